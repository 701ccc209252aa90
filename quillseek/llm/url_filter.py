"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

The filter is a table of 512-bit blocks (block, w0..w7), made by OR-ing the
masks of the listed URLs. A URL sets one bit in each of the 8 words of one
block, so a test reads one block. A canonical URL has no "#", which marks keys
of pages that didn't pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, small, table, written

#: Bits of the filter for each listed URL, and the most blocks: what the hash that names them can tell apart.
BITS_PER_URL, MOST_BLOCKS = 14, 1 << 40
TRACKING = r"^(utm_[a-z_]*|ref|gclid|fbclid|msclkid|sessionid)(=|$)"
#: Hosts whose pages the query lists.
LISTED_HOSTS = r"(^|\.)(ads-track|casino-win|adult-x)\."


def canonical_url(url: Column) -> Column:
    """Host without www., m. or default port, in lower case; path without its last slashes;
    parameters sorted, without those that track visits; no scheme and no fragment.
    Null and blank give null."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    head, query = F.regexp_extract(u, r"^([^?]*)", 1), F.regexp_extract(u, r"^[^?]*\?(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(head, r"^([^/]*)", 1)), r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(head, r"^[^/]*(.*)$", 1), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    out = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(out != "", out)


def _marks(canonical: Column, blocks: int) -> list[Column]:
    """The URL's block and its mask in each word."""
    at, bits = F.xxhash64(canonical), F.xxhash64(F.lit("bits"), canonical)
    place = F.shiftrightunsigned(at, 64 - int(math.log2(blocks))) if blocks > 1 else F.lit(0).cast("bigint")
    return [place.alias("block"), bits.alias("bits")]


def _mask(word: int) -> str:
    return f"shiftleft(cast(1 as bigint), cast(shiftright(bits, {6 * word}) & 63 as int))"


def bloom_table(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) of the canonical URLs in ``listed.canonical``."""
    marks = listed.select(*_marks(F.col("canonical"), blocks))
    return marks.groupBy("block").agg(*[F.expr(f"bit_or({_mask(i)})").alias(f"w{i}") for i in range(8)])


def url_filter(pages: DataFrame, listed_urls: DataFrame, id_col: str = "page_id", url_col: str = "url", list_col: str = "url") -> DataFrame:
    """(id, url, canonical_url, blocked) for every row of ``pages``.

    blocked: the canonical form of the URL is that of a listed one. Null, empty
    or blank URLs have a null canonical form and are never blocked; such entries
    of the list are ignored, as are repeated ones. URLs of any length are read
    whole. Repeated rows are all returned. Other columns of either table aren't
    read, and ids keep their type. An empty list blocks nothing; no pages give no rows.

    The filter grows with the list. As long as its blocks and the list can be
    broadcast, no page moves; beyond that, pages are shuffled by block, and only
    those that pass the filter by URL.
    """
    listed = written(listed_urls.select(canonical_url(quoted(list_col)).alias("canonical")).filter("canonical is not null").distinct(), "listed-urls")
    n = listed.count()
    blocks = min(MOST_BLOCKS, 1 << max(0, math.ceil(math.log2(max(1, n * BITS_PER_URL / 512)))))
    bloom = small(written(bloom_table(listed, blocks).withColumnRenamed("block", "b_block"), "url-blocks"))
    rows = pages.select(quoted(id_col).alias("own_id"), quoted(url_col).alias("url"), canonical_url(quoted(url_col)).alias("canonical_url"))
    marked = rows.select("*", *_marks(F.col("canonical_url"), blocks)).join(bloom, F.col("block") == F.col("b_block"), "left")
    hit = " and ".join(f"(w{i} & {_mask(i)}) <> 0" for i in range(8))
    # pages that don't pass get a key of their own that no list has, so they stay spread out
    key = F.expr(f"if(coalesce(canonical_url is not null and {hit}, false), canonical_url, concat('#', xxhash64(bits, own_id)))")
    joined = marked.withColumn("asked", key).join(small(listed), F.col("asked") == F.col("canonical"), "left")
    return joined.select(F.col("own_id").alias(id_col), "url", "canonical_url", F.col("canonical").isNotNull().alias("blocked"))


def query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]*)", 1))
    return url_filter(pages, pages.filter(host.rlike(LISTED_HOSTS)))


SQL = rf"""
with a as (select page_id, url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as u from pages),
b as (select *, regexp_extract(u, '^([^?]*)', 1) as head, regexp_extract(u, '^[^?]*\?(.*)$', 1) as query from a),
c as (select *, regexp_replace(regexp_replace(lower(regexp_extract(head, '^([^/]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '') as host,
  regexp_replace(regexp_extract(head, '^[^/]*(.*)$', 1), '/+$', '') as path,
  list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' and not regexp_matches(lower(p), '{TRACKING}'))) as kept from b),
d as (select page_id, url, nullif(host || path || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end, '') as canonical_url from c),
l as (select distinct canonical_url from d where regexp_matches(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '{LISTED_HOSTS}'))
select page_id, url, canonical_url, coalesce(canonical_url in (select canonical_url from l), false) as blocked from d
"""
