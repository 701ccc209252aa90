"""Mixing sources to target weights by hash-threshold histograms.

Every row has a 48-bit hash of its id. Tokens are summed by source and by the
first 12 bits of the hash; the bucket in which a source's running sum passes
its budget is the only one that the next 12 bits refine. What results is one
hash threshold for each source and budget, by which the rows are filtered.
Nothing is sorted but the 4096 sums of a bucket.
"""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import quoted, small, spare, table, word_count, written

BITS, LEVELS = 12, 4
#: Parts of all tokens, per thousand, that the nested mixes have.
BUDGETS = (250, 500, 1000)


def row_hash(doc_id: Column, text: Column) -> Column:
    """48 bits of the MD5 of the id, or of the text where the id is null."""
    of = F.coalesce(doc_id.cast("string"), F.concat(F.lit("t:"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(of), 1, BITS * LEVELS // 4), 16, 10).cast("bigint")


def whole_weights(weights: dict[str | None, float]) -> list[tuple[str | None, Decimal]]:
    """The weights in whole numbers of the same ratios; fractions are taken as they are printed."""
    exact = {k: Fraction(str(w)) for k, w in weights.items()}
    if any(w < 0 for w in exact.values()):
        raise ValueError("weights can't be negative")
    scale = math.lcm(*(w.denominator for w in exact.values()))
    return [(k, Decimal(int(w * scale))) for k, w in exact.items()]


def thresholds(sized: DataFrame, weights: dict[str | None, float] | None, budgets: tuple[int, ...]) -> DataFrame:
    """(src, tier, below): a row of ``src`` belongs to the mix ``tier`` if its hash is less than ``below``.

    ``sized`` has src, h and tokens and is read once a level. Budgets are
    counted in decimals of 38 digits.
    """
    spark = sized.sparkSession
    by = sized.groupBy("src").agg(F.sum("tokens").alias("total"))
    if weights:
        known = spark.createDataFrame(whole_weights(weights), "w_src string, w decimal(38,0)")
        by = by.join(F.broadcast(known), F.col("src").eqNullSafe(F.col("w_src")), "left").select("src", "total", F.coalesce("w", F.lit(Decimal(0))).cast("decimal(38,0)").alias("w"))
    else:
        by = by.withColumn("w", F.lit(Decimal(1)).cast("decimal(38,0)"))
    whole = by.agg(F.sum("total").cast("decimal(38,0)").alias("all_tokens"), F.sum("w").cast("decimal(38,0)").alias("all_w"))
    tiers = spark.createDataFrame([(t,) for t in sorted(budgets)], "tier int")
    bound = by.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(tiers)).select(
        "src", "tier", F.expr("coalesce(cast((all_tokens * tier * w) div (1000 * nullif(all_w, 0)) as bigint), 0)").alias("budget"),
        F.lit(0).cast("bigint").alias("base"), F.lit(0).cast("bigint").alias("low"), F.lit(True).alias("open"),
    )
    bound = written(bound, "mix-bounds")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = small(bound.filter("open").select(F.col("src").alias("b_src"), "low").distinct())
        rows = sized.join(inside, F.col("src").eqNullSafe(F.col("b_src")) & (F.expr(f"shiftright(h, {shift + BITS}) = shiftright(low, {shift + BITS})")))
        sums = rows.groupBy("src", F.expr(f"shiftleft(shiftright(h, {shift}), {shift})").alias("bucket")).agg(F.sum("tokens").alias("tokens"), (F.min("h") < F.max("h")).alias("more"))
        running = sums.withColumn("cum", F.sum("tokens").over(W.partitionBy("src", F.expr(f"shiftright(bucket, {shift + BITS})")).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)))
        running = running.select(F.col("src").alias("r_src"), "bucket", "tokens", "cum", "more")
        passed = bound.filter("open").join(running, F.col("src").eqNullSafe(F.col("r_src")) & F.expr(f"shiftright(bucket, {shift + BITS}) = shiftright(low, {shift + BITS}) and base + cum > budget"), "left")
        first = passed.groupBy("src", "tier").agg(
            F.first("budget").alias("budget"), F.first("base").alias("base0"), F.min(F.struct("bucket", "cum", "tokens", "more")).alias("at"),
        ).select(
            "src", "tier", "budget", F.coalesce(F.expr("base0 + at.cum - at.tokens"), F.col("base0")).alias("base"),
            # no bucket passes the budget: all rows of the source fit
            F.coalesce("at.bucket", F.lit(1 << (BITS * LEVELS))).alias("low"), F.coalesce("at.more", F.lit(False)).alias("open"),
        )
        bound = written(first.unionByName(bound.filter("not open")), "mix-bounds")
    return bound.select("src", "tier", F.col("low").alias("below"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, budgets: tuple[int, ...] = BUDGETS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the largest mix, with ``mix_budget``, the least budget whose mix has the row.

    budgets: parts per thousand of all tokens. A source gets its weight's share
    of a budget (equal shares without ``weights``; 0 for a source that isn't in
    them; weights may be fractions), at most all it has; what it lacks isn't given to others. Mixes are
    nested: a row of a smaller one is in every larger one. Tokens are words
    between white space.

    Null or empty text has 0 tokens and stays if its hash is below the
    threshold; texts of any length are counted whole. A null source is a source of its own. A null id is hashed by its
    text; ids may be of any type. Rows of equal hash (repeated rows) stay or go together. An existing
    column mix_budget is replaced; other columns are left as they are. An empty
    table gives an empty one.
    """
    h = row_hash(quoted(id_col), quoted(text_col))
    sized = written(docs.select(quoted(source_col).cast("string").alias("src"), h.alias("h"), word_count(quoted(text_col)).alias("tokens")), "mix-sizes")
    cut = thresholds(sized, weights, budgets)
    names = [c for c in docs.columns if c.lower() != "mix_budget"]
    h_name, src_name, *tiers = spare(docs, "mix_budget_h", "mix_budget_src", *(f"mix_budget_{t}" for t in budgets))
    wide = cut.groupBy(F.col("src").alias(src_name)).agg(*[F.max(F.when(F.col("tier") == t, F.col("below"))).alias(c) for t, c in zip(budgets, tiers)])
    rows = docs.select(*map(quoted, names), h.alias(h_name))
    joined = rows.join(small(wide), quoted(source_col).cast("string").eqNullSafe(F.col(src_name)))
    least = reduce(lambda c, t: F.when(F.col(h_name) < F.col(t[1]), F.lit(t[0])).otherwise(c), sorted(zip(budgets, tiers), reverse=True), F.lit(None).cast("int"))
    return joined.filter(least.isNotNull()).select(*map(quoted, names), least.alias("mix_budget"))


def query(spark, sf_dir):
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", word_count(F.col("text")).alias("tokens"), "mix_budget")


_TIER = " ".join(f"when cum <= (all_tokens * {t}) // (1000 * n_src) then {t}" for t in sorted(BUDGETS))
SQL = rf"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+')) as bigint) as tokens,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 't:' || coalesce(text, ''))), 1, 12) as bigint) as h
  from documents),
s as (select cast(sum(tokens) as bigint) as all_tokens, count(distinct coalesce('s' || source, '')) as n_src from d),
c as (select d.*, cast(sum(tokens) over (partition by source order by h range unbounded preceding) as bigint) as cum from d)
select doc_id, source, tokens, cast(case {_TIER} end as integer) as mix_budget
from c, s where cum <= (all_tokens * {max(BUDGETS)}) // (1000 * n_src)
"""
