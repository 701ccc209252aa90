"""Inversion: documents to tokens, postings, lexicon, term ids and figures of the collection.

A ``docs`` frame has doc_id, url, body (lower case) and tokens; prepare() makes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Tokenizer, html_text, page_body, tokenize
from ..shared import parts
from .numbering import number


def prepare(rows: DataFrame, id_col: str, text_col: str, url_col: str | None = None, html: bool = False, tokenizer: Tokenizer = tokenize, extract: Callable[[Column], Column] = html_text) -> DataFrame:
    """(doc_id, url, body, tokens, size) of documents; rows without a body are left out, as are pages without a URL.

    The body is the text in lower case, after the URL if there is one; the
    tokens are those of the body, of its visible text with ``html``, which
    ``extract`` makes (text.html_text_full parses in Python).
    """
    url = F.trim(F.col(url_col)) if url_col else F.lit("")
    body = page_body(F.col(url_col), F.col(text_col)) if url_col else F.lower(F.col(text_col))
    docs = rows.select(F.col(id_col).cast("bigint").alias("doc_id"), url.alias("url"), body.alias("body")).filter("body is not null")
    if url_col:
        docs = docs.filter("url <> ''")
    return docs.withColumn("tokens", tokenizer(extract(F.col("body")) if html else F.col("body"))).withColumn("size", F.size("tokens").cast("bigint"))


def token_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, term), a row for each token; pos counts from 0."""
    rows = docs.select("doc_id", F.posexplode_outer("tokens").alias("pos", "term")).filter("term is not null")  # a plain posexplode would be given a filter that tokenises once more
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


def postings(docs: DataFrame, with_size: bool = False, unique: bool = False) -> DataFrame:
    """(term, doc_id, freq) and the document's size; a row for each term of a document.

    With ``unique``, no two rows of ``docs`` have one id (a primary key), so the
    tokens are counted within the row and nothing is shuffled. Otherwise a
    document may be given in parts, which are summed up; the count is partial on
    each task before the shuffle.
    """
    keep = ["size"] if with_size else []
    if unique:
        runs = docs.select("doc_id", *keep, F.sort_array("tokens").alias("s"))  # array_sort doesn't compare in generated code
        runs = runs.withColumn("at", F.expr("case when size(s) > 0 then filter(sequence(0, size(s) - 1), i -> i = 0 or s[i] <> get(s, i - 1)) end"))
        runs = runs.select("doc_id", *keep, "s", "at", F.posexplode_outer("at").alias("k", "p")).filter("p is not null")
        return runs.select(F.expr("s[p]").alias("term"), "doc_id", F.expr("cast(coalesce(get(at, k + 1), size(s)) - p as bigint)").alias("freq"), *keep)
    return docs.select("doc_id", *keep, F.explode_outer("tokens").alias("term")).filter("term is not null").groupBy("term", "doc_id", *keep).agg(F.count("*").alias("freq")).select("term", "doc_id", "freq", *keep)


def merge_runs(*runs: DataFrame) -> DataFrame:
    """One postings table of several; freq of equal (term, doc_id) is summed."""
    whole = runs[0].select("term", "doc_id", "freq")
    for r in runs[1:]:
        whole = whole.unionByName(r.select("term", "doc_id", "freq"))
    return whole.groupBy("term", "doc_id").agg(F.sum("freq").alias("freq"))


def lexicon(posts: DataFrame) -> DataFrame:
    """(term, df)."""
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size)."""
    return docs.select("doc_id", "size")


def stats(docs: DataFrame, first: int = 10_000) -> DataFrame:
    """One row (n, davg): the number of documents, and the whole part of the mean size of the ``first`` by id."""
    mean = docs.select("doc_id", "size").orderBy("doc_id").limit(first).agg(F.avg("size").cast("bigint").alias("davg"))
    return docs.agg(F.count("*").alias("n")).crossJoin(mean)


def term_ids(docs: DataFrame, unique: bool = False) -> DataFrame:
    """(term, term_id): numbers from 1 in the order in which terms are first seen.

    With ``unique``, no two rows have one id: a row's distinct tokens keep their
    order, and the least id and the place in its row are a hash aggregation;
    the least pair of id and place sorts all tokens.
    """
    if unique:
        first = docs.select("doc_id", F.posexplode_outer(F.array_distinct("tokens")).alias("pos", "term")).filter("term is not null").groupBy("term").agg(F.min("doc_id").alias("doc"), F.min_by("pos", "doc_id").alias("pos"))
        return number(first, [F.col("doc"), F.col("pos")], "term_id").select("term", "term_id")
    seen = token_rows(docs).groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    return number(seen, [F.col("at")], "term_id").select("term", "term_id")


def joined(posts: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Both by ``key`` (term or term_id), a term's row of ``ids`` to each of its postings, in as many partitions as the input's size asks for.

    A partition's terms are looked up in a hash table, so its postings, which
    are many times more, aren't sorted and don't spill.
    """
    n = max(parts(posts), parts(ids))
    return posts.repartition(n, key).join(ids.repartition(n, key).hint("shuffle_hash"), key)


def with_term_ids(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """(term_id, doc_id, freq)."""
    return joined(posts, ids, "term").select("term_id", "doc_id", "freq")


def number_documents(rows: DataFrame, file: Column, order: Column) -> DataFrame:
    """``rows`` with doc_id, from 1 in the order of file and place; numbers are dense."""
    return number(rows, [file, order], "doc_id")
