"""Ranked and Boolean retrieval over postings with document sizes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.score import Scorer, bm25_linear
from ..functions.text import DELIMITERS, MAX_BYTES, term_frequencies
from ..shared import small

AND, OR = "c", "d"
#: What next_geq() returns if there is no such document.
END = (1 << 32) - 1
#: Scores are rounded to so many places before they are compared, so that the order of summing decides no tie.
PLACES = 9


class TermNotFound(LookupError):
    """A query term that no document has."""


def parse_query(line: str, analyze: bool = False) -> list[str]:
    """Terms between white space, as they are; with ``analyze`` in lower case and split as documents are."""
    if not analyze:
        return line.split()
    return [t for t in re.split(DELIMITERS, line.lower()) if 0 < len(t.encode()) <= MAX_BYTES]


def query_terms(spark: SparkSession, terms: Sequence[str], mode: str) -> DataFrame:
    """(term, qtf): how often each term counts. AND counts repeated terms, OR doesn't."""
    counts = Counter(terms) if mode == AND else dict.fromkeys(terms, 1)
    return spark.createDataFrame(list(counts.items()), "term string, qtf bigint")


def open_list(posts: DataFrame, term: str) -> DataFrame:
    """A term's postings by document; on a stored index the filter reaches the files, which are sorted by term."""
    return posts.filter(F.col("term") == term)


def next_geq(posts: DataFrame, term: str, at_least: int) -> DataFrame:
    """One row (doc_id): the term's least document of that id or more, or END."""
    return open_list(posts, term).filter(F.col("doc_id") >= at_least).agg(F.coalesce(F.min("doc_id"), F.lit(END)).alias("doc_id"))


def frequency(posts: DataFrame, term: str, doc_id: int) -> DataFrame:
    """(freq) of a term in a document; no row if it isn't there."""
    return open_list(posts, term).filter(F.col("doc_id") == doc_id).select("freq")


def boolean(posts: DataFrame, terms: Sequence[str], mode: str) -> DataFrame:
    """(doc_id) of the documents that have all (AND) or any (OR) of the terms; no terms, no documents."""
    distinct = sorted(set(terms))
    found = posts.filter(F.col("term").isin(distinct))
    if mode == OR:
        return found.select("doc_id").distinct()
    return found.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(distinct)).filter(F.lit(bool(distinct))).select("doc_id")


def without(posts: DataFrame, terms: Sequence[str], excluded: Sequence[str]) -> DataFrame:
    """(doc_id) of the documents that have any of ``terms`` and none of ``excluded``."""
    return boolean(posts, terms, OR).join(boolean(posts, excluded, OR), "doc_id", "left_anti")


def narrow(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(doc_id, size, found) of all documents: their sizes and how often they have each of the terms.

    It is a few numbers a document. A search that isn't on a stored index reads
    it for postings, df and the collection's figures; write it to read and
    tokenise the documents once.
    """
    return docs.select("doc_id", "size", term_frequencies(F.col("tokens"), sorted(set(terms))).alias("found"))


def matches(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Postings (term, doc_id, freq, size) of the given terms only, straight from documents or narrow(): nothing else is exploded or shuffled."""
    rows = docs if "found" in docs.columns else narrow(docs, terms)
    return rows.select("doc_id", "size", F.inline_outer("found")).filter("term is not null").select("term", "doc_id", "freq", "size")


def scored(posts: DataFrame, lex: DataFrame, stats: DataFrame, query: DataFrame, scorer: Scorer = bm25_linear) -> DataFrame:
    """The query's postings with term_score. ``query`` has term, qtf and may have query_id; stats is one row. Terms and figures of many queries are broadcast if they are small enough."""
    words = small(query.join(lex, "term"))
    rows = posts.join(words, "term").crossJoin(F.broadcast(stats))
    score = F.col("qtf") * scorer(F.col("freq"), F.col("df"), F.col("size"), F.col("n"), F.col("davg"))
    return rows.withColumn("term_score", F.coalesce(score, F.lit(0.0)))


def totals(rows: DataFrame, *keys: str) -> DataFrame:
    """A row for each document (and of ``keys``): score, size, n_terms and the frequency of each term."""
    freqs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "freq"))))
    return rows.groupBy(*keys, "doc_id").agg(F.round(F.sum("term_score"), PLACES).alias("score"), F.first("size").alias("size"), F.count("*").alias("n_terms"), freqs.alias("query_freqs"))


def best_first() -> list:
    """Score, then the larger document, then the lesser id."""
    return [F.desc("score"), F.desc("size"), F.asc("doc_id")]


def top_k(posts: DataFrame, lex: DataFrame, stats: DataFrame, terms: Sequence[str], mode: str = OR, k: int = 10, scorer: Scorer = bm25_linear, strict: bool = False) -> DataFrame:
    """(doc_id, score, size, query_freqs) of the k best documents.

    A term that isn't in the lexicon leaves AND without a result and is ignored
    by OR; with ``strict`` it raises. No terms give no rows.
    """
    if mode not in (AND, OR):
        raise ValueError("wrong input: the mode is c or d")
    distinct = sorted(set(terms))
    if strict and (missing := set(distinct) - {r[0] for r in lex.filter(F.col("term").isin(distinct)).select("term").collect()}):
        raise TermNotFound(", ".join(sorted(missing)))
    query = query_terms(posts.sparkSession, terms, mode)
    found = totals(scored(posts.filter(F.col("term").isin(distinct)), lex.filter(F.col("term").isin(distinct)), stats, query, scorer))
    if mode == AND:
        found = found.filter(F.col("n_terms") == len(distinct))
    return found.select("doc_id", "score", "size", "query_freqs").orderBy(*best_first()).limit(k)


def batch(posts: DataFrame, lex: DataFrame, stats: DataFrame, queries: DataFrame, k: int = 10, scorer: Scorer = bm25_linear) -> DataFrame:
    """(query_id, rank, doc_id, score, size, query_freqs) of many queries at once; ``queries`` has query_id, term and mode, a row for each word.

    The postings are read once for all queries; ranks are cut before the shuffle.
    """
    words = queries.groupBy("query_id", "mode", "term").agg(F.count("*").alias("times"))
    asked = words.groupBy("query_id").agg(F.count("*").alias("asked"))
    query = words.join(asked, "query_id").withColumn("qtf", F.when(F.col("mode") == AND, F.col("times")).otherwise(1)).drop("times")
    found = totals(scored(posts, lex, stats, query, scorer), "query_id", "mode", "asked").filter((F.col("mode") == OR) | (F.col("n_terms") == F.col("asked")))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*best_first()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score", "size", "query_freqs")


def with_pages(top: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """The few rows of ``top`` with columns of their documents, which are read for those ids only."""
    return docs.select("doc_id", *columns).join(F.broadcast(top), "doc_id")
