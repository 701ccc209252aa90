"""Snippets: the lines around the one that scores best for the query's terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.score import B, K1
from ..functions.text import lines, tokenize

SHOWN = 5


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, size, idx, line) of the lines that aren't empty; idx counts from 0."""
    return docs.select("doc_id", "size", F.posexplode_outer(lines(F.col("body"))).alias("idx", "line")).filter("line is not null").withColumn("idx", F.col("idx").cast("bigint"))


def _line_arrays(docs: DataFrame) -> DataFrame:
    """(doc_id, size, l) of the documents that have lines; all that follows stays within a document's row."""
    return docs.select("doc_id", "size", lines(F.col("body")).alias("l")).filter(F.size("l") > 0)


def line_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, mean_bytes): the whole part of the mean length of a line in bytes."""
    total = F.aggregate("l", F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x))
    return _line_arrays(docs).select("doc_id", F.size("l").cast("bigint").alias("n_lines"), F.floor(total / F.size("l")).cast("bigint").alias("mean_bytes"))


def _line_score(freq: Column, df: Column, length: Column, n: Column, mean: Column) -> Column:
    idf = F.log10(F.when(n - df + 0.5 > 0, (n - df + 0.5) / (df + 0.5)))
    return F.coalesce(F.when(freq > 0, idf * (K1 + 1) * freq / (K1 * ((1 - B) + B * length / mean))), F.lit(0.0))


def _scores(docs: DataFrame, terms: Sequence[str], exact: bool) -> DataFrame:
    """(doc_id, l, scores): the score of every line, in order; see scored_lines()."""
    words = sorted(set(terms))
    equal = lambda w: lambda x: x == F.lit(w)
    split = _line_arrays(docs).withColumn("t", F.transform("l", lambda x: F.struct(F.octet_length(x).alias("d"), tokenize(x).alias("t"))))
    counts = F.transform("t", lambda x: F.struct(x["d"].alias("d"), *[F.size(F.filter(x["t"], equal(w))).alias(f"f{i}") for i, w in enumerate(words)]))
    rows = split.select("doc_id", "size", "l", counts.alias("c"))
    having = lambda i: F.size(F.filter("c", lambda y: y[f"f{i}"] > 0))
    total = F.aggregate("c", F.lit(0).cast("bigint"), lambda a, y: a + y["d"])
    rows = rows.select("doc_id", "size", "l", "c", F.floor(total / F.size("c")).alias("mean"), *[having(i).alias(f"df{i}") for i in range(len(words))])

    def score(y: Column) -> Column:
        out = F.lit(0.0)
        for i in range(len(words)):
            out = out + _line_score(y[f"f{i}"], F.col(f"df{i}"), y["d"], F.col("size"), F.col("mean"))
        out = F.round(out, 9)
        return out if exact else F.greatest(F.floor(out), F.lit(0)).cast("bigint")

    return rows.select("doc_id", "l", F.transform("c", score).alias("scores"))


def scored_lines(docs: DataFrame, terms: Sequence[str], exact: bool = False) -> DataFrame:
    """(doc_id, idx, line, n_lines, score) of every line.

    The score takes the document's size as the number of documents, lines that
    have the term as its df and bytes as lengths. It is cut to its whole part
    and to 0 at least, unless ``exact``. A term in more lines than the size
    allows counts nothing.
    """
    rows = _scores(docs, terms, exact).select("doc_id", F.size("l").cast("bigint").alias("n_lines"), F.posexplode_outer(F.arrays_zip("l", "scores")).alias("idx", "x"))
    return rows.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.col("x.l").alias("line"), "n_lines", F.col("x.scores").alias("score"))


def _best(docs: DataFrame, terms: Sequence[str], exact: bool) -> DataFrame:
    """(doc_id, l, top): top has the score and idx of the best line, the last of equals."""
    top = F.array_max(F.transform("scores", lambda s, i: F.struct(s.alias("score"), i.cast("bigint").alias("idx"))))
    return _scores(docs, terms, exact).select("doc_id", "l", top.alias("top"))


def best_lines(docs: DataFrame, terms: Sequence[str], exact: bool = False) -> DataFrame:
    """(doc_id, best, best_score, n_lines): the line of the best score, the last of equals."""
    return _best(docs, terms, exact).select("doc_id", F.col("top.idx").alias("best"), F.col("top.score").alias("best_score"), F.size("l").cast("bigint").alias("n_lines"))


def window_start(best: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(best - SHOWN // 2, n - SHOWN))


def _window(docs: DataFrame, terms: Sequence[str], exact: bool) -> DataFrame:
    """(doc_id, low, shown): the SHOWN lines around the best one, moved to stay within the text, and the first one's number."""
    rows = _best(docs, terms, exact).withColumn("low", window_start(F.col("top.idx"), F.size("l")))
    return rows.select("doc_id", "low", F.slice("l", F.col("low").cast("int") + 1, F.lit(SHOWN)).alias("shown"))


def window_lines(docs: DataFrame, terms: Sequence[str], exact: bool = False) -> DataFrame:
    """(doc_id, idx, line) of the lines that are shown."""
    rows = _window(docs, terms, exact).select("doc_id", "low", F.posexplode_outer("shown").alias("i", "line"))
    return rows.select("doc_id", (F.col("low") + F.col("i")).cast("bigint").alias("idx"), "line")


def snippets(docs: DataFrame, terms: Sequence[str], exact: bool = False) -> DataFrame:
    """(doc_id, snippet); a line break (CR LF) follows each line. A document without lines has no row."""
    return _window(docs, terms, exact).select("doc_id", F.concat(F.array_join("shown", "\r\n"), F.lit("\r\n")).alias("snippet"))
