"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A profile is the most frequent 1- to 3-grams of a language's labelled sample,
in order of frequency. A document's own list is compared to each profile by the
out-of-place distance: the sum over its n-grams of how far their ranks are
apart, with the greatest rank for n-grams that the profile lacks.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_back, id_key, key_type, quoted, small, small_batches, table, written

#: N-grams in a list; labelled documents a language that profiles are fitted on, at most.
PROFILE, SAMPLE = 400, 400
#: Documents whose distance, as a part of the greatest possible one, is above this are in no known language.
MAX_DISTANCE = 0.78
#: N-grams that a text needs for the distance to decide; a shorter one is only labelled.
MIN_GRAMS = 40


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() or unicodedata.category(chr(i))[0] == "M" for i in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """N-grams of the words of ``text`` as integers, in any order."""
    low = unicodedata.normalize("NFC", text.lower())
    x = np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letters()[x]
    x = np.where(is_letter, x, 32).astype(np.int64)
    x = np.concatenate(([32], x, [32]))
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)  # one space between words
    x = x[keep]
    if len(x) < 3:
        return x[:0]
    two, mid = (x[:-1] << 21) | x[1:], x[1:-1]
    three = (x[:-2] << 42) | (mid << 21) | x[2:]
    return np.concatenate((x[x != 32], two, three[mid != 32]))


def top_grams(counts: dict[int, int] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The PROFILE most frequent n-grams (ties: the lesser code first) and their counts."""
    if isinstance(counts, dict):
        grams, n = np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
    else:
        grams, n = np.unique(counts, return_counts=True)
    if len(grams) > 4 * PROFILE:  # only those that can be among the first
        least = np.partition(n, len(n) - PROFILE)[len(n) - PROFILE]
        grams, n = grams[n >= least], n[n >= least]
    order = np.lexsort((grams, -n))[:PROFILE]
    return grams[order], n[order]


def fit_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> dict[str, list[int]]:
    """language: its n-grams by rank, from the ``sample`` labelled rows a language whose ids hash least."""
    lang, key = quoted(lang_col).cast("string"), id_key(docs, id_col)
    ids = docs.filter(quoted(lang_col).isNotNull() & quoted(id_col).isNotNull()).select(lang.alias("lang"), key.alias("id"))
    first = ids.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))).filter(F.col("n") <= sample)
    chosen = small(written(first.select("lang", "id").distinct(), "profile-sample"))  # at most ``sample`` rows a language
    rows = docs.select(lang.alias("lang"), key.alias("id"), quoted(text_col).alias("text")).filter("text is not null").join(chosen, ["lang", "id"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                grams, n = np.unique(_codes(text), return_counts=True)
                if len(grams):
                    yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})

    grams = rows.mapInPandas(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = grams.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= PROFILE)
    out: dict[str, list[int]] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["lang"], r["r"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Ranker:
    """Distances of texts to profiles."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.grams = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, np.array(profiles[lang], np.int64)), k] = np.arange(len(profiles[lang]))

    def score(self, text: str | None) -> tuple[str | None, float | None, float | None, int]:
        """(language, its distance as a part of the greatest, how much less than the next best, n-grams);
        None for a text without letters or without profiles. Ties go to the first language by name."""
        codes = _codes(text) if text else np.empty(0, np.int64)
        if not len(codes) or not self.langs:
            return None, None, None, len(codes)
        own, _ = top_grams(codes)
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        there = self.ranks[at]
        far = np.where(there < 0, PROFILE, np.abs(there - np.arange(len(own))[:, None])).sum(0)
        order = np.argsort(far, kind="stable")
        most = PROFILE * len(own)
        best = float(far[order[0]]) / most
        margin = float(far[order[1]]) / most - best if len(order) > 1 else 1.0 - best
        return self.langs[order[0]], best, margin, len(codes)


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """(id, declared, language, distance, margin, accepted) for every row.

    accepted is false for a text that has no letter (null and empty texts too:
    language, distance and margin are null) and for one of at least MIN_GRAMS
    n-grams whose distance to the nearest profile is over MAX_DISTANCE. The
    declared language decides nothing. Without profiles, every text that has
    letters is accepted and its language is null. Of equally near languages, the
    first by name is taken. Texts are read whole; repeated rows give repeated
    results; null ids are kept and ids keep their type. An empty table gives an
    empty one. Other columns aren't read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranker = Ranker(profiles)
        for b in batches:
            got = [ranker.score(t) for t in b["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"], "declared": b["declared"], "language": [g[0] for g in got], "distance": pd.array([g[1] for g in got], "Float64"),
                    "margin": pd.array([g[2] for g in got], "Float64"), "accepted": [_accepted(g[1], g[3]) for g in got],
                }
            )

    rows = docs.select(id_key(docs, id_col).alias("doc_id"), quoted(lang_col).cast("string").alias("declared"), quoted(text_col).alias("text"))
    out = rows.mapInPandas(run, f"doc_id {key_type(docs, id_col)}, declared string, language string, distance double, margin double, accepted boolean")
    return out.withColumn("doc_id", id_back(docs, id_col, F.col("doc_id")))


def _accepted(distance: float | None, grams: int) -> bool:
    return grams > 0 and (distance is None or grams < MIN_GRAMS or distance <= MAX_DISTANCE)


def accept(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that identify() accepts, all columns as they are."""

    @F.pandas_udf("boolean")
    def accepted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranker = Ranker(profiles)
        for t in texts:
            yield pd.Series([_accepted((s := ranker.score(x))[1], s[3]) for x in t], dtype=bool)

    return small_batches(docs).filter(accepted(quoted(text_col)))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_profiles(docs))
