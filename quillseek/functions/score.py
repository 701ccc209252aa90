"""Scorers: (freq, df, size, n, davg) -> score of one term in one document. A document's score is their sum."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
Scorer = Callable[[Column, Column, Column, Column, Column], Column]


def bm25_linear(freq: Column, df: Column, size: Column, n: Column, davg: Column) -> Column:
    """The default: BM25 without saturation, so linear in freq; the weight of terms in over half of the documents is negative."""
    idf = F.log10((n - df + 0.5) / (df + 0.5))
    return idf * (K1 + 1) * freq / (K1 * ((1 - B) + B * size / davg))


def bm25(freq: Column, df: Column, size: Column, n: Column, davg: Column) -> Column:
    """The textbook's BM25, with saturation and a natural logarithm that stays positive."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * (K1 + 1) * freq / (freq + K1 * ((1 - B) + B * size / davg))


def cosine(freq: Column, df: Column, size: Column, n: Column, davg: Column) -> Column:
    """Cosine measure; the document's own length plays no part."""
    return F.log(1 + n / df) * (1 + F.log(freq)) / F.sqrt(davg)


SCORERS: dict[str, Scorer] = {"bm25_linear": bm25_linear, "bm25": bm25, "cosine": cosine}
