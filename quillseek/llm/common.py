"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import quoted, shared_dir, small
from ..shared import written as _written

__all__ = ["bitmap", "id_back", "id_key", "is_marked", "key_type", "quoted", "row_key", "shared_dir", "small", "small_batches", "spare", "table", "word_count", "written"]

#: Rows of text, and of chunks with it, that go to Python at a time, and bytes after which no row is added to them.
TEXT_ROWS, TEXT_BYTES = 100, 4 << 20
#: Bits of a bitmap for each of its keys, and the most bits of one (64 MB).
MARK_BITS, MOST_BITS = 16, 1 << 29
#: Never an id in practice; stands for the null id where ids are integers.
NO_ID = -(2**63)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The result has no lineage, so a lost executor costs a reread, and a stage
    that is used several times is computed once. Texts go to Python in batches
    of TEXT_ROWS, and about TEXT_BYTES, meanwhile, as both sides hold whole batches.
    """
    with _text_batches(df.sparkSession):
        return _written(df, label)


def _size(value: str) -> int:
    """The number that a setting has, in bytes if it has a unit."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", value.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


@contextmanager
def _text_batches(spark: SparkSession) -> Iterator[None]:
    most = {"spark.sql.execution.arrow.maxRecordsPerBatch": TEXT_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": TEXT_BYTES}
    before = {conf: spark.conf.get(conf) for conf in most}
    for conf, value in before.items():
        if not 0 < _size(value) <= most[conf]:
            spark.conf.set(conf, str(most[conf]))
    try:
        yield
    finally:
        for conf, value in before.items():
            spark.conf.set(conf, value)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after setting the session's rows of an Arrow batch to TEXT_ROWS if they are Spark's default.

    For results that the caller runs: both sides hold whole batches, and what
    the JVM took for large ones outside of its heap it doesn't give back.
    Batches have no influence on results.
    """
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(conf) == "10000":
        df.sparkSession.conf.set(conf, str(TEXT_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("bigint")


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that ``df`` has no column of, letter case aside."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _integral(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _type_of(df: DataFrame, name: str) -> T.DataType:
    return df.select(quoted(name)).schema[0].dataType


def id_key(df: DataFrame, id_col: str) -> Column:
    """The id as a never-null column that sorts as it does, null first: a bigint for integers, a string for all other types."""
    c = quoted(id_col)
    if _integral(_type_of(df, id_col)):
        return F.coalesce(c.cast("bigint"), F.lit(NO_ID))
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c.cast("string")))


def key_type(df: DataFrame, id_col: str) -> str:
    return "bigint" if _integral(_type_of(df, id_col)) else "string"


def id_back(df: DataFrame, id_col: str, key: Column) -> Column:
    """The id, in its own type, of a key that id_key() made."""
    kind = _type_of(df, id_col)
    if _integral(kind):
        return F.when(key != NO_ID, key.cast(kind))
    return F.when(key != "", F.substring(key, 2, 2**31 - 1).cast(kind))


def row_key(df: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two never-null columns that tell rows apart unless id and text are equal."""
    return id_key(df, id_col), F.xxhash64(F.coalesce(quoted(text_col), F.lit("\0")))


def bitmap(keys: DataFrame, least: int = 1 << 10) -> Broadcast:
    """Bits, two for each of ``keys`` (one bigint column, already hashed), for is_marked(), on all executors.

    The bits are OR-ed on the executors; the driver gets words of 64 bits, at
    most MOST_BITS and at least ``least`` (a power of 2) in all. Beyond MOST_BITS / MARK_BITS keys, more other keys
    pass; whoever asks has an exact join after it.
    """
    (name,) = keys.columns
    n = keys.count()
    bits = min(MOST_BITS, max(least, 1 << (MARK_BITS * n).bit_length()))
    k = quoted(name)
    places = F.explode(F.array(k.bitwiseAND(bits - 1), F.shiftrightunsigned(k, 32).bitwiseAND(bits - 1)))
    words = keys.select(places.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("m")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    if words.num_rows:
        out[words["w"].to_numpy()] = words["m"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def is_marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each of ``keys`` (int64) may be one of those of bitmap()."""
    low = np.uint64(len(bits) * 64 - 1)
    k = keys.view(np.uint64)
    ok = np.ones(len(k), bool)
    for at in (k & low, (k >> np.uint64(32)) & low):
        ok &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok
