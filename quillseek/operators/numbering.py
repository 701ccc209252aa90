"""Dense numbers and running sums in a global order, without one partition that holds all rows.

Rows are sorted in ranges, as many as the input's size asks for, and written
once with their range and their place in it. Only the ranges' totals pass
through a window over everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import parts, written

#: monotonically_increasing_id() has the partition above these bits and the row's place within below.
_BITS = 33


def _ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df``, written, with __at, which ascends in the order, and its range __p."""
    rows = df.repartitionByRange(parts(df), *order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("__at"))
    return written(rows, "ranges").withColumn("__p", F.shiftright("__at", _BITS))


def _bases(totals: DataFrame) -> DataFrame:
    """(__p, __base) of (__p, __v), a row for each range: what the ranges before have."""
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    return F.broadcast(totals.select("__p", F.coalesce(F.sum("__v").over(before), F.lit(0)).alias("__base")))  # a row a partition


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before (not with) each in the order."""
    rows = _ranges(df.withColumn("__v", value), order)
    within = F.coalesce(F.sum("__v").over(W.partitionBy("__p").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    joined = rows.withColumn("__w", within).join(_bases(rows.groupBy("__p").agg(F.sum("__v").alias("__v"))), "__p")
    return joined.select(*df.columns, (F.col("__base") + F.col("__w")).alias(name))


def number(df: DataFrame, order: list[Column], name: str, first: int = 1) -> DataFrame:
    """``df`` with dense numbers from ``first`` in the order; sorted and shuffled once."""
    rows = _ranges(df, order)
    joined = rows.join(_bases(rows.groupBy("__p").agg(F.count("*").alias("__v"))), "__p")
    return joined.select(*df.columns, (F.col("__base") + F.col("__at").bitwiseAND((1 << _BITS) - 1) + first).alias(name))
