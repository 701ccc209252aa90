"""Tables that cut lineage, in the folder that all executors share, and sides that are small enough to be sent to all of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest side, in bytes, that is broadcast.
BROADCAST_BYTES = 16 << 20
#: Bytes of the tables that are read, for each partition of a shuffle of their postings: some 1.3 million rows, which a task sorts in memory.
PART_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local, a temporary folder is made
    and set instead.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="quillseek-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The result has no lineage, so a lost executor costs a reread, and a stage
    that is used several times is computed once.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(df: DataFrame) -> int:
    """Partitions for a shuffle of ``df``'s rows: one for each PART_BYTES of the tables that it reads, or the session's number if that is more or their bytes aren't known."""
    conf, leaves = df.sparkSession._jsparkSession.sessionState().conf(), df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < conf.defaultSizeInBytes())
    return max(conf.numShufflePartitions(), -(-known // PART_BYTES))


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its rows take at most BROADCAST_BYTES, which are summed first; ``df`` should be a written table or little more."""
    size = F.lit(32).cast("bigint")
    for f in df.schema:
        c = quoted(f.name)
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            size = size + F.coalesce(F.octet_length(F.to_json(c)), F.lit(0))
        else:
            size = size + F.lit(16)
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df
