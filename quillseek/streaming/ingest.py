"""Adding documents to an index as files arrive. An addition of this engine; the batch path doesn't need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import blocks
from ..operators.invert import postings, prepare, stats
from ..plans.engine import SearchIndex
from ..schemas import DOCS, POSTINGS


def ingest(spark: SparkSession, source: str, schema: StructType, folder: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", url_col: str | None = None, html: bool = False) -> StreamingQuery:
    """Append docs and postings of every new Parquet file under ``source`` to ``folder``.

    Each micro-batch writes partition batch=<id> of both tables and overwrites
    it if the batch is run again, so a restart adds nothing twice. Ends when all
    files that are there have been read.
    """
    def add(rows: DataFrame, batch: int) -> None:
        docs = prepare(rows, id_col, text_col, url_col, html)
        for name, df in (("docs", docs.select(*DOCS.fieldNames())), ("postings", postings(docs, with_size=True).sortWithinPartitions("term", "doc_id"))):
            df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish(spark: SparkSession, folder: str, sparse: bool = True) -> SearchIndex:
    """Make lexicon and figures of all that ingest() has added so far, and load the index.

    It is a batch job over the postings; run it after ingest() has ended.
    """
    posts = spark.read.parquet(f"{folder}/postings").select(*POSTINGS.fieldNames())
    blocks.positions(posts, sparse).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/lexicon")
    stats(spark.read.parquet(f"{folder}/docs")).write.mode("overwrite").parquet(f"{folder}/stats")
    return SearchIndex.load(spark, folder)
