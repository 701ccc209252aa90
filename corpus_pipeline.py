"""From documents to a training mix: five stages, each a written table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillseek.llm import decontam, langid, linededup, mixing, simhash
from quillseek.llm.common import quoted, shared_dir, spare, table


# Every stage keeps all columns it is given as they are (line_dedup changes text and n_chars), whatever
# their names; null, empty and very long texts, repeated rows and empty tables are as the operator defines.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and is near some language's profile; see langid.identify().

    Null and empty texts go, as they have no letters. Of repeated rows all stay or go.
    """
    return langid.accept(docs, langid.fit_profiles(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the chunks of lines that came before; documents of which nothing is left go.

    n_chars is counted anew where chunks were removed. Null and empty texts, of
    which nothing was removed, stay. Rows that repeat id and text are treated alike.
    """
    (count,) = spare(docs, "removed_chunks")
    cut = linededup.remove_repeats(docs, count_col=count).filter(~((F.col(count) > 0) & (F.trim("text") == "")))
    size = F.when(F.col(count) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[size.alias(c) if c == "n_chars" else quoted(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and all that are in none; of rows that repeat id and text, one.

    Texts without words (null and empty ones too) are in no group and stay.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark is found; null and empty texts have none and stay."""
    return decontam.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The largest mix in which sources have equal shares as far as they go, with mix_budget; see mixing.mix().

    A null source is one of its own; repeated rows stay or go together.
    """
    return mixing.mix(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mix", source_mix)]

#: SimHash groups and n-gram profiles can't be had from SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
