"""Documents from Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.invert import prepare


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The table documents, without URLs or HTML; see prepare()."""
    return prepare(read_table(spark, folder, "documents"), "doc_id", "text")


def html_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The table pages; see prepare()."""
    return prepare(read_table(spark, folder, "pages"), "page_id", "html", "url", html=True)
