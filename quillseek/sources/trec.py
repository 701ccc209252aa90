"""Documents from TREC files: each <TEXT> holds a URL on the next line and then HTML up to </TEXT>."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.invert import number_documents
from ..shared import quoted

#: Ends a document; a file is split at it, so that one large file is read by many tasks.
END = "</TEXT>"
#: Bytes that are read at a time of a UTF-16 file.
READ = 4 << 20
_PIECE = r"(?s)<TEXT>[^\n]*\n([^\n]*)\n(.*)"


def _pieces(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame:
    """(file, block, at, value): what lies before each END; (block, at) ascends within a file."""
    rows = spark.read.option("lineSep", END).text(list(paths))
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def _unended(pieces: DataFrame) -> DataFrame:
    """(file, last_block, last_at) of the last piece of each file that doesn't end with END."""

    def cut_off(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for name in b["file"]:
                system, path = fs.FileSystem.from_uri(name)
                with system.open_input_file(path) as f:
                    f.seek(max(0, f.size() - len(END)))
                    keep.append(f.read() != END.encode())
            yield b[keep]

    last = pieces.groupBy("file").agg(F.max(F.struct("block", "at")).alias("last")).select("file", F.col("last.block").alias("last_block"), F.col("last.at").alias("last_at"))
    return last.mapInPandas(cut_off, last.schema)


def _wide_pieces(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame:
    """(file, block, at, value) of UTF-16 files, each read by one task, some READ bytes at a time; what isn't ended is left out."""
    files = spark.read.format("binaryFile").load(list(paths)).select(F.col("path").alias("file"))  # the names only: content isn't read

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["file"]:
                system, path = fs.FileSystem.from_uri(name)
                decoder, rest, at = codecs.getincrementaldecoder("utf-16")(), "", 0
                with system.open_input_stream(path, compression=None) as f:
                    while data := f.read(READ):
                        *done, rest = (rest + decoder.decode(data)).split(END)
                        if done:
                            yield pd.DataFrame({"file": name, "block": 0, "at": range(at, at + len(done)), "value": done})
                            at += len(done)

    return files.repartition(max(1, files.count()), "file").mapInPandas(run, "file string, block bigint, at bigint, value string")


def read_trec(spark: SparkSession, *paths: str, utf16: bool = False) -> DataFrame:
    """(doc_id, url, html), numbered from 1 in the order of files and places.

    The rest of the line after <TEXT> is dropped. A document that isn't ended,
    one with an empty URL, and all other tags are left out; those take no number.
    Files of any size are split among tasks; UTF-16 files, decoded with their
    byte order mark, are read as streams by one task each.
    """
    if utf16:
        rows = _wide_pieces(spark, paths)
    else:
        rows = _pieces(spark, paths)
        cut = F.broadcast(_unended(rows.select("file", "block", "at")).withColumnRenamed("file", "cut_file"))  # a row a file at most
        rows = rows.join(cut, (F.col("file") == F.col("cut_file")) & (F.col("block") == F.col("last_block")) & (F.col("at") == F.col("last_at")), "left_anti")
    text = rows.select("file", "block", "at", F.regexp_replace("value", "\r\n", "\n").alias("d")).filter(F.contains("d", F.lit("<TEXT>")))
    docs = text.select("file", F.struct("block", "at").alias("place"), F.trim(F.regexp_replace(F.regexp_extract("d", _PIECE, 1), r"\s+$", "")).alias("url"), F.regexp_extract("d", _PIECE, 2).alias("html"))
    return number_documents(docs.filter("url <> ''"), F.col("file"), F.col("place")).select("doc_id", "url", "html")


def write_trec(pages: DataFrame, folder: str, id_col: str, url_col: str, html_col: str, utf16: bool = False) -> None:
    """Write every row as a document, in ranges of the id; a null URL or text is an empty one. A URL's line breaks and ends of documents within a text become spaces."""
    url, html = (F.coalesce(quoted(c), F.lit("")) for c in (url_col, html_col))
    line = F.concat(F.lit("<DOC>\n<DOCNO>"), quoted(id_col).cast("string"), F.lit("</DOCNO>\n<TEXT>\n"), F.regexp_replace(url, r"[\r\n]", " "), F.lit("\n"), F.replace(html, F.lit(END), F.lit(" ")), F.lit(f"{END}\n</DOC>"))
    rows = pages.repartitionByRange(quoted(id_col)).sortWithinPartitions(quoted(id_col)).select(line.alias("value"))
    if not utf16:
        rows.write.text(folder)
        return

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/part-{TaskContext.get().partitionId():05}.trec", compression=None) as f:
            f.write(codecs.BOM_UTF16_LE)
            for b in batches:
                for text in b["value"]:
                    f.write((text + "\n").encode("utf-16-le", "surrogatepass"))
        yield pd.DataFrame({"n": [1]})

    rows.mapInPandas(run, "n int").count()
