"""Postings as files of other layouts: varbyte records (docid, freq, length, term), text, and id triples."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import lengths, put, raw_bytes, taken
from ..operators.invert import joined
from ..schemas import RUN
from ..shared import parts


#: Bytes that are read at a time.
READ = 4 << 20


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(term, doc_id, freq) of varbyte run files, each read as a stream by one task; a record that was cut off raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(name)
                with system.open_input_stream(path, compression=None) as f:
                    rest = b""
                    while new := f.read(READ):
                        out, rest = _records(rest + new)
                        yield from (out.slice(i, 50_000) for i in range(0, out.num_rows, 50_000))
                    if rest:
                        raise ValueError(f"{name} ends within a record")

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInArrow(run, RUN)


def write_runs(posts: DataFrame, folder: str, n: int | None = None) -> list[str]:
    """Write varbyte runs, each sorted by (term, doc_id); returns their paths. Runs split the terms by range."""
    rows = posts.select(*RUN.fieldNames())
    rows = (rows.repartitionByRange(n, "term") if n else rows).sortWithinPartitions("term", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name, wrote = f"{base}/{uuid.uuid4().hex}.run", False
        with system.open_output_stream(name, compression=None) as f:
            for b in batches:
                f.write(_encoded(*b.columns))
                wrote |= b.num_rows > 0
        if wrote:
            yield pa.RecordBatch.from_pydict({"path": [name]})

    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    return sorted(scheme + r[0] for r in rows.mapInArrow(run, "path string").collect())


def _encoded(term: pa.Array, doc: pa.Array, freq: pa.Array) -> bytes:
    """The records of a batch, one after the other."""
    raw, at = raw_bytes(term)
    size = np.diff(at)
    numbers = [doc.to_numpy(), freq.to_numpy(), size]
    if any(((x < 0) | (x >= 1 << 35)).any() for x in numbers):
        raise ValueError("a number can't be encoded")
    codes = [lengths(x) for x in numbers]
    ends = np.cumsum(sum(codes) + size)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    out[np.repeat(ends - size - at[:-1], size) + np.arange(len(raw))] = raw
    end = ends - size
    for x, code in zip(reversed(numbers), reversed(codes)):
        put(out, end, x, code)
        end = end - code
    return out.tobytes()


def _records(data: bytes) -> tuple[pa.RecordBatch, bytes]:
    """The whole records that ``data`` begins with, and what is left.

    Where a record that began at a byte would end is computed for all bytes at
    once; then only the starts are followed from one to the next.
    """
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    last = np.append(np.flatnonzero(raw < 128), n)
    after = np.append(last[np.searchsorted(last[:-1], np.arange(n))] + 1, [n + 1, n + 1])  # the place after a number that begins at a byte; n + 1 if it isn't ended here
    head = after[np.minimum(after[: n + 1], n + 1)]
    size_end = after[np.minimum(head, n + 1)]
    size = np.zeros(n + 1, np.int64)
    whole = size_end <= n
    size[whole] = taken(raw, size_end[whole], (size_end - head)[whole])
    follow = (size_end + size).tolist()
    starts, at = [], 0
    while at < n and follow[at] <= n:
        starts.append(at)
        at = follow[at]
    s = np.array(starts, np.int64)
    e1, e2, e3 = after[s], head[s], size_end[s]
    numbers = [taken(raw, e1, e1 - s), taken(raw, e2, e2 - e1)]
    count = size[s]
    to = np.concatenate([[0], np.cumsum(count)])
    text = raw[np.repeat(e3 - to[:-1], count) + np.arange(to[-1])]
    terms = pa.Array.from_buffers(pa.string(), len(s), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(text)])
    terms.validate(full=True)
    return pa.RecordBatch.from_arrays([terms, *(pa.array(x, pa.int64()) for x in numbers)], RUN.fieldNames()), data[at:]


def write_text_runs(posts: DataFrame, folder: str) -> None:
    """term,doc_id,freq lines in the order of (term, doc_id)."""
    rows = posts.select(*RUN.fieldNames())
    rows.repartitionByRange(parts(rows), "term", "doc_id").sortWithinPartitions("term", "doc_id").write.csv(folder, header=False)


def read_text_runs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RUN).csv(folder)


def write_id_runs(posts: DataFrame, ids: DataFrame, folder: str) -> None:
    """(term_id, doc_id, freq) as Parquet, beside the term map in folder/terms."""
    ids.write.parquet(f"{folder}/terms")
    joined(posts, posts.sparkSession.read.parquet(f"{folder}/terms"), "term").select("term_id", "doc_id", "freq").write.parquet(f"{folder}/postings")


def read_id_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(term, doc_id, freq) of write_id_runs()."""
    ids = spark.read.parquet(f"{folder}/terms")
    return joined(spark.read.parquet(f"{folder}/postings"), ids, "term_id").select("term", "doc_id", F.col("freq"))
