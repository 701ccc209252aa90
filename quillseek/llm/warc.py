"""WARC files read through an index.

write_warc() makes files of gzip members, one a record. index_warc() reads any
WARC files once and writes where each record lies: file, offset, length, URL
and digest. Records are then selected in the index alone, and read_records()
fetches them in order of place, with ranges that lie close together as one read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote_plus

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, shared_dir, table, written

#: Gap that is read over rather than skipped, most bytes of one read, and of a file before another is begun.
GAP, READ, FILE = 64 << 10, 8 << 20, 256 << 20
#: Most bytes of a file whose selected records are one unit of work.
SPAN = 16 << 20
LEVEL = 4
INDEX = "file string, offset bigint, length bigint, record_id string, type string, url string, digest string, payload bigint"


def digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | str | None, url: str | None, html: str | None) -> bytes:
    """One record; the id is URL-encoded and CR and LF in a URL are percent-encoded; null html is a metadata record without payload."""
    body = (html or "").encode("utf-8", "surrogatepass")
    head = ["WARC/1.0", f"WARC-Type: {'metadata' if html is None else 'resource'}", f"WARC-Record-ID: <urn:{'uuid:' + str(uuid.uuid4()) if page_id is None else 'page:' + quote_plus(str(page_id))}>", "WARC-Date: 2020-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: {digest(body)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by name in lower case, payload) of one record that isn't compressed."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers.get("content-length", 0))]


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row as a record; returns the files (file) that hold them, as a written table.

    A task writes files of its own name, so a task that is run again leaves only
    files that nothing names. Repeated rows are records of their own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, done, size = None, [], 0
        for b in batches:
            for i, url, html in zip(b["id"], b["url"], b["html"]):
                if out is None:
                    name = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, size = system.open_output_stream(name, compression=None), 0
                    done.append(name)
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = z.compress(record(i, url, html)) + z.flush()
                out.write(data)
                size += len(data)
                if size >= FILE:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pd.DataFrame({"file": done}, dtype="object")

    rows = pages.select(quoted(id_col).cast("string").alias("id"), quoted(url_col).alias("url"), quoted(html_col).alias("html"))
    return written(rows.mapInPandas(run, "file string").withColumn("file", F.concat(F.lit(_scheme(folder)), "file")), "warc-files")


def _scheme(folder: str) -> str:
    return folder.split("://")[0] + "://" if "://" in folder and not folder.startswith("file:") else "file://"


def _records(stream, size: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of a file, gzip members or plain, one in memory at a time."""
    buffer, at = b"", 0

    def more() -> bool:
        nonlocal buffer
        new = stream.read(1 << 20)
        buffer += new
        return bool(new)

    while buffer or more():
        if buffer[:2] == b"\x1f\x8b" or (len(buffer) < 2 and more() and buffer[:2] == b"\x1f\x8b"):
            z, raw, used, feed = zlib.decompressobj(31), [], 0, buffer
            while True:
                raw.append(z.decompress(feed))
                if z.eof:
                    used += len(feed) - len(z.unused_data)
                    buffer = z.unused_data
                    break
                used += len(feed)
                feed = stream.read(1 << 20)
                if not feed:
                    return  # a member that was cut off
            yield at, used, b"".join(raw)
            at += used
        else:
            while b"\r\n\r\n" not in buffer:
                if not more():
                    return
            headers, _ = parse(buffer)
            whole = buffer.index(b"\r\n\r\n") + 8 + int(headers.get("content-length", 0))
            while len(buffer) < whole:
                if not more():
                    return
            yield at, whole, buffer[:whole]
            buffer, at = buffer[whole:], at + whole


def index_warc(files: DataFrame) -> DataFrame:
    """Written table of INDEX for the files (column file); a last record that was cut off is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["file"]:
                system, path = fs.FileSystem.from_uri(name)
                rows = []
                with system.open_input_stream(path, compression=None) as stream:
                    for offset, length, raw in _records(stream, 0):
                        h, body = parse(raw)
                        rows.append((name, offset, length, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-payload-digest") or digest(body), len(body)))
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=[x.split()[0] for x in INDEX.split(", ")])
                            rows = []
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in INDEX.split(", ")])

    n = max(1, files.count())
    return written(files.select("file").repartition(min(n, 100_000), "file").mapInPandas(run, INDEX), "warc-index")


def read_records(selected: DataFrame) -> DataFrame:
    """(file, offset, record_id, url, payload) of the index rows in ``selected``.

    Rows are sorted by place within spans of at most SPAN bytes of a file, whose
    number follows from the bytes to be read, not from the size of the index;
    ranges at most GAP apart are one read of at most READ bytes (a longer record
    is read alone). Rows that repeat a place give repeated records.
    """
    spark = selected.sparkSession
    total = selected.agg(F.sum("length")).first()[0] or 0
    parts = min(100_000, max(spark.sparkContext.defaultParallelism, -(-total // SPAN)))
    span = max(1 << 20, min(SPAN, total // parts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_name, handle = None, None

        def fetch(group: list[tuple[str, int, int]]) -> pd.DataFrame:
            nonlocal open_name, handle
            name, first = group[0][0], group[0][1]
            if name != open_name:
                system, path = fs.FileSystem.from_uri(name)
                open_name, handle = name, system.open_input_file(path)
            handle.seek(first)
            data, rows = handle.read(max(o + n for _, o, n in group) - first), []
            for _, offset, length in group:
                raw = data[offset - first : offset - first + length]
                h, body = parse(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)
                rows.append((name, offset, h.get("warc-record-id"), h.get("warc-target-uri"), body.decode("utf-8", "surrogatepass")))
            return pd.DataFrame(rows, columns=["file", "offset", "record_id", "url", "payload"])

        group: list[tuple[str, int, int]] = []
        for b in batches:
            for name, offset, length in zip(b["file"], b["offset"].tolist(), b["length"].tolist()):
                if group and (name != group[-1][0] or offset - group[-1][1] - group[-1][2] > GAP or offset + length - group[0][1] > READ):
                    yield fetch(group)
                    group = []
                group.append((name, offset, length))
        if group:
            yield fetch(group)

    places = selected.select("file", "offset", "length").repartition(parts, "file", F.expr(f"offset div {span}")).sortWithinPartitions("file", "offset")
    return places.mapInPandas(run, "file string, offset bigint, record_id string, url string, payload string")


def distinct_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, n_bytes): of the pages of one content, that of the least id (null ids last, then URL), through WARC files.

    The pages are written to the shared folder, indexed, chosen by digest and
    read. Null html isn't chosen; empty html is a content like any other; null
    URLs stay null. Pages are whole, however long. Ids keep their type; no pages
    give no rows. Other columns aren't written.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    index = index_warc(write_warc(pages, folder, id_col, url_col, html_col))
    kind = pages.select(quoted(id_col)).schema[0].dataType
    of = F.regexp_extract("record_id", r"^<urn:page:(.*)>$", 1)
    page = F.when(F.col("record_id").startswith("<urn:page:"), F.url_decode(of)).cast(kind)
    ids = index.filter("type = 'resource'").withColumn("p", page)
    order = F.struct(F.col("p").isNull().alias("none"), "p", F.coalesce("url", F.lit("")).alias("u"), "file", "offset", "length")
    best = written(ids.groupBy("digest").agg(F.min(order).alias("b")).select("b.file", "b.offset", "b.length"), "warc-selected")
    return read_records(best).select(page.alias("page_id"), "url", F.col("payload").alias("html"), F.octet_length("payload").cast("bigint").alias("n_bytes"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_pages(table(spark, sf_dir, "pages"))


SQL = """
select page_id, url, html, cast(octet_length(encode(html)) as bigint) as n_bytes from (
  select *, row_number() over (partition by html order by page_id nulls last, coalesce(url, '')) as n from pages where html is not null) where n = 1
"""
