import gzip
import random

from quillseek.llm import warc

KIND = "page_id bigint, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], KIND + ", offset int, file string")


ROWS = [(1, "http://a.com/1", "<p>é</p>"), (2, "http://a.com/2", "<p>é</p>"), (3, None, "three"), (4, "http://a.com/4", None), (5, "http://a.com/5", ""), (None, "http://a.com/n", "nobody"), (6, "line\nbreak", "six"), (7, "http://a.com/7", "7" * 3_000_000), (8, "http://a.com/8", "WARC/1.0\r\n\r\nContent-Length: 3\r\n\r\n"), (8, "http://a.com/8", "WARC/1.0\r\n\r\nContent-Length: 3\r\n\r\n")]


def test_round_trip(spark, tmp_path):
    files = warc.write_warc(pages(spark, ROWS).repartition(3), f"file://{tmp_path}/w")
    index = warc.index_warc(files)
    got = warc.read_records(index).collect()
    assert index.count() == len(ROWS) == len(got)
    want = sorted((str(u).replace("\n", "%0A"), h or "") for _, u, h in ROWS)
    assert sorted((str(r.url), r.payload) for r in got) == want
    for r in index.collect():
        with open(r.file.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            head, body = warc.parse(gzip.decompress(f.read(r.length)))
        assert (head["warc-record-id"], head.get("warc-target-uri"), len(body), warc.digest(body)) == (r.record_id, r.url, r.payload, r.digest)


def test_few_reads(spark, tmp_path):
    """Near ranges are one read; far ones aren't read over."""
    rng = random.Random(1)
    rows = [(i, f"u{i}", "".join(rng.choices("abcdefgh", k=20_000))) for i in range(200)]
    index = warc.index_warc(warc.write_warc(pages(spark, rows).coalesce(1), f"file://{tmp_path}/w"))
    some = index.filter("url in ('u0', 'u1', 'u150', 'u199')")
    assert {r.url: r.payload for r in warc.read_records(some).collect()} == {u: h for i, u, h in rows if i in (0, 1, 150, 199)}


def test_plain_and_foreign_files(spark, tmp_path):
    raw = [warc.record(i, f"u{i}", f"body {i}") for i in range(5)]
    (tmp_path / "p.warc").write_bytes(b"".join(raw))
    (tmp_path / "g.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)) + gzip.compress(raw[0])[:-9])
    for name in ("p.warc", "g.warc.gz"):
        index = warc.index_warc(spark.createDataFrame([(f"file://{tmp_path}/{name}",)], "file string"))
        assert sorted(r.payload for r in warc.read_records(index).collect()) == [f"body {i}" for i in range(5)]


def test_distinct_pages(spark):
    got = sorted(((r.page_id, r.url, r.html, r.n_bytes) for r in warc.distinct_pages(pages(spark, ROWS)).collect()), key=str)
    want = [(1, "http://a.com/1", "<p>é</p>", 9), (3, None, "three", 5), (5, "http://a.com/5", "", 0), (None, "http://a.com/n", "nobody", 6), (6, "line%0Abreak", "six", 3), (7, "http://a.com/7", "7" * 3_000_000, 3_000_000), (8, "http://a.com/8", ROWS[8][2], len(ROWS[8][2]))]
    assert got == sorted(want, key=str)
    assert warc.distinct_pages(pages(spark, ROWS).limit(0)).count() == 0
