"""Work that has to grow no faster than the input: each table is shuffled once, in partitions by its size, and documents are tokenised once."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillseek import shared
from quillseek.functions import codec
from quillseek.operators import blocks, invert
from quillseek.plans.engine import SearchIndex
from quillseek.sources import runs


def plan(df):
    """Lines of the plan that is run, with what is shared marked as reused."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def exchanges(text):
    return sum("Exchange" in x and "Reused" not in x for x in text.splitlines())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(t, d, rng.randint(1, 300)) for t, n in (("a", 1), ("b", 128), ("bé", 129), ("c", 700), ("日", 256)) for d in sorted(rng.sample(range(90_000), n))]


@pytest.fixture(scope="module")
def posts(spark, rows, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("posts") / "p")
    spark.createDataFrame(random.Random(4).sample(rows, len(rows)), "term string, doc_id bigint, freq bigint").write.parquet(out)
    return spark.read.parquet(out)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(f"w{int(rng.paretovariate(1))}" for _ in range(rng.randint(0, 60)))) for i in rng.sample(range(10_000), 300)] + [(20_000, None)]
    return invert.prepare(spark.createDataFrame(texts, "id bigint, text string"), "id", "text")


def test_partitions_follow_the_size(posts, monkeypatch):
    assert shared.parts(posts) == 4  # the session's number
    monkeypatch.setattr(shared, "PART_BYTES", 1000)
    assert shared.parts(posts) > 4
    for df in (blocks.blocks(posts), blocks.chunked(posts), blocks.chunk_sizes(posts)):
        assert f"partitioning(term#" in plan(df) and f", {shared.parts(posts)})" in plan(df)  # noqa: F541


def test_postings_of_a_chunk_are_shuffled_once(posts, rows):
    for df in (blocks.blocks(posts), blocks.chunk_sizes(posts), blocks.unblock(blocks.blocks(posts)), blocks.unpack(blocks.blocks(posts, codec.FIXED), codec.FIXED)):
        assert exchanges(plan(df)) == 1
    assert exchanges(plan(blocks.unpack(posts.select("term", F.lit(0).alias("chunk_id"), F.unhex(F.lit("0101")).alias("payload"))))) == 0


@pytest.mark.parametrize("size", [1, 100, 127, 128, 129, 10_000])
def test_chunks_across_batches(spark, posts, size):
    """Chunks are those of chunked(), wherever a batch ends; rows without a term or an id are left out."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, size)
    try:
        more = posts.unionByName(spark.createDataFrame([(None, 5, 1), ("a", None, 1)], posts.schema))
        got = {(r.term, r.chunk_id): (r.last_doc_id, r.n, r.gaps, r.freqs, bytes(r.payload)) for r in blocks.blocks(more).collect()}
        sizes = {(r.term, r.chunk_id): (r.last_doc_id, r.n, r.n_bytes) for r in blocks.chunk_sizes(more).collect()}
    finally:
        spark.conf.set(conf, before)
    want = {}
    for r in sorted(blocks.chunked(posts).collect(), key=lambda r: (r.term, r.doc_id)):
        want.setdefault((r.term, r.chunk_id), []).append(r)
    assert got == {k: (x[-1].doc_id, len(x), [r.gap for r in x], [r.freq for r in x], codec.encode([r.gap for r in x] + [r.freq for r in x])) for k, x in want.items()}
    assert sizes == {k: (x[0], x[1], len(x[4])) for k, x in got.items()}


def test_lists_with_nulls(spark):
    rows = [(0, None), (1, []), (2, [5, None, 300]), (3, [None]), (4, [(1 << 35) - 1, 0])]
    df = spark.createDataFrame(rows, "k int, ns array<bigint>").coalesce(1)
    for c in codec.CODECS.values():
        got = {r.k: (r.b, r.back) for r in df.select("k", c.encode(F.col("ns")).alias("b")).select("k", "b", c.decode(F.col("b")).alias("back")).collect()}
        assert got[0] == (None, None)
        assert [got[k][1] for k in range(1, 5)] == [[], [5, 300], [], [(1 << 35) - 1, 0]]
    sums = {r[0]: r[1] for r in df.select("k", codec.running(F.col("ns"))).collect()}
    assert sums == {0: None, 1: [], 2: [5, 305], 3: [], 4: [(1 << 35) - 1, (1 << 35) - 1]}


def test_offsets_make_chunks_once(posts):
    text = plan(blocks.chunk_offsets(blocks.chunk_sizes(posts)))
    assert "ReusedExchange" in text


def test_documents_are_tokenised_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf(ArrayType(StringType()))
    def tokens(text):
        calls.add(1)
        return text.split()

    rows = spark.createDataFrame([(i, f"w{i % 3} w{i % 7} x") for i in range(50)], "id bigint, text string")
    index = SearchIndex.build(invert.prepare(rows, "id", "text", tokenizer=lambda c: tokens(c)), str(tmp_path / "index"), with_blocks=True)
    assert index.stats.first().n == 50 and index.postings.filter("term = 'x'").count() == 50
    assert calls.value <= 100  # for the tokens and for the size


def test_blocks_tell_the_lexicon_their_sizes(spark, docs, tmp_path):
    built = [SearchIndex.build(docs, str(tmp_path / n), with_blocks=n != "without", codec=codec.FIXED if n == "fixed" else codec.VARBYTE) for n in ("with", "without", "fixed")]
    for a in built[1:]:
        assert sorted(map(tuple, a.lexicon.collect())) == sorted(map(tuple, built[0].lexicon.collect()))


def test_term_ids_by_hashing(docs):
    one = invert.term_ids(docs, unique=True)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, invert.term_ids(docs).collect()))
    seen = docs.select("doc_id", F.posexplode_outer(F.array_distinct("tokens")).alias("pos", "term")).filter("term is not null").groupBy("term").agg(F.min("doc_id").alias("doc"), F.min_by("pos", "doc_id").alias("pos"))
    assert "SortAggregate" not in plan(seen)
    joined = invert.with_term_ids(invert.postings(docs, unique=True), one)
    text = plan(joined)
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text
    ids = {r.term: r.term_id for r in one.collect()}
    assert sorted(map(tuple, joined.collect())) == sorted((ids[r.term], r.doc_id, r.freq) for r in invert.postings(docs, unique=True).collect())


def test_counting_within_rows(docs):
    """As when all tokens are grouped; sorted in generated code."""
    got = invert.postings(docs, with_size=True, unique=True)
    assert "array_sort" not in plan(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, invert.postings(docs, with_size=True).collect()))


def test_text_runs_in_partitions_by_size(spark, posts, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "PART_BYTES", 1000)
    runs.write_text_runs(posts, str(tmp_path / "text"))
    files = sorted((tmp_path / "text").glob("part-*"))
    assert len(files) > 4 == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [x for p in files for x in p.read_text().splitlines()] == [f"{t},{d},{f}" for t, d, f in sorted(rows, key=lambda r: (r[0].encode(), r[1]))]
    assert sorted(map(tuple, runs.read_text_runs(spark, str(tmp_path / "text")).collect())) == sorted(rows)


def test_records_by_whole_arrays():
    rng = random.Random(6)
    rows = [(rng.choice(["a", "né", "日本語" * 9, ""]), rng.choice([0, 127, 128, 16_384, (1 << 35) - 1]), rng.randint(1, 1 << 20)) for _ in range(500)]
    data = b"".join(codec.encode((d, f, len(t.encode()))) + t.encode() for t, d, f in rows)
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
    assert runs._encoded(*columns) == data
    for cut in (0, 1, 2, 7, 100, len(data) - 1, len(data)):
        first, rest = runs._records(data[:cut])
        second, none = runs._records(rest + data[cut:])
        assert [tuple(r.values()) for r in first.to_pylist() + second.to_pylist()] == rows and none == b""
    with pytest.raises(ValueError):
        runs._encoded(columns[0], pa.array([-1] * len(rows), pa.int64()), columns[2])
