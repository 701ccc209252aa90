import random
import time

from pyspark.sql import functions as F

from quillseek.functions import codec
from quillseek.operators import blocks
from quillseek.operators.numbering import number, running_sum


def test_chunks_of_128(spark):
    posts = spark.range(300).select(F.lit("t").alias("term"), (F.col("id") * 3 + 1).alias("doc_id"), F.lit(2).cast("bigint").alias("freq"))
    got = blocks.blocks(posts).orderBy("chunk_id").collect()
    assert [r.n for r in got] == [128, 128, 44] and [r.last_doc_id for r in got] == [382, 766, 898]
    for r in got:
        assert sum(r.gaps) == r.last_doc_id and codec.decode(bytes(r.payload))[0] == r.gaps + r.freqs and r.n_bytes == len(r.payload)
    assert got[1].gaps[0] == 385  # gaps begin anew in each chunk
    assert sorted(map(tuple, blocks.unblock(blocks.blocks(posts)).collect())) == sorted(map(tuple, posts.collect()))
    sizes = {r.chunk_id: r.n_bytes for r in blocks.chunk_sizes(posts).collect()}
    assert sizes == {r.chunk_id: r.n_bytes for r in got}
    assert [r.relative_position for r in blocks.chunk_offsets(blocks.chunk_sizes(posts)).orderBy("chunk_id").collect()] == [0, sizes[0], sizes[0] + sizes[1]]


def test_ranges_of_ids(spark, monkeypatch):
    """Chunks and gaps don't depend on the ranges by which a long list is numbered."""
    posts = spark.createDataFrame([(t, d * k, 1) for k, t in ((7, "a"), (900, "b")) for d in range(1, 400)], "term string, doc_id bigint, freq bigint")
    whole = sorted(map(tuple, blocks.chunked(posts).collect()))
    monkeypatch.setattr(blocks, "SPAN", 100)
    assert sorted(map(tuple, blocks.chunked(posts).collect())) == whole
    done = blocks.chunked(posts)
    done.write.format("noop").mode("overwrite").save()
    done.collect()
    assert "ReusedExchange" in done._jdf.queryExecution().executedPlan().toString()


def _full(lex):
    out, since = {}, 501
    for term, df in sorted(lex, key=lambda x: x[0].encode()):
        if df > 50 or since > 500:
            out[term], since = True, 0
        else:
            out[term], since = False, since + df
    return out


def test_sparse_rule(spark):
    rng = random.Random(1)
    lex = [(f"t{i:04}", rng.choice([1, 2, 3, 40, 50, 51, 200])) for i in range(400)] + [(f"é{i}", 45) for i in range(30)] + [("a", 50), ("b", 51), ("日", 3)]
    got = {r.term: r.is_full for r in blocks.full_terms(spark.createDataFrame(lex, "term string, df bigint")).collect()}
    assert got == _full(lex)
    assert blocks.full_terms(spark.createDataFrame([], "term string, df bigint")).count() == 0


def test_positions(spark):
    rng = random.Random(2)
    posts = [(t, d, rng.randint(1, 200)) for t in ("a", "ab", "b", "zz", "é") for d in sorted(rng.sample(range(5000), rng.choice([1, 20, 300])))]
    df = spark.createDataFrame(posts, "term string, doc_id bigint, freq bigint")
    for sparse in (False, True):
        at = 0
        full = _full([(t, sum(p[0] == t for p in posts)) for t in {p[0] for p in posts}])
        for r in blocks.positions(df, sparse).orderBy("position").collect():
            own = [(d, f) for t, d, f in posts if t == r.term]
            chunks, meta = b"", []
            for i in range(0, len(own), 128):
                part = own[i : i + 128]
                data = codec.encode([d - (part[k - 1][0] if k else 0) for k, (d, _) in enumerate(part)]) + codec.encode(f for _, f in part)
                meta += [part[-1][0], len(data)]
                chunks += data
            entry = codec.encode([len(meta) // 2, *meta]) + chunks
            if sparse and not full[r.term]:
                entry = b"\0" + codec.encode([len(own), len(r.term.encode())]) + r.term.encode() + entry
            assert (r.df, r.position, r.next_position) == (len(own), at, at + len(entry))
            at += len(entry)


def test_numbering(spark):
    rows = spark.createDataFrame([(k, v) for k in "cab" for v in range(5)], "g string, v bigint")
    got = number(rows.repartition(5), [F.col("g"), F.col("v")], "n").orderBy("n").collect()
    assert [(r.g, r.v, r.n) for r in got] == [(g, v, i * 5 + v + 1) for i, g in enumerate("abc") for v in range(5)]
    sums = running_sum(rows, [F.col("g"), F.col("v")], F.col("v"), "s").orderBy("g", "v").collect()
    total = 0
    for r in sums:
        assert r.s == total
        total += r.v
    big = spark.range(50_000).select((F.col("id") * 7919 % 50_021).alias("k")).repartition(7)
    got = number(big, [F.col("k")], "n", 0).orderBy("k").collect()
    assert [r.n for r in got] == list(range(len(got)))


def test_many_rare_terms_in_a_segment(spark):
    """The rule's time is linear in the terms of a segment."""
    lex = spark.range(200_000).select(F.format_string("t%07d", F.col("id")).alias("term"), (F.col("id") % 3 + 1).alias("df"))
    began = time.time()
    got = [r.is_full for r in blocks.full_terms(lex).orderBy("term").collect()]
    assert time.time() - began < 30
    want = _full([(f"t{i:07}", i % 3 + 1) for i in range(200_000)])
    assert got == [want[t] for t in sorted(want)]


def test_codecs(spark):
    """Postings through the bytes alone, by any codec; lengths are as they are told."""
    rows = [(t, d * k, d % 300 + 1) for k, t in ((7, "a"), (90_001, "b")) for d in range(1, 300)] + [("c", 4294967295, 1)]
    posts = spark.createDataFrame(rows, "term string, doc_id bigint, freq bigint")
    for c in codec.CODECS.values():
        chunks = blocks.blocks(posts, c)
        assert sorted(map(tuple, blocks.unpack(chunks.drop("gaps", "freqs"), c).collect())) == sorted(rows)
        n = chunks.select(F.sum("n_bytes")).first()[0]
        assert n == chunks.select(F.sum(F.aggregate(F.concat("gaps", "freqs"), F.lit(0).cast("bigint"), lambda a, x: a + c.length(x)))).first()[0]


def test_offsets_of_a_long_list(spark, monkeypatch):
    chunks = spark.createDataFrame([(t, i, i % 5 + 1) for t in "ab" for i in range(300)], "term string, chunk_id bigint, n_bytes bigint")
    whole = sorted(map(tuple, blocks.chunk_offsets(chunks).collect()))
    monkeypatch.setattr(blocks, "CHUNK_SPAN", 16)
    assert sorted(map(tuple, blocks.chunk_offsets(chunks).collect())) == whole
    assert [r[2] for r in whole[:4]] == [0, 1, 3, 6]
