import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillseek.llm import common
from quillseek.llm import linededup as L

KIND = "doc_id bigint, text string"


def brute(rows):
    """{(id, text): text that is left}: the same rule, one document after the other."""
    from pyspark.sql import SparkSession
    from quillseek.llm.common import row_key

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame(rows, KIND)
    keys = df.select("doc_id", "text", *[c.alias(n) for c, n in zip(row_key(df, "doc_id", "text"), ("k1", "k2"))]).distinct().collect()
    docs = sorted(((r.k1, r.k2, r.doc_id, r.text) for r in keys if r.text is not None), key=lambda r: r[:2])
    seen, out = {}, {}
    for _, _, i, text in docs:
        spans = []
        bounds = L.chunks(text)
        for k, (s, e, _, fit) in enumerate(bounds):
            part = text[s:e].removesuffix("\n")
            if fit and part in seen:
                before, after = seen[part]
                spans.append({"start": s, "end": e, "first_text": part, "before": before, "after": after})
            elif fit:
                seen[part] = (text[slice(*bounds[k - 1][:2])] if k else None, text[slice(*bounds[k + 1][:2])].removesuffix("\n") if k + 1 < len(bounds) else None)
        out[i, text] = L.cut(text, spans)[0]
    return out


def lines(rng, n, words=(1, 30)):
    return [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(*words))) for _ in range(n)]


def check(spark, rows, **columns):
    df = spark.createDataFrame(rows, KIND)
    got = L.remove_repeats(df).collect()
    want = brute(rows)
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(want.get((i, t), t))) for i, t in rows)
    return got


def test_brute_force(spark):
    rng = random.Random(2)
    passages = [lines(rng, rng.randint(2, 9)) for _ in range(12)]
    rows = []
    for i in range(150):
        body = lines(rng, rng.randint(0, 12))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(body))
            body[at:at] = rng.choice(passages)
        rows.append((i, "\n".join(body) + rng.choice(["", "\n"])))
    rows += [(None, rows[3][1]), (5, rows[5][1]), (5, "\n".join(lines(rng, 3))), (200, None), (201, ""), (202, "\n\n\n"), (203, "x y " * 100_000), (204, "x y " * 100_000), (205, rows[7][1] + "\n" + rows[7][1])]
    check(spark, rows)


def test_passages_go_whatever_is_around_them(spark):
    rng = random.Random(8)
    passage = lines(rng, 6, (5, 30))
    one = lines(rng, 1, (51, 60))
    rows = [(i, "\n".join(lines(rng, rng.randint(1, 9)) + (passage if i % 2 else one) + lines(rng, rng.randint(1, 9)))) for i in range(40)]
    got = {r.doc_id: r.text for r in check(spark, rows)}
    assert ["\n".join(passage) in got[i] for i in range(1, 40, 2)] == [True] + [False] * 19
    for line in passage:
        assert sum(line in t.split("\n") for t in got.values()) == 1
    assert [one[0] in got[i] for i in range(0, 40, 2)] == [True] + [False] * 19
    for i, text in rows:  # nothing else is touched
        own = set(text.split("\n")) - set(passage) - set(one)
        assert own <= set(got[i].split("\n"))


def test_boundaries_resist_shifts():
    rng = random.Random(1)
    a = lines(rng, 40, (1, 15))
    cuts = lambda ls: {("\n".join(ls) + "\n")[s:e] for s, e, _, _ in L.chunks("\n".join(ls) + "\n")}
    assert len(cuts(a) - cuts(lines(rng, 3) + a)) <= 2
    text = "\n".join(a)
    assert "".join(text[s:e] for s, e, _, _ in L.chunks(text)) == text
    for t in ("", "\n", "a", "a\n", "\n\na"):
        assert "".join(t[s:e] for s, e, _, _ in L.chunks(t)) == t


def test_short_repeated_lines_stay(spark):
    rows = [(i, f"Les.\nunique line number {i}\nUn.") for i in range(30)]
    assert {r.removed_chunks for r in L.remove_repeats(spark.createDataFrame(rows, KIND)).collect()} == {0}


def test_bytes_decide():
    text = "one two\nthree four five six seven eight nine ten eleven"
    assert L.cut(text, [{"start": 0, "end": len(text), "first_text": text.upper(), "before": None, "after": None}]) == (text, 0)


def test_other_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a", 5, "k", 2)], KIND + ", hash int, spans string, removed_chunks int")
    out = L.remove_repeats(df)
    assert out.columns == ["doc_id", "text", "hash", "spans", "removed_chunks"] and out.first() == (1, "a", 5, "k", 0)
    assert L.remove_repeats(df.limit(0)).count() == 0
    void = L.remove_repeats(df.withColumn("nothing", F.lit(None)))
    assert void.columns[-2:] == ["nothing", "removed_chunks"] and void.first()["nothing"] is None


@pytest.mark.parametrize("bits", [common.MOST_BITS, 1 << 10])
def test_table(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "MOST_BITS", bits)
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    assert sum(r.removed_chunks for r in check(spark, rows)) > 10


def runs_before(rows):
    """{id: numbers of the lines within a run of over 50 words that came before}, by all runs of all texts in order of their ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        ls, gone = text.split("\n"), set()
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                if sum(len(x.split()) for x in ls[a:b]) > 50:
                    if tuple(ls[a:b]) not in seen:
                        break
                    gone |= set(range(a, b))
        seen |= {tuple(ls[a:b]) for a in range(len(ls)) for b in range(a + 1, len(ls) + 1)}
        out[i] = gone
    return out


@pytest.mark.parametrize("alone", [False, True])
def test_all_repeated_runs_go(spark, alone):
    """Runs of over 50 words in short lines, against all runs of lines; alone: each of their lines came before elsewhere."""
    rng = random.Random(5)
    passages = [lines(rng, n, (words, words)) for n, words in ((3, 19), (4, 15), (5, 12), (6, 10), (8, 8), (15, 6), (40, 2)) for _ in range(6)]
    rows = []
    if alone:
        rows = [(n, "\n".join([*lines(rng, 1), line, *lines(rng, 1)])) for n, line in enumerate(x for p in passages for x in p)]
    for p in passages:
        for _ in range(2):
            rows.append((len(rows), "\n".join(lines(rng, rng.randint(0, 4)) + p + lines(rng, rng.randint(0, 4)))))
    want = runs_before(rows)
    assert sum(map(bool, want.values())) == len(passages)
    got = {r.doc_id: r.text.split("\n") for r in L.remove_repeats(spark.createDataFrame(rows, KIND)).collect()}
    for i, text in rows:
        ls = text.split("\n")
        left = [ls[k] for k in want[i] if ls[k] in got[i]]
        assert sum(len(x.split()) for x in left) < L.LONG if alone else not left
        assert {x for k, x in enumerate(ls) if k not in want[i]} <= set(got[i])


def test_a_copy_is_sent_once(spark, monkeypatch):
    """Chunks and windows that came in one piece from one text are one run; their texts, with those beside them, would be many times the copy."""
    rng = random.Random(6)
    text = "\n".join(lines(rng, 200, (4, 9)))
    tables = {}
    keep = L.written
    monkeypatch.setattr(L, "written", lambda df, label: tables.setdefault(label, keep(df, label)))
    rows = [(1, text), (2, text), (2, text), (3, "\n".join(lines(rng, 3) + [text] + lines(rng, 2)))]
    check(spark, rows)
    runs = tables["runs"].collect()
    assert sorted((r.d_id, r.f_id, r.lo, r.hi) for r in runs) == [(2, 1, 0, len(text)), (3, 1, 0, len(text))]
    assert all(len(r.pieces) == len(set(r.pieces)) > 300 for r in runs)


def test_batches_are_bounded_by_bytes(spark):
    @F.pandas_udf("long")
    def total(text):
        return text.str.len().sum() + 0 * text.str.len()

    size = 1 << 18
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf)
    texts = spark.range(0, 100, 1, 1).select(F.repeat(F.lit("x"), size).alias("text"))
    most = common.written(texts.select(total("text").alias("n")), "sizes").agg(F.max("n")).first()[0]
    assert size < most <= common.TEXT_BYTES + size and spark.conf.get(conf) == before
    assert [common._size(x) for x in ("100", "67108864b", "64m", "64MB", "-1", "2k")] == [100, 64 << 20, 64 << 20, 64 << 20, -1, 2048]
