import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillseek.llm import simhash

KIND = "doc_id bigint, text string"


def closure(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in root}


def brute_pairs(rows):
    """All pairs of documents within MAX_DISTANCE, in any order."""
    make = simhash.Fingerprinter()
    ids = [i for i, t in rows if make(t)]
    m = np.array([np.frombuffer(make(t), np.uint8) for i, t in rows if make(t)])
    bits = np.unpackbits(m, axis=1).astype(np.float32) * 2 - 1
    near = np.argwhere(np.triu((simhash.BITS - bits @ bits.T) / 2 <= simhash.MAX_DISTANCE, 1))
    return [(ids[a], ids[b]) for a, b in near]


def test_fingerprint_votes():
    import xxhash

    words = "the cat sat on the mat".split()
    votes = np.zeros(simhash.BITS)
    for w in set(words):
        votes += np.unpackbits(np.frombuffer(b"".join(xxhash.xxh3_128_digest(w, seed=s) for s in range(4)), np.uint8)) * 2.0 - 1
    assert (np.unpackbits(np.frombuffer(simhash.Fingerprinter()(" ".join(words)), np.uint8)) == (votes > 0)).all()
    many = " ".join(f"w{i}" for i in range(2000))
    assert simhash.Fingerprinter()(many) == simhash.Fingerprinter()(" ".join(reversed(many.split())))
    assert simhash.Fingerprinter()("") is None and simhash.Fingerprinter()(None) is None and simhash.Fingerprinter()("!!") is None


def test_spanning_joins_what_pairs_join():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 16, (6, simhash.BITS // 16), dtype=np.uint16)
    prints = np.array([b ^ np.where(rng.random(base.shape[1]) < 0.6, 1 << rng.integers(0, 16, base.shape[1]), 0).astype(np.uint16) for b in base for _ in range(30)])
    ids = list(range(len(prints)))
    pairs = [(a, b) for a in ids for b in ids if a < b and simhash.distances(prints[a], prints[b : b + 1])[0] <= simhash.MAX_DISTANCE]
    edges = simhash.spanning(ids, prints)
    assert closure(edges) == closure(pairs) and len(edges) < len(ids)


def test_meeting_is_exact(spark):
    """Lists join all fingerprints with a band within RADIUS, and the distance alone decides the rest."""
    rng = random.Random(9)
    words = [f"word{i}" for i in range(3000)]
    rows = []
    for g in range(60):
        base = rng.choices(words, k=rng.randint(8, 300))
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            copy = [w if rng.random() > 0.06 else rng.choice(words) for w in base]
            rows.append((len(rows), " ".join(copy)))
    make = simhash.Fingerprinter()
    prints = {i: np.frombuffer(make(t), ">u4") for i, t in rows}
    pop = lambda x: bin(int(x)).count("1")
    meets = [(a, b) for a, b in brute_pairs(rows) if min(pop(x ^ y) for x, y in zip(prints[a], prints[b])) <= simhash.RADIUS]
    got = simhash.group(spark.createDataFrame(rows, KIND)).collect()
    want = closure(meets)
    assert {r.doc_id: r.first_id for r in got} == {i: want.get(i, i) for i, _ in rows}
    assert len(meets) >= 0.9 * len(brute_pairs(rows))


def test_recall_on_the_table(spark):
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet").select(["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in rows]
    pairs = brute_pairs(rows)
    group = closure((r.doc_id, r.duplicate_of) for r in simhash.query(spark, "/root/testdata/sf0.01").collect())
    met = sum(a in group and group.get(a) == group.get(b) for a, b in pairs)
    assert met >= 0.9 * len(pairs) > 0
    truth = closure(pairs)
    assert all(truth[a] == truth[b] for a, b in group.items())  # and nothing else is joined


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(35)] + [(7, 5), (5, 7), (9, 9)]
    got = {r.node: r.comp for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == closure(edges)
    assert simhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_edge_cases(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, long), (2, long + " one more"), (3, None), (4, None), (5, ""), (6, ""), (7, "!!"), (None, long), (8, "alone in the world"), (9, "a"), (10, "a"), (9, "a"), (11, "b"), (None, "unique text for nobody"), (12, "x y z"), (12, "another text of the same id")]
    docs = spark.createDataFrame([(i, t, n, 1) for n, (i, t) in enumerate(rows)], KIND + ", fid int, comp int")
    pairs = {(r.doc_id, r.duplicate_of) for r in simhash.near_duplicates(docs).collect()}
    assert pairs == {(1, None), (2, None), (10, 9)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rest = Counter((r.doc_id, r.text) for r in kept.collect())
    assert rest == Counter({k: 1 for k in rows if k not in ((1, long), (2, long + " one more"), (10, "a"))})
    assert simhash.keep_one(docs.limit(0)).count() == 0 and simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("top,most", [(0, 10**9), (3, 10**9), (5, 50), (11, 10**9), (17, 3)])
def test_variants_and_buckets(monkeypatch, top, most):
    """Whatever the buckets, the lists are those of all variants within half the radius."""
    monkeypatch.setattr(simhash, "MOST", most)
    monkeypatch.setattr(simhash, "PACK", 50)
    rng = np.random.default_rng(top)
    base = rng.integers(0, 256, (70, simhash.BITS // 8), dtype=np.uint8)
    base = np.concatenate([base] + [base ^ np.where(rng.random(base.shape) < 0.03, 1 << rng.integers(0, 8, base.shape), 0).astype(np.uint8) for _ in range(3)])
    nodes = np.concatenate([np.arange(100), (1 << 33) + np.arange(len(base) - 100)])
    batch = pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([b.tobytes() for b in base], pa.binary())], ["node", "print"])
    rows = [r for b in simhash._variants(top)([batch]) for r in b.to_pylist()]
    assert len(rows) == len({(r["bucket"], r["high"], r["single"], r["data"]) for r in rows})
    rows.sort(key=lambda r: r["bucket"])
    got = {}
    for b in simhash._meetings(top)([pa.RecordBatch.from_pylist(rows)]):
        for r in b.to_pylist():
            got.setdefault(r["list"], set()).add(r["node"])
    want = {}
    for n, b in zip(nodes.tolist(), base):
        for k, w in enumerate(np.frombuffer(b.tobytes(), ">u4").tolist()):
            for m in simhash.MASKS.tolist():
                want.setdefault((k, w ^ m), set()).add(n)
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values() if len(x) > 1}


@pytest.mark.parametrize("n,top", [(0, 0), (1000, 0), (236_000, 5), (14_000_000, 11), (46_000_000_000, 23)])
def test_top_bits(n, top):
    assert simhash._top_bits(n) == top


def test_block_pairs():
    ids = np.arange(23)
    parts = list(simhash.block_pairs(ids, 5))
    assert max(map(len, parts)) <= 10 and {(a, b) for p in parts for a in p.tolist() for b in p.tolist()} == {(a, b) for a in range(23) for b in range(23)}
    assert [p.tolist() for p in simhash.block_pairs(ids, 23)] == [ids.tolist()]


@pytest.mark.parametrize("distance,least", [(47, 1.0), (64, 0.97), (74, 0.89), (85, 0.7)])
def test_recall_by_distance(distance, least):
    """How often two fingerprints that far apart have a band within RADIUS; all of them up to BANDS * (RADIUS + 1) - 1."""
    rng = np.random.default_rng(distance)
    flips = np.zeros((4000, simhash.BITS), bool)
    for row in flips:
        row[rng.choice(simhash.BITS, distance, replace=False)] = True
    met = (flips.reshape(len(flips), simhash.BANDS, 32).sum(2) <= simhash.RADIUS).any(1)
    assert met.mean() >= least


@pytest.mark.parametrize("few", [2, 8, 100])
def test_short_lists_come_as_pairs(few):
    """Lists and pairs together let meet what all lists do; a list of at most ``few`` nodes isn't sent to Python again."""
    rng = np.random.default_rng(few)
    base = rng.integers(0, 256, (40, simhash.BITS // 8), dtype=np.uint8)
    base = np.concatenate([base] + [base[:20] ^ np.where(rng.random((20, base.shape[1])) < 0.02, 1 << rng.integers(0, 8, (20, base.shape[1])), 0).astype(np.uint8) for _ in range(12)])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(base))), pa.array([b.tobytes() for b in base], pa.binary())], ["node", "print"])
    rows = sorted((r for b in simhash._variants(3)([batch]) for r in b.to_pylist()), key=lambda r: r["bucket"])

    def meet(few):
        lists, pairs = {}, set()
        for b in simhash._meetings(3, few)([pa.RecordBatch.from_pylist(rows)]):
            for r in b.to_pylist():
                if r["list"] is None:
                    assert r["node"] < r["other"]
                    pairs.add((r["node"], r["other"]))
                else:
                    lists.setdefault(r["list"], set()).add(r["node"])
        return lists, pairs

    of = lambda lists: {(a, b) for x in lists.values() for a in x for b in x if a < b}
    whole, (lists, pairs) = meet(0)[0], meet(few)
    assert pairs and of(lists) | pairs == of(whole) and all(len(x) > few for x in lists.values())


def test_pairs_are_verified_by_their_distance(spark):
    rng = np.random.default_rng(11)
    one = rng.integers(0, 256, simhash.BITS // 8, dtype=np.uint8)
    prints = [one]
    for d in (0, 1, simhash.MAX_DISTANCE, simhash.MAX_DISTANCE + 1, simhash.BITS):
        flips = np.zeros(simhash.BITS, np.uint8)
        flips[rng.choice(simhash.BITS, d, replace=False)] = 1
        prints.append(one ^ np.packbits(flips))
    own = spark.createDataFrame([(100 + n, p.tobytes(), n) for n, p in enumerate(prints)], "fid bigint, print binary, node bigint")
    own = own.mapInArrow(simhash._with_words, "fid bigint, print binary, node bigint, " + ", ".join(f"{w} bigint" for w in simhash._WORDS))
    pairs = spark.createDataFrame([(0, n) for n in range(1, 6)], "node bigint, other bigint")
    assert sorted(map(tuple, simhash.near_pairs(pairs, own).collect())) == [(100, 101), (100, 102), (100, 103)]
