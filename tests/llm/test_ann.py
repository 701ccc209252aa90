import numpy as np
import pytest

from quillseek.llm import ann

KIND = "vec_id bigint, embedding array<float>"


def brute(x, ids, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    return {int(i): [int(ids[j]) for j in np.lexsort((ids, -s[n]))[:k]] for n, i in enumerate(ids)}


def table(spark, x, ids):
    return spark.createDataFrame([(int(i), v.tolist(), 3, 4) for i, v in zip(ids, x)], KIND + ", rank int, code int")


@pytest.mark.parametrize("dim", [100, 16])
def test_recall(spark, dim):
    """Tight clusters, loose ones and noise: at least 0.9 of the true neighbours, for every row as a query."""
    rng = np.random.default_rng(dim)
    tight = np.repeat(rng.standard_normal((12, dim)), 40, 0) + 0.05 * rng.standard_normal((480, dim))
    loose = np.repeat(rng.standard_normal((10, dim)), 20, 0) + 0.5 * rng.standard_normal((200, dim))
    x = np.concatenate([tight, loose, rng.standard_normal((300, dim))]).astype(np.float32)
    ids = rng.permutation(len(x)) * 3
    got = {}
    for r in ann.neighbours(table(spark, x, ids)).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.neighbour_id, r.cosine))
    want = brute(x.astype(np.float64), ids, ann.K)
    assert set(got) == set(want) and all([g[0] for g in sorted(v)] == list(range(1, ann.K + 1)) for v in got.values())
    recall = np.mean([len({g[1] for g in got[i]} & set(want[i])) / ann.K for i in want])
    assert recall >= 0.9
    assert all(g[2] <= 1.000001 for v in got.values() for g in v)


def pop(a):
    return np.bitwise_count(a)


@pytest.mark.parametrize("width,radius,rows", [(16, 1, 3000), (16, 2, 900), (20, 3, 400), (8, 8, 50), (24, 2, 500)])
def test_probing_finds_the_ball(width, radius, rows):
    """Probing is the same as comparing all values, each pair once, for any radius left to a query."""
    rng = np.random.default_rng(width + radius)
    index = rng.integers(0, 1 << min(width, 9), rows).astype(np.uint32) << np.uint32(max(0, width - 9))
    query, left = np.concatenate([index[:200], rng.integers(0, 1 << width, 50).astype(np.uint32)]), rng.integers(0, radius + 1, min(200, rows) + 50)
    got = [p for q, i in ann.probe(index, query, left, width) for p in zip(q.tolist(), i.tolist())]
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(pop(query[:, None] ^ index) <= left[:, None]))}
    assert len(got) == len(set(got)) and set(got) == want


def test_pigeonhole():
    """Codes within m(r + 1) - 1 bits have a substring within r in m indexes."""
    rng = np.random.default_rng(1)
    for m, r in ((4, 1), (16, 2), (64, 3)):
        flips = np.zeros((500, m * 16), bool)
        for row in flips:
            row[rng.choice(m * 16, m * (r + 1) - 1, replace=False)] = True
        assert (flips.reshape(500, m, 16).sum(2).min(1) <= r).all()


def test_meeting_is_the_share_of_pairs_that_meet():
    rng = np.random.default_rng(2)
    radii = [1] * 4 + [2] * 12 + [-1] * 48
    for p in (0.05, 0.2, 0.35):
        bits = rng.random((4000, 16, 16)) < p
        met = (bits.sum(2) <= np.array(radii[:16])).any(1).mean()
        assert met == pytest.approx(ann.meeting(p, 16, radii), abs=0.03)
    far = ann.farthest(16, radii)
    assert ann.meeting(far, 16, radii) == pytest.approx(ann.TARGET, abs=1e-6)


def test_codes_are_learned_over_all_vectors(spark):
    """Mean and principal directions are those of the whole table; rotations stay rotations and lose less than at first."""
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((4000, 12)) @ np.diag([3, 3, 3, 3, 1, 1, 1, 1, 1, 1, 0, 0]) + 5).astype(np.float32)
    df = table(spark, x, range(len(x))).repartition(7).select("embedding")
    mean, p = ann.learn(df, 12, 20)
    assert np.allclose(mean, x.mean(0), atol=1e-3) and p.shape == (12, 20)
    assert np.allclose(p[:, :10].T @ p[:, :10], np.eye(10), atol=1e-4) and np.allclose(p[10:], 0, atol=1e-4)
    loss = lambda q: np.square(np.abs((x - mean) @ q[:, :10]) - np.abs((x - mean) @ q[:, :10]).mean()).mean()
    assert loss(p) <= loss(ann.learn(df, 12, 20, rounds=0)[1]) + 1e-6


def run(spark, x, ids, **how):
    unit, n, dim = ann._unit(table(spark, x, ids), "vec_id", "embedding")
    found, asked = ann.search(unit, n, dim, **how)
    got = {}
    for r in found.collect():
        got.setdefault(r.q, set()).add(r.id)
    want = brute(x.astype(np.float64), ids, ann.K)
    return np.mean([len(got[i] & set(want[i])) / ann.K for i in want]), asked


def test_the_index_answers(spark):
    """Clustered vectors are answered at the first levels, all others before a whole index is the ball; no vector is compared with all."""
    rng = np.random.default_rng(6)
    tight = np.repeat(rng.standard_normal((40, 64)), 50, 0) + 0.1 * rng.standard_normal((2000, 64))
    recall, asked = run(spark, tight.astype(np.float32), np.arange(2000))
    assert recall >= 0.95 and len(asked) <= 2 and (len(asked) == 1 or asked[1][1] < 100)
    loose = np.repeat(rng.standard_normal((40, 64)), 50, 0) + 0.5 * rng.standard_normal((2000, 64))
    recall, asked = run(spark, loose.astype(np.float32), np.arange(2000))
    assert recall >= 0.9 and asked[-1][0][2] <= 2
    noise = rng.standard_normal((3000, 64)).astype(np.float32)
    recall, asked = run(spark, noise, np.arange(3000))
    assert recall >= 0.9 and asked[-1][0][2] <= 3


def test_indexes_in_parts_give_the_same(spark):
    """Queries go to all parts of an index that their balls reach."""
    rng = np.random.default_rng(8)
    x = np.concatenate([np.repeat(rng.standard_normal((20, 32)), 20, 0) + 0.3 * rng.standard_normal((400, 32)), rng.standard_normal((300, 32))]).astype(np.float32)
    unit, n, dim = ann._unit(table(spark, x, np.arange(len(x))), "vec_id", "embedding")
    one, two = (sorted(map(tuple, ann.search(unit, n, dim, part_bytes=b)[0].select("q", "id").collect())) for b in (ann.PART_BYTES, 20_000))
    assert one == two


def test_levels():
    for width in (16, 20, 30):
        assert all((b - a) * ann.ball(width, r) < 1 << width for a, b, r in ann.levels(width)[:-1]) and ann.levels(width)[-1] == (0, 1, width)
    assert [ann.width_of(n) for n in (0, 1, 65_536, 65_537, 10**9, 10**12)] == [16, 16, 16, 17, 30, 30]


def test_edge_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (None, [1.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0]), (8, [float("nan"), 1.0]), (9, [None, 1.0]), (10, [1.0, float("inf")]), (1, [1.0, 0.0]), (11, [-1.0, 0.0])]
    out = sorted((r.vec_id, r.rank, r.neighbour_id, r.cosine) for r in ann.neighbours(spark.createDataFrame(rows, KIND)).collect())
    assert out == [(1, 1, 2, 1.0), (1, 2, 3, 0.0), (1, 3, 11, -1.0), (2, 1, 1, 1.0), (2, 2, 3, 0.0), (2, 3, 11, -1.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0), (3, 3, 11, 0.0), (11, 1, 3, 0.0), (11, 2, 1, -1.0), (11, 3, 2, -1.0)]
    assert ann.neighbours(spark.createDataFrame(rows[:1], KIND)).count() == 0
    assert ann.neighbours(spark.createDataFrame([], KIND)).count() == 0 and ann.neighbours(spark.createDataFrame(rows[4:7], KIND)).count() == 0


def cone(n, dim=64, inner=8, seed=3):
    """Vectors with a large common mean: their cosines are near 1, though they lie in all directions from the mean."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, inner)) @ rng.standard_normal((inner, dim)) / np.sqrt(inner)
    return (rng.standard_normal(dim) + 0.1 * x).astype(np.float32)


def test_recall_with_a_large_mean(spark):
    x = cone(4000)
    ids = np.arange(len(x))
    got = {}
    for r in ann.neighbours(table(spark, x, ids)).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour_id)
    want = brute(x.astype(np.float64), ids, ann.K)
    assert np.mean([len(got[i] & set(want[i])) / ann.K for i in want]) >= 0.99


def test_string_ids(spark):
    x = np.eye(4, dtype=np.float32)[[0, 0, 1, 2]]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(["b", "a", "é", ""], x)], "vec_id string, embedding array<float>")
    got = sorted((r.vec_id, r.rank, r.neighbour_id) for r in ann.neighbours(df, 2).collect())
    assert got == [("", 1, "a"), ("", 2, "b"), ("a", 1, "b"), ("a", 2, ""), ("b", 1, "a"), ("b", 2, ""), ("é", 1, ""), ("é", 2, "a")]
