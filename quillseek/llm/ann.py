"""Nearest neighbours by multi-index hashing.

Vectors get binary codes: the signs of rotations of their principal components,
learned over all vectors so that the signs lose least (iterative quantisation).
A code is split into TABLES substrings of as many bits as the number of vectors
has, 16 at least, and each substring is an index. Probing all values within r
bits of a query's substring in m indexes finds every code within m(r + 1) - 1
bits of the query's (pigeonhole), and further codes with a chance that follows
from their angle. The floats rerank what is found.

The radius grows for each query by levels(), from 4 indexes at radius 1 on, until
vectors as near as its K-th found neighbour are met with a chance of TARGET; at
the last level the ball is the whole index. Most clustered vectors end at the
first levels. For vectors that have no near neighbours, all are nearly as far,
so the ball has to hold a part of the table that hardly shrinks with its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_back, id_key, key_type, quoted, written

K, TABLES, LEAST_WIDTH = 10, 64, 16
#: Chance with which a vector as near as the K-th found neighbour is met before a query is answered.
TARGET = 0.9
#: Passes over all vectors that fit the rotations.
ROUNDS = 4
#: Bits of a code by which a candidate is judged before its floats are, and the deviations from what is expected that it may have.
SKETCH, SIGMAS = 256, 2.5
#: Bytes of an index, or of the part of one with the same first bits, that a task holds.
PART_BYTES = 32 << 20
#: Pairs that are compared at a time.
PAIRS = 1 << 19


def width_of(n: int) -> int:
    """Bits of a substring: about one vector for each value."""
    return min(30, max(LEAST_WIDTH, math.ceil(math.log2(max(2, n)))))


def ball(width: int, radius: int) -> int:
    """Values within ``radius`` bits of one of ``width`` bits."""
    return sum(math.comb(width, j) for j in range(min(radius, width) + 1))


def levels(width: int) -> list[tuple[int, int, int]]:
    """(first index, index after the last, radius) of each level; those whose balls would together be larger than an index give way to one whole index."""
    out = [(0, 4, 1), (4, 16, 2), (16, TABLES, 2), *(x for r in range(3, width) for x in ((0, 16, r), (16, TABLES, r)))]
    return [x for x in out if (x[1] - x[0]) * ball(width, x[2]) < 1 << width] + [(0, 1, width)]


def meeting(p: float, width: int, radii: list[int]) -> float:
    """Chance that codes whose bits differ with probability ``p`` are met in an index; radii: of each index, -1 where it isn't probed."""
    miss = 1.0
    for r in radii:
        if r >= 0:
            miss *= 1 - sum(math.comb(width, j) * p**j * (1 - p) ** (width - j) for j in range(min(r, width) + 1))
    return 1 - miss


def farthest(width: int, radii: list[int]) -> float:
    """The largest share of differing bits at which codes are met with a chance of TARGET."""
    low, high = 0.0, 1.0
    if meeting(high, width, radii) >= TARGET:
        return high
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if meeting(mid, width, radii) >= TARGET else (low, mid)
    return low


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(n, -1) if n else np.empty((0, 0), np.float32)


def _summed(vectors: DataFrame, part) -> np.ndarray:
    """The sum over all batches of part(matrix), a float64 array; added up by tasks in two steps, so that the driver gets few of them."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                one = part(_matrix(b.column(0)).astype(np.float64))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for raw in b.column(0).to_pylist():
                one = np.frombuffer(raw, np.float64)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    partial = vectors.mapInArrow(first, "sum binary")
    return sum(np.frombuffer(r[0], np.float64) for r in partial.repartition(16).mapInArrow(again, "sum binary").collect())


def learn(vectors: DataFrame, dim: int, bits: int, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, dim x bits projection) of the one column of ``vectors``, whose matrices of sums are made over all rows.

    Directions in which vectors don't differ are left out; with fewer than
    ``bits`` others, several rotations of them follow each other.
    """
    sums = _summed(vectors, lambda x: np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel())))
    mean = sums[1 : dim + 1] / sums[0]
    variance, basis = np.linalg.eigh(sums[dim + 1 :].reshape(dim, dim) / sums[0] - np.outer(mean, mean))
    basis = basis[:, variance > 1e-9 * max(variance[-1], 1e-12)][:, ::-1][:, :bits]
    if not basis.shape[1]:
        basis = np.eye(dim)
    d, rng = basis.shape[1], np.random.default_rng(seed)
    rotations = [np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(-(-bits // d))]
    for _ in range(rounds if len(rotations) * d * d <= 1 << 24 else 0):

        def part(x: np.ndarray) -> np.ndarray:
            v = (x - mean) @ basis
            return np.concatenate([(np.where(v @ r >= 0, 1.0, -1.0).T @ v).ravel() for r in rotations])

        turned = _summed(vectors, part).reshape(len(rotations), d, d)
        rotations = [(u @ wt).T for u, _, wt in map(np.linalg.svd, turned)]
    return mean.astype(np.float32), np.concatenate([basis @ r for r in rotations], 1)[:, :bits].astype(np.float32)


def substrings(x: np.ndarray, mean: np.ndarray, project: np.ndarray, width: int, first: int, last: int) -> np.ndarray:
    """(rows, last - first) of the codes' substrings in those indexes."""
    on = ((x - mean) @ project[:, first * width : last * width] >= 0).reshape(len(x), last - first, width)
    return (on @ (1 << np.arange(width, dtype=np.int64))).astype(np.uint32)


def sketches(x: np.ndarray, mean: np.ndarray, project: np.ndarray) -> np.ndarray:
    return np.packbits((x - mean) @ project[:, :SKETCH] >= 0, axis=1).view(np.uint64)


def masks_of(width: int, radius: int) -> np.ndarray:
    """All values of at most ``radius`` of ``width`` bits, by their number of bits."""
    rings = [np.zeros(1, np.uint32)]
    for _ in range(min(radius, width)):
        more = (rings[-1][:, None] | (np.uint32(1) << np.arange(width, dtype=np.uint32))).ravel()
        rings.append(np.setdiff1d(more, rings[-1]))
    return np.concatenate(rings)


def probe(index: np.ndarray, query: np.ndarray, left: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (query row, index row) whose values differ in at most left[query row] bits, some PAIRS at a time and in order of the queries."""
    if not len(index) or not len(query):
        return
    masks = masks_of(width, int(left.max())) if ball(width, int(left.max())) < len(index) else None
    if masks is None:  # the ball has more values than the index has rows
        step = max(1, PAIRS // len(index))
        for i in range(0, len(query), step):
            q, at = np.nonzero(np.bitwise_count(query[i : i + step, None] ^ index) <= left[i : i + step, None])
            yield q + i, at
        return
    order = np.argsort(index, kind="stable")
    values = index[order]
    bits = np.bitwise_count(masks)
    starts = np.searchsorted(values, np.arange((1 << width) + 1)) if width <= 22 else None
    step = max(1, PAIRS // len(masks))
    for i in range(0, len(query), step):
        want = query[i : i + step, None] ^ masks
        lo, hi = (starts[want], starts[want + np.uint32(1)]) if starts is not None else (np.searchsorted(values, want), np.searchsorted(values, want, "right"))
        n = np.where(bits <= left[i : i + step, None], hi - lo, 0)
        done = 0
        ends = np.cumsum(n.sum(1))
        while done < len(n):  # rows whose pairs are at most PAIRS, or one row
            to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
            m, at = n[done:to].ravel(), lo[done:to].ravel()
            total = int(m.sum())
            if total:
                where = np.repeat(at - (np.cumsum(m) - m), m) + np.arange(total)
                yield np.repeat(np.arange(i + done, i + to), n[done:to].sum(1)), order[where]
            done = to


def _record(tables: int, dim: int) -> np.dtype:
    """A vector in an index; left: bits in which probed values may differ, 255 where it isn't a query; is: whether it is part of the index."""
    return np.dtype([("node", "<i8"), ("vec", "<f4", (dim,)), ("sketch", "<u8", (SKETCH // 64,)), ("sub", "<u4", (tables,)), ("bound", "<f4"), ("limit", "<u2"), ("left", "u1"), ("is", "u1")])


def _entries(mean: np.ndarray, project: np.ndarray, width: int, first: int, last: int, radius: int, prefix: int, each: int):
    """(part, data): every vector for every index, ``each`` indexes together or, with ``prefix``, one by the first bits of the substring. Queries go to all parts that their balls reach."""
    kind = _record(each, len(mean))
    flips = masks_of(prefix, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            one = np.zeros(len(x), kind)
            one["node"], one["vec"], one["sketch"] = b.column(0).to_numpy(zero_copy_only=False), x, sketches(x, mean, project)
            apart, known = b.column(3).to_numpy(zero_copy_only=False), ~np.isnan(b.column(2).to_numpy(zero_copy_only=False))
            one["bound"] = np.where(known, b.column(2).to_numpy(zero_copy_only=False) - 1e-6, -2)
            one["limit"] = np.where(known, np.ceil(SKETCH * apart + SIGMAS * np.sqrt(SKETCH * apart * (1 - apart))), SKETCH)
            asks = b.column(4).to_numpy(zero_copy_only=False).astype(bool)
            subs = substrings(x, mean, project, width, first, last)
            for g, t in enumerate(range(0, last - first, each)):
                own = one.copy()
                s = subs[:, t : t + each]
                own["sub"][:, : s.shape[1]] = s & np.uint32((1 << (width - prefix)) - 1)
                own["left"], own["is"] = np.where(asks, radius, 255), 1
                part = (g << prefix) + (s[:, 0].astype(np.int64) >> (width - prefix) if prefix else 0) + np.zeros(len(x), np.int64)
                yield _rows(part, own)
                own["is"] = 0
                for flip in flips[1:].tolist():
                    if asks.any():
                        own["left"] = radius - flip.bit_count()
                        yield _rows(part[asks] ^ flip, own[asks])

    return run


def _rows(part: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    size = data.dtype.itemsize
    offsets = np.arange(len(data) + 1, dtype=np.int32) * size
    return pa.RecordBatch.from_arrays([pa.array(part), pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])], ["part", "data"])


def _best(q: np.ndarray, node: np.ndarray, cos: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, ties by the lesser node."""
    order = np.lexsort((node, -cos, q))
    q = q[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


def _found(kind: np.dtype, width: int, mean: np.ndarray, k: int):
    """From rows sorted by part, each query's k best in it: (q, id, cosine, apart), apart the share of bits in which their codes should differ."""

    def search(data: np.ndarray) -> Iterator[pa.RecordBatch]:
        index, query = data[data["is"] == 1], data[data["left"] != 255]
        if not len(query):
            return
        i_vec, i_node, q_vec, q_node, limit, bound = (np.ascontiguousarray(x) for x in (index["vec"], index["node"], query["vec"], query["node"], query["limit"], query["bound"]))
        i_words, q_words = ([np.ascontiguousarray(x["sketch"][:, w]) for w in range(SKETCH // 64)] for x in (index, query))
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for t in range(kind["sub"].shape[0]):
            for q, i in probe(index["sub"][:, t].copy(), query["sub"][:, t].copy(), query["left"].astype(np.int64), width):
                far = np.zeros(len(q), np.uint16)
                for a, b in zip(q_words, i_words):
                    far += np.bitwise_count(a[q] ^ b[i])
                keep = np.flatnonzero(far <= limit[q])
                q, i = q[keep], i[keep]
                keep = q_node[q] != i_node[i]
                q, i = q[keep], i[keep]
                cos = np.concatenate([np.einsum("ij,ij->i", q_vec[q[n : n + 16_384]], i_vec[i[n : n + 16_384]]) for n in range(0, len(q), 16_384)] or [np.empty(0, np.float32)])
                keep = cos >= bound[q]
                q, i, cos = q[keep], i[keep], cos[keep]
                top = _best(q, i_node[i], cos, k)
                got.append((q[top], i[top], cos[top]))
        q, i, cos = (np.concatenate(c) for c in zip(*got)) if got else (np.empty(0, np.int64),) * 3
        if not len(q):
            return
        _, one = np.unique(q * len(index) + i, return_index=True)  # a pair that is met in several indexes
        q, i, cos = q[one], i[one], cos[one]
        top = _best(q, i_node[i], cos, k)
        m = mean.astype(np.float64)
        for n in range(0, len(top), 16_384):
            q_n, i_n = q[top[n : n + 16_384]], i[top[n : n + 16_384]]
            a, b = q_vec[q_n].astype(np.float64), i_vec[i_n].astype(np.float64)
            cos = np.einsum("ij,ij->i", a, b)
            a -= m
            b -= m
            turn = np.einsum("ij,ij->i", a, b) / np.maximum(1e-12, np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(q_node[q_n]), pa.array(i_node[i_n]), pa.array(cos), pa.array(np.arccos(np.clip(turn, -1, 1)) / np.pi)], ["q", "id", "cosine", "apart"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            part = b.column(0).to_numpy(zero_copy_only=False)
            raw = b.column(1)
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for s, e in zip(cuts, cuts[1:]):
                if e == s:
                    continue
                if part[s] != now and held:
                    yield from search(np.frombuffer(b"".join(held), kind))
                    held = []
                now = part[s]
                held += raw.slice(s, e - s).to_pylist()
        if held:
            yield from search(np.frombuffer(b"".join(held), kind))

    return run


def _unit(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, int]:
    """(written table of node, key and v, rows, length): the vectors that count, at length 1; node ascends with key."""
    v = vectors.select(id_key(vectors, id_col).alias("key"), quoted(vec_col).cast("array<float>").alias("v"))
    missing = F.lit("") if key_type(vectors, id_col) == "string" else F.lit(-(2**63))
    fit = v.filter(F.col("key") != missing).filter("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < float('inf')) and exists(v, x -> x <> 0)")
    sizes = fit.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return v, 0, 0
    rows = fit.filter(F.size("v") == sizes["d"]).groupBy("key").agg(F.min("v").alias("v"))
    rows = rows.withColumn("n", F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + cast(x as double) * x))")).select("key", F.expr("transform(v, x -> cast(x / n as float))").alias("v"))
    if key_type(vectors, id_col) == "string":
        rows = written(rows.orderBy("key"), "vectors-sorted").select(F.monotonically_increasing_id().alias("node"), "key", "v")
    else:
        rows = rows.select(F.col("key").alias("node"), "key", "v")
    unit = written(rows, "vectors")
    return unit, unit.count(), sizes["d"]


def search(unit: DataFrame, n: int, dim: int, k: int = K, part_bytes: int = PART_BYTES) -> tuple[DataFrame, list[tuple[tuple[int, int, int], int]]]:
    """((q, id, cosine, rank) of all rows of _unit(), [(level, queries that it was asked for)])."""
    spark = unit.sparkSession
    width = width_of(n)
    mean, project = learn(unit.select("v"), dim, TABLES * width)
    k, radii, asked = min(k, n - 1), [-1] * TABLES, []
    found, open_rows = None, n
    for level in levels(width) if k < n - 1 else [(0, 1, width)]:  # all others are asked for: the ball is the whole index
        first, last, radius = level
        asked.append((level, open_rows))
        prefix = max(0, math.ceil(math.log2(n * _record(1, dim).itemsize / part_bytes)))
        prefix = min(prefix, width - 1)
        each = 1 if prefix else -(-(last - first) // 16)
        parts = -(-(last - first) // each) << prefix
        if found is None:
            rows = unit.select("node", "v", F.lit(None).cast("double").alias("bound"), F.lit(0.5).alias("apart"), F.lit(True).alias("open"))
        else:
            state = found.groupBy(F.col("q").alias("node")).agg(F.count("*").alias("n"), F.min("cosine").alias("bound"), F.max("apart").alias("apart"))
            state = state.select("node", F.when(F.col("n") >= k, F.col("bound")).alias("bound"), "apart", (F.col("n") >= k).alias("full"))
            done = F.coalesce(F.col("full") & (F.col("apart") <= reach), F.lit(False))
            rows = unit.join(state, "node", "left").select("node", "v", "bound", F.coalesce("apart", F.lit(0.5)).alias("apart"), (~done).alias("open"))
        kind = _record(each, dim)
        sent = rows.mapInArrow(_entries(mean, project, width, first, last, radius, prefix, each), "part bigint, data binary")
        met = sent.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part").mapInArrow(_found(kind, width - prefix, mean, k), "q bigint, id bigint, cosine double, apart double")
        both = (met if found is None else met.unionByName(found.drop("rank"))).repartition("q").groupBy("q", "id").agg(F.max("cosine").alias("cosine"), F.max("apart").alias("apart"))
        rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("cosine"), "id"))
        found = written(both.withColumn("rank", rank).filter(F.col("rank") <= k), "neighbours")
        for t in range(first, last):
            radii[t] = max(radii[t], radius)
        reach = farthest(width, radii)
        ended = found.groupBy("q").agg(F.count("*").alias("n"), F.max("apart").alias("apart")).filter((F.col("n") >= k) & (F.col("apart") <= reach)).count()
        open_rows = n - ended
        if not open_rows:
            break
    return found, asked


def neighbours(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, neighbour_id, rank, cosine): the k nearest others of every vector by cosine; ties by the lesser id.

    Every row is a query. Of the true neighbours at least 0.9 are found; see the
    module. Rows whose id is null, or whose vector is null, empty, zero, of
    another length than most or has a null, NaN or infinite part, are left out.
    Rows that repeat an id are one, the least vector. Fewer than k others give as
    many as there are; an empty table gives an empty one. Ids keep their type.
    Other columns aren't read.
    """
    unit, n, dim = _unit(vectors, id_col, vec_col)
    kind = vectors.select(quoted(id_col)).schema[0].dataType.simpleString()
    if n < 2:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, neighbour_id {kind}, rank int, cosine double")
    found, _ = search(unit, n, dim, k)
    if key_type(vectors, id_col) == "string":
        keys = unit.select("node", "key")
        found = found.join(keys.withColumnsRenamed({"node": "q", "key": "q_key"}), "q").join(keys.withColumnsRenamed({"node": "id", "key": "id_key"}), "id")
    else:
        found = found.withColumns({"q_key": F.col("q"), "id_key": F.col("id")})
    return found.select(id_back(vectors, id_col, F.col("q_key")).alias("vec_id"), id_back(vectors, id_col, F.col("id_key")).alias("neighbour_id"), F.col("rank").cast("int").alias("rank"), F.round("cosine", 6).alias("cosine"))
