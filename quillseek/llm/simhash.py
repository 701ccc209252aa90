"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint is the SimHash of its set of words: BANDS words of
32 bits. Two bands within distance RADIUS have a variant in common that differs
from either in at most RADIUS/2 bits, so every band emits all its variants
within half the radius and the variants are shuffled. Fingerprints that meet in
a variant are verified by the distance of the whole fingerprints, MAX_DISTANCE
of BITS at most. Groups are the connected components of what is verified.

Most meetings of a large table are by chance and of two or a few fingerprints,
and their number grows with the square of the table. These are verified as pairs
within Spark's generated code; only longer lists go to Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_back, key_type, quoted, row_key, small, spare, table, written

BANDS, RADIUS = 16, 2
BITS = 32 * BANDS
#: Distance of near-duplicates, of BITS; about 0.76 as the Jaccard likeness of the sets of words.
MAX_DISTANCE = 85
_WORD = re.compile(r"\w+")
_SEEDS = BITS // 128
#: All masks of at most RADIUS/2 bits.
MASKS = np.array([0, *(1 << i for i in range(32))], np.int64)
#: Variants in a bucket, on average, and the most that are sorted in memory at a time.
PER_BUCKET, MOST = 250_000, 1_000_000
#: Fingerprints whose variants are packed at a time.
PACK = 8192
#: Nodes of a list that are compared by one task; a longer one is compared in pairs of such blocks.
BLOCK = 2048
#: Nodes of the longest list that is verified as pairs.
FEW = 8
_POPS = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


class Fingerprinter:
    def __init__(self) -> None:
        self.of: dict[str, bytes] = {}

    def __call__(self, text: str | None) -> bytes | None:
        """BITS/8 bytes; None for a text without words. A bit is set if most of the distinct words' hashes have it."""
        words = set(_WORD.findall(text.lower())) if text else ()
        if not words:
            return None
        if len(self.of) > 100_000:
            self.of.clear()
        get, parts = self.of.get, []
        for w in words:
            h = get(w)
            if h is None:
                h = self.of[w] = b"".join(xxhash.xxh3_128_digest(w, seed=s) for s in range(_SEEDS))
            parts.append(h)
        rows = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, BITS // 8)
        votes = np.zeros(BITS, np.int64)
        for i in range(0, len(rows), 255):  # as many as a byte can count
            votes += np.add.reduce(np.unpackbits(rows[i : i + 255], axis=1), axis=0, dtype=np.uint8)
        return np.packbits(2 * votes > len(rows)).tobytes()


def distances(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Of a row of uint16 words to rows of such."""
    return _POPS[one ^ many].sum(1, dtype=np.int64)


def spanning(ids: list[int], prints: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what pairs within MAX_DISTANCE join; every pair that matters is compared."""
    left, edges = np.arange(len(ids)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = distances(prints[at], prints[left]) <= MAX_DISTANCE
            for k in left[near].tolist():
                edges.append((ids[at], ids[k]))
                queue.append(k)
            left = left[~near]
    return edges


def _print_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    make = Fingerprinter()
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "text_key": b["text_key"], "print": [make(t) for t in b["text"]]})


def _top_bits(fingerprints: int) -> int:
    """First bits of a variant that are its bucket, so that a bucket has some PER_BUCKET variants."""
    return min(24, (fingerprints * len(MASKS) // PER_BUCKET).bit_length())


def _variants(top: int):
    """(bucket, high, single, data): the variants of a run of nodes by bucket.

    A bucket is a band and the ``top`` first bits of a variant. All variants
    that differ from a band's word in later bits are in the word's own bucket;
    they travel as the word alone (single is false) and are unfolded there. The
    others are sent one by one. Each takes 6 bytes: the word or variant, and the
    node's low 16 bits, its others being ``high``.
    """
    flips = np.array([0, *(1 << (31 - j) for j in range(top))], np.uint32)
    kind = np.uint16 if BANDS << (top + 1) <= 1 << 16 else np.uint32
    band = (np.arange(BANDS, dtype=np.uint64) << np.uint64(top))[None, :, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, prints = [], []
        for b in batches:
            for node, one in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if nodes and (len(nodes) >= PACK or node >> 16 != nodes[0] >> 16):
                    yield pack(np.array(nodes, np.int64), prints)
                    nodes, prints = [], []
                nodes.append(node)
                prints.append(one)
        if nodes:
            yield pack(np.array(nodes, np.int64), prints)

    def pack(nodes: np.ndarray, prints: list[bytes]) -> pa.RecordBatch:
        words = np.frombuffer(b"".join(prints), ">u4").reshape(-1, BANDS).astype(np.uint32)
        v = words[:, :, None] ^ flips
        key = ((v.astype(np.uint64) >> np.uint64(32 - top)) | band) << np.uint64(1)
        key[:, :, 1:] |= np.uint64(1)
        key = key.reshape(-1).astype(kind)
        order = np.argsort(key, kind="stable")
        key, v = key[order], v.reshape(-1)[order]
        low = (nodes & 0xFFFF).astype(np.uint16)[order // (BANDS * len(flips))]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.concatenate((starts[1:], [len(key)]))
        data = [v[s:e].tobytes() + low[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist())]
        key = key[starts].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key >> 1), pa.array(np.full(len(key), nodes[0] >> 16)), pa.array((key & 1).astype(bool)), pa.array(data, pa.binary())], ["bucket", "high", "single", "data"])

    return run


def _name(ids: np.ndarray) -> int:
    """A list's name. Two lists of one name would be compared as one, which finds no less."""
    return xxhash.xxh3_64_intdigest(ids.tobytes()) - (1 << 63)


def block_pairs(ids: np.ndarray, size: int = BLOCK) -> Iterator[np.ndarray]:
    """Parts of ``ids``, of two blocks at most, such that any two ids are together in one."""
    blocks = [ids[i : i + size] for i in range(0, len(ids), size)]
    if len(blocks) == 1:
        yield ids
    for k, one in enumerate(blocks):
        for other in blocks[k + 1 :]:
            yield np.concatenate((one, other))


def _meetings(top: int, few: int = 0):
    """From rows sorted by bucket, the distinct lists of nodes that have a variant in common. One bucket is in memory at a time.

    Lists come as rows of (list, node, null). Those of at most ``few`` nodes come as all their pairs instead, (null, lesser node, other).
    """
    inner = np.array([0, *(1 << i for i in range(32 - top))], np.uint32)

    def unfold(w: np.ndarray, w_nodes: np.ndarray, v: np.ndarray, v_nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(variants, nodes) of a bucket; a large one in parts by the next bits, so that equal variants stay together."""
        size = len(w) * len(inner) + len(v)
        split = min(32 - top, (size // MOST).bit_length())
        if not split:
            yield np.concatenate(((w[:, None] ^ inner).reshape(-1), v)), np.concatenate((np.repeat(w_nodes, len(inner)), v_nodes))
            return
        of = lambda x: (x.astype(np.uint64) >> np.uint64(32 - top - split)) & np.uint64((1 << split) - 1)
        for part in range(1 << split):
            vs, ns = [], []
            for x, n in [*((w ^ m, w_nodes) for m in inner), (v, v_nodes)]:
                here = of(x) == part
                vs.append(x[here])
                ns.append(n[here])
            yield np.concatenate(vs), np.concatenate(ns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        now, parts = None, []

        def lists(parts: list[tuple[int, bool, bytes]]) -> Iterator[pa.RecordBatch]:
            both = []
            for kind in (False, True):
                own = [(high, data) for high, single, data in parts if single == kind]
                both.append(np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(d, np.uint32, len(d) // 6) for _, d in own)]))
                both.append(np.concatenate([np.empty(0, np.int64), *((h << 16) | np.frombuffer(d, np.uint16, len(d) // 6, len(d) // 6 * 4).astype(np.int64) for h, d in own)]))
            for v, nodes in unfold(*both):
                if len(v) > 1:
                    yield met(v, nodes)

        def met(v: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
            key = (v.astype(np.uint64) << np.uint64(32)) | np.arange(len(v), dtype=np.uint64)
            key.sort()
            nodes, v = nodes[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)], key >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(v)])))
            pairs = [np.empty((0, 2), np.int64)]
            for n in range(2, few + 1):
                i, j = np.triu_indices(n, 1)
                some = np.sort(nodes[starts[sizes == n][:, None] + np.arange(n)], axis=1)
                pairs.append(np.stack((some[:, i].ravel(), some[:, j].ravel()), 1))
            both = np.concatenate(pairs)
            both = both[np.lexsort((both[:, 1], both[:, 0]))]
            both = both[np.concatenate(([True], (both[1:] != both[:-1]).any(1)))[: len(both)]]
            names, members = [], [np.empty(0, np.int64)]
            for k in np.flatnonzero(sizes > max(1, few)).tolist():
                for ids in block_pairs(np.sort(nodes[starts[k] : starts[k] + sizes[k]])):
                    name = _name(ids)
                    if name not in seen:
                        seen.add(name)
                        names += [name] * len(ids)
                        members.append(ids)
            if len(seen) > 200_000:
                seen.clear()  # lists may then come again; distinct() takes them
            lists = [pa.array(names, pa.int64()), pa.array(np.concatenate(members)), pa.nulls(len(names), pa.int64())]
            met = [pa.nulls(len(both), pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(met, lists)], ["list", "node", "other"])

        for b in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != now and parts:
                    yield from lists(parts)
                    parts = []
                now = bucket
                parts.append(row)
        if parts:
            yield from lists(parts)

    return run


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for fids, prints in zip(b["fids"], b["prints"]):
            rows += spanning([int(i) for i in fids], np.frombuffer(b"".join(prints), np.uint16).reshape(len(fids), -1))
        yield pd.DataFrame(rows, columns=["a", "b"], dtype="int64")


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fid, print, node) with the print as integers too."""
    for b in batches:
        rows = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64).reshape(-1, BITS // 64)
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.ascontiguousarray(w)) for w in rows.T)], [*b.schema.names, *_WORDS])


_WORDS = [f"w{k}" for k in range(BITS // 64)]


def near_pairs(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b): the fids of ``pairs`` (node, other) whose fingerprints are within MAX_DISTANCE."""
    one = own.select("node", F.col("fid").alias("a"), *(F.col(w).alias(f"a_{w}") for w in _WORDS))
    two = own.select(F.col("node").alias("other"), F.col("fid").alias("b"), *(F.col(w).alias(f"b_{w}") for w in _WORDS))
    apart = " + ".join(f"bit_count(a_{w} ^ b_{w})" for w in _WORDS)
    return pairs.join(one, "node").join(two, "other").filter(f"{apart} <= {MAX_DISTANCE}").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): comp is the least node that ``edges`` (a, b) connect it with.

    Each round takes the least label of the neighbours and then the label's own
    label, so that the rounds grow with the logarithm of a component's length.
    Every round is a written table.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("least"))
        better = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "least").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("comp").alias("onward"))
        step = written(better.join(jump, "new").select("node", "old", F.least("new", "onward").alias("comp")), "labels")
        labels = step.select("node", "comp")
        if not step.filter("old <> comp").limit(1).count():
            return labels


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, first_id, first_key, copies) for each document; the ids are keys as of common.id_key().

    first_id and first_key name the document of its group that stays: the one of
    the least id, then key. A group of one has itself. text_key is a hash of the
    text; rows that repeat id and text are one document, of ``copies`` rows.
    Texts without words (null, empty, punctuation) are in no group and not in
    the result. Texts are read whole; an empty table gives an empty one. Other
    columns aren't read.

    Fingerprints at a distance up to BANDS * (RADIUS + 1) - 1 = 47 always meet
    (pigeonhole). At d bits beyond, they meet with the chance that some band has
    at most RADIUS of them: 0.98 at 64, 0.92 at 74, 0.75 at 85; most such pairs
    are in one group by way of others.
    """
    k1, k2 = row_key(docs, id_col, text_col)
    texts = docs.select(k1.alias("doc_id"), k2.alias("text_key"), quoted(text_col).alias("text"))
    kind = f"doc_id {key_type(docs, id_col)}, text_key bigint, print binary"
    prints = written(texts.mapInPandas(_print_rows, kind).filter("print is not null").select("*", F.xxhash64("print").alias("fid")), "prints")
    own = prints.select("fid", "print").distinct().withColumn("node", F.monotonically_increasing_id())
    own = written(own.mapInArrow(_with_words, "fid bigint, print binary, node bigint, " + ", ".join(f"{w} bigint" for w in _WORDS)), "fingerprints")
    top = _top_bits(own.count())
    packed = own.select("node", "print").mapInArrow(_variants(top), "bucket bigint, high bigint, single boolean, data binary")
    met = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meetings(top, FEW), "list bigint, node bigint, other bigint").distinct()
    met = written(met, "meetings")
    pairs = near_pairs(met.filter("list is null").select("node", "other"), own)
    lists = met.filter("list is not null").join(own.select("node", "fid", "print"), "node").groupBy("list").agg(F.collect_list("fid").alias("fids"), F.collect_list("print").alias("prints"))
    edges = written(lists.select("fids", "prints").mapInPandas(_edges, "a bigint, b bigint").unionByName(pairs).distinct(), "near")
    comps = components(edges)
    placed = prints.join(comps.withColumnRenamed("node", "fid"), "fid", "left").select("doc_id", "text_key", F.coalesce("comp", "fid").alias("comp"))
    rows = placed.groupBy("comp", "doc_id", "text_key").agg(F.count("*").alias("copies"))
    first = rows.groupBy("comp").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    return rows.join(first, "comp").select("doc_id", "text_key", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"), "copies")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, duplicate_of): every document that doesn't stay with the one of its group that does; ids keep their type. See group()."""
    gone = group(docs, id_col, text_col).filter("not (doc_id = first_id and text_key = first_key)")
    return gone.select(id_back(docs, id_col, F.col("doc_id")).alias("doc_id"), id_back(docs, id_col, F.col("first_id")).alias("duplicate_of"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, and all that are in none; all columns as they are.

    Of rows that repeat id and text, one stays, whichever if other columns differ.
    """
    a, b, gone = spare(docs, "near_id", "near_key", "near_gone")
    marks = group(docs, id_col, text_col).withColumn(gone, F.expr("not (doc_id = first_id and text_key = first_key)")).filter(F.col(gone) | (F.col("copies") > 1))
    marks = written(marks.select(F.col("doc_id").alias(a), F.col("text_key").alias(b), gone), "near-marks")
    k1, k2 = row_key(docs, id_col, text_col)
    hit = (k1 == F.col(a)) & (k2 == F.col(b))
    single = docs.join(small(marks), hit, "left_anti")
    repeated = marks.filter(~F.col(gone)).drop(gone)
    if repeated.isEmpty():
        return single
    some = docs.join(small(repeated), hit).dropDuplicates([a, b])
    return single.unionByName(some.drop(a, b))


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
