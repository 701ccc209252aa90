"""Blocked, compressed inverted lists and the positions of their entries."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codec import VARBYTE, Codec, lengths, lists, running, varbyte_length
from ..shared import parts, written
from .numbering import running_sum

CHUNK = 128
#: Ids whose postings, and chunks whose offsets, of one term are numbered by one task.
SPAN, CHUNK_SPAN = 1 << 20, 1 << 16
#: A term is in the full lexicon if its df is over FULL_DF, or if over SINCE postings came since the last full one.
FULL_DF, SINCE = 50, 500


def chunked(posts: DataFrame) -> DataFrame:
    """(term, doc_id, freq, chunk_id, gap): CHUNK postings a chunk; the first gap of a chunk is the id itself.

    A term's postings are numbered by ranges of SPAN ids: only the ranges'
    counts and last ids pass through a window over the whole term, so a word
    that is in every document is shared by many tasks. Both uses of the
    postings read one shuffle.
    """
    rows = posts.select("term", "doc_id", "freq", F.expr(f"doc_id div {SPAN}").alias("__r"))
    rows = rows.filter(F.col("term").isNotNull() & F.col("__r").isNotNull()).repartition(parts(posts), "term", "__r")  # the join would put this filter on one side only
    by_term = W.partitionBy("term").orderBy("__r")
    ranges = rows.groupBy("term", "__r").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"), F.max("freq").alias("freq")).select(  # with freq, so that this is the same shuffle
        "term", "__r", F.when(F.col("freq").isNotNull(), F.coalesce(F.sum("n").over(by_term.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("__base"), F.lag("last").over(by_term).alias("__last"),
    )
    here = W.partitionBy("term", "__r").orderBy("doc_id")
    placed = rows.select("*", F.row_number().over(here).alias("__i"), F.lag("doc_id").over(here).alias("__before")).join(ranges, ["term", "__r"]).withColumn("__n", F.col("__base") + F.col("__i") - 1)
    before = F.coalesce(F.col("__before"), F.col("__last"), F.lit(0))
    return placed.select("term", "doc_id", "freq", F.expr(f"__n div {CHUNK}").alias("chunk_id"), (F.col("doc_id") - F.when(F.col("__n") % CHUNK == 0, 0).otherwise(before)).alias("gap"))


_CHUNK = "term string, chunk_id bigint, last_doc_id bigint, n bigint, n_bytes bigint"


def _folded(posts: DataFrame, content: bool) -> DataFrame:
    """(term, chunk_id, last_doc_id, n, n_bytes) of each chunk, and with ``content`` its gaps and freqs.

    Postings are shuffled once, by term, and read as a sorted stream of which
    only a chunk is kept. A document has a term once, so no term has more
    than its share of a document's terms (one in some hundred) of all postings.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, doc, freq, first = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), 0  # the last chunk, which may go on, and its number
        for b in chain(batches, [None]):
            if b is not None:
                if b.column(0).null_count or b.column(1).null_count:
                    b = b.filter(pc.and_(pc.is_valid(b.column(0)), pc.is_valid(b.column(1))))
                term, doc, freq = pa.concat_arrays([term, b.column(0)]), np.concatenate([doc, b.column(1).to_numpy()]), np.concatenate([freq, b.column(2).to_numpy()])
            if not len(doc):
                continue
            new = np.concatenate([[True], pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)])
            heads = np.flatnonzero(new)
            place = np.arange(len(doc)) - heads[np.cumsum(new) - 1]
            place[: heads[1] if len(heads) > 1 else len(doc)] += first * CHUNK
            starts = np.flatnonzero(place % CHUNK == 0)
            gap = np.diff(doc, prepend=0)
            gap[starts] = doc[starts]
            ends, ids = np.append(starts[1:], len(doc)), place[starts] // CHUNK
            done = len(starts) - (b is not None)
            if done:
                to = ends[done - 1]
                size = np.add.reduceat((lengths(gap) + lengths(freq))[:to], starts[:done])
                out = [term.take(pa.array(starts[:done])), ids[:done], doc[ends[:done] - 1], (ends - starts)[:done], size]
                if content:
                    at = np.append(starts[:done], to)
                    out += [lists(gap[:to], at, out[0]), lists(freq[:to], at, out[0])]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in out], names)
            if b is not None:
                at, first = starts[-1], int(ids[-1])
                term, doc, freq = term[at:], doc[at:], freq[at:]

    kind = _CHUNK + (", gaps array<bigint>, freqs array<bigint>" if content else "")
    names = [x.split()[0] for x in kind.split(", ")]
    rows = posts.select("term", "doc_id", "freq")  # a filter of nulls here would be inferred of the tokens, which would be made twice
    return rows.repartition(parts(posts), "term").sortWithinPartitions("term", "doc_id").mapInArrow(fold, kind)


def chunk_sizes(posts: DataFrame) -> DataFrame:
    """(term, chunk_id, last_doc_id, n, n_bytes) of each chunk."""
    return _folded(posts, False)


def blocks(posts: DataFrame, codec: Codec = VARBYTE) -> DataFrame:
    """Chunks with their content: gaps, freqs and payload, the bytes that ``codec`` makes of all gaps and then of all freqs."""
    rows = _folded(posts, True).withColumn("payload", codec.encode(F.concat("gaps", "freqs")))
    return rows.select("term", "chunk_id", "last_doc_id", "n", F.octet_length("payload").cast("bigint").alias("n_bytes"), "gaps", "freqs", "payload")


def _postings(chunks: DataFrame, ids: Column, freqs: Column) -> DataFrame:
    """A row for each posting; each chunk's are made within its row."""
    return chunks.select("term", F.posexplode_outer(ids).alias("i", "doc_id"), freqs.alias("freqs")).filter("i is not null").select("term", "doc_id", F.expr("freqs[i]").alias("freq"))


def unblock(chunks: DataFrame) -> DataFrame:
    """Postings of blocks(): ids are running sums of the gaps."""
    return _postings(chunks.select("term", "freqs", running(F.col("gaps")).alias("ids")), F.col("ids"), F.col("freqs"))


def unpack(chunks: DataFrame, codec: Codec = VARBYTE) -> DataFrame:
    """Postings (term, doc_id, freq) of the payloads of blocks(), whose gaps and freqs aren't read."""
    numbers = codec.decode(F.col("payload"))
    rows = chunks.select("term", numbers.alias("x"), running(numbers).alias("sums")).withColumn("n", F.expr("cast(size(x) div 2 as int)"))
    return _postings(rows, F.expr("slice(sums, 1, n)"), F.expr("slice(x, n + 1, n)"))


def full_terms(lex: DataFrame) -> DataFrame:
    """(term, df, is_full) by FULL_DF and SINCE in the order of the terms; the first term is full.

    A term of df over FULL_DF starts a segment; the count since the last full
    term depends on a segment's terms only, so segments are folded apart, each
    as a sorted stream of which only the count is kept.
    """
    big = F.when(F.col("df") > FULL_DF, 1).otherwise(0)
    rows = running_sum(lex.select("term", "df"), [F.col("term")], big, "before").select((F.col("before") + big).alias("segment"), "term", "df")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = since = None
        for b in batches:
            flags = []
            for segment, df in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if segment != now:
                    now, since = segment, 0 if segment else SINCE + 1
                full = df > FULL_DF or since > SINCE
                since = 0 if full else since + df
                flags.append(full)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(flags, pa.bool_())], ["term", "df", "is_full"])

    return rows.repartition("segment").sortWithinPartitions("segment", "term").mapInArrow(fold, "term string, df bigint, is_full boolean")


def entry_sizes(chunks: DataFrame, sparse: bool = False) -> DataFrame:
    """(term, df, n_chunks, bytes, is_full) of chunk_sizes(): bytes of each term's entry: the head of a sparse one, chunk count, chunk metadata, chunks."""
    sizes = chunks.groupBy("term").agg(
        F.sum("n").alias("df"), F.count("*").alias("n_chunks"), F.sum(varbyte_length(F.col("last_doc_id")) + varbyte_length(F.col("n_bytes")) + F.col("n_bytes")).alias("body"),
    )
    sizes = sizes.withColumn("bytes", F.col("body") + varbyte_length(F.col("n_chunks")))
    if not sparse:
        return sizes.select("term", "df", "n_chunks", "bytes", F.lit(True).alias("is_full"))
    sizes = written(sizes, "entry-sizes")  # a row a term, read for the rule and for the sizes
    length = F.octet_length("term").cast("bigint")
    head = F.when(F.col("is_full"), F.lit(0)).otherwise(1 + varbyte_length(F.col("df")) + varbyte_length(length) + length)
    return sizes.join(full_terms(sizes.select("term", "df")).select("term", "is_full"), "term").select("term", "df", "n_chunks", (F.col("bytes") + head).alias("bytes"), "is_full")


def positions(posts: DataFrame, sparse: bool = False, chunks: DataFrame | None = None) -> DataFrame:
    """(term, df, position, next_position, is_full): where each entry starts and where the next one does; the last one's next is the end. ``chunks`` are the chunk_sizes() if they are there."""
    out = running_sum(entry_sizes(chunk_sizes(posts) if chunks is None else chunks, sparse), [F.col("term")], F.col("bytes"), "position")
    return out.select("term", "df", "position", (F.col("position") + F.col("bytes")).alias("next_position"), "is_full")


def chunk_offsets(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, relative_position): bytes of the term's chunks before. As in chunked(), only totals of CHUNK_SPAN chunks pass through a window over a whole term."""
    rows = chunks.select("term", "chunk_id", "n_bytes", F.expr(f"chunk_id div {CHUNK_SPAN}").alias("__r")).filter(F.col("term").isNotNull() & F.col("__r").isNotNull()).repartition("term", "__r")
    before = lambda w: F.coalesce(F.sum("n_bytes").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = rows.groupBy("term", "__r").agg(F.sum("n_bytes").alias("n_bytes"), F.max("chunk_id").alias("last"))  # with chunk_id, so that this is the same shuffle
    spans = spans.select("term", "__r", F.when(F.col("last").isNotNull(), before(W.partitionBy("term").orderBy("__r"))).alias("__base"))
    placed = rows.withColumn("__w", before(W.partitionBy("term", "__r").orderBy("chunk_id"))).join(spans, ["term", "__r"])
    return placed.select("term", "chunk_id", (F.col("__base") + F.col("__w")).alias("relative_position"))
