"""Line dedup by runs of lines.

A text is cut into chunks: a line of LONG words, or a shorter line with the
blank lines after it, so that lines put in before a passage shift no boundary
within it. Besides, each run of shorter lines from any line on, as soon as it
has LONG words, is a window; so every passage of more words than two short lines
and LONG have holds a whole long line or window, whatever is around it. Chunks
and windows that come again anywhere are compared byte by byte with their first
occurrence, which itself stays. They and the lines beside them, as far as those
are beside the first occurrence too, are removed if together they have LONG
words, or two lines and LEAST words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap, is_marked, key_type, quoted, row_key, spare, table, written

#: Words that make a line a chunk of its own, and that several lines need to be removed.
LONG, LEAST = 20, 10
#: Characters of chunks that a task gives out at a time.
OUT_CHARS = 2 << 20


def _lines(text: str) -> list[tuple[int, int, int]]:
    """(start, end, words) for each line, in order; blank lines after one of under LONG words are part of it."""
    out, at = [], 0
    for line in text.removesuffix("\n").split("\n"):
        n, end = len(line.split()), min(at + len(line) + 1, len(text))
        if n == 0 and out and out[-1][2] < LONG:
            out[-1] = (out[-1][0], end, out[-1][2])
        else:
            out.append((at, end, n))
        at = end
    return out


def _hash(part: str) -> int:
    return xxhash.xxh3_64_intdigest(part.removesuffix("\n").encode("utf-8", "surrogatepass")) - (1 << 63)


def chunks(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, end, hash, whether it can be removed) for each chunk, in order; text[start:end] has its last line break.

    A short line can only be removed with others, so one between long lines is left to those.
    """
    spans = _lines(text)
    short = [False, *(0 < n < LONG for _, _, n in spans), False]
    fits = [n >= LONG or (n > 0 and (short[k] or short[k + 2])) for k, (_, _, n) in enumerate(spans)]
    return [(s, e, _hash(text[s:e]) if fit else 0, fit) for (s, e, _), fit in zip(spans, fits)]


def windows(text: str) -> list[tuple[int, int, int]]:
    """(start, end, hash) of the least run of short lines from each line on that has LONG words."""
    spans, out, j, words = _lines(text), [], 0, 0
    for i, (start, _, n) in enumerate(spans):
        if j < i:
            j, words = i, 0
        while words < LONG and j < len(spans) and 0 < spans[j][2] < LONG:
            words += spans[j][2]
            j += 1
        if words >= LONG:
            end = spans[j - 1][1]
            out.append((start, end, _hash(text[start:end])))
        if j > i:
            words -= n
    return out


def _spots(text: str) -> Iterator[tuple[int, int, int, int, int]]:
    """(start, end, low, high, hash) for each chunk that can be removed and each window; low and high are where the line before begins and the line after ends."""
    bounds = [(s, e) for s, e, _ in _lines(text)]
    first, last = {s: k for k, (s, _) in enumerate(bounds)}, {e: k for k, (_, e) in enumerate(bounds)}
    for s, e, h in [*((s, e, h) for s, e, h, fit in chunks(text) if fit), *windows(text)]:
        i, j = first[s], last[e]
        yield s, e, bounds[i - 1][0] if i else s, bounds[j + 1][1] if j + 1 < len(bounds) else e, h


def _chunk_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["d_id", "d_key", "start", "end", "low", "high", "hash"]
    for b in batches:
        yield pd.DataFrame([(i, k, *spot) for i, k, t in zip(b["d_id"], b["d_key"], b["text"]) for spot in _spots(t)], columns=cols)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The wanted parts (lo, hi) of each text, some OUT_CHARS at a time."""
    cols = ["f_id", "f_key", "lo", "hi", "part"]
    for b in batches:
        rows, size = [], 0
        for i, k, text, wanted in zip(b["f_id"], b["f_key"], b["text"], b["wanted"]):
            for w in wanted:
                rows.append((i, k, w["lo"], w["hi"], text[w["lo"] : w["hi"]]))
                size += w["hi"] - w["lo"]
                if size > OUT_CHARS:
                    yield pd.DataFrame(rows, columns=cols)
                    rows, size = [], 0
        yield pd.DataFrame(rows, columns=cols)


def _spans(runs: list[dict] | None) -> list[dict]:
    """The spans of runs, as cut() takes them."""
    out = []
    for run in runs or ():
        part, lo = run["part"], run["lo"]
        for c in run["pieces"]:
            start, end, low, high = c["f_start"] - lo, c["f_end"] - lo, c["f_low"] - lo, c["f_high"] - lo
            before = part[low:start] if low < start else None
            after = part[end:high].removesuffix("\n") if high > end else None
            out.append({"start": c["start"], "end": c["end"], "first_text": part[start:end].removesuffix("\n"), "before": before, "after": after})
    return out


def cut(text: str | None, spans: list[dict] | None) -> tuple[str | None, int]:
    """(text without the spans that equal their first occurrence and what goes with them, places of those removed)."""
    if text is None or spans is None or not len(spans):
        return text, 0
    again = []
    for c in spans:
        at = start = c["start"]
        end = c["end"]
        if text[start:end].removesuffix("\n") != c["first_text"]:
            continue
        for line in reversed(c["before"].split("\n")[:-1] if c["before"] else []):
            low = start - len(line) - 1
            if low < 0 or text[low:start] != line + "\n" or (low and text[low - 1] != "\n"):
                break
            start = low
        for line in c["after"].split("\n") if c["after"] is not None else []:
            high = end + len(line)
            if end >= len(text) or text[end:high] != line or (high < len(text) and text[high] != "\n"):
                break
            end = min(high + 1, len(text))
        again.append((start, end, at))
    runs: list[tuple[int, int, set[int]]] = []  # spans that overlap are one run
    for start, end, at in sorted(again):
        if runs and start < runs[-1][1]:
            runs[-1][2].add(at)
            runs[-1] = (runs[-1][0], max(runs[-1][1], end), runs[-1][2])
        else:
            runs.append((start, end, {at}))
    kept, at, gone = [], 0, 0
    for start, end, places in runs:
        words = [n for n in (len(line.split()) for line in text[start:end].split("\n")) if n]
        if sum(words) >= LONG or (len(words) > 1 and sum(words) >= LEAST):
            kept.append(text[at:start])
            at, gone = end, gone + len(places)
    kept.append(text[at:])
    out = "".join(kept)
    return (out.removesuffix("\n") if gone and not text.endswith("\n") else out), gone


def _marked(keys: DataFrame):
    """A filter on a hash that lets all of ``keys``, one column of such hashes, pass and few others."""
    bits = bitmap(keys)

    @F.pandas_udf("boolean")
    def passes(key: pd.Series) -> pd.Series:
        return pd.Series(is_marked(bits.value, key.to_numpy(np.int64)))

    return passes


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "removed_chunks") -> DataFrame:
    """``docs`` with repeated chunks and windows cut from the text and a column ``count_col`` put last.

    A chunk or window came before if its bytes did: in a document of lesser id
    (then lesser hash of the text; null ids first), or earlier in the same text.
    Beside it, lines that equal those beside the first occurrence go with it, as
    far as its neighbouring chunk there reaches; an equal line always stays at
    an earlier place. What overlaps of these is one run, which is removed if it
    has at least LONG words, or two lines and LEAST words; blank lines don't
    count. A document of which all came before has an empty text left. Rows that
    repeat id and text are one document and are treated alike. Null text stays
    null and empty text empty. If two different chunks have one hash, only those
    like the first are removed. ``count_col`` counts the places at which removed
    chunks and windows begin. Columns other than the text are as they were; an
    existing ``count_col`` is replaced. Ids of any type keep it; those that aren't
    integers sort as text. Texts are cut whole, however long they are. An empty
    table gives an empty one.
    """
    k1, k2 = row_key(docs, id_col, text_col)
    kind = f"d_id {key_type(docs, id_col)}, d_key bigint"
    texts = docs.filter(quoted(text_col).isNotNull()).select(k1.alias("d_id"), k2.alias("d_key"), quoted(text_col).alias("text"))
    spots = written(texts.mapInPandas(_chunk_rows, f"{kind}, start int, end int, low int, high int, hash bigint"), "chunks")
    place = F.struct("d_id", "d_key", "start")
    ends = spots.groupBy("hash").agg(F.min(F.struct("d_id", "d_key", "start", "end", "low", "high")).alias("at"), F.max(place).alias("last"))
    repeated = ends.filter(F.struct("at.d_id", "at.d_key", "at.start") != F.col("last"))
    repeated = written(repeated.select("hash", *[F.col(f"at.{x}").alias(f"f_{y}") for x, y in (("d_id", "id"), ("d_key", "key"), ("start", "start"), ("end", "end"), ("low", "low"), ("high", "high"))]), "repeated")
    again = spots.drop("low", "high").join(repeated, "hash").filter(place != F.struct("f_id", "f_key", "f_start")).drop("hash").repartition("d_id", "d_key")
    # what came in one piece from one text is one run, whose text is sent once
    doc, source = ["d_id", "d_key"], ["f_id", "f_key"]
    line = Window.partitionBy(*doc, *source, "shift").orderBy("start", "end")
    new = F.col("start") > F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    again = again.withColumn("shift", F.col("start") - F.col("f_start")).withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.collect_set(F.struct("start", "end", "f_start", "f_end", "f_low", "f_high"))  # a set, as rows may repeat
    runs = again.groupBy(*doc, *source, "shift", "run").agg(F.min("f_low").alias("lo"), F.max("f_high").alias("hi"), pieces.alias("pieces"))
    runs = written(runs.groupBy(*doc, *source, "lo", "hi").agg(F.flatten(F.collect_list("pieces")).alias("pieces")), "runs")
    wanted = runs.groupBy(*source).agg(F.collect_set(F.struct("lo", "hi")).alias("wanted"))
    holders = texts.filter(_marked(repeated.select("f_key").distinct())(F.col("d_key"))).select(F.col("d_id").alias("f_id"), F.col("d_key").alias("f_key"), "text")
    parts = holders.join(wanted, source).select(*source, "text", "wanted").mapInPandas(_parts, f"{kind.replace('d_', 'f_')}, lo int, hi int, part string").dropDuplicates([*source, "lo", "hi"])
    a, b, c, runs_name, done = spare(docs, "cut_id", "cut_key", "cut_hash", "cut_runs", "cut_done")
    spans = runs.join(parts, [*source, "lo", "hi"]).groupBy(F.col("d_id").alias(a), F.col("d_key").alias(b)).agg(F.collect_list(F.struct("part", "lo", "pieces")).alias(runs_name))

    @F.arrow_udf("struct<text: string, n: int>")
    def cut_all(text: pa.Array, runs: pa.Array) -> pa.Array:
        done = (cut(t.as_py(), _spans(r.as_py())) for t, r in zip(text, runs))  # a row's spans at a time
        texts, counts = zip(*done) if len(text) else ((), ())
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["text", "n"])

    names = [x for x in docs.columns if x.lower() != count_col.lower()]
    void = [x for x in names if isinstance(docs.select(quoted(x)).schema[0].dataType, T.NullType)]  # Parquet has no such columns
    rows = docs.select(*[quoted(x) for x in names if x not in void], k2.alias(c))
    touched = _marked(runs.select("d_key").distinct())
    joined = rows.filter(touched(F.col(c))).join(spans, (k1 == F.col(a)) & (F.col(c) == F.col(b)), "left").withColumn(done, cut_all(quoted(text_col), F.col(runs_name)))
    some = joined.select(*[F.col(done)["text"].alias(x) if x.lower() == text_col.lower() else quoted(x) for x in names if x not in void], F.col(done)["n"].alias(count_col))
    rest = rows.filter(~touched(F.col(c))).select(*[quoted(x) for x in names if x not in void], F.lit(0).alias(count_col))  # their texts aren't shuffled
    both = written(some, "cut").unionByName(rest)
    return both.select(*[F.lit(None).alias(x) if x in void else quoted(x) for x in names], quoted(count_col))


def query(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_chunks")
