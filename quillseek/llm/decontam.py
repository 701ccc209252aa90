"""Benchmark decontamination by template windows.

Texts become templates: numbers, names and units are typed placeholders, other
words are in lower case. Windows of templates are joined with those of the
benchmark. Windows of a document and an item that lie on one diagonal must
agree on the slots: a value of the item always stands for the same value in the
document. So copies are caught, and questions with other numbers or names. Items
that are almost only placeholders are looked for with their values as words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, id_back, id_key, is_marked, key_type, quoted, row_key, small, spare, table, written

#: Tokens in a window, least literal words in one, and part of an item's windows that a document must have.
WINDOW, LITERALS, COVERAGE = 8, 4, 0.5
#: Characters of texts that are looked through at a time, and least bits of the bitmap: with few, most texts have a window that passes by chance.
AT_ONCE, LEAST_BITS = 1 << 19, 1 << 24
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute "
    "minutes h hr hour hours day days week weeks month months year years % percent $ € £ ° usd eur dollar dollars euro euros cent cents kb mb gb tb hz khz mhz ghz w kw mw v a c f k j "
    "kj cal kcal mph kph n pa kpa mol".split()
)
_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|\w+|[.!?:\n%$€£°]")
_STOP = frozenset(".!?:\n")


def tokens(text: str, names: frozenset[str] = frozenset()) -> tuple[list[str], dict[int, str], bool]:
    """(tokens, {position: value of the slot there}, whether there is a name).

    A word with a capital first letter that isn't all capitals and doesn't begin
    a sentence, or any form of a word in ``names``, is a name; names that follow
    each other are one. A unit is one only beside a number.
    """
    out: list[str] = []
    slots: dict[int, str] = {}
    start, named, special = True, False, UNITS | names
    add = out.append
    for t in _TOKEN.findall(text):
        if t in _STOP:
            start = True
            continue
        low = t.lower()
        if t == low and t.isalpha() and low not in special:  # most words
            add(low)
            start = False
            continue
        if t[0].isdigit():
            slots[len(out)] = t
            out.append(NUM)
        elif low in UNITS and out and (out[-1] == NUM):
            slots[len(out)] = low
            out.append(UNIT)
        elif low in names or (not start and t != low and t[0].isupper() and not t.isupper()):
            named = True
            if out and out[-1] == NAME and not start:
                slots[len(out) - 1] += " " + low
            else:
                slots[len(out)] = low
                out.append(NAME)
        elif t in "%$€£°":
            pass
        else:
            out.append(low)
        start = False
    return out, slots, named


def forms(text: str, names: frozenset[str]) -> list[tuple[int, list[str], dict[int, str]]]:
    """The template (0) and, if it has names, the same text with them as words (1), for copies whose capitals differ."""
    toks, slots, named = tokens(text, names)
    if not named:
        return [(0, toks, slots)]
    plain, plain_slots, _ = tokens(text.lower())
    return [(0, toks, slots), (1, plain, plain_slots)]


def exact(text: str) -> tuple[list[str], dict[int, str]]:
    """Form 2: the tokens in lower case with numbers and units as they are, and which of them those are."""
    toks, slots, _ = tokens(text.lower())
    for k, value in slots.items():
        toks[k] = value
    return toks, slots


_MUL = np.uint64(0x9E3779B97F4A7C15)


#: Low bits that a token's hash leaves free.
_FREE = 14


def _hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token) >> _FREE << _FREE


class _Hashes(dict):
    """Hashes of tokens, kept."""

    def __missing__(self, token: str) -> int:
        h = self[token] = _hash(token)
        return h

    def of(self, toks: list[str]) -> np.ndarray:
        if len(self) > 100_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, toks), np.uint64, len(toks))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * _MUL + h[j : j + n]
    return out ^ (out >> np.uint64(29))


_END, _DIGIT, _UNIT, _NAMED, _CAPITAL, _SIGN, _EDGE = (1 << k for k in range(7))


class Templates(dict):
    """The templates of many texts at a time, as hashes only; they are those of tokens(), which is slower.

    Tokens are kept with a number: the hash, and in its free bits the flags in a
    text as it is and, seven bits higher, those in a text in lower case without names.
    """

    def __init__(self, names: frozenset[str] = frozenset()) -> None:
        self.names, self.special = names, UNITS | names

    def __missing__(self, t: str) -> int:
        low = t.lower()
        if low == t and t.isalpha() and low not in self.special:  # most words
            f = plain = 0
        elif t in _STOP:
            f = plain = _END
        elif t[0].isdigit():
            f = plain = _DIGIT
        else:
            plain = _UNIT * (low in UNITS) | _SIGN * (t in "%$€£°")
            f = plain | _NAMED * (low in self.names) | _CAPITAL * (t != low and t[0].isupper() and not t.isupper())
        k = self[t] = _hash(low) | plain << 7 | f
        return k

    def __call__(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(form, hashes of all tokens, number of the text of each) for the forms 0 and 1, the latter of the texts with a name. An edge, which is no token and has no number (-1), is before each text."""
        if len(self) > 200_000:
            self.clear()
        parts = [self._numbers(text) for text in texts]
        h, at, named = _template(np.concatenate(parts), 0)
        yield 0, h, at
        if len(named):
            # letters in lower case are the same tokens, but for these two
            lower = [self._numbers(t.lower()) if "İ" in (t := texts[k]) or "Σ" in t else parts[k] for k in named.tolist()]
            h, at, _ = _template(np.concatenate(lower), 7)
            yield 1, h, np.where(at < 0, -1, named[at])

    def _numbers(self, text: str) -> np.ndarray:
        toks = _TOKEN.findall(text)
        out = np.full(len(toks) + 1, _EDGE << 7 | _EDGE, np.uint64)
        out[1:] = np.fromiter(map(self.__getitem__, toks), np.uint64, len(toks))
        return out


def _template(numbers: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the tokens and edges, number of the text of each token, numbers of the texts that have a name)."""
    f = (numbers >> np.uint64(shift)).astype(np.uint8) & np.uint8(127)
    h, text = numbers >> np.uint64(_FREE) << np.uint64(_FREE), np.cumsum(f == _EDGE) - 1
    start = np.concatenate(([True], (f[:-1] & np.uint8(_END | _EDGE)) != 0))
    last = lambda x: np.concatenate(([False], x[:-1]))
    keep = (f & np.uint8(_END)) == 0
    f, h, text, start = f[keep], h[keep], text[keep], start[keep]
    digit = (f & np.uint8(_DIGIT)) != 0
    unit = ((f & np.uint8(_UNIT)) != 0) & last(digit)
    h[digit], h[unit] = _hash(NUM), _hash(UNIT)
    keep = ((f & np.uint8(_SIGN)) == 0) | unit
    f, h, text, start, unit = f[keep], h[keep], text[keep], start[keep], unit[keep]
    name = ~unit & (((f & np.uint8(_NAMED)) != 0) | (~start & ((f & np.uint8(_CAPITAL)) != 0)))
    h[name] = _hash(NAME)
    keep = ~(name & ~start & last(name))  # names that follow each other are one
    return h[keep], np.where(f == _EDGE, -1, text)[keep], np.unique(text[name])


def having(h: np.ndarray, text: np.ndarray, widths: list[int], marked: Callable[[np.ndarray], np.ndarray]) -> set[int]:
    """Numbers of the texts, of Templates, that have a window whose hash is marked."""
    edges, out = np.concatenate(([0], np.cumsum(text < 0))), set()
    for width in widths:
        hs = window_hashes(h, width)
        whole = edges[width:] == edges[: len(edges) - width] if len(hs) else np.empty(0, bool)
        out.update(text[: len(hs)][whole & marked(hs.view(np.int64))].tolist())
    return out


def _window(toks: list[str], slots: dict[int, str], i: int, width: int) -> tuple[str, list[str]]:
    return " ".join(toks[i : i + width]), [slots[k] for k in range(i, i + width) if k in slots]


def _useful(toks: list[str], width: int) -> bool:
    return sum(t not in (NUM, NAME, UNIT) for t in toks) >= min(LITERALS, width)


def item_windows(text: str | None, names: frozenset[str], hashes: _Hashes) -> list[tuple]:
    """[(form, windows of the form, index, template, slot values, hash)] of one item."""
    out = []
    for form, toks, slots in forms(text or "", names):
        width = min(WINDOW, len(toks))
        spots = [i for i in range(len(toks) - width + 1) if _useful(toks[i : i + width], width)] if width else []
        hs = window_hashes(hashes.of(toks), width) if spots else ()
        out += [(form, len(spots), i, width, *_window(toks, slots, i, width), int(hs[i].astype(np.int64))) for i in spots]
    if not out:  # almost only placeholders: windows with a word, all values compared
        toks, slots = exact(text or "")
        width = min(WINDOW, len(toks))
        spots = [i for i in range(len(toks) - width + 1) if any(k not in slots for k in range(i, i + width))]
        hs = window_hashes(hashes.of(toks), width) if spots else ()
        out += [(2, len(spots), i, width, " ".join(toks[i : i + width]), [], int(hs[i].astype(np.int64))) for i in spots]
    return out


def _parts(rows: list[tuple]) -> Iterator[list[tuple]]:
    """``rows``, whose last value is a text, some AT_ONCE characters at a time."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[-1])
        if size > AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def benchmark_names(texts: DataFrame) -> frozenset[str]:
    """Words that the items (column text) have with a capital within a sentence and never in lower case."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(sorted({w for t in b["text"] for w in _cased(t or "")}), columns=["word", "upper"])

    both = texts.mapInPandas(words, "word string, upper boolean").groupBy("word").agg(F.bool_and("upper").alias("upper"))
    return frozenset(r[0] for r in both.filter("upper").collect())


def _cased(text: str) -> Iterator[tuple[str, bool]]:
    """Words with whether they have a capital within a sentence; sentence starts and all capitals say nothing."""
    start = True
    for t in _TOKEN.findall(text):
        if t in _STOP:
            start = True
            continue
        if t[0].isalpha() and (t == t.lower() or not (start or t.isupper())):
            yield t.lower(), t != t.lower()
        start = False


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, item_id, coverage, kind) for each document and item that it has.

    A document has an item if windows of it, on diagonals whose slots are
    consistent, are at least ``coverage`` of the item's windows. kind: copy if
    no slot differs where most of the item is found, else reparameterised. An item shorter than WINDOW tokens is
    one window; one without words, or null, is ignored, as are windows of
    almost only placeholders. An item that has no others is found only with its
    own values, by its windows that have a word. Null or empty documents have
    nothing, and an empty table on either side gives an empty one. Texts are
    read whole. Rows that repeat an id and text are one; texts that share an item
    id are items of their own. Ids keep their types. text_key, with doc_id, names
    rows whose id is null or not unique. Other columns aren't read.
    """
    found = _leaks(docs, benchmark, coverage, id_col, text_col, item_col, item_text_col)
    return found.select(id_back(docs, id_col, F.col("d_id")).alias("doc_id"), F.col("d_key").alias("text_key"), id_back(benchmark, item_col, F.col("item")).alias("item_id"), "coverage", "kind")


def _leaks(docs: DataFrame, benchmark: DataFrame, coverage: float, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """find_leaks() with the keys (d_id, d_key) of the documents and (item) of the items."""
    spark = docs.sparkSession
    item_type, doc_type = key_type(benchmark, item_col), key_type(docs, id_col)
    i1, i2 = row_key(benchmark, item_col, item_text_col)
    items = benchmark.select(i1.alias("item"), i2.alias("item_key"), quoted(item_text_col).alias("text")).distinct()
    names = benchmark_names(items.select("text"))
    cols = ["item", "item_key", "i_form", "n_windows", "idx", "width", "template", "i_slots", "hash"]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for b in batches:
            yield pd.DataFrame([(i, k, *w) for i, k, t in zip(b["item"], b["item_key"], b["text"]) for w in item_windows(t, names, hashes)], columns=cols)

    windows = written(items.mapInPandas(build, f"item {item_type}, item_key bigint, i_form int, n_windows int, idx int, width int, template string, i_slots array<string>, hash bigint"), "benchmark-windows")
    widths = sorted(r[0] for r in windows.select("width").distinct().collect())
    values = not windows.filter("i_form = 2").isEmpty()
    sent = bitmap(windows.select("hash").distinct(), LEAST_BITS)  # what passes by chance has no equal template in the join

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, cols = _Hashes(), ["d_id", "d_key", "form", "pos", "template", "d_slots"]
        marked = lambda h: is_marked(sent.value, h)
        templates = Templates(names)
        for b in batches:
            rows: list[tuple] = []
            for part in _parts(list(zip(b["d_id"], b["d_key"], b["text"]))):
                some = [set(), set(), set(range(len(part))) if values else set()]
                for form, h, at in templates([t for _, _, t in part]):
                    some[form] = having(h, at, widths, marked)
                for k in sorted(set.union(*some)):  # the others have nothing
                    doc, key, text = part[k]
                    both = [x for x in forms(text, names) if k in some[x[0]]] if k in some[0] | some[1] else []
                    for form, toks, slots in [*both, *([(2, exact(text)[0], {})] if values else [])]:
                        h = hashes.of(toks)
                        for width in widths:
                            spots = np.flatnonzero(marked(window_hashes(h, width).view(np.int64))).tolist()
                            rows += [(doc, key, form, i, *_window(toks, slots, i, width)) for i in spots]
                        if len(rows) > 20_000:
                            yield pd.DataFrame(rows, columns=cols)
                            rows = []
            yield pd.DataFrame(rows, columns=cols)

    k1, k2 = row_key(docs, id_col, text_col)
    texts = docs.filter(quoted(text_col).isNotNull()).select(k1.alias("d_id"), k2.alias("d_key"), quoted(text_col).alias("text"))
    hits = written(texts.mapInPandas(scan, f"d_id {doc_type}, d_key bigint, form int, pos int, template string, d_slots array<string>"), "benchmark-hits").distinct()
    pairs = hits.join(small(windows.drop("hash", "width")), "template")
    key = ["d_id", "d_key", "item", "item_key"]
    slot_pairs = F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("i_slots", "d_slots"))))
    lines = pairs.groupBy(*key, "i_form", "n_windows", "form", (F.col("pos") - F.col("idx")).alias("diagonal")).agg(F.collect_set("idx").alias("idx"), slot_pairs.alias("slots"))
    lines = lines.withColumn("values", F.expr("size(array_distinct(transform(slots, s -> s.i_slots)))")).filter(F.col("values") == F.size("slots"))
    lines = lines.withColumn("same", F.expr("forall(slots, s -> lower(s.i_slots) = lower(s.d_slots))"))
    of = lambda idx: F.size(F.array_distinct(F.flatten(F.collect_list(idx))))
    found = lines.groupBy(*key, "i_form", "n_windows").agg(of("idx").alias("has"), of(F.when(F.col("same"), F.col("idx"))).alias("alike"))
    found = found.withColumns({"coverage": F.col("has") / F.col("n_windows"), "same": F.col("has") == F.col("alike")}).filter(F.col("coverage") >= coverage)
    best = found.groupBy("d_id", "d_key", "item").agg(F.max(F.struct("coverage", "same")).alias("best"))
    return best.select("d_id", "d_key", "item", "best.coverage", F.when(F.col("best.same"), F.lit("copy")).otherwise(F.lit("reparameterised")).alias("kind"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which find_leaks() finds an item; all columns as they are."""
    leaks = _leaks(docs, benchmark, coverage, id_col, text_col, item_col, item_text_col)
    a, b = spare(docs, "leak_id", "leak_key")
    found = written(leaks.select(F.col("d_id").alias(a), F.col("d_key").alias(b)).distinct(), "leaks")
    k1, k2 = row_key(docs, id_col, text_col)
    return docs.join(small(found), (k1 == F.col(a)) & (k2 == F.col(b)), "left_anti")


def query(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "coverage", "kind")
