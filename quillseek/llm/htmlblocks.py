"""HTML extraction by a recurrent block labeller.

A page is a sequence of leaf blocks: the text between block-level tags. Each
block has a vector of its tag path (hashed, with classes), its hashed words and
a few figures. A bidirectional LSTM in numpy reads a page's whole sequence, so
every block is labelled with the context of all others. The model is fitted here
on a bounded sample of pages whose own markup (article or main, outside of
navigation, footers and advertisements) says what is content; half of the time
the path is hidden from it, so that it learns words and order too.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_key, key_type, quoted, small, table, written

PATH, WORDS, FIGURES, HIDDEN = 32, 48, 6, 16
DIM = PATH + WORDS + FIGURES
#: Pages that the model is fitted on, at most; rounds over them; pages in a step.
SAMPLE, EPOCHS, BATCH = 320, 4, 16
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_CLASS = re.compile(r"""(?:class|id)\s*=\s*["']?([^"'>]+)""", re.I)
_SKIP = frozenset("script style noscript template svg iframe object textarea".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "body": {"head"}}
_FENCE = frozenset("ul ol table div article section main body html td tr dl nav".split())
_ENDS = {t: re.compile(rf"</{t}\s*+>", re.I) for t in _SKIP}
_WORD = re.compile(r"\w+")
#: What is left of a step's weight in the path's vector one step further down.
DAMPING = 0.6
_CONTENT, _NOT, _NOT_MARKS = {"article", "main"}, {"nav", "footer", "aside", "form"}, {"ad", "ads", "advert", "nav", "menu", "footer"}


class Path:
    """The block-level tags from the root to a block; each step adds to what the step above has, so deep pages cost no more."""

    __slots__ = ("above", "label", "vector", "inside", "outside")

    def __init__(self, above: Path | None, label: str):
        self.above, self.label = above, label
        self.vector = np.zeros(PATH, np.float32) if above is None else above.vector * np.float32(DAMPING)
        self.vector[xxhash.xxh3_64_intdigest(label) % PATH] += 1
        tag, _, mark = label.partition(".")
        self.inside = tag in _CONTENT or (above is not None and above.inside)
        self.outside = tag in _NOT or mark in _NOT_MARKS or (above is not None and above.outside)

    @classmethod
    def of(cls, *labels: str) -> Path | None:
        path = None
        for label in labels:
            path = cls(path, label)
        return path

    def steps(self) -> tuple[str, ...]:
        out, at = [], self
        while at is not None:
            out.append(at.label)
            at = at.above
        return tuple(reversed(out))


class Paths:
    """Paths that were made, as pages of a site share them."""

    def __init__(self) -> None:
        self.made: dict[tuple[Path | None, str], Path] = {}

    def of(self, above: Path | None, label: str) -> Path:
        path = self.made.get((above, label))
        if path is None:
            if len(self.made) > 50_000:
                self.made.clear()
            path = self.made[above, label] = Path(above, label)
        return path


class _Open:
    """The tags that are open, with the places of each, so that ends are found without a search."""

    def __init__(self, paths: Paths) -> None:
        self.paths = paths
        self.tags: list[tuple[str, Path | None]] = []
        self.places: dict[str, list[int]] = {}
        self.fences: list[int] = []

    def path(self) -> Path | None:
        return self.tags[-1][1] if self.tags else None

    def push(self, tag: str, label: str) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag in _FENCE:
            self.fences.append(len(self.tags))
        self.tags.append((tag, self.path() if tag in _INLINE else self.paths.of(self.path(), label)))

    def last(self, tags) -> int:
        """Place of the last of ``tags`` that is open, unless a container was opened after it; -1 if there is none."""
        at = max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)
        return at if not self.fences or at >= self.fences[-1] else -1

    def cut(self, at: int) -> None:
        while len(self.tags) > at:
            tag, _ = self.tags.pop()
            self.places[tag].pop()
            if tag in _FENCE:
                self.fences.pop()


def _tags(html: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, "/" for an end, name in lower case, attributes) of each tag, and the text after the last, whose name is empty.

    Comments, CDATA and declarations are left out, as is what hidden elements
    hold. Every search either moves on by what it finds or is not made again,
    so the time is linear in the length.
    """
    at = begin = 0
    parts: list[str] = []
    unended: set[str] = set()
    loose = False  # quotes don't balance up to the end: tags end at the next ">"

    def find(what: str, start: int) -> int:
        if what in unended:
            return -1
        place = html.find(what, start)
        if place < 0:
            unended.add(what)
        return place

    while True:
        lt = html.find("<", at)
        if lt < 0:
            break
        nxt = html[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            close = next((c for o, c in (("<!--", "-->"), ("<![CDATA[", "]]>")) if html.startswith(o, lt)), None)
            end = find(close, lt + 4) if close else -1
            end = end + 3 if end >= 0 else find(">", lt) + 1
            if not end:
                at = lt + 1
                continue
            parts.append(html[begin:lt])
            begin = at = end
            continue
        m = _NAME.match(html, lt)
        if m is None:
            at = lt + 1
            continue
        end = -1
        if not loose:
            end = _ATTRIBUTES.match(html, m.end()).end()
            if html[end : end + 1] != ">":
                end, loose = -1, True
        if end < 0:
            end = find(">", m.end())
        if end < 0:
            break  # no tag ends any more
        parts.append(html[begin:lt])
        name, attributes, slash = m.group(1).lower(), html[m.end() : end], "/" if nxt == "/" else ""
        begin = at = end + 1
        if name in _SKIP:
            if not slash and not attributes.endswith("/"):
                close = _ENDS[name].search(html, at)
                begin = at = close.end() if close else len(html)
            parts.append(" ")
            continue
        yield "".join(parts), slash, name, attributes
        parts.clear()
    yield "".join(parts) + html[begin:], "", "", ""


def blocks(html: str, paths: Paths | None = None) -> list[tuple[Path | None, str, float]]:
    """(tag path, text, part of its letters that are link text) of every block that has text, in order.

    Never fails, and takes time in proportion to the length: tags that aren't
    closed or opened are tolerated, a tag that isn't ended is text, and scripts
    that aren't ended reach to the end.
    """
    out: list[tuple[Path | None, str, float]] = []
    tags = _Open(paths or Paths())
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((tags.path(), text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    for text, slash, name, attributes in _tags(html):
        if text:
            parts.append(text)
            if tags.places.get("a"):
                linked += len(text)
        if not name:
            continue
        if name not in _INLINE:
            flush()
        if slash:
            at = (tags.places.get(name) or [-1])[-1] if name in _FENCE else tags.last((name,))
            if at >= 0:
                tags.cut(at)
            continue
        if name in _VOID:
            continue
        if (at := tags.last(_CLOSES.get(name, ()))) >= 0:
            tags.cut(at)
        if name not in _INLINE:  # inline tags that were left open end with their block
            n = len(tags.tags)
            while n and tags.tags[n - 1][0] in _INLINE:
                n -= 1
            tags.cut(n)
        if not attributes.endswith("/"):
            mark = _CLASS.search(attributes) if attributes else None
            tags.push(name, f"{name}.{mark.group(1).split()[0].lower()}" if mark and mark.group(1).split() else name)
    flush()
    return out


def silver(path: Path | None) -> bool:
    """What the markup says: within article or main, and not in navigation, a footer, an aside or an advertisement."""
    return path is not None and path.inside and not path.outside


class Features:
    def __init__(self) -> None:
        self.slot: dict[str, int] = {}

    def _of(self, word: str) -> int:
        h = self.slot.get(word)
        if h is None:
            if len(self.slot) > 100_000:
                self.slot.clear()
            d = xxhash.xxh3_64_intdigest(word)
            h = self.slot[word] = (d % WORDS) * 2 + (d >> 63)
        return h

    def __call__(self, page: list[tuple[Path | None, str, float]]) -> np.ndarray:
        """(blocks, DIM); all words of a block count."""
        n = len(page)
        x = np.zeros((n, DIM), np.float32)
        sizes, slots = np.zeros(n, np.int64), []
        for i, (path, text, links) in enumerate(page):
            if path is not None:
                x[i, :PATH] = path.vector
            words = _WORD.findall(text.lower())
            slots += map(self._of, words)
            sizes[i] = len(words)
            x[i, PATH + WORDS :] = (np.log1p(len(words)) / 4, np.log1p(len(text)) / 6, links, min(1.0, 3 * sum(map(text.count, ".,;!?")) / (1 + len(words))), i / n, 1.0)
        if slots:
            s = np.array(slots, np.int64)
            at = np.repeat(np.arange(n), sizes) * WORDS + (s >> 1)
            counts = np.bincount(at, weights=np.where(s & 1, 1.0, -1.0), minlength=n * WORDS).reshape(n, WORDS)
            x[:, PATH : PATH + WORDS] = counts / np.sqrt(np.maximum(1, sizes))[:, None]
        return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def init(seed: int = 11, dim: int = DIM, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"w{d}"] = (rng.standard_normal((dim + hidden, 4 * hidden)) / np.sqrt(dim + hidden)).astype(np.float32)
        p[f"c{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)  # the forget gate is open at first
    p["wo"], p["bo"] = (rng.standard_normal(2 * hidden) / np.sqrt(hidden)).astype(np.float32), np.zeros(1, np.float32)
    return p


def _run(x: np.ndarray, mask: np.ndarray, w: np.ndarray, c: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """x: (steps, pages, dim); states stay as they are where mask is 0. Returns the hidden states and what _back() needs."""
    t, n, dim = x.shape
    h_dim = w.shape[1] // 4
    h, s, out, tape = np.zeros((n, h_dim), x.dtype), np.zeros((n, h_dim), x.dtype), np.empty((t, n, h_dim), x.dtype), []
    first = x.reshape(-1, dim) @ w[:dim] + c
    first = first.reshape(t, n, -1)
    for k in range(t):
        z = first[k] + h @ w[dim:]
        gates = _sigmoid(z[:, : 3 * h_dim])
        i, f, o, g = gates[:, :h_dim], gates[:, h_dim : 2 * h_dim], gates[:, 2 * h_dim :], np.tanh(z[:, 3 * h_dim :])
        m = mask[k][:, None]
        new = f * s + i * g
        tanh = np.tanh(new)
        if keep:
            tape.append((h, s, i, f, o, g, tanh, m))
        s, h = m * new + (1 - m) * s, m * (o * tanh) + (1 - m) * h
        out[k] = h
    return out, tape


def _back(x: np.ndarray, w: np.ndarray, tape: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t, n, dim = x.shape
    dw, dc = np.zeros_like(w), np.zeros(w.shape[1], x.dtype)
    dh = ds = np.zeros((n, w.shape[1] // 4), x.dtype)
    for k in range(t - 1, -1, -1):
        h, s, i, f, o, g, tanh, m = tape[k]
        dh = dh + d_out[k]
        on = m * dh
        dn = m * ds + on * o * (1 - tanh * tanh)
        dz = np.concatenate([dn * g * i * (1 - i), dn * s * f * (1 - f), on * tanh * o * (1 - o), dn * i * (1 - g * g)], 1)
        dw[:dim] += x[k].T @ dz
        dw[dim:] += h.T @ dz
        dc += dz.sum(0)
        dh, ds = (1 - m) * dh + dz @ w[dim:].T, (1 - m) * ds + dn * f
    return dw, dc


def forward(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits (steps, pages); pages are padded at the end. The backward pass reads the padding first, which changes nothing."""
    hf, tf = _run(x, mask, p["wf"], p["cf"], keep)
    hb, tb = _run(x[::-1], mask[::-1], p["wb"], p["cb"], keep)
    both = np.concatenate([hf, hb[::-1]], 2)
    return both @ p["wo"] + p["bo"][0], (both, tf, tb)


def loss_and_grads(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the blocks and its gradients, through time."""
    z, (both, tf, tb) = forward(p, x, mask, True)
    total = mask.sum()
    loss = float((mask * (np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z))))).sum() / total)
    dz = mask * (_sigmoid(z) - y) / total
    d_both, h = dz[:, :, None] * p["wo"], both.shape[2] // 2
    g = {"wo": np.einsum("tn,tnh->h", dz, both), "bo": np.array([dz.sum()], x.dtype)}
    g["wf"], g["cf"] = _back(x, p["wf"], tf, d_both[:, :, :h])
    g["wb"], g["cb"] = _back(x[::-1], p["wb"], tb, d_both[::-1, :, h:])
    return loss, g


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(x) for x in pages)
    x, mask = np.zeros((t, len(pages), pages[0].shape[1]), np.float32), np.zeros((t, len(pages)), np.float32)
    for k, a in enumerate(pages):
        x[: len(a), k], mask[: len(a), k] = a, 1
    return x, mask


def train(pages: list[str], epochs: int = EPOCHS, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights fitted on the pages' own markup by Adam. Without any block, the weights as they began."""
    rng, make, p = np.random.default_rng(seed), Features(), init()
    data = [(make(b), np.array([silver(path) for path, _, _ in b], np.float32)) for b in map(blocks, pages) if b]
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    data.sort(key=lambda d: len(d[0]))  # pages of like length together
    for _ in range(epochs):
        for b in rng.permutation(-(-len(data) // BATCH)):
            part = data[b * BATCH : (b + 1) * BATCH]
            x, mask = pad([d[0] for d in part])
            y = pad([d[1][:, None] for d in part])[0][:, :, 0]
            x[:, :, :PATH] *= rng.random((1, x.shape[1], 1)) < 0.5
            _, g = loss_and_grads(p, x, mask, y)
            step += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                p[k] -= (0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def label(p: dict[str, np.ndarray], pages: list[list], make: Features, group: int = 64) -> list[np.ndarray]:
    """For each page's blocks, whether they are content; pages of like length are run together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    i = 0
    while i < len(order):
        n = group
        while n > 1 and len(pages[order[min(i + n, len(order)) - 1]]) * n > 16_384:
            n //= 2  # bounds the memory of long pages
        part = order[i : i + n]
        x, mask = pad([make(pages[k]) for k in part])
        z, _ = forward(p, x, mask)
        for c, k in enumerate(part):
            out[k] = z[: len(pages[k]), c] > 0
        i += n
    return out


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """A model from the ``sample`` labelled pages whose ids hash least: those that have an article or main tag. Without any such page, None; see extract()."""
    html, key = quoted(html_col), id_key(pages, id_col)
    marked = pages.filter(html.rlike(r"(?i)<(article|main)[\s>]"))
    ids = marked.select(key.alias("id"), F.xxhash64(html).alias("h")).orderBy(F.xxhash64("id"), "id", "h").limit(sample).distinct()
    a, b = "sample_id", "sample_h"
    chosen = small(written(ids.select(F.col("id").alias(a), F.col("h").alias(b)), "html-sample"))  # at most ``sample`` rows
    texts = pages.select(key.alias("id"), html.alias("html")).join(chosen, (F.col("id") == F.col(a)) & (F.xxhash64("html") == F.col(b)), "left_semi")
    rows = texts.select("html", F.xxhash64("html").alias("h")).orderBy("h", "html").limit(sample).collect()
    return train([r[0] for r in rows]) if rows else None


def extract(pages: DataFrame, model: dict[str, np.ndarray] | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, n_blocks, n_content, labels, text) for every row.

    labels has 1 or 0 for each block in order; text has the content blocks, one a
    line. Null html gives null labels and text and no block; html without text
    gives empty ones. Pages are read whole; repeated rows give repeated results.
    Ids keep their type; no pages give no rows. Other columns aren't read.

    Without a model (no page had the markup that labels are made of), a block is
    content if less than half of it is link text and it has ten words.
    """
    known = pages.sparkSession.sparkContext.broadcast(model)  # some 12,000 numbers, whatever the pages

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make, paths = Features(), Paths()
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.iloc[i : i + 256]
                found = [blocks(h, paths) if h else [] for h in part["html"]]
                marks = label(known.value, found, make) if known.value is not None else [np.array([links < 0.5 and len(t.split()) >= 10 for _, t, links in f], bool) for f in found]
                yield pd.DataFrame(
                    {
                        "page_id": part["page_id"], "url": part["url"], "n_blocks": [len(f) for f in found], "n_content": [int(m.sum()) for m in marks],
                        "labels": [None if h is None else "".join("01"[int(x)] for x in m) for h, m in zip(part["html"], marks)],
                        "text": [None if h is None else "\n".join(t for (_, t, _), x in zip(f, m) if x) for h, f, m in zip(part["html"], found, marks)],
                    }
                )

    rows = pages.select(id_key(pages, id_col).alias("page_id"), quoted(url_col).alias("url"), quoted(html_col).alias("html"))
    out = rows.mapInPandas(run, f"page_id {key_type(pages, id_col)}, url string, n_blocks int, n_content int, labels string, text string")
    return out.withColumn("page_id", id_back(pages, id_col, F.col("page_id")))


def query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
