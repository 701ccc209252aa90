import math
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from quillseek.llm import htmlblocks as H

KIND = "page_id bigint, url string, html string"


def test_blocks():
    html = "<!DOCTYPE html><head><title>T &amp; t</title><style>p{}</style><script>var t='</p>'</script></head><body><nav><ul><li><a href='/x'>one</a><li>two</ul></nav><!-- <p>no</p> --><div class='ad big'>buy</div><article><h1>H</h1><p><b>bold text<br>more<p>next</article>tail < 3 <footer>&copy; f"
    got = [(path.steps() if path else (), text) for path, text, _ in H.blocks(html)]
    assert got == [
        (("head", "title"), "T & t"), (("body", "nav", "ul", "li"), "one"), (("body", "nav", "ul", "li"), "two"), (("body", "div.ad"), "buy"), (("body", "article", "h1"), "H"),
        (("body", "article", "p"), "bold text"), (("body", "article", "p"), "more"), (("body", "article", "p"), "next"), (("body",), "tail < 3"), (("body", "footer"), "© f"),
    ]
    assert H.blocks(html)[1][2] == 1.0 and H.blocks(html)[3][2] == 0.0


@pytest.mark.parametrize("html", ["", "<", "<p", "text only", "</p></div>", "<script>never ended <p>x</p>", "<p a='>'>q</p>", "<" * 500, "<p>" * 5000 + "deep", "&#xZZ; &nbsp;", "<a><b><i>" * 300])
def test_blocks_never_fail(html):
    H.blocks(html)


BROKEN = ["<a ", "<!--", "<script>", "<script ", "</script ", "<b>", "<div>x", "<ul><li>x", "<![CDATA[", "<", "&#", '<a ">', "<a '\"> ", "<p><div><b></p>", "</p", "<!"]


@pytest.mark.parametrize("part", BROKEN)
def test_time_is_linear(part):
    """A megabyte of any broken markup; a quadratic scan would take minutes to hours."""
    page = part * (1_000_000 // len(part))
    began = time.process_time()
    H.blocks(page)
    assert time.process_time() - began < 10


def test_nothing_is_cut():
    """However deep a block is, its path has all steps, and links are links however far inside their tag is."""
    deep = "<article>" + "<div class=x>" * 40 + "<a href=1>" + "<b><i><u><em><q>" + "linked text" + "</q></em></u></i></b></a>"
    (path, text, links), = H.blocks(deep)
    assert len(path.steps()) == 41 and H.silver(path) and links == 1.0
    shallow = H.Path.of(*["div.x"] * 40)
    assert not np.array_equal(path.vector, shallow.vector)


def test_extract_against_a_scalar_forward_pass(spark):
    """The labels of extract() are those of an LSTM written out for one block and one number at a time."""
    pages = [r["html"] for r in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()][:25]
    model, make = H.train(pages[:10], epochs=1), H.Features()
    sig = lambda z: 1 / (1 + math.exp(-z))

    def run(rows, w, c):
        n, out = w.shape[1] // 4, []
        h, s = [0.0] * n, [0.0] * n
        for x in rows:
            both = [*x, *h]
            z = [float(c[j]) + sum(a * float(b) for a, b in zip(both, w[:, j]) if a) for j in range(4 * n)]
            i, f, o, g = ([fn(v) for v in z[k * n : k * n + n]] for k, fn in enumerate((sig, sig, sig, math.tanh)))
            s = [fk * sk + ik * gk for fk, sk, ik, gk in zip(f, s, i, g)]
            h = [ok * math.tanh(sk) for ok, sk in zip(o, s)]
            out.append(h)
        return out

    want = []
    for page in pages:
        x = make(H.blocks(page)).astype(float).tolist()
        ahead, back = run(x, model["wf"], model["cf"]), run(x[::-1], model["wb"], model["cb"])[::-1]
        logits = [sum(a * float(w) for a, w in zip(u + v, model["wo"])) + float(model["bo"][0]) for u, v in zip(ahead, back)]
        want.append(["?" if abs(z) < 1e-4 else "01"[z > 0] for z in logits])
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], KIND)
    got = {r.page_id: r.labels for r in H.extract(df, model).collect()}
    for i, w in enumerate(want):
        assert len(got[i]) == len(w) and all(a in ("?", b) for a, b in zip(w, got[i]))


def test_pages_without_the_markup(spark):
    """Without any article or main tag there is no model, and long blocks that aren't links are content."""
    df = spark.createDataFrame([(1, "u", "<nav><a>one two three four five six seven eight nine ten</a></nav><p>one two three four five six seven eight nine ten</p><p>short</p>")], KIND)
    assert H.fit(df) is None and H.extract(df, None).first().labels == "010"


def test_gradients():
    """Back-propagation through time against differences, with padding."""
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in H.init(dim=5, hidden=3).items()}
    x, mask = rng.standard_normal((6, 3, 5)), np.ones((6, 3))
    mask[4:, 1] = mask[2:, 2] = 0
    y = (rng.random((6, 3)) < 0.5).astype(float)
    _, g = H.loss_and_grads(p, x, mask, y)
    for k in p:
        for at in rng.choice(p[k].size, min(12, p[k].size), replace=False):
            i = np.unravel_index(at, p[k].shape)
            old, e = p[k][i], 1e-6
            p[k][i] = old + e
            up, _ = H.loss_and_grads(p, x, mask, y)
            p[k][i] = old - e
            down, _ = H.loss_and_grads(p, x, mask, y)
            p[k][i] = old
            assert g[k][i] == pytest.approx((up - down) / (2 * e), abs=1e-6), k


def test_padding_changes_nothing():
    p, make = H.init(), H.Features()
    a, b = [(H.Path.of("body", "p"), f"word {i} of text", 0.0) for i in range(3)], [(H.Path.of("body", "nav", "li"), f"link {i}", 1.0) for i in range(9)]
    alone, _ = H.forward(p, *H.pad([make(a)]))
    both, _ = H.forward(p, *H.pad([make(a), make(b)]))
    assert np.allclose(alone[:, 0], both[:3, 0], atol=1e-5)


def test_context_is_the_whole_document():
    p, make = H.init(), H.Features()
    page = [(H.Path.of("body", "p"), "same words here", 0.0)] * 6
    other = page[:5] + [(H.Path.of("body", "footer"), "quite different", 1.0)]
    one, two = H.forward(p, *H.pad([make(page)]))[0][:, 0], H.forward(p, *H.pad([make(other)]))[0][:, 0]
    assert abs(one[0] - two[0]) > 1e-6


def test_held_out_accuracy():
    html = pq.read_table("/root/testdata/sf0.1/pages.parquet").column("html").to_pylist()
    p, make = H.train(html[:200]), H.Features()
    rest = [H.blocks(h) for h in html[1000:1300]]
    truth = np.concatenate([[H.silver(path) for path, _, _ in b] for b in rest])
    assert np.mean(np.concatenate(H.label(p, rest, make)) == truth) > 0.98
    # without what the tag path tells
    blind = [[(H.Path.of("html"), t, k) for _, t, k in b] for b in rest]
    assert np.mean(np.concatenate(H.label(p, blind, make)) == truth) > 0.8


def test_table(spark):
    body = "<article><p>some real words that go on for a while, with commas.</p></article>"
    rows = [(i, f"u{i}", f"<nav><li><a>menu</a></li></nav>{body}<footer>foot</footer>") for i in range(60)] + [(None, None, None), (100, "u", ""), (101, "u", body * 3000), (5, "u5", rows5 := "<p>twice</p>"), (5, "u5", rows5)]
    df = spark.createDataFrame([(*r, 9) for r in rows], KIND + ", text int")
    model = H.fit(df)
    out = H.extract(df, model).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert by[None].labels is None and by[None].text is None and by[None].n_blocks == 0
    assert by[100].labels == "" and by[100].text == "" and by[101].n_blocks == 3000 == len(by[101].labels)
    assert by[7].n_blocks == 3 and by[7].labels == "010" and by[7].text.startswith("some real words")
    assert H.extract(df.limit(0), H.fit(df.limit(0))).count() == 0
