import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from quillseek.llm import langid

KIND = "doc_id bigint, text string, lang string"


def brute_grams(text):
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        out.update(word)
    padded = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    out.update(padded[i : i + 2] for i in range(len(padded) - 1))
    out.update(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " ")
    return out


def code(gram):
    n = 0
    for c in gram:
        n = n << 21 | ord(c)
    return n


@pytest.mark.parametrize("text", ["Ab, ab! c", "été à l'île 12 x_y", "  ", "", "a", "über " * 50])
def test_grams(text):
    want = {code(g): n for g, n in brute_grams(text).items()} if re.search(r"[^\W\d_]", text) else {}
    grams, n = np.unique(langid._codes(text), return_counts=True)
    assert dict(zip(grams.tolist(), n.tolist())) == want
    if want:
        best = sorted(want.items(), key=lambda x: (-x[1], x[0]))[: langid.PROFILE]
        assert list(zip(*(a.tolist() for a in langid.top_grams(langid._codes(text))))) == best


def test_out_of_place_distance():
    profiles = {"x": [code("a"), code("b"), code("ab")], "y": [code("z")]}
    lang, far, margin, n = langid.Ranker(profiles).score("ab")
    own = [g for g, _ in sorted(((code(g), c) for g, c in brute_grams("ab").items()), key=lambda x: (-x[1], x[0]))]
    want = sum(abs(i - profiles["x"].index(g)) if g in profiles["x"] else langid.PROFILE for i, g in enumerate(own)) / (langid.PROFILE * len(own))
    assert (lang, n) == ("x", len(own)) and far == pytest.approx(want) and margin == pytest.approx(1 - want)


def test_held_out_accuracy(spark):
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows], KIND)
    profiles = langid.fit_profiles(docs.filter("doc_id % 2 = 0"))
    out = langid.identify(docs.filter("doc_id % 2 = 1"), profiles).collect()
    assert np.mean([r.declared == r.language for r in out]) > 0.97
    assert np.mean([r.accepted for r in out]) > 0.99
    assert langid.accept(docs.filter("doc_id % 2 = 1"), profiles).count() == sum(r.accepted for r in out)


def test_edge_cases(spark):
    base = [(i, "the quick brown fox and the dog of the house " * 5, "en") for i in range(5)] + [(10 + i, "der schnelle braune fuchs und der hund des hauses " * 5, "de") for i in range(5)]
    odd = [(None, None, None), (20, "", "en"), (21, "12 34 !!", "en"), (22, "the", None), (23, "漢字" * 400, "xx"), (24, "the house of the dog " * 50_000, "de"), (24, "the house of the dog " * 50_000, "de")]
    docs = spark.createDataFrame([(*r, 1, "q") for r in base + odd], KIND + ", gram int, language string")
    profiles = langid.fit_profiles(docs.filter("doc_id < 20"))
    out = [(r.doc_id, r.language, r.accepted) for r in langid.identify(docs, profiles).collect()]
    assert (None, None, False) in out and (20, None, False) in out and (21, None, False) in out and (22, "en", True) in out
    assert out.count((24, "en", True)) == 2 and [a for i, _, a in out if i == 23] == [False] and len(out) == 17
    kept = langid.accept(docs, profiles)
    assert kept.columns == docs.columns and kept.count() == 13
    assert langid.fit_profiles(docs.limit(0)) == {} and langid.identify(docs.limit(0), {}).count() == 0
    assert {r.accepted for r in langid.identify(docs.filter("doc_id < 20"), {}).collect()} == {True}
