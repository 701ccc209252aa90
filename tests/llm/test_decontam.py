import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from quillseek.llm import common, decontam

ITEMS = [
    (1, "Alice has 12 apples and gives Bob 5 kg of pears. How many apples does Alice have after 12 days if Bob returns 5 kg?"), (2, "plain words that simply go on for a little while without any slot at all"),
    (3, "short item here now"), (4, None), (5, ""), (6, "3 4 5 6 7 8 9 10 11 12 13"), (2, "plain words that simply go on for a little while without any slot at all"),
]
REPARAM = "Well, Carol has 99 apples and gives Dave 7 kg of pears. How many apples does Carol have after 99 days if Dave returns 7 kg? Yes."
BROKEN = "Well, Carol has 99 apples and gives Dave 7 kg of pears. How many apples does Erin have after 11 days if Frank returns 8 kg? Yes."


def found(spark, docs, items=ITEMS, **how):
    d = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id bigint, text string, template string, hash bigint")
    b = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id bigint, text string, width int")
    return sorted(((r.doc_id, r.item_id, r.kind) for r in decontam.find_leaks(d, b, **how).collect()), key=str)


@pytest.mark.parametrize("bits", [common.MOST_BITS, 1 << 10])
def test_cases(spark, bits, monkeypatch):
    """With a bitmap that lets nearly all pass, too."""
    monkeypatch.setattr(common, "MOST_BITS", bits)
    docs = [
        (10, "before " * 30 + ITEMS[0][1] + " after" * 30), (11, REPARAM), (12, BROKEN), (13, "PLAIN!! WORDS!! THAT!! SIMPLY!! GO!! ON!! FOR!! A!! LITTLE!! WHILE!! WITHOUT!! ANY!! SLOT!! AT!! ALL!!"),
        (14, "Say: Plain Words that simply go on for a little while without any slot at all"), (15, "a short item here now and more"), (16, None), (17, ""), (18, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"),
        (19, "something else altogether, with Alice and 12 apples"), (None, ITEMS[1][1]), (20, "z " * 200_000 + ITEMS[1][1]), (20, "z " * 200_000 + ITEMS[1][1]), (21, "plain words that simply go on"),
    ]
    want = [(10, 1, "copy"), (11, 1, "reparameterised"), (13, 2, "copy"), (14, 2, "copy"), (15, 3, "copy"), (20, 2, "copy"), (None, 2, "copy")]
    assert found(spark, docs) == sorted(want, key=str)


def test_other_capitals(spark):
    title = "Alice Has 12 Apples And Gives Bob 5 Kg Of Pears. How Many Apples Does Alice Have After 12 Days If Bob Returns 5 Kg?"
    assert found(spark, [(1, ITEMS[0][1].upper()), (2, title), (3, ITEMS[0][1].lower())]) == [(1, 1, "copy"), (2, 1, "copy"), (3, 1, "copy")]


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [(1, "a b c")], []) == [] and found(spark, [], []) == []


def test_removal(spark):
    docs = spark.createDataFrame([(1, ITEMS[1][1], 5), (1, "another text", 6), (None, ITEMS[1][1], 7), (None, None, 8), (2, "fine", 9), (2, "fine", 9)], "doc_id bigint, text string, __x int")
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    out = decontam.remove_leaks(docs, bench)
    assert out.columns == docs.columns and sorted(r["__x"] for r in out.collect()) == [6, 8, 9, 9]


def test_passages_of_the_tables(spark):
    """Every document that has an item's words in a row is found, and no other."""
    docs, bench = (pq.read_table(f"/root/testdata/sf0.01/{t}.parquet").to_pylist() for t in ("documents", "benchmark"))
    plain = lambda t: " " + " ".join(decontam.tokens(t.lower())[0]) + " "
    items = {b["item_id"]: plain(b["text"]) for b in bench}
    want = {(d["doc_id"], i) for d in docs for x in [plain(d["text"])] for i, t in items.items() if t in x}
    folder = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in decontam.query(spark, folder).collect()}
    assert want and want <= got and len(got - want) <= 0.05 * len(want)


def test_items_of_almost_only_placeholders(spark):
    items = [(1, "What is 17 + 25?"), (2, "Convert 5 km to 5000 m."), (3, "Sort 9 8 7 6 5 4 3 2 1 0"), (4, "1 2 3 4 5 6 7 8 9 10"), (5, ITEMS[1][1])]
    docs = [
        (10, "Tell me. What is 17 + 25? It is 42."), (11, "what is 18 + 25? what is 17 or 25"), (12, "so CONVERT 5 KM TO 5000 M. Then"), (13, "convert 6 km to 6000 m"),
        (14, "please sort 9 8 7 6 5 4 3 2 1 0"), (15, "9 8 7 6 5 4 3 2 1 0"), (16, "1 2 3 4 5 6 7 8 9 10"), (17, ITEMS[1][1]),
    ]
    assert found(spark, docs, items) == [(10, 1, "copy"), (12, 2, "copy"), (14, 3, "copy"), (17, 5, "copy")]


def test_ids_keep_their_values(spark):
    """Negative and null item ids are told apart."""
    items = [(-5, ITEMS[0][1]), (-1, ITEMS[1][1]), (None, ITEMS[2][1])]
    docs = [(-7, ITEMS[0][1]), (-(2**62), ITEMS[1][1]), (3, "a short item here now and more")]
    assert found(spark, docs, items) == sorted([(-7, -5, "copy"), (-(2**62), -1, "copy"), (3, None, "copy")], key=str)


def test_reparameterised_against_brute_force(spark):
    """Items with their slots filled anew are found if the filling is one value for each value, and only then, by filling in every item."""
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("bal", "cor", "dim", "fen", "gol") for b in ("an", "ek", "ir", "os", "um")]
    people, items, docs, want = [x.title() for x in ("ann", "bert", "cleo", "dirk", "eve", "fred")], [], [], []
    for i in range(25):
        shape = [rng.choice([*words * 4, "#0", "#1", "@0", "@1"]) for _ in range(24)]
        shape[0] = words[i]
        fill = lambda nums, names, shape=shape: " ".join(nums[int(w[1])] if w[0] == "#" else names[int(w[1])] if w[0] == "@" else w for w in shape)
        apart = [w for k, w in enumerate(shape) if w[0] == "@" and k and shape[k - 1][0] == "@"]
        if apart:
            continue  # names in a row are one name
        items.append((i, fill(["17", "25"], ["Ann", "Bert"])))
        nums, names = rng.sample(["3", "44", "506", "8"], 2), rng.sample(people[2:], 2)
        docs.append((100 + i, "some words before it and " + fill(nums, names) + " and others after"))
        want.append((100 + i, i, "reparameterised" if any(w[0] in "#@" for w in shape) else "copy"))
    assert len(items) > 10
    got = found(spark, docs, items)
    assert got == sorted(want, key=str)


ODD = ["5", "12.5", "1/2", "km", "KM", "Km", "$", "%", "€", "°", ".", "!", "\n", ":", "Alice", "alice", "Bob", "NASA", "word", "the", "I", "X2", "2x", "²", "٣", "İstanbul", "ß", "ǅ", "_", "-", "Éa", "Days", "s", "", "̇", "ⅷ", "5km", "日本", "Σ", "ΑΣ", "ΑΣ.Α", "K", "Ⓐ"]


@pytest.mark.parametrize("names", [frozenset(), frozenset({"alice", "word", "km", "x2"})])
def test_templates_are_those_of_tokens(names):
    """The quick look at many texts sees the tokens of forms(), whatever is in the texts and beside them."""
    rng, quick, hashes = random.Random(4), decontam.Templates(names), decontam._Hashes()
    for _ in range(100):
        texts = ["".join(rng.choice(ODD) + rng.choice("  ") * rng.randint(0, 1) for _ in range(rng.randint(0, 30))) for _ in range(30)]
        got = {form: (h, at) for form, h, at in quick(texts)}
        for k, text in enumerate(texts):
            want = decontam.forms(text, names)
            assert all(hashes.of(toks).tolist() == got[form][0][got[form][1] == k].tolist() for form, toks, _ in want), text
            assert len(want) == 2 or not (got.get(1, (0, np.empty(0)))[1] == k).any()


def test_windows_do_not_run_from_text_to_text():
    texts = ["one two three four", "five six seven eight", "", "zero one two three four five six seven eight"]
    (_, h, at), hashes = next(decontam.Templates()(texts)), decontam._Hashes()
    want = decontam.window_hashes(hashes.of(" ".join(texts[:2]).split()), 8).view(np.int64)
    assert decontam.having(h, at, [8], lambda x: np.isin(x, want)) == {3}
    assert decontam.having(h[:5], at[:5], [8], lambda x: np.ones(len(x), bool)) == set()


def test_few_windows_pass_by_chance(spark, monkeypatch):
    """What is written of texts without any window of the benchmark: one in a hundred of their windows with 16 bits a hash."""
    tables, keep = {}, decontam.written
    monkeypatch.setattr(decontam, "written", lambda df, label: tables.setdefault(label, keep(df, label)))
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    docs = [(i, text(500)) for i in range(100)]
    assert found(spark, [*docs, (100, docs[0][1])], [(i, text(60)) for i in range(100)]) == []
    assert tables["benchmark-windows"].count() == 5300 and tables["benchmark-hits"].count() <= 5
