import pytest

import corpus_pipeline as P
from quillseek.llm import decontam, langid, linededup, mixing, simhash

SF = "/root/testdata/sf0.001"
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int"


def rows(df, *cols):
    return sorted(map(str, df.select(*(cols or df.columns)).collect()))


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "x")
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_order():
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "source_mix"] and P.ORACLE_SQL is None


def test_each_stage_against_brute_force(spark, steps):
    (a, b), (_, c), (_, d), (_, e), (_, f) = steps
    ranker = langid.Ranker(langid.fit_profiles(a))
    text = {r.doc_id: r.text for r in a.collect()}
    assert {r.doc_id for r in b.collect()} == {i for i, t in text.items() if langid._accepted((s := ranker.score(t))[1], s[3])}
    from tests.llm.test_linededup import brute as lines_left

    left = lines_left([(r.doc_id, r.text) for r in b.collect()])
    want = {i: x for (i, t), x in left.items() if x.strip() or x == t}
    assert {r.doc_id: r.text for r in c.collect()} == want and all(r.n_chars == len(r.text) or text[r.doc_id] == r.text for r in c.collect())
    from tests.llm.test_simhash import brute_pairs, closure

    near = closure(brute_pairs([(r.doc_id, r.text) for r in c.collect()]))
    assert {r.doc_id for r in d.collect()} == {i for i in want if near.get(i, i) == i}
    plain = lambda t: " " + " ".join(decontam.tokens(t.lower())[0]) + " "
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in e.collect()}
    assert not [r.doc_id for r in d.collect() if r.doc_id in kept and any(i in plain(r.text) for i in items)] and len(kept) >= 0.8 * d.count()
    from tests.llm.test_mixing import brute as mixed

    want = mixed([(r.doc_id, r.text, r.source) for r in e.collect()], None, mixing.BUDGETS)
    assert sorted((r.doc_id, r.source, r.mix_budget) for r in f.collect()) == sorted(want)


def test_columns_and_run(spark, steps):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(out.columns == docs.columns and out.schema == docs.schema for _, out in steps[:-1])
    assert rows(P.run(spark, SF)) == rows(steps[-1][1])


def test_edge_cases(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog and runs away from the house of the old man near the river " * 3
    odd = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (2, text, "en", None, 5, 3), (2, text, "en", None, 5, 4), (3, text + "\n" + text, "en", "t", 6, 5), (4, "12 34", "en", "t", 5, 6), (5, text.upper() * 3000, "xx", "u", 7, 7)]
    for k, data in enumerate((odd, [])):
        docs = spark.createDataFrame(data, KIND)
        for name, stage in P.STAGES:
            path = str(tmp_path / f"{k}-{name}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            if name != "source_mix":
                assert docs.columns == [c.split()[0] for c in KIND.split(", ")]
        assert docs.count() <= len(data)


