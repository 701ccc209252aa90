"""Every operator and pipeline stage on tables whose other columns have the names that operators might use, and on ids of other types."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quillseek.llm import ann, chat, common, decontam, htmlblocks, langid, linededup, mixing, simhash, url_filter, warc

NAMES = (
    "__k1 __done __cut __cut_id __cut_key __mix_h __mix_250 __mix_src __leak_id __leak_key __near_id __near_key __near_gone __id a.b `q` k1 gone comp node print fid hash form pos template item width h src below tier "
    "cut_id cut_key cut_hash cut_spans cut_done near_id near_key near_gone leak_id leak_key mix_budget_h mix_budget_src mix_budget_250 d_id d_key removed_chunks_ copies first_id lang_ part data"
).split()
TEXT = "the quick brown fox jumps over the lazy dog and runs away from the house of the old man near the river"
LEAK = "which of these words would a benchmark item have if it were made of plain words alone"
ROWS = [("1", TEXT, "en", "s"), ("1", TEXT, "en", "s"), ("2", TEXT + " again", "en", "s"), ("3", f"{TEXT}\nother words of the document that nobody else has said so far\n{TEXT}", "en", "t"), ("4", None, None, None), ("5", "", "en", "t"), (None, LEAK + " or so", "en", "t"), ("7", "another thing entirely, which is of no use to the others and has not been seen", "en", "u")]


@pytest.fixture(scope="module")
def docs(spark):
    """By id type: documents with all of NAMES, whose values name their rows."""
    out = {}
    for kind in ("bigint", "string", "int", "date"):
        df = spark.createDataFrame([(*r, n) for n, r in enumerate(ROWS)], "doc_id string, text string, lang string, source string, n int")
        of = F.expr("date_add(date'2020-01-01', cast(doc_id as int))") if kind == "date" else F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("id-"), "doc_id")) if kind == "string" else F.col("doc_id").cast(kind)
        df = df.withColumn("doc_id", of)
        out[kind] = df.select("doc_id", "text", "lang", "source", F.length("text").alias("n_chars"), "n", *[F.col("n").alias(c) for c in NAMES])
    return out


def same(out, docs):
    """The extra columns are as they were."""
    assert out.columns[: len(docs.columns)] == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    rows = out.collect()
    assert all(r[c] == r["n"] for r in rows for c in NAMES)
    assert all(r["source"] == ROWS[r["n"]][3] and (r["doc_id"] is None) == (ROWS[r["n"]][0] is None) for r in rows)
    return sorted(r["n"] for r in rows)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_rows_stay_whole(spark, docs, kind):
    d = docs[kind]
    bench = spark.createDataFrame([("x", LEAK)], "item_id string, text string")
    assert same(langid.accept(d, langid.fit_profiles(d)), d) == [0, 1, 2, 3, 6, 7]
    cut = linededup.remove_repeats(d)
    assert same(cut, d) == list(range(8)) and {r["n"]: r["removed_chunks"] for r in cut.collect()}[3] > 0
    kept = same(simhash.keep_one(d), d)
    assert len(kept) < len(ROWS) and kept[-5:] == [3, 4, 5, 6, 7] or kept[-4:] == [4, 5, 6, 7]
    assert same(decontam.remove_leaks(d, bench), d) == [0, 1, 2, 3, 4, 5, 7]
    assert set(same(mixing.mix(d), d)) <= set(range(8))


@pytest.mark.parametrize("kind", ["bigint"])
def test_stages(spark, docs, kind, tmp_path):
    d = docs[kind]
    for name, stage in P.STAGES:
        out = stage(spark, d, "/root/testdata/sf0.001")
        assert same(out, d) is not None
        if name != "source_mix":
            assert out.columns == d.columns
        out.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        assert stage(spark, d.limit(0), "/root/testdata/sf0.001").count() == 0


@pytest.mark.parametrize("kind", ["string", "date"])
def test_results_have_the_ids(spark, docs, kind):
    d = docs[kind]
    ids, of = {r[0] for r in d.select("doc_id").collect()}, d.schema["doc_id"].dataType
    bench = spark.createDataFrame([(i, LEAK) for i in ("x", None)], "item_id string, text string")
    leaks = decontam.find_leaks(d, bench)
    assert {(r.doc_id, r.item_id) for r in leaks.collect()} == {(None, "x"), (None, None)}
    near = simhash.near_duplicates(d)
    found = langid.identify(d, langid.fit_profiles(d))
    assert near.schema["doc_id"].dataType == near.schema["duplicate_of"].dataType == found.schema["doc_id"].dataType == of
    assert {x for r in near.collect() for x in r} <= ids and {r.doc_id for r in found.collect()} == ids
    pages = d.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.com/"), "n").alias("url"), F.col("text").alias("html"), "hash", "data", "part", F.col("n").alias("block"), F.col("n").alias("bits"))
    whole = warc.distinct_pages(pages)
    assert whole.schema["page_id"].dataType == of and {r.page_id for r in whole.collect()} <= ids and whole.count() == 6
    labels = htmlblocks.extract(pages, htmlblocks.fit(pages))
    assert labels.schema["page_id"].dataType == of and {r.page_id for r in labels.collect()} == ids
    urls = url_filter.url_filter(pages, pages.filter("block = 1").select(F.col("url"), F.lit(1).alias("canonical")))
    assert urls.schema["page_id"].dataType == of and [r.page_id for r in urls.collect() if r.blocked] == [d.filter("n = 1").first().doc_id]
    chats = chat.format_chats(d.select(F.col("doc_id").alias("conv_id"), F.col("n").alias("turn"), F.col("lang").alias("role"), "text", "gone", "form"))
    assert chats.schema["conv_id"].dataType == of and {r.conv_id for r in chats.collect()} == ids
    vectors = d.select(F.col("doc_id").alias("vec_id"), F.expr("array(cast(n + 1 as float), 1f)").alias("embedding"), "node", "data", "part", "k1")
    assert {r.vec_id for r in ann.neighbours(vectors).collect()} == ids - {None}


def test_session_settings_are_left_alone(spark, docs):
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    linededup.remove_repeats(docs["bigint"]).count()
    simhash.keep_one(docs["bigint"]).count()
    assert spark.conf.get(conf) == before


def test_bitmap(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("k"))
    bits = common.bitmap(keys).value
    asked = [r.k for r in spark.range(30_000).select(F.xxhash64("id").alias("k")).collect()]
    hit = common.is_marked(bits, np.array(asked, np.int64))
    assert hit[:3000].all() and hit[3000:].mean() < 0.03
    assert not common.is_marked(common.bitmap(keys.limit(0)).value, np.array(asked, np.int64)).any()
