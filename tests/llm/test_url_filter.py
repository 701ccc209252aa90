from pyspark.sql import functions as F

from quillseek.llm import url_filter as U

CASES = {
    "http://www.A.com/x/?b=2&utm_source=q&a=1#f": "a.com/x?a=1&b=2", "HTTPS://m.a.com:443//": "a.com", "a.com/X": "a.com/X", "http://a.com?ref=1": "a.com", "http://a.com?reference=1": "a.com?reference=1",
    "": None, "  ": None, None: None, "http://": None, "http://a.com:8080/p//": "a.com:8080/p", "http://a.com/?&&x": "a.com?x", "#only": None,
}


def test_canonical(spark):
    df = spark.createDataFrame(list(CASES.items()), "u string, want string")
    for r in df.select("*", U.canonical_url(F.col("u")).alias("c")).collect():
        assert r.c == r.want, r.u


def test_brute_force(spark):
    urls = [(i, f"http{'s' * (i % 2)}://{'www.' * (i % 3 == 0)}h{i % 400}.com/p{i % 7}/{'?utm_x=1' * (i % 5 == 0)}") for i in range(6000)] + [(None, None), (1, None), (2, ""), (3, "http://h1.com/p1"), (3, "http://h1.com/p1"), (9, "x" * 100_000)]
    listed = [(f"h{i}.com/p{i % 7}", "z") for i in range(0, 900)] + [(None, ""), ("", ""), ("h1.com/p1", ""), ("x" * 100_000, "")]
    pages = spark.createDataFrame([(*r, "c", 1, True) for r in urls], "page_id bigint, url string, canonical string, block int, maybe boolean")
    bad = spark.createDataFrame(listed, "url string, canonical string")
    out = U.url_filter(pages, bad).collect()
    block = {U_ for U_, _ in listed if U_}
    assert len(out) == len(urls)
    assert all(r.blocked == (r.canonical_url in block) for r in out)
    assert sum(r.blocked for r in out) > 500 and {r.page_id for r in out if r.page_id is None} == {None}


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("u"), "id").alias("canonical"))
    blocks = 128
    bloom = U.bloom_table(listed, blocks)
    ask = spark.range(30_000).select(F.concat(F.lit("u"), "id").alias("canonical"), "id").select("id", *U._marks(F.col("canonical"), blocks)).join(bloom, "block", "left")
    hit = ask.filter(" and ".join(f"(w{i} & {U._mask(i)}) <> 0" for i in range(8)))
    assert hit.filter("id < 3000").count() == 3000 and hit.filter("id >= 3000").count() < 27_000 * 0.02


def test_empty(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    some = spark.createDataFrame([(1, "http://a.com")], "page_id bigint, url string")
    assert U.url_filter(none, some).count() == 0
    assert [r.blocked for r in U.url_filter(some, none).collect()] == [False]
    assert [r.blocked for r in U.url_filter(some, some).collect()] == [True]
