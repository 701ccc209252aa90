import time

import pytest
from pyspark.sql import functions as F

from quillseek.functions.text import html_text, html_text_full, lines, tokenize


def toks(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(tokenize(F.col("t"))).collect()]


def test_tokenizer(spark):
    a, b, c, d, e, f = toks(spark, "foo-bar baz_qux x=1;y naïve", "http://d.io/w", "a" * 30 + " " + "b" * 31, "é" * 16 + " é", "", None)
    assert a == ["foo", "bar", "baz", "qux", "x=1;y", "naïve"]
    assert b == ["http", "d", "io", "w"]
    assert c == ["a" * 30] and d == ["é"] and e == [] and f is None


def test_every_delimiter(spark):
    marks = " @#$%^&*<>`:.,?!()/\\+-_[]{}\"'\r\n\t"
    assert toks(spark, "x" + "x".join(marks) + "x") == [["x"] * (len(marks) + 1)]
    assert toks(spark, "a=b;c~d|e") == [["a=b;c~d|e"]]


def test_html(spark):
    cases = {
        "<b>ab</b>cd": "ab cd", "<head><title>t</title></head><nav>n</nav><script>s</script><p>p</p>": "n p", "a<!-- c -->b": "a b",
        "<header>x</header>y<noscript>z</noscript>": "y", "<textarea>k</textarea>": "k", "x &lt;y&gt; &amp;amp;": "x y amp;", "<p\nclass='a'>q": "q",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "h string, want string")
    for r in df.select("*", tokenize(html_text(F.col("h"))).alias("a"), tokenize(html_text_full(F.col("h"))).alias("b")).collect():
        assert " ".join(r.a) == " ".join(r.b) == r.want, r.h


@pytest.mark.parametrize("part", ["<!--", "<a ", "<script>", "<script ", "<noscript>", "</head ", "<head>", "<", "&", "&#", "<header><header>x</header>", "<noscript ", "-->"])
def test_time_is_linear(spark, part):
    """A megabyte of any broken markup; a quadratic search would take minutes to hours."""
    df = spark.createDataFrame([(part, 1_000_000 // len(part))], "p string, n int").repartition(1).select(html_text(F.repeat("p", F.col("n"))).alias("t"))
    began = time.time()
    df.select(F.sum(F.length("t"))).collect()
    assert time.time() - began < 20


def test_full_parser_handles_what_expressions_do_not(spark):
    df = spark.createDataFrame([("<head><title>t<body>x &eacute;",)], "h string")
    assert df.select(tokenize(html_text_full(F.col("h")))).first()[0] == ["x", "é"]


def test_lines(spark):
    df = spark.createDataFrame([("a\r\n\n b\rc",), ("",)], "t string")
    assert [r[0] for r in df.select(lines(F.col("t"))).collect()] == [["a", " b", "c"], []]
