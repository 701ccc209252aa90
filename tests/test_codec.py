import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillseek.functions import codec

GOLDEN = {0: "00", 1: "01", 127: "7f", 128: "8100", 129: "8101", 16383: "ff7f", 16384: "818000", 2097152: "81808000", 3000000: "81b78d40", 268435456: "8180808000", 2415937952: "8980819320", 4294967295: "8fffffff7f"}


def test_python_golden():
    for n, want in GOLDEN.items():
        assert codec.encode([n]).hex() == want
        assert codec.decode(bytes.fromhex(want)) == ([n], len(want) // 2)


def test_expressions_golden(spark):
    df = spark.createDataFrame([(n,) for n in GOLDEN], "n bigint")
    for r in df.select("n", codec.varbyte_hex(F.col("n")).alias("h"), codec.varbyte_length(F.col("n")).alias("l")).collect():
        assert (r.h, r.l) == (GOLDEN[r.n], len(GOLDEN[r.n]) // 2)


@given(st.lists(st.integers(0, (1 << 32) - 1), max_size=50))
def test_round_trip(numbers):
    assert codec.decode(codec.encode(numbers))[0] == numbers


def test_expression_round_trip(spark):
    rows = [(1, [0, 128, 3000000]), (2, []), (3, list(GOLDEN)), (4, [2415937952])]
    df = spark.createDataFrame(rows, "k int, ns array<bigint>")
    got = {r.k: (bytes(r.b), r.back) for r in df.select("k", codec.varbyte_encode(F.col("ns")).alias("b")).select("k", "b", codec.varbyte_decode(F.col("b")).alias("back")).collect()}
    for k, ns in rows:
        assert got[k] == (codec.encode(ns), ns)


def test_unended_number_fails(spark):
    with pytest.raises(ValueError):
        codec.decode(b"\x81")
    with pytest.raises(ValueError):
        codec.encode([-1])
    with pytest.raises(Exception, match="ends within"):
        spark.range(1).select(codec.varbyte_decode(F.unhex(F.lit("0181")))).collect()
