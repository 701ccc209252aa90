"""Schemas of the engine's tables. All numbers are 64 bits; texts compare by bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_long, _text, _int = T.LongType(), T.StringType(), T.IntegerType()
DOCS = _of(doc_id=_long, url=_text, body=_text, size=_long)
POSTINGS = _of(term=_text, doc_id=_long, freq=_long, size=_long)
LEXICON = _of(term=_text, df=_long)
LEXICON_FULL = _of(term=_text, df=_long, position=_long, next_position=_long, is_full=T.BooleanType())
TERMS = _of(term=_text, term_id=_long)
BLOCKS = _of(term=_text, chunk_id=_long, last_doc_id=_long, n=_long, n_bytes=_long, gaps=T.ArrayType(_long), freqs=T.ArrayType(_long), payload=T.BinaryType())
RUN = _of(term=_text, doc_id=_long, freq=_long)


def check(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df``'s columns of ``schema`` in its order; raises if one is missing or of another type."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    wrong = [f"{f.name} {f.dataType.simpleString()} (found {have.get(f.name)})" for f in schema if have.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError("columns don't fit: " + ", ".join(wrong))
    return df.select(*schema.fieldNames())
