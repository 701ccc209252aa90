"""python -m quillseek.cli build|search|shell: an index from files, and queries against it."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .functions.score import SCORERS
from .operators.invert import prepare
from .operators.search import TermNotFound
from .plans.engine import SearchIndex
from .sources.trec import read_trec


def answer(index: SearchIndex, line: str, mode: str, k: int, scorer: str) -> None:
    for r in index.search(line, mode, k, scorer).collect():
        counts = ", ".join(f"{t}: {n}" for t, n in sorted(r["query_freqs"].items()))
        print(f"{r['doc_id']}  {r['url']}\nscore {r['score']:.6f}; {counts}\n{r['snippet'] or ''}")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillseek")
    sub = p.add_subparsers(dest="what", required=True)
    b = sub.add_parser("build", help="index TREC files or a Parquet table")
    b.add_argument("folder")
    b.add_argument("paths", nargs="+")
    b.add_argument("--utf16", action="store_true")
    b.add_argument("--parquet", metavar="ID,TEXT[,URL]", help="the paths are Parquet with these columns")
    b.add_argument("--full-lexicon", action="store_true")
    b.add_argument("--blocks", action="store_true")
    for name in ("search", "shell"):
        s = sub.add_parser(name)
        s.add_argument("folder")
        s.add_argument("--k", type=int, default=10)
        s.add_argument("--scorer", choices=sorted(SCORERS), default="bm25_linear")
        if name == "search":
            s.add_argument("mode", choices=("c", "d"))
            s.add_argument("terms", nargs="+")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.what == "build":
        if a.parquet:
            cols = a.parquet.split(",")
            docs = prepare(spark.read.parquet(*a.paths), *cols, html=len(cols) > 2)
        else:
            docs = prepare(read_trec(spark, *a.paths, utf16=a.utf16), "doc_id", "html", "url", html=True)
        SearchIndex.build(docs, a.folder, sparse=not a.full_lexicon, with_blocks=a.blocks)
        return 0
    index = SearchIndex.load(spark, a.folder).persist()
    if a.what == "search":
        answer(index, " ".join(a.terms), a.mode, a.k, a.scorer)
        return 0
    for line in sys.stdin:  # a query, then c for all its terms or d for any
        if not line.strip():
            continue
        mode = next(sys.stdin, "").strip()
        if mode not in ("c", "d"):
            print("wrong input")
            continue
        try:
            answer(index, line, mode, a.k, a.scorer)
        except TermNotFound as e:
            print(f"term not found: {e}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
