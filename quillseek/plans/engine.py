"""SearchIndex: the stored tables of a collection, and search over them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import VARBYTE, Codec
from ..functions.score import SCORERS, Scorer, bm25_linear
from ..functions.text import html_text
from ..operators import blocks, invert, search, snippet
from ..schemas import DOCS, LEXICON_FULL, POSTINGS, check
from ..shared import parts, small


@dataclass
class SearchIndex:
    """docs, postings (with sizes), lexicon and stats. load() reads what build() wrote."""

    docs: DataFrame
    postings: DataFrame
    lexicon: DataFrame
    stats: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, folder: str, sparse: bool = True, with_blocks: bool = False, codec: Codec = VARBYTE) -> SearchIndex:
        """Write the tables of prepare()'s ``docs`` and load them.

        Postings are partitioned by ranges of terms and sorted by (term, doc_id)
        in their files, so that a query's filter skips files and row groups by
        their least and greatest terms. Documents are tokenised once, for the
        page table, which keeps each one's sorted tokens beside it; every later
        table is made from a written one. If no id repeats, as in a primary
        key, tokens are counted within rows. Blocks in varbyte tell the lexicon
        their sizes.
        """
        spark = docs.sparkSession
        docs.select(*DOCS.fieldNames(), F.sort_array("tokens").alias("tokens")).write.parquet(f"{folder}/docs")
        pages = spark.read.parquet(f"{folder}/docs")
        repeats = pages.groupBy("doc_id").count().filter("count > 1")
        posts = invert.postings(pages, with_size=True, unique=repeats.isEmpty())
        posts.repartitionByRange(parts(posts), "term", "doc_id").sortWithinPartitions("term", "doc_id").write.option("parquet.bloom.filter.enabled#term", "true").parquet(f"{folder}/postings")
        stored, chunks = spark.read.parquet(f"{folder}/postings"), None
        if with_blocks:
            blocks.blocks(stored, codec).write.parquet(f"{folder}/blocks")  # a task's terms in order
            chunks = spark.read.parquet(f"{folder}/blocks").select("term", "chunk_id", "last_doc_id", "n", "n_bytes") if codec is VARBYTE else None
        blocks.positions(stored, sparse, chunks).sortWithinPartitions("term").write.parquet(f"{folder}/lexicon")
        invert.stats(pages).write.parquet(f"{folder}/stats")
        return cls.load(spark, folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> SearchIndex:
        read = lambda name, schema: check(spark.read.parquet(f"{folder}/{name}"), schema)
        return cls(read("docs", DOCS), read("postings", POSTINGS), read("lexicon", LEXICON_FULL), spark.read.parquet(f"{folder}/stats"))

    @classmethod
    def of(cls, docs: DataFrame) -> SearchIndex:
        """An index that isn't stored; every search computes what it needs."""
        posts = invert.postings(docs, with_size=True)
        return cls(docs.select(*DOCS.fieldNames()), posts, invert.lexicon(posts), invert.stats(docs))

    def search(self, query: str | Sequence[str], mode: str = search.OR, k: int = 10, scorer: str | Scorer = bm25_linear, strict: bool = False, analyze: bool = False, snippets: bool = True, exact: bool = False, text_snippet: bool = False) -> DataFrame:
        """(doc_id, url, size, score, query_freqs, snippet) of the k best documents, best first.

        Bodies are read for these k documents only. ``text_snippet`` makes
        snippets of the visible text instead of the page as it is.
        """
        terms = search.parse_query(query, analyze) if isinstance(query, str) else list(query)
        how = SCORERS[scorer] if isinstance(scorer, str) else scorer
        top = search.top_k(self.postings, self.lexicon, self.stats, terms, mode, k, how, strict)
        if not terms:
            return top.join(self.docs.select("doc_id", "url"), "doc_id").withColumn("snippet", F.lit(""))
        found = search.with_pages(top, self.docs, "url", "body")
        if text_snippet:
            found = found.withColumn("body", html_text(F.col("body")))
        if snippets:
            found = found.join(snippet.snippets(found.select("doc_id", "size", "body"), terms, exact), "doc_id", "left")
        return found.drop("body").orderBy(*search.best_first())

    def batch(self, queries: DataFrame, k: int = 10, scorer: Scorer = bm25_linear) -> DataFrame:
        words = small(queries.select("term").distinct())
        return search.batch(self.postings.join(words, "term", "left_semi"), self.lexicon.join(words, "term", "left_semi"), self.stats, queries, k, scorer)

    def page(self, doc_id: int) -> DataFrame:
        return self.docs.filter(F.col("doc_id") == doc_id)

    def persist(self) -> SearchIndex:
        """Keep the lexicon and sizes in memory for many queries."""
        self.lexicon.persist()
        self.stats.persist()
        return self

    def unpersist(self) -> SearchIndex:
        self.lexicon.unpersist()
        self.stats.unpersist()
        return self
