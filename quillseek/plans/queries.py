"""The engine's operators as queries over the tables of a folder: (spark, folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codec, score
from ..functions.text import html_text, tokenize
from ..operators import blocks, invert, search, snippet
from ..operators.numbering import number
from ..operators.search import AND, OR
from ..shared import shared_dir, written
from ..sources import runs, trec
from ..sources.tables import html_documents, read_table, text_documents
from .engine import SearchIndex

#: Query words that the tables have in many documents, and one that they haven't.
COMMON, PAIR, MISSING = ("that", "is", "of"), ("that", "the"), "nosuchword"
PAGE_TERMS = ("that", "example")
#: Markup and the tokens of its visible text.
HTML_CASES = (
    ("<head><title>no</title><body>caf&#233; &eacute;t&#xe9;</body>", "café été"), ("<HEAD>a</HEAD><header>b</header ><p>c", "c"), ("x<!-- never ended <p>y</p>", "x"), ("a<!-- <script> -->b<script>no</script\n>c", "a b c"),
    ("<noscript>1<noscript>2</noscript>3</noscript>z", "z"), ("<header>1<header>2<header>3</header></header></header>k", "k"), ("<style>p{}", ""), ("q<script>if (a<b) x</script>r", "q r"), ("1 &lt; 2 &amp;lt; &amp;", "1 2 lt;"),
    ("&#0; &#xD800; &#1114112; &bogus; & &#;", "0; xd800; 1114112; bogus; ;"), ("&copy&copy;", "copy©"), ("<b>in</b>line<br>break", "in line break"), ("a < b > c", "a c"), ("<<p>>x", "x"), ("<a href='x'", "a href= x"),
    ("&frac12;&Alpha;&alpha;", "½αα"), ("&#128512;", "\U0001f600"), ("a&nbsp;b", "a\u00a0b"), ("<header-x>shown</header-x><headline>too</headline>", "shown too"), ("<nav>n</nav><textarea>t</textarea>", "n t"),
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def _posts(spark: SparkSession, folder: str) -> DataFrame:
    """All postings of the table documents, whose doc_id is its key."""
    return invert.postings(text_documents(spark, folder), unique=True)


def _ranked(spark: SparkSession, folder: str, terms, mode: str, scorer=score.bm25_linear, docs: DataFrame | None = None) -> DataFrame:
    docs = written(search.narrow(text_documents(spark, folder) if docs is None else docs, terms), "narrow")
    posts = search.matches(docs, terms)
    top = search.top_k(posts, invert.lexicon(posts), invert.stats(docs), terms, mode, 10, scorer)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*search.best_first())).cast("bigint"))


def _flat(top: DataFrame) -> DataFrame:
    return top.select("rank", "doc_id", "size", F.round("score", 6).alias("score"))


@query
def tokenize_documents(spark, folder):
    return invert.token_rows(text_documents(spark, folder))


@query
def html_text_tokens(spark, folder):
    return invert.token_rows(html_documents(spark, folder))


@query
def html_visible_text(spark, folder):
    return read_table(spark, folder, "pages").select("page_id", html_text(F.lower("html")).alias("text"))


@query
def postings(spark, folder):
    return _posts(spark, folder)


@query
def postings_sorted(spark, folder):
    """The order of runs: term, then document; the rank proves it."""
    return number(_posts(spark, folder), [F.col("term"), F.col("doc_id")], "place")


@query
def postings_merge_runs(spark, folder):
    """Four runs by id, of which two each have part of every document of the other half."""
    docs = text_documents(spark, folder)
    half = lambda keep: invert.postings(docs.withColumn("tokens", F.expr(f"filter(tokens, (t, i) -> i % 2 = {keep})")), unique=True)
    return invert.merge_runs(*[half(k).filter(F.col("doc_id") % 2 == r) for k in (0, 1) for r in (0, 1)])


@query
def lexicon_df(spark, folder):
    return invert.lexicon(_posts(spark, folder))


@query
def doc_sizes(spark, folder):
    return invert.sizes(text_documents(spark, folder))


@query
def corpus_stats(spark, folder):
    return invert.stats(text_documents(spark, folder))


@query
def term_ids(spark, folder):
    return invert.term_ids(text_documents(spark, folder), unique=True)


@query
def postings_with_term_ids(spark, folder):
    docs = text_documents(spark, folder)
    return invert.with_term_ids(invert.postings(docs, unique=True), invert.term_ids(docs, unique=True))


@query
def open_list(spark, folder):
    return search.open_list(search.matches(text_documents(spark, folder), ["that"]), "that").select("term", "doc_id", "freq")


@query
def next_geq(spark, folder):
    posts = search.matches(text_documents(spark, folder), ["that"])
    ask = lambda k: search.next_geq(posts, "that", k).select(F.lit(k).cast("bigint").alias("at_least"), "doc_id")
    return ask(0).unionByName(ask(100)).unionByName(ask(10**9))


@query
def get_freq(spark, folder):
    posts = search.matches(text_documents(spark, folder), ["that"])
    return posts.join(search.next_geq(posts, "that", 100), "doc_id").select("doc_id", "freq")


@query
def boolean_and(spark, folder):
    return search.boolean(search.matches(text_documents(spark, folder), PAIR), PAIR, AND)


@query
def boolean_or(spark, folder):
    return search.boolean(search.matches(text_documents(spark, folder), PAIR), PAIR, OR)


@query
def boolean_and_not(spark, folder):
    return search.without(search.matches(text_documents(spark, folder), PAIR), PAIR[:1], PAIR[1:])


@query
def boolean_missing(spark, folder):
    """AND with a word that no document has is empty; OR ignores it."""
    terms = [PAIR[0], MISSING]
    posts = search.matches(text_documents(spark, folder), terms)
    both = [search.boolean(posts, terms, m).groupBy().agg(F.count("*").alias("n")).select(F.lit(m).alias("mode"), "n") for m in (AND, OR)]
    return both[0].unionByName(both[1])


@query
def bm25_and_top10(spark, folder):
    return _flat(_ranked(spark, folder, COMMON, AND))


@query
def bm25_or_top10(spark, folder):
    return _flat(_ranked(spark, folder, COMMON, OR))


@query
def bm25_and_dup_terms(spark, folder):
    return _flat(_ranked(spark, folder, ["that", "of", "that"], AND))


@query
def bm25_or_dup_terms(spark, folder):
    return _flat(_ranked(spark, folder, ["that", "of", "that"], OR))


@query
def bm25_or_missing_term(spark, folder):
    return _flat(_ranked(spark, folder, ["that", MISSING], OR))


@query
def cosine_or_top10(spark, folder):
    return _flat(_ranked(spark, folder, COMMON, OR, score.cosine))


@query
def bm25_saturating_or_top10(spark, folder):
    return _flat(_ranked(spark, folder, COMMON, OR, score.bm25))


@query
def scores_all(spark, folder):
    """The score of every document that has a word of the query, without a limit."""
    docs = written(search.narrow(text_documents(spark, folder), COMMON), "narrow")
    posts = search.matches(docs, COMMON)
    rows = search.scored(posts, invert.lexicon(posts), invert.stats(docs), search.query_terms(spark, COMMON, OR))
    return search.totals(rows).select("doc_id", "size", F.round("score", 6).alias("score"), F.col("n_terms"))


@query
def topk_with_page(spark, folder):
    docs = html_documents(spark, folder)
    return search.with_pages(_ranked(spark, folder, PAGE_TERMS, OR, docs=docs), docs, "url").select("rank", "doc_id", "url", "size", F.round("score", 6).alias("score"))


@query
def result_freqs(spark, folder):
    return _ranked(spark, folder, COMMON, AND).select("rank", "doc_id", F.explode("query_freqs").alias("term", "freq"))


@query
def query_df(spark, folder):
    """What is told of each word before a search."""
    return invert.lexicon(search.matches(text_documents(spark, folder), COMMON))


@query
def batch_bm25(spark, folder):
    words = [(1, "that", OR), (1, "is", OR), (2, "that", AND), (2, "of", AND), (2, "that", AND), (3, "the", OR), (4, "the", AND), (4, MISSING, AND)]
    queries = spark.createDataFrame(words, "query_id bigint, term string, mode string")
    words = sorted({w for _, w, _ in words})
    docs = written(search.narrow(text_documents(spark, folder), words), "narrow")
    posts = search.matches(docs, words)
    top = search.batch(posts, invert.lexicon(posts), invert.stats(docs), queries)
    return top.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "size", F.round("score", 6).alias("score"))


@query
def sentences(spark, folder):
    return snippet.line_rows(text_documents(spark, folder)).select("doc_id", "idx", "line")


@query
def sentence_stats(spark, folder):
    return snippet.line_stats(text_documents(spark, folder))


@query
def sentence_scores(spark, folder):
    return snippet.scored_lines(text_documents(spark, folder), PAIR, exact=True).select("doc_id", "idx", F.round("score", 6).alias("score"))


@query
def best_sentence(spark, folder):
    return snippet.best_lines(text_documents(spark, folder), PAIR).select("doc_id", "best", "best_score")


@query
def snippet_window(spark, folder):
    return snippet.window_lines(text_documents(spark, folder), PAIR).select("doc_id", "idx")


@query
def snippet_text(spark, folder):
    return snippet.snippets(text_documents(spark, folder), PAIR)


@query
def search_with_snippets(spark, folder):
    """A whole search: rank, fetch the pages of the ten best, and make their snippets only."""
    docs = html_documents(spark, folder)
    found = search.with_pages(_ranked(spark, folder, PAGE_TERMS, OR, docs=docs), docs, "url", "body")
    shown = snippet.snippets(found.select("doc_id", "size", "body"), PAGE_TERMS)
    return found.join(shown, "doc_id").select("rank", "doc_id", "url", "snippet")


@query
def posting_chunks(spark, folder):
    return blocks.chunk_sizes(_posts(spark, folder))


@query
def posting_gaps(spark, folder):
    return blocks.chunked(_posts(spark, folder)).select("term", "doc_id", "chunk_id", "gap")


@query
def gap_decode(spark, folder):
    """Postings to blocks and back."""
    return blocks.unblock(blocks.blocks(_posts(spark, folder)))


@query
def block_payloads(spark, folder):
    return blocks.blocks(_posts(spark, folder)).select("term", "chunk_id", "n", "n_bytes", F.lower(F.hex("payload")).alias("payload"))


def _numbers(spark, folder):
    """Numbers of all byte lengths, from the sizes of the documents."""
    n = F.col("n_chars")
    return read_table(spark, folder, "documents").select("doc_id", F.explode(F.array(n, n * 37, n * 9973, n * 999_983 % (1 << 32), F.col("doc_id") % 3)).alias("n")).select("n").distinct()


@query
def varbyte_len(spark, folder):
    return _numbers(spark, folder).select("n", codec.varbyte_length(F.col("n")).alias("n_bytes"))


@query
def varbyte_encode(spark, folder):
    return _numbers(spark, folder).select("n", codec.varbyte_hex(F.col("n")).alias("code"))


@query
def varbyte_roundtrip(spark, folder):
    by = _numbers(spark, folder).groupBy((F.col("n") % 50).alias("part")).agg(F.array_sort(F.collect_list("n")).alias("ns"))
    return by.select("part", F.explode(codec.varbyte_decode(codec.varbyte_encode(F.col("ns")))).alias("n"))


@query
def lexicon_positions(spark, folder):
    return blocks.positions(_posts(spark, folder)).select("term", "df", "position", "next_position")


@query
def lexicon_sparse(spark, folder):
    return blocks.full_terms(invert.lexicon(_posts(spark, folder)))


@query
def lexicon_sparse_positions(spark, folder):
    return blocks.positions(_posts(spark, folder), sparse=True)


@query
def chunk_offsets(spark, folder):
    return blocks.chunk_offsets(blocks.chunk_sizes(_posts(spark, folder)))


@query
def page_lookup(spark, folder):
    return html_documents(spark, folder).filter("doc_id = 7").select("doc_id", "url", "size")


@query
def page_url(spark, folder):
    return html_documents(spark, folder).select("doc_id", "url")


@query
def page_body(spark, folder):
    return html_documents(spark, folder).filter("doc_id = 7").select("doc_id", "body")


@query
def page_count(spark, folder):
    return html_documents(spark, folder).agg(F.count("*").alias("n"))


@query
def docs_with_term(spark, folder):
    """Semi join: pages' sizes where a term occurs."""
    docs = html_documents(spark, folder)
    return docs.select("doc_id", "size").join(search.boolean(search.matches(docs, PAGE_TERMS[:1]), PAGE_TERMS[:1], OR), "doc_id", "left_semi")


@query
def html_cases(spark, folder):
    """Markup that isn't as it should be, and characters by number and name; the SQL has what is expected, written by hand."""
    rows = spark.createDataFrame(list(enumerate(h for h, _ in HTML_CASES)), "n bigint, html string")
    return rows.select("n", F.array_join(tokenize(html_text(F.lower("html"))), " ").alias("text"))


@query
def tokenize_by_space(spark, folder):
    """Another tokeniser in the place of the default one."""
    by_space = lambda c: F.filter(F.split(c, r"[ \n]"), lambda t: t != "")
    return invert.token_rows(invert.prepare(read_table(spark, folder, "documents"), "doc_id", "text", tokenizer=by_space))


@query
def parsed_query(spark, folder):
    """A line as it is typed: split at white space only, unless it is analysed as documents are."""
    line = "  Foo foo-bar\tthat  "
    rows = [(how, i, t) for how, terms in (("plain", search.parse_query(line)), ("analyzed", search.parse_query(line, analyze=True))) for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, "how string, place bigint, term string")


@query
def document_numbers(spark, folder):
    """Ids by order of place, dense, without pages that have no URL."""
    pages = read_table(spark, folder, "pages").filter("trim(url) <> '' and html is not null")
    return invert.number_documents(pages, F.col("url"), F.col("page_id")).select("page_id", "doc_id")


_BUILT: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, folder: str, kind: str) -> str:
    """Folder of a stored index of the tables documents or pages, built once in a session, in the folder that all executors share."""
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _BUILT:
        out = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        SearchIndex.build({"documents": text_documents, "pages": html_documents}[kind](spark, folder), out, with_blocks=True)
        _BUILT[key] = out
    return _BUILT[key]


def _index(spark: SparkSession, folder: str, kind: str = "documents") -> SearchIndex:
    return SearchIndex.load(spark, _stored(spark, folder, kind))


def _indexed_top(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    index = _index(spark, folder)
    top = search.top_k(index.postings, index.lexicon, index.stats, COMMON, mode, 10)
    return _flat(top.withColumn("rank", F.row_number().over(W.orderBy(*search.best_first())).cast("bigint")))


@query
def indexed_open_list(spark, folder):
    return search.open_list(_index(spark, folder).postings, "that").select("term", "doc_id", "freq")


@query
def indexed_next_geq(spark, folder):
    posts = _index(spark, folder).postings
    ask = lambda k: search.next_geq(posts, "that", k).select(F.lit(k).cast("bigint").alias("at_least"), "doc_id")
    return ask(0).unionByName(ask(100)).unionByName(ask(10**9))


@query
def indexed_boolean_and(spark, folder):
    return search.boolean(_index(spark, folder).postings, PAIR, AND)


@query
def indexed_bm25_and_top10(spark, folder):
    return _indexed_top(spark, folder, AND)


@query
def indexed_bm25_or_top10(spark, folder):
    return _indexed_top(spark, folder, OR)


@query
def indexed_batch_bm25(spark, folder):
    words = [(1, "that", OR), (1, "is", OR), (2, "that", AND), (2, "of", AND), (2, "that", AND), (3, "the", OR), (4, "the", AND), (4, MISSING, AND)]
    top = _index(spark, folder).batch(spark.createDataFrame(words, "query_id bigint, term string, mode string"))
    return top.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "size", F.round("score", 6).alias("score"))


@query
def indexed_search_with_snippets(spark, folder):
    """A whole search on the stored index: rank, fetch the pages of the ten best, and make their snippets only."""
    found = _index(spark, folder, "pages").search(list(PAGE_TERMS), OR)
    return found.withColumn("rank", F.row_number().over(W.orderBy(*search.best_first())).cast("bigint")).select("rank", "doc_id", "url", "snippet")


@query
def index_lexicon(spark, folder):
    """The lexicon as it is loaded from the stored index."""
    return _index(spark, folder).lexicon


@query
def index_pages(spark, folder):
    """The page table of the stored index."""
    return _index(spark, folder, "pages").docs


@query
def index_stats(spark, folder):
    return _index(spark, folder).stats


@query
def payload_decode(spark, folder):
    """The stored index's compressed bytes back to postings; nothing but the payloads is read."""
    return blocks.unpack(spark.read.parquet(f"{_stored(spark, folder, 'documents')}/blocks"))


@query
def payload_decode_fixed(spark, folder):
    """The same with another codec."""
    return blocks.unpack(blocks.blocks(_posts(spark, folder), codec.FIXED), codec.FIXED)


def _through_trec(spark: SparkSession, folder: str, utf16: bool) -> DataFrame:
    out = f"{shared_dir(spark)}/trec-{uuid.uuid4().hex}"
    trec.write_trec(read_table(spark, folder, "pages"), out, "page_id", "url", "html", utf16)
    return trec.read_trec(spark, out, utf16=utf16)


@query
def trec_documents(spark, folder):
    """Pages through TREC files, which are split among tasks."""
    return _through_trec(spark, folder, False)


@query
def trec_documents_utf16(spark, folder):
    return _through_trec(spark, folder, True)


def _small_posts(spark: SparkSession, folder: str) -> DataFrame:
    return search.matches(text_documents(spark, folder), COMMON).select("term", "doc_id", "freq")


@query
def runs_varbyte(spark, folder):
    """Postings through varbyte files."""
    return runs.read_runs(spark, runs.write_runs(_posts(spark, folder), f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"))


@query
def runs_merged(spark, folder):
    """Several run files of the same terms as one table; frequencies are summed."""
    posts = _small_posts(spark, folder)
    made = [runs.read_runs(spark, runs.write_runs(posts.filter(f"doc_id % 3 <= {k}"), f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}", 2)) for k in (0, 1)]
    return invert.merge_runs(*made)


@query
def runs_text(spark, folder):
    out = f"{shared_dir(spark)}/text-runs-{uuid.uuid4().hex}"
    runs.write_text_runs(_posts(spark, folder), out)
    return runs.read_text_runs(spark, out)


def _id_runs(spark: SparkSession, folder: str) -> str:
    out, docs = f"{shared_dir(spark)}/id-runs-{uuid.uuid4().hex}", text_documents(spark, folder)
    runs.write_id_runs(invert.postings(docs, unique=True), invert.term_ids(docs, unique=True), out)
    return out


@query
def runs_ids(spark, folder):
    return runs.read_id_runs(spark, _id_runs(spark, folder))


@query
def term_map(spark, folder):
    """The file that names the terms of id runs."""
    return spark.read.parquet(f"{_id_runs(spark, folder)}/terms")


@query
def varbyte_file(spark, folder):
    """Numbers of all byte lengths through a file."""
    rows = _numbers(spark, folder).select(F.lit("n").alias("term"), F.col("n").alias("doc_id"), (F.col("n") % 7 + 1).alias("freq"))
    return runs.read_runs(spark, runs.write_runs(rows, f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}", 1)).select(F.col("doc_id").alias("n"), "freq")
