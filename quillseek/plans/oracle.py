"""The queries of plans.queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from ..functions.text import ENTITIES, HIDDEN
from .queries import COMMON, HTML_CASES, MISSING, PAGE_TERMS, PAIR

_RX = r"""[ @#$%^&*<>`:.,?!()/\\+\-_\[\]{}"''\r\n\t]"""


def _tokens(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_RX}'), lambda t: strlen(t) between 1 and 30)"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _html(text: str) -> str:
    """By splitting at "<" and "&", where the engine replaces; bound to a name at each step, so that the text stays short."""
    steps = ["regexp_replace(regexp_replace(t, '<!--.*?-->', ' ', 'gs'), '<!--.*', ' ', 's')"]
    for tag in HIDDEN:
        opened = rf"<{tag}(\s[^<>]*)?>"
        steps.append(rf"regexp_replace(t, '{opened}.*?</{tag}\s*>', ' ', 'gs')")
        if tag == "head":
            steps.append(rf"regexp_replace(t, '{opened}.*?(<body[\s>])', ' \2', 's')")
        steps.append(rf"regexp_replace(t, '{opened}.*', ' ', 's')")
    steps.append("array_to_string(list_transform(string_split(t, '<'), lambda p, i: case when i = 1 then p when contains(p, '>') then ' ' || substr(p, strpos(p, '>') + 1) else '<' || p end), '')")
    names = "map([" + ", ".join(map(_quote, ENTITIES)) + "], [" + ", ".join(map(_quote, ENTITIES.values())) + "])"
    code = "try_cast(case when lower(ref[:2]) = '#x' then '0x' || replace(ref[3:], ';', '') when ref[1] = '#' then replace(ref[2:], ';', '') end as bigint)"
    known = f"case when {code} between 1 and 55295 or {code} between 57344 and 1114111 then chr(cast({code} as integer)) when ref[1] <> '#' then {names}[replace(ref, ';', '')] end"
    piece = f"list_transform([regexp_extract(p, '^(#[0-9]{{1,7}};?|#[xX][0-9a-fA-F]{{1,6}};?|[a-zA-Z][a-zA-Z0-9]{{1,31}};)', 1)], lambda ref: coalesce({known} || p[len(ref) + 1:], '&' || p))[1]"
    steps.append(f"case when contains(t, '&') then array_to_string(list_transform(string_split(t, '&'), lambda p, i: case when i = 1 then p else {piece} end), '') else t end")
    out = f"[{text}]"
    for step in steps:
        out = f"list_transform({out}, lambda t: {step})"
    return f"({out})[1]"


def _in(terms) -> str:
    return "(" + ", ".join(f"'{t}'" for t in sorted(set(terms))) + ")"


DOCS = f"docs as (select doc_id, body, {_tokens('body')} as tokens from (select doc_id, lower(text) as body from documents where text is not null))"
PAGES = f"docs as (select doc_id, url, body, {_tokens(_html('body'))} as tokens from (select page_id as doc_id, trim(url) as url, lower(trim(url) || ' ' || html) as body from pages where trim(url) <> '' and html is not null))"
TOK = "tok as (select doc_id, cast(unnest(range(len(tokens))) as bigint) as pos, unnest(tokens) as term from docs)"
POST = "post as (select term, doc_id, cast(count(*) as bigint) as freq from tok group by all)"
LEX = "lex as (select term, cast(count(*) as bigint) as df from post group by term)"
SIZES = "sizes as (select doc_id, cast(len(tokens) as bigint) as size from docs)"
STATS = "stats as (select (select cast(count(*) as bigint) from docs) as n, (select cast(floor(avg(size)) as bigint) from (select size from sizes order by doc_id limit 10000)) as davg)"


def _with(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


BASE, FULL = _with(DOCS, TOK, POST), (DOCS, TOK, POST, LEX, SIZES, STATS)
_LINEAR = "log10((n - df + 0.5) / (df + 0.5)) * 2.2 * freq / (1.2 * (0.25 + 0.75 * size / davg))"
_COSINE = "ln(1 + n / df) * (1 + ln(freq)) / sqrt(davg)"
_BM25 = "ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * freq / (freq + 1.2 * (0.25 + 0.75 * size / davg))"


def _totals(terms, mode: str, formula: str = _LINEAR) -> str:
    counts = {t: list(terms).count(t) if mode == "c" else 1 for t in terms}
    values = ", ".join(f"('{t}', {c})" for t, c in counts.items())
    having = f"having count(*) = {len(counts)}" if mode == "c" else ""
    return f"""tot as (select doc_id, any_value(size) as size, round(sum(qtf * {formula}), 9) as s, cast(count(*) as bigint) as n_terms
      from post join (values {values}) q(term, qtf) using (term) join lex using (term) join sizes using (doc_id) cross join stats group by doc_id {having})"""


_TOP = "top as (select cast(row_number() over (order by s desc, size desc, doc_id) as bigint) as rank, * from tot qualify rank <= 10)"


def _top(terms, mode: str, formula: str = _LINEAR, docs: str = DOCS, select: str = "select rank, doc_id, size, round(s, 6) as score from top") -> str:
    return _with(docs, *FULL[1:], _totals(terms, mode, formula), _TOP) + select


_LINES = r"""lines as (select doc_id, size, cast(unnest(range(len(l))) as bigint) as idx, unnest(l) as line
  from (select doc_id, cast(len(tokens) as bigint) as size, list_filter(string_split_regex(body, '[\r\n]'), lambda x: x <> '') as l from docs))"""


def _scored(terms) -> tuple[str, ...]:
    f = ", ".join(f"len(list_filter(t, lambda x: x = '{t}')) as f{i}" for i, t in enumerate(sorted(set(terms))))
    n = len(set(terms))
    df = ", ".join(f"sum(case when f{i} > 0 then 1 else 0 end) over (partition by doc_id) as df{i}" for i in range(n))
    one = lambda i: f"case when f{i} > 0 and size - df{i} + 0.5 > 0 then log10((size - df{i} + 0.5) / (df{i} + 0.5)) * 2.2 * f{i} / (1.2 * (0.25 + 0.75 * d / mean)) else 0 end"
    return (
        f"a as (select *, {_tokens('line')} as t, strlen(line) as d from lines)", f"b as (select *, {f} from a)",
        f"c as (select *, count(*) over (partition by doc_id) as n_lines, floor(sum(d) over (partition by doc_id) / count(*) over (partition by doc_id)) as mean, {df} from b)",
        f"sc as (select doc_id, idx, line, n_lines, round({' + '.join(one(i) for i in range(n))}, 9) as exact from c)",
        "cut as (select *, cast(greatest(floor(exact), 0) as bigint) as score from sc)",
        "best as (select doc_id, idx as best, score as best_score, n_lines from cut qualify row_number() over (partition by doc_id order by score desc, idx desc) = 1)",
        "win as (select cut.doc_id, idx, line from cut join best using (doc_id) where idx between greatest(0, least(best - 2, best.n_lines - 5)) and greatest(0, least(best - 2, best.n_lines - 5)) + 4)",
    )


_SNIPPET = r"select doc_id, string_agg(line, chr(13) || chr(10) order by idx) || chr(13) || chr(10) as snippet from win group by doc_id"
_LEN = lambda x: f"(case when {x} < 128 then 1 when {x} < 16384 then 2 when {x} < 2097152 then 3 when {x} < 268435456 then 4 else 5 end)"
_CHUNKED = (
    "num as (select *, (row_number() over (partition by term order by doc_id) - 1) // 128 as chunk_id from post)",
    "gaps as (select term, doc_id, freq, cast(chunk_id as bigint) as chunk_id, doc_id - coalesce(lag(doc_id) over (partition by term, chunk_id order by doc_id), 0) as gap from num)",
    f"sizes_ as (select term, chunk_id, max(doc_id) as last_doc_id, cast(count(*) as bigint) as n, cast(sum({_LEN('gap')} + {_LEN('freq')}) as bigint) as n_bytes from gaps group by all)",
)
_ENTRY = f"entry as (select term, cast(sum(n) as bigint) as df, {_LEN('count(*)')} + sum({_LEN('last_doc_id')} + {_LEN('n_bytes')} + n_bytes) as bytes from sizes_ group by term)"
_FULL = """seg as (select term, df, sum(case when df > 50 then 1 else 0 end) over (order by term) as segment from lex),
arr as (select segment, list({'term': term, 'df': df} order by term) as ts from seg group by segment),
fold as (select ts, list_reduce(list_transform(ts, lambda x: {'s': cast(x.df as bigint), 'f': cast([] as boolean[])}),
  lambda a, x: {'s': case when x.s > 50 or a.s > 500 then cast(0 as bigint) else a.s + x.s end, 'f': list_append(a.f, x.s > 50 or a.s > 500)},
  {'s': cast(case when segment = 0 then 501 else 0 end as bigint), 'f': cast([] as boolean[])}).f as fs from arr),
full_ as (select unnest(ts).term as term, unnest(ts).df as df, unnest(fs) as is_full from fold)"""
_NUMBERS = """nums as (select distinct n from (select unnest([n_chars, n_chars * 37, n_chars * 9973, n_chars * 999983 % 4294967296, doc_id % 3]) as n from documents))"""


def _code(n: str) -> str:
    byte = lambda k, high: f"lower(lpad(to_hex({n} // {1 << (7 * k)} % 128 + {high}), 2, '0'))"
    forms = [" || ".join(byte(k, 128 if k else 0) for k in range(m, -1, -1)) for m in range(5)]
    return "case " + " ".join(f"when {n} < {1 << (7 * (m + 1))} then {forms[m]}" for m in range(4)) + f" else {forms[4]} end"


SQL: dict[str, str] = {
    "tokenize_documents": _with(DOCS, TOK) + "select * from tok",
    "html_text_tokens": _with(PAGES, TOK) + "select * from tok",
    "html_visible_text": f"select page_id, {_html('lower(html)')} as text from pages",
    "postings": BASE + "select term, doc_id, freq from post",
    "postings_sorted": BASE + "select term, doc_id, freq, cast(row_number() over (order by term, doc_id) as bigint) as place from post",
    "postings_merge_runs": BASE + "select term, doc_id, freq from post",
    "lexicon_df": _with(DOCS, TOK, POST, LEX) + "select * from lex",
    "doc_sizes": _with(DOCS, SIZES) + "select * from sizes",
    "corpus_stats": _with(DOCS, SIZES, STATS) + "select * from stats",
    "term_ids": _with(DOCS, TOK) + "select term, cast(row_number() over (order by d, p) as bigint) as term_id from (select term, min(doc_id) as d, arg_min(pos, (doc_id, pos)) as p from tok group by term)",
    "postings_with_term_ids": _with(DOCS, TOK, POST, "ids as (select term, cast(row_number() over (order by d, p) as bigint) as term_id from (select term, min(doc_id) as d, arg_min(pos, (doc_id, pos)) as p from tok group by term))")
    + "select term_id, doc_id, freq from post join ids using (term)",
    "open_list": BASE + "select term, doc_id, freq from post where term = 'that'",
    "next_geq": BASE + "select cast(k as bigint) as at_least, coalesce((select min(doc_id) from post where term = 'that' and doc_id >= k), 4294967295) as doc_id from (values (0), (100), (1000000000)) v(k)",
    "get_freq": BASE + "select doc_id, freq from post where term = 'that' and doc_id = (select min(doc_id) from post where term = 'that' and doc_id >= 100)",
    "boolean_and": BASE + f"select doc_id from post where term = '{PAIR[0]}' intersect select doc_id from post where term = '{PAIR[1]}'",
    "boolean_or": BASE + f"select doc_id from post where term = '{PAIR[0]}' union select doc_id from post where term = '{PAIR[1]}'",
    "boolean_and_not": BASE + f"select doc_id from post where term = '{PAIR[0]}' except select doc_id from post where term = '{PAIR[1]}'",
    "boolean_missing": BASE + f"select 'c' as mode, cast(count(*) as bigint) as n from (select doc_id from post where term = '{PAIR[0]}' intersect select doc_id from post where term = '{MISSING}') "
    f"union all select 'd', cast(count(*) as bigint) from (select doc_id from post where term = '{PAIR[0]}' union select doc_id from post where term = '{MISSING}')",
    "bm25_and_top10": _top(COMMON, "c"),
    "bm25_or_top10": _top(COMMON, "d"),
    "bm25_and_dup_terms": _top(["that", "of", "that"], "c"),
    "bm25_or_dup_terms": _top(["that", "of", "that"], "d"),
    "bm25_or_missing_term": _top(["that", MISSING], "d"),
    "cosine_or_top10": _top(COMMON, "d", _COSINE),
    "bm25_saturating_or_top10": _top(COMMON, "d", _BM25),
    "scores_all": _with(*FULL, _totals(COMMON, "d")) + "select doc_id, size, round(s, 6) as score, n_terms from tot",
    "topk_with_page": _top(PAGE_TERMS, "d", docs=PAGES, select="select rank, doc_id, url, size, round(s, 6) as score from top join (select doc_id, url from docs) using (doc_id)"),
    "result_freqs": _top(COMMON, "c", select=f"select rank, doc_id, term, freq from top join post using (doc_id) where term in {_in(COMMON)}"),
    "query_df": _with(DOCS, TOK, POST, LEX) + f"select term, df from lex where term in {_in(COMMON)}",
    "batch_bm25": _with(*FULL, "q as (select * from (values (1, 'that', 1, 'd', 2), (1, 'is', 1, 'd', 2), (2, 'that', 2, 'c', 2), (2, 'of', 1, 'c', 2), (3, 'the', 1, 'd', 1), (4, 'the', 1, 'c', 2)) v(query_id, term, qtf, mode, asked))",
        f"tot as (select query_id, doc_id, any_value(size) as size, round(sum(qtf * {_LINEAR}), 9) as s from q join post using (term) join lex using (term) join sizes using (doc_id) cross join stats group by query_id, mode, asked, doc_id having mode = 'd' or count(*) = asked)")
    + "select cast(query_id as bigint) as query_id, cast(row_number() over (partition by query_id order by s desc, size desc, doc_id) as bigint) as rank, doc_id, size, round(s, 6) as score from tot qualify rank <= 10",
    "sentences": _with(DOCS, _LINES) + "select doc_id, idx, line from lines",
    "sentence_stats": _with(DOCS, _LINES) + "select doc_id, cast(count(*) as bigint) as n_lines, cast(floor(sum(strlen(line)) / count(*)) as bigint) as mean_bytes from lines group by doc_id",
    "sentence_scores": _with(DOCS, _LINES, *_scored(PAIR)) + "select doc_id, idx, round(exact, 6) as score from sc",
    "best_sentence": _with(DOCS, _LINES, *_scored(PAIR)) + "select doc_id, best, best_score from best",
    "snippet_window": _with(DOCS, _LINES, *_scored(PAIR)) + "select doc_id, idx from win",
    "snippet_text": _with(DOCS, _LINES, *_scored(PAIR)) + _SNIPPET,
    "search_with_snippets": _with(PAGES, *FULL[1:], _totals(PAGE_TERMS, "d"), _TOP, _LINES, *_scored(PAGE_TERMS), f"sn as ({_SNIPPET})") + "select rank, doc_id, url, snippet from top join (select doc_id, url from docs) using (doc_id) join sn using (doc_id)",
    "posting_chunks": _with(DOCS, TOK, POST, *_CHUNKED) + "select * from sizes_",
    "posting_gaps": _with(DOCS, TOK, POST, *_CHUNKED) + "select term, doc_id, chunk_id, gap from gaps",
    "gap_decode": BASE + "select term, doc_id, freq from post",
    "block_payloads": _with(DOCS, TOK, POST, *_CHUNKED) + f"select term, chunk_id, cast(count(*) as bigint) as n, cast(sum({_LEN('gap')} + {_LEN('freq')}) as bigint) as n_bytes, string_agg({_code('gap')}, '' order by doc_id) || string_agg({_code('freq')}, '' order by doc_id) as payload from gaps group by term, chunk_id",
    "varbyte_len": _with(_NUMBERS) + f"select n, cast({_LEN('n')} as bigint) as n_bytes from nums",
    "varbyte_encode": _with(_NUMBERS) + f"select n, {_code('n')} as code from nums",
    "varbyte_roundtrip": _with(_NUMBERS) + "select n % 50 as part, n from nums",
    "lexicon_positions": _with(DOCS, TOK, POST, *_CHUNKED, _ENTRY) + "select term, df, cast(sum(bytes) over w - bytes as bigint) as position, cast(sum(bytes) over w as bigint) as next_position from entry window w as (order by term)",
    "lexicon_sparse": _with(DOCS, TOK, POST, LEX, _FULL) + "select term, df, is_full from full_",
    "lexicon_sparse_positions": _with(DOCS, TOK, POST, LEX, *_CHUNKED, _ENTRY, _FULL, f"e as (select entry.term, entry.df, is_full, bytes + case when is_full then 0 else 1 + {_LEN('entry.df')} + {_LEN('strlen(entry.term)')} + strlen(entry.term) end as bytes from entry join full_ using (term))")
    + "select term, df, cast(sum(bytes) over w - bytes as bigint) as position, cast(sum(bytes) over w as bigint) as next_position, is_full from e window w as (order by term)",
    "chunk_offsets": _with(DOCS, TOK, POST, *_CHUNKED) + "select term, chunk_id, cast(sum(n_bytes) over (partition by term order by chunk_id) - n_bytes as bigint) as relative_position from sizes_",
    "page_lookup": _with(PAGES) + "select doc_id, url, cast(len(tokens) as bigint) as size from docs where doc_id = 7",
    "page_url": _with(PAGES) + "select doc_id, url from docs",
    "page_body": _with(PAGES) + "select doc_id, body from docs where doc_id = 7",
    "page_count": _with(PAGES) + "select cast(count(*) as bigint) as n from docs",
    "docs_with_term": _with(PAGES, SIZES) + f"select doc_id, size from sizes where doc_id in (select doc_id from docs where list_contains(tokens, '{PAGE_TERMS[0]}'))",
}
#: Stored tables and files give what the queries that compute everything anew give.
SQL |= {
    f"indexed_{name}": SQL[name] for name in ("open_list", "next_geq", "boolean_and", "bm25_and_top10", "bm25_or_top10", "batch_bm25", "search_with_snippets")
} | {
    "index_lexicon": SQL["lexicon_sparse_positions"], "index_stats": SQL["corpus_stats"], "payload_decode": SQL["postings"], "payload_decode_fixed": SQL["postings"], "runs_varbyte": SQL["postings"], "runs_text": SQL["postings"], "runs_ids": SQL["postings"],
    "term_map": SQL["term_ids"],
    "runs_merged": BASE + f"select term, doc_id, cast(sum(freq) as bigint) as freq from (select * from post where doc_id % 3 <= 0 union all select * from post where doc_id % 3 <= 1) where term in {_in(COMMON)} group by term, doc_id",
    "varbyte_file": _with(_NUMBERS) + "select n, n % 7 + 1 as freq from nums",
    "index_pages": _with(PAGES) + "select doc_id, url, body, cast(len(tokens) as bigint) as size from docs",
    "trec_documents": "select cast(row_number() over (order by page_id) as bigint) as doc_id, trim(url) as url, html from pages where trim(url) <> ''", "document_numbers": "select page_id, cast(row_number() over (order by url, page_id) as bigint) as doc_id from pages where trim(url) <> '' and html is not null",
    "html_cases": "select * from (values " + ", ".join(f"(cast({n} as bigint), {_quote(text)})" for n, (_, text) in enumerate(HTML_CASES)) + ") v(n, text)",
    "tokenize_by_space": r"select doc_id, cast(unnest(range(len(tokens))) as bigint) as pos, unnest(tokens) as term from (select doc_id, list_filter(string_split_regex(lower(text), '[ \n]'), lambda t: t <> '') as tokens from documents where text is not null)",
    "parsed_query": "select how, cast(place as bigint) as place, term from (values ('plain', 0, 'Foo'), ('plain', 1, 'foo-bar'), ('plain', 2, 'that'), ('analyzed', 0, 'foo'), ('analyzed', 1, 'foo'), ('analyzed', 2, 'bar'), ('analyzed', 3, 'that')) v(how, place, term)",
}
SQL["trec_documents_utf16"] = SQL["trec_documents"]
