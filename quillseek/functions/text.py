"""Text functions: tokens, lines, HTML to text. All of them are built-in expressions but html_text_full."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that separate tokens. "=", ";", "~", "|" and all beyond ASCII don't.
DELIMITERS = r"[ @#$%^&*<>`:.,?!()/\\+\-_\[\]{}\"'\r\n\t]"
#: Longest token in bytes.
MAX_BYTES = 30
#: Elements that are left out with all they hold, and have a closing tag.
HIDDEN = ("script", "style", "noscript", "header", "head")
#: Elements within equal ones that are told apart from the outside.
NESTED = 3
#: Named characters; names are in the case that the standard has.
ENTITIES = {n: chr(c) for n, c in name2codepoint.items()} | {"apos": "'"}

Tokenizer = Callable[[Column], Column]


def tokenize(text: Column) -> Column:
    """Array of the tokens of 1 to MAX_BYTES bytes, in order; null for null."""
    return F.filter(F.split(text, DELIMITERS), lambda t: F.octet_length(t).between(1, MAX_BYTES))


def lines(body: Column) -> Column:
    """Array of the lines that aren't empty."""
    return F.filter(F.split(body, r"[\r\n]"), lambda x: x != "")


def _steps(text: Column, *steps: Callable[[Column], Column]) -> Column:
    """The steps one after the other; what a step is given is computed once, however often it is used."""
    box = F.array(text)
    for step in steps:
        box = F.transform(box, step)
    return F.element_at(box, 1)


def _around(text: Column, mark: str, before: Callable[[Column], Column], after: Callable[[Column], Column]) -> Column:
    """``before`` of all up to the last ``mark`` and ``after`` of the rest.

    An opening in the first part always has its end, so no search for one runs
    to the end of the text in vain.
    """
    rest = F.substring_index(text, mark, -1)
    return F.concat(before(F.left(text, F.char_length(text) - F.char_length(rest))), after(rest))


def _without_comments(text: Column) -> Column:
    """A comment that isn't ended reaches to the end."""
    return _around(text, "-->", lambda t: F.regexp_replace(t, "(?s)<!--.*?-->", " "), lambda t: F.regexp_replace(t, "(?s)<!--.*+", " "))


def _without(tag: str) -> list[Callable[[Column], Column]]:
    """Elements within each other go from the inside, so to NESTED levels; one that isn't closed reaches to the end, a head to the body."""
    opened, end = rf"<{tag}(?:\s[^<>]*+)?+>", r"(?:.*?(?=<body[\s>])|.*+)" if tag == "head" else ".*+"
    inner = rf"(?s){opened}(?:(?!</?{tag}[\s>]).)*+</{tag}>"
    out = [lambda t: F.regexp_replace(t, rf"</{tag}\s++>", f"</{tag}>")]
    if tag not in ("script", "style"):  # their content is no markup
        out += [lambda t: F.regexp_replace(t, inner, " ")] * NESTED
    return [*out, lambda t: _around(t, f"</{tag}>", lambda h: F.regexp_replace(h, rf"(?s){opened}.*?</{tag}>", " "), lambda r: F.regexp_replace(r, rf"(?s){opened}{end}", " "))]


def decode_entities(text: Column) -> Column:
    """Named (with ";"), decimal and hexadecimal characters, each decoded once; what isn't one stays as it is."""
    names, chars = zip(*sorted(ENTITIES.items()))
    named = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.lit, chars)))

    def char(ref: Column) -> Column:
        digits = F.regexp_replace(ref, "[#;xX]", "")
        code = F.when(F.lower(F.substring(ref, 1, 2)) == "#x", F.conv(digits, 16, 10)).when(F.substring(ref, 1, 1) == "#", digits).cast("bigint")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.coalesce(F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")), F.try_element_at(named, F.regexp_replace(ref, ";", "")))

    def piece(p: Column, i: Column) -> Column:
        ref = F.regexp_extract(p, "^(#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[a-zA-Z][a-zA-Z0-9]{1,31};)", 1)
        decoded = F.when(ref != "", F.concat(char(ref), F.substring(p, F.length(ref) + 1, F.length(p))))
        return F.when(i == 0, p).otherwise(F.coalesce(decoded, F.concat(F.lit("&"), p)))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "&"), piece), "")).otherwise(text)


def html_text(html: Column) -> Column:
    """Text of lower-case HTML; every tag is a break between tokens, hidden elements and comments are left out.

    Each step is linear in the length, whatever the markup.
    """
    hidden = [step for tag in HIDDEN for step in _without(tag)]
    return _steps(html, _without_comments, *hidden, lambda t: F.regexp_replace(t, "<[^<>]*+>", " "), decode_entities)


@F.pandas_udf(StringType())
def html_text_full(html: pd.Series) -> pd.Series:
    """As html_text(), but by the standard library's parser: unclosed hidden elements and all entities are handled."""
    from .htmlparse import text_of

    return html.map(lambda x: None if x is None else text_of(x))


def page_body(url: Column, html: Column) -> Column:
    """What a page's tokens and snippets are made of: URL and HTML in lower case."""
    return F.lower(F.concat(F.trim(url), F.lit(" "), html))


def term_frequencies(tokens: Column, terms: Sequence[str]) -> Column:
    """Map-free count of each term: array of (term, freq) for those that occur, in the terms' order."""
    counts = F.array(*[F.struct(F.lit(t).alias("term"), F.size(F.filter(tokens, _equal_to(t))).cast("bigint").alias("freq")) for t in terms])
    return F.filter(counts, lambda c: c["freq"] > 0)


def _equal_to(term: str) -> Callable[[Column], Column]:
    return lambda x: x == F.lit(term)
