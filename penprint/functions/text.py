"""Scalar text expressions.

Everything returns a ``Column`` built from JVM-side functions; no Python UDF is involved
(expressions with lambdas are interpreted).  The regex strings are kept as
module constants because the DuckDB oracle (``penprint.oracles``) reuses them verbatim.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from penprint.functions.charclass import non_ws_class, ws_body, ws_class

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
MIN_AUTHOR_TEXT_LENGTH = 20      # minimum cleaned length of an accepted author text
MIN_CORPUS_TOKENS = 60           # corpus rows need strictly more tokens than this
URL_TOKEN = "URL"                # replacement for masked links
# ---------------------------------------------------------------------------

# ``http`` + non-space run, or ``www.`` + non-space run; case-sensitive, no word boundary.
URL_PATTERN = f"http{non_ws_class()}+|www\\.{non_ws_class()}+"
WS_RUN_PATTERN = f"{ws_class()}+"

# Default token counter: runs of letters, runs of at most three digits, runs of other
# non-whitespace symbols.  It stands in for a BPE vocabulary that cannot be loaded
# offline.  Every Unicode whitespace only separates tokens, so collapsing whitespace
# (B1) never changes a count.
TOKEN_PATTERN = f"\\p{{L}}+|\\p{{N}}{{1,3}}|[^{ws_body()}\\p{{L}}\\p{{N}}]+"

# Quotation removal (B3).  Opening quotes ``" „ ‚``, closing quotes ``" “ ‘``.
QUOTE_ATTRIBUTION_PATTERN = '["„‚][^"„‚“‘]+,["“‘][^\\n]*?\\.'
QUOTE_SENTENCE_PATTERN = '["„‚][^"„‚“‘]+[.]["“‘]'


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mask_urls(text) -> Column:
    """Links masked; the pattern is tried only on texts that hold one of its two beginnings."""
    t = as_col(text)
    return F.when(t.contains("http") | t.contains("www."), F.regexp_replace(t, URL_PATTERN, URL_TOKEN)).otherwise(t)


def clean_text(text) -> Column:
    """B1: CRLF->LF, mask URLs, collapse every Unicode whitespace run to one space, trim.

    Newline runs followed by whitespace runs collapse to the same single space as one
    combined whitespace run, so the two reference steps fold into one replacement.
    """
    t = F.replace(as_col(text), F.lit("\r\n"), F.lit("\n"))
    t = F.regexp_replace(mask_urls(t), WS_RUN_PATTERN, " ")
    return F.trim(t)


@dataclass(frozen=True)
class TokenCounter:
    """B14 as a hook: how texts fall into tokens, for C2, B15, B16 and B21 alike.

    ``tokens`` gives the array of a text's tokens and ``count`` their number, as column
    functions that also work inside array lambdas (built-in functions, no Python UDFs);
    ``of_constant`` counts a text known on the driver, such as a template.  With
    ``ignores_spaces`` a count does not change when white space is collapsed, so it may run
    on texts that are not cleaned yet.
    """
    tokens: Callable[[Column], Column]
    count: Callable[[Column], Column]
    of_constant: Callable[[str], int]
    ignores_spaces: bool = False


def pattern_counter(pattern: str, ignores_spaces: bool = False) -> TokenCounter:
    """Tokens are the matches of a regular expression of Java."""
    def of_constant(text: str) -> int:
        python = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\U%08x" % int(m.group(1), 16), pattern)
        return len(regex.findall(python, text))

    return TokenCounter(lambda t: F.regexp_extract_all(t, F.lit(pattern), 0),
                        lambda t: F.regexp_count(t, F.lit(pattern)).cast("long"), of_constant, ignores_spaces)


DEFAULT_COUNTER = pattern_counter(TOKEN_PATTERN, ignores_spaces=True)


def count_tokens(text, counter: TokenCounter = DEFAULT_COUNTER) -> Column:
    """Token count (by default of ``TOKEN_PATTERN``)."""
    return counter.count(as_col(text))


def tokenize_truncate(text, max_tokens: int, counter: TokenCounter = DEFAULT_COUNTER) -> Column:
    """The first ``max_tokens`` tokens of a text, as an array."""
    return F.slice(counter.tokens(as_col(text)), 1, max_tokens)


def min_chars(text, n: int = MIN_AUTHOR_TEXT_LENGTH) -> Column:
    """At least ``n`` code points."""
    return F.length(as_col(text)) >= n


def min_tokens(text, n: int = MIN_CORPUS_TOKENS, counter: TokenCounter = DEFAULT_COUNTER) -> Column:
    """Strictly more than ``n`` tokens."""
    return count_tokens(text, counter) > n


def language_ok(lang, accepted=None) -> Column:
    """C5 (a): predicted language is in the accept set; ``None`` accepts everything."""
    if not accepted:
        return F.lit(True)
    return as_col(lang).isin(list(accepted))


def author_text(text, lang=None, accepted_langs=None) -> Column:
    """Cleaned text, or null when blank, shorter than 20 code points or off-language."""
    cleaned = clean_text(text)
    ok = (cleaned != "") & min_chars(cleaned)
    if lang is not None and accepted_langs:
        ok = ok & language_ok(lang, accepted_langs)
    return F.when(ok, cleaned)


def strip_quotations(text) -> Column:
    """Drop quoted speech with its attribution, then quoted full sentences.

    ``[^\\n]`` stands for Python's ``.``; it must run before ``clean_text``.
    """
    t = F.regexp_replace(as_col(text), QUOTE_ATTRIBUTION_PATTERN, "")
    return F.regexp_replace(t, QUOTE_SENTENCE_PATTERN, "")


# Markdown removal (B2).  First the reference's own line rule (block quotes and
# ``^(...)`` footnote lines), then our documented markup chain.
MD_QUOTE_LINE = "(?m)^>[^\\n]*(?:\\n|\\z)"
MD_FOOTNOTE_LINE = "(?m)^\\^\\([^\\n]*\\)(?:\\n|\\z)"
MD_CHAIN = [
    ("(?m)^[ \\t]*```[^\\n]*(?:\\n|\\z)", ""),                  # code fences
    ("(?m)^[ \\t]*(?:[-*_][ \\t]*){3,}(?:\\n|\\z)", ""),          # horizontal rules
    ("(?m)^[ \\t]{0,3}#{1,6}[ \\t]+", ""),                      # ATX headings
    ("(?m)^[ \\t]*[-*+][ \\t]+", ""),                           # bullet markers
    ("!\\[([^\\]\\n]*)\\]\\([^)\\n]*\\)", "$1"),                # images -> alt text
    ("\\[([^\\]\\n]*)\\]\\([^)\\n]*\\)", "$1"),                 # links -> link text
    ("`([^`\\n]*)`", "$1"),                                     # inline code
    ("\\*\\*([^*\\n]+)\\*\\*", "$1"),                           # strong
    ("__([^_\\n]+)__", "$1"),
    ("\\*([^*\\n]+)\\*", "$1"),                                 # emphasis
    ("~~([^~\\n]+)~~", "$1"),                                   # strike-through
]


def java_lines(pattern: str) -> str:
    """Java's multi-line anchors also fire at CR, NEL and U+2028; UNIX_LINES (``d``)
    restricts them to LF as in Python and RE2."""
    return pattern.replace("(?m)", "(?md)")


def strip_markdown(text) -> Column:
    t = F.regexp_replace(as_col(text), java_lines(MD_QUOTE_LINE), "")
    t = F.regexp_replace(t, java_lines(MD_FOOTNOTE_LINE), "")
    for pattern, repl in MD_CHAIN:
        t = F.regexp_replace(t, java_lines(pattern), repl)
    return t


def forum_post_text(text, lang=None, accepted_langs=None) -> Column:
    """Markdown removal, then the author-text rules."""
    return author_text(strip_markdown(text), lang, accepted_langs)


def news_article_text(text) -> Column:
    """Quotation removal, then the author-text rules without a language check."""
    return author_text(strip_quotations(text))


def parse_count(text, marker: str = "rec") -> Column:
    """Drop spaces and NBSP, keep what precedes ``marker``, read an integer."""
    t = F.translate(as_col(text), "\u0020\u00a0", "")
    head = F.substring_index(t, marker, 1)
    return head.try_cast("long")
