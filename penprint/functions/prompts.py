"""Prompt data functions: our own templates, budget, crop, parse.

Templates are plain data; a template string is split at its placeholders once on the
driver and re-assembled with ``concat`` per row, which substitutes all placeholders at
once the way ``str.format`` does (a placeholder inside a text is never expanded).
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from penprint.functions.charclass import ws_class
from penprint.functions.text import DEFAULT_COUNTER, TokenCounter, as_col

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results: the response
# markers the parser looks for, and the budget constants.
# ---------------------------------------------------------------------------
ANALYSIS_MARKER = "Analýza:"
RESULT_MARKER = "Výsledek:"
AUTHOR_WORD = "autor"
BUDGET_BUFFER = 50
DEFAULT_MAX_TOKENS = 128000
DEFAULT_MAX_NEW_TOKENS = 1000
REQUEST_METHOD = "POST"
REQUEST_URL = "/v1/chat/completions"
REQUEST_MODEL = "gpt-4o-mini-2024-07-18"
REQUEST_MAX_TOKENS = 1000
REQUEST_TEMPERATURE = 0.7
# ---------------------------------------------------------------------------

EXAMPLE_WORD = "Autor"

_RESULT_FORMAT_CZ = ("Odpověz jen v tomto tvaru:\n### Analýza:\n(krátké zdůvodnění v jednom odstavci)\n"
                     "### Výsledek:\n(pouze číslo autora)")

TEMPLATES: dict[str, list[dict[str, str]]] = {
    "en": [
        {"role": "system",
         "content": 'Answer with a JSON object holding "analysis" (why) and "answer" '
                    "(the ID of the author of the query text)."},
        {"role": "user",
         "content": "Compare writing style only, not topic or length, and decide who wrote "
                    "the query text.\n\nQuery text: {query_text}\n\nKnown authors:\n{example_text}"},
    ],
    "cz": [
        {"role": "system", "content": _RESULT_FORMAT_CZ},
        {"role": "user",
         "content": "Podle stylu psaní urči, který ze známých autorů napsal dotazovaný text.\n\n"
                    "Dotazovaný text: {query_text}\n\nTexty známých autorů:\n{example_text}"},
    ],
    "cz-1shot": [
        {"role": "system", "content": _RESULT_FORMAT_CZ},
        {"role": "user",
         "content": "Dotazovaný text: Dnes prší.\n\nTexty známých autorů:\nAutor 0: Venku leje.\n"
                    "Autor 1: Sluníčko svítí."},
        {"role": "assistant", "content": "### Analýza:\nKrátké věty o počasí.\n### Výsledek:\n0"},
        {"role": "user",
         "content": "Dotazovaný text: {query_text}\n\nTexty známých autorů:\n{example_text}"},
    ],
}

FINETUNE_REQUEST_TEMPLATE = [
    {"role": "system", "content": _RESULT_FORMAT_CZ},
    {"role": "user",
     "content": "Vysvětli podle stylu psaní, proč dotazovaný text napsal autor {correct_author}.\n\n"
                "Dotazovaný text: {query_text}\n\nTexty známých autorů (JSON): {example_text}"},
]

SFT_TEMPLATE = [
    {"role": "system", "content": _RESULT_FORMAT_CZ},
    {"role": "user", "content": "Dotazovaný text: {query_text}\n\nTexty známých autorů:\n{example_text}"},
    {"role": "assistant", "content": "### Analýza:\n{response}\n### Výsledek:\n{label}"},
]


def load_template(name: str) -> list[dict[str, str]]:
    key = name.lower()
    if key not in TEMPLATES:
        raise ValueError(f"unknown template {name!r}; known: {', '.join(sorted(TEMPLATES))}")
    return TEMPLATES[key]


def fill(template: str, values: dict[str, Column]) -> Column:
    """``template.format(**values)`` as one ``concat``."""
    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(values[field].cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def render_messages(template: list[dict[str, str]], values: dict[str, Column],
                    fill_all: bool = False) -> Column:
    """``array<struct<role, content>>``; placeholders are filled in the last message
    (or in every message when ``fill_all``)."""
    msgs = []
    last = len(template) - 1
    for i, m in enumerate(template):
        content = fill(m["content"], values) if (fill_all or i == last) else F.lit(m["content"])
        msgs.append(F.struct(F.lit(m["role"]).alias("role"), content.alias("content")))
    return F.array(*msgs)


def flatten_chat(messages: Column) -> Column:
    """One training string per chat: ``<|role|>`` header line, content, blank line."""
    return F.array_join(F.transform(messages, lambda m: F.concat(
        F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n"))), "")


def template_tokens(template: list[dict[str, str]], counter: TokenCounter = DEFAULT_COUNTER) -> int:
    # The reference counts the tokens of the template's Python ``str()`` form.
    return counter.of_constant(str(template))


def token_budget(n_texts, template_tok: int, max_tokens: int = DEFAULT_MAX_TOKENS,
                 max_new_tokens: int = DEFAULT_MAX_NEW_TOKENS) -> Column:
    """``(max - max_new - template - 50) // (n + 1)``, undivided when ``n <= 0``."""
    rest = F.lit(max_tokens - max_new_tokens - template_tok - BUDGET_BUFFER).cast("long")
    n = as_col(n_texts).cast("long")
    return F.when(n > 0, F.floor(rest / (n + 1)).cast("long")).otherwise(rest)


SENTENCE_SEP = "\ue000"    # private-use sentinel; RE2 has no look-behind (G3)


def sentences(text) -> Column:
    """Split after ``.``/``!``/``?`` followed by spaces (sentinel form, as in RE2)."""
    marked = F.regexp_replace(as_col(text), "([.!?]) +", "$1" + SENTENCE_SEP)
    return F.split(marked, SENTENCE_SEP)


def crop_to_budget(text, budget, counter: TokenCounter = DEFAULT_COUNTER) -> Column:
    """B15 + F8: keep the text if it has fewer tokens than ``budget``; otherwise keep the
    longest run of leading sentences whose running token total stays within the budget.

    The running total is the sum of the sentences' own counts (with the default counter
    also the count of the sentences joined by a space): a prefix sum in one ``aggregate`` per row.
    """
    t = as_col(text)
    b = as_col(budget).cast("long") if not isinstance(budget, int) else F.lit(budget).cast("long")
    sents = sentences(t)
    toks = F.transform(sents, lambda s: counter.count(s).cast("long"))
    init = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("k"), F.lit(False).alias("stop"))

    def step(acc, x):
        nxt = acc["sum"] + x
        stop = acc["stop"] | (nxt > b)
        return F.struct(F.when(stop, acc["sum"]).otherwise(nxt).alias("sum"),
                        F.when(stop, acc["k"]).otherwise(acc["k"] + 1).alias("k"),
                        stop.alias("stop"))

    k = F.aggregate(toks, init, step)["k"]
    cropped = F.trim(F.array_join(F.slice(sents, 1, k), " "))
    return F.when(counter.count(t) < b, t).otherwise(cropped)


_WS = ws_class()
ANALYSIS_PATTERN = f"###{_WS}*{ANALYSIS_MARKER}{_WS}*([^\\n]+){_WS}*###{_WS}*{RESULT_MARKER}"
ANSWER_PATTERN = f"###{_WS}*{RESULT_MARKER}{_WS}*(?:{AUTHOR_WORD}{_WS}+)?(\\p{{Nd}}+)"


def parse_response(text) -> Column:
    """Last analysis section (else the whole text), last numeric answer (else
    ``error``); Unicode case-insensitive."""
    t = as_col(text)
    flags = "(?iu)"
    analysis = F.try_element_at(F.regexp_extract_all(t, F.lit(flags + ANALYSIS_PATTERN), 1), F.lit(-1))
    answer = F.try_element_at(F.regexp_extract_all(t, F.lit(flags + ANSWER_PATTERN), 1), F.lit(-1))
    return F.struct(F.coalesce(analysis, t).alias("analysis"),
                    F.coalesce(answer, F.lit("error")).alias("answer"))


def parse_json_response(text) -> Column:
    """Null -> (error, error); not an object with both fields -> (text, error)."""
    t = as_col(text)
    js = F.from_json(t, "analysis string, answer string")
    ok = js["analysis"].isNotNull() & js["answer"].isNotNull()
    return (F.when(t.isNull(), F.struct(F.lit("error").alias("analysis"), F.lit("error").alias("answer")))
            .when(ok, F.struct(js["analysis"].alias("analysis"), js["answer"].alias("answer")))
            .otherwise(F.struct(t.alias("analysis"), F.lit("error").alias("answer"))))


def json_string(col) -> Column:
    """A JSON string literal for one value (``to_json`` of a one-element array, unwrapped)."""
    arr = F.to_json(F.array(as_col(col).cast("string")))
    return F.substring(arr, F.lit(2), F.length(arr) - 2)
