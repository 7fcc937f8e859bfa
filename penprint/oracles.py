"""DuckDB twins of the Spark expressions, used as the correctness oracle.

Regex constants are shared with ``penprint.functions``; only the dialect differs
(``$1`` -> ``\\1``, global flag ``'g'``, no Java-only ``d`` flag).
"""

from __future__ import annotations

from penprint.functions import text as T
from penprint.operators.sampling import DEFAULT_SPLIT, SPLIT_NAMES, cut_points

SEED = 42


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rx_replace(expr: str, pattern: str, repl: str = "") -> str:
    repl = repl.replace("$1", "\\1")
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}, 'g')"


def clean(expr: str) -> str:
    t = f"replace({expr}, chr(13) || chr(10), chr(10))"
    t = rx_replace(t, T.URL_PATTERN, T.URL_TOKEN)
    t = rx_replace(t, T.WS_RUN_PATTERN, " ")
    return f"trim({t})"


def tokens(expr: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, {q(T.TOKEN_PATTERN)})) AS BIGINT)"


def strip_quotations(expr: str) -> str:
    return rx_replace(rx_replace(expr, T.QUOTE_ATTRIBUTION_PATTERN), T.QUOTE_SENTENCE_PATTERN)


def strip_markdown(expr: str) -> str:
    t = rx_replace(expr, T.MD_QUOTE_LINE)
    t = rx_replace(t, T.MD_FOOTNOTE_LINE)
    for p, r in T.MD_CHAIN:
        t = rx_replace(t, p, r)
    return t


def author_text(expr: str) -> str:
    c = clean(expr)
    return f"CASE WHEN {c} <> '' AND length({c}) >= {T.MIN_AUTHOR_TEXT_LENGTH} THEN {c} END"


def hash_key(*parts: str, seed=SEED) -> str:
    return f"md5(concat_ws('|', {q(str(seed))}, {', '.join(parts)}))"


def vc(col: str) -> str:
    return f"CAST({col} AS VARCHAR)"


# ---------------------------------------------------------------------------
# Reusable CTE chains
# ---------------------------------------------------------------------------

def corpus_ctes(label: str = "source") -> str:
    """``corpus(doc_id, label, text)``: dedup -> clean -> > 60 tokens."""
    return f"""
raw AS (SELECT doc_id, CAST({label} AS VARCHAR) AS label, text FROM documents WHERE text IS NOT NULL),
dedup AS (SELECT min(doc_id) AS doc_id, label, text FROM raw GROUP BY label, text),
cleaned AS (SELECT doc_id, label, {clean('text')} AS text FROM dedup),
corpus AS (SELECT * FROM cleaned WHERE {tokens('text')} > {T.MIN_CORPUS_TOKENS}),
counts AS (SELECT label, count(*) AS n_texts FROM corpus GROUP BY label),
ranked AS (SELECT label, n_texts,
           CAST(row_number() OVER (ORDER BY n_texts DESC, label ASC) - 1 AS INTEGER) AS author_rank
           FROM counts)"""


def split_case(rank: str, size: str, split=DEFAULT_SPLIT) -> str:
    cuts = cut_points(split)
    parts = [f"WHEN {rank} < trunc({c!r}::DOUBLE * {size}) THEN '{name}'"
             for name, c in zip(SPLIT_NAMES, cuts)]
    return f"CASE {' '.join(parts)} ELSE '{SPLIT_NAMES[len(cuts)]}' END"


def dataset_ctes(n: int, limit: int | None = None, ooc: bool = False, split=DEFAULT_SPLIT,
                 label: str = "source") -> str:
    """``dataset(doc_id, label, text, split)`` on top of ``corpus_ctes``."""
    lim = (f"SELECT doc_id, label, text FROM (SELECT *, row_number() OVER "
           f"(PARTITION BY label ORDER BY doc_id) AS rn FROM sel) WHERE rn <= {limit}"
           if limit is not None else "SELECT * FROM sel")
    s = corpus_ctes(label) + f""",
sel AS (SELECT * FROM corpus WHERE label IN (SELECT label FROM ranked WHERE author_rank < {n})),
lim AS ({lim}),
keyed AS (SELECT *, {hash_key('label', vc('doc_id'))} AS k FROM lim),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k, doc_id) - 1 AS r,
       count(*) OVER (PARTITION BY label) AS n FROM keyed),
sp AS (SELECT doc_id, label, text, {split_case('r', 'n', split)} AS split FROM rk),
mapped AS (SELECT sp.doc_id, coalesce(CAST(ranked.author_rank AS VARCHAR), sp.label) AS label,
           sp.text, sp.split FROM sp LEFT JOIN ranked ON sp.label = ranked.label)"""
    if not ooc:
        return s + ",\ndataset AS (SELECT * FROM mapped)"
    return s + f""",
ooc_k AS (SELECT CAST(ceil(max(CASE WHEN author_rank = {n - 1} THEN n_texts END)
          / count(CASE WHEN author_rank >= {n} THEN 1 END)) AS BIGINT) AS k FROM ranked),
ooc_rows AS (SELECT c.doc_id, c.text, c.label,
             row_number() OVER (PARTITION BY c.label ORDER BY
               {hash_key("'ooc'", 'c.label', vc('c.doc_id'))}, c.doc_id) - 1 AS r
             FROM corpus c WHERE c.label IN (SELECT label FROM ranked WHERE author_rank >= {n})),
pool AS (SELECT doc_id, '{n}' AS label, text FROM ooc_rows, ooc_k WHERE r < k),
pool_rk AS (SELECT *, row_number() OVER (ORDER BY {hash_key("'pool'", vc('doc_id'))}, doc_id) - 1 AS r,
            count(*) OVER () AS n FROM pool),
dataset AS (SELECT * FROM mapped
            UNION ALL SELECT doc_id, label, text, {split_case('r', 'n', split)} FROM pool_rk)"""


# ---------------------------------------------------------------------------
# Feature twins
# ---------------------------------------------------------------------------

def ratio(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0))"


def words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, {q(T.WS_RUN_PATTERN)}), lambda w: w <> '')"


def style_select(t: str) -> str:
    from penprint.functions.charclass import digit_class, lower_preimage, upper_class
    from penprint.functions.features import FREQ_CHARS, SHORT_WORD
    ws = words(t)
    cols = [
        f"{ratio(f'coalesce(list_sum(list_transform({ws}, lambda w: length(w))), 0)', f'len({ws})')} AS avg_len",
        f"CAST(length({t}) AS DOUBLE) AS len_text",
        f"CAST(len({ws}) AS DOUBLE) AS len_words",
        f"CAST(len(list_filter({ws}, lambda w: length(w) < {SHORT_WORD})) AS DOUBLE) AS num_short_w",
        f"{ratio(f'length({t}) - length({rx_replace(t, digit_class())})', f'length({t})')} AS per_digit",
        f"{ratio(f'length({t}) - length({rx_replace(t, upper_class())})', f'length({t})')} AS per_cap",
        f"{ratio(f'len(list_distinct({ws}))', f'len({ws})')} AS richness",
    ]
    for c in FREQ_CHARS:
        kept = f"translate({t}, {q(lower_preimage(c))}, '')"
        num = f"length({t}) - length({kept})"
        cols.append(f"{ratio(num, f'length({t})')} AS \"cf_{c}\"")
    return ",\n  ".join(cols)


def ngrams(chars: str, n: int) -> str:
    """n-grams from a character list column (``string_split(t, '')`` computed once)."""
    parts = " || ".join(f"{chars}[i + {j}]" for j in range(n))
    return f"list_transform(range(1, len({chars}) - {n - 2}), lambda i: {parts})"


def padded(t: str) -> str:
    return f"(' ' || {t} || ' ')"


# ---------------------------------------------------------------------------
# Metric twins
# ---------------------------------------------------------------------------

def macro_metrics_ctes(source: str, group: str | None = None) -> str:
    """``metrics(grp, accuracy, f1, precision, recall)`` from ``source(grp, y, p)``."""
    g = group or "0"
    return f"""
conf AS (SELECT {g} AS grp, y, p, count(*) AS c FROM {source} GROUP BY ALL),
roles AS (SELECT grp, y AS cls, CASE WHEN y = p THEN c ELSE 0 END AS tp, 0 AS fp,
                 CASE WHEN y <> p THEN c ELSE 0 END AS fn FROM conf
          UNION ALL
          SELECT grp, p AS cls, 0 AS tp, CASE WHEN y <> p THEN c ELSE 0 END AS fp, 0 AS fn FROM conf),
pc AS (SELECT grp, cls, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM roles GROUP BY grp, cls),
pcm AS (SELECT grp,
          CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
          CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall,
          CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END AS f1
        FROM pc),
macro AS (SELECT grp, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM pcm GROUP BY grp),
acc AS (SELECT grp, sum(CASE WHEN y = p THEN c ELSE 0 END) / sum(c) AS accuracy FROM conf GROUP BY grp),
metrics AS (SELECT macro.grp, accuracy, f1, precision, recall FROM macro JOIN acc ON macro.grp = acc.grp)"""


# ---------------------------------------------------------------------------
# Prompting twins
# ---------------------------------------------------------------------------

def prompt_set_ctes(n: int | None, reps: int) -> str:
    """``prompt_set(rep, label, author, query_text, example_text)`` after ``corpus_ctes``."""
    if n is None:
        pa = ("SELECT r.rep, c.label, row_number() OVER (PARTITION BY r.rep ORDER BY c.label) AS rn "
              "FROM counts c CROSS JOIN reps r")
        drawn = "SELECT rep, label, CAST(rn - 1 AS INTEGER) AS author_idx FROM pa"
    else:
        pa = (f"SELECT r.rep, c.label, row_number() OVER (PARTITION BY r.rep ORDER BY "
              f"{hash_key(q('authors'), vc('r.rep'), 'c.label')}, c.label) AS rn "
              f"FROM counts c CROSS JOIN reps r")
        drawn = f"SELECT rep, label, CAST(rn - 1 AS INTEGER) AS author_idx FROM pa WHERE rn <= {n}"
    return f"""
reps AS (SELECT CAST(unnest(range(0, {reps})) AS INTEGER) AS rep),
pa AS ({pa}),
drawn AS ({drawn}),
tx AS (SELECT d.rep, d.label, d.author_idx, c.text,
       row_number() OVER (PARTITION BY d.rep, d.label ORDER BY
         {hash_key(q('texts'), vc('d.rep'), vc('c.doc_id'))}, c.doc_id) AS rn
       FROM corpus c JOIN drawn d ON c.label = d.label),
prompt_set AS (SELECT rep, author_idx AS label, label AS author,
       max(CASE WHEN rn = 1 THEN text END) AS query_text,
       max(CASE WHEN rn = 2 THEN text END) AS example_text
       FROM tx GROUP BY rep, label, author_idx)"""


def example_json_cte(source: str = "prompt_set") -> str:
    return f"""
ej AS (SELECT rep, '{{' || string_agg(to_json(CAST(label AS VARCHAR)) || ': ' || to_json(example_text),
       ', ' ORDER BY label) || '}}' AS example_json FROM {source} GROUP BY rep)"""


def sentences(t: str) -> str:
    from penprint.functions.prompts import SENTENCE_SEP
    return f"string_split(regexp_replace({t}, '([.!?]) +', '\\1{SENTENCE_SEP}', 'g'), '{SENTENCE_SEP}')"


def crop(t: str, budget: str) -> str:
    """B15 twin: prefix sums over sentence token counts (monotone), keep those <= budget."""
    s = sentences(t)
    toks = f"list_transform({s}, lambda x: len(regexp_extract_all(x, {q(T.TOKEN_PATTERN)})))"
    pref = f"list_transform(range(1, len({toks}) + 1), lambda i: list_sum(({toks})[1:i]))"
    k = f"len(list_filter({pref}, lambda v: v <= {budget}))"
    cropped = f"trim(array_to_string(({s})[1:{k}], ' '))"
    return f"CASE WHEN {tokens(t)} < {budget} THEN {t} ELSE {cropped} END"


def fill(template: str, values: dict[str, str]) -> str:
    import string as _s
    parts = []
    for literal, field, _, _ in _s.Formatter().parse(template):
        if literal:
            parts.append(q(literal))
        if field is not None:
            parts.append(f"CAST({values[field]} AS VARCHAR)")
    return " || ".join(parts) if parts else "''"


# ---------------------------------------------------------------------------
# HTML / URL twins
# ---------------------------------------------------------------------------

def unescape(t: str) -> str:
    from penprint.functions.html import ENTITIES
    for ent, ch in ENTITIES:
        t = f"replace({t}, {q(ent)}, {q(ch)})"
    return t


def paragraphs(fragment: str) -> str:
    from penprint.functions.html import EDGE_WS, P_OPEN, TAG
    body = f"(regexp_split_to_array({fragment}, {q(P_OPEN)}))[2:]"
    inner = f"regexp_replace(regexp_replace(p, '(?s)</p>.*', ''), {q(TAG)}, '', 'g')"
    return f"list_transform({body}, lambda p: {rx_replace(unescape(inner), EDGE_WS)})"


def all_parts(html: str, tag: str) -> str:
    return f"array_to_string(regexp_extract_all({html}, '(?s)<{tag}(?:[ \\t\\n\\r\\f][^>]*)?>(.*?)</{tag}>', 1), '')"


def main_fragment(html: str, boilerplate=("ad",)) -> str:
    from penprint.functions.html import boilerplate_pattern
    cleaned = rx_replace(html, boilerplate_pattern(boilerplate))
    return all_parts(cleaned, "article")


def html_main_text(html: str, boilerplate=("ad",)) -> str:
    paras = paragraphs(main_fragment(html, boilerplate))
    joined = f"array_to_string(list_filter({paras}, lambda p: p <> ''), chr(10))"
    return author_text(strip_quotations(joined))


def entity_id(url: str, prefix: str) -> str:
    from penprint.functions.html import UNKNOWN_ID, entity_id_pattern
    pat = q(entity_id_pattern(prefix))
    return (f"CASE WHEN NOT regexp_matches({url}, {pat}) THEN '{UNKNOWN_ID}' "
            f"WHEN regexp_extract({url}, {pat}, 2) <> '' THEN regexp_extract({url}, {pat}, 1) || '_' || "
            f"regexp_extract({url}, {pat}, 2) ELSE regexp_extract({url}, {pat}, 1) END")


def user_from_url(url: str, marker: str) -> str:
    m = q(marker)
    tail = f"CASE WHEN strpos({url}, {m}) > 0 THEN substr({url}, strpos({url}, {m}) + {len(marker)}) ELSE {url} END"
    return f"split_part({tail}, '/', 1)"
