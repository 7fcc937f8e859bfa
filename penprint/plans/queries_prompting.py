"""Registered queries: prompt sets, fine-tuning requests, prompts and response scoring
(SURVEY F4, F5, F8, E7, E8, E9, G-3, G-5, A3, A4, A9, B14-B19, B21, I13, I16, I17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from penprint import oracles as O
from penprint.catalog import register
from penprint.functions import prompts as P
from penprint.functions import text as T
from penprint.operators import prompting as PR
from penprint.operators.metrics import METRICS
from penprint.plans.queries_core import N_AUTHORS, _clean
from penprint.sources.corpus import read_table

REPS = 3               # notebook example: 3 repetitions
MODEL_CONTEXT = 8192   # context of the open models the reference fine-tunes
TEMPLATE = "cz"
R = 9


def _prompt_set(spark, sf, n=N_AUTHORS, reps=REPS):
    return PR.sample_two_per_author(_clean(spark, sf), n, reps)


_PS = f"{O.corpus_ctes()}, {O.prompt_set_ctes(N_AUTHORS, REPS)}"


@register("f4_prompt_set", f"WITH {_PS} SELECT rep, label, author, query_text, example_text FROM prompt_set")
def f4_prompt_set(spark, sf):
    return _prompt_set(spark, sf)


@register("i16_create_prompt_set", f"WITH {_PS} SELECT rep, label, query_text, example_text FROM prompt_set")
def i16_create_prompt_set(spark, sf):
    return _prompt_set(spark, sf).select("rep", "label", "query_text", "example_text")


@register("f5_extract_samples", f"""WITH {O.corpus_ctes()}, {O.prompt_set_ctes(None, 1)}
SELECT label, author, query_text, example_text FROM prompt_set""")
def f5_extract_samples(spark, sf):
    s = PR.sample_two_per_author(_clean(spark, sf), None, 1)
    return s.select("label", "author", "query_text", "example_text")


@register("e7_authors_per_rep", f"""WITH {_PS}
SELECT rep, count(DISTINCT label) AS n_authors FROM prompt_set GROUP BY rep""")
def e7_authors_per_rep(spark, sf):
    return PR.authors_per_rep(_prompt_set(spark, sf))


@register("e8_example_block", f"""WITH {_PS}
SELECT rep, string_agg('{P.EXAMPLE_WORD} ' || CAST(label AS VARCHAR) || ': ' || example_text,
                       chr(10) ORDER BY label) AS examples
FROM prompt_set GROUP BY rep""")
def e8_example_block(spark, sf):
    return PR.example_block(_prompt_set(spark, sf))


@register("e9_example_json", f"WITH {_PS}, {O.example_json_cte()} SELECT rep, example_json FROM ej")
def e9_example_json(spark, sf):
    return PR.example_json(_prompt_set(spark, sf))


def _last_content_sql(template, values):
    return O.fill(template[-1]["content"], values)


def _messages_sql(template, values):
    """Every message as ``role: content``; only the last one has its placeholders filled."""
    fixed = "".join(f"{m['role']}: {m['content']}\n" for m in template[:-1])
    return f"{O.q(fixed + template[-1]['role'] + ': ')} || {_last_content_sql(template, values)}"


def _messages_text(col):
    return F.array_join(F.transform(F.col(col), lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


@register("i17_finetune_requests", f"""WITH {_PS}, {O.example_json_cte()},
rows AS (SELECT p.*, ej.example_json FROM prompt_set p JOIN ej USING (rep)),
num AS (SELECT *, row_number() OVER (ORDER BY {O.hash_key("'shuffle'", O.vc('rep'), O.vc('label'))},
               rep, label) - 1 AS request_idx FROM rows)
SELECT 'request_' || CAST(request_idx AS VARCHAR) AS custom_id, request_idx, rep, label, example_json,
       '{P.REQUEST_METHOD}' AS method, '{P.REQUEST_URL}' AS url, '{P.REQUEST_MODEL}' AS model,
       {_last_content_sql(P.FINETUNE_REQUEST_TEMPLATE,
                          {'query_text': 'query_text', 'example_text': 'example_json',
                           'correct_author': 'label'})} AS last_message,
       {_messages_sql(P.FINETUNE_REQUEST_TEMPLATE,
                      {'query_text': 'query_text', 'example_text': 'example_json', 'correct_author': 'label'})} AS messages
FROM num""")
def i17_finetune_requests(spark, sf):
    req = PR.finetune_requests(_prompt_set(spark, sf))
    return req.select("custom_id", "request_idx", "rep", "label", "example_json", "method", "url",
                      F.col("body.model").alias("model"),
                      F.element_at("body.messages", -1)["content"].alias("last_message"),
                      _messages_text("body.messages").alias("messages"))


_TT = P.template_tokens(P.load_template(TEMPLATE))
_BUDGET_SQL = (f"CASE WHEN n_authors > 0 THEN CAST(floor(({MODEL_CONTEXT - P.DEFAULT_MAX_NEW_TOKENS - _TT - P.BUDGET_BUFFER})"
               f" / (n_authors + 1)) AS BIGINT) ELSE {MODEL_CONTEXT - P.DEFAULT_MAX_NEW_TOKENS - _TT - P.BUDGET_BUFFER} END")


@register("b16_token_budget", f"""WITH {_PS},
n AS (SELECT rep, count(DISTINCT label) AS n_authors FROM prompt_set GROUP BY rep)
SELECT rep, {_BUDGET_SQL} AS budget FROM n""")
def b16_token_budget(spark, sf):
    n = PR.authors_per_rep(_prompt_set(spark, sf))
    return n.select("rep", P.token_budget(F.col("n_authors"), _TT, MODEL_CONTEXT).alias("budget"))


_CROPPED = f"""{_PS},
n AS (SELECT rep, count(DISTINCT label) AS n_authors FROM prompt_set GROUP BY rep),
b AS (SELECT p.*, {_BUDGET_SQL} AS budget FROM prompt_set p JOIN n USING (rep)),
cropped AS (SELECT rep, label, budget, {O.crop('query_text', 'budget')} AS query_text,
                   {O.crop('example_text', 'budget')} AS example_text FROM b)"""


@register("b15_crop_to_budget", f"""WITH {_CROPPED}
SELECT rep, label, query_text, example_text, {O.tokens('query_text')} AS query_tokens FROM cropped""")
def b15_crop_to_budget(spark, sf):
    ps = _prompt_set(spark, sf)
    n = PR.authors_per_rep(ps)
    b = ps.join(n, "rep").withColumn("budget", P.token_budget(F.col("n_authors"), _TT, MODEL_CONTEXT))
    out = b.select("rep", "label", P.crop_to_budget("query_text", F.col("budget")).alias("query_text"),
                   P.crop_to_budget("example_text", F.col("budget")).alias("example_text"))
    return out.withColumn("query_tokens", T.count_tokens("query_text"))


@register("b17_render_prompt", f"""WITH {_CROPPED},
blocks AS (SELECT rep, string_agg('{P.EXAMPLE_WORD} ' || CAST(label AS VARCHAR) || ': ' || example_text,
                  chr(10) ORDER BY label) AS examples FROM cropped GROUP BY rep)
SELECT c.rep, c.label,
       {_last_content_sql(P.load_template(TEMPLATE), {'query_text': 'c.query_text', 'example_text': 'blocks.examples'})}
         AS prompt, {_messages_sql(P.load_template(TEMPLATE), {'query_text': 'c.query_text', 'example_text': 'blocks.examples'})}
         AS messages
FROM cropped c JOIN blocks USING (rep)""")
def b17_render_prompt(spark, sf):
    x = PR.prompt_inputs(_prompt_set(spark, sf), TEMPLATE, MODEL_CONTEXT)
    return x.select("rep", "label", F.element_at("messages", -1)["content"].alias("prompt"),
                    _messages_text("messages").alias("messages"))


# -- B18 / B18b over conversations with literal response sections ------------------
def _resp_spark(c):
    nl = F.lit("\n")
    return (F.when(F.col("role") == "assistant",
                   F.concat(F.lit("### Analýza:"), nl, F.col("text"), nl, F.lit("### VÝSLEDEK: autor "),
                            F.col("turn").cast("string")))
            .when(F.col("role") == "system",
                  F.concat(F.lit("###  analýza: "), F.col("role"), F.lit(" ### výsledek: "),
                           F.col("conv_id").cast("string"), F.lit(" ### Výsledek:\tAutor  "),
                           F.col("turn").cast("string"), F.lit(". ### Analýza: short ### Výsledek: x")))
            .otherwise(F.col("text")))


_RESP_SQL = ("CASE WHEN role = 'assistant' THEN '### Analýza:' || chr(10) || text || chr(10) || "
             "'### VÝSLEDEK: autor ' || CAST(turn AS VARCHAR) "
             "WHEN role = 'system' THEN '###  analýza: ' || role || ' ### výsledek: ' || CAST(conv_id AS VARCHAR) "
             "|| ' ### Výsledek:' || chr(9) || 'Autor  ' || CAST(turn AS VARCHAR) || '. ### Analýza: short ### Výsledek: x' "
             "ELSE text END")


def _parse_sql(t):
    a = f"list_extract(regexp_extract_all({t}, {O.q('(?i)' + P.ANALYSIS_PATTERN)}, 1), -1)"
    b = f"list_extract(regexp_extract_all({t}, {O.q('(?i)' + P.ANSWER_PATTERN)}, 1), -1)"
    return f"coalesce({a}, {t}) AS analysis, coalesce({b}, 'error') AS answer"


@register("b18_parse_response", f"""
SELECT conv_id, turn, {_parse_sql(_RESP_SQL)} FROM conversations""")
def b18_parse_response(spark, sf):
    c = read_table(spark, sf, "conversations")
    r = P.parse_response(_resp_spark(c))
    return c.select("conv_id", "turn", r["analysis"].alias("analysis"), r["answer"].alias("answer"))


@register("b18b_parse_json_response", """
WITH src AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN CAST(to_json({'analysis': text, 'answer': CAST(turn AS VARCHAR)}) AS VARCHAR)
             WHEN role = 'assistant' THEN NULL ELSE text END AS resp FROM conversations)
SELECT conv_id, turn,
  CASE WHEN resp IS NULL THEN 'error'
       WHEN json_valid(resp) AND json_extract_string(resp, '$.analysis') IS NOT NULL
            AND json_extract_string(resp, '$.answer') IS NOT NULL THEN json_extract_string(resp, '$.analysis')
       ELSE resp END AS analysis,
  CASE WHEN resp IS NULL THEN 'error'
       WHEN json_valid(resp) AND json_extract_string(resp, '$.analysis') IS NOT NULL
            AND json_extract_string(resp, '$.answer') IS NOT NULL THEN json_extract_string(resp, '$.answer')
       ELSE 'error' END AS answer
FROM src""")
def b18b_parse_json_response(spark, sf):
    c = read_table(spark, sf, "conversations")
    resp = (F.when(F.col("role") == "user",
                   F.to_json(F.struct(F.col("text").alias("analysis"), F.col("turn").cast("string").alias("answer"))))
            .when(F.col("role") == "assistant", F.lit(None).cast("string"))
            .otherwise(F.col("text")))
    r = P.parse_json_response(resp)
    return c.select("conv_id", "turn", r["analysis"].alias("analysis"), r["answer"].alias("answer"))


# -- I13: responses derived from the prompt set, scored per repetition -------------------
def _responses_spark(ps):
    wrong = ((F.col("label") + 1) % F.lit(N_AUTHORS)).cast("string")
    right = F.substring(F.md5(F.concat_ws("|", F.lit("resp"), F.col("rep").cast("string"),
                                          F.col("label").cast("string"))), 1, 1) < F.lit("a")
    pred = F.when(right, F.col("label").cast("string")).otherwise(wrong)
    text = (F.when(F.col("label") == 0, F.lit("no idea"))
            .otherwise(F.concat(F.lit("### Analýza: style ### Výsledek: autor "), pred)))
    return ps.select("rep", "label", text.alias("response"))


_RESP_PS_SQL = (f"CASE WHEN label = 0 THEN 'no idea' ELSE '### Analýza: style ### Výsledek: autor ' || "
                f"CASE WHEN substr(md5(concat_ws('|', 'resp', CAST(rep AS VARCHAR), CAST(label AS VARCHAR))), 1, 1) < 'a' "
                f"THEN CAST(label AS VARCHAR) ELSE CAST((label + 1) % {N_AUTHORS} AS VARCHAR) END END")

_MS = ", ".join(f"round(avg({m}), {R}) AS {m}_mean, round(stddev_pop({m}), {R}) AS {m}_std" for m in METRICS)


@register("i13_score_responses", f"""WITH {_PS},
resp AS (SELECT rep, label, {_RESP_PS_SQL} AS response FROM prompt_set),
parsed AS (SELECT CAST(rep AS VARCHAR) AS rep, CAST(label AS VARCHAR) AS y,
           coalesce(list_extract(regexp_extract_all(response, {O.q('(?i)' + P.ANSWER_PATTERN)}, 1), -1), 'error') AS p
           FROM resp),
{O.macro_metrics_ctes('parsed', 'rep')}
SELECT {_MS} FROM metrics""")
def i13_score_responses(spark, sf):
    _, summary = PR.score_responses(_responses_spark(_prompt_set(spark, sf)))
    return summary.select(*[F.round(c, R).alias(c) for c in summary.columns])


@register("a9_load_sft_set", f"""WITH {_PS}, {O.example_json_cte()},
resp AS (SELECT rep, label, {_RESP_PS_SQL} AS response FROM prompt_set),
rows AS (SELECT p.rep, p.label, p.query_text, ej.example_json, r.response FROM prompt_set p
         JOIN ej USING (rep) JOIN resp r ON r.rep = p.rep AND r.label = p.label),
rk AS (SELECT *, row_number() OVER (ORDER BY {O.hash_key("'sft'", O.vc('rep'), O.vc('label'))}, rep, label) - 1 AS r,
       count(*) OVER () AS n FROM rows)
SELECT rep, label, CASE WHEN r < n - ceil(0.1 * n) THEN 'train' ELSE 'test' END AS split,
       {O.q('<|system|>' + chr(10) + P.SFT_TEMPLATE[0]['content'] + chr(10) + '<|user|>' + chr(10))} ||
       {O.fill(P.SFT_TEMPLATE[1]['content'], {'query_text': 'query_text', 'example_text': "array_to_string(list_transform(map_entries(CAST(json(example_json) AS MAP(VARCHAR, VARCHAR))), lambda e: " + O.q(P.EXAMPLE_WORD + ' ') + " || e.key || ': ' || e.value), chr(10))"})}
       || chr(10) || '<|assistant|>' || chr(10) ||
       {O.fill(P.SFT_TEMPLATE[2]['content'], {'response': 'response', 'label': 'label'})} || chr(10) AS chat
FROM rk""")
def a9_load_sft_set(spark, sf):
    ps = _prompt_set(spark, sf)
    return PR.sft_rows(ps, _responses_spark(ps)).select("rep", "label", "split", "chat")


# -- B21: tokens per text cut at a model maximum -------------------------------------------
MAX_MODEL_TOKENS = 512


@register("b21_tokenize_truncate", f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, {O.q(T.TOKEN_PATTERN)})[1:{MAX_MODEL_TOKENS}]) AS INTEGER) AS n_kept,
       list_extract(regexp_extract_all(text, {O.q(T.TOKEN_PATTERN)})[1:{MAX_MODEL_TOKENS}], -1) AS last_token
FROM documents""")
def b21_tokenize_truncate(spark, sf):
    d = read_table(spark, sf, "documents")
    toks = T.tokenize_truncate("text", MAX_MODEL_TOKENS)
    return d.select("doc_id", F.size(toks).alias("n_kept"), F.try_element_at(toks, F.lit(-1)).alias("last_token"))
