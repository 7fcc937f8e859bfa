"""Registered queries: sinks written to the shared scratch folder and read back
(SURVEY A2, A3, A4, A5, A6, A8).  Each SQL twin is the frame that was written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from penprint import oracles as O
from penprint.catalog import register
from penprint.functions import prompts as P
from penprint.operators import prompting as PR
from penprint.plans import dataset as D
from penprint.plans import queries_collect as QC
from penprint.plans.queries_core import N_AUTHORS, _clean
from penprint.plans.queries_features import _round_all, _style_sql_round
from penprint.plans.queries_prompting import _PS, _prompt_set, _responses_spark
from penprint.session import shared_dir
from penprint.sources.corpus import load_corpus, split_text_features


def _scratch(spark) -> str:
    return f"{shared_dir(spark)}/sinks/{uuid.uuid4().hex}"


@register("a2_write_splits", f"WITH {O.dataset_ctes(N_AUTHORS)} SELECT doc_id, label, split FROM dataset")
def a2_write_splits(spark, sf):
    ds = D.create_dataset(_clean(spark, sf), N_AUTHORS)
    path = D.write_splits(ds, _scratch(spark), N_AUTHORS)
    back = spark.read.parquet(path)
    return back.select("doc_id", "label", "split")


@register("a3_export_requests", f"""WITH {_PS}, {O.example_json_cte()},
rows AS (SELECT p.*, ej.example_json FROM prompt_set p JOIN ej USING (rep)),
num AS (SELECT *, row_number() OVER (ORDER BY {O.hash_key("'shuffle'", O.vc('rep'), O.vc('label'))},
               rep, label) - 1 AS request_idx FROM rows)
SELECT 'request_' || CAST(request_idx AS VARCHAR) AS custom_id, '{P.REQUEST_METHOD}' AS method,
       '{P.REQUEST_URL}' AS url, '{P.REQUEST_MODEL}' AS model, {P.REQUEST_MAX_TOKENS} AS max_tokens,
       CAST({P.REQUEST_TEMPERATURE} AS DOUBLE) AS temperature, {len(P.FINETUNE_REQUEST_TEMPLATE)} AS n_messages
FROM num""")
def a3_export_requests(spark, sf):
    path = _scratch(spark)
    PR.export_requests(PR.finetune_requests(_prompt_set(spark, sf)), path)
    schema = ("custom_id string, method string, url string, body struct<model: string, "
              "messages: array<struct<role: string, content: string>>, max_tokens: int, temperature: double>")
    j = spark.read.text(path).select(F.from_json("value", schema).alias("r"))
    return j.select("r.custom_id", "r.method", "r.url", F.col("r.body.model").alias("model"),
                    F.col("r.body.max_tokens").alias("max_tokens"),
                    F.col("r.body.temperature").alias("temperature"),
                    F.size("r.body.messages").alias("n_messages"))


@register("a4_prompt_set_roundtrip", f"WITH {_PS} SELECT rep, label, query_text, example_text FROM prompt_set")
def a4_prompt_set_roundtrip(spark, sf):
    path = _scratch(spark)
    PR.write_prompt_set(_prompt_set(spark, sf), path)
    df, n = PR.read_prompt_set(spark, path)
    assert n == N_AUTHORS
    return df


@register("a5_write_results", f"""WITH {_PS},
resp AS (SELECT rep, label, CASE WHEN label = 0 THEN 'no idea' ELSE '### Analýza: style ### Výsledek: autor ' ||
  CASE WHEN substr(md5(concat_ws('|', 'resp', CAST(rep AS VARCHAR), CAST(label AS VARCHAR))), 1, 1) < 'a'
  THEN CAST(label AS VARCHAR) ELSE CAST((label + 1) % {N_AUTHORS} AS VARCHAR) END END AS response FROM prompt_set)
SELECT CAST(rep AS VARCHAR) AS rep, CAST(label AS VARCHAR) AS label,
       coalesce(list_extract(regexp_extract_all(response, {O.q('(?i)' + P.ANSWER_PATTERN)}, 1), -1), 'error') AS answer
FROM resp""")
def a5_write_results(spark, sf):
    rows, summary = PR.score_responses(_responses_spark(_prompt_set(spark, sf)))
    path = _scratch(spark)
    PR.write_results(rows, summary, path)
    assert spark.read.json(f"{path}/summary").count() == 1
    return spark.read.schema("analysis string, answer string, label string, rep string") \
        .json(f"{path}/data").select("rep", "label", "answer")


@register("a6_append_corpus", f"""{QC._TREE_SQL},
x AS (SELECT c.conv_id, c.turn, {QC._AUTHOR_SQL} AS author, c.text, w.blocked FROM conversations c
      JOIN walk w ON c.conv_id = w.conv_id AND c.turn = w.turn),
k AS (SELECT author, {O.author_text(O.strip_markdown('text'))} AS text FROM x
      WHERE CASE WHEN turn = 0 THEN {QC._valid_author_sql('author')} AND text <> '' ELSE NOT blocked END)
SELECT DISTINCT author AS label, text FROM k WHERE text IS NOT NULL""")
def a6_append_corpus(spark, sf):
    from penprint.sources.corpus import read_table
    from penprint.operators import collect as C
    rows = C.forum_rows(read_table(spark, sf, "conversations"), QC._author_spark())
    path = _scratch(spark)
    for _ in range(2):   # a resumed crawl appends again, header included
        rows.write.mode("append").option("header", True).option("escape", '"').csv(path)
    return load_corpus(spark, path).select("label", "text")


@register("a8_split_text_features", f"""
WITH {O.dataset_ctes(N_AUTHORS)}
SELECT doc_id, split,
  {_style_sql_round()}
FROM dataset""")
def a8_split_text_features(spark, sf):
    ds = D.create_dataset(_clean(spark, sf), N_AUTHORS, add_text_features=True)
    _, feats = split_text_features(ds)
    return _round_all(feats, ["doc_id", "split"])
