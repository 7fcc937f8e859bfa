"""Registered queries: scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from penprint import oracles as O
from penprint.catalog import register
from penprint.operators import metrics as M
from penprint.sources.corpus import read_table

R = 9
N_REPS = 3   # labels: repetition := doc_id % 3 (derived column, every row kept)


def _rounded(df, keep):
    return df.select(*keep, *[F.round(c, R).alias(c) for c in df.columns if c not in keep])


def _metrics_sql(source_ctes: str, group: str | None, select: str) -> str:
    return f"WITH {source_ctes}, {O.macro_metrics_ctes('src', group)} {select}"


_ROUND4 = ", ".join(f"round({m}, {R}) AS {m}" for m in M.METRICS)


@register("e5_macro_metrics", _metrics_sql(
    "src AS (SELECT CAST(quality AS VARCHAR) AS y, CAST(toxic AS VARCHAR) AS p FROM labels)",
    None, f"SELECT {_ROUND4} FROM metrics"))
def e5_macro_metrics(spark, sf):
    lab = read_table(spark, sf, "labels")
    return _rounded(M.macro_metrics(lab, "quality", "toxic"), [])


@register("e5_macro_metrics_unseen_class", _metrics_sql(
    "src AS (SELECT CAST(quality AS VARCHAR) AS y, "
    "CASE WHEN toxic = 1 THEN 'error' ELSE CAST(quality AS VARCHAR) END AS p FROM labels)",
    None, f"SELECT {_ROUND4} FROM metrics"))
def e5_macro_metrics_unseen_class(spark, sf):
    lab = read_table(spark, sf, "labels").withColumn(
        "answer", F.when(F.col("toxic") == 1, F.lit("error")).otherwise(F.col("quality").cast("string")))
    return _rounded(M.macro_metrics(lab, "quality", "answer"), [])


@register("e5_metrics_per_rep", _metrics_sql(
    f"src AS (SELECT CAST(doc_id % {N_REPS} AS VARCHAR) AS rep, CAST(quality AS VARCHAR) AS y, "
    "CAST(toxic AS VARCHAR) AS p FROM labels)",
    "rep", f"SELECT grp AS rep, {_ROUND4} FROM metrics"))
def e5_metrics_per_rep(spark, sf):
    lab = read_table(spark, sf, "labels").withColumn("rep", (F.col("doc_id") % N_REPS).cast("string"))
    return _rounded(M.macro_metrics(lab, "quality", "toxic", ["rep"]), ["rep"])


_MS = ", ".join(f"round(avg({m}), {R}) AS {m}_mean, round(stddev_pop({m}), {R}) AS {m}_std"
                for m in M.METRICS)


@register("e6_rep_mean_std", _metrics_sql(
    f"src AS (SELECT CAST(doc_id % {N_REPS} AS VARCHAR) AS rep, CAST(quality AS VARCHAR) AS y, "
    "CAST(toxic AS VARCHAR) AS p FROM labels)",
    "rep", f"SELECT {_MS} FROM metrics"))
def e6_rep_mean_std(spark, sf):
    lab = read_table(spark, sf, "labels").withColumn("rep", (F.col("doc_id") % N_REPS).cast("string"))
    per_rep = M.macro_metrics(lab, "quality", "toxic", ["rep"])
    return _rounded(M.rep_mean_std(per_rep), [])


@register("b20_argmax_class", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS argmax,
       label FROM embeddings""")
def b20_argmax_class(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", M.argmax_class("embedding").alias("argmax"), "label")


@register("e10_label_dictionary", """
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id
FROM (SELECT DISTINCT source AS label FROM documents)""")
def e10_label_dictionary(spark, sf):
    d = read_table(spark, sf, "documents").select(F.col("source").alias("label"))
    return M.label_dictionary(d)
