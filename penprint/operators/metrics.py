"""Classification scores.

Macro precision / recall / F1 average over the *union* of true and predicted classes
with 0 on zero division (G7), so an unparseable answer such as ``error`` becomes a class
of its own that scores 0.  The data is reduced to a confusion table first (partial
aggregation, one row per group x true x predicted class), and everything after that runs
on the tiny table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("accuracy", "f1", "precision", "recall")


def confusion(df: DataFrame, y: str, p: str, group_cols=()) -> DataFrame:
    g = list(group_cols)
    return (df.select(*g, F.col(y).cast("string").alias("y"), F.col(p).cast("string").alias("p"))
            .groupBy(*g, "y", "p").agg(F.count(F.lit(1)).alias("c")))


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def macro_metrics(df: DataFrame, y: str, p: str, group_cols=()) -> DataFrame:
    """E5: ``(group..., accuracy, f1, precision, recall)`` per group."""
    g = list(group_cols)
    if not g:
        return macro_metrics(df.withColumn("_all", F.lit(0)), y, p, ["_all"]).drop("_all")
    conf = confusion(df, y, p, g)
    hit = (F.col("y") == F.col("p"))
    roles = F.array(
        F.struct(F.col("y").alias("cls"), F.when(hit, F.col("c")).otherwise(0).alias("tp"),
                 F.lit(0).cast("long").alias("fp"), F.when(~hit, F.col("c")).otherwise(0).alias("fn")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("tp"),
                 F.when(~hit, F.col("c")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")))
    per_class = (conf.select(*g, F.explode(roles).alias("r"))
                 .groupBy(*g, F.col("r.cls").alias("cls"))
                 .agg(F.sum("r.tp").alias("tp"), F.sum("r.fp").alias("fp"), F.sum("r.fn").alias("fn"))
                 .select(*g, "tp",
                         _safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                         _safe_div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                         _safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1")))
    macro = per_class.groupBy(*g).agg(F.avg("precision").alias("precision"),
                                      F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    acc = conf.groupBy(*g).agg((F.sum(F.when(F.col("y") == F.col("p"), F.col("c")).otherwise(0))
                                / F.sum("c")).alias("accuracy"))
    return macro.join(acc, g).select(*g, *METRICS)   # both sides: one row per group


def rep_mean_std(per_rep: DataFrame) -> DataFrame:
    """Mean and *population* standard deviation of each metric over repetitions."""
    aggs = []
    for m in METRICS:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return per_rep.agg(*aggs)


def argmax_class(scores) -> Column:
    """Index of the highest score, first maximum wins (as numpy)."""
    a = F.col(scores) if isinstance(scores, str) else scores
    return (F.array_position(a, F.array_max(a)) - 1).cast("long")


def label_dictionary(df: DataFrame, label: str = "label") -> DataFrame:
    """Sorted distinct labels -> dense 0-based ids (both directions in one table).

    The rank is bucketed at labels sampled from the table, so a large table is never
    sorted in one task, whatever prefixes its labels share."""
    from penprint.operators.ranking import rank_in_group
    labels = df.select(F.col(label).cast("string").alias("label")).distinct()
    ranked = rank_in_group(labels, [], ["label"], "label", "range", rank_col="_r")
    return ranked.select("label", F.col("_r").cast("int").alias("label_id"))
