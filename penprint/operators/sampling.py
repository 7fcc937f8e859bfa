"""Author ranking, selection and seeded sampling.

All randomness of the reference is replaced by ordering on ``md5(seed|...)``, which is
reproducible, independent of partitioning and identical in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penprint.operators.ranking import DEFAULT_SEED, first_k_in_group, hash_key, rank_in_group

DEFAULT_SPLIT = (0.7, 0.15, 0.15)
SPLIT_NAMES = ("train", "val", "test")
PARTIAL_LIMIT = 100       # limits for which every map task may forward that many rows a group


def check_split(split) -> tuple[float, ...]:
    if sum(split) != 1:
        raise ValueError(f"split fractions {tuple(split)} do not add up to 1")
    return tuple(float(s) for s in split)


def cut_points(split) -> list[float]:
    """Cumulative fractions, summed exactly like the reference (float additions)."""
    return [sum(split[: i + 1]) for i in range(len(split) - 1)]


def author_counts(corpus: DataFrame) -> DataFrame:
    """Texts per author (partial aggregation; the result has one row per author)."""
    return corpus.groupBy("label").agg(F.count(F.lit(1)).alias("n_texts"))


def author_rank(counts: DataFrame) -> DataFrame:
    """0-based rank by count desc, label asc (explicit tie-break).

    Runs on the per-author count table.  Authors of equal count are one group, ranked by
    label in buckets (a long tail of one-text authors is never sorted in one task); a
    prefix sum over the distinct counts, of which N texts allow fewer than sqrt(2N),
    gives each group its place.
    """
    ties = rank_in_group(counts, ["n_texts"], ["label"], "label", "range", rank_col="_r")
    larger = Window.orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, -1)
    before = (counts.groupBy(F.col("n_texts").alias("_n")).agg(F.count(F.lit(1)).alias("_same"))
              .select("_n", F.coalesce(F.sum("_same").over(larger), F.lit(0)).alias("_before")))
    return (ties.join(before, F.col("n_texts") == F.col("_n"))
            .withColumn("author_rank", (F.col("_before") + F.col("_r")).cast("int"))
            .drop("_n", "_before", "_r", "_group_n"))


def top_authors(ranked: DataFrame, n: int) -> DataFrame:
    """G-1: the first ``n`` authors."""
    return ranked.filter(F.col("author_rank") < n)


def restrict_to(df: DataFrame, authors: DataFrame) -> DataFrame:
    """Rows of the selected authors.  ``authors`` holds at most ``n`` rows (a
    parameter), so broadcasting it is size-safe."""
    return df.join(F.broadcast(authors.select("label")), "label", "left_semi")


def exclude(df: DataFrame, authors: DataFrame) -> DataFrame:
    """Rows of authors *not* in ``authors`` (bounded by ``n``, broadcast)."""
    return df.join(F.broadcast(authors.select("label")), "label", "left_anti")


def limit_per_author(df: DataFrame, limit: int | None) -> DataFrame:
    """the first ``limit`` texts of each author in file (doc_id) order."""
    if limit is None:
        return df
    if limit < 1:
        raise ValueError(f"a limit per author must be positive, got {limit}")
    if limit <= PARTIAL_LIMIT:
        return first_k_in_group(df, ["label"], ["doc_id"], limit).drop("_rn")
    ranked = rank_in_group(df.select("doc_id", "label"), ["label"], ["doc_id"], "doc_id", "range")
    keep = ranked.filter(F.col("_rank") < limit).select("doc_id")
    return df.join(keep, "doc_id", "left_semi")


def split_column(rank, size, split) -> "F.Column":
    """F2 cut: ``rank < int(c1*n)`` -> train, ``< int(c2*n)`` -> val, else test.

    The products are DOUBLE (G8: ``int(0.7*90)`` is 62) and truncated.
    """
    cuts = cut_points(split)
    expr = None
    for name, c in zip(SPLIT_NAMES, cuts):
        bound = F.floor(F.lit(float(c)) * size.cast("double")).cast("long")
        cond = rank < bound
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(SPLIT_NAMES[len(cuts)]))


def stratified_split(df: DataFrame, split=DEFAULT_SPLIT, seed=DEFAULT_SEED,
                     group_cols=("label",), key_cols=("label", "doc_id")) -> DataFrame:
    """shuffle each group by ``md5(seed|key)`` and cut it 70/15/15."""
    split = check_split(split)
    keyed = df.withColumn("_key", hash_key(seed, *key_cols))
    ranked = rank_in_group(keyed, list(group_cols), ["_key", "doc_id"], "_key", "hex")
    return (ranked.withColumn("split", split_column(F.col("_rank"), F.col("_group_n"), split))
            .drop("_key", "_rank", "_group_n"))


def out_of_class_pool(corpus: DataFrame, ranked_authors: DataFrame, n: int,
                      seed=DEFAULT_SEED) -> DataFrame:
    """F3 pool: from every non-selected author, ``ceil(count(author n-1) / #others)``
    random texts (counted on the unlimited frame), relabelled ``str(n)``.
    """
    stats = (ranked_authors.agg(
        F.max(F.when(F.col("author_rank") == n - 1, F.col("n_texts"))).alias("last_n"),
        F.count(F.when(F.col("author_rank") >= n, 1)).alias("n_other"))
        .withColumn("k", F.when(F.col("n_other") > 0,
                                F.ceil(F.col("last_n") / F.col("n_other")).cast("long"))))
    # ``stats`` is one row: attach it to the non-selected authors with a broadcast
    # equi-join on a constant key.
    others = (ranked_authors.filter(F.col("author_rank") >= n).select("label")
              .withColumn("_one", F.lit(1))
              .join(F.broadcast(stats.select("k").withColumn("_one", F.lit(1))), "_one")
              .drop("_one"))
    pool = corpus.join(others, "label")              # AQE picks the join from real sizes
    pool = pool.withColumn("_key", hash_key(seed, F.lit("ooc"), "label", "doc_id"))
    ranked = rank_in_group(pool, ["label"], ["_key", "doc_id"], "_key", "hex")
    return (ranked.filter(F.col("_rank") < F.col("k"))
            .select("doc_id", F.lit(str(n)).alias("label"), *[c for c in corpus.columns
                                                               if c not in ("doc_id", "label")]))


def out_of_class_pools(corpus: DataFrame, ranked_authors: DataFrame, ns: list[int], seed=DEFAULT_SEED) -> DataFrame:
    """F3 pools for several N: ``(n, doc_id)``, for each N the rows of ``out_of_class_pool``.  Each
    author's texts are ranked once; every N takes its own share of the authors beyond it."""
    counts = [F.struct(F.lit(n).alias("n"),
                       F.max(F.when(F.col("author_rank") == n - 1, F.col("n_texts"))).alias("last_n"),
                       F.count(F.when(F.col("author_rank") >= n, 1)).alias("n_other")) for n in ns]
    shares = F.transform("_counts", lambda c: F.struct(
        c["n"].alias("n"), F.when(c["n_other"] > 0, F.ceil(c["last_n"] / c["n_other"])).cast("long").alias("k")))
    # One row, of one entry an N.
    shares = ranked_authors.agg(F.array(*counts).alias("_counts")).select(shares.alias("_shares"), F.lit(1).alias("_one"))
    others = ranked_authors.filter(F.col("author_rank") >= min(ns)).select("label", "author_rank")
    pool = corpus.select("doc_id", "label").join(others, "label").withColumn("_key", hash_key(seed, F.lit("ooc"), "label", "doc_id"))
    ranked = rank_in_group(pool, ["label"], ["_key", "doc_id"], "_key", "hex").withColumn("_one", F.lit(1))
    due = F.filter("_shares", lambda s: (F.col("author_rank") >= s["n"]) & (F.col("_rank") < s["k"]))
    return ranked.join(F.broadcast(shares), "_one").select(F.explode(F.transform(due, lambda s: s["n"])).alias("n"), "doc_id")


def require_others(ranked_authors: DataFrame, n: int) -> None:
    """The reference divides by the number of non-selected authors."""
    if ranked_authors.filter(F.col("author_rank") >= n).limit(1).count() == 0:
        raise ValueError("no author is left for out-of-class texts")


def apply_label_map(df: DataFrame, ranked_authors: DataFrame) -> DataFrame:
    """Replace an author by its rank string; unknown labels stay as they are.
    ``ranked_authors`` holds the selected authors, at most ``n`` rows (a parameter)."""
    m = ranked_authors.select(F.col("label").alias("_from"),
                              F.col("author_rank").cast("string").alias("_to"))
    return (df.join(F.broadcast(m), df["label"] == m["_from"], "left")
            .withColumn("label", F.coalesce(F.col("_to"), F.col("label")))
            .drop("_from", "_to"))
