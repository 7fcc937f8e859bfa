"""Seeded hash keys and exact, skew-proof ranking within groups.

``row_number() over (partition by g order by k)`` puts a whole group into one task; with
one author holding a third of the corpus that task is a third of the job.  Here every
group is cut into buckets by a *monotone* function of its sort key: the leading hex digits
of an md5 key, or else bounds sampled from the group itself by the hash of the key.  Bucket
sizes are counted with partial (map-side) aggregation, bucket offsets come from a window
over that small count table, and the final ``row_number`` runs per (group, bucket).  There
is one plan for every size, it is lazy, and both steps evaluate the same deterministic
bucket.  Groups are compared null-safe, so rows of a null group are ranked like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SEED = 42
HEX_DIGITS = 3                # leading digits of an md5 key: 4,096 even buckets a group
BOUNDS = 64                   # bounds sampled from a group whose key is not a hash


def hash_key(seed, *cols) -> Column:
    """``md5(seed|c1|c2|...)`` as lowercase hex; DuckDB's ``md5`` returns the same string."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                  for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def _same_groups(cols: list[str], renamed: list[str]) -> Column:
    cond = F.lit(True)
    for c, r in zip(cols, renamed):
        cond = cond & F.col(c).eqNullSafe(F.col(r))
    return cond


def _with_bucket(df: DataFrame, groups: list[str], key: str, kind: str) -> DataFrame:
    """``_b``: a bucket monotone in ``key`` within each group (nulls in bucket 0)."""
    if kind == "hex":
        digits = F.conv(F.substring(F.col(key), 1, HEX_DIGITS), 16, 10).cast("long")
        return df.withColumn("_b", F.coalesce(digits, F.lit(0)))
    drawn = (df.select(*groups, key).where(F.col(key).isNotNull())
             .withColumn("_h", F.xxhash64(F.lit(7), F.col(key))))
    drawn = first_k_in_group(drawn, groups, ["_h", key], BOUNDS, rank_col="_rn")
    names = [f"_bg{i}" for i in range(len(groups))]
    bounds = drawn.groupBy(*[F.col(g).alias(n) for g, n in zip(groups, names)]) \
        .agg(F.sort_array(F.collect_set(key)).alias("_bounds"))      # BOUNDS keys a group at most
    x = df.join(bounds, _same_groups(groups, names), "left").drop(*names)
    below = F.size(F.filter("_bounds", lambda v: v < F.col(key)))
    return x.withColumn("_b", F.coalesce(F.when(F.col(key).isNotNull() & F.col("_bounds").isNotNull(), below),
                                         F.lit(0)).cast("long")).drop("_bounds")


def rank_in_group(df: DataFrame, group_cols: list[str], order_cols: list[str],
                  bucket_col: str | None = None, bucket_kind: str = "hex",
                  rank_col: str = "_rank", size_col: str = "_group_n") -> DataFrame:
    """Add ``rank_col`` (0-based position by ``order_cols`` asc within the group) and
    ``size_col`` (group size).

    ``bucket_col`` must be the leading sort column: a hex string (``bucket_kind='hex'``,
    e.g. an md5 key) or any orderable value (``'range'``).  ``order_cols`` must be unique
    within a group for the rank to be deterministic.
    """
    groups = list(group_cols) or ["_all"]
    base = df if group_cols else df.withColumn("_all", F.lit(0))
    x = _with_bucket(base, groups, bucket_col or order_cols[0], bucket_kind)
    names = [f"_sg{i}" for i in range(len(groups))]
    sizes = x.groupBy(*[F.col(g).alias(n) for g, n in zip(groups, names)], F.col("_b").alias("_sb")) \
        .agg(F.count(F.lit(1)).alias("_bn"))
    whole = Window.partitionBy(*names)
    before = whole.orderBy("_sb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sizes.withColumn(size_col, F.sum("_bn").over(whole))
               .withColumn("_off", F.coalesce(F.sum("_bn").over(before), F.lit(0))).drop("_bn"))
    w = Window.partitionBy(*groups, "_b").orderBy(*order_cols)
    x = x.withColumn("_rn_b", F.row_number().over(w))
    x = x.join(offsets, _same_groups(groups, names) & (F.col("_b") == F.col("_sb")))
    x = x.withColumn(rank_col, (F.col("_off") + F.col("_rn_b") - 1).cast("long"))
    return x.drop("_b", "_sb", "_off", "_rn_b", *names, *([] if group_cols else ["_all"]))


def first_k_in_group(df: DataFrame, group_cols: list[str], order_cols: list, k: int,
                     rank_col: str = "_rn") -> DataFrame:
    """Top-k rows per group for a small literal ``k``.

    ``row_number() <= k`` lets Catalyst insert a partial WindowGroupLimit before the
    shuffle, so each map task forwards at most ``k`` rows per group: skew-proof.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
