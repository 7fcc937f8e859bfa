"""Properties and edge cases of the relational operators (SURVEY F2, F3, F4, F7, D4, E5,
E6, ranking)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from penprint.operators import collect as C
from penprint.operators import metrics as M
from penprint.operators import sampling as S
from penprint.operators.ranking import hash_key, rank_in_group


def _one_author(spark, n):
    return spark.createDataFrame([(i, "a", f"t{i}") for i in range(n)], "doc_id long, label string, text string")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 90, 170, 180])
def test_split_sizes_truncate_like_python(spark, n):
    got = {r["split"]: r["c"] for r in S.stratified_split(_one_author(spark, n))
           .groupBy("split").agg(F.count(F.lit(1)).alias("c")).collect()}
    c1, c2 = S.cut_points(S.DEFAULT_SPLIT)
    train, val = int(c1 * n), int(c2 * n) - int(c1 * n)
    assert got.get("train", 0) == train
    assert got.get("val", 0) == val
    assert got.get("test", 0) == n - train - val


def test_split_disjoint_complete_and_partition_independent(spark):
    df = spark.createDataFrame([(i, f"a{i % 3}", "x") for i in range(500)], "doc_id long, label string, text string")
    a = {(r.doc_id, r.split) for r in S.stratified_split(df).collect()}
    b = {(r.doc_id, r.split) for r in S.stratified_split(df.repartition(7)).collect()}
    assert a == b
    assert {d for d, _ in a} == set(range(500))


def test_rank_in_group_exact_with_many_buckets(spark):
    # Force many buckets per group: ranks must still be a permutation in key order.
    df = spark.range(0, 3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("string").alias("g"))
    df = df.withColumn("_key", hash_key(7, "doc_id"))
    r = rank_in_group(df, ["g"], ["_key", "doc_id"], "_key", "hex").collect()
    for g in ("0", "1"):
        rows = sorted((x["_key"], x["doc_id"], x["_rank"]) for x in r if x["g"] == g)
        assert [x[2] for x in rows] == list(range(len(rows)))


def test_rank_in_group_range_buckets(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("doc_id"), F.lit("u").alias("g"),
                                     (F.col("id") * 7 % 1000).alias("v"))
    r = rank_in_group(df, ["g"], ["v", "doc_id"], "v", "range").collect()
    rows = sorted((x["v"], x["doc_id"], x["_rank"]) for x in r)
    assert [x[2] for x in rows] == list(range(1000))


def test_out_of_class_needs_other_authors(spark):
    ranked = spark.createDataFrame([("a", 5, 0), ("b", 4, 1)], "label string, n_texts long, author_rank int")
    with pytest.raises(ValueError):
        S.require_others(ranked, 2)


def test_limit_must_be_positive(spark):
    with pytest.raises(ValueError):
        S.limit_per_author(_one_author(spark, 3), 0)


def _metrics(spark, pairs):
    df = spark.createDataFrame(pairs, "y string, p string")
    return M.macro_metrics(df, "y", "p").first().asDict()


def test_macro_metrics_perfect(spark):
    m = _metrics(spark, [("a", "a"), ("b", "b")])
    assert m == {"accuracy": 1.0, "f1": 1.0, "precision": 1.0, "recall": 1.0}


def test_macro_metrics_all_wrong(spark):
    m = _metrics(spark, [("a", "b"), ("b", "a")])
    assert m == {"accuracy": 0.0, "f1": 0.0, "precision": 0.0, "recall": 0.0}


def test_macro_metrics_unseen_prediction_is_a_class(spark):
    m = _metrics(spark, [("a", "a"), ("a", "error"), ("b", "b")])
    assert m["accuracy"] == pytest.approx(2 / 3)
    assert m["precision"] == pytest.approx(2 / 3)
    assert m["recall"] == pytest.approx(0.5)
    assert m["f1"] == pytest.approx((2 / 3 + 1) / 3)


def test_rep_mean_std_population(spark):
    per_rep = spark.createDataFrame([(0.5, 0.5, 0.5, 0.5), (1.0, 1.0, 1.0, 1.0)],
                                    "accuracy double, f1 double, precision double, recall double")
    r = M.rep_mean_std(per_rep).first()
    assert r["accuracy_mean"] == pytest.approx(0.75)
    assert r["accuracy_std"] == pytest.approx(0.25)      # population, not sample


def _items(spark, n=25):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(1, i, t0 + dt.timedelta(minutes=i)) for i in range(n)],
                                 "user_id long, event_id long, ts timestamp")


def test_paged_quota_overshoots_by_a_page(spark):
    out = C.paged_quota(_items(spark), "user_id", ["ts", "event_id"], F.lit(True), 15)
    assert out.count() == 20


def test_paged_quota_zero_means_default_and_none_unbounded(spark):
    assert C.paged_quota(_items(spark), "user_id", ["ts", "event_id"], F.lit(True), 0,
                         default_limit=C.MAX_REVIEWS_PER_USER).count() == 25
    assert C.paged_quota(_items(spark), "user_id", ["ts", "event_id"], F.lit(True), None).count() == 25


def test_comment_tree_prunes_below_invalid(spark):
    long = "a comment that is long enough to keep"
    conv = spark.createDataFrame([
        (1, 0, "alice", long), (1, 1, "bob", "ok"), (1, 2, "carol", long),
        (1, 3, "AutoModerator", long), (1, 4, "dave", long)],
        "conv_id long, turn long, role string, text string")
    rows = C.forum_rows(conv, F.col("role")).collect()
    got = sorted(r["item_id"] for r in rows)
    # turn 1 is valid but too short: not emitted, still descended; turn 3 prunes turn 4
    assert got == ["1_0", "1_2"]


def test_first_seen_prefers_priority(spark):
    t0 = dt.datetime(2024, 1, 1)
    lst = spark.createDataFrame([(10, t0, 7, 1), (11, t0 - dt.timedelta(days=1), 7, 2), (12, t0, 8, 3)],
                                "event_id long, ts timestamp, item_id long, priority int")
    got = {r["item_id"]: r["event_id"] for r in C.first_seen(lst).collect()}
    assert got == {7: 10, 8: 12}


def test_pending_items(spark):
    frontier = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    done = spark.createDataFrame([(2,)], "id long")
    assert sorted(r.id for r in C.pending_items(frontier, done, "id").collect()) == [1, 3]


def test_author_rank_ties_by_label(spark):
    counts = spark.createDataFrame([("b", 5), ("a", 5), ("c", 7), ("d", 1)], "label string, n_texts long")
    got = {r["label"]: r["author_rank"] for r in S.author_rank(counts).collect()}
    assert got == {"c": 0, "a": 1, "b": 2, "d": 3}


def test_label_dictionary_orders_bytes_with_many_buckets(spark):
    labels = ["b", "a", "ab", "abcdefghij", "abcdefgh", "é", "Z", "a"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    got = [r["label"] for r in M.label_dictionary(df).orderBy("label_id").collect()]
    assert got == sorted(set(labels), key=lambda s: s.encode("utf-8"))
