"""Ranking on hard groups, request bodies, class counts, reply trees, loaders, page parts."""

import math

import pytest
from pyspark.sql import functions as F

from penprint.functions import html as H
from penprint.operators import collect as C
from penprint.operators import metrics as M
from penprint.operators import ml as ML
from penprint.operators import prompting as PR
from penprint.operators import sampling as S
from penprint.operators.ranking import hash_key, rank_in_group
from penprint.sources.corpus import load_corpus



@pytest.mark.parametrize("kind", ["hex", "range"])
def test_rank_keeps_null_groups(spark, kind):
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("a")).alias("g"))
    df = df.withColumn("k", hash_key(1, "doc_id") if kind == "hex" else F.lit(600) - F.col("doc_id"))
    rows = rank_in_group(df, ["g"], ["k", "doc_id"], "k", kind).collect()
    assert len(rows) == 600
    for g in (None, "a"):
        mine = sorted((r.k, r.doc_id, r._rank, r._group_n) for r in rows if r.g == g)
        assert [x[2] for x in mine] == list(range(len(mine))) and {x[3] for x in mine} == {len(mine)}


def test_rank_null_keys_first(spark):
    df = spark.createDataFrame([(i, None if i < 5 else i) for i in range(200)], "doc_id long, v long")
    rows = {r.doc_id: r._rank for r in rank_in_group(df, [], ["v", "doc_id"], "v", "range").collect()}
    assert rows == {i: i for i in range(200)}


def test_rank_buckets_are_even(spark):
    from penprint.operators.ranking import BOUNDS, _with_bucket
    urls = spark.range(8000).select(F.concat(F.lit("https://example.com/users/"), F.lpad(F.col("id").cast("string"), 6, "0"))
                                    .alias("label")).withColumn("_all", F.lit(0))
    sizes = [r["count"] for r in _with_bucket(urls, ["_all"], "label", "range").groupBy("_b").count().collect()]
    assert len(sizes) == BOUNDS + 1 and max(sizes) < 10 * sum(sizes) / len(sizes)
    got = [r.label for r in M.label_dictionary(urls).orderBy("label_id").collect()]
    assert got == sorted(got) and len(got) == 8000


def test_author_rank_long_tail(spark):
    counts = spark.range(3000).select(F.format_string("u%05d", "id").alias("label"),
                                      F.when(F.col("id") < 10, F.col("id") * 50 + 2).otherwise(1).alias("n_texts"))
    got = S.author_rank(counts).collect()
    want = sorted(((-r.n_texts, r.label) for r in got))
    assert [(-r.n_texts, r.label) for r in sorted(got, key=lambda r: r.author_rank)] == want
    assert sorted(r.author_rank for r in got) == list(range(3000))


def test_finetune_requests_hold_their_texts(spark):
    rows = [(rep, k, f"author{k}", f"query {rep} {k}", f"example {rep} {k}") for rep in range(2) for k in range(3)]
    ps = spark.createDataFrame(rows, "rep int, label int, author string, query_text string, example_text string")
    for r in PR.finetune_requests(ps).collect():
        last = r.body.messages[-1]
        assert last.role == "user" and r.query_text in last.content
        assert all(f"example {r.rep} {k}" in last.content for k in range(3)) and f"autor {r.label}" in last.content
        assert not any(x in m.content for m in r.body.messages for x in ("{query_text}", "{example_text}", "{correct_author}"))


def test_prompt_arguments_are_checked(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, label string, text string")
    for n, reps in ((1, 1), (2, 0)):
        with pytest.raises(ValueError):
            PR.sample_two_per_author(df, n, reps)


def test_classifier_has_the_known_classes_only(spark):
    rows = [(i, "abc"[i % 3], float(i % 3), float(i % 7)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, label string, x1 double, x2 double")
    model = ML.fit_classifier(df, ["x1", "x2"])
    unseen = spark.createDataFrame([(99, "zzz", 1.0, 1.0)], df.schema)
    assert model.stages[-1].numClasses == 3
    for r in ML.predictions(model, df.unionByName(unseen)).collect():
        assert len(r.proba) == 3 and math.isclose(sum(r.proba), 1, abs_tol=1e-9)
        assert r.predicted == "abc"[max(range(3), key=lambda k: r.proba[k])]


def test_orphans_are_blocked_and_cycles_raise(spark):
    nodes = spark.createDataFrame([(0, None, False), (1, 0, False), (3, 2, False), (4, 3, False), (5, 1, True), (6, 5, False)],
                                  "id long, parent long, bad boolean")
    got = {r.id: r.blocked for r in C.prune_tree(nodes, ["id"], ["parent"], F.col("bad")).collect()}
    assert got == {0: False, 1: False, 3: True, 4: True, 5: True, 6: True}
    ring = spark.createDataFrame([(1, 2, False), (2, 1, False), (3, None, False)], nodes.schema)
    with pytest.raises(ValueError):
        C.prune_tree(ring, ["id"], ["parent"], F.col("bad"))


def test_forum_language_check(spark):
    text = "a text that is long enough to be kept by the rules"
    conv = spark.createDataFrame([(1, 0, "user", text, "en"), (2, 0, "user", text, "fr")],
                                 "conv_id long, turn long, role string, text string, lang string")
    got = C.forum_rows(conv, F.col("role"), F.col("lang"), ["en"]).collect()
    assert [r.item_id for r in got] == ["1_0"]


def test_corpus_ids_do_not_depend_on_files(spark, tmp_path):
    df = spark.createDataFrame([(f"a{i % 3}", f"text {i}") for i in range(60)], "author string, text string")
    found = []
    for n in (1, 3):
        df.repartition(n).write.parquet(str(tmp_path / str(n)))
        found.append({(r.doc_id, r.label, r.text) for r in load_corpus(spark, str(tmp_path / str(n)), "parquet").collect()})
    assert found[0] == found[1] and len({d for d, _, _ in found[0]}) == 60


def test_label_corpus_dedups_on_every_column(spark, tmp_path):
    rows = [("a", "t", 1), ("a", "t", 2), ("a", "t", 2)]
    spark.createDataFrame(rows, "label string, text string, post_id int").write.parquet(str(tmp_path / "l"))
    assert load_corpus(spark, str(tmp_path / "l"), "parquet").count() == 2
    spark.createDataFrame(rows, "author string, text string, post_id int").write.parquet(str(tmp_path / "a"))
    assert load_corpus(spark, str(tmp_path / "a"), "parquet").count() == 1


def test_every_container_and_section_is_read(spark):
    page = ('<html><nav><a href="/a">1</a></nav><article><p>First.</p></article><articles><p>no</p></articles>'
            '<article class="x"><p>Second.</p></article><nav class="y"><a href="/b">2</a><a href="/c">3</a></nav></html>')
    r = spark.createDataFrame([(page,)], "h string").select(
        H.paragraphs(H.main_container("h")).alias("p"), H.html_links("h").alias("l"), H.last_page_label("h").alias("n")).first()
    assert r.p == ["First.", "Second."] and r.l == ["/a", "/b", "/c"] and r.n == "2"


def test_classifier_queries_return_predictions_and_probabilities(spark):
    from penprint.catalog import load_all
    from penprint.plans.queries_ml import lang_dataset
    from penprint.sources.corpus import read_table
    sf = "/root/testdata/sf0.01"
    ds = lang_dataset(spark, sf).select("doc_id", "split").collect()
    every = {"c5_language_predictions": sorted(r.doc_id for r in ds),
             "i7_style_predictions": sorted(r.doc_id for r in ds if r.split == "test"),
             "i11_score_vectors": sorted(r.vec_id for r in read_table(spark, sf, "embeddings").select("vec_id").collect())}
    for name, ids in every.items():
        rows = load_all()[name][0](spark, sf).collect()
        assert sorted(r[0] for r in rows) == ids
        best = {}
        for r in rows:
            assert abs(sum(r.proba) - 1) < 1e-9
            best.setdefault(max(range(len(r.proba)), key=r.proba.__getitem__), set()).add(r.predicted)
        assert all(len(x) == 1 for x in best.values())
        hits = sum(r.label == r.predicted for r in rows)
        assert hits > max(sum(r.label == k for r in rows) for k in {r.label for r in rows})
