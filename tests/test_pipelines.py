"""End-to-end: driver contract, DuckDB parity on sf0.001, prompting checks, model
invariants, streaming = batch (SURVEY §5)."""

import math
import os
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001, SF01
from penprint.operators import ml as ML
from penprint.operators import prompting as PR
from penprint.plans import dataset as D
from penprint.streaming import incremental as ST

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
FAST = ["a1_load_corpus", "b1_clean_text", "i14_corpus_pipeline", "e1_author_counts",
        "i15_create_dataset", "f3_create_dataset_ooc", "i1_style_features", "g2_top_ngrams",
        "e5_macro_metrics", "e6_rep_mean_std", "f4_prompt_set", "i17_finetune_requests",
        "b15_crop_to_budget", "b18_parse_response", "b7_html_main_text", "d4_comment_tree",
        "i18_collect_forum", "f7_paged_quota", "j3_running_author_counts"]


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "label", "split", "text"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", FAST)
def test_oracle_parity_sf0001(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = E.queries()[name](spark, SF001)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, res.fetchall())


def test_prompt_set_errors(spark):
    clean = D.corpus_pipeline(spark, SF001)
    with pytest.raises(ValueError):
        PR.sample_two_per_author(clean, 10_000, 1)
    with pytest.raises(ValueError):
        PR.check_prompt_args(1, 3)
    with pytest.raises(ValueError):
        PR.check_prompt_args(3, 0)


def test_prompt_set_shape(spark):
    ps = PR.sample_two_per_author(D.corpus_pipeline(spark, SF001), 3, 2).collect()
    assert len(ps) == 6
    for r in ps:
        assert r["query_text"] != r["example_text"]
    assert sorted({(r["rep"], r["label"]) for r in ps}) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]


def test_style_classifier_beats_majority(spark):
    from penprint.plans.queries_ml import i7_style_predictions
    pred = i7_style_predictions(spark, SF01)
    rows = pred.collect()
    acc = sum(r["label"] == r["predicted"] for r in rows) / len(rows)
    majority = max(sum(r["label"] == k for r in rows) for k in {r["label"] for r in rows}) / len(rows)
    assert acc > majority


def test_language_model_probabilities(spark):
    ds = D.create_dataset(D.corpus_pipeline(spark, SF001, label="lang"), 4)
    model = ML.language_model(ds.filter(F.col("split") == "train"), label="label")
    out = ML.predict_language(model, ds).select(F.aggregate("lang_scores", F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert out.count() == ds.count()


def test_embeddings_probabilities_sum_to_one(spark):
    from penprint.sources.corpus import read_table
    _, out = ML.embeddings_classifier(read_table(spark, SF001, "embeddings"))
    for r in out.select("proba").collect():
        assert math.isclose(sum(r["proba"]), 1.0, rel_tol=1e-9)


def test_streaming_two_runs_equal_one_batch(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    d = tempfile.mkdtemp(prefix="penprint-stream-")
    src, out, chk = f"{d}/src", f"{d}/out", f"{d}/chk"
    first = pages.filter(F.col("page_id") % 2 == 0)
    second = pages.filter(F.col("page_id") % 2 == 1)
    first.coalesce(1).write.parquet(f"{src}/part1")
    os.makedirs(f"{src}/flat", exist_ok=True)
    # one flat folder holding two files, the second arriving after the first run
    import glob
    import shutil
    f1 = glob.glob(f"{src}/part1/*.parquet")[0]
    shutil.copy(f1, f"{src}/flat/a.parquet")
    ST.incremental_collect(spark, f"{src}/flat", "*.parquet", out, chk, pages.schema)
    n1 = spark.read.parquet(out).count()
    second.coalesce(1).write.parquet(f"{src}/part2")
    shutil.copy(glob.glob(f"{src}/part2/*.parquet")[0], f"{src}/flat/b.parquet")
    ST.incremental_collect(spark, f"{src}/flat", "*.parquet", out, chk, pages.schema)
    streamed = {tuple(r) for r in spark.read.parquet(out).collect()}
    batch = {tuple(r) for r in ST.news_rows(pages).collect()}
    assert n1 < len(streamed)
    assert streamed == batch


def test_appended_csv_repeated_header_rows_dropped(spark):
    d = tempfile.mkdtemp(prefix="penprint-csv-")
    with open(f"{d}/corpus.csv", "w", encoding="utf-8") as f:
        f.write('author,post_id,text\nann,1,"first text, quoted"\nbob,2,second\n')
        f.write('author,post_id,text\nann,3,"multi\nline"\nann,1,"first text, quoted"\n')   # resumed run
    from penprint.sources.corpus import load_corpus
    rows = sorted((r["label"], r["text"]) for r in load_corpus(spark, f"{d}/corpus.csv").collect())
    assert rows == [("ann", "first text, quoted"), ("ann", "multi\nline"), ("bob", "second")]


def test_corpus_needs_text_and_label(spark):
    from penprint.sources.corpus import as_corpus
    with pytest.raises(ValueError):
        as_corpus(spark.createDataFrame([("x",)], "body string"))
    with pytest.raises(ValueError):
        as_corpus(spark.createDataFrame([("x",)], "text string"))
