"""Character features by Arrow batches, and streams over tables that are folders."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from penprint.functions import features as FT
from penprint.functions import text as T
from penprint.operators import ml as ML
from penprint.streaming import incremental as S

TEXTS = ["Ahoj 12 Kde aB²", "", "a", " ", "aaaa aa\n\taaa", "nul\x00 nul\x00", "žluťoučký KŮŇ K \U0001f600\U0001f600\U0001f600", "abab abab a", None]


def _frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grams_are_counted_before_they_become_rows(spark):
    got = FT.ngram_counts(_frame(spark), orders=(1, 2, 3, 4))
    assert "Generate" not in _plan(got)          # a row a gram occurrence was the job's time
    want = Counter(p[i:i + n] for t in TEXTS if t is not None for p in [f" {t} "] for n in (1, 2, 3, 4) for i in range(len(p) - n + 1))
    assert {r["gram"]: r["cnt"] for r in got.collect()} == dict(want)
    assert all(r["n"] == len(r["gram"]) for r in got.collect())


def test_grams_counted_piece_by_piece_add_up(spark, monkeypatch):
    whole = {tuple(r) for r in FT.ngram_counts(_frame(spark)).collect()}
    assert FT._count_grams(["ab", "", "a", "abab"], 2) == (["ab", "ba"], [3, 1])
    assert FT._count_grams(["ab", "", "a", "b"], 3) == ([], [])
    monkeypatch.setattr(FT, "CHARS_AT_ONCE", 1)
    assert {tuple(r) for r in FT.ngram_counts(_frame(spark)).collect()} == whole


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_distinct_ngrams_without_an_array_of_grams(spark, n):
    got = _frame(spark).select("doc_id", FT.distinct_ngrams("text", n).alias("d"))
    assert "zip_with" not in _plan(got)
    want = {i: None if t is None else len({t[j:j + n] for j in range(len(t) - n + 1)}) for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["d"] for r in got.collect()} == want


def test_ngram_frequencies_sort_a_text_once(spark):
    vocab = {2: ["aa", "ab", " a", "zz", "\U0001f600\U0001f600"], 3: ["aaa", "aba", "bab", "nul", "l\x00 "], 4: ["abab"]}
    got = _frame(spark).select("doc_id", FT.ngram_frequencies("text", vocab).alias("f"))
    assert "replace" not in _plan(got)
    for r in got.collect():
        t, want = TEXTS[r["doc_id"]], []
        for n, grams in vocab.items():
            d = len({t[j:j + n] for j in range(len(t) - n + 1)}) if t else 0
            want += [t.count(g) / d if d else None for g in grams]
        assert r["f"] == want


def test_style_reads_a_text_once(spark):
    got = _frame(spark).select("doc_id", *FT.style_columns("text"))
    plan = _plan(got)
    assert plan.count("ArrowEvalPython [") == 1 and "replace" not in plan
    rows = {r["doc_id"]: r.asDict() for r in got.collect()}
    assert all(v is None for k, v in rows[8].items() if k != "doc_id")
    assert rows[1]["len_text"] == 0.0 and rows[1]["avg_len"] is None and rows[1]["cf_a"] is None
    for i, t in enumerate(TEXTS):
        if t:
            ws = t.split()
            assert rows[i]["len_words"] == len(ws) and rows[i]["num_short_w"] == sum(len(w) < 3 for w in ws)
            assert rows[i]["richness"] == (len(set(ws)) / len(ws) if ws else None)
            assert rows[i]["avg_len"] == (sum(map(len, ws)) / len(ws) if ws else None)
            assert rows[i]["per_digit"] == sum(c.isdigit() for c in t) / len(t)
            assert rows[i]["per_cap"] == sum(c.isupper() for c in t) / len(t)
            for c in FT.FREQ_CHARS:
                assert rows[i][f"cf_{c}"] == sum(x.lower() == c for x in t) / len(t)


def test_masking_is_tried_on_texts_with_links_only(spark):
    texts = ["see http://a.b c", "www.x.y", "www x", "http", None, "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["m"] for r in df.select(T.mask_urls("t").alias("m")).collect()] == ["see URL c", "URL", "www x", "http", None, "plain"]


def test_collect_streams_a_table_that_is_a_folder(spark, tmp_path):
    rows = [(k, f"https://x/{k}", f"<html><article><p>A paragraph of page {k} that is long enough to be kept by the rules.</p></article></html>") for k in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.repartition(2).write.parquet(f"{tmp_path}/sf/pages.parquet")
    S.incremental_collect(spark, f"{tmp_path}/sf", "pages.parquet", f"{tmp_path}/out", f"{tmp_path}/chk", pages.schema, ("ad",))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
    pages.limit(1).withColumn("url", F.lit("https://x/new")).write.mode("append").parquet(f"{tmp_path}/sf/pages.parquet")
    S.incremental_collect(spark, f"{tmp_path}/sf", "pages.parquet", f"{tmp_path}/out", f"{tmp_path}/chk", pages.schema, ("ad",))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_hashed_ngrams_equal_hashing_tf(spark):
    from pyspark.ml.feature import HashingTF, NGram
    df = _frame(spark).where("text IS NOT NULL").withColumn("c", F.split("text", ""))
    old = HashingTF(inputCol="g", outputCol="old", numFeatures=1 << 16).transform(NGram(n=3, inputCol="c", outputCol="g").transform(df))
    got = old.withColumn("new", FT.hashed_ngrams("text", 1 << 16))
    rows = got.select("old", "new").collect()
    assert len(rows) == 8 and all(r["old"] == r["new"] for r in rows)
    model = ML.language_model(df.select("doc_id", "text", (F.col("doc_id") % 2).cast("string").alias("lang")))
    out = ML.predict_language(model, df.withColumn("lang", F.lit("0")))
    assert "HashingTF" not in str(model.stages) and out.count() == 8


def test_scaling_by_one_row_a_feature(spark):
    df = spark.createDataFrame([([1.0, None, 5.0],), ([3.0, None, 5.0],), ([None, None, 5.0],), (None,)], "b array<double>")
    assert ML.fit_array_standardizer(df, "b", 3) == [(2.0, 1.0), (0.0, 1.0), (5.0, 1.0)]
    two = df.select(F.col("b")[0].alias("x"), F.lit(4).alias("y"))
    assert ML.fit_standardizer(two, ["x", "y"]) == {"x": (2.0, 1.0), "y": (4.0, 1.0)}
    assert ML.fit_standardizer(two.limit(0), ["x"]) == {"x": (0.0, 1.0)}


@pytest.mark.parametrize("name", ["i18_collect_reviews", "i18_collect_news_pages"])
def test_collected_pages_are_parsed_once(spark, tmp_path, name):
    from penprint.catalog import load_all
    html = "<html lang=\"en\"><article><p>A paragraph of page {0} that is long enough to be kept by the rules.</p></article></html>"
    rows = [(k, f"https://host{k % 2}/item/{k}?page=1", html.format(k)) for k in range(6)] + [(6, "https://host0/item/6", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = load_all()[name][0](spark, str(tmp_path))
    assert "InMemoryTableScan" in _plan(got) and "Scan parquet" not in _plan(got).split("InMemoryRelation")[0]
    assert got.count() == 6
