"""Datasets for several N, out-of-fold stacking, saved models and the score hook (SURVEY G-1,
D5, I8-I12, A13, A14)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from penprint.operators import ml as ML
from penprint.plans import dataset as D

SF01 = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def fitted(spark):
    from penprint.plans.queries_ml import lang_dataset
    ds = lang_dataset(spark, SF01)
    lang = ML.language_model(ds.where("split = 'train'"), label="label")
    scores = ML.external_scores(ds, lang).persist()
    return ds, scores, ML.Ensemble().fit(ds, scores)


def test_several_tops_equal_separate_runs(spark, tmp_path):
    clean = D.corpus_pipeline(spark, SF01).persist()
    for limit, ooc in ((None, True), (20, False)):
        got = D.create_datasets(clean, [10, 5], limit=limit, add_out_of_class=ooc)
        for n in (5, 10):
            one = D.create_dataset(clean, n, limit=limit, add_out_of_class=ooc)
            assert rows_of(got.where(F.col("n") == n).drop("n")) == rows_of(one)
    path = D.write_datasets(got, str(tmp_path))
    back = spark.read.parquet(path)
    assert rows_of(back.select(got.columns)) == rows_of(got)
    assert {r.n for r in back.select("n").distinct().collect()} == {5, 10}
    for bad in ([], [0, 5]):
        with pytest.raises(ValueError):
            D.create_datasets(clean, bad)


def test_saved_ensemble_scores_alike(spark, fitted, tmp_path):
    ds, scores, ens = fitted
    test = ds.where("split = 'test'")
    ens.save(spark, str(tmp_path / "m"))
    again = ML.Ensemble.load(spark, str(tmp_path / "m"))
    assert again.vocab == ens.vocab and sum(map(len, ens.vocab.values())) == 200
    want, got = (sorted(e.score(test, scores).collect()) for e in (ens, again))
    assert [r[:3] for r in want] == [r[:3] for r in got]
    assert np.allclose([r.proba for r in want], [r.proba for r in got], atol=1e-12)
    grams = ens.ngram_predictions(test).collect()
    assert {r.doc_id for r in grams} == {r.doc_id for r in want}
    most = max(sum(r.label == k for r in want) for k in {r.label for r in want})
    assert sum(r.label == r.predicted for r in want) > most and sum(r.label == r.predicted for r in grams) > most


def test_score_block_is_models_then_style_then_ngrams(fitted):
    ds, scores, ens = fitted
    test = ds.where("split = 'test'")
    base = ens._base_probabilities(ens._scaled(ens._raw_blocks(test)))
    given = {r.doc_id: list(r.scores) for r in scores.collect()}
    parts = {r.doc_id: given[r.doc_id] + list(r.ps) + list(r.pn) for r in base.collect()}
    assert {r.doc_id: list(r.b) for r in ens._stack(base, scores).collect()} == parts


def test_evaluation_per_split_equals_plain_counts(fitted):
    ds, scores, ens = fitted
    pred = ens.score(ds, scores).join(ds.select("doc_id", "split"), "doc_id").persist()
    rows = pred.collect()
    got = {r.split: r for r in ML.evaluate_splits(pred).collect()}
    assert set(got) == {"train", "val", "test"}
    for split, r in got.items():
        own = [x for x in rows if x.split == split]
        recalls = []
        for k in sorted({x.label for x in own} | {x.predicted for x in own}):
            of = [x for x in own if x.label == k]
            recalls.append(sum(x.predicted == k for x in of) / len(of) if of else 0.0)
        values = [v for c, v in r.asDict().items() if "recall" in c]
        assert values and all(abs(v - np.mean(recalls)) < 1e-9 for v in values)


def test_no_row_is_scored_by_a_model_that_has_seen_it(spark, fitted, monkeypatch):
    ds, scores, _ = fitted
    ens = ML.Ensemble()
    ens.vocab = {2: ["th", "es"]}
    trained, used = [], []
    frame, fit = ML.training_frame, ML.fit_array_standardizer

    def stats(df, block, width):
        used.append({r[0] for r in df.select("doc_id").collect()})
        return fit(df, block, width)

    def rows(df):
        trained.append(df.count())
        return frame(df)

    monkeypatch.setattr(ML, "training_frame", rows)
    monkeypatch.setattr(ML, "fit_array_standardizer", stats)
    got = ens.out_of_fold(ds, 3).collect()
    train = {r.doc_id for r in ds.where("split = 'train'").collect()}
    assert sorted(r.doc_id for r in got) == sorted(train)
    folds = {r.doc_id: r["_fold"] for r in got}
    assert set(folds.values()) == {0, 1, 2}
    for k in range(3):
        outside = {d for d in train if folds[d] != k}
        assert used[2 * k] == used[2 * k + 1] == outside and trained[2 * k] == trained[2 * k + 1] == len(outside)
    assert all(len(r.ps) == len(r.pn) == 4 and abs(sum(r.ps) - 1) < 1e-9 for r in got)


def test_rows_of_a_fold_do_not_move_their_own_scores(spark, fitted):
    """Other labels on the rows of one fold leave the scores of that fold as they are."""
    ds, _, _ = fitted
    flip = F.when((ML.fold_of("doc_id", 2) == 0) & (F.col("split") == "train"), F.lit("3")).otherwise(F.col("label"))
    scored = []
    for data in (ds, ds.withColumn("label", flip)):
        ens = ML.Ensemble()
        ens.vocab = {2: ["th", "es"]}
        scored.append({r.doc_id: list(r.ps) + list(r.pn) for r in ens.out_of_fold(data, 2).where("_fold = 0").collect()})
    assert scored[0].keys() == scored[1].keys() and all(np.allclose(scored[0][d], scored[1][d]) for d in scored[0])


def test_folds_must_be_positive(fitted):
    ds, scores, _ = fitted
    with pytest.raises(ValueError):
        ML.Ensemble().fit(ds, scores, folds=0)


def text_scorer(width):
    def make():
        def score(texts):
            return np.array([[len(t), t.count("e"), -1.5][:width] for t in texts], dtype="float64").reshape(len(texts), -1)
        return score
    return make


def test_score_hook_on_texts_feeds_the_stack(spark, fitted):
    ds, _, ens = fitted
    rows = [(1, "eel"), (2, None), (3, ""), (4, "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: list(r.scores) for r in ML.score_batches(df, text_scorer(3), 3, batch_size=2).collect()}
    assert got == {1: [3.0, 2.0, -1.5], 2: [0.0, 0.0, -1.5], 3: [0.0, 0.0, -1.5], 4: [50_000.0, 0.0, -1.5]}
    with pytest.raises(Exception, match="3 outputs a row"):
        ML.score_batches(df, text_scorer(2), 3).collect()
    test = ds.where("split = 'test'")
    base = ens._base_probabilities(ens._scaled(ens._raw_blocks(test)))
    stack = ens._stack(base, ML.score_batches(test, text_scorer(3), 3)).collect()
    assert len(stack) == test.count() and all(len(r.b) == 3 + 4 + 4 for r in stack)


def test_score_hook_gives_logits_of_a_linear_model(spark):
    emb = spark.read.parquet(f"{SF01}/embeddings.parquet").where("embedding is not null")
    model, pred = ML.embeddings_classifier(emb)
    proba = {r.vec_id: np.array(r.proba) for r in pred.collect()}
    raw = ML.score_batches(emb, ML.linear_scorer(model), len(model.stages[0].labels), "embedding", "vec_id", tensor=[64])
    for r in raw.collect():
        e = np.exp(np.array(r.scores) - max(r.scores))
        assert np.allclose(e / e.sum(), proba[r.vec_id], atol=1e-6)
