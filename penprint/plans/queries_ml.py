"""Registered queries: model operators (SURVEY C5 (b), D5, I4-I12, A13, A14).

Labels for model quality are the document languages (``label := lang``); the author
labels of the fixture are round-robin and carry no signal.  Only ``i4_standardize`` has
an exact SQL twin; the trained models get the rows-only check plus pytest invariants.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from penprint import oracles as O
from penprint.catalog import register
from penprint.functions import features as FT
from penprint.operators import ml as ML
from penprint.plans import dataset as D
from penprint.plans.queries_core import _clean
from penprint.session import cut_lineage, reuse, shared_dir

N_LANGS = 4


def lang_dataset(spark, sf):
    clean = reuse(D.corpus_pipeline(spark, sf, label="lang"))
    # Cut here: the classifiers stack many persisted frames on this one.
    return cut_lineage(D.create_dataset(clean, N_LANGS))


def _fit_all(spark, sf, folds=1):
    ds = lang_dataset(spark, sf)
    lang = ML.language_model(ds.filter(F.col("split") == "train"), label="label")
    scores = reuse(ML.external_scores(ds, lang))
    ens = ML.Ensemble().fit(ds, scores, folds)
    return ds, scores, ens


_STYLE7 = ["avg_len", "len_text", "len_words", "num_short_w", "per_digit", "per_cap", "richness"]


def _z_sql():
    sel = O.style_select("text").split(",\n  ")[:7]
    exprs = []
    for line in sel:
        e, name = line.rsplit(" AS ", 1)
        exprs.append(f"{e} AS {name}")
    zs = ", ".join(f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) AS {c}"
                   for c in _STYLE7)
    return f"""WITH {O.corpus_ctes()},
f AS (SELECT doc_id, {', '.join(exprs)} FROM corpus)
SELECT doc_id, {zs} FROM f"""


@register("i4_standardize", _z_sql())
def i4_standardize(spark, sf):
    c = _clean(spark, sf)
    f = reuse(c.select("doc_id", *FT.style_columns("text")[:7]))
    z = ML.standardize(f, ML.fit_standardizer(f, _STYLE7))
    return z.select("doc_id", *[F.round(x, 6).alias(x) for x in _STYLE7])


def _facts_sql(rows: str, id_col: str = "doc_id", n: int = N_LANGS, more: str = "") -> str:
    return (f"SELECT {id_col}, label, {n} AS n_classes, true AS sums_to_one, true AS predicted_is_argmax, "
            f"true AS beats_majority{more} FROM {rows}")


_TEST_SQL = f"WITH {O.dataset_ctes(N_LANGS, label='lang')} "
_LANG_LABELS = [str(k) for k in range(N_LANGS)]


@register("c5_language_classifier", _TEST_SQL + _facts_sql("dataset WHERE split = 'test'"))
def c5_language_classifier(spark, sf):
    ds = lang_dataset(spark, sf)
    model = ML.language_model(ds.filter(F.col("split") == "train"), label="label")
    out = ML.predict_language(model, ds.filter(F.col("split") == "test"))
    return ML.scoring_facts(out.select("doc_id", "label", F.col("predicted_lang").alias("predicted"),
                                       vector_to_array("probability").alias("proba")), _LANG_LABELS)


@register("i7_style_classifier", _TEST_SQL + _facts_sql("dataset WHERE split = 'test'"))
def i7_style_classifier(spark, sf):
    ds = lang_dataset(spark, sf)
    style = reuse(ds.select("doc_id", "label", "split", *FT.style_columns("text")).fillna(0.0))
    stats = ML.fit_standardizer(style.filter(F.col("split") == "train"), FT.STYLE_COLUMNS)
    z = reuse(ML.standardize(style, stats))
    model = ML.fit_classifier(z.filter(F.col("split") == "train"), FT.STYLE_COLUMNS)
    return ML.scoring_facts(ML.predictions(model, z.filter(F.col("split") == "test")), _LANG_LABELS)


@register("i9_stacked_ensemble")
def i9_stacked_ensemble(spark, sf):
    ds, scores, ens = _fit_all(spark, sf)
    return ens.score(ds.filter(F.col("split") == "test"), scores).drop("proba")


@register("i9_out_of_fold")
def i9_out_of_fold(spark, sf):
    """``i9_stacked_ensemble`` with the stacked model trained on three-fold out-of-fold probabilities."""
    ds, scores, ens = _fit_all(spark, sf, folds=3)
    return ens.score(ds.filter(F.col("split") == "test"), scores)


@register("i10_ensemble_score")
def i10_ensemble_score(spark, sf):
    ds, scores, ens = _fit_all(spark, sf)
    path = f"{shared_dir(spark)}/models/{uuid.uuid4().hex}"
    ens.save(spark, path)
    loaded = ML.Ensemble.load(spark, path)
    return loaded.score(ds.filter(F.col("split") == "test"), scores).drop("proba")


@register("i12_train_val_eval")
def i12_train_val_eval(spark, sf):
    ds, scores, ens = _fit_all(spark, sf)
    pred = ens.score(ds, scores).join(ds.select("doc_id", "split"), "doc_id")
    return ML.evaluate_splits(pred)


@register("i11_external_scores", _facts_sql(
    "(SELECT vec_id, CAST(label AS VARCHAR) AS label FROM embeddings)", "vec_id",
    "(SELECT count(DISTINCT label) FROM embeddings)").replace("AS n_classes", "::INTEGER AS n_classes"))
def i11_external_scores(spark, sf):
    from penprint.sources.corpus import read_table
    model, out = ML.embeddings_classifier(read_table(spark, sf, "embeddings"))
    return ML.scoring_facts(out, model.stages[0].labels, "vec_id")


@register("i8_ngram_classifier")
def i8_ngram_classifier(spark, sf):
    ds = lang_dataset(spark, sf)
    ens = ML.Ensemble()
    ens.fit_base(ds)
    return ens.ngram_predictions(ds.filter(F.col("split") == "test")).drop("proba")


def _language_predictions(ds):
    model = ML.language_model(ds.filter(F.col("split") == "train"), label="label")
    return ML.predict_language(model, ds).select("doc_id", "label", "split", F.col("predicted_lang").alias("predicted"),
                                                 vector_to_array("probability").alias("proba"))


@register("c5_language_predictions")
def c5_language_predictions(spark, sf):
    """Predicted language and probabilities of every row of the dataset; ``c5`` states facts of the test rows."""
    return _language_predictions(lang_dataset(spark, sf))


@register("i7_style_predictions")
def i7_style_predictions(spark, sf):
    """Predicted label and probabilities of the rows that ``i7_style_classifier`` states facts of."""
    ds = lang_dataset(spark, sf)
    style = reuse(ds.select("doc_id", "label", "split", *FT.style_columns("text")).fillna(0.0))
    stats = ML.fit_standardizer(style.filter(F.col("split") == "train"), FT.STYLE_COLUMNS)
    z = reuse(ML.standardize(style, stats))
    model = ML.fit_classifier(z.filter(F.col("split") == "train"), FT.STYLE_COLUMNS)
    return ML.predictions(model, z.filter(F.col("split") == "test"))


@register("i11_score_vectors")
def i11_score_vectors(spark, sf):
    """Predicted label and score vector of every row of ``embeddings``."""
    from penprint.sources.corpus import read_table
    _, out = ML.embeddings_classifier(read_table(spark, sf, "embeddings"))
    return out


@register("i11_raw_outputs")
def i11_raw_outputs(spark, sf):
    """Raw outputs (logits) of a model applied to every row of ``embeddings`` through the score hook."""
    from penprint.sources.corpus import read_table
    emb = read_table(spark, sf, "embeddings")
    model, _ = ML.embeddings_classifier(emb)
    width = len(model.stages[0].labels)
    return ML.score_batches(emb, ML.linear_scorer(model), width, "embedding", "vec_id", tensor=[model.stages[-1].numFeatures])
