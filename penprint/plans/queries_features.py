"""Registered queries: style and n-gram features."""

from __future__ import annotations

from pyspark.sql import functions as F

from penprint import oracles as O
from penprint.catalog import register
from penprint.functions import features as FT
from penprint.plans import dataset as D
from penprint.plans.queries_core import N_AUTHORS, _clean

R = 9   # float results are rounded to 9 digits on both sides


def _dataset(spark, sf):
    return D.create_dataset(_clean(spark, sf), N_AUTHORS)


def _round_all(df, keep):
    return df.select(*keep, *[F.round(c, R).alias(c) for c in df.columns if c not in keep])


def _style_sql_round():
    cols = []
    for line in O.style_select("text").split(",\n  "):
        expr, name = line.rsplit(" AS ", 1)
        cols.append(f"round({expr}, {R}) AS {name}")
    return ",\n  ".join(cols)


@register("i1_style_features", f"""
WITH {O.dataset_ctes(N_AUTHORS)}
SELECT doc_id, label, split,
  {_style_sql_round()}
FROM dataset""")
def i1_style_features(spark, sf):
    ds = D.create_dataset(_clean(spark, sf), N_AUTHORS, add_text_features=True)
    return _round_all(ds.drop("text"), ["doc_id", "label", "split"])


@register("h3_distinct_words", f"""
WITH {O.corpus_ctes()}
SELECT doc_id, CAST(len({O.words('text')}) AS BIGINT) AS n_words,
       CAST(len(list_distinct({O.words('text')})) AS BIGINT) AS n_distinct_words
FROM corpus""")
def h3_distinct_words(spark, sf):
    c = _clean(spark, sf)
    w = FT.words("text")
    return c.select("doc_id", F.size(w).cast("long").alias("n_words"),
                    F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"))


def _gram_counts_sql(source: str) -> str:
    return f"""
chars AS (SELECT string_split({O.padded('text')}, '') AS c FROM {source}),
grams AS (SELECT 2 AS n, unnest({O.ngrams('c', 2)}) AS gram FROM chars
          UNION ALL SELECT 3 AS n, unnest({O.ngrams('c', 3)}) AS gram FROM chars),
gcount AS (SELECT n, gram, count(*) AS cnt FROM grams GROUP BY n, gram)"""


@register("e4_char_ngram_counts", f"""
WITH {O.corpus_ctes()}, {_gram_counts_sql('corpus')}
SELECT CAST(n AS INTEGER) AS n, gram, cnt FROM gcount""")
def e4_char_ngram_counts(spark, sf):
    return FT.ngram_counts(_clean(spark, sf)).withColumn("n", F.col("n").cast("int"))


@register("e11_distinct_ngrams", f"""
WITH {O.corpus_ctes()},
c AS (SELECT doc_id, string_split(text, '') AS ch FROM corpus)
SELECT doc_id, CAST(len(list_distinct({O.ngrams('ch', 2)})) AS INTEGER) AS distinct_bigrams,
       CAST(len(list_distinct({O.ngrams('ch', 3)})) AS INTEGER) AS distinct_trigrams
FROM c""")
def e11_distinct_ngrams(spark, sf):
    c = _clean(spark, sf)
    return c.select("doc_id", FT.distinct_ngrams("text", 2).alias("distinct_bigrams"),
                    FT.distinct_ngrams("text", 3).alias("distinct_trigrams"))


_VOCAB_SQL = f"""{O.dataset_ctes(N_AUTHORS)},
train AS (SELECT text FROM dataset WHERE split = 'train'), {_gram_counts_sql('train')},
vocab AS (SELECT n, gram, cnt, row_number() OVER (PARTITION BY n ORDER BY cnt DESC, gram) AS rank
          FROM gcount QUALIFY rank <= {FT.NGRAM_TOP})"""


def _vocab(spark, sf):
    ds = _dataset(spark, sf)
    return ds, FT.top_ngrams(FT.ngram_counts(ds.filter(F.col("split") == "train")))


@register("g2_top_ngrams", f"""
WITH {_VOCAB_SQL}
SELECT CAST(n AS INTEGER) AS n, CAST(rank AS INTEGER) AS rank, gram, cnt FROM vocab""")
def g2_top_ngrams(spark, sf):
    _, vocab = _vocab(spark, sf)
    return vocab.withColumn("n", F.col("n").cast("int"))


@register("i3_ngram_frequencies", f"""
WITH {_VOCAB_SQL},
d AS (SELECT doc_id, text, len(list_distinct({O.ngrams('ch', 2)})) AS d2,
             len(list_distinct({O.ngrams('ch', 3)})) AS d3
      FROM (SELECT doc_id, text, string_split(text, '') AS ch FROM dataset))
SELECT d.doc_id, CAST(v.n AS INTEGER) AS n, CAST(v.rank AS INTEGER) AS rank,
       round(((length(d.text) - length(replace(d.text, v.gram, ''))) / length(v.gram))
             / NULLIF(CAST(CASE WHEN v.n = 2 THEN d2 ELSE d3 END AS DOUBLE), 0), {R}) AS freq
FROM d CROSS JOIN vocab v""")
def i3_ngram_frequencies(spark, sf):
    ds, vocab = _vocab(spark, sf)
    voc = FT.collect_vocabulary(vocab)
    n2 = len(voc.get(2, []))
    x = ds.select("doc_id", F.posexplode(FT.ngram_frequencies("text", voc)).alias("pos", "freq"))
    return x.select(
        "doc_id",
        F.when(F.col("pos") < n2, 2).otherwise(3).cast("int").alias("n"),
        F.when(F.col("pos") < n2, F.col("pos") + 1).otherwise(F.col("pos") - n2 + 1).cast("int").alias("rank"),
        F.round("freq", R).alias("freq"))
