"""Registered queries: corpus, author ranking, splits (SURVEY A1, A8, B1, C1, C2, D1, D2,
D6, E1-E3, F1-F3, F9, G-1, H2, I14, I15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from penprint import oracles as O
from penprint.catalog import register
from penprint.functions import text as T
from penprint.operators import sampling as S
from penprint.plans import dataset as D
from penprint.session import reuse
from penprint.sources.corpus import dedup_corpus, documents_corpus, read_table

N_AUTHORS = 5          # notebook example: top 5 authors
LIMIT = 30             # per-author limit exercised by the limit variants


def _clean(spark, sf):
    # Several branches of each query read the cleaned corpus: compute it once per query.
    return reuse(D.corpus_pipeline(spark, sf))


# -- A1 / H2 ----------------------------------------------------------------
@register("a1_load_corpus", f"""
WITH raw AS (SELECT doc_id, source AS label, text FROM documents WHERE text IS NOT NULL)
SELECT min(doc_id) AS doc_id, label, text FROM raw GROUP BY label, text""")
def a1_load_corpus(spark, sf):
    return dedup_corpus(documents_corpus(spark, sf))


# -- B1 clean_text, over texts with CR/LF, URLs and odd whitespace appended -------------
_B1_SPARK_SUFFIX = ["\r\n", "see http://", None, ".org/x\u00a0\u2003www.", None, "\r", " xhttpd  "]


def _b1_input(col_src, col_text):
    parts = []
    for p in _B1_SPARK_SUFFIX:
        parts.append(F.col(col_src) if p is None else F.lit(p))
    return F.concat(F.col(col_text), *parts)


_B1_SQL_INPUT = ("text || chr(13) || chr(10) || 'see http://' || source || '.org/x' || chr(160) "
                 "|| chr(8195) || 'www.' || source || chr(13) || ' xhttpd  '")


@register("b1_clean_text", f"""
SELECT doc_id, {O.clean(_B1_SQL_INPUT)} AS clean_text FROM documents""")
def b1_clean_text(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", T.clean_text(_b1_input("source", "text")).alias("clean_text"))


# -- B14 / C1 / C2: token counts and the corpus filters --------------------------------
@register("c2_min_tokens", f"""
SELECT doc_id, {O.tokens(O.clean('text'))} AS n_tokens,
       length({O.clean('text')}) >= 20 AS min_chars_ok,
       {O.tokens(O.clean('text'))} > 60 AS min_tokens_ok
FROM documents""")
def c2_min_tokens(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", T.clean_text("text").alias("t"))
    return d.select("doc_id", T.count_tokens("t").alias("n_tokens"),
                    T.min_chars("t").alias("min_chars_ok"),
                    T.min_tokens("t").alias("min_tokens_ok"))


# -- I14 corpus pipeline -------------------------------------------------------------
@register("i14_corpus_pipeline", f"WITH {O.corpus_ctes()} SELECT doc_id, label, text FROM corpus")
def i14_corpus_pipeline(spark, sf):
    return _clean(spark, sf)


# -- E1 + F9 author counts and ranks -------------------------------------------------
@register("e1_author_counts", f"WITH {O.corpus_ctes()} SELECT label, n_texts, author_rank FROM ranked")
def e1_author_counts(spark, sf):
    return D.ranked_authors(_clean(spark, sf)).select("label", "n_texts", "author_rank")


# -- G-1 + D1 top-n authors and their rows --------------------------------------------
@register("d1_top_author_rows", f"""
WITH {O.corpus_ctes()}
SELECT c.doc_id, c.label FROM corpus c
WHERE c.label IN (SELECT label FROM ranked WHERE author_rank < {N_AUTHORS})""")
def d1_top_author_rows(spark, sf):
    clean = _clean(spark, sf)
    top = S.top_authors(D.ranked_authors(clean), N_AUTHORS)
    return S.restrict_to(clean, top).select("doc_id", "label")


@register("d2_non_selected_rows", f"""
WITH {O.corpus_ctes()}
SELECT c.doc_id, c.label FROM corpus c
WHERE c.label NOT IN (SELECT label FROM ranked WHERE author_rank < {N_AUTHORS})""")
def d2_non_selected_rows(spark, sf):
    clean = _clean(spark, sf)
    top = S.top_authors(D.ranked_authors(clean), N_AUTHORS)
    return S.exclude(clean, top).select("doc_id", "label")


# -- F1 limit per author -------------------------------------------------------------
@register("f1_limit_per_author", f"""
WITH {O.corpus_ctes()}
SELECT doc_id, label FROM (
  SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS rn FROM corpus)
WHERE rn <= {LIMIT}""")
def f1_limit_per_author(spark, sf):
    return S.limit_per_author(_clean(spark, sf), LIMIT).select("doc_id", "label")


# -- F2 / I15: the flagship split ------------------------------------------------------
@register("i15_create_dataset", f"""
WITH {O.dataset_ctes(N_AUTHORS)}
SELECT doc_id, label, split, text FROM dataset""")
def i15_create_dataset(spark, sf):
    return D.create_dataset(_clean(spark, sf), N_AUTHORS).select("doc_id", "label", "split", "text")


@register("f2_split_sizes", f"""
WITH {O.dataset_ctes(N_AUTHORS)}
SELECT label, split, count(*) AS n FROM dataset GROUP BY label, split""")
def f2_split_sizes(spark, sf):
    ds = D.create_dataset(_clean(spark, sf), N_AUTHORS)
    return ds.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@register("i15_create_dataset_limit", f"""
WITH {O.dataset_ctes(N_AUTHORS, limit=LIMIT)}
SELECT doc_id, label, split FROM dataset""")
def i15_create_dataset_limit(spark, sf):
    return D.create_dataset(_clean(spark, sf), N_AUTHORS, limit=LIMIT).select("doc_id", "label", "split")


@register("f3_create_dataset_ooc", f"""
WITH {O.dataset_ctes(N_AUTHORS, ooc=True)}
SELECT doc_id, label, split FROM dataset""")
def f3_create_dataset_ooc(spark, sf):
    ds = D.create_dataset(_clean(spark, sf), N_AUTHORS, add_out_of_class=True)
    return ds.select("doc_id", "label", "split")


# -- G-1: several N in one plan -----------------------------------------------------------
TOPS = (3, 5, 10)


@register("g1_create_datasets", "".join(
    f"{' UNION ALL ' if k else ''}SELECT CAST({n} AS INTEGER) AS n, doc_id, label, split FROM (WITH {O.dataset_ctes(n, ooc=True)} SELECT * FROM dataset)"
    for k, n in enumerate(TOPS)))
def g1_create_datasets(spark, sf):
    ds = D.create_datasets(_clean(spark, sf), TOPS, add_out_of_class=True)
    return ds.select("n", "doc_id", "label", "split")


# -- E2 corpus info, E3 histogram (raw deduplicated corpus) -----------------------------
_RAW = """raw AS (SELECT doc_id, source AS label, text FROM documents WHERE text IS NOT NULL),
dedup AS (SELECT min(doc_id) AS doc_id, label, text FROM raw GROUP BY label, text),
counts AS (SELECT label, count(*) AS n_texts FROM dedup GROUP BY label),
ranked AS (SELECT label, n_texts, row_number() OVER (ORDER BY n_texts DESC, label) - 1 AS author_rank
           FROM counts),
ks AS (SELECT unnest([5, 10, 20, 50]) AS k)"""


@register("e2_corpus_info", f"""
WITH {_RAW},
d AS (SELECT ks.k, length(dedup.text) AS len FROM dedup JOIN ranked USING (label)
      JOIN ks ON ranked.author_rank < ks.k),
a AS (SELECT ks.k, n_texts FROM ranked JOIN ks ON ranked.author_rank < ks.k)
SELECT CAST(d.k AS INTEGER) AS k, num_texts, round(avg_text_length, 9) AS avg_text_length, min_text_length,
       max_text_length, round(avg_texts_per_author, 9) AS avg_texts_per_author, min_texts_per_author,
       max_texts_per_author
FROM (SELECT k, count(*) AS num_texts, avg(len) AS avg_text_length,
             CAST(min(len) AS BIGINT) AS min_text_length, CAST(max(len) AS BIGINT) AS max_text_length
      FROM d GROUP BY k) d
JOIN (SELECT k, avg(n_texts) AS avg_texts_per_author, min(n_texts) AS min_texts_per_author,
             max(n_texts) AS max_texts_per_author FROM a GROUP BY k) a ON d.k = a.k""")
def e2_corpus_info(spark, sf):
    info = D.corpus_info(dedup_corpus(documents_corpus(spark, sf)))
    return (info.withColumn("avg_text_length", F.round("avg_text_length", 9))
            .withColumn("avg_texts_per_author", F.round("avg_texts_per_author", 9)))


@register("e3_author_histogram", f"""
WITH {_RAW}
SELECT author_rank + 1 AS position, label, n_texts FROM ranked WHERE author_rank < 100""")
def e3_author_histogram(spark, sf):
    h = D.author_histogram(dedup_corpus(documents_corpus(spark, sf)))
    return h.withColumn("position", F.col("position").cast("long"))
