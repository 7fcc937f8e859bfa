"""Corpus pipeline and labelled-split builder.

One logical plan per call: scan -> dedup (partial aggregate) -> clean/token filter
(built-in expressions) -> per-author counts (partial aggregate, one row per author) ->
broadcast semi join on the top-``n`` list (bounded by ``n``) -> skew-proof ranking ->
label map.  Text is never shuffled for ranking beyond the single rank exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.functions import text as T
from penprint.operators import sampling as S
from penprint.operators.ranking import DEFAULT_SEED, hash_key
from penprint.session import reuse
from penprint.sources.corpus import dedup_corpus, documents_corpus


def clean_corpus(corpus: DataFrame, min_tokens: int = T.MIN_CORPUS_TOKENS,
                 counter: T.TokenCounter = T.DEFAULT_COUNTER) -> DataFrame:
    """I14 body on a raw corpus: H2 dedup, B1 cleaning, C2 (> ``min_tokens`` tokens).

    The token count depends on the raw text only, so it is computed inside the dedup
    aggregate (in its partial, map-side stage) on the URL-masked text (on the cleaned one
    if the counter minds white space), and the filter on
    that aggregate output cannot be pushed back into the scan: on an under-split input
    the regex work runs after ``spread`` instead of in the single scan task.  Full
    cleaning runs once, after the shuffle, on the surviving rows only.
    """
    counted = T.mask_urls("text") if counter.ignores_spaces else T.clean_text("text")
    deduped = (corpus.groupBy("label", "text")
               .agg(F.min("doc_id").alias("doc_id"),
                    F.max(T.count_tokens(counted, counter)).alias("_ntok")))
    kept = deduped.filter(F.col("_ntok") > min_tokens)
    return kept.select("doc_id", "label", T.clean_text("text").alias("text"))


def corpus_pipeline(spark: SparkSession, sf_dir: str, label: str = "source") -> DataFrame:
    """Fixture corpus -> dedup -> clean -> token filter, as ``(doc_id, label, text)``."""
    return clean_corpus(documents_corpus(spark, sf_dir, label))


def ranked_authors(clean: DataFrame) -> DataFrame:
    """E1 + F9 on the cleaned corpus: ``(label, n_texts, author_rank)``."""
    return S.author_rank(S.author_counts(clean))


def create_dataset(clean: DataFrame, n: int, limit: int | None = None,
                   add_out_of_class: bool = False, add_text_features: bool = False,
                   split=S.DEFAULT_SPLIT, seed=DEFAULT_SEED) -> DataFrame:
    """``(doc_id, label, text, split[, 58 style features])`` for the top-``n`` authors.

    ``label`` is the author's rank string over *all* authors (D6); out-of-class rows carry
    ``str(n)`` and are added after the rank mapping (G6).
    """
    if limit is not None and limit < 1:
        raise ValueError(f"a limit per author must be positive, got {limit}")
    split = S.check_split(split)
    clean = reuse(clean)                 # read by the ranking and by the row branches
    ranked = reuse(ranked_authors(clean))      # one row an author, read by every branch below
    selected = S.top_authors(ranked, n)
    # Rank and split narrow (doc_id, label) rows; the text of the selected authors alone joins
    # back by doc_id at the end, so it never travels through the per-author exchanges.
    narrow = S.restrict_to(clean.select("doc_id", "label"), selected)
    narrow = S.limit_per_author(narrow, limit)
    parts = S.apply_label_map(S.stratified_split(narrow, split, seed), selected).select("doc_id", "label", "split")
    texts = S.restrict_to(clean, selected).select("doc_id", "text")
    # The hint keeps the text side streamed: narrow rows, even by their unique ids, are hashed
    # partition by partition and the text is neither broadcast nor gathered.
    parts = texts.join(parts.hint("shuffle_hash"), "doc_id")
    if add_out_of_class:
        S.require_others(ranked, n)
        pool = S.out_of_class_pool(clean.select("doc_id", "label"), ranked, n, seed)
        pool_split = S.stratified_split(pool, split, seed, group_cols=("label",),
                                        key_cols=(F.lit("pool"), "doc_id"))
        others = S.exclude(clean, selected).select("doc_id", "text")
        parts = parts.unionByName(others.join(pool_split.select("doc_id", "label", "split").hint("shuffle_hash"), "doc_id"))
    parts = parts.select("doc_id", "label", "text", "split")
    if add_text_features:
        from penprint.functions.features import style_columns
        parts = parts.select("*", *style_columns("text"))
    return parts


def create_datasets(clean: DataFrame, ns, limit: int | None = None, add_out_of_class: bool = False,
                    split=S.DEFAULT_SPLIT, seed=DEFAULT_SEED) -> DataFrame:
    """G-1 for several N in one plan: ``(n, doc_id, label, text, split)``, for each N the rows of
    ``create_dataset(clean, N)``.

    One ranking of the authors and one split serve every N, since an author's split depends on
    their texts alone; the narrow rows are then dealt to each N that the author belongs to, and
    the texts are joined once."""
    ns = sorted(set(ns))
    if not ns or ns[0] < 1:
        raise ValueError(f"numbers of authors must be positive, got {ns}")
    if limit is not None and limit < 1:
        raise ValueError(f"a limit per author must be positive, got {limit}")
    split = S.check_split(split)
    clean = reuse(clean)
    ranked = reuse(ranked_authors(clean))
    selected = S.top_authors(ranked, ns[-1])
    of = clean.select("doc_id", "label")
    parts = S.stratified_split(S.limit_per_author(S.restrict_to(of, selected), limit), split, seed)
    # At most max(ns) authors, a parameter.
    parts = parts.join(F.broadcast(selected.select("label", "author_rank")), "label")
    every = F.array(*[F.lit(n) for n in ns])
    parts = parts.select(F.explode(F.filter(every, lambda n: F.col("author_rank") < n)).alias("n"), "doc_id",
                         F.col("author_rank").cast("string").alias("label"), "split")
    texts = S.restrict_to(clean, selected).select("doc_id", "text")
    if add_out_of_class:
        S.require_others(ranked, ns[-1])
        pool = S.out_of_class_pools(of, ranked, ns, seed)
        pool = S.stratified_split(pool, split, seed, group_cols=("n",), key_cols=(F.lit("pool"), "doc_id"))
        parts = parts.unionByName(pool.select("n", "doc_id", F.col("n").cast("string").alias("label"), "split"))
        texts = clean.select("doc_id", "text")
    return texts.join(parts.hint("shuffle_hash"), "doc_id").select("n", "doc_id", "label", "text", "split")


def write_datasets(df: DataFrame, out_dir: str, add_out_of_class: bool = False, fmt: str = "parquet", seed=DEFAULT_SEED) -> str:
    """A2 for several N: ``n=<N>/split=<name>`` below one folder, each in the seeded order of G-3."""
    path = f"{out_dir.rstrip('/')}/tops{'_withOOC' if add_out_of_class else ''}"
    rows = df.orderBy("n", "split", hash_key(seed, F.lit("order"), "doc_id"), "doc_id")
    w = rows.write.mode("overwrite").partitionBy("n", "split")
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    w.format(fmt).save(path)
    return path


def shuffled(df: DataFrame, seed=DEFAULT_SEED) -> DataFrame:
    """G-3: the reference's final ``sample(frac=1)``, as a seeded sort used at write time."""
    return df.orderBy(hash_key(seed, F.lit("order"), "doc_id"), "doc_id")


def write_splits(df: DataFrame, out_dir: str, n: int, add_out_of_class: bool = False,
                 fmt: str = "parquet", seed=DEFAULT_SEED) -> str:
    """A2: one directory per split under ``top{n}[_withOOC]``, partition-pruned by split."""
    path = f"{out_dir.rstrip('/')}/top{n}{'_withOOC' if add_out_of_class else ''}"
    w = shuffled(df, seed).write.mode("overwrite").partitionBy("split")
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)
    return path


INFO_TOPS = (5, 10, 20, 50)


def corpus_info(corpus: DataFrame, tops=INFO_TOPS) -> DataFrame:
    """Per ``k``: texts, text length avg/min/max and texts-per-author avg/min/max over
    the top-``k`` authors of the raw deduplicated corpus.

    One pass: every statistic is derived from a per-author aggregate (count, length sum,
    min, max), so the documents are read once and the rest runs on one row per author.
    """
    per_author = corpus.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("text")).alias("len_sum"),
        F.min(F.length("text")).alias("len_min"), F.max(F.length("text")).alias("len_max"))
    ranked = S.author_rank(per_author)
    ks = F.array(*[F.lit(k) for k in tops])
    per_k = ranked.withColumn("k", F.explode(F.filter(ks, lambda k: F.col("author_rank") < k)))
    return per_k.groupBy("k").agg(
        F.sum("n_texts").alias("num_texts"),
        (F.sum("len_sum") / F.sum("n_texts")).alias("avg_text_length"),
        F.min("len_min").cast("long").alias("min_text_length"),
        F.max("len_max").cast("long").alias("max_text_length"),
        F.avg("n_texts").alias("avg_texts_per_author"),
        F.min("n_texts").alias("min_texts_per_author"),
        F.max("n_texts").alias("max_texts_per_author")).withColumn("k", F.col("k").cast("int"))


def author_histogram(corpus: DataFrame, top: int = 100) -> DataFrame:
    """Counts of the first ``top`` authors (the data behind the reference's plot)."""
    ranked = S.author_rank(S.author_counts(corpus))
    return ranked.filter(F.col("author_rank") < top).select(
        (F.col("author_rank") + 1).alias("position"), "label", "n_texts")
