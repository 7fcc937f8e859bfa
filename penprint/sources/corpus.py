"""Sources: labelled corpora, pages, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS_COLUMNS = ["doc_id", "label", "text"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over the cluster when the scan yields fewer splits than
    there are cores (e.g. one parquet row group holding every text).

    Per-row text work is CPU-bound; on real inputs with many splits this is a no-op and
    no extra shuffle is planned.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def _check_columns(cols: list[str]) -> None:
    if "text" not in cols:
        raise ValueError("no text column in the input")
    if "author" not in cols and "label" not in cols:
        raise ValueError("neither an author nor a label column in the input")


def as_corpus(df: DataFrame, label_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """Normalise a frame to ``(doc_id, label, text)``.

    ``author`` wins over ``label`` (the reference projects and renames it); a numeric
    author is carried as its string form.  Rows without text are dropped up front.
    """
    cols = df.columns
    if label_col is None:
        _check_columns(cols)
        label_col = "author" if "author" in cols else "label"
    did = F.col(id_col) if id_col else F.monotonically_increasing_id()
    return (df.select(did.cast("long").alias("doc_id"),
                      F.col(label_col).cast("string").alias("label"),
                      F.col("text").cast("string").alias("text"))
            .filter(F.col("text").isNotNull()))


def documents_corpus(spark: SparkSession, sf_dir: str, label: str = "source") -> DataFrame:
    """The fixture corpus: ``documents`` with ``label := source`` (or ``lang``)."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", label, "text"))
    return as_corpus(docs, label_col=label, id_col="doc_id")


def dedup_corpus(corpus: DataFrame) -> DataFrame:
    """H2: drop exact duplicate (label, text) rows, keeping the first (smallest doc_id).

    Implemented as an aggregate so duplicate copies collapse map-side before the shuffle,
    however many copies one text has.
    """
    return (corpus.groupBy("label", "text").agg(F.min("doc_id").alias("doc_id"))
            .select(*CORPUS_COLUMNS))


def load_corpus(spark: SparkSession, path: str, fmt: str = "csv",
                header_cols: tuple[str, ...] | None = None) -> DataFrame:
    """A1 for files: read a CSV/parquet/JSON corpus, validate, normalise and dedup.

    CSV written in append mode repeats its header at every resume (G1); rows equal to the
    header are removed.  Multi-line quoted fields are supported.
    """
    if fmt == "csv":
        df = (spark.read.option("header", True).option("multiLine", True)
              .option("escape", '"').csv(path))
        cols = list(header_cols or df.columns)
        first = F.lit(True)
        for c in cols:
            first = first & (F.col(c) == F.lit(c))
        df = df.filter(~first)
    else:
        df = spark.read.format(fmt).load(path)
    _check_columns(df.columns)
    # With an author only author and text count as the row; otherwise every column does.
    # The id is a digest of those columns, so it does not depend on how files are cut.
    keep = ["author", "text"] if "author" in df.columns else df.columns
    rows = df.select(*keep).where(F.col("text").isNotNull()).distinct()
    digest = F.md5(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in keep])))
    return as_corpus(rows.withColumn("_content", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")),
                     id_col="_content")


def split_text_features(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``[label, text]`` and the remaining feature columns (doc_id kept as key)."""
    feats = [c for c in df.columns if c not in ("label", "text")]
    return df.select("doc_id", "label", "text"), df.select(*feats)


def load_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: already-fetched HTML pages (fetching itself is out of scope)."""
    return spread(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


# The listings a forum crawl walks, in priority order, over the ``events`` fixture.
LISTING_PRIORITY = ["click", "view", "purchase", "signup"]


def listing_union(spark: SparkSession, sf_dir: str, listings=None) -> DataFrame:
    """Union of ranked listings; each row carries its listing's priority.

    The listings are disjoint filters of one table, so the union is a single scan with a
    pushed-down ``IN`` filter and a priority lookup."""
    ev = read_table(spark, sf_dir, "events")
    listings = list(listings or LISTING_PRIORITY)
    names = F.array(*[F.lit(x) for x in listings])
    return (ev.filter(F.col("event_type").isin(listings))
            .select("event_id", "ts", F.col("user_id").alias("item_id"), "event_type",
                    (F.array_position(names, F.col("event_type")) - 1).cast("int").alias("priority")))

