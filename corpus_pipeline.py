"""Corpus cleaning: language, lines, near copies, benchmark passages, then token digests.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next one's ``docs``.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.llm import byte_cnn, decontaminate, line_dedup, piece_offsets, simhash
from penprint.llm.common import table, written
from penprint.llm.queries import tokenizer_file

LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language: not ``und`` and not below ``LEAST_SCORE``."""
    found = byte_cnn.with_language(docs, byte_cnn.fit(docs), lang_col="__lang_pred", score_col="__score")
    kept = found.where((F.col("__lang_pred") != byte_cnn.UNDETERMINED) & (F.col("__score") >= LEAST_SCORE))
    return kept.select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that occur earlier; documents all of whose lines did so go."""
    found = line_dedup.dedup_lines(docs)
    some_left = F.col("lines_in") - F.col("lines_exact") - F.col("lines_near") > 0
    kept = found.where(some_left | (F.col("lines_in") == 0))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.simhash_dedup(docs, shingle=3, radius=3).select(docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of what is left."""
    return piece_offsets.piece_digests(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark_passages),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None        # the trained language model and the tokenizer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
