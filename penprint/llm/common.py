"""Helpers shared by the training-data operators: the shared scratch folder, written
tables, and text as UTF-8 bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.session import ship


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``.

    On a single-JVM ``local[...]`` master without that setting (tests) a temporary folder
    is set once for the session; any other master must name a shared folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) \
        or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="penprint-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and outlives executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: str | Column) -> Column:
    """Text as UTF-8 bytes, null as no bytes; Python tasks then skip a decode."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("binary"), F.lit(b""))


def unsigned_hex(col: str | Column) -> Column:
    """A 64-bit value as 16 lowercase hex digits."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package on the tasks' path."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)
