"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package is planned for.  AQE re-plans joins from measured
# shuffle sizes (broadcast only when the built side really is small, skew-join splitting
# otherwise) and coalesces small partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast only on sizes measured at run time (AQE), never on planner estimates;
    # explicit ``broadcast()`` is kept for tables with a proven bound (top-n lists).
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    # Text work is CPU-bound per row: let AQE keep many small partitions of compressed
    # text rather than merging them into a few (no effect once partitions are large).
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "penprint",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when the session has none (tests, local runs) is ``fallback`` installed.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d and fallback:
        spark.conf.set("spark.checkpoint.dir", fallback)
        d = fallback
    if d:
        spark.sparkContext.setCheckpointDir(d)
    return d


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints, sinks and models: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is set once for a single-JVM ``local`` master (tests);
    any other master must name a folder that its executors share."""
    d = checkpoint_dir(spark)
    if d:
        return d.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return checkpoint_dir(spark, fallback=tempfile.mkdtemp(prefix="penprint-shared-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def reuse(df: DataFrame) -> DataFrame:
    """Persist a frame that several branches of one plan read (computed once; blocks lost
    with an executor are recomputed from lineage)."""
    from pyspark import StorageLevel
    if not df.is_cached:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return df


def ship(spark: SparkSession) -> None:
    """Give Python tasks this package, as ``--py-files`` would, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_penprint_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="penprint-py-"), "penprint.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(out)
    sc._penprint_shipped = True
