"""A keyed table kept as append-only changes.

Every micro-batch adds one folder with the rows of the keys it changed; nothing that is
there is rewritten.  The current table is the newest row of each key, one aggregate with
map-side combine over the base and the changes since.  Once the changes outweigh the base,
or are many, they are folded into a new base, so a key is rewritten about as often as the
table doubles.

``changes/b<id>`` holds a micro-batch, ``base/v<id>`` all changes up to that one.  A folder
counts once its ``_SUCCESS`` marker is there: a job lost while writing leaves nothing that is
read, and its replay overwrites the folder.  The base before the newest stays, with the
changes since, because a replayed micro-batch reads the state before itself.  A table belongs
to one streaming checkpoint (batch numbers must not start again).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_CHANGES = 256
LEAST_CHANGES = 8


class ChangeTable:
    """Newest row per key of ``keys`` below ``path``; ``schema`` is that of the rows."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.schema = spark.createDataFrame([], schema).schema

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """The changed rows of a micro-batch, each key once."""
        rows.select(self.schema.names).write.mode("overwrite").parquet(f"{self.path}/changes/b{batch_id}")

    def current(self, before: int | None = None) -> DataFrame:
        """The table, or its state before micro-batch ``before``."""
        base, changes = self._parts(before)
        if base is None and not changes:
            return self.spark.createDataFrame([], self.schema)
        parts = [self._read(f"base/v{base}", -1)] if base is not None else []
        parts += [self._read(f"changes/b{b}", b) for b in changes]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if len(parts) == 1:
            return rows.drop("_batch")
        values = [c for c in self.schema.names if c not in self.keys]
        newest = F.max_by(F.struct(*values), F.col("_batch")).alias("_v")
        return rows.groupBy(*self.keys).agg(newest).select(*[F.col(f"_v.{c}").alias(c) if c in values else F.col(c)
                                                            for c in self.schema.names])

    def compact(self, batch_id: int) -> bool:
        """Fold the changes up to ``batch_id`` into a base if they outweigh the last one."""
        base, changes = self._parts(batch_id + 1)
        if len(changes) < LEAST_CHANGES:
            return False
        weight = sum(self._bytes(f"changes/b{b}") for b in changes)
        if len(changes) < MOST_CHANGES and base is not None and weight <= self._bytes(f"base/v{base}"):
            return False
        self.current(batch_id + 1).write.mode("overwrite").parquet(f"{self.path}/base/v{batch_id}")
        if base is not None:
            for b in self._complete("base", "v"):
                if b < base:
                    self._delete(f"base/v{b}")
            for b in self._complete("changes", "b"):
                if b <= base:
                    self._delete(f"changes/b{b}")
        return True

    def _parts(self, before: int | None) -> tuple[int | None, list[int]]:
        bases = [b for b in self._complete("base", "v") if before is None or b < before]
        base = max(bases) if bases else None
        return base, sorted(b for b in self._complete("changes", "b")
                            if (base is None or b > base) and (before is None or b < before))

    def _read(self, name: str, batch: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}").withColumn("_batch", F.lit(batch).cast("long"))

    # -- folders, on whatever file system the path names ---------------------------------
    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _complete(self, folder: str, prefix: str) -> list[int]:
        path, fs = self._at(folder)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        found = [n for n in names if n.startswith(prefix) and n[1:].isdigit()]
        return [int(n[1:]) for n in found if fs.exists(self._at(f"{folder}/{n}/_SUCCESS")[0])]

    def _bytes(self, name: str) -> int:
        path, fs = self._at(name)
        return fs.getContentSummary(path).getLength()

    def _delete(self, name: str) -> None:
        path, fs = self._at(name)
        fs.delete(path, True)
