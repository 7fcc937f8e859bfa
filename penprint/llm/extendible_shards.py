"""Operator 5: sharding by extendible hashing.

A row's hash is 60 bits of an md5 over its id and its text's md5.  The directory is indexed
by hash-prefix bits: starting from one bucket, only a bucket over the byte limit is split on
its next bit, until every bucket fits.  All splits of ``STEP`` bits are decided together:
rows are summed into cells of that prefix length, the cells' sums rolled up to every shorter
prefix, and a prefix is a shard when it fits and its parent does not.  Only cells that are
still over the limit go on, with ``STEP`` more bits.

Scale: rows are read narrow (id, hash, byte count); cells have map-side aggregation, so a
round shuffles at most ``2**STEP`` rows a task.  A round's directory has at most ``2**STEP``
entries and is broadcast; the deeper rounds' directories are joined.

Defined cases: a null text has no bytes; rows equal in id and text share all hash bits, and
where they exceed the limit they are dealt to overflow pages of the bucket (numbered within
each input partition, so no task gathers them); a single row over the limit has a page of
its own; a null id is hashed as empty text; an empty table has no shards; other columns
pass through ``with_shards``, and columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.llm.common import written

BITS = 60
STEP = 15
SHARD_BYTES = 1 << 20
_ADDED = ("shard", "shard_depth", "shard_bytes", "shard_docs")


def row_hash(id_col: str, text_col: str) -> Column:
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                               F.md5(F.coalesce(F.col(text_col), F.lit("")))).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def row_bytes(text_col: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")


def _prefix(bits: int | Column) -> Column:
    if isinstance(bits, int):
        return F.shiftright("__h", BITS - bits)
    return F.expr(f"shiftright(__h, {BITS} - cast(__depth as int))")


def directory(rows: DataFrame, limit: int, base: int) -> DataFrame:
    """cell (prefix of base + STEP bits), depth, prefix, shard_bytes, shard_docs, full: the
    shard of each cell, or, with full set, that the cell itself is over the limit."""
    top = base + STEP
    cells = rows.groupBy(_prefix(top).alias("cell")).agg(F.sum("__bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
    depths = F.explode(F.sequence(F.lit(base), F.lit(top)))
    ancestors = (cells.withColumn("depth", depths)
                 .withColumn("prefix", F.expr(f"shiftright(cell, {top} - depth)")))
    nodes = ancestors.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"),
                           (F.col("shard_bytes") > limit).alias("split"))
    nodes = (nodes.withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["depth", "parent"], "left")
             .where(F.coalesce("split", F.lit(True)) & ((F.col("shard_bytes") <= limit) | (F.col("depth") == top)))
             .withColumn("full", F.col("shard_bytes") > limit).drop("parent", "split"))
    return ancestors.select("cell", "depth", "prefix").join(nodes, ["depth", "prefix"])


def with_shards(df: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with shard (its hash-prefix bits, and the page after a dot where equal rows
    overflow), shard_depth, shard_bytes and shard_docs of the bucket."""
    rows = df.drop(*_ADDED).withColumns({"__h": row_hash(id_col, text_col), "__bytes": row_bytes(text_col)})
    narrow = written(rows.select("__h", "__bytes"), "shard-hashes")
    out, left, base = [], rows, 0
    while base < BITS:
        found = written(directory(narrow, limit, base), "shard-directory")
        top = base + STEP
        entries = F.broadcast(found) if base == 0 else found           # 2**STEP entries at most
        placed = left.withColumn("cell", _prefix(top)).join(entries, "cell")
        out.append(placed.where(~F.col("full")).drop("cell", "full"))
        open_cells = found.where("full").select("cell")
        if open_cells.isEmpty():
            break
        left = left.withColumn("cell", _prefix(top)).join(open_cells, "cell", "left_semi").drop("cell")
        narrow = narrow.withColumn("cell", _prefix(top)).join(open_cells, "cell", "left_semi").drop("cell")
        base = top
    else:
        out.append(_overflow(placed.where("full").drop("cell", "full"), limit))
    result = None
    for part in out:
        if "page" not in part.columns:
            part = part.withColumn("page", F.lit(""))
        result = part if result is None else result.unionByName(part)
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return (result.withColumns({"shard": F.concat(bits, "page"), "shard_depth": F.col("depth")})
            .drop("__h", "__bytes", "depth", "prefix", "page"))


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Pages of buckets whose rows share all hash bits."""
    numbered = rows.withColumn("__part", F.spark_partition_id())
    w = Window.partitionBy("__h", "__part").orderBy("__bytes")
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("__bytes", F.lit(1))))
    return (numbered.withColumn("page", F.concat(F.lit("."), F.col("__part"), F.lit("-"),
                                                 F.floor((F.row_number().over(w) - 1) / per_page)))
            .drop("__part"))


def write_shards(df: DataFrame, folder: str, **options) -> None:
    """One folder a shard below ``folder``."""
    with_shards(df, **options).repartition("shard").write.partitionBy("shard").parquet(folder)


def shard_rows(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its bytes and its shard."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       row_bytes(text_col).alias("n_bytes"))
    return with_shards(rows, limit).select("doc_id", "n_bytes", *_ADDED)


ORACLE = f"""
WITH rows AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, {BITS // 4}) AS BIGINT) AS h
  FROM documents),
prefixes AS (
  SELECT doc_id, n_bytes, depth, h >> ({BITS} - depth)::INTEGER AS prefix FROM rows, (SELECT unnest(range(0, 41)) AS depth)),
nodes AS (
  SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM prefixes GROUP BY ALL),
shards AS (
  SELECT n.* FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix >> 1
  WHERE n.shard_bytes <= {SHARD_BYTES} AND (n.depth = 0 OR p.shard_bytes > {SHARD_BYTES}))
SELECT p.doc_id, p.n_bytes, CASE WHEN s.depth = 0 THEN '' ELSE lpad(bin(s.prefix), s.depth::INTEGER, '0') END AS shard,
       s.depth::INTEGER AS shard_depth, s.shard_bytes, s.shard_docs
FROM prefixes p JOIN shards s ON s.depth = p.depth AND s.prefix = p.prefix
"""
