"""Operator 13: product codes of integer vectors through per-dimension value dictionaries.

Each component ``x`` becomes the integer ``floor(scale * x)``; a vector is cut into ``parts``
equal parts, each coded by the nearest of its codebook's entries.  Vectors are written once
as blocks: for every dimension the block's distinct integers (its dictionary) and, per
vector, the place of its value there.  An assignment tabulates, for each dimension, the
squared differences of every dictionary value to all entries; a part's distances to all
entries are then gathers of table rows by dictionary code, added over the part's dimensions.
Equal values share their arithmetic, and everything is an integer, so results are exact.

Scale: vectors are read twice (first entries, blocks); the rounds read the coded blocks only.
Codebooks (``parts * entries`` integer vectors) go to the tasks with each pass and come
back as at most ``parts * entries`` rows of sums, added up in each task and by Spark before
they reach the driver.  A block is bounded by ``BLOCK`` rows, so its dictionaries and tables
are bounded whatever the values are.  Blocks lie in the shared folder: a lost executor
costs its running tasks.  Error totals of labels are one row a label and join back with a
checked broadcast, or by a shuffle whose hot labels Spark splits.

Defined cases: a row whose vector is null, empty, or holds a null or non-finite component is
dropped, as is one of another length than the kept vector of smallest id; integers beyond
``LARGEST`` count as that (no squared distance then leaves 64 bits); first entries are the
vectors of smallest id, nulls last and equal ids by vector; fewer vectors than entries make
fewer entries; repeated rows are coded each; null labels are one label; a length that the
parts do not divide is an error; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.llm.common import map_arrow, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
LARGEST = 1 << 27
BLOCK = 8192              # vectors that share dictionaries; a code then fits 16 bits
CHUNK = 1024              # vectors whose distances are held at once
LABELS_BROADCAST = 100_000
_BLOCKS = "ids array<bigint>, labels array<string>, dictionaries array<binary>, codes binary"


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """vec_id, label (as text) and v: the integer components of every row that is kept."""
    top = float(LARGEST)
    value = F.transform("v", lambda x: F.least(F.greatest(F.floor(F.greatest(F.least(x * scale, F.lit(top)), F.lit(-top))),
                                                          F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                           F.col(vec_col).cast("array<double>").alias("v"))
            .where(F.col("v").isNotNull() & (F.size("v") > 0))
            .where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
            .withColumn("v", value))


def encode_block(ids: list, labels: list, v: np.ndarray) -> dict:
    """One row of the block table: dictionaries and codes (dimension by dimension)."""
    found = [np.unique(column, return_inverse=True) for column in v.T]
    return {"ids": ids, "labels": labels, "dictionaries": [values.astype("<i4").tobytes() for values, _ in found],
            "codes": np.concatenate([code.astype("<u2") for _, code in found]).tobytes()}


def decode_block(row: dict) -> tuple[list[np.ndarray], np.ndarray]:
    """The dictionaries and the codes (dimension, vector) of a block."""
    dictionaries = [np.frombuffer(d, "<i4").astype(np.int64) for d in row["dictionaries"]]
    return dictionaries, np.frombuffer(row["codes"], "<u2").reshape(len(dictionaries), -1)


def write_blocks(rows: DataFrame, dim: int, block: int = BLOCK) -> DataFrame:
    """Every integer vector of length ``dim``, as dictionary-coded blocks in the shared folder."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())),
                        ("dictionaries", pa.list_(pa.binary())), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, list, np.ndarray]] = []
        n = 0

        def emit() -> pa.RecordBatch:
            row = encode_block([i for h in held for i in h[0]], [x for h in held for x in h[1]],
                               np.concatenate([h[2] for h in held]))
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                if n + part.num_rows > block:
                    yield emit()
                    held, n = [], 0
                v = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                held.append((part.column(0).to_pylist(), part.column(1).to_pylist(), v))
                n += part.num_rows
        if n:
            yield emit()

    return written(map_arrow(rows.where(F.size("v") == dim).select("vec_id", "label", "v"), run, _BLOCKS), "value-blocks")


def nearest_entries(dictionaries: list[np.ndarray], codes: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry (ties to the lower) and its squared distance, for one part of a block's
    vectors: ``dictionaries`` and ``codes`` of its dimensions, ``book`` (entry, dimension)."""
    widest = sum(int(max(abs(d.max() - b.min()), abs(b.max() - d.min()))) ** 2 for d, b in zip(dictionaries, book.T))
    kind = np.int32 if widest < 2 ** 31 else np.int64
    tables = [((d[:, None] - b[None, :]) ** 2).astype(kind) for d, b in zip(dictionaries, book.T)]
    n = codes.shape[1]
    best, error = np.empty(n, np.int64), np.empty(n, np.int64)
    for at in range(0, n, CHUNK):
        part = codes[:, at:at + CHUNK]
        far = tables[0].take(part[0], axis=0)
        gathered = np.empty_like(far)
        for table, code in zip(tables[1:], part[1:]):
            far += table.take(code, axis=0, out=gathered, mode="clip")
        near = far.argmin(axis=1)
        best[at:at + CHUNK] = near
        error[at:at + CHUNK] = far[np.arange(len(near)), near]
    return best, error


def _book_sums(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, sums): the vectors' parts that each entry is nearest to."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                dictionaries, codes = decode_block(row)
                for p in range(parts):
                    own = slice(p * width, (p + 1) * width)
                    best, _ = nearest_entries(dictionaries[own], codes[own], books[p])
                    count[p] += np.bincount(best, minlength=entries)
                    # Sums from how often each entry meets each dictionary value.
                    for j, (values, code) in enumerate(zip(dictionaries[own], codes[own])):
                        met, times = np.unique(best * len(values) + code, return_counts=True)
                        np.add.at(sums[p, :, j], met // len(values), values[met % len(values)] * times)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"])

    found = map_arrow(blocks.select("dictionaries", "codes"), run, "part int, entry int, n bigint, sums array<bigint>")
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)])


def train_codebooks(rows: DataFrame, blocks: DataFrame, dim: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """(part, entry, dimension of the part) integers after ``rounds`` rounds."""
    first = (rows.where(F.size("v") == dim).select("vec_id", "v")
             .orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect())
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in _book_sums(blocks, books).collect():
            books[r.part, r.entry] = [s // r.n for s in r[3:]]
    return books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def assigned(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every vector."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dictionaries, codes = decode_block(row)
                best, error = zip(*(nearest_entries(dictionaries[p * width:(p + 1) * width], codes[p * width:(p + 1) * width], books[p])
                                    for p in range(parts)))
                text = ["".join(f"{e:02x}" for e in entry) for entry in np.array(best).T.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array(text), pa.array(sum(error))],
                    names=["vec_id", "label", "code", "error"])

    return map_arrow(blocks, run, "vec_id bigint, label string, code string, error bigint")


def value_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | Column = "label",
                scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (error over the rows of the same label) and
    codebooks_sha256 (of all final entries, by part, entry and place) of every kept row."""
    spark = vectors.sparkSession
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: entries must be 1 to 256")
    rows = integer_vectors(vectors, id_col, vec_col, label_col, scale)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("dim")).first()
    if first is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    if first.dim % parts:
        raise ValueError(f"vectors of {first.dim} components cannot be cut into {parts} equal parts")
    blocks = write_blocks(rows, first.dim)
    books = train_codebooks(rows, blocks, first.dim, parts, entries, rounds)
    coded = written(assigned(blocks, books), "value-codes")
    totals = written(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "value-totals")
    if totals.count() <= LABELS_BROADCAST:
        totals = F.broadcast(totals)
    return (coded.join(totals, F.col("label").eqNullSafe(F.col("of_label")))
            .select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")))


def _oracle() -> str:
    """DuckDB: the same rounds as plain joins of every part with every entry."""
    steps = []

    def assignment(k: int) -> str:
        return f"""a{k} AS (
  SELECT vec_id, part, v, min(far * 256 + entry) % 256 AS entry, min(far * 256 + entry) // 256 AS error FROM (
    SELECT c.vec_id, c.part, c.v, b.entry,
           list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far
    FROM cut c JOIN b{k} b USING (part)) GROUP BY vec_id, part, v)"""

    for k in range(ROUNDS):
        steps.append(assignment(k))
        steps.append(f"""m{k} AS (
  SELECT part, entry, list(x ORDER BY j) AS v FROM (
    SELECT part, entry, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (
      SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{k}) GROUP BY part, entry, j)
  GROUP BY part, entry),
b{k + 1} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (part, entry))""")
    steps.append(assignment(ROUNDS))
    chain = ",\n".join(steps)
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (
  SELECT vec_id, part, list_slice(v, (part * len(v) // {PARTS} + 1)::BIGINT, ((part + 1) * len(v) // {PARTS})::BIGINT) AS v
  FROM kept, range({PARTS}) p(part)),
b0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM cut
  QUALIFY entry < {ENTRIES}),
{chain},
coded AS (
  SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(error)::BIGINT AS error
  FROM a{ROUNDS} GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS d FROM b{ROUNDS})
SELECT c.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, d AS codebooks_sha256
FROM coded c JOIN kept k USING (vec_id), digest
"""


ORACLE = _oracle()
