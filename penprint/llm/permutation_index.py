"""Operator 10: approximate nearest neighbours by a permutation index.

A vector is represented by its ``prefix`` nearest pivots in order.  The index is a table of
segments (a bounded run of vectors each): the segment's vectors and, for every pivot, an
inverted list of the rows that have it among their nearest, with its rank there.  A search
walks the lists of a query's own nearest pivots, adding up Spearman's footrule (a pivot
missing from a row counts as rank ``prefix``), keeps each segment's ``share`` of rows with
the smallest distance (ties to smaller ids) and reranks them by cosine in double precision.

Scale: every row is indexed, in one pass without a shuffle; pivots come from a bounded
sample (``SAMPLE`` rows of smallest id hash).  Queries are taken in blocks of at most
``QUERY_BLOCK`` vectors, each block sent to the segments' tasks; a segment answers with its
best ``k`` rows a query, and the answers are cut with a partial top-k before their shuffle.
The index is written to the shared folder, so a lost executor costs its running tasks.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor do those of another length than most; a null id takes no part; a query
finds every row but those with its own id; equal scores go to the smaller id; fewer than k
rows return all; an empty table returns no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.llm.common import map_arrow, written

PIVOTS = 64
PREFIX = 64               # ranks kept of a row: all of them; fewer shorten the lists and cost recall
SHARE = 0.15              # of a segment's rows reranked for each query
LEAST = 200               # rows reranked at least
SAMPLE = 4000
QUERY_BLOCK = 1024
_INDEX = ("ids binary, vectors binary, starts binary, rows binary, ranks binary, n int, dim int")


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and v (array of double) of the rows that take part."""
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
            .where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
            .where(F.exists("v", lambda x: x != 0)))
    sizes = rows.groupBy(F.size("v").alias("dim")).count()
    common = sizes.orderBy(F.desc("count"), "dim").limit(1).select("dim")
    return rows.join(F.broadcast(common), F.size("v") == F.col("dim"), "left_semi")


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)          # no overflow or underflow of squares
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Unit pivots spread over a bounded sample: farthest-first from its first vector, among
    a random half, so that neither outliers nor one dense cluster take all of them."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not got:
        return np.zeros((0, 0))
    u = _unit(np.array([r.v for r in got]))
    u = u[np.sort(np.unique(u, axis=0, return_index=True)[1])]
    rng = np.random.default_rng(11)
    take = rng.permutation(len(u))[:max(pivots * 4, 1)]
    u = u[take]
    if len(u) <= pivots:
        return u
    chosen, near = [0], u @ u[0]
    while len(chosen) < pivots:
        k = int(near.argmin())
        chosen.append(k)
        near = np.maximum(near, u @ u[k])
    return u[chosen]


def permutations(unit: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """(rows, prefix) nearest pivots in order, ties to the lower pivot number."""
    near = -np.round(unit @ pivots.T, 12)
    return np.argsort(near, axis=1, kind="stable")[:, :min(prefix, pivots.shape[0])]


def build_index(rows: DataFrame, pivots: np.ndarray, prefix: int = PREFIX) -> DataFrame:
    """The segment table of all rows, written to the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            perm = permutations(_unit(v), pivots, prefix)
            flat = perm.ravel()
            by_pivot = np.argsort(flat, kind="stable")
            at, rank = np.divmod(by_pivot, perm.shape[1])
            starts = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))
            row = {"ids": ids.astype("<i8"), "vectors": v.astype("<f8"), "starts": starts.astype("<i8"),
                   "rows": at.astype("<i4"), "ranks": rank.astype("<i2")}
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([x.tobytes()], pa.binary()) for x in row.values()),
                 pa.array([len(ids)], pa.int32()), pa.array([v.shape[1]], pa.int32())], names=[*row, "n", "dim"])
    return written(map_arrow(rows.select("vec_id", "v"), run, _INDEX), "permutation-index")


def _answers(index: DataFrame, q_ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, prefix: int,
             k: int, share: float, least: int) -> DataFrame:
    q_perm = permutations(_unit(q), pivots, prefix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = q_perm.shape[1]
        # What a listed row gains over "missing" when the query has the pivot at rank a, the row at b.
        a = np.arange(width)
        gain = np.abs(a[:, None] - a[None, :]) - np.abs(a - width)[:, None]
        q_norm = _norm(q)
        for batch in batches:
            for s in batch.to_pylist():
                ids, v = np.frombuffer(s["ids"], "<i8"), np.frombuffer(s["vectors"], "<f8").reshape(-1, s["dim"])
                starts = np.frombuffer(s["starts"], "<i8")
                rows, ranks = np.frombuffer(s["rows"], "<i4"), np.frombuffer(s["ranks"], "<i2")
                norm = _norm(v)
                n = len(ids)
                most = int(np.unique(ids, return_counts=True)[1].max())
                repeats = most > 1
                keep = min(n, max(least, int(np.ceil(n * share))) + most)  # the query's own rows may be among them
                out_q, out_v, out_s = [], [], []
                for j in range(len(q_ids)):
                    foot = np.zeros(n, np.int64)
                    for rank, p in enumerate(q_perm[j]):
                        part = slice(starts[p], starts[p + 1])
                        if part.stop - part.start == n:                    # every row, in order
                            foot += gain[rank].take(ranks[part])
                        else:
                            foot[rows[part]] += gain[rank][ranks[part]]
                    foot = foot * n + np.arange(n)                         # ties to the smaller id
                    near = np.argpartition(foot, keep - 1)[:keep] if keep < n else np.arange(n)
                    near = near[ids[near] != q_ids[j]]
                    score = (v[near] / norm[near, None] * (q[j] / q_norm[j])).sum(axis=1)
                    best = np.lexsort((ids[near], -score))
                    if repeats:                                            # a row of each id: its nearest
                        best = best[np.sort(np.unique(ids[near][best], return_index=True)[1])]
                    best = best[:k]
                    out_q.append(np.full(len(best), q_ids[j]))
                    out_v.append(ids[near][best])
                    out_s.append(score[best])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_v)), pa.array(np.concatenate(out_s))],
                    names=["query_id", "vec_id", "score"])

    return map_arrow(index, run, "query_id long, vec_id long, score double")


def _norm(m: np.ndarray) -> np.ndarray:
    top = np.abs(m).max(axis=1)
    return top * np.sqrt(((m / top[:, None]) ** 2).sum(axis=1))


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
           pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows found for every row that
    satisfies ``is_query`` (an expression over ``vec_id``)."""
    rows = usable(vectors, id_col, vec_col)
    anchor = choose_pivots(rows, pivots)
    if not len(anchor):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = build_index(rows, anchor, prefix)
    queries = written(rows.where(is_query).select("vec_id", "v"), "queries")
    blocks = -(-queries.count() // QUERY_BLOCK)
    parts = None
    for b in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        got = sorted((r.vec_id, r.v) for r in block.collect())
        if not got:
            continue
        found = _answers(index, np.array([i for i, _ in got]), np.array([v for _, v in got]), anchor, prefix, k, share, least)
        parts = found if parts is None else parts.union(found)
    if parts is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Rows of one id may answer from several segments, and for several queries of one id.
    parts = parts.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
