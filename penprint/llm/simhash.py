"""Operator 7: SimHash near-duplicates with bit-sliced comparison.

Fingerprints are the majority bits of the XXH64 values (seed 42) of a document's word
shingles.  Two distinct fingerprints within ``radius`` bits agree on at least two of
``radius + 2`` bit blocks, so each fingerprint is posted under one key per pair of blocks
and only fingerprints sharing a key are compared.  A task stores a key's fingerprints as 64
vertical bit planes (one word holds the same bit of 64 fingerprints) and updates the 64
distances at once with carry-save counters that start at ``2^k - 1 - radius``: the carry out
of the last counter marks a distance beyond the radius, and words whose 64 lanes are all
marked are abandoned.

Skew: equal fingerprints collapse to one row before keys are made, so copies never meet in
a group.  A group yields at most one link per member (its local component's smallest
fingerprint), never its pairs; groups beyond ``REFINE_ROWS`` are cut again by the bits they
do not share (``radius + 1`` blocks, one of which must agree), which stays exact.
Components over the links are joined tables (``components.py``).

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any
other; a document with fewer words than a shingle is one shingle; a null doc_id is
fingerprinted and never is a component's id unless no other exists; repeated rows each get
a result row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.llm.common import map_arrow, unsigned_hex, utf8, written
from penprint.llm.components import connected_components

SEED = 42
ALL = np.uint64(0xFFFF_FFFF_FFFF_FFFF)
SMALL_GROUP = 64          # up to here groups are compared together by shifting the planes
REFINE_ROWS = 4096
QUERIES_AT_ONCE = 256
_GRAMS_AT_ONCE = 65_536


# ---- fingerprints ----------------------------------------------------------------------

def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """SimHash of UTF-8 text: ASCII lower case, ASCII white space between words."""
    import xxhash
    digest = xxhash.xxh64_intdigest
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    n = len(words) - shingle + 1
    grams = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle))))
    ones = np.zeros(64, np.int64)
    while part := [digest(g, SEED) for g in islice(grams, _GRAMS_AT_ONCE)]:
        bits = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint as a signed long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))],
                                             names=["doc_id", "text_hash", "fp"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                       utf8(text_col).alias("raw"))
    return map_arrow(rows, run, "doc_id long, text_hash long, fp long")


# ---- bit-sliced comparison -------------------------------------------------------------

def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): plane b holds bit b of every fingerprint, 64 fingerprints a word."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return _packed(bits.T)


def _packed(lanes: np.ndarray) -> np.ndarray:
    """0/1 lanes along the last axis as 64-bit words."""
    pad = -lanes.shape[-1] % 64
    lanes = np.pad(lanes, [(0, 0)] * (lanes.ndim - 1) + [(0, pad)])
    return np.ascontiguousarray(np.packbits(lanes, axis=-1, bitorder="little")).view("<u8").astype(np.uint64)


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words, "<u8").view(np.uint8), axis=-1, bitorder="little").astype(bool)


def within_radius(differ, over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose distance is at most ``radius``.

    ``differ(b, live)`` gives the words of plane b's differing lanes for the word columns in
    ``live``; ``over`` (.., words) marks lanes that need no comparison.
    """
    k = max(1, radius.bit_length())
    start = (1 << k) - 1 - radius
    out = np.zeros_like(over)
    live = np.arange(over.shape[-1])
    counters = [np.full_like(over, ALL if start >> i & 1 else 0) for i in range(k)]
    for b in range(64):
        if b % 4 == 0:
            keep = (over != ALL).reshape(-1, len(live)).any(axis=0)
            if not keep.all():
                if not keep.any():
                    return out
                live, over = live[keep], over[..., keep]
                counters = [c[..., keep] for c in counters]
        carry = differ(b, live)
        for i, c in enumerate(counters):
            counters[i], carry = c ^ carry, c & carry
        over = over | carry
    out[..., live] = ~over
    return out


def _small_pairs(fps: np.ndarray, group: np.ndarray, most: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked row pairs of many small groups at once: row i against row i + s for each shift s."""
    n = len(fps)
    planes = np.pad(bit_planes(fps), [(0, 0), (0, 2)])
    left, right = [], []
    for s in range(1, min(most, n)):
        same = np.zeros(n, np.uint8)
        same[:n - s] = group[s:] == group[:-s]
        at, by = divmod(s, 64)

        def differ(b: int, live: np.ndarray) -> np.ndarray:
            p = planes[b]
            moved = p[live + at]
            if by:
                moved = (moved >> np.uint64(by)) | (p[live + at + 1] << np.uint64(64 - by))
            return p[live] ^ moved

        hit = np.flatnonzero(_lanes(within_radius(differ, ~_packed(same), radius))[:n])
        left.append(hit)
        right.append(hit + s)
    return np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


def _one_group(fps: np.ndarray, radius: int) -> np.ndarray:
    """Local root index of each of a large group's distinct fingerprints, by breadth-first
    search in which every member is compared once with those not reached yet."""
    n = len(fps)
    planes = bit_planes(fps)
    open_ = _packed(np.ones(n, np.uint8))
    root = np.arange(n)
    while (seeds := np.flatnonzero(_lanes(open_)[:n])).size:
        seed = seeds[0]
        todo = np.array([seed])
        open_[seed // 64] &= ~(np.uint64(1) << np.uint64(seed % 64))
        while todo.size:
            now, todo = todo[:QUERIES_AT_ONCE], todo[QUERIES_AT_ONCE:]
            bits = fps[now]

            def differ(b: int, live: np.ndarray) -> np.ndarray:
                one = (bits >> np.uint64(b)) & np.uint64(1)
                return planes[b][live][None, :] ^ np.where(one, ALL, np.uint64(0))[:, None]

            near = within_radius(differ, np.repeat(~open_[None, :], len(now), 0), radius)
            new = np.bitwise_or.reduce(near, axis=0)
            open_ &= ~new
            found = np.flatnonzero(_lanes(new)[:n])
            root[found] = seed
            todo = np.concatenate([todo, found])
    return root


def _refined(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of an oversized group: cut by blocks of the bits on which it varies."""
    varies = int(np.bitwise_or.reduce(fps ^ fps[0]))
    free = [b for b in range(64) if varies >> b & 1]
    if len(free) <= radius + 1:
        return fps, fps[_one_group(fps, radius)]
    a, b = [], []
    for k in range(radius + 1):
        mask = np.uint64(sum(1 << x for x in free[k::radius + 1]))
        x, y = group_links(fps, np.unique(fps & mask, return_inverse=True)[1], radius)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def group_links(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smaller root fingerprint) that join every pair of distinct
    fingerprints within ``radius`` bits in the same group; one link per member and cut at most."""
    order = np.lexsort((fps, group))
    fps, group = fps[order], group[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[starts, len(fps)])
    per_row = np.repeat(size, size)
    out_a, out_b = [], []
    low = 1
    for most in (4, 16, SMALL_GROUP):
        rows = (per_row > low) & (per_row <= most)
        low = most
        if rows.any():
            f = fps[rows]
            left, right = _small_pairs(f, group[rows], most, radius)
            root = np.arange(len(f))
            while left.size:
                m = np.minimum(root[left], root[right])
                if (root[left] == m).all() and (root[right] == m).all():
                    break
                np.minimum.at(root, left, m)
                np.minimum.at(root, right, m)
                root = root[root]
            out_a.append(f)
            out_b.append(f[root])
    for at, n in zip(starts[size > SMALL_GROUP], size[size > SMALL_GROUP]):
        f = fps[at:at + n]
        a, b = _refined(f, radius) if n > REFINE_ROWS else (f, f[_one_group(f, radius)])
        out_a.append(a)
        out_b.append(b)
    a = np.concatenate(out_a) if out_a else np.zeros(0, np.uint64)
    b = np.concatenate(out_b) if out_b else np.zeros(0, np.uint64)
    return a[a != b], b[a != b]


def block_keys(fp: str, radius: int) -> Column:
    """One key per pair of ``radius + 2`` bit blocks: the pair's number and both blocks' bits."""
    n = radius + 2
    cuts = [64 * k // n for k in range(n + 1)]

    def block(k: int) -> Column:
        width = cuts[k + 1] - cuts[k]
        return F.shiftrightunsigned(fp, cuts[k]).bitwiseAND(F.lit((1 << width) - 1))

    return F.array(*[F.xxhash64(F.lit(t), block(x), block(y)) for t, (x, y) in enumerate(combinations(range(n), 2))])


def fingerprint_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) at most ``radius`` bits apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = group_links(fps.view(np.uint64), keys, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            held_k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
            held_f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False)])
            if held_k.size and held_k[0] != held_k[-1]:
                cut = int(np.searchsorted(held_k, held_k[-1]))     # the last key may go on
                yield linked(held_k[:cut], held_f[:cut])
                held_k, held_f = held_k[cut:], held_f[cut:]
        if held_k.size:
            yield linked(held_k, held_f)

    keys = (distinct.select("fp", F.explode(block_keys("fp", radius)).alias("key")).select("key", "fp")
            .repartition("key").sortWithinPartitions("key"))
    return map_arrow(keys, run, "a long, b long")


# ---- components ------------------------------------------------------------------------

def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, text_hash, fp, component (its smallest fingerprint as a signed long) and
    component_id (its smallest doc_id) of every row."""
    fps = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = connected_components(fingerprint_links(distinct, radius)).toDF("fp", "component")
    of_fp = distinct.join(roots, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = of_fp.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_fp = of_fp.drop("first_id").join(least, "component")
    return fps.join(of_fp, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  shingle: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (null first), then the
    smallest text hash; of rows equal in both, one."""
    found = simhash_components(docs, id_col, text_col, shingle, radius)
    keep = (found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
            .select(F.col("k.doc_id").alias("__keep_id"), F.col("k.text_hash").alias("__keep_hash")).distinct())
    hashed = docs.withColumn("__text_hash", F.xxhash64(F.col(text_col)))
    kept = hashed.join(keep, F.col(id_col).cast("long").eqNullSafe(F.col("__keep_id"))
                       & (F.col("__text_hash") == F.col("__keep_hash")), "left_semi")
    return kept.dropDuplicates([id_col, "__text_hash"]).drop("__text_hash")


def simhash_rows(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id."""
    found = simhash_components(docs, **options)
    return found.select("doc_id", unsigned_hex("fp").alias("fingerprint"), "component_id")
