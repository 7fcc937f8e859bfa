"""Operator 3: benchmark decontamination by SimHash windows and multi-index Hamming blocks.

Documents are compared with every benchmark item through windows of the item's own size, one
class of items for each distinct size, at every start that can match: a window reaches the
similarity only if enough of its five-word shingles occur in the benchmark at all, which
running counts tell, and one that begins with an unknown shingle is no better than the next
that does not.  The SimHash of a window left over is read off running bit counts and looked up
in the block tables of the items of its size, which return every item within ``radius`` bits:
no other pair is looked at further.  A bit differs with a chance of at most about 0.15 at a
similarity of 0.8, so ``radius`` (of 64) lies five standard deviations above the mean there.
Candidates are verified exactly: the weighted (multiset) Jaccard similarity of the item's
shingles and those of an item-sized window, over every start around the candidate, must
reach ``similarity``.

Scale: no shuffle; tasks stream documents, ``CHUNK`` words at a time, documents beyond
``SEGMENT`` words in overlapping segments.  The benchmark is read in blocks of at most
``ITEM_BLOCK`` items; each block's index goes to the tasks and costs one pass.  A worker keeps the
indexes of ``HELD`` such blocks; the block tables take 41 KB for every eight items of a size.

Defined cases: null and empty texts match nothing; items without a word match nothing, items
under five words are one shingle of all their words; null item ids stay null; repeated rows
each get their matches; ties between windows go to the smallest start; an empty benchmark
matches nothing; words are lower-cased runs of letters and digits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.llm.common import ship

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 24
CHUNK = 16_384
SEGMENT = 50_000
BLOCKS = 5                    # of 12 or 13 bits
ITEM_BLOCK = 1000
HELD = 8
_WORD = re.compile(r"[^\W_]+")
_MATCHES = "array<struct<item_id: bigint, start_word: int, n_words: int, similarity: double>>"


def word_hashes(text: str) -> np.ndarray:
    import xxhash
    digest = xxhash.xxh64_intdigest
    words = _WORD.findall(text.lower())
    return np.fromiter(map(digest, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h ^ words[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def running_bits(hashes: np.ndarray, longest: int) -> np.ndarray:
    """(n + 1, 64): how often each bit is set before each position, in an unsigned type that
    holds twice ``longest``; differences over at most that many positions survive its wrap."""
    kind = np.uint16 if longest < 32_768 else np.uint64
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((len(hashes) + 1, 64), kind)
    np.cumsum(bits, axis=0, out=out[1:], dtype=kind)
    return out


def majority(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints from bit counts over n shingles."""
    return np.packbits(ones > (n // 2).astype(ones.dtype)[:, None], axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


class HammingBlocks:
    """Multi-index over 64-bit fingerprints: every one within ``radius`` bits of a probe is found.

    The bits are cut into ``BLOCKS`` blocks whose radii, each plus one, add up to ``radius`` + 1:
    fingerprints that are further apart than its radius in every block differ in more than
    ``radius`` bits.  A block's table holds, for each of its values, the set of items whose
    value lies within the block's radius, as bits; a probe is one lookup a block and their union."""

    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.radius = fps, radius
        edges = [64 * j // BLOCKS for j in range(BLOCKS + 1)]
        radii = [(radius + 1 + j) // BLOCKS - 1 for j in range(BLOCKS)]        # -1: no item through this block
        self.blocks = []
        for low, high, r in zip(edges, edges[1:], radii):
            mask = np.uint64((1 << (high - low)) - 1)
            values = np.arange(1 << (high - low), dtype=np.uint64)
            sets = np.zeros((len(values), -(-len(fps) // 8)), np.uint8)
            for i, f in enumerate((fps >> np.uint64(low)) & mask):
                sets[np.bitwise_count(values ^ f) <= r, i >> 3] |= np.uint8(128 >> (i & 7))
            self.blocks.append((np.uint64(low), mask, sets))

    def __call__(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, item) pairs at most ``radius`` bits apart, by probe."""
        found = np.zeros((len(probes), -(-len(self.fps) // 8)), np.uint8)
        for low, mask, sets in self.blocks:
            found |= sets[(probes >> low) & mask]
        probe, item = np.nonzero(np.unpackbits(found, axis=1, count=len(self.fps)))
        near = np.bitwise_count(probes[probe] ^ self.fps[item]) <= self.radius
        return probe[near], item[near]


class SizeClass:
    """Items of one size and the index of their fingerprints."""

    def __init__(self, size: int, items: np.ndarray, fps: np.ndarray, radius: int, similarity: float):
        self.size, self.items, self.similarity = size, items, similarity
        self.candidates = HammingBlocks(fps[items], radius)
        # Unknown shingles that a matching window can begin with.
        self.reach = size - int(np.ceil(similarity * size - 1e-9))

    def least_known(self, n: np.ndarray) -> np.ndarray:
        """Common shingles that a window of n shingles needs to reach the similarity."""
        return np.ceil(self.similarity * (self.size + n) / (1 + self.similarity) - 1e-9)


class ItemIndex:
    """The benchmark items of one shingle length."""

    def __init__(self, k: int, items: list[tuple[int | None, np.ndarray]], radius: int, similarity: float):
        self.k, self.similarity = k, similarity
        self.ids = [i for i, _ in items]
        self.n_words = [len(w) for _, w in items]
        self.shingles = [shingle_hashes(w, k) for _, w in items]
        self.counts = [dict(zip(*(x.tolist() for x in np.unique(s, return_counts=True)))) for s in self.shingles]
        sizes = np.array([len(s) for s in self.shingles])
        fps = np.concatenate([majority(running_bits(s, len(s))[-1:], np.array([len(s)])) for s in self.shingles])
        self.classes = [SizeClass(int(c), np.flatnonzero(sizes == c), fps, radius, similarity) for c in np.unique(sizes)]
        self.known = np.unique(np.concatenate(self.shingles))
        self.overlap = int(sizes.max()) * 2 + k

    def matches(self, docs: list[np.ndarray]) -> list[dict[int, tuple[float, int]]]:
        """For each document's words: item -> (similarity, start word) of the best window."""
        parts = [shingle_hashes(w, self.k) for w in docs]
        sizes = np.array([len(p) for p in parts])
        out: list[dict[int, tuple[float, int]]] = [{} for _ in docs]
        if not sizes.sum():
            return out
        h = np.concatenate(parts)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        owner = np.repeat(np.arange(len(docs)), sizes)
        left = ends[owner] - np.arange(len(h))              # shingles up to the document's end
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        known = self.known[at] == h
        hits = np.concatenate([[0], np.cumsum(known)])
        begin = np.flatnonzero(known)
        ones = None
        for c in self.classes:
            n = np.minimum(left[begin], c.size)
            able = hits[begin + n] - hits[begin] >= c.least_known(n)
            start, n = begin[able], n[able]
            if not len(start):
                continue
            if ones is None:
                ones = running_bits(h, max(c.size for c in self.classes))
            w, item = c.candidates(majority(ones[start + n] - ones[start], n))
            spans: dict[tuple[int, int], list[list[int]]] = {}
            for x, i in zip(start[w].tolist(), c.items[item].tolist()):
                d = int(owner[x])
                low, of = max(x - c.reach, int(begins[d])), spans.setdefault((d, i), [])
                if of and low <= of[-1][1]:         # starts ascend within an item
                    of[-1][1] = x + 1
                else:
                    of.append([low, x + 1])
            for (d, i), ranges in spans.items():
                for low, high in ranges:
                    best = self._best(h, i, low, high, int(ends[d]))
                    if best and (i not in out[d] or (-best[0], best[1] - begins[d]) < (-out[d][i][0], out[d][i][1])):
                        out[d][i] = best[0], int(best[1] - begins[d])
        return out

    def _best(self, h: np.ndarray, item: int, low: int, high: int, end: int) -> tuple[float, int] | None:
        """Best exact similarity of the item's multiset with item-sized windows starting in [low, high)."""
        want, m = self.counts[item], len(self.shingles[item])
        best = None
        have: dict[int, int] = {}
        common = n = 0
        right = low
        part = h[low:min(high + m, end)].tolist()
        for left in range(low, min(high, end)):
            while right < min(left + m, end):
                x = part[right - low]
                right += 1
                n += 1
                if x in want:
                    have[x] = have.get(x, 0) + 1
                    common += have[x] <= want[x]
            score = common / (m + n - common)
            if score >= self.similarity and (best is None or score > best[0]):
                best = score, left
            x = part[left - low]
            n -= 1
            if x in want:
                common -= have[x] <= want[x]
                have[x] -= 1
        return best


def build_indexes(items: list[tuple[int | None, str | None]], radius: int, similarity: float) -> list[ItemIndex]:
    by_k: dict[int, list] = {}
    for i, text in items:
        words = word_hashes(text or "")
        if len(words):
            by_k.setdefault(min(SHINGLE, len(words)), []).append((i, words))
    return [ItemIndex(k, rows, radius, similarity) for k, rows in sorted(by_k.items())]


def find_matches(indexes: list[ItemIndex], texts: list[str]) -> list[list[dict]]:
    """Per text the matched items, by index and item order."""
    out: list[list[dict]] = [[] for _ in texts]
    best: dict[tuple[int, int, int], tuple[float, int]] = {}
    held: list[tuple[int, int, np.ndarray]] = []
    n_held = 0
    step_back = max((x.overlap for x in indexes), default=0)

    def flush() -> None:
        nonlocal held, n_held
        for g, index in enumerate(indexes):
            for (doc, at, _), got in zip(held, index.matches([w for _, _, w in held])):
                for item, (score, start) in got.items():
                    old = best.get((doc, g, item))
                    if old is None or (-score, start + at) < (-old[0], old[1]):
                        best[doc, g, item] = score, start + at
        held, n_held = [], 0

    for doc, text in enumerate(texts):
        words = word_hashes(text)
        seg = max(SEGMENT, 4 * step_back)
        for at in range(0, max(1, len(words) - step_back), seg - step_back):
            part = words[at:at + seg]
            held.append((doc, at, part))
            n_held += len(part)
            if n_held >= CHUNK:
                flush()
    flush()
    for (doc, g, item), (score, start) in sorted(best.items()):
        index = indexes[g]
        out[doc].append({"item_id": index.ids[item], "start_word": start, "n_words": index.n_words[item],
                         "similarity": score})
    return out


_BUILT: dict[tuple, list[ItemIndex]] = {}


def _built(items: tuple, radius: int, similarity: float) -> list[ItemIndex]:
    key = (items, radius, similarity)
    if key not in _BUILT:
        while len(_BUILT) >= HELD:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[key] = build_indexes(list(items), radius, similarity)
    return _BUILT[key]


def _matcher(items: tuple, radius: int, similarity: float):
    @F.arrow_udf(_MATCHES)
    def matched(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int32()), ("n_words", pa.int32()),
                                   ("similarity", pa.float64())]))
        return pa.array(find_matches(_built(items, radius, similarity), texts.to_pylist()), kind)
    return matched


def matches_column(benchmark: DataFrame, text: Column, item_col: str = "item_id", item_text_col: str = "text",
                   radius: int = RADIUS, similarity: float = SIMILARITY, item_block: int = ITEM_BLOCK) -> Column:
    """The matched items of a text as an array of structs."""
    spark = benchmark.sparkSession
    ship(spark)
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t"))
    blocks = max(1, -(-rows.count() // item_block))
    parts = []
    for b in range(blocks):
        block = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        items = tuple(sorted({(r.i, r.t) for r in block.collect()}, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")))

        parts.append(_matcher(items, radius, similarity)(F.coalesce(text, F.lit(""))))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   **options) -> DataFrame:
    """One row per document and matched item: doc_id, item_id, start_word, n_words, similarity."""
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        matches_column(benchmark, F.col(text_col), **options).alias("m"))
    return found.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that match an item."""
    return docs.where(F.size(matches_column(benchmark, F.col(text_col), **options)) == 0)
