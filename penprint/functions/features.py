"""Stylometric and character n-gram features.

Features of a text are computed in Arrow batches: its code points become one integer array, from
which character classes are counted by a table and n-grams by sorting integers.
"""

from __future__ import annotations

import sys
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from penprint.functions.charclass import lower_preimage
from penprint.functions.text import WS_RUN_PATTERN, as_col
from penprint.session import ship

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
CHARS = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
DIACRITICS = "áčďéěíňóřšťúůýž"
STYLE_SCALARS = ["avg_len", "len_text", "len_words", "num_short_w", "per_digit", "per_cap",
                 "richness"]
SHORT_WORD = 3                  # words shorter than this count as short
NGRAM_TOP = 100                 # vocabulary size per n-gram order
NGRAM_ORDERS = (2, 3)
CODE_BITS, EXACT_ORDER = 21, 3  # bits of a code point; code points that fit in a 64-bit key
CHARS_AT_ONCE = 1_000_000       # characters whose grams are counted together
# ---------------------------------------------------------------------------

FREQ_CHARS = CHARS + DIGITS + DIACRITICS
STYLE_COLUMNS = STYLE_SCALARS + [f"cf_{c}" for c in FREQ_CHARS]


def words(text) -> Column:
    """Python ``str.split()``: runs of Unicode whitespace separate, empties dropped."""
    return F.filter(F.split(as_col(text), WS_RUN_PATTERN), lambda w: w != "")


@lru_cache(maxsize=None)
def _char_kinds() -> np.ndarray:
    """For every code point ``4 * column + 2 * upper + digit``: the frequency column that its lower
    case belongs to (the one after the last for none) and whether it counts as a digit or upper case."""
    kinds = np.full(sys.maxunicode + 1, 4 * len(FREQ_CHARS), dtype=np.int16)
    for k, c in enumerate(FREQ_CHARS):
        for x in lower_preimage(c):
            kinds[ord(x)] = 4 * k
    for c in range(sys.maxunicode + 1):
        kinds[c] += 2 * chr(c).isupper() + chr(c).isdigit()
    return kinds


def _per_text(text, fn, returns) -> Column:
    """``fn`` of every text, in Arrow batches."""
    ship(SparkSession.active())

    @F.pandas_udf(returns)
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(fn)

    return each(as_col(text))


def _codes(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def _style(text: str | None) -> list:
    if text is None:
        return [None] * len(STYLE_COLUMNS)
    ws = text.split()
    n, n_words = len(text), len(ws)
    kinds = np.bincount(_char_kinds()[_codes(text)], minlength=4 * len(FREQ_CHARS) + 4).reshape(-1, 4)
    digits, upper = int(kinds[:, 1::2].sum()), int(kinds[:, 2:].sum())
    of_words = [sum(map(len, ws)) / n_words, len(set(ws)) / n_words] if n_words else [None, None]
    of_chars = [digits / n, upper / n] if n else [None, None]
    freqs = (kinds[:-1].sum(axis=1) / n).tolist() if n else [None] * len(FREQ_CHARS)
    short = sum(1 for w in ws if len(w) < SHORT_WORD)
    return [of_words[0], float(n), float(n_words), float(short), *of_chars, of_words[1], *freqs]


def style_array(text) -> Column:
    """I1 + I2: the values of ``STYLE_COLUMNS`` as one array; a text is read once for all of them."""
    return _per_text(text, _style, ArrayType(DoubleType()))


def style_columns(text) -> list[Column]:
    """I1 + I2: the 58 style columns, all DOUBLE, named as in ``STYLE_COLUMNS``."""
    values = style_array(text)           # one Python evaluation a row, whatever columns are taken
    return [values[i].alias(c) for i, c in enumerate(STYLE_COLUMNS)]


def char_ngrams(text, n: int) -> Column:
    """All overlapping character n-grams of a text, in order."""
    return char_ngrams_of(F.split(as_col(text), ""), n)


def char_ngrams_of(chars: Column, n: int) -> Column:
    """All overlapping n-grams of an array of characters, in order.

    Shifted slices of the array are zipped, so every array is built once per row (an element
    lookup inside a lambda would rebuild the array per element).
    """
    m = F.greatest(F.lit(0), F.size(chars) - (n - 1))
    out = F.slice(chars, 1, m)
    for j in range(1, n):
        out = F.zip_with(out, F.slice(chars, j + 1, m), lambda a, b: F.concat(a, b))
    return out


def padded(text) -> Column:
    """One space on each side of a document stands in for the joining space."""
    return F.concat(F.lit(" "), as_col(text), F.lit(" "))


def _gram_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """One integer per n-gram, the same for the same gram: code points side by side for up to three,
    beyond that numbers which hold within ``codes`` only."""
    m = max(0, len(codes) - n + 1)
    keys = codes[:m]
    for j in range(1, n):
        if j >= EXACT_ORDER:
            keys = np.unique(keys, return_inverse=True)[1]
        keys = (keys << CODE_BITS) | codes[j:j + m]
    return keys


def _n_distinct(ordered: np.ndarray) -> int:
    return int(np.count_nonzero(ordered[1:] != ordered[:-1])) + 1 if len(ordered) else 0


def distinct_ngrams(text, n: int) -> Column:
    """Number of distinct n-grams of a text."""
    def distinct(t: str | None) -> int | None:
        return None if t is None else _n_distinct(np.sort(_gram_keys(_codes(t), n)))

    return _per_text(text, distinct, IntegerType())


def _term_hash(term: bytes) -> int:
    """The 32-bit Murmur3 of ``pyspark.ml.feature.HashingTF`` (seed 42), signed."""
    def mixed(k: int) -> int:
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        return (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF

    h, whole = 42, len(term) & ~3
    for i in range(0, whole, 4):
        h ^= mixed(int.from_bytes(term[i:i + 4], "little"))
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= mixed(int.from_bytes(term[whole:], "little")) ^ len(term)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


@lru_cache(maxsize=1 << 18)
def _bucket(key: int, n: int, num_features: int) -> int:
    chars = [chr(key >> CODE_BITS * (n - 1 - j) & (1 << CODE_BITS) - 1) for j in range(n)]
    return _term_hash(" ".join(chars).encode("utf-8", "surrogatepass")) % num_features


def hashed_ngrams(text, num_features: int, n: int = 3) -> Column:
    """The vector of ``NGram`` and ``HashingTF`` over a text's characters; each distinct gram of a
    text is hashed once, and frequent ones once a task."""
    def hashed(t: str | None):
        grams, counts = np.unique(_gram_keys(_codes(t or ""), n), return_counts=True)
        buckets = np.fromiter((_bucket(k, n, num_features) for k in grams.tolist()), dtype=np.int64, count=len(grams))
        found, where = np.unique(buckets, return_inverse=True)
        return SparseVector(num_features, found, np.bincount(where, weights=counts, minlength=len(found)))

    if n > EXACT_ORDER:
        raise ValueError(f"n-grams of at most {EXACT_ORDER} characters, got {n}")
    ship(SparkSession.active())
    return F.udf(hashed, VectorUDT(), useArrow=False)(as_col(text))      # vectors do not come back as Arrow


def _count_grams(texts: list[str], n: int) -> tuple[list[str], list[int]]:
    """The n-grams inside the texts and how often each occurs."""
    if n > EXACT_ORDER:
        counts = Counter(t[i:i + n] for t in texts for i in range(len(t) - n + 1))
        return list(counts), list(counts.values())
    keys = _gram_keys(_codes("".join(texts)), n)
    left = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    inside = np.arange(len(keys)) + n <= left[:len(keys)]        # not those that run over the end of a text
    found, counts = np.unique(keys[inside], return_counts=True)
    chars = np.stack([(found >> (CODE_BITS * (n - 1 - j))) & ((1 << CODE_BITS) - 1) for j in range(n)], axis=1)
    joined = chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [joined[i:i + n] for i in range(0, len(joined), n)], counts.tolist()


def ngram_counts(df: DataFrame, text_col: str = "text", orders=NGRAM_ORDERS) -> DataFrame:
    """Corpus-wide counts ``(n, gram, cnt)`` of overlapping n-grams of padded texts.

    One pass: every task counts the grams of about ``CHARS_AT_ONCE`` characters at a time, and
    Spark adds up those counts, in the task and over the shuffle.  The order of a gram is its length.
    """
    def count(batches):
        def counted(texts):
            for n in orders:
                grams, counts = _count_grams(texts, n)
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(counts, pa.int64())], ["gram", "cnt"])

        held, size = [], 0
        for batch in batches:
            for t in batch.column(0).drop_null():
                held.append(t.as_py())
                size += len(held[-1])
                if size >= CHARS_AT_ONCE:
                    yield from counted(held)
                    held, size = [], 0
        if held:
            yield from counted(held)

    ship(df.sparkSession)
    return (df.select(padded(text_col).alias("text")).mapInArrow(count, "gram string, cnt long")
            .groupBy("gram").agg(F.sum("cnt").alias("cnt"))
            .select(F.length("gram").cast("int").alias("n"), "gram", "cnt"))


def top_ngrams(counts: DataFrame, top: int = NGRAM_TOP) -> DataFrame:
    """G-2: ``top`` most frequent grams per order; ties broken by gram (lexical).

    ``row_number() <= top`` is planned as a partial WindowGroupLimit per order.
    """
    from pyspark.sql import Window
    w = Window.partitionBy("n").orderBy(F.desc("cnt"), F.asc("gram"))
    return (counts.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= top)
            .select("n", F.col("rank").cast("int").alias("rank"), "gram", "cnt"))


def collect_vocabulary(vocab: DataFrame) -> dict[int, list[str]]:
    """The vocabulary is bounded by ``NGRAM_TOP`` per order, so it is brought to the
    driver once and inlined into the plan as literals."""
    out: dict[int, list[str]] = {}
    for r in vocab.orderBy("n", "rank").collect():
        out.setdefault(int(r["n"]), []).append(r["gram"])
    return out


def _overlaps_itself(gram: str) -> bool:
    return any(gram[:k] == gram[-k:] for k in range(1, len(gram)))


def ngram_frequencies(text, vocabulary: dict[int, list[str]]) -> Column:
    """For each vocabulary gram, non-overlapping occurrences (``str.count``) divided by
    the number of distinct grams of that order in the text; one array, bigrams first.

    A text's grams are sorted once per order and the vocabulary is looked up there; only grams
    that can overlap themselves, such as ``aa``, are counted on their own."""
    orders = {n: list(vocabulary[n]) for n in sorted(vocabulary) if vocabulary[n]}
    apart = {n: [i for i, g in enumerate(grams) if n > EXACT_ORDER or len(g) != n or _overlaps_itself(g)]
             for n, grams in orders.items()}
    keys = {n: np.array([_gram_keys(_codes(g), n)[0] if len(g) == n and n <= EXACT_ORDER else -1 for g in grams])
            for n, grams in orders.items()}

    def of(t: str | None) -> list:
        out = []
        codes = None if t is None else _codes(t)
        for n, grams in orders.items():
            found = np.sort(_gram_keys(codes, n)) if codes is not None else ()
            if not len(found):
                out += [None] * len(grams)
                continue
            counts = np.searchsorted(found, keys[n], "right") - np.searchsorted(found, keys[n], "left")
            for i in apart[n]:
                counts[i] = t.count(grams[i])
            out += (counts / float(_n_distinct(found))).tolist()
        return out

    return _per_text(text, of, ArrayType(DoubleType()))
