"""Operator 4: quality classifier from weak labels.

Several overlapping heuristics vote good, bad or abstain on every document.  Expectation
maximisation (two latent classes, one accuracy a labeller and class, abstention carrying no
evidence) is run on the histogram of vote patterns, which counts all documents and has at
most ``3 ** labellers`` rows.  The posterior of a document's pattern is its soft label, and a
linear scorer over hashed words, word endings and word lengths is trained on a bounded
sample of soft labels, then applied to every whole text.

Scale: two passes over the text, no text shuffle; the histogram has map-side aggregation;
the sample is ``fit_docs`` documents (smallest hash of doc_id first, a parameter) whose
hashed counts reach the driver.

Defined cases: null and empty texts get the votes of a text without words, so they score
low; repeated rows score alike; a null doc_id is never sampled but is scored; with one class
only the scorer returns the class prior; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.llm.common import map_arrow, utf8, written

GOOD, BAD, ABSTAIN = 1, 0, 2
DIMS = 1 << 15
FIT_DOCS = 4000
BETTER_THAN_CHANCE = 0.55  # least accuracy a labeller is held to have on either class
_SYMBOL = re.compile(r"[#$%&*|@^~<>{}\\]")
_SENTENCE_END = frozenset(".!?…")
_PUNCTUATION = frozenset(".,;:!?…\"'»«”’)]-")


# ---- labellers -------------------------------------------------------------------------

def _by(value: float, bad_below: float, good_from: float, good_to: float, bad_above: float) -> int:
    if value < bad_below or value > bad_above:
        return BAD
    return GOOD if good_from <= value <= good_to else ABSTAIN


def votes(text: str) -> list[int]:
    """One vote a labeller: symbol share, symbol-ended words, lone symbols, letter share,
    repeated neighbours, distinct words, sentence ends, capitals, repeated lines, length."""
    words = text.split()
    n = len(words)
    if not words:
        return [ABSTAIN] * 9 + [BAD]
    solid = sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    lone = sum(1 for w in words if len(w) <= 3 and not any(map(str.isalnum, w)))
    marked = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in _PUNCTUATION and len(w) > 1)
    again = sum(map(str.__eq__, words, words[1:]))
    ends = sum(1 for w in words if w[-1] in _SENTENCE_END)
    return [
        _by(len(_SYMBOL.findall(text)) / solid, 0, 0, 0.003, 0.02),
        _by(marked / n, 0, 0, 0.03, 0.1),
        _by(lone / n, 0, 0, 0.01, 0.05),
        _by(sum(map(str.isalpha, text)) / solid, 0.8, 0.92, 1, 1),
        ABSTAIN if n < 10 else _by(again / n, 0, 0, 0.02, 0.08),
        ABSTAIN if n < 30 else _by(len(set(words)) / n * (n / 100) ** 0.3, 0.25, 0.45, 9, 99),
        ABSTAIN if n < 20 else _by(ends / n, 0.008, 0.02, 0.4, 0.6),
        _by(sum(map(str.isupper, text)) / solid, 0, 0, 0.12, 0.4),
        ABSTAIN if len(lines) < 3 else _by(1 - len(set(lines)) / len(lines), 0, 0, 0.15, 0.4),
        BAD if n < 5 else ABSTAIN if n < 20 else GOOD,
    ]


LABELLERS = len(votes("a"))


def pattern(votes_: list[int]) -> int:
    return sum(v * 3 ** k for k, v in enumerate(votes_))


def unpack(code: int) -> list[int]:
    return [code // 3 ** k % 3 for k in range(LABELLERS)]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200,
                             prior_good: float = 0.8) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, accuracies (labeller, class) and the prior.
    ``patterns`` is (patterns, labellers) of votes."""
    spoke = patterns != ABSTAIN
    good = patterns == GOOD
    # acc[j, y]: probability that labeller j votes y on a document of class y when it speaks.
    acc = np.full((patterns.shape[1], 2), 0.75)
    prior = prior_good
    post = np.full(len(patterns), prior)
    for _ in range(rounds):
        yes = np.where(good, np.log(acc[:, 1]), np.log(1 - acc[:, 1]))
        no = np.where(good, np.log(1 - acc[:, 0]), np.log(acc[:, 0]))
        odds = np.log(prior) - np.log(1 - prior) + ((yes - no) * spoke).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        w1, w0 = counts * new, counts * (1 - new)
        for y, w, agrees in ((1, w1, good), (0, w0, ~good)):
            seen = (w[:, None] * spoke).sum(axis=0)
            right = (w[:, None] * (spoke & agrees)).sum(axis=0)
            acc[:, y] = np.clip((right + 3) / (seen + 4), BETTER_THAN_CHANCE, 0.98)   # a weak belief in 3/4
        prior = float(np.clip(w1.sum() / max(counts.sum(), 1), 0.05, 0.95))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return post, acc, prior


# ---- hashed linear scorer --------------------------------------------------------------

def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and unit-length values: words, last characters and lengths."""
    words = text.split()
    counts: dict[int, float] = {}
    forms: Counter = Counter()
    for w, c in Counter(words).items():
        k = zlib.crc32(w.lower().encode()) % DIMS
        counts[k] = counts.get(k, 0.0) + c
        last = w[-1]
        forms["a" if last.isalnum() else last, min(len(w), 16), w.isupper()] += c
    out_k = np.fromiter(counts, np.int64, len(counts))
    out_v = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    norm = np.sqrt((out_v ** 2).sum()) or 1.0
    shape: dict[int, float] = {}
    for (last, size, upper), c in forms.items():
        for name in (f"e{last}", f"l{size}", f"u{upper}"):
            k = zlib.crc32(b"\0" + name.encode()) % DIMS
            shape[k] = shape.get(k, 0.0) + c / len(words)
    shape[0] = shape.get(0, 0.0) + min(1.0, len(words) / 50)
    k = np.concatenate([out_k, np.fromiter(shape, np.int64, len(shape))])
    v = np.concatenate([out_v / norm, np.fromiter(shape.values(), np.float64, len(shape)) * 2])
    return k.astype(np.int32), v.astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 20,
          rate: float = 0.3, decay: float = 1e-5, seed: int = 5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by AdaGrad."""
    rng = np.random.default_rng(seed)
    w, g2 = np.zeros(DIMS), np.full(DIMS, 1e-8)
    bias, b2 = 0.0, 1e-8
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            k, v = rows[i]
            err = 1 / (1 + np.exp(-np.clip(w[k] @ v + bias, -30, 30))) - labels[i]
            g = err * v + decay * w[k]
            g2[k] += g * g
            w[k] -= rate * g / np.sqrt(g2[k])
            b2 += err * err
            bias -= rate * err / np.sqrt(b2)
    return w.astype(np.float32), float(bias)


# ---- Spark jobs ------------------------------------------------------------------------

def vote_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the code of its vote pattern, written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [pattern(votes(t.as_py().decode("utf-8", "replace"))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int32())], names=["doc_id", "votes"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("raw"))
    return written(map_arrow(rows, run, "doc_id long, votes int"), "votes")


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   fit_docs: int = FIT_DOCS, keep_from: float = 0.5) -> DataFrame:
    """doc_id, weak_label (posterior of its votes), score and keep of every row."""
    voted = vote_table(docs, id_col, text_col)
    histogram = voted.groupBy("votes").count().orderBy("votes").collect()       # 3 ** labellers rows at most
    if not histogram:
        return docs.sparkSession.createDataFrame([], "doc_id long, weak_label double, score double, keep boolean")
    post, _, prior = expectation_maximisation(np.array([unpack(r.votes) for r in histogram]),
                                              np.array([r["count"] for r in histogram], float))
    posterior = {r.votes: float(p) for r, p in zip(histogram, post)}

    pick = (voted.where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
            .select(F.col("doc_id").alias("__fit_id")).distinct())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1):
                text = t.as_py().decode("utf-8", "replace")
                out.append((pattern(votes(text)), *(x.tobytes() for x in hashed(text))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[k] for r in out], kind)
                                    for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary())))],
                names=["doc_id", "votes", "k", "v"])

    ids = F.col(id_col).cast("long")
    # fit_docs ids are broadcast; rows of one id and text are one, and fit_docs rows are left.
    sample = (docs.join(F.broadcast(pick), ids == F.col("__fit_id"))
              .select(ids.alias("doc_id"), utf8(text_col).alias("raw"))
              .withColumn("text_hash", F.xxhash64("raw")).dropDuplicates(["doc_id", "text_hash"])
              .orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(fit_docs).select("doc_id", "raw"))
    got = sorted(map_arrow(sample, features, "doc_id long, votes int, k binary, v binary").collect(),
                 key=lambda r: (r.doc_id, r.votes, bytes(r.k)))
    rows = [(np.frombuffer(bytes(r.k), np.int32), np.frombuffer(bytes(r.v), np.float32)) for r in got]
    labels = np.array([posterior[r.votes] for r in got])
    if len(rows) and labels.min() < 0.5 < labels.max():
        weights, bias = train(rows, labels)
    else:
        weights, bias = np.zeros(DIMS, np.float32), float(np.log(prior / (1 - prior)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weak, scores = [], []
            for t in batch.column(1):
                text = t.as_py().decode("utf-8", "replace")
                k, v = hashed(text)
                weak.append(posterior.get(pattern(votes(text)), prior))
                scores.append(float(1 / (1 + np.exp(-np.clip(weights[k] @ v + bias, -30, 30)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weak), pa.array(scores)],
                                             names=["doc_id", "weak_label", "score"])

    rows = docs.select(ids.alias("doc_id"), utf8(text_col).alias("raw"))
    return (map_arrow(rows, score, "doc_id long, weak_label double, score double")
            .withColumn("keep", F.col("score") >= keep_from))
