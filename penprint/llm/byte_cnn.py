"""Operator 8: language identification with a byte convolutional network.

A text's UTF-8 bytes (lower-cased) are cut into fixed windows of ``WINDOW`` bytes, the last
one padded with zero bytes.  Filters of several widths slide over a window, each filter's
largest response is kept (max pooling, then ReLU), and a softmax layer scores the languages;
a document's score is the byte-weighted mean of its windows' probabilities.  Training is
plain numpy (cross-entropy, Adam); a one-hot convolution is a sum of per-byte table rows,
so scoring adds rows of byte-pair tables.

Fit: at most ``FIT_DOCS`` labelled rows a language (smallest hash of doc_id first; repeats of a row
count, and are learnt once) and
``FIT_WINDOWS`` windows spread over each whole text; those bounds are parameters, and only
these windows reach the driver.  Every text is scored whole, in one pass without a shuffle.

Defined cases: a null text or one without a letter is ``und`` with score 0; ties go to the
first language in order; repeated rows get equal results; a null doc_id is never held out;
with no labelled row every document is ``und``; added columns replace ones of their name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.llm.common import map_arrow, ship

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
FIT_DOCS = 300
FIT_WINDOWS = 4
EPOCHS = 6
_AT_ONCE = 64             # windows scored together: their responses stay in cache
UNDETERMINED = "und"


@dataclass
class ByteCnn:
    """taps[w][j]: (256, filters) response of byte value at tap j of the width-w filters."""
    langs: list[str]
    taps: dict[int, np.ndarray]
    dense: np.ndarray
    bias: np.ndarray

    def pooled(self, windows: np.ndarray, argmax: bool = False):
        """(windows, features) after max pooling; with ``argmax`` also where each maximum is."""
        tables = self._pair_tables()
        across = np.ascontiguousarray(windows.T)        # positions first: maxima run along rows
        pairs = across[:-1].astype(np.int32) * 256 + across[1:]
        out, at = [], []
        for w in WIDTHS:
            n = len(across) - w + 1
            r = None
            for j, table in tables[w]:
                if len(table) == 256:
                    rows = table.take(across[j:j + n], axis=0)
                else:
                    rows = table.take(pairs[j:j + n], axis=0)
                r = rows if r is None else np.add(r, rows, out=r)
            if argmax:
                at.append(r.argmax(axis=0))
            out.append(r.max(axis=0))
        x = np.concatenate(out, axis=1)
        return (x, at) if argmax else x

    def _pair_tables(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        if getattr(self, "_tables", None) is None:
            self._tables = {}
            for w, t in self.taps.items():
                self._tables[w] = [(j, (t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65_536, -1))
                                   if j + 1 < w else (j, t[j]) for j in range(0, w, 2)]
        return self._tables

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(windows), 0) @ self.dense + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def score_texts(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): byte-weighted mean window probabilities."""
        total = np.zeros((len(texts), len(self.langs)))
        held, owner, weight, n_held = [], [], [], 0

        def flush() -> None:
            nonlocal held, owner, weight, n_held
            if not held:
                return
            m = np.concatenate(held)
            p = np.concatenate([self.probabilities(m[i:i + _AT_ONCE]) for i in range(0, len(m), _AT_ONCE)])
            np.add.at(total, np.concatenate(owner), p * np.concatenate(weight)[:, None])
            held, owner, weight, n_held = [], [], [], 0

        for i, raw in enumerate(texts):
            m, w = cut_windows(raw)
            held.append(m)
            owner.append(np.full(len(m), i))
            weight.append(w)
            n_held += len(m)
            if n_held >= 4096:
                flush()
        flush()
        return total

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}


def cut_windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text and the share of its bytes in each."""
    n = max(1, -(-len(raw) // WINDOW))
    m = np.zeros(n * WINDOW, np.uint8)
    m[:len(raw)] = np.frombuffer(raw, np.uint8)
    w = np.full(n, float(WINDOW))
    w[-1] = len(raw) - (n - 1) * WINDOW
    return m.reshape(n, WINDOW), w / max(1, len(raw))


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = EPOCHS,
          filters: int = FILTERS, rate: float = 0.01, seed: int = 7) -> ByteCnn:
    """Cross-entropy with Adam; the pooled maxima alone carry gradient to the filters."""
    rng = np.random.default_rng(seed)
    net = ByteCnn(langs, {w: rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in WIDTHS},
                  rng.normal(0, 0.2, (filters * len(WIDTHS), len(langs))).astype(np.float32),
                  np.zeros(len(langs), np.float32))
    params = [*net.taps.values(), net.dense, net.bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            rows = order[at:at + 64]
            x, y = windows[rows].copy(), labels[rows]
            cut = np.where(rng.random(len(rows)) < 0.3, rng.integers(8, WINDOW, len(rows)), WINDOW)
            x[np.arange(WINDOW)[None, :] >= cut[:, None]] = 0          # short texts end in padding
            net._tables = None
            pooled, where = net.pooled(x, argmax=True)
            active = np.maximum(pooled, 0)
            z = active @ net.dense + net.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ net.dense.T) * (pooled > 0)
            grads = []
            for k, w in enumerate(WIDTHS):
                g = np.zeros_like(net.taps[w])
                part = back[:, k * filters:(k + 1) * filters]
                cols = np.broadcast_to(np.arange(filters), part.shape)
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(x, where[k] + j, axis=1), cols), part)
                grads.append(g)
            grads += [active.T @ p, p.sum(axis=0)]
            step += 1
            for i, (w_, g) in enumerate(zip(params, grads)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w_ -= (rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    net._tables = None
    return net


# ---- Spark jobs ------------------------------------------------------------------------

def _lowered(text_col: str) -> Column:
    return F.coalesce(F.lower(F.col(text_col)).cast("binary"), F.lit(b""))


def _has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learnt from: crc32 of the id's decimal text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        fit_docs: int = FIT_DOCS, fit_windows: int = FIT_WINDOWS) -> ByteCnn | None:
    """Train on a bounded sample of labelled rows that are not held out; None without any."""
    labelled = (docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col) & _has_letter(text_col))
                .select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"),
                        F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text_hash")
    pick = (labelled.select("id", "lang", "text_hash").withColumn("n", F.row_number().over(first))
            .where(F.col("n") <= fit_docs).drop("n").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, cuts = [], [], []
            for d, lang, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                m, _ = cut_windows(raw)
                for k in sorted({(len(m) - 1) * j // max(1, fit_windows - 1) for j in range(fit_windows)}):
                    ids.append(d)
                    langs.append(lang)
                    cuts.append(m[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()),
                                              pa.array(cuts, pa.binary())], names=["id", "lang", "cut"])

    # At most fit_docs rows a language are broadcast, and as many are left: rows of one id and text are one.
    rows = (labelled.join(F.broadcast(pick), ["id", "lang", "text_hash"]).dropDuplicates(["id", "lang", "text_hash"])
            .select("id", "lang", _lowered("text")))
    got = sorted(map_arrow(rows, run, "id long, lang string, cut binary").collect())
    if not got:
        return None
    langs = sorted({r.lang for r in got})
    windows = np.stack([np.frombuffer(bytes(r.cut), np.uint8) for r in got])
    return train(windows, np.array([langs.index(r.lang) for r in got]), langs)


def with_language(docs: DataFrame, model: ByteCnn | None, text_col: str = "text",
                  lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability."""
    if model is None:
        return docs.withColumn(lang_col, F.lit(UNDETERMINED)).withColumn(score_col, F.lit(0.0))
    ship(docs.sparkSession)
    names = np.array(model.langs, object)

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(raw: pa.Array) -> pa.Array:
        p = model.score_texts([x.as_py() for x in raw])
        best = p.argmax(axis=1)
        return pa.StructArray.from_arrays([pa.array(names[best], pa.string()),
                                           pa.array(np.clip(p[np.arange(len(p)), best], 0, 1))], names=["lang", "score"])

    found = docs.withColumn("__found_language", predict(_lowered(text_col)))
    letters = _has_letter(text_col)
    return (found.withColumn(lang_col, F.when(letters, F.col("__found_language.lang")).otherwise(UNDETERMINED))
            .withColumn(score_col, F.when(letters, F.col("__found_language.score")).otherwise(0.0))
            .drop("__found_language"))
