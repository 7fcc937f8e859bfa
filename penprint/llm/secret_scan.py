"""Operator 6: secret scan with a random forest that removes false positives.

Candidates are runs of 16 or more key characters with a digit, and every value assigned to a
credential name, whatever its length and characters: a quoted value is all between its
quotes (three of them span lines), one without quotes ends at white space or before the next
assignment of a list, less closing punctuation (of values nested in one another, the outermost
and the innermost).  A run inside a longer value is a candidate of its own; equal spans are one.
A forest judges each from its length,
character transitions (how its character classes follow each other, their shares, entropy),
dictionary coverage (share of it made of corpus words), the path of its document (depth,
length, words of tests and samples) and its neighbouring words (credential names, sample
words, assignment and quotes).  It is trained from labelled findings: those given, or, where
no reviewed ones exist, findings labelled by rule (a quoted value assigned to a credential
name is a secret; a run of digits, or a value beside a sample word, is none; others are
left out).

Scale: one pass extracts candidates and features, written once; the forest is fitted on at
most ``FIT_FINDINGS`` labelled findings (smallest hash first, a parameter); every finding is
scored by the fitted Spark model.  The dictionary counts the words of all documents, per
language where the table has one, in an aggregate with map-side combine; its threshold is a
share of the language's documents, so its size follows the vocabulary and not the corpus.

Defined cases: null and empty texts have no candidates; a null path has no features; one
class only among the labels, or no label, gives every finding that class's share; repeated
rows give their findings each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.llm.common import map_arrow, written

FIT_FINDINGS = 20_000
DICT_SHARE = 0.0015        # occurrences a document of the language, and at least three
TREES = 20
DEPTH = 7
_CANDIDATE = re.compile(r"[A-Za-z0-9_+/=-]{16,}")       # and a digit, tested on the run
_DIGIT = re.compile("[0-9]")
_ASSIGNED = re.compile(
    r"(?:token|secret|key|passw|passphrase|pwd|auth|credential|bearer|private)[\w-]{0,64}[\"'`]?\]?[ \t]*"
    r"(?::[ \t]*\w{1,40}[ \t]*(?==))?(?:=>|:=|={1,3}|:)"                      # a type may stand before the sign
    r"(?:\s*(?:\"\"\"(?P<a>.*?)\"\"\"|'''(?P<b>.*?)'''|\"(?P<c>(?:\\.|[^\"\\\n])*)\"|'(?P<d>(?:\\.|[^'\\\n])*)'"
    r"|`(?P<e>[^`\n]*)`)|[ \t]*[\"'`]?(?P<f>[^\s\"'`]))", re.I | re.S)
_VALUE_END = re.compile(r"\s|[,;&](?=[\w-]{1,64}[=:])|\Z")
_WORDS = re.compile(r"[^\W\d_]+")
# Names of credentials, and words that mark samples.
_CREDENTIAL = ("token", "secret", "key", "apikey", "password", "passwd", "pwd", "auth", "credential", "bearer", "private")
_SAMPLE = ("example", "sample", "test", "dummy", "placeholder", "fake", "mock", "demo", "your")


def candidates(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, assigned) of every candidate, in order; assigned: the value of a credential name."""
    values: set[tuple[int, int]] = set()
    at = run_end = 0
    inner = None
    while m := _ASSIGNED.search(text, at):
        start, end = m.span(m.lastgroup)
        at = m.end()
        if m.lastgroup == "f":
            at = start                          # the value may hold an assignment itself
            if start >= run_end:
                run_end, inner = _VALUE_END.search(text, start + 1).start(), None
                kept = start + len(text[start:run_end].rstrip(",;.)]}>\"'`"))
            else:                               # nested values end at one place, found once
                values.discard(inner)
                inner = start, kept
            end = kept
        if end > start:
            values.add((start, end))
    runs = {m.span() for m in _CANDIDATE.finditer(text) if _DIGIT.search(m[0])}
    return [(*span, span in values) for span in sorted(runs | values)]


def char_class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def coverage(candidate: str, dictionary: frozenset[str]) -> float:
    """Share of the candidate covered by dictionary words, longest first from each place."""
    low, at, covered = candidate.lower(), 0, 0
    while at < len(low):
        for n in range(min(12, len(low) - at), 3, -1):
            if low[at:at + n] in dictionary:
                covered += n
                at += n
                break
        else:
            at += 1
    return covered / len(low)


def features(candidate: str, before: str, after: str, path: str, dictionary: frozenset[str],
             assigned: bool = False) -> list[float]:
    n = len(candidate)
    classes = [char_class(c) for c in candidate]
    moves = Counter(zip(classes, classes[1:]))
    share = Counter(classes)
    steps = max(1, len(classes) - 1)
    counts = Counter(candidate)
    words = [w.lower() for w in _WORDS.findall(before)[-3:]]
    follow = [w.lower() for w in _WORDS.findall(after)[:2]]
    low_path = path.lower()
    near = before.rstrip().rstrip("\"'`").rstrip()
    return [
        float(n), math.log(n), -sum(c / n * math.log2(c / n) for c in counts.values()), len(counts) / n,
        *(share[k] / len(classes) for k in range(4)),
        *(moves[a, b] / steps for a in range(4) for b in range(4)),
        coverage(candidate, dictionary), float(all(c in "0123456789abcdef" for c in candidate.lower())),
        float(low_path.count("/") + low_path.count(".")), float(len(path)), float(any(w in low_path for w in _SAMPLE)),
        float(any(w in _CREDENTIAL for w in words)), float(bool(words) and words[-1] in _CREDENTIAL),
        float(any(w in _SAMPLE for w in words + follow)), float(near.endswith(("=", ":", "=>"))),
        float(before[-1:] in "\"'`" and bool(before)), float(after[:1] in "\"'`" and bool(after)),
        float(sum(len(w) for w in words) / max(1, len(words))), float(assigned),
    ]


def rule_label(candidate: str, before: str, after: str) -> int | None:
    """1: quoted value assigned to a credential name; 0: digits only or beside a sample word."""
    words = [w.lower() for w in _WORDS.findall(before)[-2:]]
    if any(w in _SAMPLE for w in words) or candidate.isdigit():
        return 0
    assigned = before[-1:] in "\"'`" and before.rstrip("\"'` ").endswith(("=", ":"))
    if before and assigned and words and words[-1] in _CREDENTIAL:
        return 1
    return None


def dictionary_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                     share: float = DICT_SHARE) -> frozenset[str]:
    """Words of 4 to 12 letters that recur in the documents of a language (of the table, without that column)."""
    rows = docs.select((F.col(lang_col) if lang_col in docs.columns else F.lit("")).cast("string").alias("lang"),
                       F.col(text_col).alias("text"))
    words = (rows.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w"))
             .where(F.length("w").between(4, 12)).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).withColumnRenamed("lang", "of")
    kept = words.join(sizes, F.col("lang").eqNullSafe(F.col("of"))).where(F.col("n") >= F.greatest(F.lit(3.0), share * F.col("docs")))
    return frozenset(r.w for r in kept.select("w").distinct().collect())


def findings(docs: DataFrame, dictionary: frozenset[str], id_col: str = "doc_id", text_col: str = "text",
             path_col: str | None = "source") -> DataFrame:
    """Every candidate: doc_id, start, n_chars, digest (SHA-256), features and rule label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for d, t, p in zip(batch.column(0), batch.column(1), batch.column(2)):
                text, path = t.as_py(), p.as_py()
                for start, end, assigned in candidates(text):
                    c, before, after = text[start:end], text[max(0, start - 64):start], text[end:end + 64]
                    out.append((d.as_py(), start, len(c), hashlib.sha256(c.encode()).hexdigest(),
                                features(c, before, after, path, dictionary, assigned), rule_label(c, before, after)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)],
                                             names=["doc_id", "start", "n_chars", "digest", "features", "rule"])

    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       path.alias("path"))
    return map_arrow(rows, run, "doc_id long, start long, n_chars long, digest string, features array<double>, rule int")


def scan_secrets(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                 path_col: str | None = "source", fit_findings: int = FIT_FINDINGS,
                 keep_from: float = 0.5) -> DataFrame:
    """doc_id, start, n_chars, digest, score and is_secret of every candidate.

    ``labels``: reviewed findings as doc_id, start, is_secret (0 or 1); without them the rule
    labels are used."""
    found = written(findings(docs, dictionary_words(docs, text_col), id_col, text_col, path_col), "findings")
    if labels is None:
        labelled = found.where("rule is not null").withColumn("label", F.col("rule").cast("double"))
    else:
        given = labels.select("doc_id", "start", F.col("is_secret").cast("double").alias("label")).dropDuplicates(["doc_id", "start"])
        labelled = found.join(given, ["doc_id", "start"])
    sample = (labelled.select("features", "label", "digest", "doc_id", "start")
              .orderBy(F.xxhash64("digest", "doc_id", "start"), "doc_id", "start").limit(fit_findings))
    sample = written(sample.withColumn("x", array_to_vector("features")).select("x", "label"), "labelled-findings")
    share = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(share) < 2:
        score = F.lit(next(iter(share), 0.0)).cast("double")
        scored = found.withColumn("score", score)
    else:
        model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=17,
                                       probabilityCol="p", predictionCol="y", rawPredictionCol="r").fit(sample)
        scored = (model.transform(found.withColumn("x", array_to_vector("features")))
                  .withColumn("score", vector_to_array("p")[1]))
    return scored.select("doc_id", "start", "n_chars", "digest", "score").withColumn("is_secret", F.col("score") >= keep_from)
