"""Operator 12: interaction audit of corpus filters, with exact duplicates from radix tries.

Five filters look at whole texts: A few words, B few distinct words, C many capitals, D
marks, E a text that a smaller id holds as well.  A document's failures are a mask of five
bits; for every part of the corpus, order of the filters and step, the audit counts what the
step keeps and removes, what it would have removed had nothing gone before, what only it
removes, which labelled documents it removes, and its share over all orders.

E comes from tries.  Each task inserts the texts it reads into a compressed radix trie
whose terminals hold the smallest id, and sends on one row for a distinct text.  These are
dealt out in the order of an adaptive prefix: ``PREFIX`` bytes, longer by ``WIDEN`` times
wherever the texts that share them weigh more than ``HEAVY`` bytes.  Every range is inserted
into a trie of its own; its traversal yields the smallest id of each text, and all other
documents of that text fail E.

Scale: the shuffle carries each task's distinct full texts once; a text that a third of all
rows hold is one row a task, and texts that share a long prefix are spread by a longer one.
Prefixes are weighed in ``BUCKETS`` sums by hash (a fixed size on the driver; prefixes that
meet in one bucket are only cut finer than needed).  Everything else runs on narrow rows, added up
before each shuffle.  Masks are reduced to at most 32 x 4 counts a part before orders are
laid out.  Task tries are flushed at ``FLUSH`` bytes.  Tables lie in the shared folder.

Defined cases: a null text is empty; null and empty parts are one part, the empty string;
null ids come after all others and are not smaller than one another; rows of equal id are
not smaller than one another, so repeated rows pass E together; a document is good or toxic
if any of its labels says so, unlabelled or null otherwise; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.llm.common import map_arrow, utf8, written

FILTERS = "ABCDE"
LEAST_WORDS = 200
MARKS = b"#$%&*|"
PREFIX, WIDEN = 16, 4
HEAVY = 8 << 20
BUCKETS = 1 << 16
RANGE = 24 << 20          # bytes of text meant for one range
FLUSH = 48 << 20
OUT_BATCH = 4 << 20
_UPPER = bytes(range(65, 91))
_CONTINUATION = bytes(range(0x80, 0xC0))


class Trie:
    """A compressed radix trie of byte strings; a terminal holds the smallest id inserted."""

    __slots__ = ("root", "bytes")

    def __init__(self):
        self.root = [b"", {}, False, None]          # label, children by first byte, terminal, smallest id
        self.bytes = 0

    def insert(self, text: bytes, number: int | None) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = [text[at:], {}, True, number]
                self.bytes += len(text) - at + 200
                return
            label = child[0]
            if not text.startswith(label, at):
                keep = common_length(label, text, at)
                upper = [label[:keep], {label[keep]: child}, False, None]
                child[0] = label[keep:]
                node[1][text[at]] = child = upper
                self.bytes += 200
                label = upper[0]
            node, at = child, at + len(label)
        if not node[2]:
            node[2], node[3] = True, number
        elif number is not None and (node[3] is None or number < node[3]):
            node[3] = number

    def terminals(self) -> Iterator[tuple[bytes, int | None]]:
        """(text, smallest id) of every distinct text, in byte order."""
        stack = [(self.root, b"")]
        while stack:
            node, above = stack.pop()
            text = above + node[0]
            if node[2]:
                yield text, node[3]
            stack.extend((node[1][k], text) for k in sorted(node[1], reverse=True))


def common_length(label: bytes, text: bytes, at: int) -> int:
    """Bytes that ``label`` shares with ``text`` from ``at``: less than all of ``label``."""
    low, high = 0, len(label)
    while high - low > 1:
        mid = (low + high) // 2
        if text.startswith(label[low:mid], at + low):
            low = mid
        else:
            high = mid
    return low


def failures(text: bytes) -> int:
    """Bits 1, 2, 4, 8 for the failed filters A to D."""
    words = text.split()                            # bytes split at space and \t to \r, as wanted
    distinct = len(set(words))
    capitals = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _CONTINUATION))
    return ((len(words) < LEAST_WORDS) | (100 * distinct < 50 * len(words)) << 1 | (100 * capitals > 2 * points) << 2
            | (len(text.translate(None, MARKS)) < len(text)) << 3)


def masks(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, mask, th) of every document, th a hash of its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = pa.array([failures(t) for t in b.column(2).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), mask, b.column(3)], names=["id", "part", "mask", "th"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       utf8(text_col).alias("text"), F.xxhash64(utf8(text_col)).alias("th"))
    return map_arrow(rows, run, "id bigint, part string, mask int, th bigint")


def _batches(rows: Iterator[tuple[bytes, int | None]]) -> Iterator[pa.RecordBatch]:
    texts, ids, n = [], [], 0
    for text, number in rows:
        texts.append(text)
        ids.append(number)
        n += len(text)
        if n >= OUT_BATCH or len(texts) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(ids, pa.int64())], names=["text", "id"])
            texts, ids, n = [], [], 0
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(ids, pa.int64())], names=["text", "id"])


def _tried(flush: int):
    """Rows (text, id) of a task through tries; one is emptied at ``flush`` bytes, 0 for never."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for b in batches:
            for text, number in zip(b.column(0), b.column(1)):
                trie.insert(text.as_buffer().to_pybytes(), number.as_py())
                if flush and trie.bytes > flush:
                    yield from _batches(trie.terminals())
                    trie = Trie()
        yield from _batches(trie.terminals())
    return run


def adaptive_prefix(texts: DataFrame, prefix: int = PREFIX, heavy: int = HEAVY) -> tuple[DataFrame, int]:
    """``texts`` with ``key``, the leading bytes that place a text, and the bytes of all texts."""
    size = F.octet_length("text")
    longest, total = texts.agg(F.coalesce(F.max(size), F.lit(0)), F.coalesce(F.sum(size), F.lit(0))).first()
    key, deep, length = F.substring("text", 1, prefix), F.lit(True), prefix
    while length < longest:
        bucket = F.pmod(F.xxhash64(F.lit(length), F.substring("text", 1, length)), F.lit(BUCKETS)).cast("int")
        sums = texts.where(deep).groupBy(bucket.alias("k")).agg(F.sum(size).alias("n")).where(F.col("n") > heavy).collect()
        if not sums:
            break
        dense = bytearray(BUCKETS)
        for r in sums:
            dense[r.k] = 1
        deep = deep & (F.substring(F.lit(bytes(dense)), bucket + 1, F.lit(1)) == F.lit(b"\x01"))
        length *= WIDEN
        key = F.when(deep, F.substring("text", 1, length)).otherwise(key)
    return texts.withColumn("key", key), total


def first_ids(docs: DataFrame, id_col: str, text_col: str, heavy: int = HEAVY, flush: int = FLUSH, span: int = RANGE) -> DataFrame:
    """(id, th): for every distinct text its smallest id and its hash."""
    rows = docs.select(utf8(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    texts = written(map_arrow(rows, _tried(flush), "text binary, id bigint"), "audit-texts")
    keyed, total = adaptive_prefix(texts, heavy=heavy)
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // span))
    dealt = keyed.repartitionByRange(ranges, "key").select("text", "id")
    return map_arrow(dealt, _tried(0), "text binary, id bigint").select("id", F.xxhash64("text").alias("th"))


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
                **options) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part with these failures, E as bit 16."""
    rows = masks(docs, id_col, text_col, part_col).groupBy("id", "part", "mask", "th").agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows, "audit-masks")
    firsts = written(first_ids(docs, id_col, text_col, **options), "audit-firsts").select(F.col("id").alias("fid"), F.col("th").alias("fth"))
    said = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("lid"))
            .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    both = (rows.join(firsts, (F.col("th") == F.col("fth")) & F.col("id").eqNullSafe(F.col("fid")), "left")
            .withColumn("mask", F.when(F.col("fth").isNull(), F.col("mask") + 16).otherwise(F.col("mask")))
            .groupBy("id", "part", "mask").agg(F.sum("n").alias("n")))
    both = both.join(said, F.col("id") == F.col("lid"), "left")
    return both.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"))


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from counts by mask."""
    orders = ["".join(o) for o in permutations(filters)]
    bit = {f: 1 << k for k, f in enumerate(filters)}
    places: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for o in orders:
        for step, f in enumerate(o, 1):
            places.setdefault((sum(bit[g] for g in o[:step - 1]), bit[f]), []).append((o, step))
    case = F.explode(F.array(*[F.struct(F.lit(before).alias("before"), F.lit(own).alias("own")) for before, own in places])).alias("c")
    mask, before, own = F.col("mask"), F.col("before"), F.col("own")
    fails, reached = mask.bitwiseAND(own) != 0, mask.bitwiseAND(before) == 0

    def count(of: str, cond) -> F.Column:
        return F.sum(F.when(cond, F.col(of)).otherwise(0)).cast("long")

    share = F.floor(F.lit(len(orders)) / F.greatest(F.bit_count(mask), F.lit(1)))       # orders that reach it first
    found = (counts.select("*", case).select("part", "mask", "n", "good", "toxic", "c.*").groupBy("part", "before", "own").agg(
        count("n", reached & ~fails).alias("kept"), count("n", reached & fails).alias("removed"),
        count("n", ~reached & fails).alias("redundant"), count("n", mask == own).alias("unique_fails"),
        count("good", reached & fails).alias("good_lost"), count("toxic", reached & fails).alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * share).otherwise(0)).cast("long").alias("shapley")))
    laid = F.explode(F.element_at(F.create_map(*[x for (b, o), at in places.items() for x in (
        F.lit(b * 64 + o), F.array(*[F.struct(F.lit(order).alias("filter_order"), F.lit(step).alias("step")) for order, step in at]))]),
        F.col("before") * 64 + F.col("own")))
    return (found.select("*", laid.alias("at"))
            .select("part", "at.*", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The audit of the five filters over ``docs``."""
    return audit(mask_counts(docs, labels, **options))


# DuckDB: masks by regular expressions and a window over whole texts, orders by joins.
ORACLE = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM texts),
said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masked AS (
  SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
       + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
       + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (doc_id > first_id)::INT AS mask,
       coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM words LEFT JOIN said USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, mask),
letters AS (SELECT substr('ABCDE', i, 1) AS f, (1 << (i - 1)) AS own FROM range(1, 6) t(i)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.own + b.own + c.own + d.own + e.own = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, step::INT AS step, own,
         coalesce((SELECT sum(x.own) FROM letters x WHERE position(x.f IN filter_order) < step), 0)::INT AS before
  FROM orders, range(1, 6) s(step) JOIN letters l ON l.f = substr(filter_order, step, 1)),
counted AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (WHERE mask & (before | own) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""
