"""Operator 11: embedding near-duplicates by nearest-neighbour descent.

Vectors whose cosine reaches ``threshold`` are linked.  A neighbour graph starts from windows
over the order of random hyperplane codes (a few orders; a window compares its vectors with
each other).  Rounds of descent then refine it: every node shows its neighbours, and those
that name it, to one another, and each keeps the best it meets; a pair is compared again only
if one of its two entries is new.  A node whose whole list reaches the threshold is saturated
and may keep twice as many next round.  Every pair at or above the threshold that is met
becomes a link edge, whether or not it fits a list.  An audit compares ``AUDIT`` vectors with
all rows by brute force; below ``recall`` further orders and rounds follow.  Last, the
members of each component of the link edges are compared with each other in blocks, which
counts every link exactly, in double precision, for clusters larger than any list too.

Scale: equal vectors are one node with a count, made by an aggregate, so copies cost one row
a task.  Candidate search moves unit vectors in half precision, whose error is below ``SLACK``:
pairs within it of the threshold are verified in double precision, clearer ones are certain.
A window or a group of neighbours reports its certain links as a spanning forest.  Orders
are range shuffles by code and a random salt, so a dense cluster lies in many tasks; the
neighbours of a hub are dealt to groups of about ``GROUP`` anew in each round.  Every table
lies in the shared folder; the driver sees counts and the bounded sample only.  The component
pass of a cluster of m vectors compares its m / ``BLOCK`` blocks pairwise and returns counts.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing and are their own component, as are those of another length than most; a
null id is greater than all others, and a component of null ids only has a null id; rows are
vectors of their own even if their ids repeat, equal vectors are linked; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penprint.llm.common import map_arrow, written
from penprint.llm.components import connected_components

THRESHOLD = 0.95
LIST = 12                 # neighbours of a list at first
LARGEST_LIST = 48         # a saturated list doubles up to this; the component pass counts the rest
ORDERS = 8
BITS = 48
WINDOW = 128              # vectors compared with each other in an order; windows overlap by half
OFFERS = 4                # best of a window offered to a vector's list
GROUP = 64
ROUNDS = 4
SETTLED = 0.02            # share of new ones among the entries that link, at which descent stops
AUDIT = 2000
RECALL = 0.98
PASSES = 6
SLACK = 0.0015
BLOCK = 256
_MET = "a bigint, b bigint, sim float, kind byte"
_ENTRY, _CERTAIN, _UNSURE = 0, 1, 2


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)          # no overflow or underflow of squares
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """The rows of a binary column of equal lengths."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4)
    raw = np.frombuffer(column.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
    return raw.view(kind).reshape(n, -1)


def input_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v and usable: whether the vector can link at all, its length aside."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    good = (F.col("v").isNotNull() & (F.size("v") > 0)
            & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    return rows.withColumns({"usable": F.coalesce(good, F.lit(False)), "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})


def make_nodes(rows: DataFrame) -> DataFrame:
    """One node for each distinct usable vector: node, v, copies, first (smallest id), h1, h2."""
    rows = rows.where("usable")
    dim = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dim is None:
        rows = rows.limit(0)
    else:
        rows = rows.where(F.size("v") == dim.dim)
    nodes = rows.groupBy("v", "h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"))
    return written(nodes.withColumn("node", F.monotonically_increasing_id()), "descent-nodes")


def half_units(nodes: DataFrame) -> DataFrame:
    """node and u, its unit vector in half precision."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = unit(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)).astype("<f2")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in u], pa.binary())], names=["node", "u"])

    return written(map_arrow(nodes.select("node", "v"), run, "node bigint, u binary"), "descent-units")


def spanning_forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the symmetric matrix connects."""
    out = []
    open_ = linked.any(axis=1)
    for root in np.flatnonzero(open_).tolist():
        if not open_[root]:
            continue
        open_[root] = False
        stack = [root]
        while stack:
            x = stack.pop()
            reached = np.flatnonzero(linked[x] & open_)
            open_[reached] = False
            out += [(x, y) for y in reached.tolist()]
            stack += reached.tolist()
    return out


class Met:
    """Collects list entries and link edges, and hands them on in batches."""

    def __init__(self, threshold: float):
        self.threshold, self.parts, self.n = threshold, [], 0

    def add(self, a: np.ndarray, b: np.ndarray, sim: np.ndarray, kind: int) -> None:
        if len(a):
            self.parts.append((a, b, sim.astype(np.float32), np.full(len(a), kind, np.int8)))
            self.n += len(a)

    def links(self, ids: np.ndarray, sim: np.ndarray) -> None:
        """Link edges among vectors of the similarities ``sim`` (own pairs and excluded ones at -2)."""
        near = sim >= self.threshold - SLACK
        if not near.any():
            return
        sure = sim >= self.threshold + SLACK
        x, y = np.array(spanning_forest(sure), np.int64).reshape(-1, 2).T
        self.add(ids[x], ids[y], sim[x, y], _CERTAIN)
        x, y = np.nonzero(np.triu(near & ~sure))
        self.add(ids[x], ids[y], sim[x, y], _UNSURE)

    def batch(self) -> pa.RecordBatch:
        a, b, sim, kind = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.n = [], 0
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sim), pa.array(kind)], names=["a", "b", "sim", "kind"])


def in_orders(units: DataFrame, sample: np.ndarray, first: int, threshold: float, orders: int = ORDERS) -> DataFrame:
    """What the windows of ``orders`` random orders meet (``_MET``)."""
    planes = [np.random.default_rng(7919 * (first + t) + 1).standard_normal((sample.shape[1], BITS)) for t in range(orders)]
    cuts = [np.median(sample @ p, axis=0) for p in planes]      # halves, for vectors off the origin too
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = _matrix(b.column(1), "<f2").astype(np.float32)
                code = np.stack([((u @ p > c) * weights).sum(axis=1) for p, c in zip(planes, cuts)], axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(code), pa.list_(pa.int64()))], names=["node", "u", "codes"])

    rows = map_arrow(units, coded, "node bigint, u binary, codes array<bigint>")
    rows = rows.select("node", "u", F.posexplode("codes").alias("turn", "code"))
    key = ["turn", "code", F.xxhash64("node", F.lit(first))]
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key).select("node", "turn", "u")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, step = Met(threshold), WINDOW // 2

        def compare(ids: np.ndarray, turn: np.ndarray, u: np.ndarray) -> None:
            sim = u @ u.T
            sim[turn[:, None] != turn[None, :]] = -2
            np.fill_diagonal(sim, -2)
            k = min(OFFERS, len(ids) - 1)
            if k < 1:
                return
            best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            rows = np.repeat(np.arange(len(ids)), k)
            got = sim[rows, best.ravel()]
            fine = got > -2
            met.add(ids[rows[fine]], ids[best.ravel()[fine]], got[fine], _ENTRY)
            met.links(ids, sim)

        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0), np.float32)]
        fresh = 0                                   # held rows that no window has held yet
        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64), _matrix(b.column(2), "<f2").astype(np.float32)]
            held = [np.concatenate([x, y]) if len(x) else y for x, y in zip(held, new)]
            fresh += b.num_rows
            at = 0
            while len(held[0]) - at >= WINDOW:
                compare(*(x[at:at + WINDOW] for x in held))
                fresh = len(held[0]) - at - WINDOW
                at += step
                if met.n > 50_000:
                    yield met.batch()
            held = [x[at:] for x in held]
        if fresh:
            compare(*held)
        if met.n:
            yield met.batch()

    return map_arrow(dealt, windows, _MET)


def keep_best(entries: DataFrame, threshold: float) -> DataFrame:
    """The lists (a, b, sim, old, size, least) of entries (a, b, sim, old, size): a node's best
    ``size`` (null: ``LIST``); then its size for the next round, doubled if all of them link,
    and the similarity that a new entry must exceed, -2 while the list has room."""
    one = entries.repartition("a").groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("old").alias("old"), F.max("size").alias("size"))
    node = Window.partitionBy("a")
    one = (one.withColumns({"rank": F.row_number().over(node.orderBy(F.desc("sim"), "b")), "size": F.coalesce(F.max("size").over(node), F.lit(LIST))})
           .where(F.col("rank") <= F.col("size")))
    last = F.max(F.when(F.col("rank") == F.col("size"), F.col("sim"))).over(node)
    return written(one.withColumn("least", F.coalesce(last, F.lit(-2.0).cast("float")))
                   .withColumn("size", F.when(F.col("least") >= threshold, F.least(F.col("size") * 2, F.lit(LARGEST_LIST))).otherwise(F.col("size")))
                   .select("a", "b", "sim", "old", "size", "least"), "descent-lists")


def descend(units: DataFrame, lists: DataFrame, turn: int, threshold: float) -> DataFrame:
    """What one round meets (``_MET``): the pairs of neighbours of each node."""
    state = lists.groupBy("a").agg(F.max("least").alias("least")).withColumnRenamed("a", "w")
    fresh = ~F.col("old")
    shown = (lists.select(F.col("a").alias("c"), F.col("b").alias("w"), fresh.alias("fresh"))
             .union(lists.select(F.col("b").alias("c"), F.col("a").alias("w"), fresh.alias("fresh"))))
    hubs = (shown.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP)
            .select(F.col("c").alias("hub"), F.ceil(F.col("n") / GROUP).cast("int").alias("groups")))
    group = F.pmod(F.xxhash64("w", F.lit(turn)), F.coalesce("groups", F.lit(1))).cast("int")
    shown = shown.join(hubs, F.col("c") == F.col("hub"), "left").select("c", group.alias("g"), "w", "fresh")
    vectors = units.join(state, F.col("node") == F.col("w"), "left").select("node", "u", F.coalesce("least", F.lit(-2.0).cast("float")).alias("least"))
    rows = (shown.join(vectors, F.col("w") == F.col("node")).select("c", "g", "w", "fresh", "least", "u")
            .repartition("c", "g").sortWithinPartitions("c", "g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met(threshold)
        held = None

        def compare(ids: np.ndarray, new: np.ndarray, least: np.ndarray, u: np.ndarray) -> None:
            if not new.any() or len(ids) < 2:
                return
            order = np.lexsort((~new, ids))                 # a vector shown twice counts once, as fresh if either is
            order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
            ids, new, least, u = ids[order], new[order], least[order], u[order].astype(np.float32)
            sim = u @ u.T
            sim[~(new[:, None] | new[None, :])] = -2
            np.fill_diagonal(sim, -2)
            x, y = np.nonzero(sim > least[:, None])
            met.add(ids[x], ids[y], sim[x, y], _ENTRY)
            met.links(ids, sim)

        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(),
                   b.column(3).to_numpy(zero_copy_only=False).astype(bool), b.column(4).to_numpy(), _matrix(b.column(5), "<f2")]
            held = new if held is None else [np.concatenate([x, y]) for x, y in zip(held, new)]
            edge = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
            at = 0
            for end in edge.tolist():
                compare(*(x[at:end] for x in held[2:]))
                at = end
                if met.n > 50_000:
                    yield met.batch()
            held = [x[at:] for x in held]
        if held is not None:
            compare(*held[2:])
        if met.n:
            yield met.batch()

    return map_arrow(rows, run, _MET)


def sure_links(met: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the link edges of ``met``; pairs too near the threshold are verified in double precision."""
    unsure = met.where(F.col("kind") == _UNSURE).select("a", "b").distinct()
    v = nodes.select("node", "v")
    pairs = (unsure.join(v.toDF("a", "va"), "a").join(v.toDF("b", "vb"), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (unit(b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)) for k in (2, 3))
                fine = pa.array((x * y).sum(axis=1) >= threshold)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(fine), b.column(1).filter(fine)], names=["a", "b"])

    verified = map_arrow(pairs.select("a", "b", "va", "vb"), run, "a bigint, b bigint")
    return written(met.where(F.col("kind") == _CERTAIN).select("a", "b").union(verified).distinct(), "descent-links")


def audited_recall(nodes: DataFrame, members: DataFrame, sample: DataFrame, threshold: float) -> float:
    """Of the links of the sampled nodes by brute force, the share whose ends share a component."""
    known = {r.node: r.root for r in sample.join(members, "node", "left").select("node", "root").collect()}
    got = sorted((r.node, r.v) for r in sample.collect())
    ids = np.array([i for i, _ in got])
    root = np.array([known[i] if known[i] is not None else -1 for i, _ in got])
    u = unit(np.array([v for _, v in got]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = found = 0
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                node = part.column(0).to_numpy()
                own = part.column(2).fill_null(-2).to_numpy()
                near = unit(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)) @ u.T >= threshold
                near &= node[:, None] != ids[None, :]
                links += int(near.sum())
                found += int((near & (own[:, None] == root[None, :])).sum())
        yield pa.RecordBatch.from_arrays([pa.array([links]), pa.array([found])], names=["links", "found"])

    rows = nodes.select("node", "v").join(members, "node", "left").select("node", "v", "root")
    links, found = map_arrow(rows, run, "links bigint, found bigint").agg(F.sum("links"), F.sum("found")).first()
    return found / links if links else 1.0


def component_links(nodes: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(node, others): rows other than its own copies that a node's vector links with, from
    comparing the members of each component in blocks."""
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sizes = written(sizes, "descent-sizes")
    rows = (members.join(nodes.select("node", "copies", "v"), "node").join(sizes, "root")
            .select("root", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node", "copies", "v")
            .repartition("root", "block").sortWithinPartitions("root", "block"))
    schema = "root bigint, block int, ids binary, copies binary, vectors binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def row(root, block, ids, copies, v) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([root[0]], pa.int64()), pa.array([block[0]], pa.int32()),
                 *(pa.array([x.tobytes()], pa.binary()) for x in (ids.astype("<i8"), copies.astype("<i8"), unit(v).astype("<f8")))],
                names=["root", "block", "ids", "copies", "vectors"])

        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(k).to_numpy() for k in range(4)] + [b.column(4).flatten().to_numpy().reshape(b.num_rows, -1)]
            held = new if held is None else [np.concatenate([x, y]) for x, y in zip(held, new)]
            at = 0
            for end in (np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1).tolist():
                yield row(*(x[at:end] for x in held))
                at = end
            held = [x[at:] for x in held]
        if held is not None:
            yield row(*held)

    blocks = written(map_arrow(rows, pack, schema), "descent-blocks")
    pairs = (sizes.select("root", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
             .select("root", "block", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("other")))
    both = (pairs.join(blocks, ["root", "block"])
            .join(blocks.toDF("root", "other", "ids2", "copies2", "vectors2"), ["root", "other"])
            .select("block", "other", "ids", "copies", "vectors", "ids2", "copies2", "vectors2"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                block, other, *raw = (c[k].as_py() for c in b.columns)
                i, ci, j, cj = (np.frombuffer(raw[n], "<i8") for n in (0, 1, 3, 4))
                near = np.frombuffer(raw[2], "<f8").reshape(len(i), -1) @ np.frombuffer(raw[5], "<f8").reshape(len(j), -1).T >= threshold
                near &= i[:, None] != j[None, :]
                ids, n = i, near @ cj
                if block != other:
                    ids, n = np.concatenate([i, j]), np.concatenate([n, ci @ near])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], names=["node", "n"])

    return map_arrow(both, count, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("others"))


def link_components(nodes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame | None:
    """(node, root) of every node in a component of two or more, or None if there is no link."""
    units = half_units(nodes)
    sample = written(nodes.select("node", "v").orderBy(F.xxhash64("node", F.lit(3)), "node").limit(AUDIT), "descent-sample")
    got = sample.collect()
    if len(got) < 2:
        return None
    middle = unit(np.array([r.v for r in got]))
    lists = members = None
    mets: list[DataFrame] = []
    for turn in range(PASSES):
        met = written(in_orders(units, middle, turn * ORDERS, threshold), "descent-met")
        for step in range(ROUNDS + 1):
            mets.append(met)
            entries = met.where(F.col("kind") == _ENTRY).select("a", "b", "sim", F.lit(False).alias("old"), F.lit(None).cast("int").alias("size"))
            if lists is not None:
                entries = entries.union(lists.select("a", "b", "sim", F.lit(True).alias("old"), "size"))
            lists = keep_best(entries, threshold)
            n, new = lists.where(F.col("sim") >= threshold).agg(F.count(F.lit(1)), F.coalesce(F.sum((~F.col("old")).cast("long")), F.lit(0))).first()
            if step == ROUNDS or step and new <= SETTLED * n:
                break
            met = written(descend(units, lists, turn * ROUNDS + step, threshold), "descent-met")
        members = connected_components(sure_links(reduce(DataFrame.union, mets), nodes, threshold))
        if audited_recall(nodes, members, sample, threshold) >= recall:
            break
    return members


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
                    recall: float = RECALL) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest id reachable) and
    kept (whether that is the row's own) of every row."""
    rows = input_rows(vectors, id_col, vec_col)
    nodes = make_nodes(rows)
    members = link_components(nodes, threshold, recall)
    own = nodes.select("node", "copies", "first", "h1", "h2")
    if members is None:
        found = own.where("copies > 1").select("h1", "h2", (F.col("copies") - 1).alias("n_links"), F.col("first").alias("component_id"))
    else:
        least = members.join(own, "node").groupBy("root").agg(F.min("first").alias("component_id"))
        others = component_links(nodes, members, threshold)
        found = (own.join(members, "node", "left").where("copies > 1 or root is not null").join(least, "root", "left").join(others, "node", "left")
                 .select("h1", "h2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                         F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id")))
    found = written(found, "descent-found").withColumn("linked", F.lit(True))
    return (rows.select("vec_id", "usable", "h1", "h2").join(found, ["h1", "h2"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
