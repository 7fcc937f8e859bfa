"""Operators 11 to 13 against brute force; nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns."""

import hashlib
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from penprint.llm import filter_audit, nn_descent, value_codebooks

VECTORS = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def with_clashes(df):
    for name in ("v", "node", "part", "mask", "n", "code", "error", "u", "h1", "id", "th", "key", "turn", "a", "b", "sim"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


def vector_rows(n=400, dim=16, seed=0):
    """Random vectors, copies, scaled copies, near copies, a dense cluster, and odd ones."""
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(dim).tolist(), i % 3) for i in range(n)]
    base = [r[1] for r in rows]
    rows += [(1000 + i, base[i], None) for i in range(20)]
    rows += [(1100 + i, (np.array(base[i]) * 7.5).tolist(), 5) for i in range(10)]
    rows += [(1200 + i, (np.array(base[30 + i]) + 0.03 * rng.standard_normal(dim)).tolist(), 6) for i in range(20)]
    centre = rng.standard_normal(dim)
    rows += [(2000 + i, (centre + 0.05 * rng.standard_normal(dim)).tolist(), 7) for i in range(150)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * dim, 1), (3003, [NAN] + [1.0] * (dim - 1), None),
             (3004, [INF] + [1.0] * (dim - 1), 1), (3005, [None] + [1.0] * (dim - 1), 1), (3006, [1.0, 2.0], 1),
             (None, base[2], 1), (5, base[5], 2), (5, base[5], 2), (3007, [1e300] * dim, 1), (3008, [1e-300] * dim, 1)]
    return rows


def brute_links(rows, threshold=0.95):
    """[(id, links, component)] by comparing all pairs."""
    usable = [k for k, (_, v, _) in enumerate(rows) if v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    m = np.array([rows[k][1] for k in usable])
    m = m / np.abs(m).max(axis=1, keepdims=True)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= threshold
    np.fill_diagonal(near, False)
    group = list(range(len(usable)))
    for _ in usable:
        lower = [min([group[k]] + [group[j] for j in np.flatnonzero(near[k])]) for k in range(len(usable))]
        if lower == group:
            break
        group = lower
    out = []
    for k, (i, _, _) in enumerate(rows):
        if k not in usable:
            out.append((i, 0, i))
            continue
        at = usable.index(k)
        ids = [rows[usable[j]][0] for j in range(len(usable)) if group[j] == group[at] and rows[usable[j]][0] is not None]
        out.append((i, int(near[at].sum()), min(ids) if ids else None))
    return out


# ---- 11 --------------------------------------------------------------------------------

def test_links_equal_brute_force(spark):
    rows = vector_rows()
    got = nn_descent.near_duplicates(with_clashes(spark.createDataFrame(rows, VECTORS)))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = got.collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == sorted(brute_links(rows), key=repr)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_links_of_few_and_no_rows(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert nn_descent.near_duplicates(empty).count() == 0
    one = spark.createDataFrame([(4, [1.0, 2.0], 0), (None, None, 0)], VECTORS)
    assert sorted(map(tuple, nn_descent.near_duplicates(one).collect()), key=repr) == [(4, 0, 4, True), (None, 0, None, True)]
    same = spark.createDataFrame([(4, [1.0, 2.0], 0), (3, [1.0, 2.0], 0)], VECTORS)
    assert sorted(map(tuple, nn_descent.near_duplicates(same).collect())) == [(3, 1, 3, True), (4, 1, 3, False)]


def test_descent_finds_what_the_first_windows_miss(spark):
    """Rounds raise the share of true neighbours in the lists, and full lists of links grow."""
    rng = np.random.default_rng(3)
    m = rng.standard_normal((1500, 12))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(m)] + [(2000 + i, (m[0] + 0.02 * rng.standard_normal(12)).tolist(), 0) for i in range(60)]
    nodes = nn_descent.make_nodes(nn_descent.input_rows(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding"))
    units = nn_descent.half_units(nodes)
    at = {r.node: np.array(r.v) for r in nodes.collect()}
    ids = np.array(sorted(at))
    u = nn_descent.unit(np.array([at[i] for i in ids]))
    sim = u @ u.T
    np.fill_diagonal(sim, -2)
    true = {(ids[k], ids[j]) for k in range(len(ids)) for j in np.argsort(-sim[k])[:6]}

    def listed(lists):
        return len(true & {(r.a, r.b) for r in lists.collect()}) / len(true)

    def entries(met, lists=None):
        out = met.where("kind = 0").select("a", "b", "sim", F.lit(False).alias("old"), F.lit(None).cast("int").alias("size"))
        return out if lists is None else out.union(lists.select("a", "b", "sim", F.lit(True).alias("old"), "size"))

    first = nn_descent.keep_best(entries(nn_descent.in_orders(units, u, 0, 0.95, orders=3)), 0.95)
    met = nn_descent.written(nn_descent.descend(units, first, 0, 0.95), "met")
    second = nn_descent.keep_best(entries(met, first), 0.95)
    assert 1 - listed(second) < 0.6 * (1 - listed(first))
    assert all(r.sim > r.least or r.sim == r.least for r in second.collect())
    third = nn_descent.keep_best(entries(met, second), 0.95)
    grown = {r.a for r in second.where("size > 12").collect()}
    sizes = {r.a: r.n for r in third.groupBy("a").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert grown and all(sizes[a] > nn_descent.LIST for a in grown)
    assert all(n <= nn_descent.LIST for a, n in sizes.items() if a not in grown)


def test_forest_connects_what_the_matrix_connects():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40):
        near = rng.random((n, n)) < 1.2 / n
        near |= near.T
        np.fill_diagonal(near, False)
        reach = np.linalg.matrix_power(near.astype(float) + np.eye(n), n) > 0
        kept = np.zeros((n, n), bool)
        for x, y in nn_descent.spanning_forest(near):
            assert near[x, y]
            kept[x, y] = kept[y, x] = True
        assert (np.linalg.matrix_power(kept.astype(float) + np.eye(n), n) > 0).tolist() == reach.tolist()


# ---- 12 --------------------------------------------------------------------------------

def brute_audit(docs, labels):
    import re
    rows = [(i, t or "", s or "") for i, t, s in docs]
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, t, _ in rows:
        first[t] = min(first.get(t, i), i, key=order)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, t, s in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
             "D": bool(re.search(r"[#$%&*|]", t)), "E": order(i) > order(first[t])}
        fails.append((i, s, {k for k, v in f.items() if v}))
    out, shapley = [], {}
    for o in map("".join, permutations("ABCDE")):
        for part in {s for _, s, _ in fails}:
            own = [(i, f) for i, s, f in fails if s == part]
            for k, x in enumerate(o):
                left = [(i, f) for i, f in own if not f & set(o[:k])]
                gone = [i for i, f in left if x in f]
                out.append([part, o, k + 1, len(left) - len(gone), len(gone), sum(x in f for _, f in own) - len(gone),
                            sum(f == {x} for _, f in own), sum(i in good for i in gone), sum(i in toxic for i in gone)])
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
    return sorted(tuple(r + [shapley[r[0], r[1][r[2] - 1]]]) for r in out)


def audit_docs():
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(400)] + ["É", "中文", "#x", "A"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 3, 150, 210, 260]))) for _ in range(120)]
    long = " ".join(f"word{k % 9000}" for k in range(30_000))
    shared = "same start " * 300
    texts += [shared + str(k % 7) for k in range(40)] + [long, long, "a\x0bb\x1cc\x85d\xa0e", "ABC ABC", "a $", "x\ny " * 150]
    docs = [(k, t, f"s{k % 3}") for k, t in enumerate(texts)]
    docs += [(200 + k, texts[k % 25], None if k % 2 else "") for k in range(60)] + [(3, texts[3], "s0"), (4, texts[90], "s0")]
    docs += [(None, texts[1], "s1"), (None, "only without an id", "s1"), (None, "only without an id", "s1"), (500, None, "s1"), (501, "", None)]
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 250, 2)] + [(3, None, 1), (3, 1, None), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_audit_equals_brute_force(spark):
    docs, labels = audit_docs()
    df = with_clashes(spark.createDataFrame([(i, t, s) for i, t, s in docs], "doc_id long, text string, source string"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    want = brute_audit(docs, labels)
    cols = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    for options in ({}, {"heavy": 500, "flush": 3000, "span": 2000}):
        got = filter_audit.filter_audit(df, lab, **options)
        assert got.columns == cols
        assert sorted(map(tuple, got.collect())) == want
    assert filter_audit.filter_audit(df.limit(0), lab).count() == 0
    assert {r.good_lost for r in filter_audit.filter_audit(df, lab.limit(0)).collect()} == {0}


def test_heavy_prefixes_are_cut_longer(spark):
    texts = [b"common beginning of many texts, " * 4 + str(k).encode() for k in range(200)] + [b"other", b""]
    df = spark.createDataFrame([(t, k) for k, t in enumerate(texts)], "text binary, id long")
    keyed, total = filter_audit.adaptive_prefix(df, heavy=1000)
    assert total == sum(map(len, texts))
    keys = {bytes(r.text): bytes(r.key) for r in keyed.collect()}
    assert all(t.startswith(k) for t, k in keys.items()) and keys[b"other"] == b"other"
    assert max(len([1 for x in keys.values() if x == k]) for k in set(keys.values())) == 1


def test_trie_holds_smallest_ids():
    rnd = random.Random(2)
    for _ in range(200):
        texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(9))) * rnd.choice([1, 30]) for _ in range(rnd.randrange(40))]
        trie, want = filter_audit.Trie(), {}
        for t in texts:
            i = rnd.choice([None, *range(50)])
            trie.insert(t, i)
            old = want.get(t, i)
            want[t] = old if i is None else i if old is None else min(old, i)
        assert list(trie.terminals()) == sorted(want.items())


# ---- 13 --------------------------------------------------------------------------------

def brute_codes(rows, entries, rounds, parts=4, scale=1024):
    kept = [(i, [int(max(min(np.floor(x * scale), 1 << 27), -(1 << 27))) for x in v], lab) for i, v, lab in rows
            if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = np.array([r[1] for r in kept], object).reshape(len(kept), parts, width)
    books = [[list(cut[k, p]) for k in range(min(entries, len(kept)))] for p in range(parts)]

    def assign():
        far = [[[sum((a - b) ** 2 for a, b in zip(cut[k, p], e)) for e in books[p]] for p in range(parts)] for k in range(len(kept))]
        return [[(d.index(min(d)), min(d)) for d in row] for row in far]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut[k, p] for k in range(len(kept)) if got[k][p][0] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    got = assign()
    errors = [sum(e for _, e in g) for g in got]
    of_label = {}
    for r, e in zip(kept, errors):
        of_label[r[2]] = of_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{e:02x}" for e, _ in g), err, of_label[r[2]], digest)
                   for r, g, err in zip(kept, got, errors)), key=repr)


@pytest.mark.parametrize("big", [False, True])
def test_codes_equal_brute_force(spark, big, monkeypatch):
    rows = vector_rows(n=120)[:-2]
    rows = [r for r in rows if r[0] is None or not 2040 <= r[0] < 3000]
    if big:
        rows += [(4000, [1e6 + k for k in range(16)], 1), (4001, [-1e300] * 16, 1), (4002, [2e5] * 16, 1)]
    monkeypatch.setattr(value_codebooks, "CHUNK", 37)
    got = value_codebooks.value_codes(with_clashes(spark.createDataFrame(rows, VECTORS)), entries=20, rounds=3)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_codes(rows, 20, 3)


def test_codes_of_few_and_no_rows(spark):
    assert value_codebooks.value_codes(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0
    rows = [(2, [0.5, -0.25, 3.0, 0.0], None), (1, [1.0, 2.0, 3.0, 4.0], None)]
    got = value_codebooks.value_codes(spark.createDataFrame(rows, VECTORS))
    assert sorted(map(tuple, got.collect())) == brute_codes(rows, 256, 4)
    with pytest.raises(ValueError):
        value_codebooks.value_codes(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], VECTORS))


def test_blocks_keep_every_vector():
    rng = np.random.default_rng(0)
    v = rng.integers(-500, 500, (3000, 8))
    row = value_codebooks.encode_block(list(range(3000)), [None] * 3000, v)
    dictionaries, codes = value_codebooks.decode_block(row)
    assert (np.stack([d[c] for d, c in zip(dictionaries, codes)], axis=1) == v).all()
    book = rng.integers(-500, 500, (16, 8))
    best, error = value_codebooks.nearest_entries(dictionaries, codes, book)
    far = ((v[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (best == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
