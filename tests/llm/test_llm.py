"""Training-data operators against brute force, libraries, DuckDB and held-out rows; each
with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from penprint.llm import (byte_cnn, decontaminate, extendible_shards, line_dedup, permutation_index, piece_offsets,
                          secret_scan, simhash, token_planes, weak_quality)
from penprint.llm.components import connected_components
from penprint.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, null, empty, blank and long texts, repeated rows and columns named like outputs."""
    rows = [(1, "One line here.\nAnother line, longer than the first.", "en", "a/b", 3),
            (2, None, None, None, None), (3, "", "en", "x", 0), (4, " \n\t\n ", "en", "x", 5), (5, LONG, "en", "x", 1),
            (None, "No id but a text of some words.", "fr", "y", 2), (6, "One line here.\nÀ côté ★ 中文.", "fr", None, 9),
            (6, "One line here.\nÀ côté ★ 中文.", "fr", None, 9), (7, "12345 !!!", "en", "z", 4)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("score", "shard", "lang_pred", "lines_in", "component_id", "key", "h1", "pos", "line", "m", "v"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- 1 ---------------------------------------------------------------------------------

@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_block_round_trip(planes):
    rng = np.random.default_rng(0)
    for n in (1, 7, 8, 9, 1000, 65_536):
        ids = rng.integers(0, 2 ** 32, n, dtype=np.uint32)
        assert (token_planes.decode_block(token_planes.encode_block(ids, planes), n, planes) == ids).all()


def test_word_encoder_equals_library():
    from tokenizers import Tokenizer
    path = tokenizer_file("word_bpe_49k.json")
    enc, lib = token_planes.WordEncoder(path), Tokenizer.from_file(path)
    rnd = random.Random(1)
    alphabet = "aAbZé ÉßÑŁİſǅ'’.,!$%&09²½\n\t\x1c\x85\xa0 _-<>|中文Σσς́　 ab cd"
    for k in range(1500):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(50))) + ("<|endoftext|>x don't" if k % 40 == 0 else "")
        t = t if k % 2 else "".join(c for c in t if ord(c) < 0x250)
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files(spark, odd, planes):
    from tokenizers import Tokenizer
    path = tokenizer_file("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = token_planes.token_files(odd, path, 2, planes=planes, block_ids=100, shard_ids=150)
    got = sorted(got.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 6, 6, 7]
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    at = 0
    for r in got:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_planes.token_files(odd.limit(0), path, 2).count() == 0


# ---- 2 ---------------------------------------------------------------------------------

def test_pieces_and_spans_equal_library():
    import sentencepiece
    path = tokenizer_file("piece_bpe_32k.model")
    enc, lib = piece_offsets.PieceEncoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert enc.by_segment
    rnd = random.Random(2)
    for _ in range(1500):
        t = "".join(rnd.choice("abc theX  \n\té中文😀▁<s></s>0123.!'​\x00") for _ in range(rnd.randrange(50)))
        ids, raw = enc.encode(t), t.encode()
        begins, ends = enc.spans(t, raw, ids)
        ref = lib.encode(t, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in ref]
        assert begins.tolist() == [p.begin for p in ref] and ends.tolist() == [p.end for p in ref]
        assert enc.decode(ids) == lib.decode(ids.tolist())


def test_compiled_map_equals_library_normaliser():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb
    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True,
                                                remove_extra_whitespaces=True)
    spec = pb.ModelProto()
    spec.ParseFromString(lib.serialized_model_proto())
    enc = object.__new__(piece_offsets.PieceEncoder)
    enc.map, enc.user = piece_offsets.CharacterMap(spec.normalizer_spec.precompiled_charsmap), []
    enc.squeeze = enc.prefix = enc.escape = True
    rnd = random.Random(4)
    for _ in range(400):
        t = "".join(rnd.choice("ab  ﬁ①ＡＢｶﾞé́\t​　中½") for _ in range(rnd.randrange(30)))
        out, back = enc.align(t.encode())
        assert out.decode() == lib.Normalize(t)
        assert len(back) == len(out) + 1 and (np.diff(back) >= 0).all() and back[-1] <= len(t.encode())


def test_piece_digests(spark, odd):
    import hashlib
    import sentencepiece
    path = tokenizer_file("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for r in odd.collect():
        ids = lib.encode(r.text or "")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), lib.decode(ids) if ids else "")]
        want.append((r.doc_id, len(ids), *sha))
    got = piece_offsets.piece_digests(odd, path)
    assert rows_of(got.drop("n_bytes")) == sorted(want, key=repr)
    assert piece_offsets.piece_digests(odd.limit(0), path).count() == 0


# ---- 3 ---------------------------------------------------------------------------------

def test_decontamination_against_brute_force(spark, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    index, = decontaminate.build_indexes(items, decontaminate.RADIUS, decontaminate.SIMILARITY)
    rnd = random.Random(3)
    vocab = " ".join(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()).split()
    docs, want = [], set()
    for k in range(150):
        words = rnd.choice(items)[1].split()
        for _ in range(k % 4):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        text = " ".join(rnd.choices(vocab, k=rnd.randrange(50)) + words + rnd.choices(vocab, k=rnd.randrange(50)))
        docs.append((k, text))
        h = decontaminate.shingle_hashes(decontaminate.word_hashes(text), 5)
        for i in range(len(items)):
            best = index._best(h, i, 0, len(h), len(h))
            if best:
                want.add((k, index.ids[i], best[1], round(best[0], 9)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (1000, 7):
        got = {(r.doc_id, r.item_id, r.start_word, round(r.similarity, 9))
               for r in decontaminate.contaminations(df, bench, item_block=block).collect()}
        # Fingerprints beyond the radius may belong to passages near the least similarity.
        assert got <= want and {x for x in want if x[3] >= 0.9} <= got and len(got) >= 0.98 * len(want)
    assert decontaminate.contaminations(odd, bench).count() == 0
    assert decontaminate.decontaminated(odd, bench.limit(0)).count() == 9
    assert decontaminate.decontaminated(odd.limit(0), bench).count() == 0


def test_decontamination_short_items_long_texts(spark):
    bench = spark.createDataFrame([(1, "two words"), (2, None), (3, ""), (None, "alpha beta gamma delta epsilon zeta")],
                                  "item_id long, text string")
    long = "x " * 120_000 + "two words " + "y " * 30_000 + "Alpha, beta gamma DELTA epsilon zeta"
    df = spark.createDataFrame([(1, long), (2, "two"), (3, None), (4, "Two words")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.start_word) for r in decontaminate.contaminations(df, bench).collect()}
    assert got == {(1, 1, 120_000), (1, None, 150_002), (4, 1, 0)}


@pytest.mark.parametrize("radius", [0, 3, 15, 24])
def test_hamming_blocks_find_every_fingerprint_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2 ** 64, 21, dtype=np.uint64)
    fps[20] = fps[0]
    probes = list(rng.integers(0, 2 ** 64, 500, dtype=np.uint64))
    for k in range(2000):                                    # exactly at the radius, and one bit beyond
        flips = rng.choice(64, radius + k % 2, replace=False)
        probes.append(fps[k % 21] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)) if len(flips) else fps[k % 21])
    probes = np.array(probes, np.uint64)
    apart = np.bitwise_count(probes[:, None] ^ fps[None, :])
    got = decontaminate.HammingBlocks(fps, radius)(probes)
    assert set(zip(*(x.tolist() for x in got))) == set(zip(*(x.tolist() for x in np.nonzero(apart <= radius))))
    assert len(got[0]) >= 1000 and decontaminate.HammingBlocks(fps, radius)(probes[:0])[0].size == 0


def test_decontamination_misses_no_brute_force_match():
    rnd = random.Random(33)
    vocab = [f"w{k}" for k in range(5000)]
    items = [(k, " ".join(rnd.choices(vocab, k=n + 4))) for k, n in enumerate((9, 23, 60, 88, 100, 100, 114, 125, 160, 200, 210))]
    index, = decontaminate.build_indexes(items, decontaminate.RADIUS, decontaminate.SIMILARITY)
    texts, want = [], []
    for k in range(1500):
        words = items[k % len(items)][1].split()
        for _ in range(1 + k % 5):                                   # replaced, lost and added words
            at = rnd.randrange(len(words))
            words[at:at + rnd.choice((1, 1, 0))] = rnd.choice(([rnd.choice(vocab)], [rnd.choice(vocab)], []))
        texts.append(" ".join(rnd.choices(vocab, k=rnd.randrange(90)) + words + rnd.choices(vocab, k=rnd.randrange(90))))
        h = decontaminate.shingle_hashes(decontaminate.word_hashes(texts[-1]), 5)
        best = [(i, index._best(h, i, 0, len(h), len(h))) for i in range(len(items))]
        want.append({(i, b[1], b[0]) for i, b in best if b})
    got = [{(m["item_id"], m["start_word"], m["similarity"]) for m in x} for x in decontaminate.find_matches([index], texts)]
    assert got == want and sum(map(len, want)) > 700 and sum(b[2] < 0.85 for x in want for b in x) > 100


# ---- 4 ---------------------------------------------------------------------------------

def test_expectation_maximisation_recovers_labels():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.8
    acc = np.array([0.95, 0.9, 0.8, 0.7, 0.9])
    right = rng.random((4000, 5)) < acc
    v = np.where(right, y[:, None], ~y[:, None]).astype(int)
    v[rng.random(v.shape) < 0.2] = weak_quality.ABSTAIN
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    post, est, prior = weak_quality.expectation_maximisation(patterns, counts.astype(float))
    of = {tuple(p): q for p, q in zip(patterns, post)}
    assert np.mean([(of[tuple(x)] > 0.5) == t for x, t in zip(v, y)]) > 0.93
    assert abs(prior - 0.8) < 0.05 and np.abs(est[:, 1] - acc).max() < 0.06


def test_quality_scores(spark, odd):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    got = weak_quality.quality_scores(docs).join(labels, "doc_id").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([s >= 0.5 for s in good]) > 0.98
    assert np.mean([a > b for a in good[:200] for b in bad]) > 0.75
    rows = weak_quality.quality_scores(odd, fit_docs=50).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert weak_quality.quality_scores(odd.limit(0)).count() == 0


# ---- 5 ---------------------------------------------------------------------------------

def test_shards_fit_and_match_sql(spark, odd):
    rows = [(1, "x" * 30)] * 50 + [(i, "y" * (i % 7)) for i in range(300)] + [(None, None)] * 3 + [(9999, "z" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(1)).repartition(3)
    got = extendible_shards.with_shards(df, limit=100).withColumn("b", extendible_shards.row_bytes("text"))
    shards = got.groupBy("shard").agg(F.sum("b").alias("b"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in shards) == len(rows)
    assert all(r.b <= 100 or r.n == 1 for r in shards) and sum(r.b > 100 for r in shards) == 1
    prefixes = sorted({r.shard.split(".")[0] for r in shards})
    assert not any(b.startswith(a) and a != b for a, b in zip(prefixes, prefixes[1:]))
    assert extendible_shards.shard_rows(odd).count() == 9
    assert extendible_shards.shard_rows(odd.limit(0)).count() == 0
    check_sql(spark, extendible_shards.shard_rows, extendible_shards.ORACLE, SF01)


def check_sql(spark, fn, sql, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    df = fn(spark.read.parquet(f"{sf}/documents.parquet"))
    assert rows_of(df) == sorted(map(tuple, con.execute(sql).fetchall()), key=repr)


# ---- 6 ---------------------------------------------------------------------------------

def test_secret_forest_on_reviewed_findings(spark, odd):
    rnd = random.Random(6)
    rows, labels = [], []
    for k in range(300):
        value = "".join(rnd.choice("0123456789abcdef") for _ in range(40))
        kind = k % 3
        text = {0: f'config api key = "{value}" end', 1: f"commit {value} merged", 2: f"card {rnd.randrange(10**16, 10**17)} ok"}[kind]
        rows.append((k, text, "src/app/conf.py" if k % 2 else "docs/readme", None))
        labels.append((k, secret_scan._CANDIDATE.search(text).start(), int(kind == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    train = spark.createDataFrame([x for x in labels if x[0] % 4], "doc_id long, start long, is_secret int")
    got = {r.doc_id: r.is_secret for r in secret_scan.scan_secrets(df, train).collect()}
    held = [x for x in labels if x[0] % 4 == 0]
    assert len(got) == 300 and np.mean([got[d] == bool(y) for d, _, y in held]) > 0.95
    assert all(not r.is_secret for r in secret_scan.scan_secrets(odd).collect())
    assert secret_scan.scan_secrets(odd.limit(0)).count() == 0


def test_secret_candidates_of_credential_names(spark):
    cases = [('password = "hunter2!"', "hunter2!"), ("DB_PASSWD: 'correct horse battery staple'", "correct horse battery staple"),
             ('{"pwd": "p@ss.w:rd$"}', "p@ss.w:rd$"), ("password: str = 'abc'", "abc"), ("export API_KEY=a.b:c@d!", "a.b:c@d!"),
             ("Server=x;Password=s$cret;", "s$cret"), ("conf['token'] = \"a\\\"b\"", 'a\\"b'), ('secret = """two\nlines"""', "two\nlines"),
             ("'password' => 'x.y'", "x.y"), ("key=one_token=two", "two"), ("passphrase := `open sesame`", "open sesame")]
    for text, value in cases:
        assert value in [text[a:b] for a, b, assigned in secret_scan.candidates(text) if assigned], text
    assert not any(x[2] for t in ("", "key", 'key = ""', "no name = value", "key:") for x in secret_scan.candidates(t))
    run = "0123456789abcdef" * 2
    assert secret_scan.candidates(f"see {run}") == [(4, 36, False)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {(r.doc_id, r.digest) for r in secret_scan.scan_secrets(df, path_col=None).collect()}
    assert {(k, hashlib.sha256(v.encode()).hexdigest()) for k, (_, v) in enumerate(cases)} <= got


def test_secret_dictionary_counts_every_document_and_language(spark):
    # Half of the hashes are negative: 3,000 documents come before any of the rare language.
    rare = (F.xxhash64("doc_id") > 0) & (F.col("doc_id") % 500 == 0)
    docs = spark.range(6000).toDF("doc_id").select(
        "doc_id", F.when(rare, "kitabu nyumba").otherwise(F.concat(F.lit("common words "), F.when(F.col("doc_id") % 2000 == 1, "seldom").otherwise(""))).alias("text"),
        F.when(rare, "sw").otherwise("en").alias("lang"))
    assert docs.where("lang = 'sw'").count() >= 3
    assert secret_scan.dictionary_words(docs, text_col="text") == {"common", "words", "kitabu", "nyumba"}


def test_secret_features_of_whole_candidates_in_linear_time():
    a, b = ("x1" * 2048 + tail * 2048 for tail in ("word", "9F+/"))
    fa, fb = (secret_scan.features(c, "", "", "", frozenset({"word"})) for c in (a, b))
    assert fa[4:8] == [10240 / 12288, 0.0, 2048 / 12288, 0.0] and fa[4:25] != fb[4:25] and fa[24] == 8192 / 12288
    begin = time.process_time()
    assert secret_scan.candidates("a" * 300_000) == []
    assert len(secret_scan.candidates("key=" * 50_000)) == 2
    assert time.process_time() - begin < 20


# ---- 7 ---------------------------------------------------------------------------------

def components(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("radius,refine", [(0, 4096), (1, 70), (3, 4096), (3, 70), (5, 70)])
def test_group_links_keep_every_link(radius, refine, monkeypatch):
    monkeypatch.setattr(simhash, "REFINE_ROWS", refine)
    rng = np.random.default_rng(radius)
    for groups in (3, 120):
        base = rng.integers(0, 2 ** 63, 12, dtype=np.uint64)
        rows = set()
        for _ in range(400):
            x = int(base[rng.integers(12)])
            for _ in range(rng.integers(0, 6)):
                x ^= 1 << int(rng.integers(64))
            rows.add((int(rng.integers(groups)), x))
        group, fps = (np.array(x) for x in zip(*sorted(rows)))
        fps = fps.astype(np.uint64)
        a, b = simhash.group_links(fps, group, radius)
        near = [(int(fps[i]), int(fps[j])) for i in range(len(fps)) for j in range(i)
                if group[i] == group[j] and fps[i] != fps[j] and int(fps[i] ^ fps[j]).bit_count() <= radius]
        assert components(near) == components(zip(a.tolist(), b.tolist()))


def test_simhash_components(spark, odd):
    df = spark.read.parquet(f"{SF01}/documents.parquet")
    got = sorted(simhash.simhash_rows(df).collect())
    fps = [int(r.fingerprint, 16) for r in got]
    near = [(got[i].doc_id, got[j].doc_id) for i in range(len(got)) for j in range(i)
            if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = components(near)
    assert all(r.component_id == want.get(r.doc_id, r.doc_id) for r in got)
    by_id = {r.doc_id: r for r in simhash.simhash_rows(odd).collect()}
    assert all(by_id[k].fingerprint == "0" * 16 and by_id[k].component_id == 2 for k in (2, 3, 4))
    kept = simhash.simhash_dedup(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 5, 6, 7}
    assert kept.count() == 6
    assert simhash.simhash_rows(odd.limit(0)).count() == 0


def test_fingerprint_definition():
    import xxhash
    words = b"a b c d".split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(2)]
    assert simhash.fingerprint("A b\tC\n d".encode()) == h[0] & h[1]
    assert simhash.fingerprint(b"B  a") == xxhash.xxh64_intdigest(b"b a", 42)


def test_components_of_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 200), (200, 250)]
    df = spark.createDataFrame(pairs, "a long, b long")
    want = components([p for p in pairs if p[0] != p[1]])
    assert {r.node: r.root for r in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).count() == 0


# ---- 8 ---------------------------------------------------------------------------------

def test_language_model(spark, odd):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = byte_cnn.fit(docs)
    got = byte_cnn.with_language(docs, model).withColumn("held", byte_cnn.held_out()).collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held for r in got)
    assert np.mean([r.lang == r.lang_pred for r in got if r.held]) > 0.97
    rows = byte_cnn.with_language(odd, model).collect()
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (2, 3, 4, 7)} == dict.fromkeys((2, 3, 4, 7), "und")
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 9
    assert {r.lang_pred for r in byte_cnn.with_language(odd, byte_cnn.fit(odd.limit(0))).collect()} == {"und"}


def test_fit_samples_are_bounded_in_rows(spark, monkeypatch):
    """Ids repeated over many rows, of one text and of many, do not widen the samples of the fits."""
    words = ["un texte français de tous les jours", "an english text of every day", "ein deutscher text von heute"]
    rows = [(7 if k % 2 else k, words[k % 3] + f" {k if k % 4 else 0}", ["fr", "en", "de"][k % 3]) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    seen = []
    monkeypatch.setattr(byte_cnn, "train", lambda windows, labels, langs: seen.append(np.bincount(labels, minlength=len(langs))))
    byte_cnn.fit(docs, fit_docs=20, fit_windows=1)
    assert len(seen[0]) == 3 and seen[0].max() <= 20 and seen[0].min() > 0
    fitted = []
    real = weak_quality.train
    monkeypatch.setattr(weak_quality, "train", lambda got, labels, **o: fitted.append(len(got)) or real(got, labels, **o))
    bad = spark.createDataFrame([(7, "## $$ %% && ** || @@ ^^ ~~ <> {} " * 9 + str(k), "en") for k in range(300)], docs.schema)
    assert weak_quality.quality_scores(docs.union(bad), fit_docs=50).count() == 900
    assert all(n <= 50 for n in fitted)


# ---- 9 ---------------------------------------------------------------------------------

@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rnd = random.Random(edits)
    rows = []
    for _ in range(500):
        a = "".join(rnd.choice("abé ") for _ in range(rnd.randrange(edits, 25)))
        b = list(a)
        for _ in range(rnd.randrange(5)):
            at = rnd.randrange(len(b) + 1)
            b[at:at + rnd.randrange(2)] = rnd.choice(["", "a", "é", "b "])
        if abs(len(a) - len(b)) <= edits and b:
            rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string").where(F.abs(F.length("a") - F.length("b")) <= edits)
    got = df.select(F.levenshtein("a", "b").alias("t"),
                    line_dedup.banded_distance(F.col("a"), F.col("b"), edits).alias("x")).collect()
    assert all(r.t == r.x for r in got if r.t <= edits or r.x <= edits)


def test_trimmed_distance(spark):
    rnd = random.Random(8)
    rows = []
    for _ in range(300):
        a = "".join(rnd.choice("abé中") for _ in range(rnd.randrange(4, 90)))
        b = list(a)
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(b) + 1)
            b[at:at + rnd.randrange(2)] = rnd.choice(["", "a", "é", "x"])
        if abs(len(a) - len("".join(b))) <= 2:
            rows.append((a, "".join(b)))
    rows += [("x" * 20_000 + "ab", "x" * 20_000 + "ba"), ("abab", "abab")]
    got = spark.createDataFrame(rows, "a string, b string").select(
        line_dedup.trimmed_distance(F.col("a"), F.col("b"), 2).alias("t"), F.levenshtein("a", "b").alias("x")).collect()
    assert all(r.t == r.x for r in got if r.t <= 2 or r.x <= 2) and len(got) > 200


@pytest.mark.parametrize("edits", [1, 2])
def test_near_pairs_miss_nothing(spark, edits):
    rnd = random.Random(edits)
    lines = set()
    for _ in range(60):
        a = "".join(rnd.choice("abcdefgh é") for _ in range(rnd.randrange(24, 40)))
        for _ in range(6):
            b = list(a)
            for _ in range(rnd.randrange(4)):
                at = rnd.randrange(len(b) + 1)
                b[at:at + rnd.randrange(2)] = rnd.choice(["", "a", "é", "x"])
            lines.add("".join(b) + ".")
    df = spark.createDataFrame([(k, x) for k, x in enumerate(sorted(lines))], "doc_id long, text string")
    rows = line_dedup._lines(df, "doc_id", "text")
    got = line_dedup.near_lines(rows, edits, 24).join(rows.select("h1", "line"), "h1").select("line").collect()
    long = [x for x in sorted(lines) if len(x) >= 24]
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(long) for b in long[:i] if abs(len(a) - len(b)) <= edits],
                                  "a string, b string").where(F.levenshtein("a", "b") <= edits).collect()
    assert sorted(r.line for r in got) == sorted({r.a for r in pairs}) and len(pairs) > 20


def test_large_groups_of_near_lines(spark, monkeypatch):
    """More lines a key than a round's leaders: near copies of one line, and unlike lines that share
    segments, each with its later near copy."""
    monkeypatch.setattr(line_dedup, "LEADERS", 3)
    rnd = random.Random(9)
    head, tail = "the same head of many lines of the corpus ", " and the same tail of many lines of it"
    lines = [head + "abcdefghijklmnop" + c + tail for c in "qrstuvwxyz0123456789"]
    unlike = [head + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) + tail for _ in range(30)]
    lines += unlike + [x.replace("many", "mary", 1) for x in unlike[:15]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string").repartition(3)
    rows = line_dedup._lines(df, "doc_id", "text")
    found = {r.h1 for r in line_dedup.near_lines(rows, 2, 24).collect()}
    got = {r.d for r in rows.collect() if r.h1 in found}
    pairs = spark.createDataFrame([(i, j, a, lines[j]) for i, a in enumerate(lines) for j in range(i)], "i int, j int, a string, b string")
    assert got == {r.i for r in pairs.where(F.levenshtein("a", "b") <= 2).collect()} and len(got) >= 34


def test_line_dedup(spark, odd):
    check_sql(spark, line_dedup.line_digests, line_dedup.ORACLE, SF)
    got = line_dedup.dedup_lines(odd)
    assert got.count() == 9
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].text.startswith("One line") and rows[6].text == "À côté ★ 中文." and rows[6].lines_exact == 1
    assert rows[2].text is None and rows[3].text == "" and rows[4].text == " \n\t\n " and rows[5].text == LONG
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_line_dedup_drops_two_edits(spark):
    base = "The meter on platform 17 showed a steady value."
    near = [base.replace("17", "42"), base.replace("meter", "metre"), base.replace("showed a", "shows the"), base + " Never before."]
    df = spark.createDataFrame([(0, base)] + [(k + 1, x) for k, x in enumerate(near)], "doc_id long, text string")
    got = {r.doc_id: r.lines_near for r in line_dedup.line_digests(df).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0}


def test_short_lines_allow_fewer_edits(spark):
    """An edit from 12 characters on, two from 24 on, none below; against all pairs."""
    rnd = random.Random(12)
    lines = []
    for _ in range(40):
        a = "".join(rnd.choice("abcdefgh é") for _ in range(rnd.randrange(3, 30))).strip() + "."
        lines.append(a)
        for _ in range(4):
            b = list(a)
            for _ in range(rnd.randrange(1, 3)):
                at = rnd.randrange(len(b))
                b[at:at + rnd.randrange(2)] = rnd.choice(["", "a", "é", "x"])
            lines.append("".join(b) or "x")
    lines = list(dict.fromkeys(x for x in lines if x.strip()))
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in line_dedup.line_digests(df).collect() if r.lines_near}
    pairs = spark.createDataFrame([(i, a, lines[j]) for i, a in enumerate(lines) for j in range(i) if abs(len(a) - len(lines[j])) <= 2],
                                  "i int, a string, b string").withColumn("x", F.levenshtein("a", "b")).collect()
    near = {r.i for r in pairs if r.x <= min(2, min(len(r.a), len(r.b)) // 12)}
    assert got == near and any(len(lines[i]) < 24 for i in near) and any(len(lines[i]) >= 24 for i in near)
    assert any(r.x <= 2 and r.i not in near for r in pairs)


# ---- 10 --------------------------------------------------------------------------------

def test_permutation_index(spark):
    df = spark.read.parquet(f"{SF01}/embeddings.parquet")
    rows = df.collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    got = permutation_index.search(df, F.col("vec_id") % 50 == 0).collect()
    hits = n = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        s[q] = -2
        want = ids[np.lexsort((ids, -np.round(s, 12)))[:5]]
        mine = [r for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == ids[q]]
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - s[np.flatnonzero(ids == r.vec_id)[0]]) < 1e-12 for r in mine)
        hits += len(set(want) & {r.vec_id for r in mine})
        n += 5
    assert hits / n >= 0.9


def test_permutation_index_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]),
            (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (50, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = permutation_index.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, round(r.score, 9)) for r in got] == [
        (0, 1, 1.0), (0, 2, 1.0), (0, 3, 0.0), (0, 50, -1.0), (50, 3, 0.0), (50, 0, -1.0), (50, 1, -1.0), (50, 2, -1.0)]
    assert permutation_index.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_permutation_index_repeated_ids(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(60)]
    schema = "vec_id long, embedding array<double>"
    want = permutation_index.search(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0)
    want = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in want.orderBy("query_id", "rank").collect()]
    nearest = next(v for q, rank, v, _ in want if (q, rank) == (0, 1))
    again = rows + [rows[0]] * 400 + [rows[nearest]] * 30 + [rows[50]]     # queries and answers repeated
    got = permutation_index.search(spark.createDataFrame(again, schema).repartition(3), F.col("vec_id") % 50 == 0, least=20)
    assert [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got.orderBy("query_id", "rank").collect()] == want
    other = spark.createDataFrame(rows + [(7, rows[0][1])], schema)        # id 7 with a second vector, that of query 0
    first = permutation_index.search(other, F.col("vec_id") == 0).orderBy("rank").collect()
    assert first[0].vec_id == 7 and abs(first[0].score - 1) < 1e-12 and len({r.vec_id for r in first}) == 5


# ---- pipeline --------------------------------------------------------------------------

def test_pipeline_stages(spark, odd):
    import corpus_pipeline as p
    base = spark.read.parquet(f"{SF}/documents.parquet")
    text = base.where("length(text) > 600 and lang = 'en'").orderBy("doc_id").first().text
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(9001, "12 34 !!!"), (9002, None), (9003, text), (9004, text.replace("\n", " ") + " " + item)]
    docs = base.unionByName(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS))
    steps = {}
    for name, stage in p.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        steps[name] = {r.doc_id for r in docs.collect()}
        if name != "sentencepiece":
            assert docs.columns == before.columns
    assert {9001, 9002}.isdisjoint(steps["language_id"]) and {9003, 9004} <= steps["language_id"]
    assert 9003 not in steps["line_dedup"] and 9004 in steps["line_dedup"]
    assert 9004 in steps["simhash_dedup"] and 9004 not in steps["decontaminate"]
    assert steps["sentencepiece"] == steps["decontaminate"] and len(steps["sentencepiece"]) > 120
    for name, stage in p.STAGES:
        assert stage(spark, odd.select(base.columns).limit(0), SF).count() == 0
