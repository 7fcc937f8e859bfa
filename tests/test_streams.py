"""Streams against their batch forms over several runs: change table, bounded seen set,
quota across runs (SURVEY J2, J3, F7, A7)."""

import datetime as dt

from pyspark.sql import functions as F

from penprint.operators import collect as C
from penprint.streaming import incremental as ST
from penprint.streaming.change_table import ChangeTable

SF01 = "/root/testdata/sf0.01"
DAY = dt.datetime(2024, 1, 1)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def arrive(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def parts_by_time(spark, n):
    events = spark.read.parquet(f"{SF01}/events.parquet")
    cuts = events.agg(F.percentile_approx("ts", [k / n for k in range(1, n)]).alias("c")).first()["c"]
    part = sum(((F.col("ts") >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    return events, [events.where(part == k) for k in range(n)]


def test_running_counts_write_changed_authors_only(spark, tmp_path):
    events, parts = parts_by_time(spark, 3)
    few = parts[2].where(F.col("user_id") < 10)
    src, table, chk = (str(tmp_path / x) for x in ("src", "table", "chk"))
    for part in (parts[0], parts[1], few):
        arrive(part, src)
        ST.running_author_counts(spark, src, "*.parquet", table, chk, events.schema)     # a restart each time
    good = parts[0].unionByName(parts[1]).unionByName(few).where(F.col("event_type") != "error")
    want = rows_of(C.items_per_author(good, "user_id"))
    assert rows_of(ST.read_author_counts(spark, table)) == want
    changed = spark.read.parquet(f"{table}/changes/b2")
    assert 0 < changed.count() <= 10 < len(want)


def test_change_table_compaction_replay_and_torn_writes(spark, tmp_path):
    t = ChangeTable(spark, str(tmp_path / "t"), ["k"], "k long, v long")
    assert t.current().count() == 0
    want, before = {}, {}
    folded = 0
    for b in range(20):
        before[b] = dict(want)
        new = {k: b for k in range(b % 5, b % 5 + 3)} | {100 + b: b}
        want |= new
        rows = spark.createDataFrame([*new.items()], "k long, v long")
        for _ in range(2 if b == 12 else 1):                       # a replayed micro-batch
            assert dict(rows_of(t.current(b))) == before[b]
            t.append(rows, b)
            folded += t.compact(b)
        assert dict(rows_of(t.current())) == want
    assert folded >= 2 and len(t._complete("base", "v")) == 2 and len(t._complete("changes", "b")) < 20
    torn = tmp_path / "t" / "changes" / "b20"
    spark.createDataFrame([(1, -1)], "k long, v long").write.parquet(str(torn))
    (torn / "_SUCCESS").unlink()                                   # lost before it was committed
    assert dict(rows_of(t.current())) == want


def test_seen_set_forgets_and_drops_late_rows(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    src, out, chk = (str(tmp_path / x) for x in ("src", "out", "chk"))
    runs = [[(1, 0, 1), (2, 0, 1), (3, 0, 2)],                    # id 1 twice at once
            [(4, 1, 1), (5, 10, 3)],                              # id 1 again within its time; id 3 moves the watermark on
            [(6, 10, 1), (7, 2, 2), (8, 2, 9)]]                   # id 1 as new; id 2 and the unseen id 9 come too late
    state = []
    for rows in runs:
        arrive(spark.createDataFrame([(e, DAY + dt.timedelta(days=d), u, "view") for e, d, u in rows], schema), src)
        progress = ST.stream_seen_set(spark, src, "*.parquet", out, chk, spark.read.schema(schema).parquet(src).schema,
                                      ["view"], "2 days")
        state.append(progress[-1]["stateOperators"][0]["numRowsTotal"])
    got = rows_of(spark.read.parquet(out).select("item_id", F.dayofyear("ts")))
    assert got == [(1, 1), (1, 11), (2, 1), (3, 11)]
    assert state == [2, 1, 2]                                      # ids 1 and 2; id 3 alone; ids 1 and 3


def test_quota_over_interrupted_runs_equals_batch(spark, tmp_path):
    events, parts = parts_by_time(spark, 5)
    for limit in (7, 30):
        src, out, table, chk = (str(tmp_path / f"{x}{limit}") for x in ("src", "out", "table", "chk"))
        for part in parts:
            arrive(part, src)
            ST.stream_paged_quota(spark, src, "*.parquet", out, table, chk, events.schema, "user_id", ["ts", "event_id"],
                                  F.col("event_type") != "error", limit)
        want = C.paged_quota(events, "user_id", ["ts", "event_id"], F.col("event_type") != "error", limit)
        cols = ["user_id", "event_id", "page"]
        assert rows_of(spark.read.parquet(out).select(cols)) == rows_of(want.select(cols))
        done = ST.quota_table(spark, table, "user_id").current()
        assert done.where("finished").count() > 100
        # A finished user is read no further.
        later = spark.createDataFrame([(10 ** 9 + k, dt.datetime(2025, 1, 1), done.where("finished").first().user_id)
                                       for k in range(3)], "event_id long, ts timestamp, user_id long")
        taken, ends, _ = ST.continue_quota(later, done, "user_id", ["ts", "event_id"], F.lit(True), limit)
        assert taken.count() == 0 and ends.count() == 0


def test_quota_page_cut_by_a_run_and_null_users(spark):
    schema = "user_id long, n long, ok boolean"
    rows = [(1, k, k % 2 == 0) for k in range(23)] + [(None, 99, True)] + [(2, 50 + k, None) for k in range(3)]
    full = spark.createDataFrame(rows, schema)
    want = C.paged_quota(full.where("user_id is not null").na.fill(False, ["ok"]), "user_id", ["n"], F.col("ok"), 4, page_size=5)
    state = spark.createDataFrame([], "user_id long, seen long, accepted long, on_page long, page long, finished boolean")
    got = []
    for low, high in ((0, 3), (3, 4), (4, 13), (13, 100)):          # pages of five, cut in the middle
        part = full.where((F.col("n") >= low) & (F.col("n") < high))
        taken, ends, _ = ST.continue_quota(part, state, "user_id", ["n"], F.col("ok"), 4, page_size=5)
        got += [(r.user_id, r.n, r.page) for r in taken.collect()]
        changed = ends.collect()
        kept = [r for r in state.collect() if r.user_id not in {c.user_id for c in changed}]
        state = spark.createDataFrame([tuple(r) for r in kept + changed], state.schema)
    assert sorted(got) == rows_of(want.select("user_id", "n", "page"))
    assert {(r.user_id, r.seen, r.accepted) for r in state.where("user_id = 2").collect()} == {(2, 3, 0)}


def test_shared_folder_is_never_local_on_a_cluster(spark, monkeypatch):
    import pytest

    from penprint import session
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")

    class Cluster:
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    monkeypatch.setattr(session, "checkpoint_dir", lambda s, fallback=None: fallback)
    with pytest.raises(ValueError):
        session.shared_dir(Cluster)
