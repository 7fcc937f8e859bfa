"""Registered queries: streaming jobs run to completion.

Each query streams the driver's table file through ``trigger(availableNow=True)`` into a
sink under the session's checkpoint folder and returns the sink read back as a batch
frame; the SQL twin is the batch query it must equal.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from penprint import oracles as O
from penprint.catalog import register
from penprint.plans.queries_collect import HOST_MARKER, QUOTA, _QUOTA_SQL
from penprint.session import shared_dir
from penprint.sources.corpus import LISTING_PRIORITY, read_table
from penprint.streaming import incremental as S


LISTED_FOR = "45 days"      # an item listed again after that long counts as new
RUNS = 3


def _scratch(spark) -> str:
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


@register("j1_incremental_collect", f"""
SELECT {O.user_from_url('url', HOST_MARKER)} AS author, url AS article_url, text FROM (
  SELECT url, {O.html_main_text('html')} AS text FROM pages WHERE NOT (html IS NULL OR contains(html, 'class="c-404"')))
WHERE text IS NOT NULL""")
def j1_incremental_collect(spark, sf):
    base = _scratch(spark)
    schema = read_table(spark, sf, "pages").schema
    S.incremental_collect(spark, sf, "pages.parquet", f"{base}/out", f"{base}/chk", schema, ("ad",))
    return spark.read.parquet(f"{base}/out")


@register("j2_seen_set", f"""
SELECT DISTINCT user_id AS item_id FROM events
WHERE event_type IN ({', '.join(O.q(x) for x in LISTING_PRIORITY)})""")
def j2_seen_set(spark, sf):
    base = _scratch(spark)
    schema = read_table(spark, sf, "events").schema
    S.stream_seen_set(spark, sf, "events.parquet", f"{base}/out", f"{base}/chk", schema, LISTING_PRIORITY, LISTED_FOR)
    return spark.read.parquet(f"{base}/out").select("item_id")


@register("j3_running_author_counts", """
SELECT user_id, count(*) AS n_items FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def j3_running_author_counts(spark, sf):
    base = _scratch(spark)
    schema = read_table(spark, sf, "events").schema
    S.running_author_counts(spark, sf, "events.parquet", f"{base}/table", f"{base}/chk", schema)
    return S.read_author_counts(spark, f"{base}/table").select("user_id", F.col("n_items").cast("long"))


@register("f7_quota_across_runs", f"WITH {_QUOTA_SQL} SELECT user_id, event_id, page FROM taken")
def f7_quota_across_runs(spark, sf):
    """``f7_paged_quota`` over listings that arrive in three parts, by time, each read by a run of its own."""
    base = _scratch(spark)
    events = read_table(spark, sf, "events")
    cuts = events.agg(F.percentile_approx("ts", [k / RUNS for k in range(1, RUNS)]).alias("c")).first()["c"] or []
    part = F.lit(0)
    for c in cuts:
        part = part + F.coalesce(F.col("ts") >= F.lit(c), F.lit(False)).cast("int")
    for k in range(RUNS):
        events.where(part == k).write.mode("append").parquet(f"{base}/listings")
        S.stream_paged_quota(spark, f"{base}/listings", "*.parquet", f"{base}/out", f"{base}/table", f"{base}/chk", events.schema,
                             "user_id", ["ts", "event_id"], F.col("event_type") != "error", QUOTA)
    return spark.read.parquet(f"{base}/out").select("user_id", "event_id", "page")
