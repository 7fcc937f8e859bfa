"""Structured Streaming forms of the crawl's incremental behaviour.

* J1 ``incremental_collect``: new page files are picked up by a file source, run through
  the stateless extraction expressions and appended to a sink; the checkpoint records
  which files are done, so a restart continues where it stopped (the reference's
  ``last_state.json``).
* J2 ``seen_set``: each listing item is emitted once (``dropDuplicates`` on the id; with
  a watermark the state is bounded by ``dropDuplicatesWithinWatermark``).
* J3 ``running_author_counts``: accepted items per author, kept current with an
  ``update``-mode aggregation whose changed totals ``foreachBatch`` appends to a change
  table (absolute totals, so a replayed batch is harmless).
* F7 / A7 ``stream_paged_quota``: the paged quota over listings that arrive in several runs;
  a change table holds how far each user has been read and who is finished.

All runs use ``trigger(availableNow=True)``: process what is there, then stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.functions import html as H
from penprint.functions.html import NEWS_BOILERPLATE
from penprint.operators.collect import PAGE_SIZE, blocked_prefix, valid_author  # noqa: F401  (valid_author: re-exported for users)
from penprint.operators.ranking import rank_in_group
from penprint.session import reuse
from penprint.streaming.change_table import ChangeTable


def file_stream(spark: SparkSession, directory: str, pattern: str, schema, max_files: int | None = None) -> DataFrame:
    """The files below ``directory`` whose names match ``pattern``; where that is the name of a
    folder (a table written by Spark), the files in it."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    table = spark._jvm.org.apache.hadoop.fs.Path(f"{directory.rstrip('/')}/{pattern}")
    if table.getFileSystem(spark._jsc.hadoopConfiguration()).isDirectory(table):
        return r.parquet(table.toString())
    return r.option("pathGlobFilter", pattern).parquet(directory)


def news_rows(pages: DataFrame, boilerplate=NEWS_BOILERPLATE, host_marker: str = "://") -> DataFrame:
    """Stateless J1 body: pages -> (author, article_url, text), rejected pages dropped."""
    p = pages.filter(~H.missing_page("html"))
    x = p.select(H.user_from_url("url", host_marker).alias("author"), F.col("url").alias("article_url"),
                 H.html_main_text("html", boilerplate).alias("text"))
    return x.filter(F.col("text").isNotNull())


def incremental_collect(spark: SparkSession, pages_dir: str, pattern: str, out_dir: str,
                        checkpoint: str, schema, boilerplate=NEWS_BOILERPLATE) -> None:
    """Append extracted rows of every page file not processed yet."""
    q = (news_rows(file_stream(spark, pages_dir, pattern, schema), boilerplate)
         .writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def seen_once(listings: DataFrame, id_col: str = "item_id", watermark: str | None = None, time_col: str = "ts") -> DataFrame:
    """First arrival of every id.

    With ``watermark`` an id is remembered for that long after the event time of its first
    arrival, and rows older than the newest event time less the watermark are dropped, seen or
    not; so an id listed again later than that is emitted again.  Without it, ids are
    remembered for good."""
    if watermark:
        listings = listings.withColumn(time_col, F.col(time_col).cast("timestamp"))     # event times carry a zone
        return listings.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark([id_col])
    return listings.dropDuplicates([id_col])


def stream_seen_set(spark: SparkSession, events_dir: str, pattern: str, out_dir: str,
                    checkpoint: str, schema, accepted_types, watermark: str | None = None) -> list:
    """J2 as a job; returns the progress reports of the run (state rows, dropped rows)."""
    ev = file_stream(spark, events_dir, pattern, schema)
    listings = ev.filter(F.col("event_type").isin(list(accepted_types))).select(
        "event_id", "ts", F.col("user_id").alias("item_id"), "event_type")
    q = (seen_once(listings, watermark=watermark).writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return list(q.recentProgress)


COUNTS_SCHEMA = "user_id long, n_items long"


def author_counts_table(spark: SparkSession, table_dir: str) -> ChangeTable:
    return ChangeTable(spark, table_dir, ["user_id"], COUNTS_SCHEMA)


def running_author_counts(spark: SparkSession, events_dir: str, pattern: str, table_dir: str,
                          checkpoint: str, schema) -> None:
    """Accepted items per author, kept current in ``table_dir``.

    The running totals live in the streaming state store (``update`` mode emits the
    authors whose total changed); ``foreachBatch`` appends those authors to a change table.
    Totals are absolute and a micro-batch has its own folder, so replaying one after a
    failure writes the same rows again.
    """
    table = author_counts_table(spark, table_dir)
    ev = file_stream(spark, events_dir, pattern, schema)
    totals = (ev.filter(F.col("event_type") != "error")
              .groupBy("user_id").agg(F.count(F.lit(1)).alias("n_items")))

    def add(batch: DataFrame, batch_id: int) -> None:
        table.append(batch, batch_id)
        table.compact(batch_id)

    q = (totals.writeStream.outputMode("update").foreachBatch(add)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_author_counts(spark: SparkSession, table_dir: str) -> DataFrame:
    return author_counts_table(spark, table_dir).current()


# -- F7 / A7 across runs -------------------------------------------------------------------
def quota_table(spark: SparkSession, table_dir: str, user: str, user_type: str = "long") -> ChangeTable:
    """How far each user's listing has been read: ``seen`` items, ``accepted`` ones among
    them, those of the page not yet full (``on_page``), its number, and whether the quota is
    met (``finished``: nothing of the user is read any more)."""
    schema = f"`{user}` {user_type}, seen long, accepted long, on_page long, page long, finished boolean"
    return ChangeTable(spark, table_dir, [user], schema)


def continue_quota(items: DataFrame, state: DataFrame, user: str, order_cols: list[str], accepted: Column,
                   limit: int, page_size: int = PAGE_SIZE) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """One run of ``paged_quota`` that goes on where ``state`` (``quota_table``) stopped.

    Returns the accepted items of the pages visited now, the state of the users read now,
    and the persisted frames to release.  Users are compared by equality, so items of a null
    user are not read.
    """
    s = state.select(F.col(user).alias("_su"), *[F.col(c).alias(f"_{c}") for c in ("seen", "accepted", "on_page", "page", "finished")])
    x = items.where(F.col(user).isNotNull()).withColumn("_acc", F.coalesce(accepted, F.lit(False)).cast("long"))
    x = x.join(s.where("_finished").select("_su"), F.col(user) == F.col("_su"), "left_anti")
    ranked = rank_in_group(x, [user], order_cols, order_cols[0], "range", rank_col="_r").drop("_group_n")
    ranked = ranked.join(s.select("_su", "_seen"), F.col(user) == F.col("_su"), "left")
    ranked = reuse(ranked.withColumn("page", F.floor((F.coalesce("_seen", F.lit(0)) + F.col("_r")) / page_size).cast("long"))
                   .drop("_r", "_su", "_seen"))
    pages = ranked.groupBy(user, "page").agg(F.sum("_acc").alias("_pa"), F.count(F.lit(1)).alias("_pn"))
    pages = blocked_prefix(pages, user, "page", "_pa", "_before")
    pages = pages.join(s.drop("_finished"), F.col(user) == F.col("_su"), "left").drop("_su")
    pages = pages.na.fill(0, ["_seen", "_accepted", "_on_page"])
    # Accepted items on all earlier pages: those of earlier runs, without the part of this very
    # page that an earlier run has read, and those of this run's earlier pages.
    opened = F.when(F.col("page") == F.col("_page"), F.col("_on_page")).otherwise(F.lit(0))
    pages = reuse(pages.withColumn("_opened", opened).withColumn("_before", F.col("_before") + F.col("_accepted") - F.col("_opened")))
    visited = pages.where(F.col("_before") < limit).select(user, "page")
    taken = ranked.join(visited, [user, "page"], "left_semi").where(F.col("_acc") == 1).drop("_acc")
    last = F.max_by(F.struct(F.col("page"), (F.col("_pa") + F.col("_opened")).alias("on_page"), F.col("_before")), F.col("page"))
    ends = pages.groupBy(user).agg((F.max("_seen") + F.sum("_pn")).alias("seen"), (F.max("_accepted") + F.sum("_pa")).alias("accepted"),
                                   last.alias("_last"))
    full = F.col("seen") % page_size == 0
    ends = ends.select(user, "seen", "accepted", F.when(full, F.lit(0)).otherwise(F.col("_last.on_page")).cast("long").alias("on_page"),
                       F.when(full, F.col("_last.page") + 1).otherwise(F.col("_last.page")).alias("page"))
    ends = ends.withColumn("finished", F.col("accepted") - F.col("on_page") >= limit)
    return taken, ends, [ranked, pages]


def stream_paged_quota(spark: SparkSession, items_dir: str, pattern: str, out_dir: str, table_dir: str, checkpoint: str,
                       schema, user: str, order_cols: list[str], accepted: Column, limit: int,
                       page_size: int = PAGE_SIZE, default_limit: int | None = None, max_files: int | None = None) -> None:
    """F7 over listings that arrive file by file, over any number of runs.

    A user's items are paged in the order in which they arrive (``order_cols`` within a
    micro-batch).  Accepted items go to ``out_dir/batch=<id>``, overwritten when a micro-batch
    is replayed; what each user has had so far is in a change table, so a run stopped anywhere
    goes on at the page it had reached, and finished users are left out by an anti join.
    """
    if limit == 0 and default_limit is not None:
        limit = default_limit
    table = quota_table(spark, table_dir, user, schema[user].dataType.simpleString())

    def step(batch: DataFrame, batch_id: int) -> None:
        taken, ends, held = continue_quota(batch, table.current(batch_id), user, order_cols, accepted, limit, page_size)
        taken.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")
        table.append(ends, batch_id)
        table.compact(batch_id)
        for frame in held:
            frame.unpersist()

    q = (file_stream(spark, items_dir, pattern, schema, max_files).writeStream.foreachBatch(step)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
