"""Collection-side operators.

The reference crawls sites item by item; here the fetched material is a table and each
crawl rule is a relational step: author/comment validity are predicates, "skip finished
work" is an anti join, "first listing wins" is a partial ``min`` aggregate, the
per-page quota is a prefix sum, and reply-tree pruning is pointer jumping over the
parent links (O(log depth) self-joins, each a shuffle of the node table).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.functions.text import as_col, forum_post_text
from penprint.operators.ranking import rank_in_group
from penprint.session import cut_lineage

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
INVALID_AUTHORS = ["automoderator", "moderator", "deleted", "[deleted]", "removed", "[removed]"]
BOT_SUFFIX = "bot"
MAX_REVIEWS_PER_USER = 6000
PAGE_SIZE = 10               # items per listing page in the events fixture
# ---------------------------------------------------------------------------


def valid_author(name) -> Column:
    """Present, non-empty, not a deny-listed name (case-insensitive), no ``bot``
    suffix (case-sensitive)."""
    a = as_col(name)
    return (a.isNotNull() & (a != "") & ~F.lower(a).isin(INVALID_AUTHORS)
            & ~a.endswith(BOT_SUFFIX))


def valid_comment(author, body) -> Column:
    """C4: valid author and a non-empty body."""
    b = as_col(body)
    return valid_author(author) & b.isNotNull() & (b != "")


def pending_items(frontier: DataFrame, done: DataFrame, key: str, done_key: str | None = None) -> DataFrame:
    """Work items not finished yet (anti join; AQE sizes the build side)."""
    d = done.select(F.col(done_key or key).alias(key)).distinct()
    return frontier.join(d, key, "left_anti")


def first_seen(listings: DataFrame, id_col: str = "item_id") -> DataFrame:
    """one row per id, from the highest-priority listing (then earliest ts, event id).

    ``min(struct(...))`` is a partial aggregate, so a hot id is reduced map-side."""
    first = F.min(F.struct("priority", "ts", "event_id")).alias("f")
    return (listings.groupBy(id_col).agg(first)
            .select(id_col, F.col("f.event_id").alias("event_id"), F.col("f.priority").alias("priority"),
                    F.col("f.ts").alias("ts")))


def blocked_prefix(df: DataFrame, group: str, order: str, value: str, out: str,
                    block: int = 1_000_000) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group`` ordered by integer ``order``,
    computed per block of ``block`` consecutive orders plus block offsets so no window
    partition holds more than ``block`` rows of a group."""
    x = df.withColumn("_blk", F.floor(F.col(order) / block).cast("long"))
    blocks = x.groupBy(group, "_blk").agg(F.sum(value).alias("_bs"))
    wb = Window.partitionBy(group).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offs = blocks.withColumn("_bo", F.coalesce(F.sum("_bs").over(wb), F.lit(0))).drop("_bs")
    x = x.join(offs, [group, "_blk"])
    wi = Window.partitionBy(group, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (x.withColumn(out, F.col("_bo") + F.coalesce(F.sum(value).over(wi), F.lit(0)))
            .drop("_blk", "_bo"))


def paged_quota(items: DataFrame, user: str, order_cols: list[str], accepted: Column,
                limit: int | None, page_size: int = PAGE_SIZE, default_limit: int | None = None) -> DataFrame:
    """items on the pages a crawler would visit.

    A user's items are paged ``page_size`` at a time in ``order_cols`` order; a page is
    visited iff the accepted items on earlier pages number fewer than ``limit`` (so the
    quota can overshoot by up to one page).  ``limit`` 0 means ``default_limit``;
    ``None`` means unbounded.  Returns the accepted items of visited pages with ``page``.
    """
    if limit == 0 and default_limit is not None:
        limit = default_limit
    x = items.withColumn("_acc", accepted.cast("int"))
    ranked = rank_in_group(x, [user], order_cols, order_cols[0], "range", rank_col="_r")
    ranked = ranked.withColumn("page", F.floor(F.col("_r") / page_size).cast("long"))
    if limit is None:
        return ranked.filter(F.col("_acc") == 1).drop("_acc", "_r", "_group_n")
    pages = ranked.groupBy(user, "page").agg(F.sum("_acc").alias("_pa"))
    pages = blocked_prefix(pages, user, "page", "_pa", "_before")
    visited = pages.filter(F.col("_before") < limit).select(user, "page")
    return (ranked.join(visited, [user, "page"], "left_semi")
            .filter(F.col("_acc") == 1).drop("_acc", "_r", "_group_n"))


def page_quota(items: DataFrame, user: str, page_order: list[str], accepted: Column,
               limit: int | None, default_limit: int | None = MAX_REVIEWS_PER_USER) -> DataFrame:
    """F7 over explicit listing pages: the accepted items of every page visited while
    the accepted items on earlier pages (in ``page_order``) number fewer than ``limit``."""
    if limit == 0 and default_limit is not None:
        limit = default_limit
    x = items.withColumn("_acc", accepted.cast("int"))
    if limit is None:
        return x.filter(F.col("_acc") == 1).drop("_acc")
    pages = x.groupBy(user, *page_order).agg(F.sum("_acc").alias("_pa"))
    pages = rank_in_group(pages, [user], page_order, page_order[0], "range", rank_col="_pr")
    pages = blocked_prefix(pages, user, "_pr", "_pa", "_before")
    visited = pages.filter(F.col("_before") < limit).select(user, *page_order)
    return (x.join(visited, [user, *page_order], "left_semi")
            .filter(F.col("_acc") == 1).drop("_acc"))


def visited_pages(pages: DataFrame, author: str, page: str, last_page: str, accepted: str,
                  limit: int | None) -> DataFrame:
    """The listing pages ``(author, page)`` that a crawl visits: pages 1, 2, ... of an author up to
    the last page that page 1 names, ending before a page that is missing and before the first
    one with ``limit`` accepted items on the pages before it (F7: overshoots by up to one page).

    ``pages``: rows of author, page number, the last page named there and accepted items; several
    rows of a page add up.  An author without a page 1 is not visited; null authors and numbers are skipped.
    """
    totals = (pages.where(F.col(page).isNotNull() & F.col(author).isNotNull()).groupBy(author, page)
              .agg(F.sum(accepted).alias("_pa"), F.max(last_page).alias("_last")))
    first = totals.where(F.col(page) == 1).select(F.col(author).alias("_of"), F.col("_last").alias("_end"))
    # Most pages beyond the end go before the ranking.
    x = totals.drop("_last").join(first, F.col(author) == F.col("_of")).drop("_of")
    x = x.where(F.col(page).between(1, F.coalesce("_end", F.lit(1))))
    ranked = rank_in_group(x, [author], [page], page, "range", rank_col="_pr")
    ranked = ranked.where(F.col("_pr") == F.col(page) - 1).drop("_group_n", "_end")    # no gap before
    if limit is not None:
        ranked = blocked_prefix(ranked, author, "_pr", "_pa", "_before").where(F.col("_before") < limit)
    return ranked.select(author, page)


def items_per_author(items: DataFrame, author: str) -> DataFrame:
    """Accepted items per author."""
    return items.groupBy(author).agg(F.count(F.lit(1)).alias("n_items"))


def id_frontier(ids: DataFrame, done: DataFrame, key: str, done_key: str | None = None) -> DataFrame:
    """A12 (id form): the ids of a range (``spark.range``) that are not finished yet."""
    return pending_items(ids.select(F.col("id").alias(key)), done, key, done_key)


def prune_tree(nodes: DataFrame, id_cols: list[str], parent_cols: list[str], bad: Column) -> DataFrame:
    """D4 core: ``blocked`` = some node on the path from the node up to (excluding) its
    root is bad, or the path ends at a parent that is not in ``nodes`` (a crawler never
    reaches such a node).  Roots have null parents.

    Pointer jumping: each round joins every unresolved node to its current ancestor and
    doubles the jump, so ``ceil(log2(nodes))`` rounds resolve every path; nodes left after
    that many lie on a cycle of parents, which raises.  Resolved nodes stay out of the
    join's probing side.  Lineage is cut every round (reliable checkpoint), which also makes
    each round restartable after an executor loss.
    """
    anc = [f"_a{i}" for i in range(len(parent_cols))]
    state = cut_lineage(nodes.select(*id_cols, *[F.col(p).alias(a) for p, a in zip(parent_cols, anc)],
                                     bad.alias("_bad")))
    rounds = 0
    while True:
        open_ = state.filter(F.col(anc[0]).isNotNull())
        if open_.isEmpty():
            break
        if rounds == 0:
            most = state.count().bit_length() + 1
        if rounds == most:
            raise ValueError("parent references form a cycle")
        up = state.select(*[F.col(c).alias(f"_u{i}") for i, c in enumerate(id_cols)],
                          *[F.col(a).alias(f"_ua{i}") for i, a in enumerate(anc)],
                          F.col("_bad").alias("_ubad"))
        j = open_.join(up, [F.col(a) == F.col(f"_u{i}") for i, a in enumerate(anc)], "left")
        moved = j.select(*id_cols, *[F.col(f"_ua{i}").alias(a) for i, a in enumerate(anc)],
                         (F.col("_bad") | F.coalesce(F.col("_ubad"), F.lit(True))).alias("_bad"))
        state = cut_lineage(state.filter(F.col(anc[0]).isNull()).unionByName(moved))
        rounds += 1
    return state.select(*id_cols, F.col("_bad").alias("blocked"))


def forum_rows(conv: DataFrame, author: Column, lang: Column | None = None,
               accepted_langs=None) -> DataFrame:
    """I18 (forum): ``(author, item_id, text)`` from threads in ``conversations``.

    Turn 0 is the submission (emitted when its author is valid, its body non-empty and
    its text accepted); every later turn replies to the previous turn of the thread.  A
    comment is visited only if it and all comments above it are valid (C4); a visited
    comment is emitted when its text passes B5 (with ``accepted_langs``, only if the
    predicted language ``lang`` is among them).  Comments are visited even when the
    submission itself is rejected (C7).
    """
    c = conv.withColumn("author", author)
    is_root = F.col("turn") == 0
    nodes = c.select("conv_id", "turn",
                     F.when(is_root, F.lit(None)).otherwise(F.col("conv_id")).alias("p_conv"),
                     F.when(is_root, F.lit(None)).otherwise(F.col("turn") - 1).alias("p_turn"),
                     F.when(is_root, F.lit(False)).otherwise(~valid_comment("author", "text")).alias("bad"))
    blocked = prune_tree(nodes, ["conv_id", "turn"], ["p_conv", "p_turn"], F.col("bad"))
    x = c.join(blocked, ["conv_id", "turn"])
    keep = F.when(is_root, valid_author("author") & (F.col("text") != "")).otherwise(~F.col("blocked"))
    out = x.filter(keep).select(
        "author", F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item_id"),
        forum_post_text("text", lang, accepted_langs).alias("text"))
    return out.filter(F.col("text").isNotNull())


def listed_forum_rows(conv: DataFrame, listings: DataFrame, author: Column, lang: Column | None = None,
                      accepted_langs=None) -> DataFrame:
    """I18 (forum) over ranked listings: the threads that some listing names, each once (F6), and
    their accepted rows (``forum_rows``) with the ``priority`` of the listing that named the thread.

    ``listings``: item_id (the thread), priority, ts, event_id.  Threads of no listing go before
    the reply tree is walked.
    """
    named = first_seen(listings).select(F.col("item_id").alias("_thread"), "priority")
    x = conv.drop("priority").join(named, F.col("conv_id") == F.col("_thread")).drop("_thread")
    rows = forum_rows(x, author, lang, accepted_langs)
    thread = F.substring_index("item_id", "_", 1)
    return (rows.join(named.withColumn("_thread", F.col("_thread").cast("string")), thread == F.col("_thread"))
            .select("author", "item_id", "text", "priority"))
