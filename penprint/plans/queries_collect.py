"""Registered queries: the collection half over pages, conversations, events, customers
(SURVEY A7, A10-A12, B2, B3, B5-B13, C3, C4, C7, C8, D3, D4, E12, F6, F7, I18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from penprint import oracles as O
from penprint.catalog import register
from penprint.functions import html as H
from penprint.functions import text as T
from penprint.operators import collect as C
from penprint.session import reuse
from penprint.sources.corpus import LISTING_PRIORITY, listing_union, load_pages, read_table

PAGE_ID_PREFIX = "/[a-z]{2}/"      # fixture page URLs look like http://host/xx/123?...
HOST_MARKER = "://"
REVIEW_LANGS = ("en", "fr")        # accept set of the language check in the review rows
QUOTA = 25                         # per-user item limit passed to the paged crawl


@register("a10_load_pages", "SELECT page_id, url, length(html) AS html_chars FROM pages")
def a10_load_pages(spark, sf):
    p = load_pages(spark, sf)
    return p.select("page_id", "url", F.length("html").cast("long").alias("html_chars"))


@register("b7_html_main_text", f"SELECT page_id, {O.html_main_text('html')} AS text FROM pages")
def b7_html_main_text(spark, sf):
    p = load_pages(spark, sf)
    return p.select("page_id", H.html_main_text("html", ("ad",)).alias("text"))


# Pages with boilerplate of several elements, nested and left open, at the head of each article;
# what must be left of it is one paragraph.
_NESTED = ('<section class="x ad-box"><p>gone<section><p>gone too</section><div class="b">gone</div></section><img class="ad">'
           '<p class="intro">Kept before <span class="bad">gone <span>and gone</span> gone</span>and after.<ul><li class="ad">gone<li>no paragraph</ul>')
_NESTED_LEFT = '<p class="intro">Kept before and after.</p>'


@register("b7_html_nested", f"""
SELECT page_id, {O.html_main_text(f"replace(html, '<article>', '<article>{_NESTED_LEFT}')")} AS text FROM pages""")
def b7_html_nested(spark, sf):
    page = F.replace("html", F.lit("<article>"), F.lit("<article>" + _NESTED))
    return load_pages(spark, sf).select("page_id", H.html_main_text(page, ("ad",)).alias("text"))


@register("b8_html_item_rows", f"""
WITH x AS (SELECT page_id, url, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang,
                  {O.paragraphs(O.main_fragment('html'))} AS paras FROM pages),
e AS (SELECT page_id, url, lang, unnest(paras) AS para, generate_subscripts(paras, 1) - 1 AS pos FROM x),
r AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, {O.user_from_url('url', HOST_MARKER)} AS author,
             {O.entity_id('url', PAGE_ID_PREFIX)} AS item_id,
             CASE WHEN lang IN ({', '.join(O.q(x) for x in REVIEW_LANGS)}) THEN {O.author_text('para')} END AS text
      FROM e)
SELECT * FROM r WHERE text IS NOT NULL""")
def b8_html_item_rows(spark, sf):
    p = load_pages(spark, sf)
    x = p.select("page_id", "url", H.page_lang("html").alias("lang"),
                 F.posexplode(H.main_paragraphs("html", ("ad",))).alias("pos", "para"))
    r = x.select("page_id", F.col("pos").cast("int").alias("pos"),
                 H.user_from_url("url", HOST_MARKER).alias("author"),
                 H.entity_id("url", PAGE_ID_PREFIX).alias("item_id"),
                 H.review_text("para", F.col("lang"), REVIEW_LANGS).alias("text"))
    return r.filter(F.col("text").isNotNull())


@register("b9_html_links", f"""
WITH x AS (SELECT page_id, regexp_extract_all({O.all_parts('html', 'nav')},
                                              'href="([^"]*)"', 1) AS links FROM pages)
SELECT page_id, CAST(generate_subscripts(links, 1) - 1 AS INTEGER) AS pos, unnest(links) AS href FROM x""")
def b9_html_links(spark, sf):
    p = load_pages(spark, sf)
    return p.select("page_id", F.posexplode(H.html_links("html")).alias("pos", "href")) \
        .withColumn("pos", F.col("pos").cast("int"))


@register("b10_pagination", """
SELECT page_id,
  CASE WHEN regexp_extract(url, '[?&]page=([0-9]+)', 1) = '' THEN 1
       ELSE CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS INTEGER) END AS current_page,
  coalesce(list_extract(regexp_extract_all(regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1),
                                           '<a[^>]*>([^<]*)</a>', 1), -2), '1') AS last_page_label,
  contains(html, 'class="page-next"') AS has_next
FROM pages""")
def b10_pagination(spark, sf):
    p = load_pages(spark, sf)
    return p.select("page_id", H.current_page("url").alias("current_page"),
                    H.last_page_label("html").alias("last_page_label"),
                    H.has_next_page("html").alias("has_next"))


_B11_URL_SQL = "url || '/film/' || CAST(page_id AS VARCHAR) || '-slug/' || CAST(length(html) AS VARCHAR)"


@register("b11_entity_id_from_url", f"""
SELECT page_id, {O.entity_id('url', PAGE_ID_PREFIX)} AS page_item,
       {O.entity_id(_B11_URL_SQL, H.MOVIE_ID_PREFIX)} AS movie_item,
       {O.entity_id("'https://x/none'", H.MOVIE_ID_PREFIX)} AS no_item
FROM pages""")
def b11_entity_id_from_url(spark, sf):
    p = load_pages(spark, sf)
    film = F.concat(F.col("url"), F.lit("/film/"), F.col("page_id").cast("string"), F.lit("-slug/"),
                    F.length("html").cast("string"))
    return p.select("page_id", H.entity_id("url", PAGE_ID_PREFIX).alias("page_item"),
                    H.entity_id(film).alias("movie_item"),
                    H.entity_id(F.lit("https://x/none")).alias("no_item"))


@register("b12_user_from_url", f"""
SELECT page_id, {O.user_from_url('url', HOST_MARKER)} AS host,
       {O.user_from_url('url', H.USER_MARKER)} AS user_or_head,
       {O.user_from_url("'https://site/uzivatel/' || CAST(page_id AS VARCHAR) || '-name/recenze/'", H.USER_MARKER)} AS user_name
FROM pages""")
def b12_user_from_url(spark, sf):
    p = load_pages(spark, sf)
    u = F.concat(F.lit("https://site/uzivatel/"), F.col("page_id").cast("string"), F.lit("-name/recenze/"))
    return p.select("page_id", H.user_from_url("url", HOST_MARKER).alias("host"),
                    H.user_from_url("url").alias("user_or_head"), H.user_from_url(u).alias("user_name"))


_B13_SQL = ("CAST(user_id AS VARCHAR) || ' ' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || chr(160) "
            "|| 'recenzí'")


@register("b13_parse_count", f"""
SELECT event_id, TRY_CAST(split_part(replace(replace({_B13_SQL}, ' ', ''), chr(160), ''), 'rec', 1) AS BIGINT) AS n
FROM events""")
def b13_parse_count(spark, sf):
    e = read_table(spark, sf, "events")
    s = F.concat(F.col("user_id").cast("string"), F.lit(" "),
                 F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit(" recenzí"))
    return e.select("event_id", T.parse_count(s).alias("n"))


@register("c8_missing_page", """
SELECT page_id, html IS NULL OR contains(html, 'class="c-404"') AS missing FROM pages""")
def c8_missing_page(spark, sf):
    p = load_pages(spark, sf)
    return p.select("page_id", H.missing_page("html").alias("missing"))


# -- B2 / B3 / B5 / B6 over documents with markup and quotations added by literals ------
_MD_SPARK = ["> quoted line\n", "^(footnote here)\n", "# Heading\n", "Some **bold** and *it* and `code`"
             " and [link](http://x.y) ![img](a.png)\n", "- item one\n", "---\n", "```py\n", "x = 1\n", "```\n"]
_MD_SQL = " || ".join(O.q(x) for x in _MD_SPARK)


@register("b2_strip_markdown", f"""
SELECT doc_id, {O.strip_markdown(_MD_SQL + ' || text')} AS stripped,
       {O.author_text(O.strip_markdown(_MD_SQL + ' || text'))} AS forum_text
FROM documents""")
def b2_strip_markdown(spark, sf):
    d = read_table(spark, sf, "documents")
    src = F.concat(*[F.lit(x) for x in _MD_SPARK], F.col("text"))
    return d.select("doc_id", T.strip_markdown(src).alias("stripped"), T.forum_post_text(src).alias("forum_text"))


_Q_SPARK = [' „Tohle je citace," řekl autor. ', ' "Celá věta v uvozovkách." ', ' „neuzavřená citace ']
_Q_SQL = " || ".join(O.q(x) for x in _Q_SPARK)


@register("b3_strip_quotations", f"""
SELECT doc_id, {O.strip_quotations('text || ' + _Q_SQL)} AS stripped,
       {O.author_text(O.strip_quotations('text || ' + _Q_SQL))} AS article_text
FROM documents""")
def b3_strip_quotations(spark, sf):
    d = read_table(spark, sf, "documents")
    src = F.concat(F.col("text"), *[F.lit(x) for x in _Q_SPARK])
    return d.select("doc_id", T.strip_quotations(src).alias("stripped"), T.news_article_text(src).alias("article_text"))


@register("b4_author_text", f"""
SELECT doc_id, {O.author_text('text')} AS text,
       CASE WHEN lang IN ('en', 'fr') THEN {O.author_text('text')} END AS text_lang_checked
FROM documents""")
def b4_author_text(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", T.author_text("text").alias("text"),
                    T.author_text("text", F.col("lang"), ("en", "fr")).alias("text_lang_checked"))


# -- C3 / C4 / D4 / C7 / I18 forum over conversations ------------------------------------
def _author_spark():
    return (F.when(F.col("role") == "system", F.lit("AutoModerator"))
            .when((F.col("role") == "assistant") & (F.length("text") % 5 == 0), F.lit("helperbot"))
            .otherwise(F.col("role")))


_AUTHOR_SQL = ("CASE WHEN role = 'system' THEN 'AutoModerator' "
               "WHEN role = 'assistant' AND length(text) % 5 = 0 THEN 'helperbot' ELSE role END")
_DENY = ", ".join(O.q(x) for x in C.INVALID_AUTHORS)


def _valid_author_sql(a):
    return f"({a} IS NOT NULL AND {a} <> '' AND lower({a}) NOT IN ({_DENY}) AND NOT suffix({a}, '{C.BOT_SUFFIX}'))"


def _valid_comment_sql(a, b):
    return f"({_valid_author_sql(a)} AND {b} IS NOT NULL AND {b} <> '')"


@register("c3_valid_author", f"""
SELECT conv_id, turn, {_AUTHOR_SQL} AS author, {_valid_author_sql(_AUTHOR_SQL)} AS valid_author,
       {_valid_comment_sql(_AUTHOR_SQL, 'text')} AS valid_comment
FROM conversations""")
def c3_valid_author(spark, sf):
    c = read_table(spark, sf, "conversations").withColumn("author", _author_spark())
    return c.select("conv_id", "turn", "author", C.valid_author("author").alias("valid_author"),
                    C.valid_comment("author", "text").alias("valid_comment"))


_TREE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT conv_id, turn, CASE WHEN turn = 0 THEN FALSE ELSE NOT {_valid_comment_sql(_AUTHOR_SQL, 'text')} END AS bad
  FROM conversations),
walk(conv_id, turn, blocked) AS (
  SELECT conv_id, turn, bad FROM v WHERE turn = 0
  UNION ALL
  SELECT v.conv_id, v.turn, walk.blocked OR v.bad FROM walk JOIN v ON v.conv_id = walk.conv_id AND v.turn = walk.turn + 1)"""


@register("d4_comment_tree", f"{_TREE_SQL} SELECT conv_id, turn, blocked FROM walk")
def d4_comment_tree(spark, sf):
    c = read_table(spark, sf, "conversations")
    is_root = F.col("turn") == 0
    nodes = c.withColumn("author", _author_spark()).select(
        "conv_id", "turn",
        F.when(is_root, F.lit(None)).otherwise(F.col("conv_id")).alias("p_conv"),
        F.when(is_root, F.lit(None)).otherwise(F.col("turn") - 1).alias("p_turn"),
        F.when(is_root, F.lit(False)).otherwise(~C.valid_comment("author", "text")).alias("bad"))
    return C.prune_tree(nodes, ["conv_id", "turn"], ["p_conv", "p_turn"], F.col("bad"))


@register("i18_collect_forum", f"""{_TREE_SQL},
x AS (SELECT c.conv_id, c.turn, {_AUTHOR_SQL} AS author, c.text, w.blocked FROM conversations c
      JOIN walk w ON c.conv_id = w.conv_id AND c.turn = w.turn),
k AS (SELECT author, CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS item_id,
             {O.author_text(O.strip_markdown('text'))} AS text FROM x
      WHERE CASE WHEN turn = 0 THEN {_valid_author_sql('author')} AND text <> '' ELSE NOT blocked END)
SELECT * FROM k WHERE text IS NOT NULL""")
def i18_collect_forum(spark, sf):
    return C.forum_rows(read_table(spark, sf, "conversations"), _author_spark())


@register("i18_collect_news", f"""
SELECT {O.user_from_url('url', HOST_MARKER)} AS author, url AS article_url, text FROM (
  SELECT url, {O.html_main_text('html')} AS text FROM pages WHERE NOT (html IS NULL OR contains(html, 'class="c-404"')))
WHERE text IS NOT NULL""")
def i18_collect_news(spark, sf):
    p = load_pages(spark, sf).filter(~H.missing_page("html"))
    x = p.select(H.user_from_url("url", HOST_MARKER).alias("author"), F.col("url").alias("article_url"),
                 H.html_main_text("html", ("ad",)).alias("text"))
    return x.filter(F.col("text").isNotNull())


# -- I18 forum over ranked listings (F6), with the language check of B5 -------------------
FORUM_LANGS = ("en",)
_CONV_LANG_SQL = "CASE WHEN length(text) % 3 = 0 THEN 'fr' ELSE 'en' END"      # fixture language


def _conv_lang():
    return F.when(F.length("text") % 3 == 0, F.lit("fr")).otherwise(F.lit("en"))


@register("i18_collect_forum_listed", f"""{_TREE_SQL},
l AS (SELECT user_id AS item_id, CAST(min(CASE event_type {' '.join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(LISTING_PRIORITY))} END)
             AS INTEGER) AS priority FROM events
      WHERE event_type IN ({', '.join(f"'{n}'" for n in LISTING_PRIORITY)}) GROUP BY user_id),
x AS (SELECT c.conv_id, c.turn, {_AUTHOR_SQL} AS author, c.text, w.blocked, l.priority FROM conversations c
      JOIN walk w ON c.conv_id = w.conv_id AND c.turn = w.turn JOIN l ON l.item_id = c.conv_id),
k AS (SELECT author, CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS item_id, priority,
             CASE WHEN {_CONV_LANG_SQL} IN ({', '.join(O.q(x) for x in FORUM_LANGS)})
                  THEN {O.author_text(O.strip_markdown('text'))} END AS text FROM x
      WHERE CASE WHEN turn = 0 THEN {_valid_author_sql('author')} AND text <> '' ELSE NOT blocked END)
SELECT author, item_id, text, priority FROM k WHERE text IS NOT NULL""")
def i18_collect_forum_listed(spark, sf):
    return C.listed_forum_rows(read_table(spark, sf, "conversations"), listing_union(spark, sf), _author_spark(),
                               _conv_lang(), FORUM_LANGS)


# -- I18 news under a quota over an author's listing pages (B10, F7) ----------------------
NEWS_QUOTA = 2


@register("i18_collect_news_pages", f"""
WITH a AS (SELECT page_id, {O.user_from_url('url', HOST_MARKER)} AS author, url AS article_url, {O.html_main_text('html')} AS text,
             CASE WHEN regexp_extract(url, '[?&]page=([0-9]+)', 1) = '' THEN 1
                  ELSE CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS INTEGER) END AS page_no,
             coalesce(TRY_CAST(coalesce(list_extract(regexp_extract_all(regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1),
                                                     '<a[^>]*>([^<]*)</a>', 1), -2), '1') AS INTEGER), 9) AS last_page
      FROM pages WHERE NOT (html IS NULL OR contains(html, 'class="c-404"'))),
pg AS (SELECT author, page_no, count(text) AS pa, max(last_page) AS last_page FROM a GROUP BY author, page_no),
pe AS (SELECT author, last_page AS end_page FROM pg WHERE page_no = 1),
pr AS (SELECT pg.author, page_no, pa, row_number() OVER (PARTITION BY pg.author ORDER BY page_no) AS rn
       FROM pg JOIN pe ON pg.author = pe.author WHERE page_no BETWEEN 1 AND end_page),
pb AS (SELECT author, page_no, coalesce(sum(pa) OVER (PARTITION BY author ORDER BY page_no
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pr WHERE rn = page_no)
SELECT a.author, article_url, a.page_no, text FROM a JOIN pb ON a.author = pb.author AND a.page_no = pb.page_no
WHERE pb.before < {NEWS_QUOTA} AND text IS NOT NULL""")
def i18_collect_news_pages(spark, sf):
    p = load_pages(spark, sf).filter(~H.missing_page("html"))
    # The fixture's pagination links hold words, which stand for nine pages.
    x = p.select(H.user_from_url("url", HOST_MARKER).alias("author"), F.col("url").alias("article_url"),
                 H.current_page("url").alias("page_no"),
                 F.coalesce(H.last_page_label("html").try_cast("int"), F.lit(9)).alias("last_page"),
                 H.html_main_text("html", ("ad",)).alias("text"))
    # Read by the pages' counts, their ranking and the join: every page is parsed once.
    x = reuse(x.withColumn("accepted", F.col("text").isNotNull().cast("int")))
    visited = C.visited_pages(x, "author", "page_no", "last_page", "accepted", NEWS_QUOTA)
    return (x.join(visited, ["author", "page_no"], "left_semi").where(F.col("accepted") == 1)
            .select("author", "article_url", "page_no", "text"))


# -- I18 reviews: item rows of every page under a per-author quota over listing pages --
REVIEW_QUOTA = 8


def _review_rows(spark, sf):
    p = load_pages(spark, sf)
    x = p.select("page_id", "url", H.current_page("url").alias("page_no"), H.page_lang("html").alias("lang"),
                 F.posexplode(H.main_paragraphs("html", ("ad",))).alias("pos", "para"))
    return x.select("page_id", "page_no", F.col("pos").cast("int").alias("pos"),
                    H.user_from_url("url", HOST_MARKER).alias("author"),
                    H.entity_id("url", PAGE_ID_PREFIX).alias("item_id"),
                    H.review_text("para", F.col("lang"), REVIEW_LANGS).alias("text"))


@register("i18_collect_reviews", f"""
WITH x AS (SELECT page_id, url, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang,
                  CASE WHEN regexp_extract(url, '[?&]page=([0-9]+)', 1) = '' THEN 1
                       ELSE CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS INTEGER) END AS page_no,
                  {O.paragraphs(O.main_fragment('html'))} AS paras FROM pages),
e AS (SELECT page_id, page_no, url, lang, unnest(paras) AS para, generate_subscripts(paras, 1) - 1 AS pos FROM x),
r AS (SELECT page_id, page_no, {O.user_from_url('url', HOST_MARKER)} AS author, CAST(pos AS INTEGER) AS pos,
             {O.entity_id('url', PAGE_ID_PREFIX)} AS item_id,
             CASE WHEN lang IN ({', '.join(O.q(x) for x in REVIEW_LANGS)}) THEN {O.author_text('para')} END AS text
      FROM e),
pg AS (SELECT author, page_no, page_id, sum(CASE WHEN text IS NOT NULL THEN 1 ELSE 0 END) AS pa
       FROM r GROUP BY author, page_no, page_id),
pb AS (SELECT author, page_no, page_id, coalesce(sum(pa) OVER (PARTITION BY author ORDER BY page_no, page_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pg)
SELECT author, item_id, r.page_id, r.pos, r.text FROM r
JOIN pb USING (author, page_no, page_id)
WHERE pb.before < {REVIEW_QUOTA} AND r.text IS NOT NULL""")
def i18_collect_reviews(spark, sf):
    rows = reuse(_review_rows(spark, sf))        # read by the quota and by the join: pages are parsed once
    kept = C.page_quota(rows, "author", ["page_no", "page_id"], F.col("text").isNotNull(), REVIEW_QUOTA)
    return kept.select("author", "item_id", "page_id", "pos", "text")


# -- A11 / F6 / F7 / E12 over events ------------------------------------------------------
_LISTINGS_SQL = " UNION ALL ".join(
    f"SELECT event_id, ts, user_id AS item_id, event_type, {i} AS priority FROM events WHERE event_type = '{n}'"
    for i, n in enumerate(LISTING_PRIORITY))


@register("a11_listing_union", f"SELECT event_id, item_id, CAST(priority AS INTEGER) AS priority FROM ({_LISTINGS_SQL})")
def a11_listing_union(spark, sf):
    return listing_union(spark, sf).select("event_id", "item_id", "priority")


@register("f6_first_seen", f"""
SELECT item_id, event_id, CAST(priority AS INTEGER) AS priority, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY priority, ts, event_id) AS rn FROM ({_LISTINGS_SQL}))
WHERE rn = 1""")
def f6_first_seen(spark, sf):
    return C.first_seen(listing_union(spark, sf))


_QUOTA_SQL = f"""
r AS (SELECT user_id, event_id, event_type,
        (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // {C.PAGE_SIZE} AS page,
        CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS acc FROM events),
pg AS (SELECT user_id, page, sum(acc) AS pa FROM r GROUP BY user_id, page),
pb AS (SELECT user_id, page, coalesce(sum(pa) OVER (PARTITION BY user_id ORDER BY page
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pg),
taken AS (SELECT r.user_id, r.event_id, CAST(r.page AS BIGINT) AS page FROM r
          JOIN pb ON r.user_id = pb.user_id AND r.page = pb.page
          WHERE pb.before < {QUOTA} AND r.acc = 1)"""


def _quota(spark, sf):
    e = read_table(spark, sf, "events")
    return C.paged_quota(e, "user_id", ["ts", "event_id"], F.col("event_type") != "error", QUOTA)


@register("f7_paged_quota", f"WITH {_QUOTA_SQL} SELECT user_id, event_id, page FROM taken")
def f7_paged_quota(spark, sf):
    return _quota(spark, sf).select("user_id", "event_id", "page")


@register("e12_items_per_author", f"WITH {_QUOTA_SQL} SELECT user_id, count(*) AS n_items FROM taken GROUP BY user_id")
def e12_items_per_author(spark, sf):
    return C.items_per_author(_quota(spark, sf), "user_id")


# -- D3 / A7 frontier and A12 author frontier ------------------------------------------
@register("d3_pending_items", """
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)""")
def d3_pending_items(spark, sf):
    cust = read_table(spark, sf, "customer").select("c_custkey")
    orders = read_table(spark, sf, "orders")
    return C.pending_items(cust, orders, "c_custkey", "o_custkey")


@register("a12_author_frontier", f"""
WITH x AS (SELECT unnest(regexp_extract_all({O.all_parts('html', 'nav')},
                                            'href="([^"]*)"', 1)) AS href FROM pages)
SELECT DISTINCT split_part(CASE WHEN strpos(href, '/') > 0 THEN substr(href, strpos(href, '/') + 1) ELSE href END,
                           '/', 1) AS author FROM x""")
def a12_author_frontier(spark, sf):
    p = load_pages(spark, sf)
    links = p.select(F.explode(H.html_links("html")).alias("href"))
    return links.select(H.user_from_url("href", "/").alias("author")).distinct()


FRONTIER_IDS = (1, 1000)           # the id range of the work list


@register("a12_id_frontier", f"""
SELECT r AS c_custkey FROM range({FRONTIER_IDS[0]}, {FRONTIER_IDS[1]}) t(r)
WHERE r NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 300000)""")
def a12_id_frontier(spark, sf):
    done = read_table(spark, sf, "orders").where(F.col("o_totalprice") > 300000)
    return C.id_frontier(spark.range(*FRONTIER_IDS), done, "c_custkey", "o_custkey")
