"""HTML and URL expressions over already-fetched pages.

The pages are not well-formed XML (G15), so Spark's ``xpath`` cannot be used.  A page is cut
into tokens by one pattern and its tags run through a stack of open elements, folded by
``aggregate`` inside the JVM: end tags that HTML lets authors leave out are implied, an end
tag without its start is ignored, and a parent's end closes what is open in it.  Boilerplate
is any element, nested as deep as it may be, whose class contains one of the given names; the
paragraphs are those inside the main container, a chain of nested elements.  Unlike lxml's
``remove`` the text that follows a removed element is kept (G14); the contents of script and
style elements and of comments are never text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from penprint.functions.charclass import ws_class
from penprint.functions.text import as_col, author_text, news_article_text

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
NEWS_BOILERPLATE = ("c-card", "c-player", "twitter-tweet", "instagram-media", "c-inline-gallery", "img")
MOVIE_ID_PREFIX = "film/"          # review links look like film/<id>[-slug][/<sub-id>]
USER_MARKER = "uzivatel/"          # user links look like .../uzivatel/<name>/...
COUNT_MARKER = "rec"               # "1 234 recenzí" -> 1234
UNKNOWN_ID = "UNKNOWN"
# ---------------------------------------------------------------------------

# Entities decoded after tag stripping (``&amp;`` last so it cannot create new ones).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"),
            ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]

P_OPEN = "<p(?:[ \\t\\n\\r\\f][^>]*)?>"
TAG = "<[^>]*>"
_WS = ws_class()
EDGE_WS = f"^{_WS}+|{_WS}+$"


def boilerplate_pattern(classes, tag: str = "div") -> str:
    """Flat ``tag`` blocks of the given classes, for pages known to hold no nested ones."""
    alt = "|".join(c.replace("-", "\\-") for c in classes)
    return f"(?s)<{tag}[^>]*class=\"[^\"]*(?:{alt})[^\"]*\"[^>]*>.*?</{tag}>"


def remove_blocks(html, classes=NEWS_BOILERPLATE, tag: str = "div") -> Column:
    return F.regexp_replace(as_col(html), boilerplate_pattern(classes, tag), "")


# ---------------------------------------------------------------------------
# Fixed values of HTML itself.
# ---------------------------------------------------------------------------
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
ENDS_PARAGRAPH = ("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer",
                  "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre",
                  "section", "table", "ul")
# An element that ends an open one of its own name, unless one of these is open inside that.
ENDS_OWN = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
            "th": ("tr", "table"), "option": ("select",)}
# ---------------------------------------------------------------------------
MAIN = (("article", None, False),)
NEWS_MAIN = (("div", "c-hero-wrapper", False), ("div", "c-content-inner", False), ("div", "c-rte", True))
_TOKEN = ("(?s)<!--.*?-->|(?i:<(script|style)\\b.*?</\\1\\s*>)"
          "|</?[a-zA-Z](?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-zA-Z][^>]*>|<[!?][^>]*>|[^<]+|<")
_CLASS = "(?is)\\sclass\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s>\"']+))"
_OPEN, _CLOSE = 1, 2
_END = 1 << 30


def _let(value: Column, body) -> Column:
    """``body`` of a value computed once a row."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def html_tokens(html) -> Column:
    """A page as its tags, comments, scripts and text runs, in order and nothing left out."""
    return F.regexp_extract_all(as_col(html), F.lit(_TOKEN), 0)


def _class_of(tag: Column) -> Column:
    return F.when(tag.contains("=") & F.lower(tag).contains("class"),
                  F.concat(*[F.regexp_extract(tag, _CLASS, k) for k in (1, 2, 3)])).otherwise("")


def _tags(tokens: Column, boilerplate, main) -> Column:
    """(i, kind, name, cut, steps) of every start and end tag; ``cut``: it starts boilerplate;
    ``steps``: bits of the container steps that it satisfies."""
    def tag(t: Column, i: Column) -> Column:
        def named(name: Column) -> Column:
            closing = name.startswith("/")
            alone = name.isin(*VOID) | t.endswith("/>")
            kind = F.when((name == "") | name.isin("script", "style"), 0).when(closing, _CLOSE).when(alone, 0).otherwise(_OPEN)

            def with_class(cls: Column) -> Column:
                cut = F.lit(False)
                for c in boilerplate:
                    cut = cut | cls.contains(c)
                steps = F.lit(0)
                for k, (of, wanted, exact) in enumerate(main):
                    fits = name == of
                    if wanted is not None:
                        fits = fits & ((cls == wanted) if exact else cls.contains(wanted))
                    steps = steps + F.when(fits, 1 << k).otherwise(0)
                return F.struct(i.alias("i"), kind.alias("kind"), F.ltrim(name, F.lit("/")).alias("name"),
                                cut.alias("cut"), steps.alias("steps"))

            return _let(_class_of(t), with_class)

        return _let(F.when(t.startswith("<"), F.lower(F.regexp_extract(t, "^<(/?[a-zA-Z][^\\s/>]*)", 1))).otherwise(""), named)

    return F.filter(F.transform(tokens, tag), lambda x: x["kind"] > 0)


def _last(stack: Column, name) -> Column:
    """1-based place of the innermost ``name`` on the stack, 0 without one."""
    at = F.array_position(F.reverse(stack), name)
    return F.when(at > 0, F.size(stack) + 1 - at).otherwise(0).cast("int")


def _walk(tags: Column, n_steps: int) -> Column:
    """cuts and paras: token ranges (from, to) of boilerplate and of the container's paragraphs."""
    span = "array<struct<s:int,e:int>>"

    def spans(old: Column, ended: Column, start: Column, end) -> Column:
        new = F.array(F.struct(start.alias("s"), end.cast("int").alias("e")))
        return F.when(ended, F.concat(old, new)).otherwise(old)

    def step(s: Column, x: Column) -> Column:
        size = F.size(s["stack"])
        closed = _last(s["stack"], x["name"])
        implied = F.when(x["name"].isin(*ENDS_PARAGRAPH) & F.array_contains(s["stack"], "p"), _last(s["stack"], F.lit("p")) - 1)
        for name, scope in ENDS_OWN.items():
            inner = F.greatest(*[_last(s["stack"], F.lit(o)) for o in scope], F.lit(0))
            implied = implied.when((x["name"] == name) & (closed > inner), closed - 1)
        keep = F.when(x["kind"] == _OPEN, implied.otherwise(size)).when(closed > 0, closed - 1).otherwise(size)

        def popped(keep: Column) -> Column:
            opens = x["kind"] == _OPEN
            left = F.slice(s["stack"], F.lit(1), keep)
            in_cut, in_par = (s["cut"] > 0) & (keep >= s["cut"]), (s["par"] > 0) & (keep >= s["par"])
            chain = F.filter(s["chain"], lambda level: level <= keep)
            begins_cut = opens & x["cut"] & ~in_cut
            begins_par = opens & (x["name"] == "p") & ~in_par & ~in_cut & ~x["cut"] & (F.size(chain) == n_steps)
            fits = opens & (F.size(chain) < n_steps) & (F.call_function("getbit", x["steps"], F.size(chain)) == 1)
            return F.struct(
                F.when(opens, F.concat(left, F.array(x["name"]))).otherwise(left).alias("stack"),
                F.when(begins_cut, keep + 1).when(in_cut, s["cut"]).otherwise(0).alias("cut"),
                F.when(begins_cut, x["i"]).otherwise(s["cut_from"]).alias("cut_from"),
                spans(s["cuts"], (s["cut"] > 0) & ~in_cut, s["cut_from"], x["i"]).alias("cuts"),
                F.when(fits, F.concat(chain, F.array(keep + 1))).otherwise(chain).alias("chain"),
                F.when(begins_par, keep + 1).when(in_par, s["par"]).otherwise(0).alias("par"),
                F.when(begins_par, x["i"]).otherwise(s["par_from"]).alias("par_from"),
                spans(s["paras"], (s["par"] > 0) & ~in_par, s["par_from"], x["i"]).alias("paras"))

        return _let(keep.cast("int"), popped)

    zero = F.lit(0)
    begin = F.struct(F.array().cast("array<string>").alias("stack"), zero.alias("cut"), zero.alias("cut_from"),
                     F.array().cast(span).alias("cuts"), F.array().cast("array<int>").alias("chain"),
                     zero.alias("par"), zero.alias("par_from"), F.array().cast(span).alias("paras"))
    return F.aggregate(tags, begin, step, lambda s: F.struct(
        spans(s["cuts"], s["cut"] > 0, s["cut_from"], F.lit(_END)).alias("cuts"),
        spans(s["paras"], s["par"] > 0, s["par_from"], F.lit(_END)).alias("paras")))


def main_paragraphs(html, boilerplate=NEWS_BOILERPLATE, main=MAIN) -> Column:
    """Visible text of every paragraph of the main container, stripped, in order (empties kept).

    ``main``: the steps (tag, class or None, whether the class must be equal rather than
    contained) of nested elements, outermost first."""
    def texts(tokens: Column, found: Column) -> Column:
        def text(t: Column, i: Column) -> Column:
            tag = t.startswith("<") & (F.length(t) > 1)
            return F.when(tag | F.exists(found["cuts"], lambda c: (c["s"] < i) & (i < c["e"])), "").otherwise(t)

        return _let(F.transform(tokens, text), lambda shown: F.transform(found["paras"], lambda p: strip_edges(unescape(
            F.array_join(F.slice(shown, p["s"] + 1, F.least(p["e"], F.size(shown)) - p["s"]), "")))))

    return _let(html_tokens(html), lambda tokens: _let(_walk(_tags(tokens, boilerplate, main), len(main)),
                                                      lambda found: texts(tokens, found)))


def main_container(html, tag: str = "article") -> Column:
    """Content of every container of the page, in order."""
    return _all_parts(html, tag)


def _all_parts(html, tag: str) -> Column:
    return F.array_join(F.regexp_extract_all(as_col(html), F.lit(f"(?s)<{tag}(?:[ \\t\\n\\r\\f][^>]*)?>(.*?)</{tag}>"), 1), "")


def unescape(text) -> Column:
    t = as_col(text)
    for ent, ch in ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return t


def strip_edges(text) -> Column:
    """Python ``str.strip()`` (Unicode whitespace at both ends)."""
    return F.regexp_replace(as_col(text), EDGE_WS, "")


def paragraphs(html_fragment) -> Column:
    """Visible text of every paragraph, stripped, in order (empties kept)."""
    pieces = F.split(as_col(html_fragment), P_OPEN)
    body = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(body, lambda p: strip_edges(unescape(F.regexp_replace(
        F.regexp_replace(p, "(?s)</p>.*", ""), TAG, ""))))


def html_main_text(html, boilerplate=NEWS_BOILERPLATE, main=MAIN) -> Column:
    """Paragraphs of all main containers without boilerplate, non-empty ones joined
    by newlines, then the news-article rules (B6)."""
    paras = main_paragraphs(html, boilerplate, main)
    joined = F.array_join(F.filter(paras, lambda p: p != ""), "\n")
    return news_article_text(joined)


def page_lang(html) -> Column:
    return F.regexp_extract(as_col(html), "<html[^>]*lang=\"([^\"]*)\"", 1)


def html_links(html, section: str = "nav") -> Column:
    """Hrefs inside every ``<section>`` element (``nav`` by default)."""
    part = _all_parts(html, section)
    return F.regexp_extract_all(part, F.lit("href=\"([^\"]*)\""), 1)


def link_texts(html, section: str = "nav") -> Column:
    part = _all_parts(html, section)
    return F.regexp_extract_all(part, F.lit("<a[^>]*>([^<]*)</a>"), 1)


def last_page_label(html, section: str = "nav") -> Column:
    """Second-to-last pagination link text, ``'1'`` when there are fewer than two."""
    return F.coalesce(F.try_element_at(link_texts(html, section), F.lit(-2)), F.lit("1"))


def current_page(url) -> Column:
    p = F.regexp_extract(as_col(url), "[?&]page=([0-9]+)", 1)
    return F.when(p == "", F.lit(1)).otherwise(p.cast("int"))


def has_next_page(html, marker: str = "page-next") -> Column:
    return as_col(html).contains(f'class="{marker}"')


def entity_id_pattern(prefix: str = MOVIE_ID_PREFIX) -> str:
    return f"{prefix}([0-9]+)(?:-[^/]+)?(?:/([0-9]+))?"


def entity_id(url, prefix: str = MOVIE_ID_PREFIX) -> Column:
    """``<id>`` or ``<id>_<sub>`` from the first match, ``UNKNOWN`` without one."""
    u = as_col(url)
    pat = entity_id_pattern(prefix)
    main = F.regexp_extract(u, pat, 1)
    sub = F.regexp_extract(u, pat, 2)
    return (F.when(~u.rlike(pat), F.lit(UNKNOWN_ID))
            .when(sub != "", F.concat(main, F.lit("_"), sub)).otherwise(main))


def user_from_url(url, marker: str = USER_MARKER) -> Column:
    """Text after the first ``marker`` (whole string if absent) up to the next ``/``."""
    u = as_col(url)
    pos = F.instr(u, marker)
    tail = F.when(pos > 0, F.substring(u, pos + len(marker), F.length(u) + 1)).otherwise(u)
    return F.substring_index(tail, "/", 1)


def missing_page(html, marker: str = "c-404") -> Column:
    """No page, or a page carrying the not-found marker."""
    h = as_col(html)
    return h.isNull() | h.contains(f'class="{marker}"')


def review_text(paragraph, lang=None, accepted_langs=None) -> Column:
    """B8 text rule: the author-text rules with the language check."""
    return author_text(paragraph, lang, accepted_langs)
