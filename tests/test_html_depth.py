"""Boilerplate and paragraphs by depth: hand-written goldens."""

import pytest
from pyspark.sql import functions as F

from penprint.functions import html as H

ART = "<article>%s</article>"
CASES = [
    ("plain", ART % "<p>one</p><p>two</p>", ["one", "two"]),
    ("outside the container", "<p>no</p>" + ART % "<p>yes</p>" + "<p>no</p>", ["yes"]),
    ("two containers", ART % "<p>a</p>" + "<p>no</p>" + ART % "<p>b</p>", ["a", "b"]),
    ("nested boilerplate of one name", ART % '<p>a</p><div class="c-card"><div><div><p>x</p></div></div><p>y</p></div><p>b</p>', ["a", "b"]),
    ("boilerplate that is no div", ART % '<p>a <span class="x c-player y">cut <span>in</span> cut</span>b</p><aside class="img"><p>z</p></aside>', ["a b"]),
    ("a class that contains the name", ART % '<p class="imgs">cut</p><p class="c-other">kept</p>', ["kept"]),
    ("single quotes and none", ART % "<p class='img'>x</p><p class=img>y</p><p CLASS = \"img\">z</p><p class=a>k</p>", ["k"]),
    ("void boilerplate cuts nothing", ART % '<p>a<img class="img">b</p><img class="img" /><p>c</p>', ["ab", "c"]),
    ("boilerplate in boilerplate", ART % '<div class="c-card"><div class="img">x</div>y</div><p>b</p>', ["b"]),
    ("paragraph left open", ART % "<p>a<p>b<div>not in it</div><p>c", ["a", "b", "c"]),
    ("open boilerplate paragraph ends at the next", ART % '<p class="img">x<p>b</p>', ["b"]),
    ("open boilerplate ends with its parent", ART % '<div><span class="img">x</div><p>b</p>', ["b"]),
    ("open boilerplate at the end", "<article><p>a</p><div class='img'><p>x", ["a"]),
    ("inline elements left open", ART % "<p><b>a<p>b</b><i>c</p>", ["a", "bc"]),
    ("end tags without a start", ART % "</div></p><p>a</b></span>b</p>", ["ab"]),
    ("list items left open", ART % '<ul><li class="img">x<li><p>b</p></ul><p>c</p>', ["b", "c"]),
    ("items of an inner list stay in theirs", ART % '<ul><li class="img"><ul><li>x<li><p>y</p></ul><p>z</p><li><p>b</p></ul>', ["b"]),
    ("comments and scripts", ART % '<p>a<!-- <p>no</p> -->b<script>var t="</p><p>";</script>c</p><style>p{}</style>', ["abc"]),
    ("tags in attributes", ART % '<p title="a > b" class="c">kept</p><p title="</article>">too</p>', ["kept", "too"]),
    ("a quote left open", ART % '<p title="x>a</p><p>b</p>', ["a", "b"]),
    ("upper case", "<ARTICLE><P>a</P><DIV CLASS=\"c-card\"><P>x</P></DIV></ARTICLE>", ["a"]),
    ("stray angle brackets", ART % "<p>1 < 2 &lt; 3 <</p>", ["1 < 2 < 3 <"]),
    ("entities and spaces", ART % "<p>  &amp;lt; &nbsp;</p><p> </p>", ["&lt;", ""]),
    ("self-closed", ART % '<div class="img"/><p>a</p>', ["a"]),
    ("container inside the container", ART % ("<p>a</p>" + ART % "<p>b</p>" + "<p>c</p>"), ["a", "b", "c"]),
    ("no container", "<p>a</p>", []),
    ("empty", "", []),
    ("null", None, None),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(k, c[1]) for k, c in enumerate(CASES)], "k int, html string").repartition(2)
    return {r.k: r.p for r in df.select("k", H.main_paragraphs("html").alias("p")).collect()}


@pytest.mark.parametrize("k", range(len(CASES)), ids=[c[0] for c in CASES])
def test_paragraphs(found, k):
    assert found[k] == CASES[k][2]


def test_tokens_leave_nothing_out(spark):
    df = spark.createDataFrame([(c[1],) for c in CASES if c[1]], "html string")
    assert df.where(F.array_join(H.html_tokens("html"), "") != F.col("html")).count() == 0


def test_container_of_nested_steps(spark):
    page = ('<div class="x c-hero-wrapper"><p>no</p><div class="c-content-inner wide"><div class="c-rte more"><p>no</p></div>'
            '<section><div class="c-rte"><p>a</p><div><p>b</p></div><div class="c-card"><p>no</p></div></div></section><p>no</p></div>'
            '<div class="c-rte"><p>no</p></div></div><div class="c-content-inner"><div class="c-rte"><p>no</p></div></div>')
    df = spark.createDataFrame([(page,)], "html string")
    assert df.select(H.main_paragraphs("html", main=H.NEWS_MAIN).alias("p")).first().p == ["a", "b"]


def test_long_pages(spark):
    deep = ART % ("<div>" * 300 + "<p>in</p>" + "</div>" * 300 + "".join(f"<p>{k}</p>" for k in range(1500)))
    long = ART % ("<p>" + "x " * 200_000 + "<a title=\"" + "y" * 100_000 + "\">z</a></p>")
    df = spark.createDataFrame([(deep,), (long,)], "html string")
    a, b = (r.p for r in df.select(H.main_paragraphs("html").alias("p")).collect())
    assert a == ["in"] + [str(k) for k in range(1500)] and len(b) == 1 and b[0].endswith("x z") and len(b[0]) == 400_001
