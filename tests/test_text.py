"""Golden scalars for the text, HTML and response functions (SURVEY B1-B3, B11, B12,
B15, B18, C3)."""

import importlib.util
import tracemalloc

import pytest
from pyspark.sql import functions as F

from conftest import one
from penprint.functions import charclass
from penprint.functions import html as H
from penprint.functions import prompts as P
from penprint.functions import text as T
from penprint.operators import collect as C


@pytest.mark.parametrize("raw,clean", [
    ("a\r\nb", "a b"),
    ("a\rb", "a b"),                         # lone CR survives step one, then collapses
    ("a b", "a b"),                     # NBSP is whitespace
    ("a\u001cb", "a b"),                     # so is U+001C (Python semantics)
    ("xhttp://a b", "xURL b"),               # no word boundary
    ("see www.a.b now", "see URL now"),
    ("httpd is up", "URL is up"),            # a bare word starting with http is masked
    ("plain http", "plain http"),            # needs one non-space after http
    ("  lead and trail  ", "lead and trail"),
    ("a\n\n\nb \t c", "a b c"),
])
def test_clean_text(spark, raw, clean):
    assert one(spark, T.clean_text(F.col("t")), raw) == clean


def test_clean_text_idempotent(spark):
    s = "x \r\n http://q.r/s  www.t  u　v "
    once = one(spark, T.clean_text(F.col("t")), s)
    assert one(spark, T.clean_text(F.col("t")), once) == once


def test_token_count(spark):
    # letters run, digits in threes, symbol runs; whitespace only separates
    assert one(spark, T.count_tokens(F.col("t")), "ab  cd x 12345 ?!") == 6


def test_author_text_rules(spark):
    assert one(spark, T.author_text(F.col("t")), "   ") is None
    assert one(spark, T.author_text(F.col("t")), "short text") is None
    long = "this text is certainly long enough"
    assert one(spark, T.author_text(F.col("t")), long) == long


def test_strip_markdown(spark):
    s = "> quoted line\nkeep this\n^(footnote)\nlast **bold** and [link](http://x)"
    assert one(spark, T.strip_markdown(F.col("t")), s) == "keep this\nlast bold and link"


@pytest.mark.parametrize("raw,out", [
    ('Řekl: „Tohle je citace," řekl autor. Dál.', "Řekl:  Dál."),
    ('A "Celá věta." B', "A  B"),
    ("x „neuzavřená citace", "x „neuzavřená citace"),
    ('„Ahoj," řekl\nPetr. Konec.', '„Ahoj," řekl\nPetr. Konec.'),   # '.' stops at newline
])
def test_strip_quotations(spark, raw, out):
    assert one(spark, T.strip_quotations(F.col("t")), raw) == out


@pytest.mark.parametrize("url,eid", [
    ("https://www.csfd.cz/film/123-name/", "123"),
    ("https://www.csfd.cz/film/123-name/456/", "123_456"),
    ("https://www.csfd.cz/film/123/", "123"),
    ("https://x/none", "UNKNOWN"),
])
def test_entity_id(spark, url, eid):
    assert one(spark, H.entity_id(F.col("t")), url) == eid


def test_user_from_url(spark):
    assert one(spark, H.user_from_url(F.col("t")), "https://a.cz/uzivatel/12-jan/recenze/") == "12-jan"
    assert one(spark, H.user_from_url(F.col("t")), "abc/def") == "abc"


@pytest.mark.parametrize("budget,out", [
    (10, "One two. Three four five. Six."),   # 9 tokens < 10: unchanged
    (9, "One two. Three four five. Six."),    # exactly at budget: every sentence fits
    (8, "One two. Three four five."),
    (2, ""),                                  # first sentence alone is over budget
])
def test_crop_to_budget(spark, budget, out):
    assert one(spark, P.crop_to_budget(F.col("t"), budget), "One two. Three four five. Six.") == out


@pytest.mark.parametrize("resp,analysis,answer", [
    ("### Analýza: a\n### Výsledek: 1\n### Analýza: b\n### Výsledek: autor 2", "b", "2"),
    ("### ANALÝZA: x\n### VÝSLEDEK: Autor 4", "x", "4"),
    ("no sections here", "no sections here", "error"),
])
def test_parse_response(spark, resp, analysis, answer):
    r = one(spark, P.parse_response(F.col("t")), resp)
    assert (r["analysis"], r["answer"]) == (analysis, answer)


def test_parse_json_response(spark):
    r = one(spark, P.parse_json_response(F.col("t")), '{"analysis": "a", "answer": "3"}')
    assert (r["analysis"], r["answer"]) == ("a", "3")
    r = one(spark, P.parse_json_response(F.col("t")), "not json")
    assert (r["analysis"], r["answer"]) == ("not json", "error")
    r = one(spark, P.parse_json_response(F.col("t")), None)
    assert (r["analysis"], r["answer"]) == ("error", "error")


@pytest.mark.parametrize("name,ok", [
    ("alice", True), ("AutoModerator", False), ("[deleted]", False), ("helperbot", False),
    ("helperBot", True), ("", False), (None, False)])
def test_valid_author(spark, name, ok):
    assert one(spark, C.valid_author(F.col("t")), name) is ok


def test_template_fill_is_simultaneous(spark):
    v = one(spark, P.fill("Q: {query_text} / E: {example_text}",
                          {"query_text": F.col("t"), "example_text": F.lit("ex")}), "has {example_text}")
    assert v == "Q: has {example_text} / E: ex"


def test_unknown_template():
    with pytest.raises(ValueError):
        P.load_template("de")


def test_lower_case_table_is_small_and_whole():
    """Every driver holds it: with all 1.1 million code points it took 300 MB of its memory."""
    spec = importlib.util.spec_from_file_location("charclass_unused", charclass.__file__)
    fresh = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(fresh)
    tracemalloc.start()
    found = {c: fresh.lower_preimage(c) for c in ("a", "k", "å", "č", "i", "5", "é", "A", "ß", "i̇", "")}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    assert found == {"a": "Aa", "k": "Kk\u212a", "å": "Åå\u212b", "č": "Čč", "i": "Ii", "5": "5", "é": "Éé", "A": "A",
                     "ß": "ß\u1e9e", "i̇": "i̇", "": ""}
