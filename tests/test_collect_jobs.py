"""Token counter hook (B14), crawled listing pages, id frontier and listed threads."""

import json

from pyspark.sql import functions as F

from penprint.functions import prompts as P
from penprint.functions import text as T
from penprint.operators import collect as C
from penprint.plans.dataset import clean_corpus

CHARS = T.pattern_counter("\\S")            # every character that is no space is a token
WORDS = T.TokenCounter(lambda t: F.filter(F.split(t, " "), lambda w: w != ""),
                       lambda t: F.size(F.filter(F.split(t, " "), lambda w: w != "")).cast("long"), lambda t: len(t.split()))


def test_one_counter_changes_all_four(spark):
    text = "One two three. Four five! Six seven eight nine."
    df = spark.createDataFrame([(text,)], "t string")
    for counter, n, first, crop in ((T.DEFAULT_COUNTER, 12, ["One", "two"], "One two three. Four five!"),
                                    (CHARS, 39, ["O", "n"], ""), (WORDS, 9, ["One", "two"], "One two three. Four five!")):
        r = df.select(T.count_tokens("t", counter).alias("n"), T.tokenize_truncate("t", 2, counter).alias("first"),
                      T.min_tokens("t", n, counter).alias("no"), T.min_tokens("t", n - 1, counter).alias("yes"),
                      P.crop_to_budget("t", 8, counter).alias("crop"), P.crop_to_budget("t", n + 1, counter).alias("whole")).first()
        assert (r.n, r.first, r.no, r.yes, r.crop, r.whole) == (n, first, False, True, crop, text)
    template = [{"role": "user", "content": "a b"}]
    assert P.template_tokens(template, WORDS) == len(str(template).split())
    assert P.template_tokens(template, CHARS) == len("".join(str(template).split()))
    assert json.dumps(template) and P.template_tokens(template) != P.template_tokens(template, CHARS)


def test_corpus_counts_by_the_given_counter(spark):
    corpus = spark.createDataFrame([(1, "a", "one  two\n three"), (2, "a", "one two three four")], "doc_id long, label string, text string")
    assert [r.doc_id for r in clean_corpus(corpus, 3, WORDS).collect()] == [2]
    assert clean_corpus(corpus, 10, CHARS).count() == 2 and clean_corpus(corpus, 11, CHARS).count() == 1


def test_visited_pages(spark):
    rows = [("a", 1, 3, 2), ("a", 2, 9, 2), ("a", 2, 9, 1), ("a", 3, 3, 1), ("a", 4, 3, 5),   # page 4 lies beyond the last
            ("b", 1, 9, 0), ("b", 3, 9, 4), ("c", 2, 9, 4), ("d", 1, None, 1), ("d", 2, 9, 1), ("d", None, 9, 1), (None, 1, 2, 1)]
    pages = spark.createDataFrame(rows, "author string, page int, last int, ok int").repartition(3)

    def got(limit):
        return sorted(map(tuple, C.visited_pages(pages, "author", "page", "last", "ok", limit).collect()), key=str)

    assert got(None) == sorted([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("d", 1)], key=str)
    assert [x for x in got(3) if x[0] == "a"] == [("a", 1), ("a", 2)]                        # overshoots by a page
    assert [x for x in got(2) if x[0] == "a"] == [("a", 1)]
    assert C.visited_pages(pages.limit(0), "author", "page", "last", "ok", 2).count() == 0


def test_id_frontier(spark):
    done = spark.createDataFrame([(2,), (2,), (None,), (9,)], "done long")
    assert sorted(r.u for r in C.id_frontier(spark.range(1, 5), done, "u", "done").collect()) == [1, 3, 4]


def test_listed_threads_once_with_their_first_listing(spark):
    text = "a text that is long enough to be kept by the rules"
    conv = spark.createDataFrame([(1, 0, "user", text, "en"), (1, 1, "user", text, "fr"), (2, 0, "user", text, "en"), (3, 0, "bot", text, "en"),
                                  (3, 1, "user", text, "en")], "conv_id long, turn long, role string, text string, lang string")
    listings = spark.createDataFrame([(1, 2, 10, 1), (1, 0, 30, 2), (3, 1, 20, 3), (9, 0, 5, 4)],
                                     "item_id long, priority int, ts long, event_id long")
    got = C.listed_forum_rows(conv, listings, F.col("role"), F.col("lang"), ["en"]).collect()
    assert sorted((r.item_id, r.priority) for r in got) == [("1_0", 0), ("3_1", 1)]
