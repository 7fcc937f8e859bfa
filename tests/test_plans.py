"""Plan-shape checks for the scale properties the README claims."""

import __spark_entry__ as E
from conftest import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_per_author_is_limited_before_the_shuffle(spark):
    plan = _plan(E.queries()["f1_limit_per_author"](spark, SF001))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_dedup_aggregates_map_side(spark):
    plan = _plan(E.queries()["a1_load_corpus"](spark, SF001))
    assert "partial_min" in plan


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(E.queries()["b13_parse_count"](spark, SF001))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


def test_listing_union_is_one_scan_with_pushed_filter(spark):
    plan = _plan(E.queries()["a11_listing_union"](spark, SF001))
    assert plan.count("FileScan parquet") == 1
    assert "PushedFilters: [In(event_type" in plan or "PushedFilters: [IsNotNull(event_type), In(event_type" in plan


def _nodes(plan: str) -> list[str]:
    return [line for line in plan.splitlines() if line.strip()]


def test_dataset_streams_its_text(spark):
    """The join of the texts with their splits broadcasts no text and keeps the corpus spread."""
    from penprint.plans import dataset as D
    spark.catalog.clearCache()
    clean = D.corpus_pipeline(spark, "/root/testdata/sf0.1")
    for kw in ({}, {"add_out_of_class": True}):
        ds = D.create_dataset(clean, 5, **kw)
        ds.write.format("noop").mode("overwrite").save()
        n = ds.rdd.getNumPartitions()
        final = ds._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in final and n > 1
        for line in _nodes(final):
            assert not ("BroadcastExchange" in line and "text" in line)
    spark.catalog.clearCache()
