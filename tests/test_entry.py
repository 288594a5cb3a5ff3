"""Registered queries: contract of the entry module."""

import re

import __spark_entry__ as entry_points

STREAMS = {"stream_suppress_repeats", "stream_latest_results", "stream_score", "stream_import"}


def test_flagship_runs(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["image_id", "prompt", "tag_count", "char_count"]
    assert df.count() > 0


def test_every_query_but_one_has_sql():
    queries, sql = entry_points.queries(), entry_points.oracle_sql()
    assert set(sql) <= set(queries)
    own = {name for name in queries if not re.match(r"op\d+_|pipeline$", name)}
    assert own - set(sql) == {"tensor_prepare_with_resize"}
    assert STREAMS <= set(queries)


def test_queries_build_without_running(spark, sf):
    for name in ("scores_visible", "prompt_full_rules", "catalog_check", "batch_pending", "meta_classify", "tensor_prepare"):
        assert entry_points.queries()[name](spark, sf).columns
