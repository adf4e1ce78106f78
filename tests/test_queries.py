"""Every query of the engine against its SQL."""

import pytest

from quillsift import queries

from .oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, sf_dir, con, name):
    assert_same(queries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(queries.SQL[name]).df())


def test_flagship_rows_and_order(spark, sf_dir):
    first = queries.search_words_topk(spark, sf_dir).select("doc_id", "lang", "n_chars", "weight", "score", "total").head(2)
    assert [tuple(r) for r in first] == [(59, "en", 1573, 2395, 78, 94), (139, "en", 1133, 1000, 32, 94)]


def test_point_read_and_filters_reach_the_scan(spark, sf_dir):
    plan = queries.get_by_docid(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,77)" in plan
    plan = queries.QUERIES["filter_prefix"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(p_brand,Brand#1)" in plan and "p_retailprice" not in plan


def test_paged_search_is_a_bounded_top_k(spark, sf_dir):
    plan = queries.search_words_topk(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Window" not in plan


def test_every_query_has_sql():
    assert queries.QUERIES.keys() == queries.SQL.keys()


@pytest.mark.parametrize("name", ["compaction_plan", "table_status"])
def test_segments_stay_one_a_language_at_any_size(spark, sf_dir, con, name, monkeypatch):
    """As with tables of more ids than an engine merges at."""
    monkeypatch.setattr(queries.Engine.__init__, "__defaults__", (50, *queries.Engine.__init__.__defaults__[1:]))
    assert_same(queries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(queries.SQL[name]).df())


def test_a_stream_of_outcomes_is_written_by_many_tasks(spark, sf_dir, con, tmp_path, monkeypatch):
    """Documents in 9 files: no task reads them all."""
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(9).write.parquet(str(tmp_path / "documents.parquet"))
    (tmp_path / "labels.parquet").symlink_to(f"{sf_dir}/labels.parquet")
    seen, make = [], queries.changes
    monkeypatch.setattr(queries, "changes", lambda s, path, max_files: seen.append(len(list((tmp_path / "work").glob("stream-*/in/0/*.json")))) or make(s, path, max_files))
    (tmp_path / "work").mkdir()
    monkeypatch.setattr(queries, "work_dir", lambda _: f"file://{tmp_path}/work")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        got = queries.stream_outcomes(spark, str(tmp_path)).toPandas()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen == [9]
    assert_same(got, con.execute(queries.SQL["stream_outcomes"]).df())
