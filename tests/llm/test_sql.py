"""The corpus queries against their SQL."""

import pytest

from quillsift.llm import queries

from ..oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir).toPandas(), connect(sf_dir).execute(queries.SQL[name]).df())


def test_one_query_an_operator():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
