"""Every registered query against its SQL on the smallest tables."""

import pytest

from loadlens.plans import contract_queries, import_queries, more_queries, queries, report_queries, store_queries  # noqa: F401
from tests.conftest import SF
from tests.helpers import assert_same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_similarity_join_has_no_nested_loop(spark):
    plan = queries.QUERIES["j08_similar_prompts"](spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
