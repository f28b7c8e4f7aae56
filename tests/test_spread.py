"""Queries whose rows are heavy and whose table is a few bytes: the rows are dealt to all cores."""

import pytest

from loadlens.operators import contract
from loadlens.plans import contract_queries, more_queries, queries, store_queries
from loadlens.sources import report_store
from tests.conftest import SF


@pytest.mark.parametrize("name", ["a08_run_finalization", "r18_protocol_plan"])
def test_rows_are_dealt_to_all_cores(spark, name):
    assert queries.QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_reports_are_written_by_all_cores(spark, monkeypatch):
    seen = []
    save = report_store.save_reports
    monkeypatch.setattr(store_queries.report_store, "save_reports", lambda df, *a, **k: (seen.append(df.rdd.getNumPartitions()), save(df, *a, **k)))
    assert queries.QUERIES["s11_report_files"](spark, SF).count() > 0
    assert seen[0] >= spark.sparkContext.defaultParallelism


def test_reports_of_customers_are_checked_by_all_cores(spark, monkeypatch):
    seen = []
    check = contract.check_experimental
    monkeypatch.setattr(contract_queries.contract, "check_experimental", lambda df, *a, **k: (seen.append(df.rdd.getNumPartitions()), check(df, *a, **k))[1])
    queries.QUERIES["p13_experimental_contract"](spark, SF)
    assert seen[0] >= spark.sparkContext.defaultParallelism


def test_envelopes_are_made_by_all_cores(spark):
    assert contract_queries.envelopes(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_sequences_are_dealt_to_more_tasks_the_more_there_are(spark, monkeypatch):
    """The runs of a sequence are made where it was dealt to: what is sorted in one task is so many sequences, and no run is shuffled."""
    monkeypatch.setattr(more_queries, "SEQUENCES_A_TASK", 2)
    got = queries.QUERIES["r08_protocol"](spark, SF)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert got.rdd.getNumPartitions() == -(-got.count() // 2) > 4 * spark.sparkContext.defaultParallelism
