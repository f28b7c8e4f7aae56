"""Filter audit: the walk over orders against running the filters."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadlens.llm import filter_audit
from loadlens.llm.queries import ORACLE_SQL, QUERIES
from tests.helpers import assert_same


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for i in filter_audit.swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert len(seen) == math.factorial(n) and set(seen) == set(itertools.permutations(range(n)))


def plain_audit(rows, names):
    """rows of (part, failing letters, good, toxic)."""
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = dict.fromkeys(names, 0)
        for order in itertools.permutations(names):
            left = list(mine)
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                total[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(x in r[1] for r in mine) - len(gone), sum(set(r[1]) == {x} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


@pytest.mark.parametrize("names", ["A", "XY", "PQRS"])
def test_audit_equals_running_the_filters(spark, names):
    rng = random.Random(len(names))
    rows = [(rng.choice(["a", "b", None]), "".join(x for x in names if rng.random() < 0.4), rng.random() < 0.5, rng.random() < 0.3) for _ in range(300)]
    df = spark.createDataFrame(rows, "part string, fails string, good boolean, toxic boolean").repartition(5)
    got = filter_audit.audit(df, {x: F.col("fails").contains(x) for x in names}, F.col("part"), F.col("good"), F.col("toxic"))
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got.collect()}
    assert found == plain_audit([(p or "", *x) for p, *x in rows], names)


def test_shapley_sums_to_all_that_is_removed():
    cells = np.random.default_rng(5).integers(0, 50, (3, 32, 3))
    said = list(filter_audit.walk(cells, "ABCDE"))
    assert (said[-1][1].sum(1) == 120 * cells[:, 1:, 0].sum(1)).all()


def test_copies_and_labels(spark, tmp_path):
    docs = [(5, "x", "en"), (3, "x", "de"), (3, "x", "de"), (None, "x", None), (9, None, "en"), (8, "", "en"), (None, "only", "en"), (None, "only", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = filter_audit.document_failures(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels).collect()
    assert sorted(str((r["doc_id"], r["e"])) for r in rows) == sorted(map(str, [(5, True), (3, False), (3, False), (None, True), (9, True), (8, False), (None, False), (None, False)]))
    assert_same(QUERIES["op13_filter_audit"](spark, str(tmp_path)), ORACLE_SQL["op13_filter_audit"], str(tmp_path))


def test_a_text_that_many_share_is_no_key_of_a_join(spark, edge):
    rows = filter_audit.document_failures(spark.read.parquet(f"{edge['full']}/documents.parquet"), spark.read.parquet(f"{edge['full']}/labels.parquet"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "_digest" in plan and "_id#" in plan.split("Join LeftOuter")[2]
    with pytest.raises(ValueError):
        filter_audit.audit(rows, {x: F.lit(True) for x in "abcdefghi"}, F.col("lang"), F.col("good"), F.col("toxic"))
