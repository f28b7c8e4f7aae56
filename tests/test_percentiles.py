"""Percentiles by histogram and refinement against a plain reading."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadlens.functions import stats

FRACTIONS = (0.0, 0.25, 0.5, 0.95, 1.0)


def _plain(values, f):
    v = sorted(values)
    pos = (len(v) - 1) * f
    lo, hi = int(np.floor(pos)), int(np.ceil(pos))
    return v[lo] if v[lo] == v[hi] else (hi - pos) * v[lo] + (pos - lo) * v[hi]


@pytest.mark.parametrize("edges", [20_000, 1])
@pytest.mark.parametrize("one_task", [0, 1 << 40])
def test_percentiles(spark, monkeypatch, one_task, edges):
    monkeypatch.setattr(stats, "MOST_EDGES", edges)
    rng = np.random.default_rng(5)
    groups = {
        "wide": [float(x) for x in np.exp(rng.normal(0, 20, 300))], "signs": [float(x) for x in rng.normal(0, 3, 301)], "ties": [2.5] * 200 + [2.5000001] * 7,
        None: [0.0, -0.0, 1e-320, -1e-320, 1.7e308], "one": [3.0], "odd": [float("nan"), float("inf"), 4.0],
    }
    rows = [(k, x, None if i % 2 else x) for k, v in groups.items() for i, x in enumerate(v)] + [("none", None, None), ("none", float("nan"), None)]
    got = stats.percentiles(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], {"x": F.col("x"), "y": F.col("y")}, FRACTIONS, one_task).collect()
    assert sorted(str(r["k"]) for r in got) == sorted(str(k) for k in groups)
    for r in got:
        for name, values in (("x", groups[r["k"]]), ("y", groups[r["k"]][::2])):
            finite = [v for v in values if np.isfinite(v)]
            assert r[name] == (pytest.approx([_plain(finite, f) for f in FRACTIONS], rel=1e-12) if finite else None)


def test_empty(spark):
    assert stats.percentiles(spark.createDataFrame([], "k int, x double"), ["k"], {"x": F.col("x")}, one_task=0).collect() == []


def test_metrics_take_both_ways(spark, monkeypatch):
    from loadlens.operators import runs

    log = spark.range(600).selectExpr("timestamp_seconds(id) ts", "case when id % 7 = 0 then 500 else 200 end status_code", "cast(null as string) error_code", "'stop' finish_reason", "cast(id % 9 as int) completion_tokens", "1 prompt_tokens", "id % 83 / 10.0D e2e_seconds", "id % 31 / 10.0D ttft_seconds", "id % 5 = 0 cache_hit", "id % 2 condition", "id % 3 block_index")
    shown = ["condition", "attempted", "valid", "slo_passing", "e2e_ms", "ttft_ms", "blocks", "wall_seconds", *[F.round(f"{c}.{side}", 9) for c in ("tokens_ci", "e2e_p95_ci", "ttft_p95_ci") for side in ("mean", "low", "high")]]
    read = lambda: sorted(str(r) for r in runs.condition_aggregate(log, ["condition"], e2e_ms=4000.0).select(*shown).collect())
    once = read()
    monkeypatch.setattr(stats, "fits_one_task", lambda *_: False)
    assert once == read()
