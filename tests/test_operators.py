"""Operators on small tables with known answers."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from loadlens.functions import stats, text
from loadlens.operators import bottleneck, compare, diagnose, sampling
from loadlens.sources import files
from loadlens.streaming import cache


def test_t_interval_of_none_one_and_several(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("b", 4.0), ("c", float("nan")), ("c", None)], "k string, v double")
    got = {r["k"]: r["ci"] for r in df.groupBy("k").agg(stats.t_interval("v").alias("ci")).collect()}
    half = 4.303 * statistics.stdev([1, 2, 4]) / math.sqrt(3)
    assert got["b"]["n"] == 3 and got["b"]["low"] == pytest.approx(7 / 3 - half) and got["b"]["high"] == pytest.approx(7 / 3 + half)
    assert got["a"]["n"] == 1 and got["a"]["low"] is None and got["a"]["mean"] == 1.0
    assert got["c"]["n"] == 0 and got["c"]["mean"] is None


def test_published_order_balanced_contrast(spark):
    rates = {"B1": 516.55, "C1": 1632.41, "B2": 517.89, "C2": 1688.40, "B3": 518.55, "C3": 1631.16}
    df = spark.createDataFrame([(1, p, v) for p, v in rates.items()], "k int, position string, rate double")
    r = compare.phase_contrasts(df, ["k"]).first()
    assert r["estimate"] == pytest.approx(217.8468, abs=1e-3)
    assert r["low"] == pytest.approx(189.46, abs=0.02) and r["high"] == pytest.approx(246.23, abs=0.02)


def test_bounds_missing_count_as_overlap(spark):
    df = spark.createDataFrame([(0.0, 1.0, 2.0, 3.0), (0.0, 2.0, 2.0, 3.0), (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    assert [r[0] for r in df.select(stats.intervals_overlap(*[F.col(c) for c in "abcd"])).collect()] == [False, True, True]


def test_bootstrap_replays_the_generator(spark):
    source = random.Random(3)
    values = [source.random() for _ in range(80)]
    draw = random.Random(9).randrange
    found = sorted(statistics.quantiles(sorted(values[draw(80)] for _ in range(80)), n=20, method="inclusive")[18] for _ in range(300))
    low, high, n = sampling.bootstrap_bounds(values, 0.95, 9)
    assert n == 80 and low == pytest.approx(found[7] * 0.525 + found[8] * 0.475) and high > low
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, seq int, v double")
    r = sampling.bootstrap_interval(df, ["k"], "seq", "v", 0.95, 9).first()
    assert (r["low"], r["high"], r["n"]) == (low, high, 80)


def test_reservoir_keeps_all_up_to_the_cap():
    assert sampling.reservoir([1.0, 2.0], 1, 4) == [1.0, 2.0]
    got = sampling.reservoir(list(range(100)), 1, 10)
    assert len(got) == 10 and got == sampling.reservoir(list(range(100)), 1, 10)


PROBES = {
    "dispatch-bound": [(1, 100.0, 65.0, 35.0), (8, 300.0, 65.0, 35.0)],
    "orchestration-bound": [(1, 100.0, 10.0, 90.0), (8, 400.0, 10.0, 90.0)],
    "compute-bound": [(1, 100.0, 50.0, 50.0), (8, 700.0, 50.0, 50.0)],
    "memory-bound": [(1, 100.0, 90.0, 10.0), (8, 300.0, 90.0, 10.0)],
    "mixed": [(1, 100.0, 50.0, 50.0), (8, 500.0, 50.0, 50.0)],
}


@pytest.mark.parametrize("kind", sorted(PROBES))
def test_regimes(spark, kind):
    df = spark.createDataFrame([(1, c, t, a, b, 20, 20) for c, t, a, b in PROBES[kind]], "run int, concurrency int, throughput double, ttft_mean_ms double, tpot_mean_ms double, valid_count int, attempted_count int")
    assert diagnose.classify(df, ["run"]).first()["classification"] == kind


def test_regime_of_one_probe_is_inconclusive(spark):
    df = spark.createDataFrame([(1, 1, 5.0, 1.0, 1.0, 20, 20)], "run int, concurrency int, throughput double, ttft_mean_ms double, tpot_mean_ms double, valid_count int, attempted_count int")
    r = diagnose.classify(df, ["run"]).first()
    assert r["classification"] == "inconclusive" and r["quality_issues"] == ["insufficient_valid_concurrency_levels"] and r["scaling_efficiency"] is None


def window(spark, **changes):
    base = dict(
        elapsed_seconds=8.0, observations=5, requests_finished=40, preemptions=0, flags_provenance="runtime_verified", traffic_scope="operator_attested_exclusive", failed_requests=0, max_num_seqs=8, max_num_batched_tokens=2048, offered_concurrency=16,
        max_kv_cache_usage_fraction=0.7, successful_requests=40, allowed_finished_requests=40, disallowed_finished_requests=0, unclassified_finished_requests=0, output_tokens=400, prompt_tokens=200, prompt_tokens_per_second=25.0, finished_requests_per_second=5.0,
        output_tokens_per_second=50.0, mean_queue_time_ms=200.0, mean_ttft_ms=300.0, mean_e2e_ms=1000.0, max_requests_running=8, max_requests_waiting=4, max_requests_swapped=None, sources_present=True, scope_consistent=True, scope_count=1, single_series=True, latency_observations=40,
    )
    base |= changes
    kind = lambda k, v: "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "double" if isinstance(v, float) else "long"
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {kind(k, v)}" for k, v in base.items()))


@pytest.mark.parametrize(
    ("changes", "status", "candidate"),
    [
        ({}, "suggestion_available", 10), ({"mean_queue_time_ms": 199.0}, "no_clear_signal", None), ({"preemptions": 2, "max_kv_cache_usage_fraction": 0.95}, "suggestion_available", 6),
        ({"preemptions": 2, "max_kv_cache_usage_fraction": 0.95, "max_num_seqs": 1, "max_requests_running": 1}, "no_clear_signal", None), ({"observations": 4}, "insufficient_evidence", None), ({"max_requests_running": 7}, "no_clear_signal", None),
    ],
)
def test_analysis_and_replay_agree(spark, changes, status, candidate):
    r = bottleneck.replay(bottleneck.analyze(window(spark, **changes))).first()
    assert (r["status"], r["candidate_max_num_seqs"]) == (status, candidate) == (r["replay_status"], r["replay_candidate"])


def test_exposition_lines(spark):
    lines = [
        'vllm:num_requests_running{engine="0",model="a\\"b"} 4', "# HELP vllm:num_requests_running x", "other{a=\"b\"} nonsense", "vllm:kv_cache_usage_perc 1.5", 'vllm:num_requests_waiting{a="1",a="2"} 1', 'vllm:num_requests_waiting{a=1} 1', "vllm:num_requests_waiting NaN", "vllm:num_requests_waiting 1.5", "vllm:num_requests_waiting x",
    ]
    got = files.parse_exposition(spark.createDataFrame([(x,) for x in lines], "value string")).select("labels", "number", "code").collect()
    assert (got[0]["labels"], got[0]["number"], got[0]["code"]) == ({"engine": "0", "model": 'a"b'}, 4.0, None)
    assert [r["code"] for r in got[1:]] == ["metrics_invalid_kv_fraction", "metrics_duplicate_label", "metrics_malformed_sample", "metrics_nonfinite_value", "metrics_nonintegral_count", "metrics_invalid_number"]


def test_report_tree_codes():
    assert files.tree_code('{"a": 1}') is None
    assert files.tree_code('{"a": 1, "a": 2}') == "duplicate_report_key"
    assert files.tree_code('{"a": NaN}') == files.tree_code('{"a": 1e999}') == files.tree_code('{"a": 9007199254740993}') == "unsafe_report_number"
    assert files.tree_code("[1]") == "report_not_object"
    assert files.tree_code("{") == "invalid_report_json"
    assert files.tree_code('{"a": ' + "[" * 70 + "]" * 70 + "}") == "report_too_deep"
    assert files.tree_code('{"a": "' + "x" * 20000 + '"}') == "report_string_too_long"


def test_prompt_files(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"prompt": "a"}\n\n{"messages": []}\n{"messages": [{"role": "user", "content": "b"}]}\n{"prompt": "a", "messages": []}\n')
    got = files.read_prompts(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r["line"], r["error"]) for r in got] == [(1, None), (3, "empty_messages"), (4, None), (5, "exactly_one_of_prompt_and_messages")]


def test_json_sink(spark, tmp_path):
    df = spark.createDataFrame([(2, 1.5)], "b int, a double")
    files.write_json(df, str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).first()[0] == '{"a":1.5,"b":2}'
    with pytest.raises(Exception, match="already exists"):
        files.write_json(df, str(tmp_path / "x"), replace=False)
    with pytest.raises(Exception, match="not finite"):
        files.write_json(df.withColumn("a", F.lit(float("nan"))), str(tmp_path / "y"))


def test_cache_rules():
    c = cache.Cache(ttl=10, size=2, threshold=0.5)
    c.put("a b c", 0)
    c.put("x y z", 1)
    assert c.lookup("a b c d", 2) == "a b c" and c.lookup("q", 2) is None
    c.put("a b c", 3)  # keeps its place, so it is still the first to go
    c.put("new one", 4)
    assert list(c.store) == ["x y z", "new one"] and c.evictions == 1
    assert c.lookup("x y z", 11) == "x y z" and c.lookup("x y z", 11.5) is None


def test_cache_stream_equals_replay(spark, tmp_path):
    rows = [(i % 2, i, f"word{i % 5} common text number {i % 3}", float(i)) for i in range(40)]
    schema = "cache int, seq int, prompt string, now double"
    df = spark.createDataFrame(rows, schema)
    expected = sorted(map(tuple, cache.replay(df, "cache", "seq", "prompt", "now", size=3, threshold=0.8).select("cache", "seq", "outcome", "served_by").collect()))
    df.where("seq < 20").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = cache.cache_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "cache", "seq", "prompt", "now", size=3, threshold=0.8).writeStream.format("memory").queryName("cache_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        df.where("seq >= 20").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("cache_out").collect())) == expected
    finally:
        q.stop()


def test_in_flight_leaders(spark):
    df = spark.createDataFrame([("k", 1, 0.0, 5.0), ("k", 2, 1.0, 9.0), ("k", 3, 5.0, 1.0), ("j", 4, 0.5, 1.0)], "key string, id int, at double, s double")
    assert sorted(map(tuple, cache.in_flight(df, ["key"], "id", "at", "s").collect())) == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_text_functions(spark):
    df = spark.createDataFrame([(" A b B\u001cc ", '{"model":"m","stream":true,"messages":[],"a":1}')], "t string, r string")
    r = df.select(text.tokens("t"), text.scope_key("r"), text.jaccard(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))), text.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>")), text.pieces(F.lit("abcdefghijkl"))).first()
    assert list(r) == [["a", "b", "b", "c"], '{"a": 1, "model": "m"}', 0.5, 0.0, ["abcdefghij", "kl"]]


def test_preflight_codes(spark):
    from loadlens.operators import reports
    from loadlens.plans import report_samples

    cases = report_samples.cases()
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)] + [(-1, "{"), (-2, "{}")], "i int, report string")
    got = {r["i"]: r["code"] for r in reports.preflight(df).select("i", "code").collect()}
    assert {i: got[i] for i in range(len(cases))} == {i: code for i, (_, code) in enumerate(cases)}
    assert got[-1] == "report_structure_non_json_type" and got[-2] == "unsupported_schema"
