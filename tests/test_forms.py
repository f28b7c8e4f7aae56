"""Canonical forms against Python's own, and faults of configurations and imported blocks."""

import json

import pytest
from pyspark.sql import functions as F

from loadlens.functions import text
from loadlens.operators import compare, config, imported
from loadlens.plans.import_queries import _SOUND


def test_condition_ids_are_those_of_python(spark):
    values = [1e-5, 1.5e-5, 0.0001, 0.00012, 0.001, 0.25, 1.0, 4.0, 10000000.5, 12345678.25, 1e7, 1e16, 123456789012345.5, 1e20, 3e-10, 0.1 + 0.2]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.condition_id(F.lit("open_loop"), "v").alias("id"))
    assert {r["v"]: r["id"] for r in df.collect()} == {v: f"open_loop:{int(v) if v.is_integer() else v}" for v in values}


def test_canonical_json_is_that_of_python(spark):
    texts = ['{"b": {"y": 1, "x": [1.50, 1e-7, true, null, "é\\u0001"]}, "a": "0"}', '{"a": 0}', '{"a": "0"}', "[]", '"x"', '{"a": NaN}', "{", None]
    got = [r["j"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.canonical_json("t").alias("j")).orderBy("i").collect()]
    assert got == [json.dumps(json.loads(t), sort_keys=True, separators=(",", ":")) for t in texts[:5]] + [None] * 3


def test_scopes_keep_types_and_order_no_keys(spark):
    bodies = ['{"temperature": 0, "stream": true, "messages": []}', '{"messages": [1], "temperature": 0}', '{"temperature": "0"}', '{"o": {"x": 2, "y": 1}}', '{"o": {"y": 1, "x": 2}}']
    keys = [r["k"] for r in spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").select("i", text.scope_key("b").alias("k")).orderBy("i").collect()]
    assert keys[0] == keys[1] == '{"temperature": 0}' and keys[2] == '{"temperature": "0"}' and keys[3] == keys[4]


def test_messages_without_a_role_are_the_users(spark):
    turns = [{"role": None, "content": "a"}, {"role": "system", "content": "b"}, {"role": "user", "content": None}]
    df = spark.createDataFrame([(turns,)], "m array<struct<role:string,content:string>>")
    assert df.select(text.prompt_text(F.col("m")).alias("p")).first()["p"] == "user: a\nsystem: b"


@pytest.mark.parametrize(
    "change, fault",
    [
        ({}, None), ({"mode": "x"}, "config_mode"), ({"backend": "guidellm"}, "config_gaps_not_acknowledged"), ({"model": " "}, "config_model"), ({"url": "http://h/v1"}, "config_address"), ({"api_key": None}, "config_key"),
        ({"conditions": []}, "config_no_conditions"), ({"conditions": None}, "config_no_conditions"), ({"conditions": [{"kind": "closed_loop", "value": 4.0, "max_in_flight": 4}] * 2}, "load_value_repeated"),
        ({"conditions": [{"kind": "closed_loop", "value": 4.0, "max_in_flight": 4}, {"kind": "open_loop", "value": 0.5, "max_in_flight": 4}]}, "config_mixed_loops"), ({"conditions": [{"kind": "open_loop", "value": float("inf"), "max_in_flight": 4}]}, "load_value"),
        ({"mode": "smoke"}, "config_smoke_blocks"), ({"requests_per_block": None}, "config_no_block_bound"), ({"block_duration_seconds": 1.0}, "config_two_block_bounds"), ({"p95_slo_ms": -1.0}, "config_p95_slo"), ({"seed": None}, "config_seed"), ({"cache_policy": "x"}, "config_cache_policy"),
        ({"evidence_source": None}, "config_evidence_source"), ({"flags_provenance": "x"}, "config_flags_provenance"), ({"requests_per_block": 400}, "config_requests_over_limit"), ({"cost_upper_bound": None}, "config_unknown_cost_not_allowed"), ({"cost_upper_bound": 9.0}, "config_cost_over_limit"), ({"timeout_seconds": 0.0}, "config_timeout"),
    ],
)
def test_first_fault_of_a_configuration(spark, change, fault):
    body = json.dumps({**_SOUND, **change})
    got = spark.range(1).select(config.first_fault(F.from_json(F.lit(body), config.CONFIG, {"allowNonNumericNumbers": "true"})).alias("f")).first()["f"]
    assert got == fault


def test_empty_and_failed_imports(spark):
    rows = [(0, 0, 0, 0, 1.0), (5, 0, 0, 5, 1.0), (5, 1, 0, 6, 9.0), (2, 0, 0, 2, 9.0), (2, 0, 0, 2, 1.0)]
    got = imported.blocks(spark.createDataFrame(rows, "successful int, errored int, incomplete int, total int, duration_seconds double"), requests=5, seconds=5.0).collect()
    assert [r["invalid_reasons"] for r in got] == [[imported.EMPTY, imported.SHORT], [], [imported.FAILED], [], [imported.SHORT]]


def test_malformed_runs_have_reasons(spark):
    """Nulls in any column make codes, not an empty list."""
    rows = spark.range(1, 7).select(F.lit(1).alias("k"), *[F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split(" ", 1)[0]) if c.split(" ", 1)[0] != "position_no" else F.col("id").cast("int").alias("position_no") for c in (x.strip() for x in compare.PROTOCOL_RUN.replace("map<string,string>", "map<string;string>").replace("id:string,kind:string,value:int,max_in_flight:int,peak:int,", "id:string;kind:string;value:int;max_in_flight:int;peak:int;").split(",")) for c in [c.replace(";", ",")]])
    why = set(compare.protocol_reasons(rows, ["k"]).first()["reasons"])
    assert {"engine_flags_malformed", "condition_maps_malformed", "missing_or_invalid_run_timestamps", "model_revision_is_not_immutable", "uncontrolled_or_missing_cost", "golden_protocol_requires_streaming", "warmup_workload_not_proven_separate"} <= why


def _six(k, **changes):
    """A sound sequence; ``changes`` give values by manifest path and position."""
    paths = {**dict.fromkeys((*compare.CONTROLLED, *compare.CONTROLLED_NOW), "1"), "manifest_version": compare.MANIFEST_NOW, "model_immutable_revision": "a" * 40, "engine_backend": "native"}
    load = [("closed_loop:8", "closed_loop", 8, 8, 8, [8, 9])]
    for no, position in enumerate(compare.POSITIONS, 1):
        fixed = {p: changes.get(p, {}).get(no, v) for p, v in paths.items()}
        variant, seqs = ("baseline", "4") if no % 2 else ("candidate", "8")
        yield (k, no, position, variant, no * 10.0, no * 10.0 + 8, None, fixed, "runtime_verified", "live_inference", True, 5, True, True, {"max_num_seqs": seqs}, 20, load)


def test_shared_values_that_move_return_or_lack(spark):
    """Every path in every position: another value in one run, the old one again after it, null in one run and in all."""
    paths, old = (*compare.CONTROLLED, *compare.CONTROLLED_NOW), {"manifest_version": dict.fromkeys(range(1, 7), "1.0")}
    usual = ("manifest_version", "model_immutable_revision", "engine_backend", "engine_server_version", "workload_cache_policy")  # their values have codes of their own
    cases = [({}, [])] + [({p: {no: v}}, [p]) for p in paths if p not in usual for no, v in ((1, "x"), (3, "x"), (6, ""), (1, None), (4, None))] + [({p: dict.fromkeys(range(1, 7))}, [p]) for p in paths if p not in usual]
    cases += [({p: {2: "x"}}, [p]) for p in usual] + [({**old, p: {3: "x"}}, []) for p in compare.CONTROLLED_NOW] + [({p: {2 + i % 5: "x"} for i, p in enumerate(paths)}, paths)]
    runs = spark.createDataFrame([run for k, (changes, _) in enumerate(cases) for run in _six(k, **changes)], "k int, " + compare.PROTOCOL_RUN)
    got = {r["k"]: r["reasons"] for r in compare.protocol_reasons(runs, ["k"]).collect()}
    assert got == {k: sorted(f"uncontrolled_or_missing_{p}" for p in want) for k, (_, want) in enumerate(cases)}


def test_a_sequence_is_sorted_once_and_not_held(spark):
    runs = spark.createDataFrame(list(_six(1)), "k int, " + compare.PROTOCOL_RUN)
    plan = compare.protocol_reasons(runs, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1 and "ObjectHashAggregate" not in plan
