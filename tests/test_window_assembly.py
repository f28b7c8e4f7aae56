"""Windows assembled from exporter samples: all fields, aliases and the code of each fault."""

from loadlens.operators import windows

ITL, OLD_ITL, KV, OLD_KV = "vllm:inter_token_latency_seconds", "vllm:time_per_output_token_seconds", "vllm:kv_cache_usage_perc", "vllm:gpu_cache_usage_perc"
DONE = "vllm:request_success_total"


def _run(name, change=None):
    """Three snapshots of two workers; ``change`` edits the rows of one run."""
    rows = []
    for seq in (1, 2, 3):
        for worker in ("a", "b"):
            rows += [[name, seq, DONE, worker, r, float(seq * n)] for r, n in (("stop", 4), ("abort", 2), (None, 1))]
            rows += [[name, seq, f, worker, None, float(v)] for f, v in (
                ("vllm:generation_tokens_total", 10 * seq), ("vllm:prompt_tokens_total", 5 * seq), ("vllm:num_preemptions", seq), ("vllm:num_requests_running", 3 - seq % 2), ("vllm:num_requests_waiting", 1),
                (KV, 0.1 * seq), (OLD_KV, 0.9), ("other", 7),
                *[(f"{h}_{end}", seq * (2 if end == "sum" else 8)) for h in ("vllm:time_to_first_token_seconds", "vllm:request_time_per_output_token_seconds", ITL, "vllm:request_queue_time_seconds") for end in ("sum", "count")],
                *[(f"{OLD_ITL}_{end}", seq * 4) for end in ("sum", "count")],
            )]
    return change(rows) if change else rows


def _set(where, value):
    return lambda rows: [[*r[:5], value(r)] if where(r) else r for r in rows]


def _drop(where):
    return lambda rows: [r for r in rows if not where(r)]


CASES = {
    "good": (None, None),
    "half_alias": (_drop(lambda r: r[2] == KV and r[1] == 2), "metrics_alias_or_availability_changed"),
    "half_histogram": (_drop(lambda r: r[2] == f"{ITL}_count"), "metrics_histogram_pair_incomplete"),
    "lost_series": (_drop(lambda r: r[2] == DONE and r[1] == 2 and r[3] == "b"), "metrics_series_topology_changed"),
    "reset": (_set(lambda r: r[2] == "vllm:prompt_tokens_total" and r[1] == 2, lambda r: 0.0), "metrics_counter_reset"),
    "other_sides": (_drop(lambda r: r[2] == f"{ITL}_count" and r[3] == "b"), "metrics_histogram_series_mismatch"),
    "sum_alone": (_set(lambda r: r[2] == f"{ITL}_count", lambda r: 8.0), "metrics_histogram_delta_mismatch"),
    "fraction": (_set(lambda r: r[2] == "vllm:prompt_tokens_total" and r[1] == 3 and r[3] == "a", lambda r: 15.5), "metrics_derived_value_out_of_range"),
    "one_snapshot": (_drop(lambda r: r[1] != 1), "experimental_metrics_window_invalid"),
    "nothing": (_drop(lambda r: True), "experimental_metrics_window_invalid"),
    "no_time": (None, "metrics_invalid_elapsed"),
}


def test_assembly(spark):
    rows = [tuple(r) for name, (change, _) in CASES.items() for r in _run(name, change)]
    samples = spark.createDataFrame(rows, "run string, seq int, family string, labels string, reason string, value double")
    elapsed = spark.createDataFrame([(n, 0.0 if n == "no_time" else 4.0) for n in CASES], "run string, elapsed_seconds double")
    got = {r["run"]: r.asDict(recursive=True) for r in windows.assemble(samples, elapsed, ["run"]).collect()}
    assert {n: r["code"] for n, r in got.items()} == {n: code for n, (_, code) in CASES.items()}
    good = got.pop("good")
    assert all(r["observations"] is None and r["source_families"] is None for r in got.values())
    expected = {
        "observations": 3, "requests_finished": 28, "finished_requests_per_second": 7.0, "allowed_finished_requests": 16, "disallowed_finished_requests": 8, "unclassified_finished_requests": 4,
        "output_tokens": 40, "output_tokens_per_second": 10.0, "prompt_tokens": 20, "prompt_tokens_per_second": 5.0, "preemptions": 4, "mean_ttft_ms": 250.0, "mean_tpot_ms": 250.0, "mean_inter_token_latency_ms": 250.0,
        "mean_queue_time_ms": 250.0, "mean_e2e_ms": None, "mean_prefill_time_ms": None, "mean_decode_time_ms": None, "max_requests_running": 6, "max_requests_waiting": 2, "max_requests_swapped": None,
        "metric_scope_consistent": True, "metric_scope_count": 2, "scope": "server_exporter_window", "decision_effect": "none", "elapsed_seconds": 4.0,
    }
    assert {k: good[k] for k in expected} == expected
    assert abs(good["max_kv_cache_usage_fraction"] - 0.3) < 1e-12
    assert OLD_KV not in good["source_families"] and f"{OLD_ITL}_sum" not in good["source_families"] and len(good["source_families"]) == 15
    assert {p["key"]: p["n"] for p in good["histogram_observation_counts"]} == {h: 32 for h in ("ttft", "tpot", "itl", "queue")}
    assert {p["key"]: p["n"] for p in good["series_counts"]}["requests_finished"] == 6
