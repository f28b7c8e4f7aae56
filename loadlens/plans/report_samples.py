"""A sound run report and spoilt copies of it, each with the code that its check gives."""

from __future__ import annotations

import copy
import hashlib
import json
import math
from statistics import fmean, stdev

_SHA = hashlib.sha256(b"sample").hexdigest()
_T = 4.303  # three blocks


def _ci(values: list[float]) -> dict:
    half = _T * stdev(values) / math.sqrt(len(values))
    return {"low": fmean(values) - half, "high": fmean(values) + half, "confidence": 0.95, "method": "student_t_blocks", "n": len(values)}


def _counts(n: int) -> dict:
    return {"attempted": n, "valid": n, "invalid": 0, "status_counts": {"200": n}, "error_counts": {}, "finish_reason_counts": {"stop": n - 1, "length": 1} if n > 1 else {"stop": n}}


def _latency(x: float) -> dict:
    return {"count": 70, "mean": x, "p50": x, "p90": x, "p95": x, "p99": x}


def sound() -> dict:
    """A complete closed-loop run of one condition with three blocks of 70 requests."""
    n, tokens = 70, 7000
    walls, p95, ttft = [10.0, 11.0, 12.0], [100.0, 110.0, 105.0], [20.0, 22.0, 21.0]
    load = {"id": "closed_loop:4", "kind": "closed_loop", "value": 4.0, "max_in_flight": 4}
    blocks = [
        {
            "block_index": i + 1, "valid": True, "invalid_reasons": [], "wall_duration_seconds": w, "request_counts": _counts(n), "offered_requests": n, "observed_peak_in_flight": 4,
            "metrics": {"completion_tokens": tokens, "valid_response_count": n, "error_rate": 0.0, "output_tokens_per_second": tokens / w, "requests_per_second": n / w, "e2e_latency_ms": _latency(p95[i]), "ttft_ms": _latency(ttft[i])},
        }
        for i, w in enumerate(walls)
    ]
    wall = sum(walls)
    tps, rps = ([b["metrics"][k] for b in blocks] for k in ("output_tokens_per_second", "requests_per_second"))
    counts = _counts(3 * n)
    counts["finish_reason_counts"] = {"stop": 3 * (n - 1), "length": 3}
    metrics = {
        "completion_tokens": 3 * tokens, "valid_response_count": 3 * n, "error_rate": 0.0, "output_tokens_per_second": 3 * tokens / wall, "requests_per_second": 3 * n / wall, "e2e_latency_ms": {**_latency(109.0), "p95_repeated_block_ci": _ci(p95)}, "ttft_ms": {**_latency(21.5), "p95_repeated_block_ci": _ci(ttft)},
        "block_mean_output_tokens_per_second": fmean(tps), "block_mean_requests_per_second": fmean(rps), "block_mean_output_tokens_per_second_ci": _ci(tps), "block_mean_requests_per_second_ci": _ci(rps), "cost_per_million_output_tokens": 1.5 * wall / 3600 / (3 * tokens) * 1e6,
    }
    elapsed, attempted = 40.0, 3 * n + 5
    total = 1.5 * elapsed / 3600
    return {
        "schema_version": "2.0", "artifact_type": "loadlens.run", "mode": "benchmark", "status": "complete", "stop_reason": None, "started_at": "2026-01-01T00:00:00Z", "completed_at": "2026-01-01T00:00:41+00:00",
        "manifest": {
            "manifest_version": "1.1", "tool": {"name": "loadlens", "version": "1"}, "engine": {"backend": "native", "backend_version": "1", "http_client_version": "1", "server_version": "1", "effective_flags": {"max_num_seqs": "8"}, "effective_flags_provenance": "runtime_verified"},
            "model": {"id": "m", "immutable_revision": "a" * 40},
            "runtime": {"image_digest": "sha256:" + _SHA, "gpu": "A100", "cuda_version": "12", "driver_version": "550", "gpu_fingerprint_sha256": _SHA, "gpu_fingerprint_supplied": True, "accelerator_backend": "cuda", "accelerator": "A100", "accelerator_runtime_version": "12", "host_os_version": "6", "software_environment_digest": "sha256:" + _SHA, "accelerator_fingerprint_sha256": _SHA, "accelerator_fingerprint_supplied": True},
            "workload": {"cache_policy": "off", "measured_sha256": _SHA, "warmup_sha256": _SHA[::-1], "warmup_is_separate": True, "warmup_prompts_disjoint": True, "seed": 1},
            "request": {"type": "chat_completions", "temperature": 0, "max_tokens": 128, "stop": None, "stream": True, "timeout_seconds": 30.0},
            "traffic": {"conditions": [load], "blocks": 3, "requests_per_block": n, "block_duration_seconds": None, "warmup_requests_per_condition": 5, "p95_slo_ms": None, "ttft_slo_ms": None, "open_loop_rate_relative_tolerance": 0.05, "open_loop_scheduler_lag_interval_tolerance": 1.0},
            "cost": {"currency": "USD", "kind": "dedicated_hourly", "accounting_basis": "wall", "pre_run_upper_bound": 1.5 * 600 / 3600, "total_hourly_rate": 1.5, "gpu_count": 1, "active_second_rate": None, "max_active_workers": None, "billed_active_seconds": None, "user_supplied_total": None},
            "safety": {"limits": {"max_requests": 500, "max_tokens_per_request": 256, "max_total_requested_tokens": 100000, "max_errors": 1, "max_concurrency": 8, "max_response_bytes": 1000000, "max_elapsed_seconds": 600.0, "max_estimated_spend": 5.0}, "overrides": {"insecure_http": False, "unknown_cost_acknowledged": False, "guidellm_validation_gaps_acknowledged": False}, "ambient_proxy_environment_used": False, "redirects_followed": False},
        },
        "conditions": [{"condition": load, "valid": True, "decision_grade": True, "warmup": _counts(5), "blocks": blocks, "request_counts": counts, "measured_wall_seconds": wall, "observed_peak_in_flight": 4, "metrics": metrics}],
        "run_totals": {"requests_started": attempted, "requests_completed": attempted, "requests_cancelled": 0, "requests_in_flight": 0, "peak_in_flight": 4, "errors": 0, "reserved_output_tokens": attempted * 128, "elapsed_seconds": elapsed},
        "cost_summary": {"kind": "dedicated_hourly", "total_cost": total, "completion_tokens": 3 * tokens, "cost_per_million_output_tokens": total / (3 * tokens) * 1e6},
    }


_C, _B = ("conditions", 0), ("conditions", 0, "blocks", 1)
# Path, new value, code.
SPOILT = (
    (("schema_version",), "1.0", "legacy_schema_not_decision_grade"), (("schema_version",), "3.0", "unsupported_schema"), (("artifact_type",), "x", "unsupported_artifact_type"), (("mode",), "smoke", "smoke_or_nonbenchmark_report"), (("status",), "stopped", "partial_or_failed_report"), (("stop_reason",), "x", "complete_report_has_stop_reason"),
    (("manifest", "manifest_version"), "9", "missing_or_invalid_manifest"), (("manifest", "model", "id"), "unknown", "unverified_manifest_metadata"), (("manifest", "runtime", "gpu"), "H100", "runtime_aliases_do_not_reconcile"), (("manifest", "runtime", "gpu_fingerprint_sha256"), "x", "invalid_manifest_digest"), (("manifest", "workload", "warmup_sha256"), "x", "invalid_manifest_digest"),
    (("manifest", "workload", "warmup_is_separate"), False, "warmup_workload_not_separate"), (("manifest", "workload", "seed"), True, "invalid_manifest_seed"), (("manifest", "safety", "redirects_followed"), True, "invalid_safety_manifest"), (("manifest", "cost", "gpu_count"), None, "invalid_cost_manifest"), (("manifest", "safety", "limits", "max_estimated_spend"), 0.1, "pre_run_cost_exceeded_spend_limit"),
    (("manifest", "engine", "effective_flags"), {"a_b": "1", "a-b": "2"}, "invalid_engine_flag_manifest"), (("manifest", "traffic", "open_loop_rate_relative_tolerance"), 0.1, "unsupported_open_loop_tolerance_contract"), (("manifest", "request", "temperature"), 1, "unsupported_request_contract"), (("manifest", "traffic", "p95_slo_ms"), -1.0, "invalid_slo_manifest"),
    (("manifest", "traffic", "blocks"), 2, "fewer_than_three_blocks"), (("manifest", "traffic", "block_duration_seconds"), 5.0, "ambiguous_block_bound"), (("manifest", "traffic", "requests_per_block"), 0, "invalid_request_bound"), (("manifest", "traffic", "warmup_requests_per_condition"), -1, "invalid_warmup_count"), (("conditions",), [], "missing_conditions"), (("manifest", "traffic", "conditions"), [], "condition_manifest_mismatch"),
    ((*_C, "decision_grade"), False, "one_or_more_conditions_not_decision_grade"), ((*_C, "warmup"), None, "condition_evidence_missing"), ((*_C, "blocks"), [], "condition_block_count_mismatch"), ((*_C, "condition", "max_in_flight"), 5, "condition_descriptor_invalid"), ((*_C, "condition", "id"), "x", "condition_id_does_not_match_descriptor"), ((*_C, "observed_peak_in_flight"), None, "condition_peak_in_flight_missing"), ((*_C, "observed_peak_in_flight"), 5, "condition_peak_in_flight_invalid"), ((*_C, "observed_peak_in_flight"), 3, "closed_loop_target_concurrency_not_achieved"),
    ((*_C, "request_counts", "attempted"), "x", "condition_request_counts_invalid"), ((*_C, "request_counts", "attempted"), 211, "condition_contains_invalid_responses"), ((*_C, "request_counts", "status_counts"), {"200": 1}, "condition_request_count_maps_invalid"), ((*_C, "measured_wall_seconds"), 0, "condition_duration_invalid"), ((*_C, "warmup", "valid"), 4, "warmup_counts_do_not_reconcile"), ((*_C, "warmup", "finish_reason_counts"), {"x": 5}, "warmup_request_count_maps_invalid"),
    ((*_C, "metrics", "completion_tokens"), 5, "condition_token_evidence_invalid"), ((*_C, "metrics", "completion_tokens"), 99999, "condition_tokens_exceed_request_contract"), ((*_C, "metrics", "output_tokens_per_second"), 0, "condition_throughput_invalid"), ((*_B, "valid"), False, "invalid_or_partial_block"), ((*_B, "block_index"), 3, "block_indexes_not_sequential"), ((*_B, "metrics", "output_tokens_per_second"), -1, "invalid_block_metrics"), ((*_B, "request_counts", "attempted"), 71, "invalid_block_counts"), ((*_B, "request_counts", "error_counts"), {"x": 1}, "invalid_block_count_maps"),
    ((*_B, "metrics", "completion_tokens"), 0, "invalid_block_token_evidence"), ((*_B, "metrics", "completion_tokens"), 70 * 129, "block_tokens_exceed_request_contract"), ((*_B, "wall_duration_seconds"), 0, "invalid_block_duration"), ((*_B, "offered_requests"), 71, "block_offered_requests_do_not_reconcile"), ((*_B, "observed_peak_in_flight"), 9, "invalid_block_peak_in_flight"), ((*_B, "observed_peak_in_flight"), 3, "closed_loop_target_concurrency_not_achieved_in_every_block"),
    ((*_B, "wall_duration_seconds"), 11.5, "block_throughput_does_not_reconcile"), ((*_B, "metrics", "requests_per_second"), 1.0, "block_request_throughput_does_not_reconcile"), ((*_B, "metrics", "error_rate"), 0.1, "block_metric_counts_do_not_reconcile"), ((*_B, "metrics", "e2e_latency_ms", "p95"), None, "invalid_block_latency_evidence"), ((*_C, "request_counts", "finish_reason_counts"), {"stop": 210}, "condition_finish_reason_counts_do_not_reconcile"), ((*_C, "metrics", "completion_tokens"), 21001, "condition_tokens_do_not_reconcile"),
    ((*_C, "measured_wall_seconds"), 34.0, "condition_wall_time_does_not_reconcile"), ((*_C, "metrics", "output_tokens_per_second"), 600.0, "condition_throughput_does_not_reconcile"), ((*_C, "metrics", "requests_per_second"), 6.0, "condition_request_throughput_does_not_reconcile"), ((*_C, "metrics", "error_rate"), 0.5, "condition_metric_counts_do_not_reconcile"), ((*_C, "metrics", "block_mean_output_tokens_per_second"), 1.0, "repeated_block_throughput_estimate_does_not_reconcile"), ((*_C, "metrics", "ttft_ms", "p95_repeated_block_ci", "low"), 1.0, "repeated_block_slo_interval_does_not_reconcile"),
    (("run_totals",), None, "run_totals_missing"), (("run_totals", "errors"), None, "run_totals_invalid"), (("run_totals", "errors"), 1, "run_totals_do_not_reconcile"), (("run_totals", "elapsed_seconds"), 30.0, "run_totals_violate_safety_or_wall_time"), (("started_at",), "2026-01-01", "run_timestamps_invalid"), (("completed_at",), "2026-01-01T00:00:20Z", "run_timestamps_do_not_reconcile"), (("cost_summary",), None, "cost_evidence_missing"), (("cost_summary", "total_cost"), 1.0, "cost_summary_does_not_reconcile"), ((*_C, "metrics", "cost_per_million_output_tokens"), 1.0, "condition_cost_evidence_does_not_reconcile"),
)


def spoilt(path: tuple, value: object) -> str:
    report = copy.deepcopy(sound())
    at = report
    for key in path[:-1]:
        at = at[key]
    at[path[-1]] = value
    if path[:1] == ("conditions",) and "condition" in path:  # the descriptor is declared twice
        report["manifest"]["traffic"]["conditions"] = [copy.deepcopy(report["conditions"][0]["condition"])]
    return json.dumps(report)


def cases() -> list[tuple[str, str | None]]:
    return [(json.dumps(sound()), None), *((spoilt(path, value), code) for path, value, code in SPOILT)]
