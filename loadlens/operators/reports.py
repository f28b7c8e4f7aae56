"""Saved run reports: typed parsing, provenance and contract checks, and the fail-first preflight.

A check never raises: every access is typed, so a value of another JSON type is null and fails the check that needs it.
Codes are evaluated in one order (run, then each condition with its blocks, then run totals), and the first one wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.functions import stats, text
from loadlens.operators.runs import LAG_TOLERANCE, LEAST_BLOCKS, LEAST_REQUESTS, LEAST_SECONDS, RATE_TOLERANCE, TOKEN_TOLERANCE

_CI = "struct<low:double,high:double,confidence:double,method:string,n:bigint>"
_DIST = f"struct<count:bigint,mean:double,p50:double,p90:double,p95:double,p99:double,p95_repeated_block_ci:{_CI}>"
_COUNTS = "struct<attempted:bigint,valid:bigint,invalid:bigint,status_counts:map<string,bigint>,error_counts:map<string,bigint>,finish_reason_counts:map<string,bigint>>"
_METRICS = f"struct<completion_tokens:bigint,valid_response_count:bigint,error_rate:double,output_tokens_per_second:double,requests_per_second:double,e2e_latency_ms:{_DIST},ttft_ms:{_DIST},block_mean_output_tokens_per_second:double,block_mean_requests_per_second:double,block_mean_output_tokens_per_second_ci:{_CI},block_mean_requests_per_second_ci:{_CI},cost_per_million_output_tokens:double>"
_BLOCK = f"struct<block_index:bigint,valid:boolean,invalid_reasons:array<string>,wall_duration_seconds:double,request_counts:{_COUNTS},offered_requests:bigint,target_offered_request_rate:double,launch_window_seconds:double,achieved_offered_request_rate:double,offered_rate_relative_error:double,scheduler_lag_interval_ratio_p95:double,open_loop_target_achieved:boolean,observed_peak_in_flight:bigint,scheduler_lag_ms:{_DIST},metrics:{_METRICS}>"
_LOAD = "struct<id:string,kind:string,value:double,max_in_flight:bigint>"
_CONDITION = f"struct<condition:{_LOAD},valid:boolean,decision_grade:boolean,warmup:{_COUNTS},blocks:array<{_BLOCK}>,request_counts:{_COUNTS},measured_wall_seconds:double,target_offered_request_rate:double,achieved_offered_request_rate:double,offered_rate_relative_error:double,open_loop_target_achieved:boolean,observed_peak_in_flight:bigint,metrics:{_METRICS}>"
RUNTIME = "struct<image_digest:string,gpu:string,cuda_version:string,driver_version:string,gpu_fingerprint_sha256:string,gpu_fingerprint_supplied:boolean,accelerator_backend:string,accelerator:string,accelerator_runtime_version:string,host_os_version:string,software_environment_digest:string,accelerator_fingerprint_sha256:string,accelerator_fingerprint_supplied:boolean>"
COST = "struct<currency:string,kind:string,accounting_basis:string,pre_run_upper_bound:double,total_hourly_rate:double,gpu_count:bigint,active_second_rate:double,max_active_workers:bigint,billed_active_seconds:double,user_supplied_total:double>"
_LIMITS = "struct<max_requests:bigint,max_tokens_per_request:bigint,max_total_requested_tokens:bigint,max_errors:bigint,max_concurrency:bigint,max_response_bytes:bigint,max_elapsed_seconds:double,max_estimated_spend:double>"
SAFETY = f"struct<limits:{_LIMITS},overrides:struct<insecure_http:boolean,unknown_cost_acknowledged:boolean,guidellm_validation_gaps_acknowledged:boolean>,ambient_proxy_environment_used:boolean,redirects_followed:boolean>"
_MANIFEST = f"struct<manifest_version:string,tool:struct<name:string,version:string>,engine:struct<backend:string,backend_version:string,http_client_version:string,server_version:string,effective_flags:map<string,string>,effective_flags_provenance:string>,model:struct<id:string,immutable_revision:string>,runtime:{RUNTIME},workload:struct<cache_policy:string,measured_sha256:string,warmup_sha256:string,warmup_is_separate:boolean,warmup_prompts_disjoint:boolean,seed:bigint>,request:struct<type:string,temperature:double,max_tokens:bigint,stop:string,stream:boolean,timeout_seconds:double>,traffic:struct<conditions:array<{_LOAD}>,blocks:bigint,requests_per_block:bigint,block_duration_seconds:double,warmup_requests_per_condition:bigint,p95_slo_ms:double,ttft_slo_ms:double,open_loop_rate_relative_tolerance:double,open_loop_scheduler_lag_interval_tolerance:double>,cost:{COST},safety:{SAFETY}>"
REPORT = f"struct<schema_version:string,artifact_type:string,mode:string,status:string,stop_reason:string,started_at:string,completed_at:string,manifest:{_MANIFEST},conditions:array<{_CONDITION}>,run_totals:struct<requests_started:bigint,requests_completed:bigint,requests_cancelled:bigint,requests_in_flight:bigint,peak_in_flight:bigint,errors:bigint,reserved_output_tokens:bigint,elapsed_seconds:double>,cost_summary:struct<kind:string,total_cost:double,completion_tokens:bigint,cost_per_million_output_tokens:double>>"
ARTIFACT = "loadlens.run"


def no(c: Column) -> Column:
    """The check failed, or could not be made."""
    return ~F.coalesce(c, F.lit(False))


def positive(c: Column) -> Column:
    return F.coalesce(stats.finite(c) > 0, F.lit(False))


def same(a: Column, b: Column) -> Column:
    return F.coalesce(stats.close(a, b), F.lit(False))


def public(c: Column) -> Column:
    """A safe text that says something."""
    return text.safe_metadata(c) & (F.trim(c) != "") & (F.lower(c) != "unknown")


def runtime_code(r: Column, version: Column) -> Column:
    """First structural failure of a runtime manifest of version 1.0 or 1.1."""
    digest = lambda c: F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))
    unknown = F.sha2(F.lit("unknown"), 256)
    reference = lambda c: (c == "unknown") | text.immutable_digest(c) | F.coalesce(c.rlike(r"^[\w./:-]+(@sha256:[0-9a-f]{64})?$"), F.lit(False))
    old = [r[f] for f in ("image_digest", "gpu", "cuda_version", "driver_version")]
    new = [r[f] for f in ("accelerator_backend", "accelerator", "accelerator_runtime_version", "host_os_version", "software_environment_digest")]
    every = lambda cols, f: F.forall(F.array(*cols), f)
    one, backend = version == "1.0", r["accelerator_backend"]
    cuda = F.coalesce(backend == "cuda", F.lit(False))
    aliases = (r["accelerator"] == r["gpu"]) & (r["accelerator_fingerprint_sha256"] == r["gpu_fingerprint_sha256"]) & (r["accelerator_fingerprint_supplied"] == r["gpu_fingerprint_supplied"])
    return (
        F.when(r.isNull(), "unverified_manifest_metadata").when(no(version.isin("1.0", "1.1")), "unsupported_runtime_manifest_version")
        .when(no(every(old, lambda c: text.safe_metadata(c))) | no(reference(r["image_digest"])), "unsafe_runtime_metadata").when(no(digest(r["gpu_fingerprint_sha256"])), "invalid_manifest_digest")
        .when(one & r["gpu_fingerprint_supplied"].isNull(), "invalid_runtime_fingerprint_marker").when(one & no(every(old, public)), "unverified_manifest_metadata")
        .when(one & (no(r["gpu_fingerprint_supplied"]) | (r["gpu_fingerprint_sha256"] == unknown)), "gpu_fingerprint_not_supplied")
        .when(~one & no(every(new, lambda c: text.safe_metadata(c))), "unsafe_runtime_metadata").when(~one & no(backend.isin("cuda", "rocm", "metal", "xpu", "cpu", "tpu")), "unverified_manifest_metadata")
        .when(~one & (no(public(r["accelerator"])) | no(public(r["accelerator_runtime_version"])) | (~cuda & no(public(r["host_os_version"])))), "unverified_manifest_metadata")
        .when(~one & no(reference(r["software_environment_digest"])), "unsafe_runtime_metadata").when(~one & no(digest(r["accelerator_fingerprint_sha256"])), "invalid_manifest_digest").when(~one & no(aliases), "runtime_aliases_do_not_reconcile")
        .when(~one & (no(r["accelerator_fingerprint_supplied"]) | (r["accelerator_fingerprint_sha256"] == unknown)), "accelerator_fingerprint_not_supplied")
        .when(~one & cuda & no(public(r["image_digest"]) & public(r["cuda_version"]) & public(r["driver_version"])), "unverified_manifest_metadata")
    )


def runtime_reasons(r: Column, version: Column) -> Column:
    """Codes against deciding from a runtime manifest: the structural failure, or the digests that are not pinned."""
    code = runtime_code(r, version)
    later = version != "1.0"
    need = F.array_compact(F.array(
        F.when(later & ~text.immutable_digest(r["software_environment_digest"]), "immutable_software_environment_digest_required"),
        F.when((~later | (r["accelerator_backend"] == "cuda")) & ~text.immutable_digest(r["image_digest"]), "immutable_image_digest_required"),
    ))
    return F.when(code.isNotNull(), F.array(code)).otherwise(need)


def safety_ok(s: Column) -> Column:
    limits, over = s["limits"], s["overrides"]
    counts = [limits[f] > 0 for f in ("max_requests", "max_tokens_per_request", "max_total_requested_tokens", "max_errors", "max_concurrency", "max_response_bytes")]
    known = [over[f].isNotNull() for f in ("insecure_http", "unknown_cost_acknowledged", "guidellm_validation_gaps_acknowledged")]
    ok = positive(limits["max_elapsed_seconds"]) & positive(limits["max_estimated_spend"]) & ~s["ambient_proxy_environment_used"] & ~s["redirects_followed"]
    for c in (*counts, *known):
        ok = ok & c
    return F.coalesce(ok, F.lit(False))


def cost_ok(c: Column, max_elapsed: Column) -> Column:
    """Whether a cost manifest is one model only, with the upper bound that its rates give."""
    fields = ("total_hourly_rate", "gpu_count", "active_second_rate", "max_active_workers", "billed_active_seconds", "user_supplied_total")
    only = lambda *own: F.forall(F.array(*[c[f].cast("double") for f in fields if f not in own]), lambda x: x.isNull())
    bound = c["pre_run_upper_bound"]
    billed = F.coalesce(c["billed_active_seconds"], F.lit(0.0))
    active = F.greatest(c["active_second_rate"] * c["max_active_workers"] * max_elapsed, c["active_second_rate"] * billed)
    by = (
        F.when(c["kind"] == "unknown", bound.isNull() & only())
        .when(c["kind"] == "dedicated_hourly", positive(c["total_hourly_rate"]) & (c["gpu_count"] > 0) & only("total_hourly_rate", "gpu_count") & same(bound, c["total_hourly_rate"] * max_elapsed / 3600.0))
        .when(c["kind"] == "serverless_active_seconds", positive(c["active_second_rate"]) & (c["max_active_workers"] > 0) & (billed >= 0) & only("active_second_rate", "max_active_workers", "billed_active_seconds") & same(bound, active))
        .when(c["kind"] == "user_supplied", positive(c["user_supplied_total"]) & only("user_supplied_total") & same(bound, c["user_supplied_total"]))
    )
    return F.coalesce((c["currency"] == "USD") & positive(max_elapsed) & c["accounting_basis"].isNotNull() & ((c["kind"] == "unknown") | positive(bound)) & by, F.lit(False))


def _sum(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + F.coalesce(f(x).cast("double"), F.lit(0.0)))


def interval_of(values: Column) -> tuple[Column, Column, Column]:
    """n, low and high of the Student-t interval of an array of numbers."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    half = stats.t_critical(n - 1) * F.sqrt(F.try_divide(spread, n - 1)) / F.sqrt(n.cast("double"))
    return n, mean - half, mean + half


def _ci_matches(ci: Column, values: Column) -> Column:
    n, low, high = interval_of(values)
    empty = (F.size(values) == 0) & (ci["n"] == 0) & ci["low"].isNull() & ci["high"].isNull()
    return F.coalesce(empty | ((ci["n"] == n) & same(ci["low"], low) & same(ci["high"], high)), F.lit(False))


def _maps_ok(counts: Column, n: Column) -> Column:
    whole = text.count_map_strict(counts["status_counts"], counts["error_counts"], counts["finish_reason_counts"], n)
    return whole | F.coalesce((n == 0) & (F.size(counts["status_counts"]) == 0) & (F.size(counts["error_counts"]) == 0) & (F.size(counts["finish_reason_counts"]) == 0), F.lit(False))


def _counts_ok(c: Column) -> Column:
    return F.coalesce((c["attempted"] >= 0) & (c["valid"] >= 0) & (c["invalid"] >= 0), F.lit(False))


def block_code(b: Column, index: Column, load: Column, m: Column) -> Column:
    """First failing code of a block at a (one-based) index under a load descriptor and a manifest."""
    counts, metrics, traffic = b["request_counts"], b["metrics"], m["traffic"]
    n, tokens, wall, peak = counts["attempted"], metrics["completion_tokens"], b["wall_duration_seconds"], b["observed_peak_in_flight"]
    is_open = load["kind"] == "open_loop"
    lag, window = b["scheduler_lag_ms"], b["launch_window_seconds"]
    achieved = F.try_divide(n - 1, window)
    error = F.abs(achieved - load["value"]) / load["value"]
    blank = no(same(b["target_offered_request_rate"], load["value"])) | no(n >= 2) | no(positive(window)) | no(window <= wall) | no(positive(b["achieved_offered_request_rate"])) | no(b["offered_rate_relative_error"] >= 0) | no(b["scheduler_lag_interval_ratio_p95"] >= 0) | lag.isNull()
    ordered = (lag["count"] == n) & (lag["mean"] >= 0) & (lag["p50"] >= 0) & (lag["p50"] <= lag["p90"]) & (lag["p90"] <= lag["p95"]) & (lag["p95"] <= lag["p99"])
    agrees = ordered & same(b["achieved_offered_request_rate"], achieved) & same(b["offered_rate_relative_error"], error) & same(b["scheduler_lag_interval_ratio_p95"], lag["p95"] / (1000.0 / load["value"]))
    still = ~m["request"]["stream"]
    return (
        F.when(no(b["valid"]), "invalid_or_partial_block").when(no(b["block_index"] == index), "block_indexes_not_sequential").when(no(F.size(b["invalid_reasons"]) == 0) | no(counts["invalid"] == 0) | metrics.isNull(), "invalid_or_partial_block")
        .when(no(positive(metrics["output_tokens_per_second"])), "invalid_block_metrics").when(no(_counts_ok(counts)) | no(n == counts["valid"]), "invalid_block_counts").when(no(_maps_ok(counts, n)), "invalid_block_count_maps")
        .when(traffic["requests_per_block"].isNotNull() & no(n == traffic["requests_per_block"]), "block_request_count_does_not_match_manifest").when(no(tokens > 0) | no(tokens >= counts["valid"]), "invalid_block_token_evidence").when(no(tokens <= counts["valid"] * m["request"]["max_tokens"]), "block_tokens_exceed_request_contract")
        .when(no(positive(wall)), "invalid_block_duration").when(traffic["block_duration_seconds"].isNotNull() & no(wall >= traffic["block_duration_seconds"]), "block_duration_does_not_meet_manifest").when(no(b["offered_requests"] == n), "block_offered_requests_do_not_reconcile")
        .when(no((peak > 0) & (peak <= load["max_in_flight"])), "invalid_block_peak_in_flight").when(~is_open & no(peak == load["max_in_flight"]), "closed_loop_target_concurrency_not_achieved_in_every_block")
        .when(is_open & blank, "open_loop_rate_evidence_invalid").when(is_open & no(agrees), "open_loop_rate_evidence_does_not_reconcile").when(is_open & (no(error <= RATE_TOLERANCE) | no(b["scheduler_lag_interval_ratio_p95"] <= LAG_TOLERANCE) | no(b["open_loop_target_achieved"])), "open_loop_target_rate_not_achieved")
        .when(no(same(metrics["output_tokens_per_second"], tokens / wall)), "block_throughput_does_not_reconcile").when(no(positive(metrics["requests_per_second"])) | no(same(metrics["requests_per_second"], counts["valid"] / wall)), "block_request_throughput_does_not_reconcile")
        .when(no(metrics["valid_response_count"] == counts["valid"]) | no(metrics["error_rate"] == 0), "block_metric_counts_do_not_reconcile").when(no(positive(metrics["e2e_latency_ms"]["p95"])) | metrics["ttft_ms"].isNull(), "invalid_block_latency_evidence")
        .when(still & (no(metrics["ttft_ms"]["count"] == 0) | metrics["ttft_ms"]["p95"].isNotNull()), "invalid_nonstream_ttft_evidence").when(~still & no(positive(metrics["ttft_ms"]["p95"])), "invalid_block_latency_evidence")
    )


def condition_code(c: Column, m: Column) -> Column:
    """First failing code of a condition: its own evidence, its blocks in order, then how they add up."""
    counts, metrics, blocks, warm, load = c["request_counts"], c["metrics"], c["blocks"], c["warmup"], c["condition"]
    n, wall, tokens, peak = counts["attempted"], c["measured_wall_seconds"], metrics["completion_tokens"], c["observed_peak_in_flight"]
    is_open, warmups = load["kind"] == "open_loop", m["traffic"]["warmup_requests_per_condition"]
    descriptor = load["kind"].isin("closed_loop", "open_loop") & positive(load["value"]) & (load["max_in_flight"] > 0) & (is_open | (load["value"] == load["max_in_flight"]))
    before = (
        F.when(no(c["valid"]) | no(c["decision_grade"]), "one_or_more_conditions_not_decision_grade").when(counts.isNull() | warm.isNull() | metrics.isNull(), "condition_evidence_missing").when(no(F.size(blocks) == m["traffic"]["blocks"]), "condition_block_count_mismatch")
        .when(no(descriptor), "condition_descriptor_invalid").when(no(load["id"] == text.condition_id(load["kind"], load["value"])), "condition_id_does_not_match_descriptor").when(no(peak > 0), "condition_peak_in_flight_missing").when(no(peak <= load["max_in_flight"]), "condition_peak_in_flight_invalid")
        .when(~is_open & no(peak == load["max_in_flight"]), "closed_loop_target_concurrency_not_achieved").when(no(_counts_ok(counts)), "condition_request_counts_invalid").when(no((counts["invalid"] == 0) & (n == counts["valid"])), "condition_contains_invalid_responses")
        .when(no(_maps_ok(counts, n)), "condition_request_count_maps_invalid").when(no(positive(wall)), "condition_duration_invalid").when((counts["valid"] < LEAST_REQUESTS) & (wall < LEAST_SECONDS), "condition_measurement_floor_not_met").when(no(warm["invalid"] == 0), "warmup_contains_invalid_responses")
        .when(no((warm["attempted"] == warmups) & (warm["valid"] == warmups)), "warmup_counts_do_not_reconcile").when(no(_maps_ok(warm, warmups)), "warmup_request_count_maps_invalid").when(no((tokens > 0) & (tokens >= counts["valid"])), "condition_token_evidence_invalid")
        .when(no(tokens <= counts["valid"] * m["request"]["max_tokens"]), "condition_tokens_exceed_request_contract").when(no(positive(metrics["output_tokens_per_second"])), "condition_throughput_invalid")
    )
    within = F.try_element_at(F.array_compact(F.transform(blocks, lambda b, i: block_code(b, i + 1, load, m))), F.lit(1))
    finishes = F.array_distinct(F.flatten(F.transform(blocks, lambda b: F.map_keys(b["request_counts"]["finish_reason_counts"]))))
    by_reason = lambda k: _sum(blocks, lambda b: F.try_element_at(b["request_counts"]["finish_reason_counts"], k))
    finish_ok = F.forall(F.array_union(finishes, F.map_keys(counts["finish_reason_counts"])), lambda k: F.try_element_at(counts["finish_reason_counts"], k).cast("double") == by_reason(k))
    each = blocks["metrics"]
    tps, rps = each["output_tokens_per_second"], each["requests_per_second"]
    p95 = {f: F.array_compact(each[f]["p95"]) for f in ("e2e_latency_ms", "ttft_ms")}
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)
    means_ok = same(metrics["block_mean_output_tokens_per_second"], mean(tps)) & same(metrics["block_mean_requests_per_second"], mean(rps)) & _ci_matches(metrics["block_mean_output_tokens_per_second_ci"], tps) & _ci_matches(metrics["block_mean_requests_per_second_ci"], rps)
    achieved = F.try_divide(_sum(blocks, lambda b: b["request_counts"]["attempted"] - 1), _sum(blocks, lambda b: b["launch_window_seconds"]))
    rate_ok = (c["target_offered_request_rate"] == load["value"]) & same(c["achieved_offered_request_rate"], achieved) & same(c["offered_rate_relative_error"], F.abs(achieved - load["value"]) / load["value"]) & c["open_loop_target_achieved"]
    slo = F.lit(False)
    for limit, f in (("p95_slo_ms", "e2e_latency_ms"), ("ttft_slo_ms", "ttft_ms")):
        slo = slo | (m["traffic"][limit].isNotNull() & no(positive(metrics[f]["p95_repeated_block_ci"]["high"])))
    after = (
        F.when(no((_sum(blocks, lambda b: b["request_counts"]["attempted"]) == n) & (_sum(blocks, lambda b: b["request_counts"]["valid"]) == counts["valid"])), "condition_counts_do_not_reconcile").when(no(finish_ok), "condition_finish_reason_counts_do_not_reconcile")
        .when(no(_sum(blocks, lambda b: b["metrics"]["completion_tokens"]) == tokens), "condition_tokens_do_not_reconcile").when(no(same(_sum(blocks, lambda b: b["wall_duration_seconds"]), wall)), "condition_wall_time_does_not_reconcile")
        .when(no(same(metrics["output_tokens_per_second"], tokens / wall)), "condition_throughput_does_not_reconcile").when(no(same(metrics["requests_per_second"], counts["valid"] / wall)), "condition_request_throughput_does_not_reconcile")
        .when(no((metrics["valid_response_count"] == counts["valid"]) & (metrics["error_rate"] == 0)), "condition_metric_counts_do_not_reconcile").when(no(means_ok), "repeated_block_throughput_estimate_does_not_reconcile")
        .when(no(F.array_max(F.transform(blocks, lambda b: b["observed_peak_in_flight"])) == peak), "condition_peak_in_flight_does_not_reconcile").when(is_open & no(rate_ok), "condition_open_loop_rate_evidence_does_not_reconcile")
        .when(no(_ci_matches(metrics["e2e_latency_ms"]["p95_repeated_block_ci"], p95["e2e_latency_ms"])) | no(_ci_matches(metrics["ttft_ms"]["p95_repeated_block_ci"], p95["ttft_ms"])), "repeated_block_slo_interval_does_not_reconcile").when(slo, "invalid_slo_confidence_interval")
    )
    return F.coalesce(before, within, after)


def preflight_code(r: Column) -> Column:
    """First failing code of a whole report (a struct of type REPORT); null if it is evidence."""
    m = r["manifest"]
    req, traffic, limits, cost, totals, paid = m["request"], m["traffic"], m["safety"]["limits"], m["cost"], r["run_totals"], r["cost_summary"]
    named = [m["tool"]["name"], m["tool"]["version"], m["engine"]["backend"], m["engine"]["backend_version"], m["engine"]["http_client_version"], m["engine"]["server_version"], m["model"]["id"], m["model"]["immutable_revision"], m["workload"]["cache_policy"]]
    digest = lambda c: F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))
    flags = m["engine"]["effective_flags"]
    flags_ok = flags.isNotNull() & ~text.has_alias_collision(F.map_keys(flags)) & F.forall(F.map_entries(flags), lambda e: text.safe_metadata(e["key"]) & text.safe_metadata(e["value"])) & m["engine"]["effective_flags_provenance"].isin("operator_attested", "runtime_verified")
    request_ok = (req["type"] == "chat_completions") & (req["temperature"] == 0) & req["stop"].isNull() & req["stream"].isNotNull() & (req["max_tokens"] > 0) & positive(req["timeout_seconds"]) & (req["max_tokens"] <= limits["max_tokens_per_request"])
    slos_ok = (traffic["p95_slo_ms"].isNull() | positive(traffic["p95_slo_ms"])) & (traffic["ttft_slo_ms"].isNull() | positive(traffic["ttft_slo_ms"]))
    first = (
        F.when(r["schema_version"] == "1.0", "legacy_schema_not_decision_grade").when(no(r["schema_version"] == "2.0"), "unsupported_schema").when(no(r["artifact_type"] == ARTIFACT), "unsupported_artifact_type").when(no(r["mode"] == "benchmark"), "smoke_or_nonbenchmark_report")
        .when(no(r["status"] == "complete"), "partial_or_failed_report").when(r["stop_reason"].isNotNull(), "complete_report_has_stop_reason").when(no(m["manifest_version"].isin("1.0", "1.1")), "missing_or_invalid_manifest")
        .when(no(F.forall(F.array(*named), public)), "unverified_manifest_metadata")
    )
    second = (
        F.when(no(digest(m["workload"]["measured_sha256"])) | no(digest(m["workload"]["warmup_sha256"])), "invalid_manifest_digest").when(no(m["workload"]["warmup_is_separate"]) | no(m["workload"]["warmup_prompts_disjoint"]), "warmup_workload_not_separate")
        .when(m["workload"]["seed"].isNull(), "invalid_manifest_seed").when(req.isNull() | traffic.isNull(), "incomplete_manifest_contract").when(no(safety_ok(m["safety"])), "invalid_safety_manifest").when(no(cost_ok(cost, limits["max_elapsed_seconds"])), "invalid_cost_manifest")
        .when(cost["pre_run_upper_bound"] > limits["max_estimated_spend"], "pre_run_cost_exceeded_spend_limit").when((cost["kind"] == "unknown") & no(m["safety"]["overrides"]["unknown_cost_acknowledged"]), "unknown_cost_not_acknowledged").when(no(flags_ok), "invalid_engine_flag_manifest")
        .when(no((traffic["open_loop_rate_relative_tolerance"] == RATE_TOLERANCE) & (traffic["open_loop_scheduler_lag_interval_tolerance"] == LAG_TOLERANCE)), "unsupported_open_loop_tolerance_contract").when(no(request_ok), "unsupported_request_contract").when(no(slos_ok), "invalid_slo_manifest")
        .when(no(traffic["blocks"] >= LEAST_BLOCKS), "fewer_than_three_blocks").when(traffic["requests_per_block"].isNull() == traffic["block_duration_seconds"].isNull(), "ambiguous_block_bound").when(traffic["requests_per_block"] <= 0, "invalid_request_bound")
        .when(traffic["block_duration_seconds"].isNotNull() & no(positive(traffic["block_duration_seconds"])), "invalid_duration_bound").when(no(traffic["warmup_requests_per_condition"] >= 0), "invalid_warmup_count").when(no(F.size(r["conditions"]) > 0), "missing_conditions")
        .when(no(F.size(traffic["conditions"]) == F.size(r["conditions"])), "condition_manifest_mismatch")
    )
    within = F.try_element_at(F.array_compact(F.transform(r["conditions"], lambda c: condition_code(c, m))), F.lit(1))
    conditions = r["conditions"]
    attempted = _sum(conditions, lambda c: c["request_counts"]["attempted"] + traffic["warmup_requests_per_condition"])
    tokens = _sum(conditions, lambda c: c["metrics"]["completion_tokens"])
    elapsed = totals["elapsed_seconds"]
    counted = [totals[f] for f in ("requests_started", "requests_completed", "requests_cancelled", "requests_in_flight", "peak_in_flight", "errors", "reserved_output_tokens")]
    sums = (totals["requests_started"] == attempted) & (totals["requests_completed"] == attempted) & (totals["requests_cancelled"] == 0) & (totals["requests_in_flight"] == 0) & (totals["errors"] == 0) & (totals["peak_in_flight"] >= F.array_max(F.transform(conditions, lambda c: c["observed_peak_in_flight"]))) & (totals["reserved_output_tokens"] == attempted * req["max_tokens"])
    bounds = positive(elapsed) & (elapsed >= _sum(conditions, lambda c: c["measured_wall_seconds"])) & (elapsed <= limits["max_elapsed_seconds"]) & (attempted <= limits["max_requests"]) & (totals["reserved_output_tokens"] <= limits["max_total_requested_tokens"]) & (totals["peak_in_flight"] <= limits["max_concurrency"])
    a, z = text.offset_timestamp(r["started_at"]), text.offset_timestamp(r["completed_at"])
    span = (F.unix_micros(z) - F.unix_micros(a)) / 1e6
    final = F.when(cost["kind"] == "dedicated_hourly", cost["total_hourly_rate"] * elapsed / 3600.0).when(cost["kind"] == "serverless_active_seconds", cost["active_second_rate"] * cost["billed_active_seconds"]).when(cost["kind"] == "user_supplied", cost["user_supplied_total"])
    paid_ok = F.when(final.isNull(), paid["total_cost"].isNull() & paid["cost_per_million_output_tokens"].isNull()).otherwise(same(paid["total_cost"], final) & same(paid["cost_per_million_output_tokens"], F.try_divide(final, tokens) * 1e6))
    each = F.forall(conditions, lambda c: positive(c["metrics"]["cost_per_million_output_tokens"]) & same(c["metrics"]["cost_per_million_output_tokens"], cost["total_hourly_rate"] * c["measured_wall_seconds"] / 3600.0 / c["metrics"]["completion_tokens"] * 1e6))
    last = (
        F.when(no(F.transform(conditions, lambda c: c["condition"]) == traffic["conditions"]), "condition_manifest_mismatch").when(totals.isNull(), "run_totals_missing").when(no(F.forall(F.array(*counted), lambda x: x >= 0)), "run_totals_invalid").when(no(sums), "run_totals_do_not_reconcile")
        .when(no(bounds), "run_totals_violate_safety_or_wall_time").when(a.isNull() | z.isNull(), "run_timestamps_invalid").when(no((span >= 0) & (span + 5.0 >= elapsed)), "run_timestamps_do_not_reconcile").when(paid.isNull(), "cost_evidence_missing")
        .when(no(paid["kind"] == cost["kind"]) | no(paid["completion_tokens"] == tokens) | no(paid_ok), "cost_summary_does_not_reconcile").when((cost["kind"] == "dedicated_hourly") & no(each), "condition_cost_evidence_does_not_reconcile")
    )
    return F.coalesce(first, runtime_code(m["runtime"], m["manifest_version"]), second, within, last)


def preflight(reports: DataFrame, report: str = "report") -> DataFrame:
    """``reports`` (JSON text) with ``code``, the first failing check; a text that is not JSON is report_structure_non_json_type."""
    parsed = reports.withColumn("_r", F.from_json(report, REPORT))
    return parsed.withColumn("code", F.when(F.try_parse_json(report).isNull(), "report_structure_non_json_type").otherwise(preflight_code(F.col("_r")))).drop("_r")


def run_decision_reasons(**checks: Column) -> Column:
    """Sorted codes against deciding from a run; ``checks`` name the code and what must hold."""
    return stats.reasons(*[(no(c), code) for code, c in checks.items()])


def finalize(runs: DataFrame) -> DataFrame:
    """Runs with what closes them: status, stop_reason, best_state, best_reason, reasons (sorted) against deciding from them, decision_eligible and cost of a million tokens.

    Columns read: mode, status, stop_reason, elapsed_seconds, max_elapsed_seconds, spend_estimate, max_estimated_spend, conditions and graded (numbers of conditions and of those that are decision-grade),
    best_state, backend, stream, evidence_source, flags_provenance, cache_policy, model_revision, server_version, warmup_prompts_disjoint, manifest_version, runtime (RUNTIME), total_cost and
    completion_tokens. Columns that null is in count as not fulfilled. A run that has crossed its time or its spend is stopped, whatever its runner said; one that is not
    complete has no best condition, and a supported one of a run that cannot decide becomes inconclusive.
    """
    c = F.col
    limit = F.when(c("elapsed_seconds") >= c("max_elapsed_seconds"), "max_elapsed_time").when(c("spend_estimate") >= c("max_estimated_spend"), "max_estimated_spend")
    crossed = (c("status") == "complete") & (c("stop_reason").isNotNull() | limit.isNotNull())
    closed = runs.withColumns({"_status": F.when(crossed, "stopped").otherwise(c("status")), "_stop": F.when(crossed, F.coalesce("stop_reason", limit)).otherwise(c("stop_reason"))})
    complete = c("_status") == "complete"
    best = F.when(no(complete), "inconclusive").when(no(c("conditions") > 0), "not_evaluated").otherwise(c("best_state"))
    provenance = F.coalesce(runtime_reasons(c("runtime"), c("manifest_version")), F.array(F.lit("complete_runtime_provenance_required")))
    why = stats.reasons(
        (no(c("mode") == "benchmark"), "smoke_mode_is_not_decision_grade"), (no(complete), "run_is_not_complete"), (no((c("conditions") > 0) & (c("graded") == c("conditions"))), "one_or_more_conditions_are_not_decision_grade"),
        (no(best == "supported"), "best_tested_result_is_not_statistically_supported"), (no(c("backend") == "native"), "strict_native_completion_validation_required"), (no(c("stream")), "streaming_required_for_decision_grade"), (no(c("evidence_source") == "live_inference"), "live_inference_evidence_required"),
        (no(c("flags_provenance") == "runtime_verified"), "runtime_verified_engine_flags_required"), (no(c("cache_policy") != "unknown"), "explicit_cache_policy_required"), (~text.immutable_revision("model_revision"), "immutable_model_revision_required"), (no(c("server_version") != "unknown"), "complete_runtime_provenance_required"),
        (no(c("warmup_prompts_disjoint")), "warmup_prompts_must_be_disjoint"),
    )
    done = closed.withColumn("_best", best).withColumn("reasons", F.array_sort(F.array_union(why, provenance)))
    demoted = (c("_best") == "supported") & (F.size("reasons") > 0)
    out = {
        "status": c("_status"), "stop_reason": c("_stop"), "best_state": F.when(demoted, "inconclusive").otherwise(c("_best")),
        "best_reason": F.when(demoted, "run_manifest_or_evidence_is_not_decision_eligible").when(no(c("_status") == "complete"), "partial_or_failed_run").when(no(c("conditions") > 0), "no_completed_conditions"),
        "decision_eligible": F.size("reasons") == 0, "cost_per_million_output_tokens": F.when(c("completion_tokens") > 0, c("total_cost") / c("completion_tokens") * 1_000_000.0),
    }
    return done.withColumns(out).drop("_status", "_stop", "_best")


def treatment(baseline: Column, candidate: Column) -> Column:
    """Struct of baseline and candidate values of the one flag (max-num-seqs) in which two flag maps differ; null if anything else does."""
    norm = lambda flags: F.map_from_entries(F.transform(F.map_entries(flags), lambda e: F.struct(text.flag_name(e["key"]).alias("key"), e["value"].alias("value"))))
    a, b = norm(baseline), norm(candidate)
    names = F.filter(F.array_union(F.map_keys(a), F.map_keys(b)), lambda k: ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)))
    x, y = (text.canonical_positive_int(F.try_element_at(f, F.lit("max-num-seqs"))) for f in (a, b))
    return F.when((names == F.array(F.lit("max-num-seqs"))) & (x != y), F.struct(x.alias("baseline_value"), y.alias("candidate_value")))


def golden_conditions(rates: DataFrame, tokens: DataFrame, keys: list[str], bounds: DataFrame | None = None, e2e_ms: float | None = None, ttft_ms: float | None = None) -> DataFrame:
    """State, outcome and reason of each condition of a six-position sequence.

    ``rates``: contrast rows of ``compare.phase_contrasts``; ``tokens``: completion_tokens by keys, position and block_index;
    ``bounds``: upper interval bounds e2e_p95_high and ttft_p95_high (ms) by keys and position, held against the SLOs that are set; a missing bound fails one.
    """
    treated = F.col("position").startswith("C")
    total = F.sum("completion_tokens")
    by_position = tokens.groupBy(*keys, "position").agg(total.alias("t"))
    spread = lambda c: F.coalesce(F.try_divide(F.max(c) - F.min(c), F.max(c)), F.lit(1.0))
    sides = by_position.groupBy(*keys).agg(F.sum(F.when(treated, F.col("t"))).alias("_c"), F.sum(F.when(~treated, F.col("t"))).alias("_b"), spread("t").alias("position_spread"))
    blocks = tokens.groupBy(*keys, "block_index").agg(spread("completion_tokens").alias("s")).groupBy(*keys).agg(F.max("s").alias("block_spread"))
    got = rates.join(sides, keys).join(blocks, keys).withColumn("token_difference", F.abs(F.col("_c") - F.col("_b")) / F.greatest("_c", "_b"))
    fails = [~F.coalesce(F.col(c) <= most, F.lit(False)) for c, most in (("e2e_p95_high", e2e_ms), ("ttft_p95_high", ttft_ms)) if most is not None]
    if bounds is not None and fails:
        failed = bounds.groupBy(*keys).agg(F.max(F.greatest(*fails) if len(fails) > 1 else fails[0]).alias("_failed"))
        got = got.join(failed, keys, "left").withColumn("_failed", F.coalesce("_failed", F.lit(True)))
    else:
        got = got.withColumn("_failed", F.lit(False))
    comparable = (F.col("token_difference") <= TOKEN_TOLERANCE) & (F.col("position_spread") <= TOKEN_TOLERANCE) & (F.col("block_spread") <= TOKEN_TOLERANCE)
    fit = comparable & ~F.col("_failed")
    outcome = F.when(fit & (F.col("low") > 0), "candidate_higher_throughput").when(fit & (F.col("high") < 0), "baseline_higher_throughput")
    return got.select(*keys, "estimate", "low", "high", "token_difference", "position_spread", "block_spread", outcome.alias("outcome"), F.when(outcome.isNotNull(), "supported").otherwise("inconclusive").alias("state"), F.when(~comparable, "completion_tokens_outside_5_percent_tolerance").when(F.col("_failed"), "one_or_more_runs_fail_declared_slo").when(outcome.isNull(), "order_balanced_ci_includes_zero").alias("reason"))


def golden_decision(conditions: DataFrame, keys: list[str], order: str, baseline_value: Column, candidate_value: Column) -> DataFrame:
    """Decision of each sequence from ``golden_conditions``: supported if all its conditions are, with one outcome.

    A supported one names the winner and its value and gives the estimate and interval of the first condition by ``order``; else these are null.
    """
    first = F.min_by(F.struct("estimate", "low", "high"), order)
    got = conditions.groupBy(*keys).agg(F.count("*").alias("conditions"), F.min(F.col("state") == "supported").alias("_all"), F.count_distinct("outcome").alias("_n"), F.min("outcome").alias("_o"), first.alias("_i"))
    ok = F.col("_all") & (F.col("_n") == 1)
    candidate = F.col("_o") == "candidate_higher_throughput"
    keep = lambda c: F.when(ok, c)
    return got.select(
        *keys, "conditions", F.when(ok, "supported").otherwise("inconclusive").alias("decision_state"), ok.alias("decision_eligible"), keep(F.col("_o")).alias("overall_outcome"), keep(F.when(candidate, "candidate").otherwise("baseline")).alias("winner"),
        keep(F.when(candidate, candidate_value).otherwise(baseline_value)).alias("winner_value"), keep(F.col("_i.estimate")).alias("estimate"), keep(F.col("_i.low")).alias("low"), keep(F.col("_i.high")).alias("high"),
    )


def fingerprint(report: Column) -> Column:
    """SHA-256 of the canonical JSON of a report's evidence columns: schema, manifest, conditions, totals and cost; nothing else of the text counts."""
    return text.digest(text.canonical_json(F.to_json(F.struct(*[report[f].alias(f) for f in ("conditions", "cost_summary", "manifest", "run_totals", "schema_version")]))))


def planned(conditions: Column, blocks: Column, per_block: Column, warmups: Column, max_tokens: Column) -> dict[str, Column]:
    """Requests and requested output tokens of a plan that sends nothing; null where blocks are bounded by time."""
    requests = F.size(conditions) * (blocks * per_block + warmups)
    return {"request_count": requests.cast("long"), "requested_output_tokens": (requests * max_tokens).cast("long")}
