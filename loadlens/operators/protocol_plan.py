"""Plan of a six-run session that sends nothing: positions, totals, and every reason for which the session would prove nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.functions import stats, text
from loadlens.operators import config, reports, runs

# The order of the six runs, and floors of a run.
SEQUENCE = (("B1", "baseline"), ("C1", "candidate"), ("B2", "baseline"), ("C2", "candidate"), ("B3", "baseline"), ("C3", "candidate"))
LEAST_BLOCKS, LEAST_REQUESTS, TREATMENT = 3, 200, "max-num-seqs"
CANONICAL = "golden_max_num_seqs_values_must_be_canonical_positive_integers"

#: A session: the configuration of its runs, the two flags that differ, and what is known of workload, runtime and cost.
SESSION = (
    "struct<baseline:struct<name:string,value:string>,candidate:struct<name:string,value:string>,backend:string,stream:boolean,conditions:array<struct<kind:string,value:double,max_in_flight:int>>,blocks:int,requests_per_block:int,warmup_requests:int,max_tokens:int,"
    "evidence_source:string,cache_policy:string,flags_provenance:string,variant:string,sequence_position:string,model_revision:string,server_version:string,flags:map<string,string>,warmup_separate:boolean,warmup_disjoint:boolean,"
    f"runtime:{reports.RUNTIME},cost:{config.COST},limits:{config.LIMITS},unknown_cost_allowed:boolean>"
)


def plan(sessions: DataFrame, session: str = "session") -> DataFrame:
    """``sessions`` with reasons (sorted; empty for a session that may run), positions (position, variant, max_num_seqs), requests of a position and of the session, and output tokens asked for.

    Where the treatment is unsound the other checks go by 1 and 8, and positions are null. Counts are null where time bounds the blocks.
    Nulls count as not fulfilled, repeated rows are planned each, other columns are carried, and an empty table gives an empty result.
    """
    s = F.col(session)
    no = reports.no
    a, b, limits, cost = s["baseline"], s["candidate"], s["limits"], s["cost"]
    named = (text.flag_name(a["name"]) == TREATMENT) & (text.flag_name(b["name"]) == TREATMENT)
    x, y = text.canonical_positive_int(a["value"]), text.canonical_positive_int(b["value"])
    treatment = (
        F.when(no(named), "golden_treatment_must_only_change_max_num_seqs").when(x.isNull() | y.isNull(), CANONICAL).when(x == y, "golden_max_num_seqs_values_must_be_distinct")
    )
    most = F.when(treatment.isNull(), F.greatest(x, y)).otherwise(8)
    load = F.try_element_at(s["conditions"], F.lit(1))
    whole = load["value"] == F.floor(load["value"])
    closed = (F.size(s["conditions"]) == 1) & (load["kind"] == "closed_loop") & whole
    single = F.coalesce(closed & (load["max_in_flight"] == load["value"]), F.lit(False))
    per, blocks = s["requests_per_block"], s["blocks"]
    requests = (F.size(s["conditions"]) * (blocks * per + s["warmup_requests"])).cast("long")
    total, tokens = 6 * requests, 6 * requests * s["max_tokens"]
    bound = runs.cost_columns(cost["kind"], limits["max_elapsed_seconds"], F.lit(1), cost["total_hourly_rate"], cost["active_second_rate"], cost["max_active_workers"], cost["billed_active_seconds"], cost["user_supplied_total"], limits["max_elapsed_seconds"])["upper_bound"]
    own = F.exists(F.map_keys(s["flags"]), lambda n: text.flag_name(n) == TREATMENT)
    tests = (
        (no(s["backend"] == "native"), "golden_requires_native_backend"), (no(s["stream"]), "golden_requires_streaming"), (~single, "golden_requires_one_closed_loop_concurrency"), (single & (load["value"] < most), "golden_concurrency_must_reach_both_max_num_seqs_values"), (no(blocks >= LEAST_BLOCKS), "golden_requires_at_least_three_blocks"),
        (per.isNull(), "golden_orchestrator_requires_count_bounded_blocks"), (blocks * per < LEAST_REQUESTS, "golden_requires_at_least_200_measured_requests_per_position"), (closed & (per < load["value"]), "golden_requests_per_block_must_reach_declared_concurrency"), (no(s["warmup_requests"] > 0), "golden_requires_separate_warmup_requests"),
        (no(limits["max_errors"] == 1), "golden_requires_zero_error_tolerance"), (no(s["evidence_source"] == "live_inference"), "golden_requires_live_inference_evidence"), (no(s["cache_policy"] != "unknown"), "golden_requires_explicit_cache_policy"), (no(s["flags_provenance"] == "runtime_verified"), "golden_requires_runtime_verified_engine_flags"),
        (no((s["variant"] == "unspecified") & (s["sequence_position"] == "unspecified")), "golden_assigns_variant_and_sequence_position_automatically"), (~text.immutable_revision(s["model_revision"]), "golden_requires_immutable_model_revision"), (no(s["server_version"] != "unknown"), "golden_requires_server_version"),
        (own, "max_num_seqs_must_use_baseline_and_candidate_config_flags"), (cost["kind"] == "user_supplied", "golden_user_supplied_run_total_is_ambiguous_across_six_positions"), ((cost["kind"] == "serverless_active_seconds") & cost["billed_active_seconds"].isNotNull(), "golden_serverless_billed_active_seconds_must_be_added_after_the_session"),
        (bound.isNull() & no(s["unknown_cost_allowed"]), "golden_requires_unknown_cost_acknowledgement"), (bound > limits["max_estimated_spend"], "golden_session_estimated_cost_exceeds_spend_limit"), (no(s["warmup_separate"]), "golden_requires_separate_warmup_workload"), (no(s["warmup_disjoint"]), "golden_requires_disjoint_warmup_prompts"),
        (requests.isNull(), "golden_session_request_count_must_be_exact"), (total > limits["max_requests"], "golden_session_requests_exceed_max_requests"), (tokens > limits["max_total_requested_tokens"], "golden_session_tokens_exceed_total_token_limit"),
    )
    runtime = F.transform(F.coalesce(reports.runtime_reasons(s["runtime"], F.lit("1.1")), F.array().cast("array<string>")), lambda r: F.concat(F.lit("golden_runtime_"), r))
    all_ = F.array_sort(F.array_distinct(F.concat(stats.reasons(*tests), runtime, F.array_compact(F.array(treatment)))))
    positions = F.array(*[F.struct(F.lit(p).alias("position"), F.lit(v).alias("variant"), (x if v == "baseline" else y).cast("int").alias("max_num_seqs")) for p, v in SEQUENCE])
    return sessions.withColumns({"reasons": all_, "positions": F.when(treatment.isNull(), positions), "per_position_requests": requests, "session_requests": total, "session_requested_output_tokens": tokens, "session_cost_upper_bound": bound})
