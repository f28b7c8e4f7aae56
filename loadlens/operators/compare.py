"""Comparison of runs: condition matching, paired intervals, flag differences, attribution, six-position contrasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.functions import stats, text
from loadlens.operators.runs import TOKEN_TOLERANCE

POSITIONS = ("B1", "C1", "B2", "C2", "B3", "C3")


def matched(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer match of two keyed tables with ``side`` (both, left or right); values get the suffixes _l and _r."""
    a = left.select(*keys, *[F.col(v).alias(f"{v}_l") for v in values], F.lit(1).alias("_a"))
    b = right.select(*keys, *[F.col(v).alias(f"{v}_r") for v in values], F.lit(1).alias("_b"))
    out = a.join(b, keys, "full_outer")
    return out.withColumn("side", F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")).drop("_a", "_b")


def changed(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose values differ or that one side lacks; present nulls equal each other."""
    both = matched(left, right, keys, [value])
    return both.where((F.col("side") != "both") | ~F.col(f"{value}_l").eqNullSafe(F.col(f"{value}_r")))


def attribution(names: Column, left_seqs: Column, right_seqs: Column, left_peak: Column, right_peak: Column) -> tuple[Column, Column]:
    """State and reason of a declared difference, from the sorted names of changed flags."""
    only = lambda x: names == F.array(F.lit(x))
    seqs = only("max-num-seqs")
    unknown = left_seqs.isNull() | right_seqs.isNull()
    same = (F.least(left_seqs, right_seqs) <= 0) | (left_seqs == right_seqs)
    unused = F.coalesce(F.least(left_peak, right_peak) < F.greatest(left_seqs, right_seqs), F.lit(True)) | left_peak.isNull() | right_peak.isNull()
    reason = (
        F.when(F.size(names) == 0, "no_treatment_difference_declared")
        .when(only("enable-chunked-prefill"), "chunked_prefill_alone_receives_no_optimization_credit_in_vllm_v1")
        .when(seqs & unknown, "max_num_seqs_values_not_verifiable")
        .when(seqs & same, "max_num_seqs_values_not_meaningfully_different")
        .when(seqs & unused, "max_num_seqs_change_not_exercised_by_load")
        .when(F.size(names) > 1, "multiple_engine_flags_changed")
        .otherwise("one_engine_flag_changed; causality is still not claimed")
    )
    state = F.when(reason == "multiple_engine_flags_changed", "confounded").when(reason.startswith("one_engine_flag"), "controlled_difference_declared").otherwise("unattributable")
    return state, reason


def compare_blocks(left: DataFrame, right: DataFrame, keys: list[str], block: str = "block_index", slo: Column | None = None) -> DataFrame:
    """Per condition the paired throughput interval of two runs' blocks and the first reason that withholds it.

    Blocks carry completion_tokens, output_tokens_per_second; they pair by index. ``slo`` (over _l and _r columns) marks pairs that fail.
    """
    pairs = matched(left, right, [*keys, block], ["completion_tokens", "output_tokens_per_second"])
    apart = lambda a, b: F.try_divide(F.abs(a - b), F.greatest(a, b))
    delta = stats.relative_delta_percent("output_tokens_per_second_r", "output_tokens_per_second_l")
    out = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("side") == "both").alias("paired"), F.sum("completion_tokens_l").alias("_tl"), F.sum("completion_tokens_r").alias("_tr"),
        F.max(apart(F.col("completion_tokens_l"), F.col("completion_tokens_r"))).alias("block_difference"),
        F.count_if((F.col("completion_tokens_l") > 0) & (F.col("completion_tokens_r") > 0)).alias("_tokens"), F.count_if((F.col("output_tokens_per_second_l") > 0) & (F.col("output_tokens_per_second_r") > 0)).alias("_rates"),
        F.max(F.coalesce(slo, F.lit(True)) if slo is not None else F.lit(False)).alias("_slo"), stats.t_interval(delta).alias("ci"),
    )
    difference = apart(F.col("_tl"), F.col("_tr"))
    whole = (F.col("n") >= 3) & (F.col("paired") == F.col("n"))
    reason = (
        F.when(~F.coalesce((F.col("_tl") > 0) & (F.col("_tr") > 0), F.lit(False)), "invalid_completion_token_totals")
        .when(difference > TOKEN_TOLERANCE, "completion_tokens_outside_5_percent_tolerance")
        .when(~whole | (F.col("_tokens") < F.col("n")), "missing_matched_block_token_evidence")
        .when(F.col("block_difference") > TOKEN_TOLERANCE, "one_or_more_block_pairs_outside_5_percent_completion_token_tolerance")
        .when(F.col("_slo"), "one_or_both_runs_fail_declared_slo")
        .when(F.col("_rates") < F.col("n"), "missing_matched_block_metrics")
    )
    up, down = F.coalesce(F.col("ci.low") > 0, F.lit(False)), F.coalesce(F.col("ci.high") < 0, F.lit(False))
    available = reason.isNull()
    outcome = F.when(available & up, "candidate_higher_throughput").when(available & down, "baseline_higher_throughput")
    return out.select(
        *keys, available.alias("available"), difference.alias("token_difference"), "block_difference", F.when(available, F.col("ci.mean")).alias("estimate"), F.when(available, F.col("ci.low")).alias("low"), F.when(available, F.col("ci.high")).alias("high"),
        outcome.alias("outcome"), F.when(outcome.isNotNull(), "supported").otherwise("inconclusive").alias("state"), F.when(~available, reason).when(outcome.isNull(), "paired_block_ci_includes_zero").alias("reason"),
    )


def decision(conditions: DataFrame, keys: list[str]) -> DataFrame:
    """One decision over compared conditions: supported only if all are, and all the same way."""
    kinds = F.array_sort(F.collect_set("outcome"))
    out = conditions.groupBy(*keys).agg(F.min(F.col("state") == "supported").alias("_all"), kinds.alias("_kinds"))
    ok = F.col("_all") & (F.size("_kinds") == 1)
    return out.select(*keys, F.when(ok, "supported").otherwise("inconclusive").alias("decision_state"), F.when(ok, F.col("_kinds")[0]).alias("overall_outcome"))


def phase_contrasts(rates: DataFrame, keys: list[str], position: str = "position", value: str = "rate") -> DataFrame:
    """Order-balanced contrasts of six positions and their interval: C1 against the mean of B1 and B2, the mean of C2 and C3 against B3."""
    wide = rates.groupBy(*keys).pivot(position, list(POSITIONS)).agg(F.avg(value))
    first = stats.relative_delta_percent(F.col("C1"), (F.col("B1") + F.col("B2")) / 2)
    second = stats.relative_delta_percent((F.col("C2") + F.col("C3")) / 2, F.col("B3"))
    long = wide.select(*keys, *POSITIONS, first.alias("contrast_1"), second.alias("contrast_2"))
    out = long.select("*", F.explode(F.array("contrast_1", "contrast_2")).alias("_c")).groupBy(*keys, *POSITIONS, "contrast_1", "contrast_2").agg(stats.t_interval("_c").alias("ci"))
    return out.select(*keys, *POSITIONS, "contrast_1", "contrast_2", F.col("ci.mean").alias("estimate"), F.col("ci.low").alias("low"), F.col("ci.high").alias("high"))


# What all six runs of a protocol must share, by manifest path, and what a current manifest adds.
CONTROLLED = (
    "manifest_version", "tool", "model_id", "model_immutable_revision", "runtime_image_digest", "runtime_gpu", "runtime_gpu_fingerprint_sha256", "runtime_gpu_fingerprint_supplied", "runtime_cuda_version", "runtime_driver_version",
    "engine_backend", "engine_backend_version", "engine_http_client_version", "engine_server_version", "workload_seed", "workload_measured_sha256", "workload_warmup_sha256", "workload_cache_policy", "request", "traffic_conditions", "traffic_blocks",
    "traffic_requests_per_block", "traffic_block_duration_seconds", "traffic_warmup_requests_per_condition", "traffic_p95_slo_ms", "traffic_ttft_slo_ms", "metric_definitions", "safety", "cost",
)
CONTROLLED_NOW = (
    "runtime_accelerator_backend", "runtime_accelerator", "runtime_accelerator_fingerprint_sha256", "runtime_accelerator_fingerprint_supplied", "runtime_accelerator_runtime_version", "runtime_host_os_version", "runtime_software_environment_digest",
)
MANIFEST_NOW, MOST_SEQS = "1.1", 2_147_483_647
#: Columns of a run that ``protocol_reasons`` reads, beside its keys.
PROTOCOL_RUN = (
    "position_no int, position string, variant string, started_at double, completed_at double, preflight string, controlled map<string,string>, flags_provenance string, evidence_source string, stream boolean, warmup_requests int, "
    "warmup_separate boolean, warmup_disjoint boolean, flags map<string,string>, requests_per_block int, conditions array<struct<id:string,kind:string,value:int,max_in_flight:int,peak:int,attempted:array<int>>>"
)


def _one_load(conditions: Column) -> Column:
    """The concurrency that a run's only condition declares; null unless it is closed-loop and canonical."""
    c = F.try_element_at(conditions, F.lit(1))
    sound = (F.size(conditions) == 1) & c["value"].between(1, MOST_SEQS) & (c["max_in_flight"] == c["value"]) & (c["kind"] == "closed_loop") & (c["id"] == F.concat(F.lit("closed_loop:"), c["value"].cast("string")))
    return F.when(sound, c["value"])


def protocol_reasons(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted codes against each six-run sequence of ``runs`` (columns PROTOCOL_RUN); none says that the sequence follows the protocol.

    One sort by sequence and position, then one aggregation in that order: what the manifests must share is compared with the run
    before, other shared values by their least and greatest, what the first run declares is taken by position. Only what is compared
    is sorted, not the maps and conditions it is read from, and runs that already lie by ``keys`` are not shuffled. As in the protocol,
    a wrong number of runs, then a run's own fault, then colliding flag names stand alone. Null flags or conditions are malformed.
    """
    no, six, fixed = F.col("position_no"), len(POSITIONS), (*CONTROLLED, *CONTROLLED_NOW)
    names = F.when(F.col("flags").isNotNull(), F.map_from_entries(F.array_sort(F.map_entries(F.transform_keys("flags", lambda k, _: text.flag_name(k))))))
    collide = F.coalesce(text.has_alias_collision(F.map_keys("flags")), F.lit(False))
    seen = runs.withColumn("_collide", collide).withColumn("_flags", F.when(~F.col("_collide"), names)).withColumn("_flag_text", F.to_json("_flags"))
    base = (no % 2) == 1
    label = F.element_at(F.array(*[F.lit(p) for p in POSITIONS]), F.least(no, F.lit(six)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    first = lambda c: F.when(no == 1, c)
    declared = (("manifest_version", "version"), ("model_immutable_revision", "revision"), ("engine_server_version", "server"), ("engine_backend", "backend"), ("workload_cache_policy", "policy"))
    all_true = {
        "variants": F.col("variant") == F.when(base, "baseline").otherwise("candidate"), "labels": F.col("position") == label, "verified": F.col("flags_provenance") == "runtime_verified", "live": F.col("evidence_source") == "live_inference",
        "separate": F.col("warmup_separate"), "disjoint": F.col("warmup_disjoint"), "mapped": F.col("conditions").isNotNull(), "flagged": F.col("_flags").isNotNull(),
    }
    greatest = {
        "collide": F.col("_collide"), "blank": F.col("started_at").isNull() | F.col("completed_at").isNull(), "back": F.col("started_at") > F.col("completed_at"), "stream": first(F.col("stream")), "warmups": first(F.col("warmup_requests")), "per_block": first(F.col("requests_per_block")),
        **{a: first(F.try_element_at("controlled", F.lit(p))) for p, a in declared},
    }
    least = F.when(F.forall("conditions", lambda c: (F.size(c["attempted"]) > 0) & F.forall(c["attempted"], lambda n: n.isNotNull())), F.array_min(F.flatten(F.transform("conditions", lambda c: c["attempted"]))))
    seen = seen.select(
        *keys, "position_no", "started_at", "completed_at", F.when(no <= six, F.concat(F.lit("run_"), no.cast("string"), F.lit("_"), "preflight")).alias("_pre"), *[yes(c).alias(f"_{a}") for a, c in all_true.items()], *[c.alias(f"_{a}") for a, c in greatest.items()],
        F.array(*[F.try_element_at("controlled", F.lit(p)) for p in fixed]).alias("_fixed"), _one_load(F.col("conditions")).alias("_load"), F.to_json(F.array_sort(F.array_distinct(F.transform("conditions", lambda c: c["id"])))).alias("_ids"),
        F.array_max(F.transform("conditions", lambda c: c["peak"])).alias("_peak"), least.alias("_least"), F.try_element_at("_flags", F.lit("enable-chunked-prefill")).alias("_chunked"),
        *[F.when(side, F.col("_flag_text")).alias(f"_text_{a}") for side, a in ((base, "b"), (~base, "c"))], *[F.when(no == at, F.col("_flags")).alias(f"_{a}") for at, a in ((1, "b"), (2, "c"))],
    )
    w = Window.partitionBy(*keys).orderBy("position_no")
    early = F.coalesce(F.col("started_at") < F.lag("completed_at").over(w), F.lit(False))
    seen = seen.withColumns({"_early": early, "_before": F.lag("_fixed").over(w), "_pres": F.collect_set("_pre").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    # One bit for each place of ``fixed`` that is null or not the value of the run before.
    now, before = (lambda i: F.col("_fixed")[i]), (lambda i: F.col("_before")[i])
    bits = [F.when(now(i).isNull() | (F.col("_before").isNotNull() & ~now(i).eqNullSafe(before(i))), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(len(fixed))]
    seen = seen.withColumn("_moved", F.when(F.col("_fixed") == F.col("_before"), F.lit(0).cast("long")).otherwise(reduce(Column.bitwiseOR, bits)))
    same = lambda c: (F.count(c) == six) & (F.min(c) == F.max(c))
    # No aggregate here collects: the extremes of strings are taken in the order of the sort, so nothing is sorted or held again.
    got = seen.groupBy(*keys).agg(
        F.count("*").alias("n"), F.array_sort(F.first("_pres")).alias("pre"), *[F.min(f"_{a}").alias(a) for a in all_true], *[F.max(f"_{a}").alias(a) for a in (*greatest, "early")],
        F.bit_or("_moved").alias("moved"), same("_ids").alias("sets"), F.when(same("_load"), F.max("_load")).alias("load"), *[(F.min(f"_text_{a}") == F.max(f"_text_{a}")).alias(f"same_{a}") for a in "bc"],
        *[F.first(f"_{a}", ignorenulls=True).alias(a) for a in "bc"], ((F.count("_chunked") == 0) | same("_chunked")).alias("chunked"), F.min("_peak").alias("peak"), F.count("_peak").alias("peaks"), F.min("_least").alias("least"), F.count("_least").alias("leasts"),
    )
    changed = F.array_sort(F.filter(F.array_union(F.map_keys("b"), F.map_keys("c")), lambda k: ~F.try_element_at(F.col("b"), k).eqNullSafe(F.try_element_at(F.col("c"), k))))
    limit_b, limit_c = (text.canonical_positive_int(F.try_element_at(F.col(x), F.lit("max-num-seqs"))) for x in "bc")
    limits = limit_b.isNotNull() & limit_c.isNotNull()
    load, no_ = F.col("load"), lambda c: ~F.coalesce(c, F.lit(False))
    moved = lambda p: F.getbit("moved", F.lit(fixed.index(p))) == 1
    tests = [
        (no_(F.col("variants")), "sequence_must_be_baseline_candidate_baseline_then_candidate_baseline_candidate"), (no_(F.col("labels")), "sequence_position_labels_must_be_B1_C1_B2_C2_B3_C3"), (F.col("blank"), "missing_or_invalid_run_timestamps"),
        (~F.col("blank") & F.col("back"), "run_starts_after_its_completion"), (~F.col("blank") & F.col("early"), "runs_overlap_or_are_out_of_order"),
        *[(moved(p), f"uncontrolled_or_missing_{p}") for p in CONTROLLED], *[(moved(p) & (F.col("version") == MANIFEST_NOW), f"uncontrolled_or_missing_{p}") for p in CONTROLLED_NOW],
        (~text.immutable_revision(F.col("revision")), "model_revision_is_not_immutable"), (no_(F.col("server") != "unknown"), "server_version_missing"), (no_(F.col("backend") == "native"), "golden_protocol_requires_strict_native_completion_validation"),
        (~F.col("verified"), "effective_engine_flags_not_runtime_verified"), (~F.col("live"), "all_six_runs_must_be_live_inference"), (F.col("policy") == "unknown", "cache_policy_must_be_explicit"), (no_(F.col("stream")), "golden_protocol_requires_streaming"),
        (no_(F.col("warmups") > 0), "golden_protocol_requires_separate_warmup_requests"), (~F.col("separate"), "warmup_workload_not_proven_separate"), (~F.col("disjoint"), "warmup_prompts_not_disjoint_from_measured_workload"),
        (~F.col("mapped"), "condition_maps_malformed"), (F.col("mapped") & no_(F.col("sets")), "condition_sets_do_not_match"), (F.col("mapped") & F.col("sets") & load.isNull(), "golden_treatment_requires_one_common_closed_loop_concurrency"), (~F.col("flagged"), "engine_flags_malformed"),
    ]
    flagged = [
        (no_(F.col("same_b")), "baseline_effective_flags_changed_between_repeats"), (no_(F.col("same_c")), "candidate_effective_flags_changed_between_repeats"), (no_(changed == F.array(F.lit("max-num-seqs"))), "golden_treatment_must_only_change_max_num_seqs"),
        (~limits, "golden_treatment_requires_canonical_positive_max_num_seqs_values"), (limits & (limit_b == limit_c), "golden_treatment_requires_distinct_max_num_seqs_values"), (load.isNull(), "golden_treatment_requires_one_common_closed_loop_concurrency"),
        (limits & (F.col("per_block") < load), "golden_requests_per_block_must_reach_declared_concurrency"), (limits & (load < F.greatest(limit_b, limit_c)), "golden_concurrency_must_reach_both_max_num_seqs_values"),
        (limits & load.isNotNull() & no_((F.col("leasts") == six) & (F.col("least") >= load)), "golden_measured_blocks_must_attempt_declared_concurrency"), (limits & load.isNotNull() & no_((F.col("peaks") == six) & (F.col("peak") >= load)), "traffic_does_not_reach_declared_closed_loop_concurrency"),
        (no_(F.col("chunked")), "chunked_prefill_must_not_be_the_treatment"),
    ]
    why = (
        F.when(F.col("n") != six, F.array(F.lit("golden_sequence_requires_exactly_six_runs"))).when(F.size("pre") > 0, F.col("pre")).when(F.col("collide"), F.array(F.lit("engine_flags_malformed")))
        .when(~F.col("flagged"), stats.reasons(*tests)).otherwise(stats.reasons(*tests, *flagged))
    )
    return got.select(*keys, why.alias("reasons"))
