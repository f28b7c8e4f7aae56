"""Plan of the six-run session: one reason for each change of a sound session."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from loadlens.operators import protocol_plan
from loadlens.plans.store_queries import SESSION

G = "golden_"
CHANGES = [
    ({}, []), ({"baseline.name": "max_num_batched_tokens"}, ["treatment_must_only_change_max_num_seqs"]), ({"baseline.name": None}, ["treatment_must_only_change_max_num_seqs"]), ({"baseline.value": "04"}, ["max_num_seqs_values_must_be_canonical_positive_integers"]), ({"candidate.value": "2147483648"}, ["max_num_seqs_values_must_be_canonical_positive_integers"]),
    ({"candidate.value": "4"}, ["max_num_seqs_values_must_be_distinct"]), ({"candidate.value": "9"}, ["concurrency_must_reach_both_max_num_seqs_values"]), ({"backend": "x"}, ["requires_native_backend"]), ({"stream": None}, ["requires_streaming"]), ({"conditions": []}, ["requires_one_closed_loop_concurrency"]), ({"conditions": [{"kind": "open_loop", "value": 8.0, "max_in_flight": 8}]}, ["requires_one_closed_loop_concurrency"]),
    ({"conditions": [{"kind": "closed_loop", "value": 8.0, "max_in_flight": 9}]}, ["requires_one_closed_loop_concurrency"]), ({"blocks": 2, "requests_per_block": 110}, ["requires_at_least_three_blocks"]), ({"requests_per_block": None}, ["orchestrator_requires_count_bounded_blocks", "session_request_count_must_be_exact"]), ({"requests_per_block": 66}, ["requires_at_least_200_measured_requests_per_position"]),
    ({"requests_per_block": 7, "blocks": 29}, ["requests_per_block_must_reach_declared_concurrency"]), ({"warmup_requests": 0}, ["requires_separate_warmup_requests"]), ({"limits.max_errors": 2}, ["requires_zero_error_tolerance"]), ({"evidence_source": "replay"}, ["requires_live_inference_evidence"]), ({"cache_policy": "unknown"}, ["requires_explicit_cache_policy"]), ({"flags_provenance": "operator_attested"}, ["requires_runtime_verified_engine_flags"]),
    ({"variant": "baseline"}, ["assigns_variant_and_sequence_position_automatically"]), ({"model_revision": "main"}, ["requires_immutable_model_revision"]), ({"server_version": "unknown"}, ["requires_server_version"]), ({"runtime.image_digest": "a:1"}, ["runtime_immutable_image_digest_required"]), ({"warmup_separate": False}, ["requires_separate_warmup_workload"]), ({"warmup_disjoint": None}, ["requires_disjoint_warmup_prompts"]),
    ({"limits.max_requests": 1289}, ["session_requests_exceed_max_requests"]), ({"limits.max_requests": 1290}, []), ({"limits.max_total_requested_tokens": 165119}, ["session_tokens_exceed_total_token_limit"]), ({"limits.max_estimated_spend": 0.5}, ["session_estimated_cost_exceeds_spend_limit"]), ({"cost.kind": "unknown"}, ["requires_unknown_cost_acknowledgement"]), ({"cost.kind": "unknown", "unknown_cost_allowed": True}, []),
    ({"cost": {"currency": "USD", "kind": "user_supplied", "user_supplied_total": 1.0}}, ["user_supplied_run_total_is_ambiguous_across_six_positions"]), ({"cost": {"currency": "USD", "kind": "serverless_active_seconds", "active_second_rate": 0.001, "max_active_workers": 2, "billed_active_seconds": 5.0}}, ["serverless_billed_active_seconds_must_be_added_after_the_session"]),
]


def changed(change):
    session = copy.deepcopy(SESSION)
    for path, value in change.items():
        *above, last = path.split(".")
        at = session
        for k in above:
            at = at[k]
        at[last] = value
    return json.dumps(session)


@pytest.fixture(scope="module")
def planned(spark):
    bodies = [changed(c) for c, _ in CHANGES] + [changed({"flags": {"Max_Num_Seqs": "9"}}), "{}"]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string").select("id", F.from_json("body", protocol_plan.SESSION).alias("session"))
    return {r["id"]: r for r in protocol_plan.plan(df).collect()}


def test_each_change_has_its_reasons(planned):
    assert {i: planned[i]["reasons"] for i in range(len(CHANGES))} == {i: [G + x for x in why] for i, (_, why) in enumerate(CHANGES)}
    assert planned[len(CHANGES)]["reasons"] == ["max_num_seqs_must_use_baseline_and_candidate_config_flags"]
    assert len(planned[len(CHANGES) + 1]["reasons"]) > 12 and planned[len(CHANGES) + 1]["positions"] is None


def test_positions_and_totals(planned):
    sound = planned[0]
    assert [tuple(p) for p in sound["positions"]] == [("B1", "baseline", 4), ("C1", "candidate", 8), ("B2", "baseline", 4), ("C2", "candidate", 8), ("B3", "baseline", 4), ("C3", "candidate", 8)]
    assert (sound["per_position_requests"], sound["session_requests"], sound["session_requested_output_tokens"]) == (215, 1290, 165120) and sound["session_cost_upper_bound"] == pytest.approx(0.6)
