"""The evidence ledger: one fault for each kind of cell, and gates just met and just missed."""

import pytest

from loadlens.operators import pilot

COLUMNS = [c.split("`")[1] for c in pilot.LEDGER.split(", ")]
SOUND = {
    "pilot_id": "p1", "org_id": "o1", "segment_code": "online_serving", "decision_kind": "max_num_seqs", "qualified": "true", "real_traffic_started": "true", "benchmark_valid": "true", "minutes_to_valid": "12.5", "session_started_at": "2026-01-01T09:00:00Z", "session_completed_at": "2026-01-01T11:00:00+01:00",
    "verified_decision_code": "deployed", "verified_decision_at": "2026-01-03T00:00:00Z", "unprompted_return_at": "2026-01-10T00:00:00Z", "unprompted_return_for_real_decision": "true", "introduction_kind": "unsolicited_peer", "introduced_operator_qualified": "true", "paid_invoice": "true", "paid_invoice_at": "2026-01-05", "amount_collected_usd": "10", "decision_state": "inconclusive",
}


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], pilot.LEDGER)


@pytest.fixture(scope="module")
def faults(spark):
    changes = [
        ({}, []), ({"segment_code": "x"}, ["unknown_segment_code"]), ({"segment_code": " "}, []), ({"qualified": "yes"}, ["invalid_qualified"]), ({"qualified": "TRUE"}, []), ({"minutes_to_valid": "-1"}, ["invalid_minutes_to_valid"]), ({"minutes_to_valid": "Infinity"}, ["invalid_minutes_to_valid"]), ({"decision_deadline": "tomorrow"}, ["invalid_decision_deadline"]),
        ({"decision_deadline": "2026-13-01"}, ["invalid_decision_deadline"]), ({"org_id": "https://x"}, ["unsafe_org_id"]), ({"org_id": "a b"}, ["unsafe_org_id"]), ({"decision_state": "Maybe!"}, ["unknown_decision_state"]), ({"session_completed_at": "2026-01-01T08:00:00Z"}, ["session_completed_at_before_session_started_at"]), ({"paid_invoice_at": None}, ["paid_invoice_without_moment"]), ({"paid_invoice": "false"}, ["paid_invoice_without_moment"]),
        ({"verified_decision_at": None, "unprompted_return_at": None}, ["verified_decision_without_moment"]), ({"verified_decision_code": "none"}, ["verified_decision_without_moment"]), ({"verified_decision_code": "yes", "source_channel": "y"}, ["unknown_source_channel", "unknown_verified_decision_code", "verified_decision_without_moment"]), (dict.fromkeys(COLUMNS), []),
    ]
    got = pilot.ledger_faults(frame(spark, [{**SOUND, **c, "evidence_packet_id": f"n{i}"} for i, (c, _) in enumerate(changes)])).collect()
    return {r["evidence_packet_id"]: r["faults"] for r in got}, {f"n{i}": f for i, (_, f) in enumerate(changes)}


def test_each_cell_has_its_fault(faults):
    got, want = faults
    assert got == want


def five(**more):
    return [{**SOUND, "pilot_id": f"p{i}", "org_id": f"o{i}", **more} for i in range(5)]


@pytest.mark.parametrize(
    "rows, passed",
    [
        (five(), {"activation", "decision_value", "payment", "pull"}), (five()[:4], {"payment"}), (five(minutes_to_valid="30"), {"decision_value", "payment", "pull"}), (five(paid_invoice="false", paid_invoice_at=None), {"activation", "decision_value", "pull"}), (five(amount_collected_usd="0"), {"activation", "decision_value", "pull"}),
        (five(unprompted_return_at="2026-01-20T00:00:00Z", introduction_kind="solicited"), {"activation", "payment"}), (five(unprompted_return_at="2026-03-20T00:00:00Z"), {"activation", "decision_value", "payment"}), (five(org_id="o"), {"activation", "decision_value"}), (five(qualified=None), {"payment"}), (five(verified_decision_code="none"), {"activation"}),
    ],
)
def test_gates(spark, rows, passed):
    got = pilot.gates(frame(spark, rows), ["segment_code"]).first()
    assert {g for g in ("activation", "decision_value", "payment", "pull") if got[g]} == passed


def test_one_account_that_renews_and_one_that_buys(spark):
    rows = five(paid_invoice="false", paid_invoice_at=None)
    rows[0] |= {"paid_invoice": "true", "paid_invoice_at": "2026-01-05", "paid_renewal": "true"}
    assert not pilot.gates(frame(spark, rows), ["segment_code"]).first()["payment"]
    rows[1] |= {"procurement_owner_confirmed": "true", "procurement_started_at": "2026-01-06"}
    assert pilot.gates(frame(spark, rows), ["segment_code"]).first()["payment"]


def test_empty_ledger(spark):
    assert pilot.gates(pilot.ledger_faults(frame(spark, [])), ["segment_code"]).count() == 0
