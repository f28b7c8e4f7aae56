"""The evidence ledger of pilots: codes of its rows, and the gates that its facts pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadlens.functions import stats, text

# Columns of the ledger by kind, and the codes that its coded columns may hold.
IDS = ("pilot_id", "org_id", "decision_proof_id", "offer_id", "evidence_packet_id")
TIMES = (
    "decision_deadline", "session_started_at", "session_completed_at", "verified_decision_at", "rerun_requested_at", "next_relevant_decision_at", "unprompted_return_at", "introduction_at", "standard_offer_sent_at", "paid_invoice_at", "procurement_started_at", "procurement_target_date", "paid_renewal_at", "retention_delete_on",
)
FLAGS = (
    "qualified", "staging_confirmed", "known_slo", "run_card_approved", "plan_approved", "real_traffic_started", "smoke_valid", "benchmark_valid", "decision_eligible", "unprompted_return_for_real_decision", "introduced_operator_qualified", "paid_invoice", "procurement_owner_confirmed", "paid_renewal", "teardown_confirmed",
)
NUMBERS = ("minutes_to_valid", "founder_support_minutes", "standard_price_usd", "amount_collected_usd")
CODES = {
    "segment_code": ("online_serving", "async_batch", "hobby_ux"), "source_channel": ("vllm_forum", "reddit", "referral", "owner_authorized_direct"), "decision_kind": ("max_num_seqs", "other_supported_engine_flag"),
    "same_day_action_code": ("none", "deploy_planned", "reject_planned", "defer_planned", "rerun_requested", "internal_share"), "verified_decision_code": ("none", "deployed", "rejected", "deferred"), "introduction_kind": ("none", "unsolicited_peer", "unsolicited_internal", "solicited"),
}
#: What a flag or a code needs beside it: without the fact on the left the column on the right has to be empty, with it filled.
PAIRS = (("paid_invoice", "paid_invoice_at"), ("paid_renewal", "paid_renewal_at"))
#: Moments that must not come before others.
ORDER = (("session_started_at", "session_completed_at"), ("session_completed_at", "verified_decision_at"), ("verified_decision_at", "unprompted_return_at"), ("standard_offer_sent_at", "paid_invoice_at"), ("paid_invoice_at", "paid_renewal_at"))
LEDGER = ", ".join(f"`{c}` string" for c in (*IDS, *TIMES, *FLAGS, *NUMBERS, *CODES, "decision_state", "incident_or_blocker_code"))


def read_ledger(spark: SparkSession, path: str, more: str = "") -> DataFrame:
    """The ledger's CSV with its header, all cells as texts, so that what is in them can be judged. ``more``: columns before them. A header of other names fails."""
    return spark.read.csv(path, header=True, schema=f"{more}, {LEDGER}" if more else LEDGER, enforceSchema=False)


def _time(name: str) -> Column:
    """A moment with its offset, or a date at its start; null for anything else."""
    v = F.col(name)
    return F.coalesce(text.offset_timestamp(v), F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(v, F.lit("T00:00:00Z")))))


def _flag(name: str) -> Column:
    return F.coalesce(F.lower(name) == "true", F.lit(False))


def ledger_faults(ledger: DataFrame) -> DataFrame:
    """``ledger`` (texts of LEDGER) with faults: sorted codes of a row's cells that are no code, moment, flag or number, of identities that could name someone, and of moments out of order.

    Empty cells are no fault. Nulls count as empty, repeated rows are judged each, other columns are carried.
    """
    given = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    tests = [(given(c) & ~F.col(c).isin(*codes), f"unknown_{c}") for c, codes in CODES.items()]
    tests += [(given(c) & _time(c).isNull(), f"invalid_{c}") for c in TIMES]
    tests += [(given(c) & ~F.lower(c).isin("true", "false"), f"invalid_{c}") for c in FLAGS]
    tests += [(given(c) & ~F.coalesce((F.col(c).try_cast("double") >= 0) & (F.col(c).try_cast("double") < float("inf")), F.lit(False)), f"invalid_{c}") for c in NUMBERS]
    tests += [(given(c) & ~F.col(c).rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"), f"unsafe_{c}") for c in IDS]
    tests += [(given(c) & ~F.col(c).rlike(r"^[a-z0-9_]{1,64}$"), f"unknown_{c}") for c in ("decision_state", "incident_or_blocker_code")]
    tests += [(F.coalesce(_time(b) < _time(a), F.lit(False)), f"{b}_before_{a}") for a, b in ORDER]
    tests += [(_flag(fact) != given(at), f"{fact}_without_moment") for fact, at in PAIRS]
    decided = F.coalesce(F.col("verified_decision_code").isin("deployed", "rejected", "deferred"), F.lit(False))
    return ledger.withColumn("faults", stats.reasons(*tests, (decided != given("verified_decision_at"), "verified_decision_without_moment")))


def gates(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each of ``keys``: the facts of a group of pilots and whether it passes the gates of activation, decision value, payment and pull.

    Rows with faults should be left out first. The first five qualified completions of a group are its earliest (ties by pilot_id).
    """
    days = lambda a, b, n: F.coalesce((_time(b) >= _time(a)) & (F.unix_micros(_time(b)) - F.unix_micros(_time(a)) <= n * 86_400_000_000), F.lit(False))
    decided = F.coalesce(F.col("verified_decision_code").isin("deployed", "rejected", "deferred"), F.lit(False))
    returned = lambda n: _flag("unprompted_return_for_real_decision") & days("verified_decision_at", "unprompted_return_at", n)
    introduced = F.coalesce(F.col("introduction_kind").isin("unsolicited_peer", "unsolicited_internal"), F.lit(False)) & _flag("introduced_operator_qualified")
    valid = _flag("qualified") & _flag("benchmark_valid")
    paid = _flag("paid_invoice") & F.coalesce(F.col("amount_collected_usd").try_cast("double") > 0, F.lit(False))
    renewed, buying = paid & _flag("paid_renewal"), ~paid & _flag("procurement_owner_confirmed") & _time("procurement_started_at").isNotNull()
    orgs = lambda c: F.count_distinct(F.when(c, F.col("org_id")))
    facts = ledger.groupBy(*keys).agg(
        F.count_if(_flag("qualified") & _flag("real_traffic_started")).alias("started"), F.count_if(valid).alias("completed"), F.percentile(F.when(valid, F.col("minutes_to_valid").try_cast("double")), 0.5).alias("median_minutes"), F.count_if(_flag("qualified")).alias("invited"), orgs(decided).alias("decided_orgs"),
        orgs(paid).alias("paid_orgs"), orgs(renewed).alias("renewed_orgs"), orgs(buying).alias("buying_orgs"), orgs(valid).alias("valid_orgs"), F.count_if(returned(30)).alias("returns"), F.count_if(introduced).alias("introductions"),
    )
    first = Window.partitionBy(*keys).orderBy(_time("session_completed_at"), "pilot_id")
    five = ledger.where(valid & _time("session_completed_at").isNotNull()).withColumn("_n", F.row_number().over(first)).where("_n <= 5")
    value = five.groupBy(*keys).agg(F.count("*").alias("_five"), F.count_if(decided).alias("_decided"), F.count_if(decided & (returned(14) | introduced)).alias("_pull"))
    pattern = ledger.where(decided & F.col("decision_kind").isNotNull()).groupBy(*keys, "decision_kind").agg(F.count_distinct("org_id").alias("_orgs")).groupBy(*keys).agg(F.max("_orgs").alias("pattern_orgs"))
    all_ = facts.join(value, keys, "left").join(pattern, keys, "left").fillna(0, ["_five", "_decided", "_pull", "pattern_orgs"])
    c = F.col
    return all_.select(
        *keys, "started", "completed", "median_minutes", "decided_orgs", "paid_orgs", "returns", "introductions", "pattern_orgs", ((c("started") >= 5) & (c("completed") >= 3) & F.coalesce(c("median_minutes") < 30, F.lit(False))).alias("activation"),
        ((c("_five") == 5) & (c("_decided") >= 2) & (c("_pull") >= 1)).alias("decision_value"), ((c("decided_orgs") >= 3) & ((c("paid_orgs") >= 2) | ((c("renewed_orgs") >= 1) & (c("buying_orgs") >= 1)))).alias("payment"),
        ((c("valid_orgs") >= 5) & (c("returns") >= 3) & (c("introductions") >= 2) & (c("pattern_orgs") >= 3)).alias("pull"),
    )
