"""Validation of run configurations before any traffic: the code of the first fault of each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loadlens.functions import text

#: Fields of a configuration.
CONFIG = (
    "struct<mode:string,backend:string,stream:boolean,gaps_acknowledged:boolean,model:string,url:string,api_key:string,max_tokens:int,conditions:array<struct<kind:string,value:double,max_in_flight:int>>,blocks:int,requests_per_block:int,"
    "block_duration_seconds:double,warmup_requests:int,timeout_seconds:double,p95_slo_ms:double,ttft_slo_ms:double,seed:bigint,cache_policy:string,evidence_source:string,flags_provenance:string,"
    "limits:struct<max_requests:bigint,max_tokens_per_request:int,max_total_requested_tokens:bigint,max_concurrency:int,max_estimated_spend:double>,cost_upper_bound:double,unknown_cost_allowed:boolean>"
)
# What fields may say.
MODES, BACKENDS, KINDS = ("smoke", "benchmark"), ("native", "guidellm"), ("closed_loop", "open_loop")
CACHE_POLICIES = ("unknown", "disabled", "cold", "warm", "representative")
EVIDENCE, PROVENANCE = ("unverified_endpoint", "live_inference", "synthetic_validation"), ("operator_attested", "runtime_verified")
LEAST_BLOCKS = 3


def _no(c: Column) -> Column:
    """A test that does not hold, or whose value is missing."""
    return ~F.coalesce(c, F.lit(False))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _load_fault(conditions: Column, most: Column) -> Column:
    """First fault of the conditions, in their order; a value that occurred before counts at its second place."""
    whole = lambda c: c["value"] == F.floor(c["value"])
    closed = lambda c: c["kind"] == "closed_loop"
    before = lambda i: F.slice(conditions, 1, i)

    def fault(c, i):
        return (
            F.when(_no(c["kind"].isin(*KINDS)), "load_kind").when(_no(_finite(c["value"]) & (c["value"] > 0)), "load_value")
            .when(_no(c["max_in_flight"] > 0), "load_in_flight").when(c["max_in_flight"] > most, "load_in_flight_over_limit")
            .when(closed(c) & ~whole(c), "load_value_not_whole").when(closed(c) & (c["value"] > most), "load_value_over_limit")
            .when(closed(c) & (c["max_in_flight"] != c["value"]), "load_in_flight_not_value")
            .when(F.exists(before(i), lambda b: (b["kind"] == c["kind"]) & (b["value"] == c["value"])), "load_value_repeated")
        )

    return F.try_element_at(F.filter(F.transform(conditions, fault), lambda x: x.isNotNull()), F.lit(1))


def planned_requests(c: Column) -> Column:
    """Requests of a run bounded by requests; null where time bounds its blocks."""
    return (F.size(c["conditions"]) * (c["blocks"] * c["requests_per_block"] + c["warmup_requests"])).cast("long")


def first_fault(c: Column, traffic: bool = True) -> Column:
    """The code of the first fault of a configuration (CONFIG), null if it is sound. Without ``traffic`` what only a live run needs is not asked."""
    live, positive = F.lit(traffic), lambda x: _finite(x) & (x > 0)
    limits, planned = c["limits"], planned_requests(c)
    return (
        F.when(_no(c["mode"].isin(*MODES)), "config_mode").when(_no(c["backend"].isin(*BACKENDS)), "config_backend").when(c["stream"].isNull(), "config_stream")
        .when(live & (c["backend"] == "guidellm") & _no(c["gaps_acknowledged"]), "config_gaps_not_acknowledged")
        .when(_no(F.trim(c["model"]) != ""), "config_model").when(text.chat_url(c["url"]).isNull(), "config_address").when(live & _no(c["api_key"] != ""), "config_key")
        .when(_no(c["max_tokens"] > 0), "config_max_tokens").when(c["max_tokens"] > limits["max_tokens_per_request"], "config_max_tokens_over_limit")
        .when(_no(F.size(c["conditions"]) > 0), "config_no_conditions").when(_load_fault(c["conditions"], limits["max_concurrency"]).isNotNull(), _load_fault(c["conditions"], limits["max_concurrency"]))
        .when(F.size(F.array_distinct(F.transform(c["conditions"], lambda x: x["kind"]))) != 1, "config_mixed_loops").when(_no(c["blocks"] > 0), "config_blocks")
        .when((c["mode"] == "smoke") & (c["blocks"] != 1), "config_smoke_blocks").when((c["mode"] == "benchmark") & (c["blocks"] < LEAST_BLOCKS), "config_benchmark_blocks")
        .when(c["requests_per_block"].isNull() & c["block_duration_seconds"].isNull(), "config_no_block_bound").when(c["requests_per_block"].isNotNull() & c["block_duration_seconds"].isNotNull(), "config_two_block_bounds")
        .when(c["requests_per_block"] <= 0, "config_requests_per_block").when(c["block_duration_seconds"].isNotNull() & _no(positive(c["block_duration_seconds"])), "config_block_duration")
        .when(_no(c["warmup_requests"] >= 0), "config_warmups").when(_no(positive(c["timeout_seconds"])), "config_timeout")
        .when(c["p95_slo_ms"].isNotNull() & _no(positive(c["p95_slo_ms"])), "config_p95_slo").when(c["ttft_slo_ms"].isNotNull() & _no(positive(c["ttft_slo_ms"])), "config_ttft_slo")
        .when(c["seed"].isNull(), "config_seed").when(_no(c["cache_policy"].isin(*CACHE_POLICIES)), "config_cache_policy").when(_no(c["evidence_source"].isin(*EVIDENCE)), "config_evidence_source")
        .when(_no(c["flags_provenance"].isin(*PROVENANCE)), "config_flags_provenance").when(live & (planned > limits["max_requests"]), "config_requests_over_limit")
        .when(live & (planned * c["max_tokens"] > limits["max_total_requested_tokens"]), "config_tokens_over_limit")
        .when(live & c["cost_upper_bound"].isNull() & _no(c["unknown_cost_allowed"]), "config_unknown_cost_not_allowed")
        .when(live & (c["cost_upper_bound"] > limits["max_estimated_spend"]), "config_cost_over_limit")
    )


#: Fields of a billing model and of safety limits.
COST = "struct<currency:string,kind:string,total_hourly_rate:double,active_second_rate:double,max_active_workers:bigint,billed_active_seconds:double,user_supplied_total:double,gpu_count:bigint>"
LIMITS = "struct<max_requests:bigint,max_tokens_per_request:bigint,max_total_requested_tokens:bigint,max_concurrency:bigint,max_response_bytes:bigint,max_errors:bigint,max_elapsed_seconds:double,max_estimated_spend:double>"
#: What each billing model needs; everything else of a cost has to be absent.
BILLING = {"unknown": (), "dedicated_hourly": ("total_hourly_rate", "gpu_count"), "serverless_active_seconds": ("active_second_rate", "max_active_workers"), "user_supplied": ("user_supplied_total",)}
_PRICES = ("total_hourly_rate", "active_second_rate", "max_active_workers", "billed_active_seconds", "user_supplied_total", "gpu_count")


def cost_fault(c: Column) -> Column:
    """The code of the first fault of a billing model (COST): currency, kind, what the kind needs, and what belongs to another kind. Null if it is sound."""
    code = F.when(_no(c["currency"] == "USD"), "cost_currency").when(_no(c["kind"].isin(*BILLING)), "cost_kind")
    for kind, needed in BILLING.items():
        mine = c["kind"] == kind
        for name in needed:
            code = code.when(mine & _no(_finite(c[name].cast("double")) & (c[name] > 0)), f"cost_{name}")
        if kind == "serverless_active_seconds":  # billed seconds may be known, from zero on
            code = code.when(mine & c["billed_active_seconds"].isNotNull() & _no(_finite(c["billed_active_seconds"]) & (c["billed_active_seconds"] >= 0)), "cost_billed_active_seconds")
        other = F.lit(False)
        for name in _PRICES:
            if name not in needed and not (kind == "serverless_active_seconds" and name == "billed_active_seconds"):
                other = other | c[name].isNotNull()
        code = code.when(mine & other, "cost_of_another_model")
    return code


def limits_fault(c: Column) -> Column:
    """The code of the first limit (LIMITS) that is not positive and finite, in their order. Null if all are."""
    code = None
    for field in LIMITS.removeprefix("struct<").removesuffix(">").split(","):
        name = field.split(":")[0]
        bad = _no(_finite(c[name].cast("double")) & (c[name] > 0))
        code = F.when(bad, f"limit_{name}") if code is None else code.when(bad, f"limit_{name}")
    return code
