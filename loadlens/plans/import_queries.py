"""Queries of imported aggregate reports, of configurations, and of first outputs, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loadlens.operators import config, imported, runs
from loadlens.plans.queries import query, r6
from loadlens.plans.more_queries import code_list
from loadlens.plans.views import RL, SPAN, ci, request_log, table
from loadlens.sources import imported_reports as source

_BLOCKS = f"""WITH {RL}, i AS (SELECT position_idx, concurrency, block_index, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok AND position_idx = 3) AS errored, count(*) FILTER (NOT ok AND position_idx = 4 AND concurrency = 8) AS incomplete,
  {SPAN} AS duration_seconds, coalesce(sum(completion_tokens) FILTER (ok), 0)::BIGINT AS output_tokens FROM g GROUP BY ALL),
b AS (SELECT *, successful + errored + incomplete AS total, errored + incomplete AS invalid FROM i), vb AS (SELECT *, invalid = 0 AND total > 0 AND total >= 5 AS valid FROM b)"""
_TESTED = f"""{_BLOCKS}, c AS (SELECT position_idx, concurrency, count(*) = 3 AND bool_and(valid) AS valid, count(*) AS blocks, sum(total)::BIGINT AS attempted, sum(invalid)::BIGINT AS invalid, sum(output_tokens) / sum(duration_seconds) AS pooled,
  avg(output_tokens / duration_seconds) AS mean, {ci("(output_tokens / duration_seconds)", "low")} AS low FROM vb GROUP BY ALL)"""


def _blocks(spark, d):
    ok, no = runs.valid(), F.col("position_idx")
    got = request_log(spark, d).groupBy("position_idx", "concurrency", "block_index").agg(
        F.count_if(ok).alias("successful"), F.count_if(~ok & (no == 3)).alias("errored"), F.count_if(~ok & (no == 4) & (F.col("concurrency") == 8)).alias("incomplete"),
        ((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1e6).alias("duration_seconds"), F.coalesce(F.sum(F.when(ok, F.col("completion_tokens"))), F.lit(0)).cast("long").alias("output_tokens"),
    )
    return imported.blocks(got.withColumn("total", F.col("successful") + F.col("errored") + F.col("incomplete")), requests=5)


@query("a11_imported_blocks", f"""{_BLOCKS} SELECT position_idx, concurrency, block_index, total AS attempted, invalid, valid, array_to_string(list_filter([CASE WHEN invalid > 0 THEN 'guidellm_reported_error_or_incomplete_request' END, CASE WHEN total = 0 THEN 'no_requests_measured' END, CASE WHEN total < 5 THEN 'configured_block_floor_not_reached' END], lambda x: x IS NOT NULL), ',') AS reasons FROM vb""")
def a11_blocks(spark, d):
    return _blocks(spark, d).select("position_idx", "concurrency", "block_index", "attempted", "invalid", "valid", F.array_join("invalid_reasons", ",").alias("reasons"))


@query("a11_imported_conditions", f"{_TESTED} SELECT position_idx, concurrency, valid, blocks, attempted, invalid, CASE WHEN valid THEN round(pooled, 9) END AS pooled, CASE WHEN valid THEN round(mean, 9) END AS mean, CASE WHEN valid THEN round(low, 9) END AS low FROM c")
def a11_conditions(spark, d):
    got = imported.conditions(_blocks(spark, d), ["position_idx", "concurrency"], 3)
    return got.select("position_idx", "concurrency", "valid", "blocks", "attempted", "invalid", F.round("output_tokens_per_second", 9).alias("pooled"), F.round("tokens_ci.mean", 9).alias("mean"), F.round("tokens_ci.low", 9).alias("low"))


@query("k02_imported_best", f"""{_TESTED}, r AS (SELECT *, row_number() OVER (PARTITION BY position_idx ORDER BY valid DESC, CASE WHEN valid THEN mean END DESC NULLS LAST, concurrency) AS k, max(concurrency) OVER (PARTITION BY position_idx) AS most FROM c)
SELECT position_idx, valid AND position_idx <> 5 AS available, CASE WHEN valid AND position_idx <> 5 THEN concurrency END AS value, CASE WHEN valid AND position_idx <> 5 THEN concurrency = most END AS boundary_reached, CASE WHEN valid THEN 'inconclusive' ELSE 'invalid' END AS state,
CASE WHEN NOT valid THEN 'no_operationally_complete_conditions' WHEN position_idx = 5 THEN 'guidellm_aggregate_contract_cannot_calculate_slo_goodput' END AS reason FROM r WHERE k = 1""")
def k02(spark, d):
    got = imported.best_tested(imported.conditions(_blocks(spark, d), ["position_idx", "concurrency"], 3), ["position_idx"], "concurrency", slo=F.col("position_idx") == 5)
    return got.select("position_idx", "available", "value", "boundary_reached", "state", "reason")


@query("w03_ttft", "SELECT user_id, round((min(epoch_us(ts)) FILTER (event_type IN ('click', 'purchase')) - min(epoch_us(ts))) / 1e6, 6) AS ttft FROM events GROUP BY user_id")
def w03(spark, d):
    chunks = table(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_type").isin("click", "purchase").alias("output"))
    starts = chunks.groupBy("user_id").agg(F.min("at").alias("started_at"))
    return runs.first_output(chunks, starts, ["user_id"], "at", "output", "started_at").select("user_id", r6("ttft_seconds").alias("ttft"))


_SOUND = {
    "mode": "benchmark", "backend": "native", "stream": True, "gaps_acknowledged": False, "model": "m", "url": "https://h.example/v1", "api_key": "k", "max_tokens": 128, "conditions": [{"kind": "closed_loop", "value": 4.0, "max_in_flight": 4}], "blocks": 3, "requests_per_block": 70, "block_duration_seconds": None,
    "warmup_requests": 5, "timeout_seconds": 30.0, "p95_slo_ms": None, "ttft_slo_ms": 50.0, "seed": 1, "cache_policy": "disabled", "evidence_source": "live_inference", "flags_provenance": "runtime_verified",
    "limits": {"max_requests": 500, "max_tokens_per_request": 256, "max_total_requested_tokens": 100000, "max_concurrency": 8, "max_estimated_spend": 5.0}, "cost_upper_bound": 0.25, "unknown_cost_allowed": False,
}


@query("p06_config", """WITH x AS (SELECT p_partkey AS id, p_size AS size, p_partkey % 9 - 1 AS tokens, p_partkey % 11 AS load, p_partkey % 7 AS flight, p_partkey % 5 AS blocks, p_retailprice / 400 AS cost FROM part)
SELECT id, CASE WHEN tokens * 64 <= 0 THEN 'config_max_tokens' WHEN tokens * 64 > 256 THEN 'config_max_tokens_over_limit' WHEN load / 2 <= 0 THEN 'load_value' WHEN flight <= 0 THEN 'load_in_flight'
WHEN load % 2 = 1 THEN 'load_value_not_whole' WHEN flight <> load / 2 THEN 'load_in_flight_not_value' WHEN blocks = 0 THEN 'config_blocks' WHEN blocks < 3 THEN 'config_benchmark_blocks'
WHEN blocks * size * 3 + 5 > 500 THEN 'config_requests_over_limit' WHEN (blocks * size * 3 + 5) * tokens * 64 > 60000 THEN 'config_tokens_over_limit' WHEN cost > 5 THEN 'config_cost_over_limit' END AS fault FROM x""")
def p06(spark, d):
    k = F.col("p_partkey")
    c = F.from_json(F.lit(json.dumps(_SOUND)), config.CONFIG)
    load = F.array(F.struct(F.lit("closed_loop").alias("kind"), (k % 11 / 2).cast("double").alias("value"), (k % 7).cast("int").alias("max_in_flight")))
    c = c.withField("max_tokens", ((k % 9 - 1) * 64).cast("int")).withField("conditions", load).withField("blocks", (k % 5).cast("int")).withField("requests_per_block", (F.col("p_size") * 3).cast("int"))
    c = c.withField("limits.max_total_requested_tokens", F.lit(60000).cast("long")).withField("cost_upper_bound", (F.col("p_retailprice") / 400).cast("double"))
    return table(spark, d, "part").select(k.alias("id"), config.first_fault(c).alias("fault"))


@query("p06_cost", """WITH x AS (SELECT c_custkey AS id, c_custkey % 5 AS k, CASE WHEN c_custkey % 7 < 5 THEN c_acctbal END AS rate, CASE WHEN c_custkey % 11 < 8 THEN c_nationkey END AS n, CASE WHEN c_custkey % 13 = 0 THEN -1.0 WHEN c_custkey % 13 = 1 THEN 0.0 END AS billed FROM customer)
SELECT id, CASE WHEN id % 17 = 0 THEN 'cost_currency' WHEN k = 4 THEN 'cost_kind' WHEN k = 0 THEN CASE WHEN rate IS NOT NULL OR n IS NOT NULL OR billed IS NOT NULL THEN 'cost_of_another_model' END
 WHEN k = 1 THEN CASE WHEN rate IS NULL OR rate <= 0 THEN 'cost_total_hourly_rate' WHEN n IS NULL OR n <= 0 THEN 'cost_gpu_count' WHEN billed IS NOT NULL THEN 'cost_of_another_model' END
 WHEN k = 2 THEN CASE WHEN rate IS NULL OR rate <= 0 THEN 'cost_active_second_rate' WHEN n IS NULL OR n <= 0 THEN 'cost_max_active_workers' WHEN billed < 0 THEN 'cost_billed_active_seconds' END
 ELSE CASE WHEN rate IS NULL OR rate <= 0 THEN 'cost_user_supplied_total' WHEN n IS NOT NULL OR billed IS NOT NULL THEN 'cost_of_another_model' END END AS fault FROM x""")
def p06_cost(spark, d):
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in (*config.BILLING, "other")]), (k % 5 + 1).cast("int"))
    rate, n = F.when(k % 7 < 5, F.col("c_acctbal").cast("double")), F.when(k % 11 < 8, F.col("c_nationkey").cast("long"))
    at = lambda kinds, v: F.when((k % 5).isin(*kinds), v)
    cost = F.struct(
        F.when(k % 17 == 0, "EUR").otherwise("USD").alias("currency"), kind.alias("kind"), at((0, 1), rate).alias("total_hourly_rate"), at((2,), rate).alias("active_second_rate"), at((2,), n).alias("max_active_workers"),
        F.when(k % 13 == 0, -1.0).when(k % 13 == 1, 0.0).alias("billed_active_seconds"), at((3,), rate).alias("user_supplied_total"), at((0, 1, 3), n).alias("gpu_count"),
    )
    return table(spark, d, "customer").select(k.alias("id"), config.cost_fault(cost).alias("fault"))


@query("p06_limits", """SELECT o_orderkey AS id, CASE WHEN o_custkey % 50 = 0 THEN 'limit_max_requests' WHEN o_orderkey % 19 = 0 THEN 'limit_max_total_requested_tokens' WHEN o_orderkey % 23 = 0 THEN 'limit_max_concurrency' WHEN o_orderkey % 29 = 0 THEN 'limit_max_errors' WHEN o_orderkey % 31 = 0 THEN 'limit_max_elapsed_seconds' WHEN o_orderkey % 37 = 0 THEN 'limit_max_estimated_spend' END AS fault FROM orders""")
def p06_limits(spark, d):
    k = F.col("o_orderkey")
    odd = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    limits = F.struct(
        (F.col("o_custkey") % 50).cast("long").alias("max_requests"), F.lit(256).cast("long").alias("max_tokens_per_request"), odd(19, F.lit(None).cast("long"), F.lit(9).cast("long")).alias("max_total_requested_tokens"), odd(23, F.lit(0).cast("long"), F.lit(8).cast("long")).alias("max_concurrency"), F.lit(1000).cast("long").alias("max_response_bytes"),
        odd(29, F.lit(-1).cast("long"), F.lit(1).cast("long")).alias("max_errors"), odd(31, F.lit(float("inf")), F.lit(60.0)).alias("max_elapsed_seconds"), odd(37, F.lit(float("nan")), F.lit(3.0)).alias("max_estimated_spend"),
    )
    return table(spark, d, "orders").select(k.alias("id"), config.limits_fault(limits).alias("fault"))


# One change of a sound report of the other load generator for each code: text, its replacement, code.
IMPORT_CHANGES = (
    ("", "", None), ('"version":2', '"version":3', "unsupported_report_schema"), ('"version":2', '"version":"2"', "invalid_report_number"), ("0.7.3", "0.7.4", "unsupported_report_version"), ("generative_benchmark", "other", "invalid_report_shape"), ('"benchmarks":[', '"benchmarks":[{},', "invalid_report_shape"), ('"duration":', '"duration":-', "invalid_report_number"),
    ('"request_totals":{"successful":', '"request_totals":{"successful":1', "inconsistent_report_totals"), ('"requests_made":{', '"requests_made":{"x":1,"errored":true,', "invalid_report_json"), ('"requests_made":{"successful":', '"requests_made":{"successful":"1","s":', "invalid_report_number"), ('"mode":', '"mode":NaN,"m":', "invalid_report_json"), ('"p90":', '"p91":', "invalid_report_number"),
    ('"percentiles":{', '"percentiles":[{', "invalid_report_json"), ('"std_dev":', '"std_dev":9007199254740993,"s":', "invalid_report_number"), ('"scheduler_metrics"', '"scheduler"', "invalid_report_shape"), ('"prompt_token_count":{"successful":{', '"prompt_token_count":{"failed":{', "invalid_report_shape"), ('"metadata":{', '"secret":"x","metadata":{"name":{"a":[1]},', None),
)


def import_bodies(spark, d):
    """A report of the other load generator for each block of the request log, with one change by its number."""
    ok = runs.valid()
    got = request_log(spark, d).groupBy("position_idx", "concurrency", "block_index").agg(
        F.count_if(ok).alias("successful"), F.count_if(~ok).alias("errored"), F.coalesce(F.sum(F.when(ok, F.col("completion_tokens"))), F.lit(0)).cast("long").alias("out"), F.coalesce(F.sum(F.when(ok, F.col("prompt_tokens"))), F.lit(0)).cast("long").alias("in"),
    )
    totals = F.struct("successful", "errored", F.lit(0).alias("incomplete"), (F.col("successful") + F.col("errored")).alias("total"))
    points = F.struct(*[F.lit(v).alias(p) for v, p in zip((1.5, 2.0, 2.5, 3), source.PERCENTILES, strict=True)])
    summary = lambda total: F.struct(*[(F.col("successful") if f == "count" else total if f == "total_sum" else F.lit(1.25)).alias(f) for f in source.SUMMARY], points.alias("percentiles"))
    sums = {"prompt_token_count": F.col("in"), "output_token_count": F.col("out")}
    metrics = F.struct(totals.alias("request_totals"), *[F.struct(summary(sums.get(m, F.lit(0.5))).alias("successful")).alias(m) for m in source.METRICS])
    one = F.struct(F.lit(source.KIND).alias("type_"), F.lit(10.5).alias("duration"), metrics.alias("metrics"), F.struct(totals.alias("requests_made")).alias("scheduler_metrics"))
    body = F.to_json(F.struct(F.struct(F.lit(2).alias("version"), F.lit(source.TOOL_VERSION).alias("guidellm_version")).alias("metadata"), F.array(one).alias("benchmarks")))
    number = (F.col("position_idx") * 9 + F.col("concurrency") + F.col("block_index")).cast("int")
    changed = body
    for i, (old, new, _) in enumerate(IMPORT_CHANGES):
        if old:
            changed = F.when(number % len(IMPORT_CHANGES) == i, F.replace(body, F.lit(old), F.lit(new))).otherwise(changed)
    return got.select("position_idx", "concurrency", "block_index", F.concat_ws("-", "position_idx", "concurrency", "block_index").alias("id"), changed.alias("report"))


@query("s07_imported_reports", f"""WITH {RL}, i AS (SELECT position_idx, concurrency, block_index, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS errored, coalesce(sum(completion_tokens) FILTER (ok), 0)::BIGINT AS output_tokens, coalesce(sum(prompt_tokens) FILTER (ok), 0)::BIGINT AS prompt_tokens FROM g GROUP BY ALL),
c AS (SELECT *, {code_list(c for *_, c in IMPORT_CHANGES)}[(position_idx * 9 + concurrency + block_index) % {len(IMPORT_CHANGES)} + 1] AS code FROM i)
SELECT position_idx || '-' || concurrency || '-' || block_index AS id, code, CASE WHEN code IS NULL THEN successful END AS successful, CASE WHEN code IS NULL THEN errored END AS errored, CASE WHEN code IS NULL THEN round(errored / (successful + errored), 9) END AS error_rate, CASE WHEN code IS NULL THEN prompt_tokens END AS prompt_tokens, CASE WHEN code IS NULL THEN output_tokens END AS output_tokens,
 CASE WHEN code IS NULL THEN 117 END AS numbers, CASE WHEN code IS NULL THEN errored = 0 AND successful >= 5 END AS valid FROM c""")
def s07(spark, d):
    """Blocks of the request log as the other load generator's reports: what is read from them, and whether each makes a valid block."""
    read = imported.blocks(source.imported_reports(import_bodies(spark, d)), requests=5)
    return read.select("id", "code", "successful", "errored", F.round("error_rate", 9).alias("error_rate"), "prompt_tokens", "output_tokens", F.size("metrics").alias("numbers"), F.when(F.col("code").isNull(), F.col("valid")).alias("valid"))
