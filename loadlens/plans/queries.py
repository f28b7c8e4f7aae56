"""Registered queries of the analytics operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadlens.functions import stats, text
from loadlens.operators import bottleneck, compare, diagnose, runs, similarity, windows
from loadlens.plans.views import GAUGES, RL, SAMPLES, SPAN, T, blocks_sql, ci, gauges, request_log, samples, table
from loadlens.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

BLOCK = ["concurrency", "position_idx", "block_index"]
E2E_SLO, TTFT_SLO = 800.0, 200.0


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def _pairs_text(c: str) -> Column:
    return F.coalesce(F.array_join(F.transform(c, lambda e: F.concat(e["key"], F.lit("="), e["n"])), ","), F.lit(""))


# --- predicates and request metrics -------------------------------------------------------------------------------


@query("p01_valid_response", f"WITH {RL} SELECT request_id, ok AS valid, gpu AS generated, ok AND cache_hit AS cached FROM g")
def p01(spark, d):
    return request_log(spark, d).select("request_id", runs.valid().alias("valid"), runs.generated().alias("generated"), (runs.valid() & F.col("cache_hit")).alias("cached"))


@query("p03_slo", f"WITH {RL} SELECT request_id, ok AND e2e_seconds * 1000 <= {E2E_SLO} AND coalesce(ttft_seconds * 1000 <= {TTFT_SLO}, false) AS passes FROM g")
def p03(spark, d):
    return request_log(spark, d).select("request_id", (runs.valid() & runs.within_slo(E2E_SLO, TTFT_SLO)).alias("passes"))


@query("a01_request_counts", f"""WITH {RL},
h AS (SELECT concurrency, block_index, coalesce(status_code::VARCHAR, 'transport') AS s, error_code AS e, finish_reason AS f, ok FROM g),
c AS (SELECT concurrency, block_index, 's' AS kind, s AS k, count(*) AS n FROM h GROUP BY ALL UNION ALL SELECT concurrency, block_index, 'e', e, count(*) FROM h WHERE e IS NOT NULL GROUP BY ALL UNION ALL SELECT concurrency, block_index, 'f', f, count(*) FROM h WHERE f IS NOT NULL GROUP BY ALL)
SELECT concurrency, block_index, (SELECT count(*) FROM h WHERE h.concurrency = c.concurrency AND h.block_index = c.block_index) AS attempted, (SELECT count(*) FROM h WHERE ok AND h.concurrency = c.concurrency AND h.block_index = c.block_index) AS valid,
       coalesce(string_agg(k || '=' || n, ',' ORDER BY k) FILTER (kind = 's'), '') AS statuses, coalesce(string_agg(k || '=' || n, ',' ORDER BY k) FILTER (kind = 'e'), '') AS errors, coalesce(string_agg(k || '=' || n, ',' ORDER BY k) FILTER (kind = 'f'), '') AS finishes
FROM c GROUP BY concurrency, block_index""")  # fmt: skip
def a01(spark, d):
    got = runs.request_counts(request_log(spark, d), ["concurrency", "block_index"])
    return got.select("concurrency", "block_index", "attempted", "valid", _pairs_text("status_counts").alias("statuses"), _pairs_text("error_counts").alias("errors"), _pairs_text("finish_reason_counts").alias("finishes"))


@query("a02_block_metrics", f"""WITH {RL}
SELECT concurrency, position_idx, block_index, count(*) AS attempted, count(*) FILTER (ok) AS valid, coalesce(sum(completion_tokens) FILTER (ok), 0)::BIGINT AS completion_tokens, coalesce(sum(prompt_tokens) FILTER (ok), 0)::BIGINT AS prompt_tokens,
  count(*) FILTER (ok AND cache_hit) AS cache_hits, round(count(*) FILTER (ok) / nullif({SPAN}, 0), 9) AS rps, round(coalesce(sum(completion_tokens) FILTER (gpu), 0) / nullif({SPAN}, 0), 9) AS tps, round((count(*) - count(*) FILTER (ok)) / count(*), 6) AS error_rate,
  round(count(*) FILTER (ok AND e2e_seconds * 1000 <= {E2E_SLO} AND coalesce(ttft_seconds * 1000 <= {TTFT_SLO}, false)) / nullif({SPAN}, 0), 9) AS goodput,
  count(e2e_seconds) FILTER (gpu) AS n, round(avg(e2e_seconds * 1000.0) FILTER (gpu), 6) AS mean, round(quantile_cont(e2e_seconds * 1000.0, 0.5) FILTER (gpu), 6) AS p50, round(quantile_cont(e2e_seconds * 1000.0, 0.9) FILTER (gpu), 6) AS p90,
  round(quantile_cont(e2e_seconds * 1000.0, 0.95) FILTER (gpu), 6) AS p95, round(quantile_cont(e2e_seconds * 1000.0, 0.99) FILTER (gpu), 6) AS p99
FROM g GROUP BY concurrency, position_idx, block_index""")  # fmt: skip
def a02(spark, d):
    got = runs.metrics(request_log(spark, d), BLOCK, e2e_ms=E2E_SLO, ttft_ms=TTFT_SLO)
    return got.select(
        *BLOCK, "attempted", "valid", "completion_tokens", "prompt_tokens", F.col("cache_hit_count").alias("cache_hits"), F.round("requests_per_second", 9).alias("rps"), F.round("output_tokens_per_second", 9).alias("tps"), r6("error_rate").alias("error_rate"),
        F.round("goodput_per_second", 9).alias("goodput"), F.col("e2e_ms.count").alias("n"), *[r6(f"e2e_ms.{p}").alias(p) for p in ("mean", "p50", "p90", "p95", "p99")],
    )


def _blocks(spark, d) -> DataFrame:
    return runs.metrics(request_log(spark, d), BLOCK)


def _blocks_for_rates(spark, d) -> DataFrame:
    rate = (F.col("attempted") - 1) / F.col("wall_seconds") * (1 + (F.col("block_index") - 2) * 0.06)
    return _blocks(spark, d).select(*BLOCK, "attempted", "valid", F.col("attempted").alias("offered_requests"), (F.col("block_index") != 3).alias("complete"), rate.alias("target_rate"), F.col("wall_seconds").alias("launch_window_seconds"), F.col("e2e_ms.p95").alias("lag_p95_ms"))


@query("a06_block_report", f"""WITH {RL}, b AS ({blocks_sql("concurrency, position_idx, block_index")}),
t AS (SELECT *, (attempted - 1) / wall_seconds * (1 + (block_index - 2) * 0.06) AS target FROM b),
x AS (SELECT *, abs((attempted - 1) / wall_seconds - target) / target AS off, e2e_p95 / (1000.0 / target) AS lag FROM t)
SELECT concurrency, position_idx, block_index, block_index <> 3 AND attempted = valid AS block_valid,
       CASE WHEN block_index = 3 THEN CASE WHEN attempted > valid THEN 'incomplete_block,one_or_more_invalid_responses' ELSE 'incomplete_block' END WHEN attempted > valid THEN 'one_or_more_invalid_responses' ELSE '' END AS invalid_reasons,
       round(off, 6) AS rate_error, round(lag, 9) AS lag_ratio, off <= 0.05 AND lag <= 1.0 AS achieved FROM x""")  # fmt: skip
def a06(spark, d):
    got = runs.block_report(_blocks_for_rates(spark, d))
    return got.select(*BLOCK, "block_valid", F.array_join("invalid_reasons", ",").alias("invalid_reasons"), r6("offered_rate_relative_error").alias("rate_error"), F.round("scheduler_lag_interval_ratio_p95", 9).alias("lag_ratio"), F.col("open_loop_target_achieved").alias("achieved"))


def _valid_requests(spark, d) -> DataFrame:
    """Valid requests only: a fifth of the log are errors, which would make every block invalid."""
    return request_log(spark, d).where(runs.valid())


_COND = f"""WITH {RL.replace("g AS (SELECT *, ok AND NOT cache_hit AS gpu FROM v)", "g AS (SELECT *, NOT cache_hit AS gpu FROM v WHERE ok)")}, b AS ({blocks_sql("concurrency, position_idx, block_index")}),
c AS (SELECT concurrency, position_idx, count(*) AS blocks, sum(valid)::BIGINT AS valid, sum(completion_tokens)::BIGINT AS completion_tokens, sum(wall_seconds) AS wall, sum(gpu_completion_tokens) / sum(wall_seconds) AS pooled_tps,
   avg(output_tokens_per_second) AS mean_tps, {ci("output_tokens_per_second", "low")} AS tps_low, {ci("output_tokens_per_second", "high")} AS tps_high, {ci("e2e_p95", "low")} AS p95_low, {ci("e2e_p95", "high")} AS p95_high FROM b GROUP BY concurrency, position_idx),
q AS (SELECT concurrency, position_idx, quantile_cont(e2e_seconds * 1000.0, 0.95) FILTER (gpu) AS p95 FROM g GROUP BY concurrency, position_idx)"""


@query("a07_condition", f"""{_COND}
SELECT concurrency, position_idx, blocks, valid, completion_tokens, round(wall, 6) AS wall, round(pooled_tps, 9) AS pooled_tps, round(mean_tps, 9) AS mean_tps, round(tps_low, 9) AS tps_low, round(tps_high, 9) AS tps_high, round(p95, 6) AS p95, round(p95_low, 6) AS p95_low, round(p95_high, 6) AS p95_high
FROM c JOIN q USING (concurrency, position_idx)""")  # fmt: skip
def a07(spark, d):
    got = runs.condition_aggregate(_valid_requests(spark, d), ["concurrency", "position_idx"])
    r9 = lambda c: F.round(c, 9)
    return got.select(
        "concurrency", "position_idx", "blocks", "valid", "completion_tokens", r6("wall_seconds").alias("wall"), r9("output_tokens_per_second").alias("pooled_tps"), r9("tokens_ci.mean").alias("mean_tps"), r9("tokens_ci.low").alias("tps_low"), r9("tokens_ci.high").alias("tps_high"),
        r6("e2e_ms.p95").alias("p95"), r6("e2e_p95_ci.low").alias("p95_low"), r6("e2e_p95_ci.high").alias("p95_high"),
    )


@query("r03_decision_grade", f"""{_COND}
SELECT concurrency, position_idx, blocks >= 3 AND (valid >= 200 OR wall >= 60) AND concurrency <> 8 AS decision_grade,
       array_to_string(list_filter([CASE WHEN concurrency = 8 THEN 'closed_loop_target_concurrency_not_observed' END, CASE WHEN blocks < 3 THEN 'fewer_than_three_blocks' WHEN valid < 200 AND wall < 60 THEN 'measurement_floor_not_met' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c""")  # fmt: skip
def r03(spark, d):
    got = runs.grade(runs.condition_aggregate(_valid_requests(spark, d), ["concurrency", "position_idx"]), target=F.col("concurrency") != 8)
    return got.select("concurrency", "position_idx", "decision_grade", F.array_join("decision_ineligible_reasons", ",").alias("reasons"))


@query("k01_best_tested", f"""{_COND},
m AS (SELECT *, completion_tokens / valid AS per, p95_high <= 960 AS eligible FROM c),
s AS (SELECT *, max(concurrency) OVER p AS top, max(per) OVER p AS hi, min(per) OVER p AS lo, count(*) OVER p AS nv, count(*) FILTER (eligible) OVER p AS ne, row_number() OVER (PARTITION BY position_idx ORDER BY eligible DESC, mean_tps DESC, concurrency) AS k FROM m WINDOW p AS (PARTITION BY position_idx)),
w AS (SELECT a.*, (SELECT bool_or(a.tps_low <= r.tps_high AND r.tps_low <= a.tps_high) FROM s r WHERE r.position_idx = a.position_idx AND r.k > 1 AND r.eligible) AS meets FROM s a WHERE k = 1)
SELECT position_idx, ne > 0 AS available, CASE WHEN ne > 0 THEN concurrency END AS value, CASE WHEN ne > 0 THEN round((hi - lo) / hi, 6) END AS spread,
       CASE WHEN ne = 0 THEN 'inconclusive' ELSE CASE WHEN (hi - lo) / hi > 0.05 OR nv > 1 OR concurrency = top OR meets THEN 'inconclusive' ELSE 'supported' END END AS state,
       CASE WHEN ne = 0 THEN 'no_valid_condition_meets_slo' ELSE array_to_string(list_filter([CASE WHEN (hi - lo) / hi > 0.05 THEN 'completion_tokens_per_response_not_comparable_across_conditions' END, CASE WHEN nv > 1 THEN 'multi_condition_order_not_counterbalanced' END,
       CASE WHEN concurrency = top THEN 'search_boundary_reached' END, CASE WHEN meets THEN 'throughput_confidence_intervals_overlap' END], lambda x: x IS NOT NULL), ',') END AS reasons
FROM w""")  # fmt: skip
def k01(spark, d):
    cond = runs.grade(runs.condition_aggregate(_valid_requests(spark, d), ["concurrency", "position_idx"]))
    got = runs.best_tested(cond.withColumn("decision_grade", F.lit(True)), ["position_idx"], "concurrency", e2e_ms=960.0)
    return got.select("position_idx", "available", "value", r6("token_spread").alias("spread"), "state", F.array_join("reasons", ",").alias("reasons"))


_KINDS = ("dedicated_hourly", "serverless_active_seconds", "user_supplied", "unknown")


@query("a09_cost", f"""WITH {RL}, c AS (SELECT concurrency, position_idx, coalesce(sum(completion_tokens) FILTER (ok), 0)::BIGINT AS tokens, count(*)::DOUBLE AS elapsed, ['dedicated_hourly', 'serverless_active_seconds', 'user_supplied', 'unknown'][position_idx % 4 + 1] AS kind, CASE WHEN position_idx < 4 THEN position_idx * 100.0 END AS billed FROM g GROUP BY concurrency, position_idx),
x AS (SELECT *, CASE kind WHEN 'dedicated_hourly' THEN 1.5 * elapsed / 3600 WHEN 'serverless_active_seconds' THEN 0.002 * billed WHEN 'user_supplied' THEN 7.25 END AS final FROM c)
SELECT concurrency, position_idx, kind, round(CASE kind WHEN 'dedicated_hourly' THEN 1.5 * 600 / 3600.0 WHEN 'serverless_active_seconds' THEN greatest(0.002 * 4 * 600, coalesce(0.002 * billed, 0)) WHEN 'user_supplied' THEN 7.25 END, 6) AS upper_bound,
  round(CASE kind WHEN 'dedicated_hourly' THEN 1.5 * elapsed / 3600 WHEN 'serverless_active_seconds' THEN 0.002 * 4 * elapsed END, 6) AS elapsed_estimate, round(final, 6) AS final_cost,
  CASE kind WHEN 'dedicated_hourly' THEN 'observed_client_wall_time' WHEN 'serverless_active_seconds' THEN CASE WHEN billed IS NULL THEN 'billing_active_seconds_not_supplied' ELSE 'user_supplied_billed_active_seconds' END WHEN 'user_supplied' THEN 'user_supplied_run_total' ELSE 'billing_unknown' END AS basis,
  round(CASE WHEN tokens > 0 THEN final / tokens * 1000000.0 END, 6) AS per_million FROM x""")  # fmt: skip
def a09(spark, d):
    c = request_log(spark, d).groupBy("concurrency", "position_idx").agg(F.coalesce(F.sum(F.when(runs.valid(), F.col("completion_tokens"))), F.lit(0)).cast("long").alias("tokens"), F.count("*").cast("double").alias("elapsed"))
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), F.col("position_idx") % 4 + 1)
    billed = F.when(F.col("position_idx") < 4, F.col("position_idx") * 100.0)
    cost = runs.cost_columns(kind, F.col("elapsed"), F.col("tokens"), F.lit(1.5), F.lit(0.002), F.lit(4), billed, F.lit(7.25), F.lit(600.0))
    return c.select("concurrency", "position_idx", kind.alias("kind"), r6(cost["upper_bound"]).alias("upper_bound"), r6(cost["elapsed_estimate"]).alias("elapsed_estimate"), r6(cost["final_cost"]).alias("final_cost"), cost["basis"].alias("basis"), r6(cost["cost_per_million_output_tokens"]).alias("per_million"))


@query("a10_merge_summaries", f"WITH {RL}, b AS (SELECT concurrency, block_index, count(*) FILTER (gpu) AS n, avg(e2e_seconds * 1000.0) FILTER (gpu) AS m FROM g GROUP BY ALL) SELECT concurrency, sum(n)::BIGINT AS count, round(sum(n * m) / sum(n), 6) AS mean, CAST(NULL AS DOUBLE) AS p95 FROM b GROUP BY concurrency")
def a10(spark, d):
    b = runs.metrics(request_log(spark, d), ["concurrency", "block_index"], percentiles=False).select("concurrency", "block_index", F.col("e2e_ms.count").alias("count"), F.col("e2e_ms.mean").alias("mean"))
    return runs.merge_summaries(b, ["concurrency"]).select("concurrency", "count", r6("mean").alias("mean"), "p95")


@query("a17_token_spread", f"WITH {RL}, b AS ({blocks_sql('concurrency, position_idx')}) SELECT position_idx, round((max(completion_tokens / valid) - min(completion_tokens / valid)) / max(completion_tokens / valid), 9) AS spread FROM b GROUP BY position_idx")
def a17(spark, d):
    m = runs.metrics(request_log(spark, d), ["concurrency", "position_idx"], percentiles=False)
    return m.groupBy("position_idx").agg(F.round(stats.relative_spread(F.col("completion_tokens") / F.col("valid")), 9).alias("spread"))


@query("a20_count_distinct", f"WITH {RL} SELECT concurrency, count(DISTINCT user_id) AS users, count(DISTINCT finish_reason) AS finishes FROM g GROUP BY concurrency")
def a20(spark, d):
    return request_log(spark, d).groupBy("concurrency").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("finish_reason").alias("finishes"))


# --- statistics ------------------------------------------------------------------------------------------------------


@query("t02_percentile", "SELECT event_type, round(quantile_cont(value, 0.0), 6) AS p0, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 1.0), 6) AS p100 FROM events GROUP BY event_type")
def t02(spark, d):
    fractions = (0.0, 0.25, 0.5, 0.95, 1.0)
    got = stats.percentiles(table(spark, d, "events"), ["event_type"], {"p": F.col("value")}, fractions)
    return got.select("event_type", *[r6(F.col("p")[i]).alias(f"p{int(f * 100)}") for i, f in enumerate(fractions)])


@query("t03_t_critical", f"""WITH z AS (SELECT o_orderkey AS k, (o_orderkey % 60 + 1)::INT AS df, 1.959963984540054::DOUBLE AS z FROM orders)
SELECT k, df, round(CASE WHEN df <= 30 THEN {T}[df] ELSE z + (z**3 + z) / (4.0 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96.0 * df**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384.0 * df**3) END, 9)::DOUBLE AS t FROM z""")  # fmt: skip
def t03(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 60 + 1).cast("int").alias("df"))
    return o.select("k", "df", F.round(stats.t_critical("df"), 9).alias("t"))


@query("t04_t_interval", f"WITH u AS (SELECT event_type, user_id % 25 AS b, avg(value) AS m FROM events GROUP BY ALL) SELECT event_type, count(*) AS n, round(avg(m), 6) AS mean, round({ci('m', 'low')}, 6) AS low, round({ci('m', 'high')}, 6) AS high FROM u GROUP BY event_type")
def t04(spark, d):
    u = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 25).alias("b")).agg(F.avg("value").alias("m"))
    got = u.groupBy("event_type").agg(stats.t_interval("m").alias("ci"))
    return got.select("event_type", F.col("ci.n").alias("n"), r6("ci.mean").alias("mean"), r6("ci.low").alias("low"), r6("ci.high").alias("high"))


@query("t07_relative_delta", "SELECT event_id, round(CASE WHEN (event_id % 7)::DOUBLE <> 0 THEN (value / (event_id % 7) - 1) * 100 END, 6) AS delta FROM events")
def t07(spark, d):
    return table(spark, d, "events").select("event_id", r6(stats.relative_delta_percent("value", F.col("event_id") % 7)).alias("delta"))


@query("t09_interval_overlap", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN true ELSE value - 10 <= 250 + event_id % 300 AND 240 + event_id % 300 <= value + 10 END AS overlaps FROM events")
def t09(spark, d):
    v, m = F.col("value"), F.col("event_id") % 300
    return table(spark, d, "events").select("event_id", stats.intervals_overlap(F.when(F.col("event_id") % 5 != 0, v - 10), v + 10, 240 + m, 250 + m).alias("overlaps"))


@query("t11_close", "SELECT event_id, abs(value - value * (1 + (event_id % 4) * 5e-7)) <= greatest(1e-6 * greatest(abs(value), abs(value * (1 + (event_id % 4) * 5e-7))), 1e-9) AS same FROM events")
def t11(spark, d):
    return table(spark, d, "events").select("event_id", stats.close("value", F.col("value") * (1 + (F.col("event_id") % 4) * 5e-7)).alias("same"))


# --- ordered rows ----------------------------------------------------------------------------------------------------


@query("w01_gaps", "SELECT event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id)) / 1e6, 6) AS gap FROM events")
def w01(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", r6((at - F.lag(at).over(Window.partitionBy("user_id").orderBy("event_id"))) / 1e6).alias("gap"))


@query("w02_tpot", f"WITH {RL}, u AS (SELECT user_id, min(e2e_seconds) AS a, max(e2e_seconds) AS b, count(*) AS n, sum(completion_tokens) AS t FROM g WHERE ok GROUP BY user_id) SELECT user_id, round(a, 6) AS ttft, round(CASE WHEN n >= 2 AND t > 1 THEN (b - a) / (t - 1) END, 9) AS tpot FROM u")
def w02(spark, d):
    u = _valid_requests(spark, d).groupBy("user_id").agg(F.min("e2e_seconds").alias("a"), F.max("e2e_seconds").alias("b"), F.count("*").alias("n"), F.sum("completion_tokens").alias("t"))
    return u.select("user_id", r6("a").alias("ttft"), F.round(F.when((F.col("n") >= 2) & (F.col("t") > 1), F.try_divide(F.col("b") - F.col("a"), F.col("t") - 1)), 9).alias("tpot"))


@query("w04_counter_resets", f"WITH {GAUGES}, l AS (SELECT *, lag(value) OVER (PARTITION BY run, family, labels ORDER BY seq) AS previous FROM gauges) SELECT run, seq, labels, value, previous FROM l WHERE value < previous")
def w04(spark, d):
    return windows.resets(gauges(spark, d), ["run"]).select("run", "seq", "labels", "value", "previous")


@query("w05_sample_gaps", f"WITH {GAUGES}, s AS (SELECT DISTINCT run, seq, seq * 1.5::DOUBLE + seq * seq % 5 AS t FROM gauges) SELECT run, seq, round(t - lag(t) OVER w, 6) AS gap, coalesce(t - lag(t) OVER w BETWEEN 0 AND 5, true) AS gap_ok FROM s WINDOW w AS (PARTITION BY run ORDER BY seq)")
def w05(spark, d):
    s = gauges(spark, d).select("run", "seq", (F.col("seq") * 1.5 + F.col("seq") * F.col("seq") % 5).alias("t")).distinct()
    return windows.gaps(s, ["run"], "t").select("run", "seq", r6("gap").alias("gap"), "gap_ok")


@query("w07_running_budget", f"""WITH {RL}, s AS (SELECT request_id, count(*) OVER w AS run_requests, coalesce(sum(completion_tokens) OVER w, 0)::BIGINT AS run_tokens, count(*) FILTER (NOT ok) OVER w AS run_errors FROM g WINDOW w AS (PARTITION BY concurrency, position_idx ORDER BY request_id ROWS UNBOUNDED PRECEDING))
SELECT *, CASE WHEN run_requests >= 40 THEN 'max_requests' WHEN run_tokens >= 1500 THEN 'max_output_tokens' WHEN run_errors >= 5 THEN 'max_errors' END AS stop FROM s""")  # fmt: skip
def w07(spark, d):
    return runs.running_budget(request_log(spark, d), ["concurrency", "position_idx"], ["request_id"], 40, 1500, 5, slot=F.floor(F.col("request_id") / 4096)).select("request_id", "run_requests", "run_tokens", "run_errors", "stop")


@query("w08_peak_in_flight", f"""WITH {RL}, e AS (SELECT concurrency, block_index, epoch_us(ts) AS t, 1 AS d FROM g UNION ALL SELECT concurrency, block_index, epoch_us(ts) + CAST(floor(e2e_seconds * 1e9) AS BIGINT), -1 FROM g),
s AS (SELECT concurrency, block_index, sum(d) OVER (PARTITION BY concurrency, block_index ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS o FROM e) SELECT concurrency, block_index, max(o)::BIGINT AS peak_in_flight FROM s GROUP BY ALL""")  # fmt: skip
def w08(spark, d):
    s = request_log(spark, d).withColumn("a", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("z", F.col("a") + F.floor(F.col("e2e_seconds") * 1e9).cast("long"))
    return runs.peak_in_flight(s, ["concurrency", "block_index"], "a", "z", width=21_600_000_000)


@query("w09_scheduler_lag", "WITH s AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER w - 1 AS i, min(epoch_us(ts)) OVER (PARTITION BY user_id) / 1e6 AS t0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, i AS launch, round(greatest(0, t - (t0 + i / 0.001)), 3) AS lag FROM s")
def w09(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    w = Window.partitionBy("user_id")
    e = table(spark, d, "events").select("event_id", at.alias("t"), (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("long").alias("launch"), F.min(at).over(w).alias("t0"))
    return e.select("event_id", "launch", F.round(F.greatest(F.lit(0.0), F.col("t") - (F.col("t0") + F.col("launch") / 0.001)), 3).alias("lag"))


@query("w10_block_indexes", f"WITH {RL}, b AS (SELECT DISTINCT concurrency, position_idx, block_index FROM g WHERE NOT (concurrency = 4 AND block_index = 2 AND position_idx = 1)), r AS (SELECT *, row_number() OVER (PARTITION BY concurrency, position_idx ORDER BY block_index) AS k FROM b) SELECT concurrency, position_idx, bool_and(k = block_index) AS sequential FROM r GROUP BY ALL")
def w10(spark, d):
    b = request_log(spark, d).select(*BLOCK).distinct().where(~((F.col("concurrency") == 4) & (F.col("block_index") == 2) & (F.col("position_idx") == 1)))
    k = F.row_number().over(Window.partitionBy("concurrency", "position_idx").orderBy("block_index"))
    return b.withColumn("k", k).groupBy("concurrency", "position_idx").agg(F.min(F.col("k") == F.col("block_index")).alias("sequential"))


# --- metric windows --------------------------------------------------------------------------------------------------


@query("a12_counter_deltas", f"WITH {SAMPLES}, d AS (SELECT run, family, labels, max_by(value, seq) - min_by(value, seq) AS delta FROM samples GROUP BY ALL) SELECT run, family, round(sum(delta), 4) AS delta, count(*) AS series FROM d GROUP BY ALL")
def a12(spark, d):
    return windows.counter_deltas(samples(spark, d), ["run"]).select("run", "family", F.round("delta", 4).alias("delta"), "series")


_REASON = {"purchase": "stop", "view": "length", "click": "abort", "error": "error", "signup": "other"}


@query("a13_outcomes", f"""WITH {SAMPLES}, d AS (SELECT run, CASE WHEN labels IN ('purchase', 'view') THEN 'allowed' WHEN labels IN ('click', 'error') THEN 'disallowed' ELSE 'unclassified' END AS c, max_by(value, seq) - min_by(value, seq) AS delta FROM samples WHERE family = 'count' GROUP BY run, labels)
SELECT run, sum(delta) AS requests_finished, coalesce(sum(delta) FILTER (c = 'allowed'), 0) AS allowed_finished_requests, coalesce(sum(delta) FILTER (c = 'disallowed'), 0) AS disallowed_finished_requests, coalesce(sum(delta) FILTER (c = 'unclassified'), 0) AS unclassified_finished_requests FROM d GROUP BY run""")  # fmt: skip
def a13(spark, d):
    reason = F.element_at(F.create_map(*[F.lit(x) for kv in _REASON.items() for x in kv]), F.col("labels"))
    return windows.outcome_counts(samples(spark, d).where("family = 'count'"), ["run"], reason)


@query("a14_histogram_mean", f"WITH {SAMPLES}, d AS (SELECT run, labels, family, max_by(value, seq) - min_by(value, seq) AS delta FROM samples GROUP BY ALL) SELECT run, round(1000 * sum(delta) FILTER (family = 'sum') / nullif(sum(delta) FILTER (family = 'count'), 0), 4) AS mean_ms, (sum(delta) FILTER (family = 'count'))::BIGINT AS observations, true AS paired FROM d GROUP BY run")
def a14(spark, d):
    s = samples(spark, d)
    return windows.histogram_mean_ms(s.where("family = 'sum'"), s.where("family = 'count'"), ["run"]).select("run", F.round("mean_ms", 4).alias("mean_ms"), "observations", "paired")


@query("a15_gauge_max", f"WITH {GAUGES}, o AS (SELECT run, seq, sum(value) AS s, max(value) AS m FROM gauges GROUP BY ALL) SELECT run, max(s) AS most, max(m) AS largest FROM o GROUP BY run")
def a15(spark, d):
    g = gauges(spark, d)
    return windows.gauge_max(g, ["run"]).select("run", F.col("max_value").alias("most")).join(windows.gauge_max(g, ["run"], "max").select("run", F.col("max_value").alias("largest")), "run")


@query("j06_topology", f"WITH {SAMPLES}, n AS (SELECT run, count(DISTINCT seq) AS a FROM samples GROUP BY run), s AS (SELECT run, family, labels, count(DISTINCT seq) AS k FROM samples GROUP BY ALL) SELECT run, family, bool_and(k = a) AS stable, count(*) AS series FROM s JOIN n USING (run) GROUP BY run, family")
def j06(spark, d):
    return windows.topology(samples(spark, d), ["run"])


@query("j11_scopes", f"WITH {SAMPLES}, f AS (SELECT run, family, string_agg(DISTINCT labels, ',' ORDER BY labels) AS s, count(DISTINCT labels) AS k FROM samples GROUP BY ALL) SELECT run, count(DISTINCT s) AS scopes, count(DISTINCT s) = 1 AS consistent, max(k)::INT AS scope_count FROM f GROUP BY run")
def j11(spark, d):
    return windows.scopes_equal(samples(spark, d), ["run"])
