"""Registered queries of report checks, decisions, plans and the remaining small operators."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from loadlens.functions import stats, text
from loadlens.operators import bottleneck, compare, diagnose, reports, runs, windows
from loadlens.plans import report_samples
from loadlens.plans.more_queries import _WINDOWS, _windows, position
from loadlens.plans.queries import query, r6
from loadlens.plans.views import RL, blocks_sql, request_log, table
from loadlens.sources import files

_CASES = report_samples.cases()
_codes = "[" + ", ".join("NULL" if code is None else f"'{code}'" for _, code in _CASES) + "]"


def _pick(values: list, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


@query("p10_report_preflight", f"SELECT s_suppkey AS id, {_codes}[(s_suppkey % {len(_CASES)} + 1)::INT] AS code FROM supplier")
def p10(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), _pick([t for t, _ in _CASES], F.col("s_suppkey") % len(_CASES)).alias("report"))
    return reports.preflight(s).select("id", "code")


@query("p16_fingerprint", "SELECT s_suppkey AS id, min(s_suppkey) OVER (PARTITION BY s_suppkey % 5, s_nationkey) AS same_as FROM supplier")
def p16(spark, d):
    """Reports of one seed and one server have one fingerprint, whatever their notes say."""
    good = json.dumps({**report_samples.sound(), "note": "NOTE"}).replace('"seed": 1', '"seed": SEED').replace('"server_version": "1"', '"server_version": "v SERVER"')
    body = F.lit(good)
    for mark, value in (("SEED", F.col("s_suppkey") % 5), ("SERVER", F.col("s_nationkey")), ("NOTE", F.col("s_suppkey"))):
        body = F.replace(body, F.lit(mark), value.cast("string"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), reports.fingerprint(F.from_json(body, reports.REPORT)).alias("f"))
    return s.select("id", F.min("id").over(Window.partitionBy("f")).alias("same_as"))


_RUNTIME = report_samples.sound()["manifest"]["runtime"]


@query("p09_runtime_provenance", "SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'immutable_image_digest_required' WHEN 2 THEN 'runtime_aliases_do_not_reconcile' WHEN 3 THEN 'immutable_software_environment_digest_required' WHEN 4 THEN 'accelerator_fingerprint_not_supplied' ELSE 'unsafe_runtime_metadata' END AS reasons FROM supplier")
def p09(spark, d):
    kinds = [_RUNTIME, {**_RUNTIME, "image_digest": "repo/image:1"}, {**_RUNTIME, "accelerator": "H100"}, {**_RUNTIME, "software_environment_digest": "env:1"}, {**_RUNTIME, "gpu_fingerprint_supplied": False, "accelerator_fingerprint_supplied": False}, {**_RUNTIME, "gpu": "token=abc"}]
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.from_json(_pick([json.dumps(k) for k in kinds], F.col("s_suppkey") % 6), reports.RUNTIME).alias("r"))
    return s.select("id", F.array_join(reports.runtime_reasons(F.col("r"), F.lit("1.1")), ",").alias("reasons"))


@query("p12_contracts", "SELECT s_suppkey AS id, s_suppkey % 3 <> 1 AS safe, s_suppkey % 5 < 2 OR s_suppkey % 5 = 4 AS paid FROM supplier")
def p12(spark, d):
    m = report_samples.sound()["manifest"]
    safety = [m["safety"], {**m["safety"], "redirects_followed": True}, m["safety"]]
    none = dict.fromkeys(("total_hourly_rate", "gpu_count", "active_second_rate", "max_active_workers", "billed_active_seconds", "user_supplied_total"))
    base = {**m["cost"], **none}
    cost = [m["cost"], {**base, "kind": "unknown", "pre_run_upper_bound": None}, {**m["cost"], "pre_run_upper_bound": 1.0}, {**m["cost"], "user_supplied_total": 1.0}, {**base, "kind": "serverless_active_seconds", "active_second_rate": 0.01, "max_active_workers": 2, "pre_run_upper_bound": 12.0}]
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(k.alias("id"), F.from_json(_pick([json.dumps(x) for x in safety], k % 3), reports.SAFETY).alias("s"), F.from_json(_pick([json.dumps(x) for x in cost], k % 5), reports.COST).alias("c"))
    return s.select("id", reports.safety_ok(F.col("s")).alias("safe"), reports.cost_ok(F.col("c"), F.lit(600.0)).alias("paid"))


@query("r05_run_decision", f"WITH {RL} SELECT position_idx, array_to_string(list_filter([CASE WHEN min(block_index) FILTER (NOT ok) IS NOT NULL THEN 'one_or_more_conditions_are_not_decision_grade' END, CASE WHEN position_idx % 2 = 1 THEN 'runtime_verified_engine_flags_required' END], lambda x: x IS NOT NULL), ',') AS reasons, sum(completion_tokens)::BIGINT AS total_tokens FROM g GROUP BY position_idx")
def r05(spark, d):
    log = request_log(spark, d)
    graded = log.groupBy("position_idx").agg(F.min(runs.valid()).alias("grade"), F.sum("completion_tokens").cast("long").alias("total_tokens"))
    why = reports.run_decision_reasons(one_or_more_conditions_are_not_decision_grade=F.col("grade"), runtime_verified_engine_flags_required=F.col("position_idx") % 2 == 0)
    return graded.select("position_idx", F.array_join(why, ",").alias("reasons"), "total_tokens")


@query("r09_treatment", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey + 1 END AS baseline, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey + 2 END AS candidate FROM supplier")
def r09(spark, d):
    k = F.col("s_suppkey")
    flags = lambda n, other: F.create_map(F.lit("Max_Num_Seqs"), n.cast("string"), F.lit("kv"), other)
    got = reports.treatment(flags(k + 1, F.lit("x")), flags(F.when(k % 4 == 1, k + 1).when(k % 4 == 3, F.lit(-1)).otherwise(k + 2), F.when(k % 4 == 2, F.lit("y")).otherwise(F.lit("x"))))
    return table(spark, d, "supplier").select(k.alias("id"), got["baseline_value"].alias("baseline"), got["candidate_value"].alias("candidate"))


@query("r10_golden_conditions", f"""WITH {RL}, b AS ({blocks_sql("concurrency, position_idx, block_index")}), p AS (SELECT concurrency, position_idx, sum(completion_tokens) AS t FROM b GROUP BY ALL),
s AS (SELECT concurrency, abs(sum(t) FILTER (position_idx % 2 = 1) - sum(t) FILTER (position_idx % 2 = 0)) / greatest(sum(t) FILTER (position_idx % 2 = 1), sum(t) FILTER (position_idx % 2 = 0)) AS d, (max(t) - min(t)) / max(t) AS ps FROM p GROUP BY concurrency),
k AS (SELECT concurrency, max(s) AS bs FROM (SELECT concurrency, block_index, (max(completion_tokens) - min(completion_tokens)) / max(completion_tokens) AS s FROM b GROUP BY ALL) GROUP BY concurrency)
SELECT concurrency, round(d, 6) AS token_difference, round(ps, 6) AS position_spread, round(bs, 6) AS block_spread, CASE WHEN d <= 0.05 AND ps <= 0.05 AND bs <= 0.05 THEN 'comparable' ELSE 'completion_tokens_outside_5_percent_tolerance' END AS tokens FROM s JOIN k USING (concurrency)""")  # fmt: skip
def r10(spark, d):
    b = runs.metrics(request_log(spark, d), ["concurrency", "position_idx", "block_index"], percentiles=False).withColumn("position", position())
    rates = compare.phase_contrasts(b.select("concurrency", "position", F.col("output_tokens_per_second").alias("rate")), ["concurrency"])
    got = reports.golden_conditions(rates, b.select("concurrency", "position", "block_index", "completion_tokens"), ["concurrency"])
    outside = "completion_tokens_outside_5_percent_tolerance"
    return got.select("concurrency", r6("token_difference").alias("token_difference"), r6("position_spread").alias("position_spread"), r6("block_spread").alias("block_spread"), F.when(F.coalesce(F.col("reason") == outside, F.lit(False)), outside).otherwise("comparable").alias("tokens"))


@query("r18_plan", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN 2 * (3 * (s_suppkey % 3) + 5) END::BIGINT AS request_count, CASE WHEN s_suppkey % 3 <> 0 THEN 2 * (3 * (s_suppkey % 3) + 5) * 128 END::BIGINT AS requested_output_tokens FROM supplier")
def r18(spark, d):
    k = F.col("s_suppkey")
    got = reports.planned(F.array(F.lit(1), F.lit(4)), F.lit(3), F.when(k % 3 != 0, k % 3), F.lit(5), F.lit(128))
    return table(spark, d, "supplier").select(k.alias("id"), *[c.alias(n) for n, c in got.items()])


@query("r13_no_suggestion", f"WITH {_WINDOWS} SELECT id, array_to_string(none, ',') AS reasons FROM a WHERE pre IS NOT NULL")
def r13(spark, d):
    s = bottleneck.signals(_windows(spark, d)).where("preemptions is not null")
    return s.select("id", F.array_join(bottleneck.no_suggestion_reasons(), ",").alias("reasons"))


@query("r14_suggestion", f"WITH {_WINDOWS} SELECT id, step::INT AS step, cand::INT AS candidate, CASE WHEN pre > 0 THEN 'decrease' ELSE 'increase' END AS direction FROM a WHERE good AND NOT quiet AND NOT stuck")
def r14(spark, d):
    a = bottleneck.analyze(_windows(spark, d)).where("status = 'suggestion_available'")
    return a.select("id", F.col("policy_step").alias("step"), F.col("candidate_max_num_seqs").alias("candidate"), "direction")


def _by_class(values: dict) -> str:
    return "CASE classification " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items())


@query("r02_recommendations", f"""WITH p AS (SELECT c_custkey AS run, 100.0::DOUBLE + c_nationkey AS low, (100.0::DOUBLE + c_nationkey) * (0.5 + c_custkey % 8) AS high, 10.0::DOUBLE + c_custkey % 90 AS ttft, 100.0::DOUBLE - c_custkey % 90 AS tpot, CASE WHEN c_custkey % 13 = 0 THEN 2 ELSE 20 END AS valid FROM customer),
f AS (SELECT run, valid, high / low / 8 AS eff, ttft / (ttft + tpot) AS dom FROM p),
c AS (SELECT run, CASE WHEN valid < 10 THEN 'inconclusive' WHEN eff < 0.5 AND dom > 0.6 AND dom <= 0.7 THEN 'dispatch-bound' WHEN eff < 0.6 AND dom < 0.4 THEN 'orchestration-bound' WHEN eff > 0.7 THEN 'compute-bound' WHEN dom > 0.7 AND eff < 0.45 THEN 'memory-bound' ELSE 'mixed' END AS classification FROM f)
SELECT run, classification, ({_by_class(diagnose.CONFIDENCE)} ELSE 0 END)::DOUBLE AS confidence, {_by_class(diagnose.RECOMMENDATION)} END AS recommendation FROM c""")  # fmt: skip
def r02(spark, d):
    """Probes at two concurrencies made of customers: every regime occurs."""
    k, few = F.col("c_custkey"), F.when(F.col("c_custkey") % 13 == 0, 1).otherwise(10)
    low = F.lit(100.0) + F.col("c_nationkey")
    level = F.explode(F.array(*[F.struct(F.lit(c).alias("concurrency"), t.alias("throughput")) for c, t in ((1, low), (8, low * (0.5 + k % 8)))])).alias("p")
    probes = table(spark, d, "customer").select(k.alias("run"), level, (10.0 + k % 90).alias("ttft_mean_ms"), (100.0 - k % 90).alias("tpot_mean_ms"), few.alias("valid_count"), few.alias("attempted_count"))
    return diagnose.classify(probes.select("run", "p.*", "ttft_mean_ms", "tpot_mean_ms", "valid_count", "attempted_count"), ["run"]).select("run", "classification", "confidence", "recommendation")


_REASONS = "CASE event_type WHEN 'view' THEN 'length' WHEN 'error' THEN 'abort' WHEN 'signup' THEN 'other' ELSE 'stop' END"
_PARTS = {
    "vllm:request_success_total": "n", "vllm:generation_tokens_total": "n * 3", "vllm:num_preemptions": "CASE WHEN run = 7 AND seq > 2 THEN 0.0 ELSE n END", "vllm:e2e_request_latency_seconds_sum": "s",
    "vllm:e2e_request_latency_seconds_count": "CASE WHEN run <> 5 THEN n END", "vllm:num_requests_running": "d", "vllm:gpu_cache_usage_perc": "d / 100000.0",
}
_LONG = " UNION ALL ".join(f"SELECT run, seq, '{f}' AS family, labels, CASE WHEN '{f}' = 'vllm:request_success_total' THEN reason END AS reason, CAST({v} AS DOUBLE) AS value FROM cum WHERE {v} IS NOT NULL" for f, v in _PARTS.items())


@query("a16_window", f"""WITH q AS (SELECT user_id % 20 AS run, (dayofyear(ts) // 8)::INT AS seq, event_type AS labels, {_REASONS} AS reason, count(*)::DOUBLE AS d, sum(value) AS v FROM events GROUP BY ALL),
cum AS (SELECT run, seq, labels, reason, d, sum(d) OVER w AS n, sum(v) OVER w AS s FROM q WINDOW w AS (PARTITION BY run, labels ORDER BY seq ROWS UNBOUNDED PRECEDING)), long AS ({_LONG}),
ser AS (SELECT run, family, labels, reason, max_by(value, seq) - min_by(value, seq) AS d, count(*) AS n FROM long GROUP BY ALL),
t AS (SELECT run, count(DISTINCT seq) AS observations FROM long GROUP BY run), lost AS (SELECT run, bool_or(n < observations) AS lost FROM ser JOIN t USING (run) GROUP BY run),
gone AS (SELECT run, bool_or(k < observations) AS gone FROM (SELECT run, family, count(DISTINCT seq) AS k FROM long GROUP BY ALL) JOIN t USING (run) GROUP BY run),
c AS (SELECT run, sum(d) FILTER (family LIKE '%success%') AS fin, sum(d) FILTER (family LIKE '%generation%') AS tok, sum(d) FILTER (family LIKE '%preempt%') AS pre, sum(d) FILTER (family LIKE '%_sum') AS s, sum(d) FILTER (family LIKE '%_seconds_count') AS k, sum(d) FILTER (reason IN ('stop', 'length')) AS allowed,
  sum(d) FILTER (reason = 'abort') AS disallowed, coalesce(sum(d) FILTER (reason = 'other'), 0) AS unclassified, count(DISTINCT labels) AS scopes FROM ser GROUP BY run),
g AS (SELECT run, max(v) AS running FROM (SELECT run, seq, sum(value) AS v FROM long WHERE family LIKE '%running' GROUP BY ALL) GROUP BY run), kv AS (SELECT run, max(value) AS kv FROM long WHERE family LIKE '%usage_perc' GROUP BY run),
x AS (SELECT *, 30.0::DOUBLE + run AS elapsed, CASE WHEN observations < 2 THEN 'experimental_metrics_window_invalid' WHEN gone THEN 'metrics_alias_or_availability_changed' WHEN run = 5 THEN 'metrics_histogram_pair_incomplete' WHEN lost THEN 'metrics_series_topology_changed' WHEN run = 7 AND observations > 2 THEN 'metrics_counter_reset' END AS code FROM t JOIN lost USING (run) JOIN gone USING (run) JOIN c USING (run) JOIN g USING (run) JOIN kv USING (run))
SELECT run, elapsed, code, CASE WHEN code IS NULL THEN observations END AS observations, CASE WHEN code IS NULL THEN fin::BIGINT END AS finished, CASE WHEN code IS NULL THEN tok::BIGINT END AS output_tokens, CASE WHEN code IS NULL THEN pre::BIGINT END AS preemptions, CASE WHEN code IS NULL THEN round(fin / elapsed, 6) END AS finished_rate, CASE WHEN code IS NULL THEN round(tok / elapsed, 6) END AS token_rate,
  CASE WHEN code IS NULL THEN round(1000 * s / nullif(k, 0), 4) END AS mean_e2e, CASE WHEN code IS NULL THEN running::BIGINT END AS running, CASE WHEN code IS NULL THEN round(kv, 9) END AS kv, CASE WHEN code IS NULL THEN allowed::BIGINT END AS allowed, CASE WHEN code IS NULL THEN disallowed::BIGINT END AS disallowed, CASE WHEN code IS NULL THEN unclassified::BIGINT END AS unclassified,
  CASE WHEN code IS NULL THEN scopes::INT END AS scopes, CASE WHEN code IS NULL THEN TRUE END AS consistent, CASE WHEN code IS NULL THEN 7 END AS sources, CASE WHEN code IS NULL THEN 'e2e=' || k::BIGINT END AS observed, CAST(NULL AS DOUBLE) AS mean_ttft, CAST(NULL AS BIGINT) AS prompt_tokens FROM x""")  # fmt: skip
def a16(spark, d):
    """Cumulative counts of events by eight days as exporter snapshots: run 5 loses a histogram's counts, run 7 resets a counter."""
    e = table(spark, d, "events")
    q = e.groupBy((F.col("user_id") % 20).alias("run"), F.floor(F.dayofyear("ts") / 8).cast("int").alias("seq"), F.col("event_type").alias("labels"), F.expr(_REASONS).alias("reason")).agg(F.count("*").cast("double").alias("d"), F.sum("value").alias("v"))
    w = Window.partitionBy("run", "labels").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    cum = q.select("run", "seq", "labels", "reason", "d", F.sum("d").over(w).alias("n"), F.sum("v").over(w).alias("s"))
    parts = F.array(*[F.struct(F.lit(f).alias("family"), F.expr(f"CAST({v} AS DOUBLE)").alias("value")) for f, v in _PARTS.items()])
    long = cum.select("run", "seq", "labels", "reason", F.inline(parts)).where("value is not null").withColumn("reason", F.when(F.col("family") == "vllm:request_success_total", F.col("reason")))
    elapsed = e.select((F.col("user_id") % 20).alias("run")).distinct().withColumn("elapsed_seconds", F.lit(30.0) + F.col("run"))
    got = windows.assemble(long, elapsed, ["run"])
    return got.select(
        "run", F.col("elapsed_seconds").alias("elapsed"), "code", "observations", F.col("requests_finished").alias("finished"), "output_tokens", "preemptions", r6("finished_requests_per_second").alias("finished_rate"), r6("output_tokens_per_second").alias("token_rate"),
        F.round("mean_e2e_ms", 4).alias("mean_e2e"), F.col("max_requests_running").alias("running"), F.round("max_kv_cache_usage_fraction", 9).alias("kv"), F.col("allowed_finished_requests").alias("allowed"), F.col("disallowed_finished_requests").alias("disallowed"), F.col("unclassified_finished_requests").alias("unclassified"),
        F.col("metric_scope_count").alias("scopes"), F.col("metric_scope_consistent").alias("consistent"), F.size("source_families").alias("sources"), F.array_join(F.transform("histogram_observation_counts", lambda p: F.concat(p["key"], F.lit("="), p["n"])), ",").alias("observed"), F.col("mean_ttft_ms").alias("mean_ttft"), "prompt_tokens",
    )


_GOLDEN = """q AS (SELECT s_suppkey AS id, c, p, b, 1000 + (s_suppkey * 7 + p * 3 + b * 5) % (CASE WHEN (s_suppkey + c) % 7 = 0 THEN 400 ELSE 40 END) AS tokens, 100.0 + CASE WHEN p % 2 = 1 THEN (s_suppkey % 9 - 4) * 3.0 ELSE 0.0 END + (s_suppkey * c * p) % 3 * 0.1 AS rate, 640.0 + (s_suppkey * 13 + p * 11 + c) % 170 AS bound
  FROM supplier, {positions}, {blocks}, {loads})"""


@query("r10_golden_decision", f"""WITH {_GOLDEN.format(positions="(SELECT unnest(range(6)) AS p)", blocks="(SELECT unnest(range(1, 4)) AS b)", loads="(SELECT unnest([1, 4]) AS c)")},
w AS (SELECT id, c, {", ".join(f"max(rate::DOUBLE) FILTER (p = {i}) AS p{i}" for i in range(6))}, sum(tokens) FILTER (p % 2 = 1) AS tc, sum(tokens) FILTER (p % 2 = 0) AS tb, max(bound) AS bound FROM q GROUP BY ALL),
ps AS (SELECT id, c, (max(t) - min(t)) / max(t) AS ps FROM (SELECT id, c, p, sum(tokens) AS t FROM q GROUP BY ALL) GROUP BY ALL), bs AS (SELECT id, c, max(s) AS bs FROM (SELECT id, c, b, (max(tokens) - min(tokens)) / max(tokens) AS s FROM q GROUP BY ALL) GROUP BY ALL),
d AS (SELECT *, (p1 / ((p0 + p2) / 2) - 1) * 100 AS x, ((p3 + p5) / 2 / p4 - 1) * 100 AS y, abs(tc - tb) / greatest(tc, tb) <= 0.05 AND ps <= 0.05 AND bs <= 0.05 AND bound <= 800 AS fit FROM w JOIN ps USING (id, c) JOIN bs USING (id, c)),
e AS (SELECT *, (x + y) / 2 AS est, (x + y) / 2 - 12.706 * abs(x - y) / 2 AS low, (x + y) / 2 + 12.706 * abs(x - y) / 2 AS high FROM d),
o AS (SELECT *, CASE WHEN fit AND low > 1e-9 THEN 'candidate_higher_throughput' WHEN fit AND high < -1e-9 THEN 'baseline_higher_throughput' END AS outcome FROM e),
r AS (SELECT id, count(*) AS conditions, count(outcome) = count(*) AND count(DISTINCT outcome) = 1 AS ok, min(outcome) AS outcome, min_by(est, c) AS est, min_by(low, c) AS low, min_by(high, c) AS high FROM o GROUP BY id)
SELECT id, conditions, CASE WHEN ok THEN 'supported' ELSE 'inconclusive' END AS decision_state, ok AS decision_eligible, CASE WHEN ok THEN outcome END AS overall_outcome, CASE WHEN ok THEN CASE WHEN outcome LIKE 'c%' THEN 'candidate' ELSE 'baseline' END END AS winner,
  CASE WHEN ok THEN CASE WHEN outcome LIKE 'c%' THEN 16 ELSE 8 END END AS winner_value, CASE WHEN ok THEN round(est, 5) END AS estimate, CASE WHEN ok THEN round(low, 4) END AS low, CASE WHEN ok THEN round(high, 4) END AS high FROM r""")  # fmt: skip
def r10_decision(spark, d):
    """Six-run sequences made of suppliers: some with unlike tokens, missed SLOs or intervals that include zero."""
    ids = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    spread = ids.select("id", F.explode(F.array(F.lit(1), F.lit(4))).alias("c")).select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("p")).select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("b"))
    q = spread.select(
        "id", "c", position("p").alias("position"), F.col("b").alias("block_index"), (1000 + (F.col("id") * 7 + F.col("p") * 3 + F.col("b") * 5) % F.when((F.col("id") + F.col("c")) % 7 == 0, 400).otherwise(40)).alias("completion_tokens"),
        (100.0 + F.when(F.col("p") % 2 == 1, (F.col("id") % 9 - 4) * 3.0).otherwise(0.0) + (F.col("id") * F.col("c") * F.col("p")) % 3 * 0.1).alias("rate"), (640.0 + (F.col("id") * 13 + F.col("p") * 11 + F.col("c")) % 170).alias("e2e_p95_high"),
    )
    contrasts = compare.phase_contrasts(q.select("id", "c", "position", "rate"), ["id", "c"])
    conditions = reports.golden_conditions(contrasts, q, ["id", "c"], q, e2e_ms=800.0)
    got = reports.golden_decision(conditions, ["id"], "c", F.lit(8), F.lit(16))
    return got.select("id", "conditions", "decision_state", "decision_eligible", "overall_outcome", "winner", "winner_value", F.round("estimate", 5).alias("estimate"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


_STAGES = ("signup", "view", "click", "purchase")


@query("a21_funnel", "WITH s AS (SELECT user_id, max(list_position(['signup', 'view', 'click', 'purchase'], event_type)) AS r FROM events WHERE event_type <> 'error' GROUP BY user_id) SELECT ['signup', 'view', 'click', 'purchase'][r] AS stage, count(*) AS organizations FROM s GROUP BY r")
def a21(spark, d):
    return files.funnel(table(spark, d, "events"), "user_id", "event_type", _STAGES)


@query("t01_finite", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events")
def t01(spark, d):
    k = F.col("event_id")
    odd = F.when(k % 3 == 1, F.lit(float("nan"))).when(k % 3 == 2, F.lit(float("inf"))).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", stats.finite(odd).alias("v"))


@query("a05_latency_summary", "SELECT event_type, count(value) AS n, round(avg(value * 1000.0), 4) AS mean, round(quantile_cont(value * 1000.0, 0.99), 4) AS p99 FROM events GROUP BY event_type")
def a05(spark, d):
    got = stats.summaries_ms(table(spark, d, "events"), ["event_type"], {"s": F.col("value")})
    return got.select("event_type", F.col("s.count").alias("n"), F.round("s.mean", 4).alias("mean"), F.round("s.p99", 4).alias("p99"))


@query("u06_ordered_distinct", f"WITH {RL}, f AS (SELECT user_id, event_type, min(event_id) AS a FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY a) AS kinds FROM f GROUP BY user_id")
def u06(spark, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_distinct(ordered), ",").alias("kinds"))


@query("u07_json_keys", "SELECT conv_id, turn, len(list_distinct(string_split(text, ' '))) AS n_keys, (conv_id + turn) % 3 <> 0 OR len(list_distinct(string_split(text, ' '))) = 0 AS same FROM conversations")
def u07(spark, d):
    """Objects with the words of a text as keys, in two orders, a third of them with a word left out."""
    words = F.array_distinct(F.split("text", " "))
    c = table(spark, d, "conversations").select("conv_id", "turn", words.alias("w"))
    less = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.slice("w", 2, F.size("w"))).otherwise(F.col("w"))
    body = lambda w: F.to_json(F.map_from_arrays(w, F.transform(w, lambda x: F.length(x))))
    keys = lambda j: F.array_sort(F.json_object_keys(j))
    return c.select("conv_id", "turn", F.size(keys(body(F.col("w")))).alias("n_keys"), (keys(body(F.col("w"))) == keys(body(F.reverse(less)))).alias("same"))


@query("f02_jaccard", r"WITH p AS (SELECT conv_id, turn, list_distinct(regexp_split_to_array(lower(text), '\s+')) AS w FROM conversations), l AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM p) SELECT conv_id, turn, round(len(list_intersect(w, q)) / len(list_distinct(list_concat(w, q))), 6) AS j FROM l WHERE q IS NOT NULL")
def f02(spark, d):
    w = F.array_distinct(F.split(F.lower("text"), r"\s+"))
    p = table(spark, d, "conversations").select("conv_id", "turn", w.alias("w")).withColumn("q", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn")))
    return p.where("q is not null").select("conv_id", "turn", r6(text.jaccard(F.col("w"), F.col("q"))).alias("j"))


@query("f09_scope_keys", """SELECT event_id, '{"meta": {"x": ' || event_id % 2 || ', "y": "' || event_id % 2 || '"}, "model": "m' || event_id % 3 || '", "temperature": ' || CASE WHEN event_id % 5 = 0 THEN '"0"' ELSE '0' END || '}' AS scope FROM events""")
def f09(spark, d):
    two, zero = (F.col("event_id") % 2).cast("string"), F.when(F.col("event_id") % 5 == 0, '"0"').otherwise("0")
    parts = ['{"stream":true,"temperature":', zero, ',"messages":[1],"model":"m', (F.col("event_id") % 3).cast("string"), '","meta":{"y":"', two, '","x":', two, "}}"]
    body = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    return table(spark, d, "events").select("event_id", text.scope_key(body).alias("scope"))


@query("f14_utf8", "SELECT doc_id, strlen(text) AS bytes FROM documents")
def f14(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"))


@query("k06_sorted_reasons", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN lang <> 'en' THEN 'other_language' END, CASE WHEN length(text) > 2000 THEN 'long_text' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'holds_digits' END, CASE WHEN length(text) > 5000 THEN 'long_text' END, CASE WHEN source IS NULL THEN 'absent_source' END, CASE WHEN contains(text, '@') THEN 'an_address' END], lambda x: x IS NOT NULL))), ',') AS reasons FROM documents")
def k06(spark, d):
    n, t = F.length("text"), F.col("text")
    why = stats.reasons((F.col("lang") != "en", "other_language"), (n > 2000, "long_text"), (t.rlike("[0-9]"), "holds_digits"), (n > 5000, "long_text"), (F.col("source").isNull(), "absent_source"), (t.contains("@"), "an_address"))
    return table(spark, d, "documents").select("doc_id", F.array_join(why, ",").alias("reasons"))
