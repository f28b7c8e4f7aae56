"""Registered queries of comparisons, rules, text functions, set checks and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.functions import stats, text
from loadlens.operators import bottleneck, compare, diagnose, responses, runs, sampling, similarity, windows
from loadlens.plans.queries import query, r6
from loadlens.plans.views import RL, SAMPLES, T, blocks_sql, ci, request_log, samples, spread_by, table
from loadlens.sources import files
from loadlens.streaming import cache

POS = ["B1", "C1", "B2", "C2", "B3", "C3"]
_pos = "['B1', 'C1', 'B2', 'C2', 'B3', 'C3'][position_idx + 1]"


def position(c: str = "position_idx") -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in POS]), F.col(c) + 1)


def _rates(spark, d, keys) -> DataFrame:
    return runs.metrics(request_log(spark, d), keys, percentiles=False)


# --- matching and comparison -------------------------------------------------------------------------------------------


def _sides(spark, d, keys) -> tuple[DataFrame, DataFrame]:
    m = _rates(spark, d, [*keys, "position_idx"])
    return m.where("position_idx = 0 and not (concurrency = 8)"), m.where("position_idx = 1 and not (concurrency = 1)")


@query("j01_condition_match", f"WITH {RL}, b AS ({blocks_sql('concurrency, position_idx')}), l AS (SELECT * FROM b WHERE position_idx = 0 AND concurrency <> 8), r AS (SELECT * FROM b WHERE position_idx = 1 AND concurrency <> 1) SELECT coalesce(l.concurrency, r.concurrency) AS concurrency, CASE WHEN r.concurrency IS NULL THEN 'left' WHEN l.concurrency IS NULL THEN 'right' ELSE 'both' END AS side, l.completion_tokens AS tokens_l, r.completion_tokens AS tokens_r FROM l FULL JOIN r ON l.concurrency = r.concurrency")
def j01(spark, d):
    left, right = _sides(spark, d, ["concurrency"])
    return compare.matched(left, right, ["concurrency"], ["completion_tokens"]).select("concurrency", "side", F.col("completion_tokens_l").alias("tokens_l"), F.col("completion_tokens_r").alias("tokens_r"))


@query("u02_condition_sets_equal", f"WITH {RL}, l AS (SELECT DISTINCT concurrency, block_index FROM g WHERE position_idx = 0), r AS (SELECT DISTINCT concurrency, block_index FROM g WHERE position_idx = 1 AND concurrency <> 1) SELECT 'left' AS side, * FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT 'right', * FROM (SELECT * FROM r EXCEPT SELECT * FROM l)")
def u02(spark, d):
    c = request_log(spark, d)
    left, right = (c.where(w).select("concurrency", "block_index").distinct() for w in ("position_idx = 0", "position_idx = 1 and concurrency <> 1"))
    return left.exceptAll(right).select(F.lit("left").alias("side"), "*").unionByName(right.exceptAll(left).select(F.lit("right").alias("side"), "*"))


@query("r07_compare", f"""WITH {RL}, b AS ({blocks_sql("concurrency, position_idx, block_index")}),
p AS (SELECT l.concurrency, l.block_index, l.completion_tokens AS tl, r.completion_tokens AS tr, abs(l.completion_tokens - r.completion_tokens) / greatest(l.completion_tokens, r.completion_tokens) AS bd, (r.output_tokens_per_second / l.output_tokens_per_second - 1) * 100 AS delta
  FROM b l JOIN b r ON l.concurrency = r.concurrency AND l.block_index = r.block_index AND l.position_idx = 0 AND r.position_idx = 1),
c AS (SELECT concurrency, abs(sum(tl) - sum(tr)) / greatest(sum(tl), sum(tr)) AS td, max(bd) AS bd, avg(delta) AS e, {ci("delta", "low")} AS low, {ci("delta", "high")} AS high FROM p GROUP BY concurrency),
x AS (SELECT *, CASE WHEN td > 0.05 THEN 'completion_tokens_outside_5_percent_tolerance' WHEN bd > 0.05 THEN 'one_or_more_block_pairs_outside_5_percent_completion_token_tolerance' END AS why FROM c)
SELECT concurrency, why IS NULL AS available, round(td, 6) AS token_difference, round(bd, 6) AS block_difference, CASE WHEN why IS NULL THEN round(e, 6) END AS estimate, CASE WHEN why IS NULL THEN round(low, 6) END AS low, CASE WHEN why IS NULL THEN round(high, 6) END AS high,
  CASE WHEN why IS NULL AND low > 0 THEN 'candidate_higher_throughput' WHEN why IS NULL AND high < 0 THEN 'baseline_higher_throughput' END AS outcome, CASE WHEN why IS NULL AND (low > 0 OR high < 0) THEN 'supported' ELSE 'inconclusive' END AS state,
  CASE WHEN why IS NOT NULL THEN why WHEN low > 0 OR high < 0 THEN NULL ELSE 'paired_block_ci_includes_zero' END AS reason FROM x""")  # fmt: skip
def r07(spark, d):
    b = _rates(spark, d, ["concurrency", "position_idx", "block_index"])
    got = compare.compare_blocks(b.where("position_idx = 0"), b.where("position_idx = 1"), ["concurrency"])
    return got.select("concurrency", "available", r6("token_difference").alias("token_difference"), r6("block_difference").alias("block_difference"), r6("estimate").alias("estimate"), r6("low").alias("low"), r6("high").alias("high"), "outcome", "state", "reason")


@query("t08_paired_interval", f"""WITH {RL}, b AS ({blocks_sql("concurrency, position_idx, block_index")}), p AS (SELECT l.concurrency, (r.output_tokens_per_second / l.output_tokens_per_second - 1) * 100 AS delta FROM b l JOIN b r ON l.concurrency = r.concurrency AND l.block_index = r.block_index AND l.position_idx = 2 AND r.position_idx = 3)
SELECT concurrency, count(*) AS n, round(avg(delta), 6) AS estimate, round({ci("delta", "low")}, 6) AS low, round({ci("delta", "high")}, 6) AS high FROM p GROUP BY concurrency""")  # fmt: skip
def t08(spark, d):
    b = _rates(spark, d, ["concurrency", "position_idx", "block_index"])
    pairs = compare.matched(b.where("position_idx = 2"), b.where("position_idx = 3"), ["concurrency", "block_index"], ["output_tokens_per_second"])
    got = pairs.groupBy("concurrency").agg(stats.t_interval(stats.relative_delta_percent("output_tokens_per_second_r", "output_tokens_per_second_l")).alias("ci"))
    return got.select("concurrency", F.col("ci.n").alias("n"), r6("ci.mean").alias("estimate"), r6("ci.low").alias("low"), r6("ci.high").alias("high"))


@query("t10_phase_contrasts", f"""WITH {RL}, b AS ({blocks_sql("concurrency, position_idx, block_index")}), m AS (SELECT concurrency, {_pos} AS position, avg(output_tokens_per_second) AS rate FROM b GROUP BY ALL),
w AS (SELECT concurrency, max(rate) FILTER (position = 'B1') AS b1, max(rate) FILTER (position = 'C1') AS c1, max(rate) FILTER (position = 'B2') AS b2, max(rate) FILTER (position = 'C2') AS c2, max(rate) FILTER (position = 'B3') AS b3, max(rate) FILTER (position = 'C3') AS c3 FROM m GROUP BY concurrency),
c AS (SELECT concurrency, (c1 / ((b1 + b2) / 2) - 1) * 100 AS x, ((c2 + c3) / 2 / b3 - 1) * 100 AS y FROM w)
SELECT concurrency, round(x, 6) AS contrast_1, round(y, 6) AS contrast_2, round((x + y) / 2, 6) AS estimate, round((x + y) / 2 - 12.706 * abs(x - y) / 2, 5) AS low, round((x + y) / 2 + 12.706 * abs(x - y) / 2, 5) AS high FROM c""")  # fmt: skip
def t10(spark, d):
    b = _rates(spark, d, ["concurrency", "position_idx", "block_index"])
    rates = b.groupBy("concurrency", position().alias("position")).agg(F.avg("output_tokens_per_second").alias("rate"))
    got = compare.phase_contrasts(rates, ["concurrency"])
    return got.select("concurrency", r6("contrast_1").alias("contrast_1"), r6("contrast_2").alias("contrast_2"), r6("estimate").alias("estimate"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query("j03_six_positions", f"WITH {RL}, m AS (SELECT concurrency, {_pos} AS position, count(*) AS n FROM g GROUP BY ALL) SELECT concurrency, " + ", ".join(f"max(n) FILTER (position = '{p}') AS {p.lower()}" for p in POS) + " FROM m GROUP BY concurrency")
def j03(spark, d):
    wide = request_log(spark, d).withColumn("position", position()).groupBy("concurrency").pivot("position", POS).count()
    return wide.select("concurrency", *[F.col(p).alias(p.lower()) for p in POS])


#: Faults of a six-run sequence, each in the sequences whose number the first figure divides: code, and the column, positions and value that bring it about.
_FAULTS = (
    (3, "model_revision_is_not_immutable", "model_immutable_revision", None, "'main'"), (4, "server_version_missing", "engine_server_version", None, "'unknown'"), (5, "golden_protocol_requires_streaming", "stream", None, "false"),
    (6, "golden_protocol_requires_strict_native_completion_validation", "engine_backend", None, "'other'"), (7, "effective_engine_flags_not_runtime_verified", "flags_provenance", 4, "'operator_attested'"), (8, "all_six_runs_must_be_live_inference", "evidence_source", 6, "'synthetic_validation'"),
    (9, "cache_policy_must_be_explicit", "workload_cache_policy", None, "'unknown'"), (10, "golden_protocol_requires_separate_warmup_requests", "warmup_requests", None, "0"), (11, "warmup_workload_not_proven_separate", "warmup_separate", 2, "null"), (13, "warmup_prompts_not_disjoint_from_measured_workload", "warmup_disjoint", 3, "false"),
    (14, "sequence_must_be_baseline_candidate_baseline_then_candidate_baseline_candidate", "variant", 5, "'candidate'"), (15, "sequence_position_labels_must_be_B1_C1_B2_C2_B3_C3", "position", 1, "'C1'"), (16, "uncontrolled_or_missing_workload_seed", "workload_seed", 2, "'9'"), (17, "uncontrolled_or_missing_runtime_gpu", "runtime_gpu", 5, "null"),
    (18, "uncontrolled_or_missing_runtime_accelerator", "runtime_accelerator", 5, "'x'"), (19, "runs_overlap_or_are_out_of_order", "started_at", 4, "25.0"), (21, "condition_sets_do_not_match", "other_id", 2, "'closed_loop:99'"), (22, "chunked_prefill_must_not_be_the_treatment", "chunked", 6, "'true'"),
    (23, "traffic_does_not_reach_declared_closed_loop_concurrency", "peak", 3, "7"), (26, "golden_measured_blocks_must_attempt_declared_concurrency", "attempted", 2, "5"), (27, "golden_requests_per_block_must_reach_declared_concurrency", "requests_per_block", None, "7"),
)
_FAULT = {code: f"id % {every} = 0" for every, code, *_ in _FAULTS}
_FLAGS_MOVE = _FAULT["chunked_prefill_must_not_be_the_treatment"]
_LONE = "id % 29 = 0"
_FAULT |= {
    "candidate_effective_flags_changed_between_repeats": _FLAGS_MOVE, "golden_treatment_must_only_change_max_num_seqs": "id % 12 = 0", "golden_treatment_requires_distinct_max_num_seqs_values": "id % 12 = 0",
    "golden_concurrency_must_reach_both_max_num_seqs_values": "id % 8 + 1 + id % 12 > 8 AND NOT id % 21 = 0", "golden_treatment_requires_one_common_closed_loop_concurrency": "id % 21 = 0",
}
for _code in ("traffic_does_not_reach_declared_closed_loop_concurrency", "golden_measured_blocks_must_attempt_declared_concurrency", "golden_requests_per_block_must_reach_declared_concurrency"):
    _FAULT[_code] += " AND NOT id % 21 = 0"


#: Sequences of about 8 kB, which one task sorts.
SEQUENCES_A_TASK = 1 << 14


@query("r08_protocol", f"""SELECT id, CASE WHEN id % 31 = 0 THEN 'golden_sequence_requires_exactly_six_runs' WHEN {_LONE} THEN 'run_3_partial_or_failed_report' WHEN id % 25 = 0 THEN 'engine_flags_malformed'
ELSE array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN {when} THEN '{code}' END" for code, when in _FAULT.items())}], lambda x: x IS NOT NULL)), ',') END AS reasons FROM (SELECT p_partkey AS id FROM part)""")
def r08(spark, d):
    found = {column: F.expr(f"id % {every} = 0" + (f" and position_no = {at}" if at else "")) for every, _, column, at, _ in _FAULTS}
    value = {column: F.expr(v) for *_, column, _, v in _FAULTS}
    put = lambda column, usual: F.when(found[column], value[column]).otherwise(usual) if column in found else usual
    no = F.col("position_no")
    usual = {"model_immutable_revision": F.lit("a" * 40), "engine_backend": F.lit("native"), "manifest_version": F.lit(compare.MANIFEST_NOW)}
    controlled = {p: put(p, usual.get(p, F.lit("1"))) for p in (*compare.CONTROLLED, *compare.CONTROLLED_NOW)}
    seqs = F.col("id") % 8 + 1 + F.when(no % 2 == 0, F.col("id") % 12).otherwise(0)
    flags = F.map_filter(F.create_map(F.lit("Max_Num_Seqs"), seqs.cast("string"), F.lit("enable_chunked_prefill"), put("chunked", F.lit("false")), F.lit("max_num_seqs"), F.when(F.col("id") % 25 == 0, "1")), lambda _, v: v.isNotNull())
    load = F.struct(put("other_id", F.lit("closed_loop:8")).alias("id"), F.lit("closed_loop").alias("kind"), F.lit(8).alias("value"), F.lit(8).alias("max_in_flight"), put("peak", F.lit(8)).alias("peak"), F.array(F.lit(8), put("attempted", F.lit(9))).alias("attempted"))
    made = {
        "position": put("position", F.element_at(F.array(*[F.lit(p) for p in POS]), no)), "variant": put("variant", F.when(no % 2 == 1, "baseline").otherwise("candidate")), "started_at": put("started_at", (no * 10.0).cast("double")), "completed_at": (no * 10.0 + 8).cast("double"),
        "preflight": F.when((F.col("id") % 29 == 0) & (no == 3), "partial_or_failed_report"), "controlled": F.create_map(*[x for k, v in controlled.items() for x in (F.lit(k), v)]), "flags_provenance": put("flags_provenance", F.lit("runtime_verified")), "evidence_source": put("evidence_source", F.lit("live_inference")),
        "stream": put("stream", F.lit(True)), "warmup_requests": put("warmup_requests", F.lit(5)), "warmup_separate": put("warmup_separate", F.lit(True)), "warmup_disjoint": put("warmup_disjoint", F.lit(True)), "flags": flags, "requests_per_block": put("requests_per_block", F.lit(20)), "conditions": F.array(load),
    }
    ids = spread_by(table(spark, d, "part").select(F.col("p_partkey").alias("id")), "id", SEQUENCES_A_TASK)
    seq = ids.select("id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("position_no")).where("not (id % 31 = 0 and position_no = 6)")
    got = compare.protocol_reasons(seq.select("id", "position_no", *[c.alias(n) for n, c in made.items()]), ["id"])
    return got.select("id", F.array_join("reasons", ",").alias("reasons"))


#: Flags of two runs, derived from the parts table: half of the candidate's values differ, some names exist on one side.
def _flags(spark, d):
    p = table(spark, d, "part").select(F.pmod("p_partkey", F.lit(50)).alias("run"), F.concat(F.lit("Max_"), F.pmod(F.expr("p_partkey div 50"), F.lit(4)).cast("string")).alias("name"), F.col("p_size"))
    one = p.groupBy("run", "name").agg(F.min("p_size").alias("v"))
    left = one.where("v % 5 <> 0").select("run", "name", F.col("v").cast("string").alias("value"))
    right = one.where("v % 7 <> 0").select("run", "name", (F.col("v") + F.when(F.col("v") % 2 == 0, 1).otherwise(0)).cast("string").alias("value"))
    return left, right


_FLAGS = """f AS (SELECT p_partkey % 50 AS run, 'max-' || (p_partkey // 50) % 4 AS name, min(p_size) AS v FROM part GROUP BY ALL), l AS (SELECT run, name, v::VARCHAR AS value FROM f WHERE v % 5 <> 0), r AS (SELECT run, name, (v + CASE WHEN v % 2 = 0 THEN 1 ELSE 0 END)::VARCHAR AS value FROM f WHERE v % 7 <> 0),
x AS (SELECT coalesce(l.run, r.run) AS run, coalesce(l.name, r.name) AS name, l.value AS a, r.value AS b FROM l FULL JOIN r ON l.run = r.run AND l.name = r.name WHERE l.value IS DISTINCT FROM r.value)"""


@query("j05_flag_diff", f"WITH {_FLAGS} SELECT run, name, a AS left_value, b AS right_value FROM x")
def j05(spark, d):
    left, right = (s.withColumn("name", text.flag_name("name")) for s in _flags(spark, d))
    return compare.changed(left, right, ["run", "name"], "value").select("run", "name", F.col("value_l").alias("left_value"), F.col("value_r").alias("right_value"))


@query("r06_attribution", f"""WITH {_FLAGS}, n AS (SELECT run, string_agg(replace(name, 'max-1', 'max-num-seqs'), ',' ORDER BY replace(name, 'max-1', 'max-num-seqs')) AS names, count(*) AS k FROM x GROUP BY run),
s AS (SELECT f.run, names, coalesce(k, 0) AS k, max(l.value::INT) FILTER (l.name = 'max-1') AS lv, max(r.value::INT) FILTER (r.name = 'max-1') AS rv FROM f LEFT JOIN n ON f.run = n.run LEFT JOIN l ON f.run = l.run AND f.name = l.name LEFT JOIN r ON f.run = r.run AND f.name = r.name GROUP BY f.run, names, k),
y AS (SELECT *, CASE WHEN k = 0 THEN 'no_treatment_difference_declared' WHEN names = 'max-num-seqs' AND (lv IS NULL OR rv IS NULL) THEN 'max_num_seqs_values_not_verifiable' WHEN names = 'max-num-seqs' AND (lv = rv OR least(lv, rv) <= 0) THEN 'max_num_seqs_values_not_meaningfully_different'
   WHEN names = 'max-num-seqs' AND greatest(lv, rv) > 20 THEN 'max_num_seqs_change_not_exercised_by_load' WHEN k > 1 THEN 'multiple_engine_flags_changed' ELSE 'one_engine_flag_changed; causality is still not claimed' END AS reason FROM s)
SELECT run, reason, CASE WHEN reason = 'multiple_engine_flags_changed' THEN 'confounded' WHEN reason LIKE 'one_engine_flag%' THEN 'controlled_difference_declared' ELSE 'unattributable' END AS state FROM y""")  # fmt: skip
def r06(spark, d):
    named = lambda s: s.withColumn("name", F.replace(text.flag_name("name"), F.lit("max-1"), F.lit("max-num-seqs")))
    left, right = (named(s) for s in _flags(spark, d))
    all_runs = table(spark, d, "part").select(F.pmod("p_partkey", F.lit(50)).alias("run")).distinct()
    names = compare.changed(left, right, ["run", "name"], "value").groupBy("run").agg(F.array_sort(F.collect_list("name")).alias("names"))
    limit = lambda s, c: s.where("name = 'max-num-seqs'").select("run", text.canonical_positive_int("value").alias(c))
    got = all_runs.join(names, "run", "left").join(limit(left, "lv"), "run", "left").join(limit(right, "rv"), "run", "left")
    state, reason = compare.attribution(F.coalesce("names", F.array().cast("array<string>")), F.col("lv"), F.col("rv"), F.lit(20), F.lit(20))
    return got.select("run", reason.alias("reason"), state.alias("state"))


@query("j04_path_diff", "WITH a AS (SELECT s_suppkey AS run, s_nationkey AS x, s_name AS y FROM supplier), l AS (SELECT run, 'nation' AS path, x::VARCHAR AS value FROM a UNION ALL SELECT run, 'name', y FROM a), r AS (SELECT run, 'nation' AS path, (CASE WHEN x % 3 = 0 THEN x + 1 ELSE x END)::VARCHAR AS value FROM a UNION ALL SELECT run, 'name', CASE WHEN x % 4 = 0 THEN NULL ELSE y END FROM a) SELECT run, path, l.value AS l, r.value AS r FROM l JOIN r USING (run, path) WHERE l.value IS DISTINCT FROM r.value")
def j04(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("run"), F.col("s_nationkey").alias("x"), F.col("s_name").alias("y"))
    long = lambda x, y: a.select("run", F.explode(F.create_map(F.lit("nation"), x.cast("string"), F.lit("name"), y)).alias("path", "value"))
    right = long(F.when(F.col("x") % 3 == 0, F.col("x") + 1).otherwise(F.col("x")), F.when(F.col("x") % 4 != 0, F.col("y")))
    return compare.changed(long(F.col("x"), F.col("y")), right, ["run", "path"], "value").select("run", "path", F.col("value_l").alias("l"), F.col("value_r").alias("r"))


# --- regimes and rules ---------------------------------------------------------------------------------------------------


@query("r01_regime", f"""WITH {RL}, p AS (SELECT user_id % 20 AS run, concurrency, count(*) AS attempted, count(*) FILTER (ok) AS valid, sum(completion_tokens) FILTER (gpu) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0) AS tp, avg(ttft_seconds * 1000.0) FILTER (gpu) AS ttft, avg((e2e_seconds - ttft_seconds) * 1000.0) FILTER (gpu) AS tpot FROM g GROUP BY ALL),
f AS (SELECT run, sum(valid) AS v, sum(attempted) AS a, count(*) FILTER (valid > 0 AND tp IS NOT NULL) AS n, max_by(tp, concurrency) / greatest(min_by(tp, concurrency), 0.001::DOUBLE) / (max(concurrency) / min(concurrency)) AS eff, avg(ttft) / (avg(ttft) + avg(tpot)) AS dom, stddev_samp(tpot) / avg(tpot) AS cv, stddev_samp(ttft) / avg(ttft) AS tcv FROM p GROUP BY run)
SELECT run, CASE WHEN v < 10 OR (a - v) / a > 0.5 OR cv > 1 OR tcv > 1 THEN 'inconclusive' WHEN eff < 0.5 AND dom > 0.6 AND dom <= 0.7 THEN 'dispatch-bound' WHEN eff < 0.6 AND dom < 0.4 THEN 'orchestration-bound' WHEN cv < 0.25 AND eff > 0.7 THEN 'compute-bound' WHEN dom > 0.7 AND eff < 0.45 THEN 'memory-bound' ELSE 'mixed' END AS classification, round(eff, 3) AS scaling_efficiency, round(dom, 3) AS ttft_dominance, round(cv, 3) AS tpot_cv FROM f""")  # fmt: skip
def r01(spark, d):
    log = request_log(spark, d).withColumn("run", F.col("user_id") % 20).withColumn("tpot_seconds", F.when(runs.generated(), F.col("e2e_seconds") - F.col("ttft_seconds")))
    m = runs.metrics(log, ["run", "concurrency"], percentiles=False)
    tpot = log.groupBy("run", "concurrency").agg(F.avg(F.col("tpot_seconds") * 1000.0).alias("tpot_mean_ms"))
    probes = m.join(tpot, ["run", "concurrency"]).select("run", "concurrency", F.col("output_tokens_per_second").alias("throughput"), F.col("ttft_ms.mean").alias("ttft_mean_ms"), "tpot_mean_ms", F.col("valid").alias("valid_count"), F.col("attempted").alias("attempted_count"))
    return diagnose.classify(probes, ["run"]).select("run", "classification", "scaling_efficiency", "ttft_dominance", "tpot_cv")


def _windows(spark, d, source: str = "orders", key: str = "o_orderkey") -> DataFrame:
    """Windows made of orders (or another table): every rule is met by some and broken by others."""
    k = F.col(key)
    m = lambda a, b: (k * a) % b
    o = table(spark, d, source)
    w = o.select(
        k.alias("id"), (4.0 + m(1, 9)).alias("elapsed_seconds"), (4 + m(3, 11)).cast("int").alias("observations"), (28 + m(5, 40)).alias("requests_finished"), F.when(m(1, 31) != 0, m(7, 5) * 0 + F.when(m(1, 4) == 0, 3).otherwise(0)).cast("long").alias("preemptions"),
        F.when(m(1, 17) == 0, "operator_attested").otherwise("runtime_verified").alias("flags_provenance"), F.when(m(1, 19) == 0, "unconfirmed").otherwise("operator_attested_exclusive").alias("traffic_scope"), F.when(m(1, 23) == 0, 1).otherwise(0).alias("failed_requests"),
        (m(1, 12) + 1).cast("int").alias("max_num_seqs"), F.lit(2048).alias("max_num_batched_tokens"), (m(1, 12) + 1 + m(11, 6)).cast("int").alias("offered_concurrency"), (m(13, 20) / 20.0 + 0.04).alias("max_kv_cache_usage_fraction"),
    )
    i = F.col("id")
    return w.withColumns({
        "successful_requests": F.col("requests_finished"), "allowed_finished_requests": F.col("requests_finished") - F.when(i % 29 == 0, 1).otherwise(0), "disallowed_finished_requests": F.when(i % 29 == 0, 1).otherwise(0).cast("long"), "unclassified_finished_requests": F.lit(0).cast("long"),
        "output_tokens": F.col("requests_finished") * 10, "prompt_tokens": F.lit(None).cast("long"), "prompt_tokens_per_second": F.lit(None).cast("double"), "finished_requests_per_second": F.col("requests_finished") / F.col("elapsed_seconds"), "output_tokens_per_second": F.col("requests_finished") * 10 / F.col("elapsed_seconds"),
        "mean_queue_time_ms": (i % 40 * 10).cast("double"), "mean_ttft_ms": (i % 40 * 10 + 20).cast("double"), "mean_e2e_ms": F.lit(1000.0), "max_requests_running": F.col("max_num_seqs") - F.when(i % 8 == 0, 1).otherwise(0), "max_requests_waiting": F.when(i % 3 == 0, 0).otherwise(F.col("offered_concurrency") - F.col("max_num_seqs")), "max_requests_swapped": F.when(i % 37 == 0, 1).cast("int"),
        "sources_present": F.lit(True), "scope_consistent": F.lit(True), "scope_count": F.lit(1), "single_series": i % 41 != 0, "latency_observations": F.col("requests_finished"),
    })


_WINDOWS = """o AS (SELECT o_orderkey AS id FROM orders),
w AS (SELECT id, 4.0::DOUBLE + id % 9 AS elapsed, 4 + id * 3 % 11 AS obs, 28 + id * 5 % 40 AS fin, CASE WHEN id % 31 <> 0 THEN CASE WHEN id % 4 = 0 THEN 3 ELSE 0 END END AS pre, id % 12 + 1 AS seqs, id % 12 + 1 + id * 11 % 6 AS offered, (id * 13 % 20) / 20.0 + 0.04::DOUBLE AS kv FROM o),
x AS (SELECT *, seqs - CASE WHEN id % 8 = 0 THEN 1 ELSE 0 END AS running, CASE WHEN id % 3 = 0 THEN 0 ELSE offered - seqs END AS waiting, (id % 40 * 10)::DOUBLE AS queue, CASE WHEN id % 37 = 0 THEN 1 END AS swapped FROM w),
q AS (SELECT *, list_sort(list_filter([CASE WHEN id % 17 = 0 THEN 'effective_flags_not_runtime_verified' END, CASE WHEN id % 19 = 0 THEN 'traffic_scope_not_exclusive' END, CASE WHEN id % 23 = 0 THEN 'load_requests_failed' END, CASE WHEN elapsed < 5 THEN 'window_too_short' END,
  CASE WHEN obs < 5 THEN 'too_few_observations' END, CASE WHEN elapsed / (obs - 1) > 5 THEN 'sample_spacing_too_sparse' END, CASE WHEN fin < 30 OR fin < 2 * offered THEN 'too_few_finished_requests' END, CASE WHEN id % 29 = 0 THEN 'finish_reason_evidence_not_clean' END, CASE WHEN pre IS NULL THEN 'missing_required_metric' END,
  CASE WHEN id % 41 = 0 THEN 'required_metric_series_count_not_one' END, CASE WHEN waiting > offered THEN 'gauge_exceeds_offered_concurrency' END], lambda v: v IS NOT NULL)) AS quality FROM x),
s AS (SELECT *, list_filter([CASE WHEN NOT (offered >= seqs AND running = seqs) THEN 'configured_limit_not_exercised' END, CASE WHEN swapped > 0 THEN 'legacy_swap_pressure_observed' END], lambda v: v IS NOT NULL) AS base,
  (pre > 0 AND kv >= 0.9) OR (pre = 0 AND waiting > 0 AND queue / 1000.0 >= 0.2 AND kv <= 0.7 AND offered > seqs) AS complete FROM q),
n AS (SELECT *, CASE WHEN complete THEN list_sort(base) ELSE list_sort(list_concat(base, list_filter([CASE WHEN (pre > 0) <> (kv >= 0.9) THEN 'pressure_signal_incomplete' END, CASE WHEN waiting = 0 THEN 'no_material_queue' WHEN queue / 1000.0 < 0.2 THEN 'queue_share_below_policy_threshold' END,
  CASE WHEN waiting > 0 AND kv > 0.7 THEN 'queue_and_kv_signals_conflict' END, CASE WHEN kv > 0.7 AND kv < 0.9 THEN 'kv_headroom_not_clear' END], lambda v: v IS NOT NULL))) END AS none0 FROM s),
m AS (SELECT *, CASE WHEN NOT complete AND len(none0) = 0 THEN ['kv_headroom_not_clear'] ELSE none0 END AS none, (seqs + 3) // 4 AS step FROM n),
c AS (SELECT *, CASE WHEN pre > 0 THEN greatest(1, seqs - step) ELSE least(offered, 2048, seqs + step) END AS cand FROM m),
a AS (SELECT *, len(quality) = 0 AS good, len(none) > 0 AS quiet, CASE WHEN pre > 0 THEN cand >= seqs ELSE cand <= seqs END AS stuck FROM c)"""


@query("r11_quality", f"WITH {_WINDOWS} SELECT id, array_to_string(quality, ',') AS quality FROM a")
def r11(spark, d):
    return _windows(spark, d).select("id", F.array_join(bottleneck.quality_reasons(), ",").alias("quality"))


@query("r12_signals", f"WITH {_WINDOWS} SELECT id, round(elapsed / (obs - 1), 6) AS spacing, round(1 - kv, 6) AS headroom, round(queue / 1000.0, 6) AS queue_share, round(100.0 * pre / fin, 6) AS preemptions_per_100, offered >= seqs AND running = seqs AS exercised FROM a")
def r12(spark, d):
    s = bottleneck.signals(_windows(spark, d))
    return s.select("id", r6("average_sample_spacing_seconds").alias("spacing"), r6("sampled_kv_headroom_fraction").alias("headroom"), r6("queue_share_of_mean_e2e").alias("queue_share"), r6("preemptions_per_100_finished").alias("preemptions_per_100"), F.col("configured_limit_exercised").alias("exercised"))


@query("r15_analysis", f"""WITH {_WINDOWS} SELECT id, CASE WHEN NOT good THEN 'insufficient_evidence' WHEN quiet OR stuck THEN 'no_clear_signal' ELSE 'suggestion_available' END AS status,
 CASE WHEN NOT good THEN array_to_string(quality, ',') WHEN quiet THEN array_to_string(none, ',') WHEN stuck THEN CASE WHEN pre > 0 THEN 'no_lower_candidate' ELSE 'no_higher_candidate_within_verified_bounds' END ELSE '' END AS reasons,
 CASE WHEN good AND NOT quiet AND NOT stuck THEN CASE WHEN pre > 0 THEN 'decrease' ELSE 'increase' END END AS direction, CASE WHEN good AND NOT quiet AND NOT stuck THEN cand::INT END AS candidate FROM a""")  # fmt: skip
def r15(spark, d):
    a = bottleneck.analyze(_windows(spark, d))
    return a.select("id", "status", F.array_join("reasons", ",").alias("reasons"), "direction", F.col("candidate_max_num_seqs").alias("candidate"))


@query("r16_replay", f"WITH {_WINDOWS} SELECT id, CASE WHEN NOT good THEN 'insufficient_evidence' WHEN quiet OR stuck THEN 'no_clear_signal' ELSE 'suggestion_available' END AS status, CASE WHEN good AND NOT quiet AND NOT stuck THEN cand::INT END AS candidate, true AS agrees FROM a")
def r16(spark, d):
    both = bottleneck.replay(bottleneck.analyze(_windows(spark, d)))
    agrees = F.col("replay_status").eqNullSafe(F.col("status")) & F.col("replay_candidate").eqNullSafe(F.col("candidate_max_num_seqs"))
    return both.select("id", F.col("replay_status").alias("status"), F.col("replay_candidate").alias("candidate"), agrees.alias("agrees"))


@query("f13_ceil_quarter", "SELECT o_orderkey AS id, ((o_orderkey % 100 + 3) // 4)::INT AS step FROM orders")
def f13(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr("cast((o_orderkey % 100 + 3) div 4 as int)").alias("step"))


# --- text, sets and identities ---------------------------------------------------------------------------------------------


@query("f01_tokens", r"SELECT conv_id, turn, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS n, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))) AS n_distinct FROM conversations")
def f01(spark, d):
    w = text.tokens("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@query("j08_similar_prompts", r"""WITH p AS (SELECT doc_id AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))) AS w FROM documents), m AS (SELECT *, min(id) OVER (PARTITION BY w) AS name FROM p WHERE len(w) > 0),
r AS (SELECT id, w FROM m WHERE id = name), c AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS k, len(a.w) + len(b.w) AS n FROM r a JOIN r b ON a.id < b.id AND least(len(a.w), len(b.w)) >= greatest(len(a.w), len(b.w)) * 0.8)
SELECT a, b, round(k / (n - k), 6) AS similarity FROM c WHERE k >= 0.8 * (n - k) UNION ALL SELECT name, id, 1.0 FROM m WHERE id <> name""")  # fmt: skip
def j08(spark, d):
    return similarity.similar_pairs(table(spark, d, "documents"), "doc_id", "text", 0.8).select("a", "b", r6("similarity").alias("similarity"))


@query("j09_shared_identities", "SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents WHERE source = 'src3') AND source <> 'src3'")
def j09(spark, d):
    docs = table(spark, d, "documents")
    return similarity.shared_identities(docs.where("source <> 'src3'"), docs.where("source = 'src3'"), "text").select("doc_id")


@query("u01_token_sets", r"""WITH p AS (SELECT conv_id, turn, list_distinct(regexp_split_to_array(lower(text), '\s+')) AS w FROM conversations), l AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM p)
SELECT conv_id, turn, len(list_intersect(w, q)) AS common, len(list_distinct(list_concat(w, q))) AS either FROM l WHERE q IS NOT NULL""")  # fmt: skip
def u01(spark, d):
    w = F.array_distinct(F.split(F.lower("text"), r"\s+"))
    p = table(spark, d, "conversations").select("conv_id", "turn", w.alias("w")).withColumn("q", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn")))
    return p.where("q is not null").select("conv_id", "turn", F.size(F.array_intersect("w", "q")).cast("long").alias("common"), F.size(F.array_union("w", "q")).cast("long").alias("either"))


@query("u03_prompt_overlap", "SELECT text FROM documents WHERE source = 'src1' INTERSECT SELECT text FROM documents WHERE source = 'src2'")
def u03(spark, d):
    docs = table(spark, d, "documents")
    return docs.where("source = 'src1'").select("text").intersect(docs.where("source = 'src2'").select("text"))


@query("u05_warmup_and_measured", f"WITH {RL} SELECT block_index, count(*) AS n, sum(w)::BIGINT AS warmups FROM (SELECT block_index, 1 AS w FROM g WHERE position_idx = 0 UNION ALL SELECT block_index, 0 FROM g WHERE position_idx > 0) GROUP BY block_index")
def u05(spark, d):
    log = request_log(spark, d)
    both = log.where("position_idx = 0").select("block_index", F.lit(1).alias("w")).unionByName(log.where("position_idx > 0").select("block_index", F.lit(0).alias("w")))
    return both.groupBy("block_index").agg(F.count("*").alias("n"), F.sum("w").cast("long").alias("warmups"))


_ESCAPED = r'''replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')'''


@query("f03_workload_hash", f"""SELECT conv_id, turn, sha256('[{{"role":"' || role || '","content":"' || {_ESCAPED} || '"}}]') AS h FROM conversations""")
def f03(spark, d):
    body = F.to_json(F.array(F.struct("role", F.col("text").alias("content"))))
    return table(spark, d, "conversations").select("conv_id", "turn", text.digest(text.canonical_json(body, ascii_only=False, sort=False)).alias("h"))


@query("f04_canonical_json", """SELECT p_partkey AS id, sha256('{"a":[' || p_partkey || ',true,null,"' || p_partkey || '"],"k":{"x":{"m":' || p_partkey % 7 || '.5,"n":"\\u00e9"},"y":"' || p_name || '"},"z":' || p_size || '}') AS h FROM part""")
def f04(spark, d):
    k = F.col("p_partkey").cast("string")
    parts = ['{ "z": ', F.col("p_size").cast("string"), ', "k": {"y": "', F.col("p_name"), '", "x": {"n": "é", "m": ', (F.col("p_partkey") % 7).cast("string"), '.50}}, "a": [', k, ', true, null, "', k, '"]}']
    body = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.digest(text.canonical_json(body)).alias("h"))


_SCALE = (0.25, 0.001, 0.0001, 2500000.25)


@query("f05_condition_id", f"""WITH v AS (SELECT o_orderkey AS id, round((o_orderkey % 1000 + 1) * {list(_SCALE)}[(o_orderkey % 4 + 1)::INT]::DOUBLE, 9) AS v FROM orders)
SELECT id, 'open_loop:' || CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE rtrim(printf('%.6f', v), '0') END AS condition_id FROM v""")
def f05(spark, d):
    k = F.col("o_orderkey")
    v = F.round((k % 1000 + 1) * F.element_at(F.array(*[F.lit(x) for x in _SCALE]), (k % 4 + 1).cast("int")), 9)
    return table(spark, d, "orders").select(k.alias("id"), text.condition_id(F.lit("open_loop"), v).alias("condition_id"))


@query("f08_flag_names", "SELECT p_partkey AS id, lower(replace(replace(p_name, ' ', '_'), '_', '-')) AS flag FROM part")
def f08(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.flag_name(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("flag"))


@query("f10_prompt_text", "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS h, md5(max_by(text, turn) FILTER (role = 'user')) AS last_user FROM conversations GROUP BY conv_id")
def f10(spark, d):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("m"))
    return c.select("conv_id", F.md5(text.prompt_text(F.col("m"))).alias("h"), F.md5(text.last_user_text(F.col("m"))).alias("last_user"))


@query("f12_pieces", "SELECT conv_id, turn, ceil(length(text) / 10)::BIGINT AS n, md5(array_to_string(list_transform(range(0, length(text), 10), lambda a: substr(text, a + 1, 10)), '|')) AS h FROM conversations")
def f12(spark, d):
    p = text.pieces("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(p).cast("long").alias("n"), F.md5(F.array_join(p, "|")).alias("h"))


@query("p15_canonical_int", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey * 900000 <= 2147483647 AND o_orderkey > 0 THEN o_orderkey * 900000 END AS n FROM orders")
def p15(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), text.canonical_positive_int(F.concat(F.when(k % 3 == 0, "0").otherwise(""), (k * 900000).cast("string"))).alias("n"))


@query("p14_alias_collision", "SELECT p_partkey AS id, lower(p_name) = lower(p_brand) OR p_partkey % 2 = 0 AS collides FROM part")
def p14(spark, d):
    k = F.col("p_partkey")
    names = F.array(F.lit("max_num_seqs"), F.when(k % 2 == 0, "Max-Num-Seqs").otherwise(F.concat(F.lit("flag_"), k.cast("string"))))
    return table(spark, d, "part").select(k.alias("id"), text.has_alias_collision(names).alias("collides"))


@query("p08_digests", "SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS digest, o_orderkey % 3 = 0 AS revision FROM orders")
def p08(spark, d):
    k = F.col("o_orderkey")
    h = F.sha2(k.cast("string"), 256)
    return table(spark, d, "orders").select(k.alias("id"), text.immutable_digest(F.when(k % 2 == 0, F.concat(F.lit("sha256:"), h)).otherwise(F.lit("latest"))).alias("digest"), text.immutable_revision(F.when(k % 3 == 0, h).otherwise(F.substring(h, 1, 12))).alias("revision"))


@query("p11_count_maps", f"WITH {RL} SELECT concurrency, position_idx, block_index, count(*) = count(*) FILTER (status_code = 200) AS strict FROM g WHERE position_idx < 3 OR ok GROUP BY ALL")
def p11(spark, d):
    log = request_log(spark, d).where((F.col("position_idx") < 3) | runs.valid())
    c = runs.request_counts(log, ["concurrency", "position_idx", "block_index"])
    to_map = lambda x: F.coalesce(F.map_from_entries(x), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")))
    return c.select("concurrency", "position_idx", "block_index", text.count_map_strict(to_map(F.col("status_counts")), to_map(F.col("error_counts")), to_map(F.col("finish_reason_counts")), F.col("attempted")).alias("strict"))


@query("p17_chat_url", "SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'https://h' || s_suppkey || '.example.com/v1/chat/completions' WHEN 1 THEN 'https://h' || s_suppkey || '.example.com/v1/chat/completions' WHEN 2 THEN NULL WHEN 3 THEN 'http://127.0.0.1:8000/v1/chat/completions' ELSE NULL END AS url FROM supplier")
def p17(spark, d):
    k = F.col("s_suppkey")
    host = F.concat(F.lit("h"), k.cast("string"), F.lit(".example.com"))
    url = F.when(k % 5 == 0, F.concat(F.lit("https://"), host, F.lit("/"))).when(k % 5 == 1, F.concat(F.lit("https://"), host, F.lit("/v1"))).when(k % 5 == 2, F.concat(F.lit("http://"), host)).when(k % 5 == 3, "http://127.0.0.1:8000/v1/").otherwise(F.concat(F.lit("https://user:x@"), host))
    return table(spark, d, "supplier").select(k.alias("id"), text.chat_url(url).alias("url"))


@query("f06_offset_timestamps", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN epoch_us(o_orderdate::TIMESTAMP) - 7200000000 END AS us FROM orders")
def f06(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    t = F.concat(day, F.lit("T00:00:00"), F.when(F.col("o_orderkey") % 2 == 0, "+02:00").otherwise(""))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.unix_micros(text.offset_timestamp(t)).alias("us"))


# --- sources and responses ----------------------------------------------------------------------------------------------------


def quoted(c: Column | str) -> Column:
    """A text as a JSON string."""
    j = F.to_json(F.struct(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).alias("t")))
    return F.substring(j, F.lit(6), F.length(j) - 6)


def filled(templates: list[str], k: Column, text_: Column | str) -> Column:
    """The template of number ``k`` with each TEXT replaced by the text as a JSON string."""
    at = F.element_at(F.array(*[F.lit(t) for t in templates]), (k + 1).cast("int"))
    return F.replace(at, F.lit("TEXT"), quoted(text_))


# One-line prompts around a conversation's text, and what is wrong with each.
PROMPTS = {
    '{"prompt":TEXT}': None, '{"messages":[{"role":"user","content":TEXT}]}': None, '{"prompt":"  \\t"}': "blank_prompt", '{"prompt":TEXT,"messages":[{"role":"user","content":TEXT}]}': "exactly_one_of_prompt_and_messages", '{"text":TEXT}': "exactly_one_of_prompt_and_messages",
    '{"prompt":TEXT,"id":1e999,"note":"NaN, Infinity and 1e400"}': None, '{"prompt":TEXT,"score":NaN}': "invalid_json_object", '{"prompt":TEXT,"prompt":TEXT}': "invalid_json_object", "[TEXT]": "invalid_json_object", '{"messages":[]}': "empty_messages", '{"messages":TEXT}': "empty_messages",
    '{"messages":[{"role":"user","content":TEXT},{"role":" ","content":TEXT}]}': "invalid_message", '{"messages":[{"content":TEXT}]}': "invalid_message", '{"messages":[TEXT]}': "invalid_message", '{"prompt":7}': "blank_prompt", '{"prompt":TEXT} TEXT': "invalid_json_object",
}


def code_list(codes) -> str:
    """Codes as a list in SQL."""
    return "[" + ", ".join("NULL" if c is None else f"'{c}'" for c in codes) + "]"


_LINE = "(conv_id * 8 + turn)"


def _line() -> Column:
    return F.col("conv_id") * 8 + F.col("turn")


@query("s01_prompts", f"WITH p AS (SELECT *, {code_list(PROMPTS.values())}[{_LINE} % {len(PROMPTS)} + 1] AS error FROM conversations) SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN md5(text) END AS prompt FROM p")
def s01(spark, d):
    c = table(spark, d, "conversations")
    got = files.parse_prompts(c.select("conv_id", "turn", filled(list(PROMPTS), _line() % len(PROMPTS), "text").alias("value")))
    return got.select("conv_id", "turn", "error", F.md5(F.col("messages")[0]["content"]).alias("prompt"))


# Texts around a conversation's text, and whether they are strict JSON.
STRICT = {
    "TEXT": True, '{"a":TEXT}': True, '{"a":TEXT,"a":1}': False, '{"a":TEXT,"b":NaN}': False, '{"a":TEXT,"b":"NaN -Infinity 1e999"}': True, '{"a":TEXT,"b":1e999}': True, '{"a":[TEXT,-Infinity]}': False, '{"a":[{"b":TEXT,"b":TEXT}]}': False, '[{"b":TEXT},{"b":TEXT}]': True, "TEXT TEXT": False, "[TEXT": False,
    '{"NaN":TEXT,"b":1E+400}': True, "[TEXT],[TEXT": False, '{"a":TEXT}}': False, "[TEXT,]": False, ' {"a" : TEXT }\n': True, "{'a':TEXT}": False,
}


@query("s02_strict_json", f"SELECT conv_id, turn, [{', '.join(str(x) for x in STRICT.values())}][{_LINE} % {len(STRICT)} + 1] AS ok FROM conversations")
def s02(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", files.strict_json(filled(list(STRICT), _line() % len(STRICT), "text")).isNotNull().alias("ok"))


@query("s05_exposition", "SELECT event_id, 'vllm:num_requests_running' AS family, 'engine=' || user_id || ',kind=' || event_type AS series, (event_id % 7)::DOUBLE AS number, CASE WHEN event_id % 11 = 0 THEN 'metrics_negative_value' END AS code FROM events WHERE event_id % 2 = 0")
def s05(spark, d):
    k = F.col("event_id")
    name = F.when(k % 2 == 0, "vllm:num_requests_running").otherwise("other_family")
    line = F.concat(name, F.lit('{kind="'), "event_type", F.lit('",engine="'), F.col("user_id").cast("string"), F.lit('"} '), F.when(k % 11 == 0, "-").otherwise(""), (k % 7).cast("string"), F.when(k % 11 == 0, ".5").otherwise(""))
    got = files.parse_exposition(table(spark, d, "events").select("event_id", line.alias("value")))
    return got.select("event_id", "family", files.label_text(F.col("labels")).alias("series"), F.when(F.col("code").isNotNull(), k % 7).otherwise(F.col("number")).cast("double").alias("number"), "code")


@query("s08_sse_events", "SELECT conv_id, turn::INT AS seq, md5(replace(text, chr(10), ' ')) AS h FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn FROM conversations)")
def s08(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"))
    body = F.array_join(F.transform("m", lambda x: F.concat(F.lit("event: x\ndata: "), F.replace(x["text"], F.lit("\n"), F.lit(" ")))), "\n\n")
    return files.sse_events(c.select("conv_id", body.alias("body")), "conv_id", "body").select("conv_id", "seq", F.md5("event").alias("h"))


@query("s09_legacy_reports", "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'current' WHEN 1 THEN 'legacy' ELSE 'unsupported' END AS kind FROM orders")
def s09(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), files.report_kind(F.element_at(F.array(F.lit("2.0"), F.lit("1.0"), F.lit("x")), (k % 3 + 1).cast("int"))).alias("kind"))


_ANSWER = '{"choices":[{"index":0,"finish_reason":"stop","message":{"role":"assistant","content":TEXT}}],"usage":{"prompt_tokens":1,"completion_tokens":WORDS}}'
# One change of a sound answer for each code.
_ANSWER_CHANGES = (
    ("", "", None), ("WORDS}}", "WORDS}", "invalid_json"), ('"choices"', '"a":NaN,"choices"', "invalid_json"), (_ANSWER, "[TEXT]", "response_not_object"), ('{"choices"', '{"error":null,"choices"', "error_response_shape"), ('[{"index"', '[5,{"index"', "missing_or_empty_choices"), (_ANSWER, '{"choices":[]}', "missing_or_empty_choices"),
    (_ANSWER, '{"choices":[TEXT]}', "choice_not_object"), ('"index":0', '"index":"0"', "invalid_choice_index"), ('"index":0,', "", "invalid_choice_index"), ('"stop"', '" "', "missing_finish_reason"), ('"stop"', "TEXT", "unsupported_finish_reason"), ('"message"', '"text"', "missing_assistant_message"),
    ('"assistant"', '"user"', "invalid_assistant_role"), ("TEXT", '" \\u2003"', "empty_completion_output"), ("TEXT", "5", "empty_completion_output"), ('"usage"', '"use"', "missing_usage"), ("WORDS", "true", "invalid_completion_tokens"), ("WORDS", "0", "invalid_completion_tokens"), ('"prompt_tokens":1', '"prompt_tokens":1.0', "invalid_prompt_tokens"), ('"index":0', '"index":0.0', None),
)
ANSWERS = [_ANSWER.replace(old, new) if old else _ANSWER for old, new, _ in _ANSWER_CHANGES]
_CAP = 60


@query("p04_payload_codes", f"WITH p AS (SELECT *, len(regexp_extract_all(text, '\\S+')) AS words, {code_list(c for *_, c in _ANSWER_CHANGES)}[{_LINE} % {len(ANSWERS)} + 1] AS wrong FROM conversations) SELECT conv_id, turn, CASE WHEN wrong IS NULL AND words > {_CAP} THEN 'reported_completion_tokens_exceed_request_cap' ELSE wrong END AS code FROM p")
def p04(spark, d):
    words = F.regexp_count("text", F.lit(r"[^ \t\n\f\r]+"))
    body = F.replace(filled(ANSWERS, _line() % len(ANSWERS), "text"), F.lit("WORDS"), words.cast("string"))
    return table(spark, d, "conversations").select("conv_id", "turn", responses.payload_code(body, max_tokens=_CAP).alias("code"))


def _chunk(delta: str, finish: str = "null", index: str = "0") -> str:
    return f'{{"choices":[{{"index":{index},"delta":{delta},"finish_reason":{finish}}}]}}'


_ROLE, _SAID, _END, _USE = _chunk('{"role":"assistant"}'), _chunk('{"content":TEXT}'), _chunk("{}", '"stop"'), '{"choices":[],"usage":{"prompt_tokens":1,"completion_tokens":TURNS}}'
#: Places of a stream: its role, its first text, what stands behind the texts, and three places behind the end.
_AT = {"role": 0, "text": 1, "gap": 900, "finish": 1000, "late": 1001, "usage": 1002, "after": 1003, "done": 1004, "end": 1005}
# What each kind of stream has at some places instead of a sound one's events (None: nothing), its code, and how many events more it has.
STREAMS = (
    ({}, None, 0), ({"done": None}, "stream_missing_done", -1), ({"end": "[DONE]"}, "duplicate_stream_done", 1), ({"end": _SAID}, "stream_data_after_done", 1), ({"gap": "{"}, "malformed_stream_json", 1), ({"gap": '{"a":1,"a":2}'}, "malformed_stream_json", 1), ({"gap": "[TEXT]"}, "stream_event_not_object", 1),
    ({"gap": '{"error":null}'}, "stream_error_event", 1), ({"after": _USE}, "duplicate_stream_usage", 1), ({"gap": _USE}, "stream_usage_before_finish", 1), ({"usage": '{"choices":[],"usage":[]}'}, "missing_usage", 0), ({"usage": _USE.replace("TURNS", "true")}, "invalid_completion_tokens", 0),
    ({"usage": _USE.replace(":1,", ":-1,")}, "invalid_prompt_tokens", 0), ({"gap": '{"choices":[]}'}, "empty_stream_event_without_usage", 1), ({"usage": _SAID[:-1] + ',"usage":{"prompt_tokens":1,"completion_tokens":2}}'}, "stream_usage_with_choice_data", 0), ({"after": _SAID}, "stream_choice_after_usage", 1), ({"late": _SAID}, "stream_choice_after_finish", 1),
    ({"gap": '{"choices":TEXT}'}, "invalid_stream_choices", 1), ({"gap": _chunk("{}", index='"0"')}, "invalid_choice_index", 1), ({"finish": _chunk("{}", '" "')}, "invalid_finish_reason", 0), ({"finish": _chunk("{}", "TEXT")}, "unsupported_finish_reason", 0), ({"gap": _chunk("TEXT")}, "invalid_stream_delta", 1), ({"role": _chunk('{"role":null}')}, "invalid_assistant_role", 0),
    ({"gap": _chunk('{"content":[TEXT]}')}, "invalid_stream_content_type", 1), ({"gap": _chunk('{"reasoning_content":5}')}, "invalid_stream_reasoning_type", 1), ({"role": None}, "output_before_assistant_role", -1), ({"finish": None, "usage": None}, "missing_finish_reason", -2), ({"usage": None}, "missing_usage", -1),
    ({"gap": _chunk('{"reasoning_content":TEXT}')}, None, 1), ({"usage": _USE.replace("TURNS", "999")}, "reported_completion_tokens_exceed_request_cap", 0),
)


def streams(spark, d) -> DataFrame:
    """Events of a stream for each conversation: every turn is a chunk of content; the conversation's number says what is changed."""
    c = table(spark, d, "conversations")
    kind = (F.col("conv_id") % len(STREAMS)).cast("int")
    heads = c.groupBy("conv_id").agg(F.count("*").cast("string").alias("turns"), F.min_by("text", "turn").alias("text"))
    sound = {"role": _ROLE, "finish": _END, "usage": _USE, "done": "[DONE]"}
    rows = [(k, _AT[place], (sound | changes)[place]) for k, (changes, *_) in enumerate(STREAMS) for place in {**sound, **changes}]
    places = F.broadcast(spark.createDataFrame([r for r in rows if r[2] is not None], "kind int, seq int, event string"))  # one row a kind and place
    ends = heads.withColumn("kind", kind).join(places, "kind").select("conv_id", "seq", F.replace(F.replace("event", F.lit("TEXT"), quoted("text")), F.lit("TURNS"), F.col("turns")).alias("event"))
    texts = c.select("conv_id", (F.col("turn") + 1).cast("int").alias("seq"), F.replace(F.lit(_SAID), F.lit("TEXT"), quoted("text")).alias("event"))
    return texts.unionByName(ends)


@query("p05_stream_codes", f"SELECT conv_id, {code_list(c for _, c, _ in STREAMS)}[conv_id % {len(STREAMS)} + 1] AS code, (count(*) + 4 + [{', '.join(str(n) for *_, n in STREAMS)}][conv_id % {len(STREAMS)} + 1])::BIGINT AS events FROM conversations GROUP BY conv_id")
def p05(spark, d):
    return responses.check_streams(streams(spark, d), "conv_id", max_tokens=99).select("conv_id", "code", "events")


# Texts around a part's name, and whether they may be published.
METADATA = (
    ("NAME", True), ("NAME GPU (80GB)", True), ("NAME ", False), ("Bearer NAME", False), ("password: NAME", False), ("NAME api_key=x", False), ("https://NAME", False), ("../NAME", False), ("NAME/..", False), ("/NAME", False), ("see /NAME", False), ("C:/NAME", False), ("~/NAME", False), ("NAME\u0007", False), ("NAME\u2028b", False), ("NAME\u200bb", False),
    ("ﬁne NAME", True), ("ＡＢ NAME", True), ("NAME\ue000", True), ("／NAME", False), ("ｐassword: NAME", False), ("user:pass@NAME", False), ("img:v1@sha256:0123456789abcdef", True), ("img:token@sha256:0123456789abcdef", False), ("hf_abcdefgh1234 NAME", False), ("NAME @ 3:4", True), ("unknown", True), ("Unknown", False), ("", False), ("NAME s3:x", False),
)


@query("p07_public_metadata", f"WITH p AS (SELECT p_partkey AS id, replace([{', '.join(chr(39) + t.replace(chr(39), chr(39) * 2) + chr(39) for t, _ in METADATA)}][p_partkey % {len(METADATA)} + 1], 'NAME', p_name) AS t, [{', '.join(str(x) for _, x in METADATA)}][p_partkey % {len(METADATA)} + 1] AS safe FROM part) SELECT id, safe AND strlen(t) <= 256 AS safe FROM p")
def p07(spark, d):
    at = F.element_at(F.array(*[F.lit(t) for t, _ in METADATA]), (F.col("p_partkey") % len(METADATA) + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.public_metadata(F.replace(at, F.lit("NAME"), F.col("p_name"))).alias("safe"))


# --- order-dependent: checked by tests against plain Python ---------------------------------------------------------------------


@query("t05_bootstrap")
def t05(spark, d):
    return sampling.bootstrap_interval(request_log(spark, d).where(runs.generated()), ["concurrency", "block_index"], "request_id", "e2e_seconds", 0.95, 7)


@query("t06_reservoir")
def t06(spark, d):
    return sampling.reservoir_sample(request_log(spark, d), ["concurrency"], "request_id", "e2e_seconds", 10, 256)


@query("k04_prompt_order")
def k04(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").cast("int").alias("prompt_pos"), "text")
    return sampling.assigned_prompts(request_log(spark, d).select("request_id"), b, "request_id", b.count(), 11).select("request_id", "prompt_pos")


def _arrivals(spark, d) -> DataFrame:
    p = table(spark, d, "conversations").where("role = 'user'")
    return p.select((F.col("conv_id") % 8).alias("cache"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("text").alias("prompt"), (F.col("conv_id") * 10.0 + F.col("turn")).alias("now"), (F.col("turn") % 2).cast("string").alias("scope"))


@query("c01_similarity_cache")
def c01(spark, d):
    return cache.replay(_arrivals(spark, d), "cache", "seq", "prompt", "now", ttl=2000.0, size=50, threshold=0.6)


@query("a19_cache_hit_rate")
def a19(spark, d):
    return cache.hit_rate(cache.replay(_arrivals(spark, d), "cache", "seq", "prompt", "now", ttl=2000.0, size=50, threshold=0.6), ["cache"])


@query("c03_synthetic_hits", f"WITH {RL} SELECT request_id, round(0.9 * e2e_seconds, 6) AS ttft, 0.0001::DOUBLE AS tpot, (completion_tokens - 1)::BIGINT AS gaps FROM g WHERE ok AND cache_hit")
def c03(spark, d):
    hits = cache.synthetic_hits(request_log(spark, d).where(runs.valid() & F.col("cache_hit")))
    return hits.select("request_id", r6("ttft_seconds").alias("ttft"), F.col("tpot_seconds").alias("tpot"), F.size("inter_chunk_seconds").cast("long").alias("gaps"))


@query("c04_scoped_cache")
def c04(spark, d):
    return cache.scoped_replay(_arrivals(spark, d), "cache", "seq", "prompt", "scope", "now", ttl=2000.0, size=50, threshold=0.6)


@query("c05_in_flight")
def c05(spark, d):
    return cache.in_flight(request_log(spark, d).withColumn("arrival", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumn("s", F.col("e2e_seconds") * 3600), ["user_id"], "request_id", "arrival", "s")


@query("stream_daily_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def daily_counts(spark, d):
    got = cache.windowed_counts(table(spark, d, "events").withColumn("ts", F.to_timestamp_ltz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))), "ts", ["event_type"])
    return got.groupBy(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type").agg(F.sum("n").alias("n"))


@query("c06_polling_window", """WITH s AS (SELECT user_id % 400 AS run, dayofyear(ts) AS seq, count(*) AS n, dayofyear(ts) * 1.5::DOUBLE + user_id % 400 % 7 * (dayofyear(ts) % 5) AS t FROM events GROUP BY ALL),
o AS (SELECT *, t - lag(t) OVER (PARTITION BY run ORDER BY seq) AS gap FROM s),
a AS (SELECT run, min(seq) AS before_seq, max(seq) AS after_seq, count(*) - 2 AS observations, sum(n)::BIGINT AS recognized_samples, max_by(t, seq) - min_by(t, seq) AS elapsed, bool_or(gap < 0 OR gap > 5) AS bad FROM o GROUP BY run)
SELECT run, before_seq::INT AS before_seq, after_seq::INT AS after_seq, greatest(observations, 0) AS observations, recognized_samples, round(elapsed, 6) AS elapsed, CASE WHEN observations < 0 THEN 'experimental_metrics_window_invalid' WHEN bad THEN 'experimental_metrics_sample_gap_exceeded' WHEN observations > 20 THEN 'experimental_metrics_observation_limit' WHEN recognized_samples > 5000 THEN 'experimental_metrics_window_too_large' END AS code FROM a""")  # fmt: skip
def c06(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 400).alias("run"), F.dayofyear("ts").alias("seq"))
    snapshots = e.groupBy("run", "seq").agg(F.count("*").alias("recognized_samples")).withColumn("at", F.col("seq") * 1.5 + F.col("run") % 7 * (F.col("seq") % 5))
    got = windows.polling_windows(snapshots, ["run"], "at", most_observations=20, most_samples=5000)
    return got.select("run", "before_seq", "after_seq", "observations", "recognized_samples", r6("elapsed").alias("elapsed"), "code")


@query("j10_in_flight_scopes", f"""WITH {RL} SELECT request_id, min(request_id) OVER (PARTITION BY user_id % 50, finish_reason, epoch_us(ts) // 3600000000) AS leader FROM g WHERE ok""")
def j10(spark, d):
    log = request_log(spark, d).where(runs.valid()).withColumn("scope", text.scope_key(F.to_json(F.struct("finish_reason", (F.col("user_id") % 50).alias("n"))))).withColumn("prompt", F.date_format("ts", "yyyy-MM-dd HH"))
    at = log.select("request_id", "scope", "prompt", F.col("request_id").cast("double").alias("arrival"), F.lit(1e12).alias("s"))
    return cache.in_flight(at, ["scope", "prompt"], "request_id", "arrival", "s").select("request_id", "leader")
