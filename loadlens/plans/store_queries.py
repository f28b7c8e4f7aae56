"""Registered queries of saved report files, progress kept by a stream, and run finalisation."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.operators import pilot, protocol_plan, reports
from loadlens.plans import report_samples
from loadlens.plans.more_queries import code_list, quoted
from loadlens.plans.queries import query
from loadlens.plans.views import spread, table
from loadlens.sources import report_store
from loadlens.streaming import polling, progress

#: Least size of the files that are too large here.
_LARGE = 60_000
# What a file holds (NAME: a JSON text) and the code of its check. The last three are no regular file, a link and a large file.
FILES = (
    ('{"name": NAME, "n": 1e5}', None), ('{"name": NAME, "name": 1}', "duplicate_report_key"), ('{"name": NAME, "x": [NaN]}', "unsafe_report_number"), ('{"name": NAME, "x": 9007199254740993}', "unsafe_report_number"), ("[NAME]", "report_not_object"), ('{"name": NAME', "invalid_report_json"), ('{"name": NAME, "x": ' + "[" * 70 + "]" * 70 + "}", "report_too_deep"),
    ('{"name": NAME, "x": "' + "y" * 20_000 + '"}', "report_string_too_long"), ('{"name": NAME, "' + "k" * 2_000 + '": 1}', "report_key_too_long"), ('{"name": NAME, "x": "\udcff"}', "report_unreadable"), ('{"name": NAME, "x": {"NaN": "NaN"}}', None), ("directory", "report_not_regular_file"), ("link", "report_not_regular_file"), ("large", "report_exceeds_size_limit"),
)


def _put(path: str):
    def put(rows) -> None:
        for r in rows:
            at, (body, _) = f"{path}/{r['id']}.json", FILES[r["id"] % len(FILES)]
            if body == "directory":
                os.mkdir(at)
            elif body == "link":
                os.symlink("/dev/null", at)
            else:
                with open(at, "wb") as f:
                    f.write(b" " * (_LARGE + 1) if body == "large" else body.replace("NAME", r["name"]).encode("utf-8", "surrogateescape"))

    return put


@query("s03_saved_reports", f"SELECT s_suppkey AS id, {code_list(c for _, c in FILES)}[(s_suppkey % {len(FILES)} + 1)::INT] AS code, CASE WHEN {code_list(c for _, c in FILES)}[(s_suppkey % {len(FILES)} + 1)::INT] IS NULL THEN s_name END AS name FROM supplier")
def s03(spark, d):
    """Files of one report each, made of suppliers on the executors, sound or not, are scanned."""
    path = report_store.shared_folder(spark, "reports")
    table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), quoted("s_name").alias("name")).foreachPartition(_put(path))
    found = report_store.scan_reports(spark, path, _LARGE)
    return found.select(F.regexp_replace("file", r"\.json$", "").cast("long").alias("id"), "code", F.when(F.col("code").isNull(), F.get_json_object("report", "$.name")).alias("name"))


_LINE = "chr(10)"


@query("s11_report_files", f"""SELECT c_custkey AS id, md5('{{' || {_LINE} || '  "a": [' || {_LINE} || '    ' || c_nationkey || ',' || {_LINE} || '    null' || {_LINE} || '  ],' || {_LINE} || '  "b": {{' || {_LINE} || '    "x": ' || c_custkey || ',' || {_LINE} || '    "y": "' || c_mktsegment || '"' || {_LINE} || '  }}' || {_LINE} || '}}' || {_LINE}) AS body FROM customer""")
def s11(spark, d):
    """Reports made of customers are saved, one file each, and read back as they lie."""
    c = spread(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"))
    body = F.concat(F.lit('{"b":{"y":'), quoted("c_mktsegment"), F.lit(',"x":'), F.col("c_custkey").cast("string"), F.lit('},"a":['), F.col("c_nationkey").cast("string"), F.lit(",null]}"))
    path = report_store.shared_folder(spark, "saved")
    report_store.save_reports(c.select(F.concat(F.lit("r"), "c_custkey").alias("name"), body.alias("report")), path)
    return report_store.scan_reports(spark, path).select(F.substring("file", 2, 20).cast("long").alias("id"), F.md5("report").alias("body"))


@query("c08_progress", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def c08(spark, d):
    """Events as partial reports of their users: a stream of files keeps the latest of each; its last batch is replayed."""
    at = report_store.shared_folder(spark, "progress")
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    events.repartitionByRange(6, F.xxhash64("event_id")).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    progress.progress_sink(stream, ["user_id"], ["event_id"], f"{at}/out", f"{at}/log").awaitTermination()
    last = progress._epochs(spark, f"{at}/out")[-1]
    progress.upsert(events.where(F.col("event_id") % 2 == 0), last, f"{at}/out", ["user_id"], ["event_id"])
    progress.upsert(events.where(F.col("event_id") % 2 == 1), last + 1, f"{at}/out", ["user_id"], ["event_id"])
    return progress.read_progress(spark, f"{at}/out")


@query("c06_polling_stream", """WITH s AS (SELECT user_id % 400 AS run, dayofyear(ts) AS seq, count(*) AS n, dayofyear(ts) * 1.5::DOUBLE + user_id % 400 % 7 * (dayofyear(ts) % 5) AS t FROM events GROUP BY ALL),
o AS (SELECT *, t - lag(t) OVER (PARTITION BY run ORDER BY seq) AS gap FROM s),
a AS (SELECT run, min(seq) AS before_seq, max(seq) AS after_seq, count(*) - 2 AS observations, sum(n)::BIGINT AS recognized_samples, max_by(t, seq) - min_by(t, seq) AS elapsed, bool_or(gap < 0 OR gap > 5) AS bad FROM o GROUP BY run)
SELECT run, before_seq, after_seq, greatest(observations, 0) AS observations, recognized_samples, round(elapsed, 6) AS elapsed, CASE WHEN observations < 0 THEN 'experimental_metrics_window_invalid' WHEN bad THEN 'experimental_metrics_sample_gap_exceeded' WHEN observations > 20 THEN 'experimental_metrics_observation_limit' WHEN recognized_samples > 5000 THEN 'experimental_metrics_window_too_large' END AS code FROM a""")
def c06_stream(spark, d):
    """The windows of c06 from a stream of snapshot files, whose updates are kept as progress."""
    at = report_store.shared_folder(spark, "polling")
    e = table(spark, d, "events").select((F.col("user_id") % 400).alias("run"), F.dayofyear("ts").alias("seq"))
    snapshots = e.groupBy("run", "seq").agg(F.count("*").alias("recognized_samples")).withColumn("at", F.col("seq") * 1.5 + F.col("run") % 7 * (F.col("seq") % 5))
    last = snapshots.groupBy("run").agg(F.max("seq").alias("_last"))
    rows = snapshots.join(last, "run").withColumn("ended", F.col("seq") == F.col("_last")).drop("_last")
    parts = [rows.where(F.col("seq") % 400 < 12), rows.where((F.col("seq") % 400 >= 12) & (F.col("seq") % 400 < 20)), rows.where(F.col("seq") % 400 >= 20)]
    for part in parts:  # three deliveries, in order of time
        part.write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
        found = polling.stream_polling_windows(stream, "run", "at", "ended", most_observations=20, most_samples=5000, late="3650 days")
        query_ = found.writeStream.outputMode("update").foreachBatch(lambda b, n: progress.upsert(b, n, f"{at}/out", ["run"], ["after_seq"])).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
        query_.awaitTermination()
    return progress.read_progress(spark, f"{at}/out").select("run", "before_seq", "after_seq", "observations", "recognized_samples", F.round("elapsed", 6).alias("elapsed"), "code")


_RUNTIME = report_samples.sound()["manifest"]["runtime"]


@query("a08_run_finalization", """WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'failed' ELSE 'complete' END AS status0, CASE WHEN c_custkey % 7 = 0 THEN 'max_errors' WHEN c_custkey % 71 = 1 THEN 'max_requests' END AS stop0, 30 + c_custkey % 31 AS elapsed, (c_custkey % 13) / 2.0 AS spend, 1 + c_custkey % 3 AS conds, 1 + c_custkey % 3 - CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS graded,
  CASE WHEN c_custkey % 17 = 0 THEN 'inconclusive' ELSE 'supported' END AS best0, c_custkey * 100 AS tokens FROM customer),
s AS (SELECT *, CASE WHEN stop0 IS NOT NULL THEN stop0 WHEN elapsed >= 60 THEN 'max_elapsed_time' WHEN spend >= 6 THEN 'max_estimated_spend' END AS stop FROM r),
t AS (SELECT *, CASE WHEN status0 = 'complete' AND stop IS NOT NULL THEN 'stopped' ELSE status0 END AS status FROM s),
b AS (SELECT *, CASE WHEN status <> 'complete' THEN 'inconclusive' ELSE best0 END AS best FROM t),
w AS (SELECT *, list_sort(list_filter([CASE WHEN id % 5 = 0 THEN 'smoke_mode_is_not_decision_grade' END, CASE WHEN status <> 'complete' THEN 'run_is_not_complete' END, CASE WHEN graded < conds THEN 'one_or_more_conditions_are_not_decision_grade' END, CASE WHEN best <> 'supported' THEN 'best_tested_result_is_not_statistically_supported' END, CASE WHEN id % 19 = 0 THEN 'strict_native_completion_validation_required' END,
  CASE WHEN id % 23 = 0 THEN 'streaming_required_for_decision_grade' END, CASE WHEN id % 29 = 0 THEN 'live_inference_evidence_required' END, CASE WHEN id % 3 = 1 THEN 'runtime_verified_engine_flags_required' END, CASE WHEN id % 37 = 0 THEN 'explicit_cache_policy_required' END, CASE WHEN id % 41 = 0 THEN 'immutable_model_revision_required' END,
  CASE WHEN id % 43 = 0 THEN 'complete_runtime_provenance_required' END, CASE WHEN id % 47 = 0 THEN 'warmup_prompts_must_be_disjoint' END, CASE WHEN id % 2 = 1 THEN 'immutable_image_digest_required' END], lambda x: x IS NOT NULL)) AS why FROM b)
SELECT id, status, CASE WHEN status = 'complete' THEN NULL ELSE stop END AS stop_reason, CASE WHEN best = 'supported' AND len(why) > 0 THEN 'inconclusive' ELSE best END AS best_state, CASE WHEN best = 'supported' AND len(why) > 0 THEN 'run_manifest_or_evidence_is_not_decision_eligible' WHEN status <> 'complete' THEN 'partial_or_failed_run' END AS best_reason,
  array_to_string(why, ',') AS reasons, len(why) = 0 AS decision_eligible, CASE WHEN tokens > 0 THEN round(spend / tokens * 1e6, 6) END AS per_million FROM w""")  # fmt: skip
def a08(spark, d):
    k = F.col("c_custkey")
    runtimes = F.array(*[F.from_json(F.lit(json.dumps(r)), reports.RUNTIME) for r in (_RUNTIME, {**_RUNTIME, "image_digest": "repo/image:1"})])
    odd = lambda n, a, b: F.when(k % n == 0, a).otherwise(b)
    runs_: DataFrame = spread(table(spark, d, "customer").select("c_custkey")).select(
        k.alias("id"), odd(5, "smoke", "benchmark").alias("mode"), odd(7, "failed", "complete").alias("status"), F.when(k % 7 == 0, "max_errors").when(k % 71 == 1, "max_requests").alias("stop_reason"), (30 + k % 31).cast("double").alias("elapsed_seconds"), F.lit(60.0).alias("max_elapsed_seconds"), ((k % 13) / 2.0).alias("spend_estimate"), F.lit(6.0).alias("max_estimated_spend"),
        (1 + k % 3).alias("conditions"), (1 + k % 3 - odd(11, 1, 0)).alias("graded"), odd(17, "inconclusive", "supported").alias("best_state"), odd(19, "other", "native").alias("backend"), (k % 23 != 0).alias("stream"), odd(29, "replay", "live_inference").alias("evidence_source"), F.when(k % 3 == 1, "operator_attested").otherwise("runtime_verified").alias("flags_provenance"), odd(37, "unknown", "off").alias("cache_policy"),
        odd(41, "main", "a" * 40).alias("model_revision"), odd(43, "unknown", "1").alias("server_version"), (k % 47 != 0).alias("warmup_prompts_disjoint"), F.lit("1.1").alias("manifest_version"), runtimes[(k % 2).cast("int")].alias("runtime"), ((k % 13) / 2.0).alias("total_cost"), (k * 100).alias("completion_tokens"),
    )
    got = reports.finalize(runs_)
    return got.select("id", "status", F.when(F.col("status") != "complete", F.col("stop_reason")).alias("stop_reason"), "best_state", "best_reason", F.array_join("reasons", ",").alias("reasons"), "decision_eligible", F.round("cost_per_million_output_tokens", 6).alias("per_million"))


def ledger(spark, d) -> DataFrame:
    """A ledger of pilots made of orders, a day apart, for 40 accounts in 10 groups."""
    k = F.col("o_orderkey")
    day = lambda n: F.concat(F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (k % 200 + n).cast("int")), "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    yes = lambda c: F.when(c, "true").otherwise("false")
    decided, paid = k % 3 != 0, k % 11 == 0
    cells = {
        "pilot_id": F.concat(F.lit("p"), F.lpad(k.cast("string"), 12, "0")), "org_id": F.concat(F.lit("o"), F.col("o_custkey") % 40), "segment_code": F.when(k % 17 == 0, "other").otherwise("online_serving"), "source_channel": F.lit("referral"), "decision_kind": F.when(k % 4 == 0, "other_supported_engine_flag").otherwise("max_num_seqs"), "qualified": yes(k % 5 != 0),
        "real_traffic_started": yes(k % 6 != 0), "benchmark_valid": yes(k % 7 != 0), "minutes_to_valid": F.when(k % 23 == 0, "soon").otherwise((k % 50).cast("string")), "session_started_at": day(0), "session_completed_at": F.when(k % 29 == 0, day(-1)).otherwise(day(1)), "verified_decision_code": F.when(decided, "deployed").otherwise("none"), "verified_decision_at": F.when(decided, day(3)),
        "unprompted_return_at": F.when(decided & (k % 8 == 0), F.when(k % 16 == 0, day(10)).otherwise(day(40))), "unprompted_return_for_real_decision": yes(k % 8 == 0), "introduction_kind": F.when(k % 9 == 0, "unsolicited_peer").otherwise("none"), "introduced_operator_qualified": yes(k % 9 == 0), "paid_invoice": yes(paid), "paid_invoice_at": F.when(paid, day(9)), "amount_collected_usd": F.when(paid, F.lit("100")),
    }
    names = [c.split("`")[1] for c in pilot.LEDGER.split(", ")]
    return table(spark, d, "orders").select((k % 10).alias("group"), *[cells.get(n, F.lit(None)).cast("string").alias(n) for n in names])


@query("s10_ledger_gates", """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 10 AS grp, o_custkey % 40 AS org FROM orders), f AS (SELECT *, k % 17 = 0 OR k % 23 = 0 OR k % 29 = 0 AS bad FROM r), g AS (SELECT *, k % 5 <> 0 AS q, k % 3 <> 0 AS dec, k % 5 <> 0 AND k % 7 <> 0 AS val FROM f WHERE NOT bad),
b AS (SELECT grp, count(*) FILTER (bad)::BIGINT AS faulty FROM f GROUP BY grp),
n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY k % 200, k) AS i FROM g WHERE val), v AS (SELECT grp, count(*) FILTER (dec) AS d5, count(*) FILTER (dec AND (k % 16 = 0 OR k % 9 = 0)) AS p5, count(*) AS n5 FROM n WHERE i <= 5 GROUP BY grp),
m AS (SELECT grp, max(c) AS pat FROM (SELECT grp, k % 4 = 0 AS kind, count(DISTINCT org) AS c FROM g WHERE dec GROUP BY ALL) GROUP BY grp),
a AS (SELECT grp, count(*) FILTER (q AND k % 6 <> 0) AS started, count(*) FILTER (val) AS completed, median((k % 50)::DOUBLE) FILTER (val) AS med, count(DISTINCT org) FILTER (dec) AS dorgs, count(DISTINCT org) FILTER (k % 11 = 0) AS porgs, count(DISTINCT org) FILTER (val) AS vorgs, count(*) FILTER (dec AND k % 16 = 0) AS rets, count(*) FILTER (k % 9 = 0) AS intro FROM g GROUP BY grp)
SELECT grp, faulty, started, completed, med AS median_minutes, dorgs AS decided_orgs, porgs AS paid_orgs, rets AS returns, intro AS introductions, coalesce(pat, 0) AS pattern_orgs, started >= 5 AND completed >= 3 AND coalesce(med < 30, false) AS activation, coalesce(n5 = 5 AND d5 >= 2 AND p5 >= 1, false) AS decision_value, dorgs >= 3 AND porgs >= 2 AS payment, vorgs >= 5 AND rets >= 3 AND intro >= 2 AND coalesce(pat, 0) >= 3 AS pull
FROM a LEFT JOIN v USING (grp) LEFT JOIN m USING (grp) JOIN b USING (grp)""")
def s10(spark, d):
    """The ledger is written as CSV, read back, judged, and its gates counted by group over the rows without a fault."""
    at = report_store.shared_folder(spark, "ledger")
    ledger(spark, d).write.option("header", True).csv(f"{at}/csv")
    read = pilot.read_ledger(spark, f"{at}/csv", "`group` bigint")
    judged = pilot.ledger_faults(read)
    sound = F.size("faults") == 0
    faulty = judged.groupBy("group").agg(F.count_if(~sound).alias("faulty"))
    return pilot.gates(judged.where(sound), ["group"]).join(faulty, "group").withColumnRenamed("group", "grp")


#: A session that may run; queries and tests change it.
SESSION = {
    "baseline": {"name": "max_num_seqs", "value": "4"}, "candidate": {"name": "max-num-seqs", "value": "8"}, "backend": "native", "stream": True, "conditions": [{"kind": "closed_loop", "value": 8.0, "max_in_flight": 8}], "blocks": 3, "requests_per_block": 70, "warmup_requests": 5, "max_tokens": 128, "evidence_source": "live_inference", "cache_policy": "off",
    "flags_provenance": "runtime_verified", "variant": "unspecified", "sequence_position": "unspecified", "model_revision": "a" * 40, "server_version": "1", "flags": {"dtype": "auto"}, "warmup_separate": True, "warmup_disjoint": True, "runtime": _RUNTIME, "cost": {"currency": "USD", "kind": "dedicated_hourly", "total_hourly_rate": 3.6, "gpu_count": 1},
    "limits": {"max_requests": 2000, "max_tokens_per_request": 256, "max_total_requested_tokens": 200_000, "max_concurrency": 8, "max_response_bytes": 1000, "max_errors": 1, "max_elapsed_seconds": 600.0, "max_estimated_spend": 3.0}, "unknown_cost_allowed": False,
}


@query("r18_protocol_plan", """WITH r AS (SELECT c_custkey AS id, 1 + c_custkey % 10 AS lo, 1 + c_nationkey % 10 AS hi, 6 + c_custkey % 5 AS conc, 2 + c_custkey % 3 AS blocks, CASE WHEN c_custkey % 9 <> 4 THEN 55 + c_custkey % 30 END AS per, c_custkey % 6 AS warm FROM customer),
s AS (SELECT *, blocks * per + warm AS req, CASE WHEN lo = hi THEN 8 ELSE greatest(lo, hi) END AS most FROM r)
SELECT id, array_to_string(list_sort(list_filter([CASE WHEN lo = hi THEN 'golden_max_num_seqs_values_must_be_distinct' END, CASE WHEN conc < most THEN 'golden_concurrency_must_reach_both_max_num_seqs_values' END, CASE WHEN blocks < 3 THEN 'golden_requires_at_least_three_blocks' END, CASE WHEN per IS NULL THEN 'golden_orchestrator_requires_count_bounded_blocks' END,
  CASE WHEN blocks * per < 200 THEN 'golden_requires_at_least_200_measured_requests_per_position' END, CASE WHEN warm = 0 THEN 'golden_requires_separate_warmup_requests' END, CASE WHEN id % 7 = 0 THEN 'golden_requires_native_backend' END, CASE WHEN id % 11 = 0 THEN 'max_num_seqs_must_use_baseline_and_candidate_config_flags' END, CASE WHEN id % 13 = 0 THEN 'golden_runtime_immutable_image_digest_required' END,
  CASE WHEN per IS NULL THEN 'golden_session_request_count_must_be_exact' END, CASE WHEN 6 * req > 1500 THEN 'golden_session_requests_exceed_max_requests' END, CASE WHEN 6 * req * 128 > 180000 THEN 'golden_session_tokens_exceed_total_token_limit' END], lambda x: x IS NOT NULL)), ',') AS reasons,
 CASE WHEN lo <> hi THEN 'B1=' || lo || ',C1=' || hi || ',B2=' || lo || ',C2=' || hi || ',B3=' || lo || ',C3=' || hi END AS positions, (6 * req)::BIGINT AS session_requests, (6 * req * 128)::BIGINT AS session_tokens FROM s""")  # fmt: skip
def r18_protocol(spark, d):
    k = F.col("c_custkey")
    s = F.from_json(F.lit(json.dumps(SESSION)), protocol_plan.SESSION)
    s = s.withField("baseline.value", (1 + k % 10).cast("string")).withField("candidate.value", (1 + F.col("c_nationkey") % 10).cast("string")).withField("blocks", (2 + k % 3).cast("int")).withField("requests_per_block", F.when(k % 9 != 4, 55 + k % 30).cast("int")).withField("warmup_requests", (k % 6).cast("int"))
    load = F.array(F.struct(F.lit("closed_loop").alias("kind"), (6 + k % 5).cast("double").alias("value"), (6 + k % 5).cast("int").alias("max_in_flight")))
    s = s.withField("conditions", load).withField("backend", F.when(k % 7 == 0, "other").otherwise("native")).withField("flags", F.when(k % 11 == 0, F.create_map(F.lit("max_num_seqs"), F.lit("9"))).otherwise(F.create_map(F.lit("dtype"), F.lit("auto"))))
    s = s.withField("runtime.image_digest", F.when(k % 13 == 0, "repo/image:1").otherwise(s["runtime"]["image_digest"])).withField("limits.max_requests", F.lit(1500).cast("long")).withField("limits.max_total_requested_tokens", F.lit(180_000).cast("long"))
    got = protocol_plan.plan(spread(table(spark, d, "customer").select("c_custkey", "c_nationkey")).select(k.alias("id"), s.alias("session")))
    said = F.array_join(F.transform("positions", lambda p: F.concat(p["position"], F.lit("="), p["max_num_seqs"])), ",")
    return got.select("id", F.array_join("reasons", ",").alias("reasons"), said.alias("positions"), "session_requests", F.col("session_requested_output_tokens").alias("session_tokens"))
