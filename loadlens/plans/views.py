"""The views that the registered queries read: a request log, samples, probes and prompts, derived from the given tables.

Each view is stated twice: as a DataFrame and as the SQL that the results are checked against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores: a table of few bytes is few tasks, however much work each row is."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def spread_by(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Rows dealt to all cores by their ``key``, to more tasks the more rows there are: about ``most`` in one. They are counted first."""
    return rows.repartition(max(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most)), key)


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: three concurrencies, three blocks, six positions; a fifth of them are errors, some are cache hits."""
    e = table(spark, sf_dir, "events")
    k, ok = F.get_json_object("props", "$.k").cast("int"), F.col("event_type") != "error"
    return e.select(
        F.col("event_id").alias("request_id"), "ts", "user_id", F.expr("CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 8 END").alias("concurrency"),
        F.expr("cast((event_id div 3) % 3 + 1 as int)").alias("block_index"), F.expr("cast((event_id div 9) % 6 as int)").alias("position_idx"),
        F.when(ok, 200).otherwise(503).alias("status_code"), F.when(~ok, "non_200_response").alias("error_code"), F.when(ok, F.when(F.col("event_type") == "view", "length").otherwise("stop")).alias("finish_reason"),
        F.when(ok, k + 1).alias("completion_tokens"), F.when(ok, (F.col("user_id") % 64).cast("int")).alias("prompt_tokens"), (F.col("value") / 100.0).alias("e2e_seconds"), F.when(ok, F.col("value") / 400.0).alias("ttft_seconds"), ((k % 10 == 0) & ok).alias("cache_hit"),
    )


RL = """rl AS (
  SELECT event_id AS request_id, ts, user_id, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 8 END AS concurrency,
         CAST((event_id // 3) % 3 + 1 AS INT) AS block_index, CAST((event_id // 9) % 6 AS INT) AS position_idx,
         CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS status_code, CASE WHEN event_type = 'error' THEN 'non_200_response' END AS error_code,
         CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 'length' ELSE 'stop' END AS finish_reason,
         CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS INT) + 1 END AS completion_tokens,
         CASE WHEN event_type <> 'error' THEN CAST(user_id % 64 AS INT) END AS prompt_tokens, value / 100.0 AS e2e_seconds,
         CASE WHEN event_type <> 'error' THEN value / 400.0 END AS ttft_seconds,
         CAST(json_extract_string(props, '$.k') AS INT) % 10 = 0 AND event_type <> 'error' AS cache_hit
  FROM events),
v AS (SELECT *, status_code = 200 AND error_code IS NULL AND coalesce(completion_tokens > 0, false) AND prompt_tokens IS NOT NULL AND finish_reason IS NOT NULL AS ok FROM rl),
g AS (SELECT *, ok AND NOT cache_hit AS gpu FROM v)"""

SPAN = "((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6)"
T = "[12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042]"


def ci(x: str, side: str) -> str:
    """SQL of one bound of a Student-t interval over up to 31 values."""
    return f"(avg({x}) {'-' if side == 'low' else '+'} {T}[CAST(count({x}) - 1 AS INT)] * stddev_samp({x}) / sqrt(count({x})))"


#: Per-block metrics over ``g``, by the given keys.
def blocks_sql(keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS attempted, count(*) FILTER (ok) AS valid, coalesce(sum(completion_tokens) FILTER (ok), 0)::BIGINT AS completion_tokens,
       coalesce(sum(completion_tokens) FILTER (gpu), 0)::BIGINT AS gpu_completion_tokens, {SPAN} AS wall_seconds,
       count(*) FILTER (ok) / nullif({SPAN}, 0) AS requests_per_second, coalesce(sum(completion_tokens) FILTER (gpu), 0) / nullif({SPAN}, 0) AS output_tokens_per_second,
       quantile_cont(e2e_seconds * 1000.0, 0.95) FILTER (gpu) AS e2e_p95, quantile_cont(ttft_seconds * 1000.0, 0.95) FILTER (gpu) AS ttft_p95, avg(ttft_seconds * 1000.0) FILTER (gpu) AS ttft_mean
  FROM g GROUP BY {keys}"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counts (family count) and sums (family sum) of events by worker and type, one snapshot a day."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("run"), F.dayofyear("ts").alias("seq"), F.col("event_type").alias("labels"), "value")
    day = e.groupBy("run", "seq", "labels").agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("s"))
    w = Window.partitionBy("run", "labels").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = day.select("run", "seq", "labels", F.sum("n").over(w).alias("n"), F.sum("s").over(w).alias("s"))
    return cumulative.select("run", "seq", "labels", F.explode(F.map_from_arrays(F.array(F.lit("count"), F.lit("sum")), F.array("n", "s"))).alias("family", "value"))


SAMPLES = """day AS (SELECT user_id % 4 AS run, dayofyear(ts)::INT AS seq, event_type AS labels, count(*)::DOUBLE AS n, sum(value) AS s FROM events GROUP BY ALL),
cum AS (SELECT run, seq, labels, sum(n) OVER w AS n, sum(s) OVER w AS s FROM day WINDOW w AS (PARTITION BY run, labels ORDER BY seq ROWS UNBOUNDED PRECEDING)),
samples AS (SELECT run, seq, labels, 'count' AS family, n AS value FROM cum UNION ALL SELECT run, seq, labels, 'sum', s FROM cum)"""


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 4).alias("run"), F.dayofyear("ts").alias("seq"), F.col("event_type").alias("labels")).agg(F.count("*").cast("double").alias("value")).withColumn("family", F.lit("running"))


GAUGES = "gauges AS (SELECT user_id % 4 AS run, dayofyear(ts)::INT AS seq, event_type AS labels, count(*)::DOUBLE AS value, 'running' AS family FROM events GROUP BY ALL)"
