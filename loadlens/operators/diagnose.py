"""Bottleneck regime from probes at several concurrencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.functions.stats import reasons

# Thresholds of the regimes and of evidence quality.
LEAST_VALID, MOST_ERRORS, MOST_CV = 10, 0.5, 1.0
CONFIDENCE = {"dispatch-bound": 0.80, "orchestration-bound": 0.70, "compute-bound": 0.85, "memory-bound": 0.75, "mixed": 0.50}
RECOMMENDATION = {
    "dispatch-bound": "reduce per-request dispatch work before adding load",
    "orchestration-bound": "look at the client and scheduler path between tokens",
    "compute-bound": "add compute or reduce work per token",
    "memory-bound": "reduce memory pressure at prefill",
    "mixed": "no single regime explains the probes",
    "inconclusive": "collect more valid probes",
}


def features(probes: DataFrame, keys: list[str]) -> DataFrame:
    """Scaling efficiency, first-token dominance and coefficients of variation of probes.

    Needs concurrency, throughput, ttft_mean_ms, tpot_mean_ms, valid_count and attempted_count, one row per concurrency.
    """
    ok = (F.col("valid_count") > 0) & F.col("throughput").isNotNull()
    at = lambda f, c: f(F.when(ok, F.col(c)), F.when(ok, F.col("concurrency")))
    cv = lambda c: F.when((F.count(F.when(ok, F.col(c))) >= 2) & (F.avg(F.when(ok, F.col(c))) > 0), F.try_divide(F.stddev_samp(F.when(ok, F.col(c))), F.avg(F.when(ok, F.col(c)))))
    got = probes.groupBy(*keys).agg(
        F.sum("valid_count").alias("_valid"), F.sum("attempted_count").alias("_all"), F.count_if(ok).alias("_levels"), at(F.min_by, "throughput").alias("_low"), at(F.max_by, "throughput").alias("_high"),
        F.min(F.when(ok, F.col("concurrency"))).alias("_c0"), F.max(F.when(ok, F.col("concurrency"))).alias("_c1"), F.coalesce(F.avg(F.when(ok, F.col("ttft_mean_ms"))), F.lit(0.0)).alias("_ttft"), F.coalesce(F.avg(F.when(ok, F.col("tpot_mean_ms"))), F.lit(0.0)).alias("_tpot"),
        F.coalesce(cv("tpot_mean_ms"), F.lit(0.0)).alias("tpot_cv"), cv("ttft_mean_ms").alias("_ttft_cv"),
    )
    floor = lambda c: F.when(F.col(c) == 0, 0.001).otherwise(F.col(c))
    ratio = F.greatest(F.try_divide("_c1", F.greatest("_c0", F.lit(1))), F.lit(1.0))
    return got.withColumns({"scaling_efficiency": floor("_high") / F.greatest(floor("_low"), F.lit(0.001)) / ratio, "ttft_dominance": F.coalesce(F.try_divide("_ttft", F.col("_ttft") + F.col("_tpot")), F.lit(0.0))})


def classify(probes: DataFrame, keys: list[str]) -> DataFrame:
    """Regime, confidence, evidence to three places, quality issues and recommendation of each group of probes."""
    f = features(probes, keys)
    one = F.col("_levels") < 2
    few = F.col("_valid") < LEAST_VALID
    issues = reasons(
        (few, "insufficient_valid_samples"), (F.try_divide(F.col("_all") - F.col("_valid"), F.col("_all")) > MOST_ERRORS, "high_error_rate"), (one & ~few, "insufficient_valid_concurrency_levels"),
        (~one & (F.col("tpot_cv") > MOST_CV), "high_tpot_variance"), (~one & (F.col("_ttft_cv") > MOST_CV), "high_ttft_variance"),
    )
    eff, dom, cv = F.col("scaling_efficiency"), F.col("ttft_dominance"), F.col("tpot_cv")
    kind = (
        F.when(F.size(issues) > 0, "inconclusive")
        .when((eff < 0.5) & (dom > 0.6) & (dom <= 0.70), "dispatch-bound")
        .when((eff < 0.6) & (dom < 0.4), "orchestration-bound")
        .when((cv < 0.25) & (eff > 0.70), "compute-bound")
        .when((dom > 0.70) & (eff < 0.45), "memory-bound")
        .otherwise("mixed")
    )
    look = lambda table, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("classification")), F.lit(other))
    out = f.withColumn("classification", kind).withColumn("quality_issues", issues)
    shown = lambda c: F.when(~one, F.round(c, 3))
    return out.select(*keys, "classification", look(CONFIDENCE, 0.0).alias("confidence"), shown(eff).alias("scaling_efficiency"), shown(dom).alias("ttft_dominance"), shown(cv).alias("tpot_cv"), "quality_issues", look(RECOMMENDATION, "").alias("recommendation"))
