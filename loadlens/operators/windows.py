"""Metric windows over exporter snapshots: counter deltas, histogram means, gauge maxima and their checks.

Samples are long form: keys of the run, seq, family, labels (sorted text or map text), value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Outcome classes of exporter finish reasons.
ALLOWED, DISALLOWED = ("stop", "length"), ("abort", "error", "repetition")


def outcome(reason: Column) -> Column:
    return F.when(reason.isin(*ALLOWED), "allowed").when(reason.isin(*DISALLOWED), "disallowed").otherwise("unclassified")


def resets(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Samples of a counter series that fall below the one before."""
    w = Window.partitionBy(*keys, "family", "labels").orderBy("seq")
    return samples.withColumn("previous", F.lag("value").over(w)).where("value < previous")


def series_deltas(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Last value less first value of each series."""
    return samples.groupBy(*keys, "family", "labels").agg((F.max_by("value", "seq") - F.min_by("value", "seq")).alias("delta"), F.count("*").alias("snapshots"))


def counter_deltas(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Per family the sum of its series' deltas: the difference is taken before the sum."""
    return series_deltas(samples, keys).groupBy(*keys, "family").agg(F.sum("delta").alias("delta"), F.count("*").alias("series"))


def outcome_counts(samples: DataFrame, keys: list[str], reason: Column) -> DataFrame:
    """Finished requests by outcome class of the series' reason."""
    deltas = series_deltas(samples, keys).withColumn("class", outcome(reason))
    total = lambda c: F.coalesce(F.sum(F.when(F.col("class") == c, F.col("delta"))), F.lit(0.0))
    return deltas.groupBy(*keys).agg(F.sum("delta").alias("requests_finished"), *[total(c).alias(f"{c}_finished_requests") for c in ("allowed", "disallowed", "unclassified")])


def histogram_mean_ms(sums: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """1000 * sum of sums / sum of counts over the series that both sides have; null if nothing was observed.

    ``paired`` is false where a series of one side lacks its partner.
    """
    s, c = (series_deltas(x, keys) for x in (sums, counts))
    both = s.select(*keys, "labels", F.col("delta").alias("s")).join(c.select(*keys, "labels", F.col("delta").alias("c")), [*keys, "labels"], "full_outer")
    total = F.sum("c")
    return both.groupBy(*keys).agg(F.when(total != 0, 1000.0 * F.try_divide(F.sum("s"), total)).alias("mean_ms"), total.cast("long").alias("observations"), F.min(F.col("s").isNotNull() & F.col("c").isNotNull()).alias("paired"))


def gauge_max(samples: DataFrame, keys: list[str], within: str = "sum") -> DataFrame:
    """Largest snapshot total of a gauge: series of one snapshot are summed, or their maximum is taken."""
    one = samples.groupBy(*keys, "family", "seq").agg((F.sum("value") if within == "sum" else F.max("value")).alias("v"))
    return one.groupBy(*keys, "family").agg(F.max("v").alias("max_value"))


def topology(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each family has the same series in every snapshot of a run."""
    series = samples.groupBy(*keys, "family", "labels").agg(F.count_distinct("seq").alias("n"))
    snapshots = samples.groupBy(*keys).agg(F.count_distinct("seq").alias("all"))
    return series.join(snapshots, keys).groupBy(*keys, "family").agg(F.min(F.col("n") == F.col("all")).alias("stable"), F.count("*").alias("series"))


def scopes_equal(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Number of label sets of each family, and whether all families of a run have the same."""
    sets = samples.select(*keys, "family", "labels").distinct().groupBy(*keys, "family").agg(F.array_sort(F.collect_list("labels")).alias("scope"))  # label sets of one family
    return sets.groupBy(*keys).agg(F.count_distinct("scope").alias("scopes"), (F.count_distinct("scope") == 1).alias("consistent"), F.max(F.size("scope")).alias("scope_count"))


def gaps(samples: DataFrame, keys: list[str], at: str, most: float = 5.0) -> DataFrame:
    """Seconds between neighbouring snapshots and whether they are in order and at most ``most``."""
    w = Window.partitionBy(*keys).orderBy("seq")
    gap = F.col(at) - F.lag(at).over(w)
    return samples.withColumn("gap", gap).withColumn("gap_ok", F.col("gap").isNull() | F.col("gap").between(0, most))


# Bounds of a polling window.
MOST_OBSERVATIONS, MOST_SAMPLES, MOST_GAP = 1024, 64_000, 5.0


def polling_windows(snapshots: DataFrame, keys: list[str], at: str, most_observations: int = MOST_OBSERVATIONS, most_samples: int = MOST_SAMPLES, most_gap: float = MOST_GAP) -> DataFrame:
    """One row per run of snapshots (seq, recognized_samples and their time ``at``): the first is before, the last after, those between are observations.

    ``code`` is the first fault: fewer than two snapshots, a gap below zero or above ``most_gap``, too many observations, too many samples.
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    gap = F.col(at) - F.lag(at).over(w)
    seen = snapshots.withColumn("_bad", F.coalesce(~gap.between(0.0, most_gap), F.lit(False)))
    got = seen.groupBy(*keys).agg(
        F.min("seq").alias("before_seq"), F.max("seq").alias("after_seq"), (F.count("*") - 2).alias("_n"), F.sum("recognized_samples").cast("long").alias("recognized_samples"),
        (F.max_by(at, "seq") - F.min_by(at, "seq")).alias("elapsed"), F.max("_bad").alias("_bad"),
    )
    code = (
        F.when(F.col("_n") < 0, "experimental_metrics_window_invalid").when(F.col("_bad"), "experimental_metrics_sample_gap_exceeded")
        .when(F.col("_n") > most_observations, "experimental_metrics_observation_limit").when(F.col("recognized_samples") > most_samples, "experimental_metrics_window_too_large")
    )
    return got.select(*keys, "before_seq", "after_seq", F.greatest("_n", F.lit(0)).cast("long").alias("observations"), "recognized_samples", "elapsed", code.alias("code"))


# Exporter names of the logical metrics of a window; where two are given the first that is there counts.
COUNTERS = {
    "requests_finished": ("vllm:request_success_total",), "output_tokens": ("vllm:generation_tokens_total",), "prompt_tokens": ("vllm:prompt_tokens_total",),
    "preemptions": ("vllm:num_preemptions_total", "vllm:num_preemptions"),
}
HISTOGRAMS = {
    "ttft": ("vllm:time_to_first_token_seconds",), "tpot": ("vllm:request_time_per_output_token_seconds",), "itl": ("vllm:inter_token_latency_seconds", "vllm:time_per_output_token_seconds"),
    "e2e": ("vllm:e2e_request_latency_seconds",), "queue": ("vllm:request_queue_time_seconds",), "prefill": ("vllm:request_prefill_time_seconds",), "decode": ("vllm:request_decode_time_seconds",),
}
GAUGES = {
    "requests_running": ("vllm:num_requests_running",), "requests_waiting": ("vllm:num_requests_waiting",), "requests_swapped": ("vllm:num_requests_swapped",),
    "kv_cache_usage": ("vllm:kv_cache_usage_perc", "vllm:gpu_cache_usage_perc"),
}
MEANS = {"ttft": "mean_ttft_ms", "tpot": "mean_tpot_ms", "itl": "mean_inter_token_latency_ms", "e2e": "mean_e2e_ms", "queue": "mean_queue_time_ms", "prefill": "mean_prefill_time_ms", "decode": "mean_decode_time_ms"}
RATED = {"requests_finished": "finished_requests_per_second", "output_tokens": "output_tokens_per_second", "prompt_tokens": "prompt_tokens_per_second"}


def _names() -> list[str]:
    plain = [n for part in (COUNTERS, GAUGES) for names in part.values() for n in names]
    return plain + [f"{n}_{end}" for names in HISTOGRAMS.values() for n in names for end in ("sum", "count")]


def assemble(samples: DataFrame, elapsed: DataFrame, keys: list[str]) -> DataFrame:
    """One window per run: counts, rates, means, maxima, sources, series counts and scopes, or the code of its first fault.

    ``samples``: keys, seq, family, labels (the series without its finish reason), reason, value; ``elapsed``: keys and
    elapsed_seconds. Other families are ignored. Faults in order: no positive finite time, a family that is not in every
    snapshot, a histogram without its sum or count, series that come or go, a falling counter, histogram sides with other
    series or a sum without observations, a count that is no whole number. The fields of a faulty window are null.
    """
    samples = samples.where(F.col("family").isin(_names()))
    own = [*keys, "family", "labels", "reason"]
    fell = F.coalesce(F.col("value") < F.lag("value").over(Window.partitionBy(*own).orderBy("seq")), F.lit(False))
    series = samples.withColumn("_fell", fell).groupBy(*own).agg((F.max_by("value", "seq") - F.min_by("value", "seq")).alias("d"), F.count("*").alias("n"), F.max("_fell").alias("fell"))
    delta = lambda c: F.coalesce(F.sum(F.when(outcome(F.coalesce("reason", F.lit(""))) == c, F.col("d"))), F.lit(0.0)).alias(c)
    by_series = series.groupBy(*keys, "family").agg(
        F.sum("d").alias("delta"), F.count("*").alias("series"), F.min("n").alias("least"), F.max("fell").alias("fell"), F.sort_array(F.collect_set("labels")).alias("scope"),
        F.sort_array(F.collect_list(F.struct("labels", "d"))).alias("by"), *[delta(c) for c in ("allowed", "disallowed", "unclassified")],
    )
    at = samples.groupBy(*keys, "family", "seq").agg(F.sum("value").alias("s"), F.max("value").alias("m")).groupBy(*keys, "family").agg(F.count("*").alias("seen"), F.max("s").alias("most"), F.max("m").alias("top"))
    row = [c for c in (*by_series.columns, *at.columns) if c not in keys and c != "family"]
    families = by_series.join(at, [*keys, "family"]).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("family", F.struct(*row)))).alias("_f"))  # at most one entry a known family
    snapshots = samples.groupBy(*keys).agg(F.count_distinct("seq").alias("observations"))
    got = elapsed.join(snapshots.join(families, keys), keys, "left")

    all_ = F.col("observations")
    there = lambda n: F.coalesce(F.map_contains_key("_f", n), F.lit(False))
    chosen = {logical: F.coalesce(*[F.when(there(n), F.lit(n)) for n in names]) for part in (COUNTERS, GAUGES) for logical, names in part.items()}
    bases = {logical: F.coalesce(*[F.when(there(f"{n}_sum") | there(f"{n}_count"), F.lit(n)) for n in names]) for logical, names in HISTOGRAMS.items()}
    ends = {f"{logical}_{end}": F.concat(base, F.lit(f"_{end}")) for logical, base in bases.items() for end in ("sum", "count")}
    used = F.array_compact(F.array(*chosen.values(), *ends.values()))
    at_ = lambda name: F.try_element_at("_f", name)
    counters = F.array_compact(F.array(*[chosen[c] for c in COUNTERS], *ends.values()))
    pairs = [(at_(ends[f"{h}_sum"]), at_(ends[f"{h}_count"])) for h in HISTOGRAMS]
    any_ = lambda conds: F.coalesce(F.greatest(*[F.coalesce(c, F.lit(False)) for c in conds]), F.lit(False))
    empty = lambda s, c: F.exists(F.arrays_zip(s["by"].alias("s"), c["by"].alias("c")), lambda p: (p["c"]["d"] == 0) & (p["s"]["d"] != 0))
    whole = [at_(chosen[c])["delta"] for c in COUNTERS] + [c["delta"] for _, c in pairs] + [at_(chosen[g])["most"] for g in GAUGES if g != "kv_cache_usage"]
    fine = F.col("elapsed_seconds") > 0
    code = (
        F.when(~F.coalesce(fine & (F.col("elapsed_seconds") < float("inf")), F.lit(False)), "metrics_invalid_elapsed")
        .when(all_.isNull() | (all_ < 2), "experimental_metrics_window_invalid")
        .when(F.exists("_used", lambda n: at_(n)["seen"] < all_), "metrics_alias_or_availability_changed").when(any_([s.isNull() != c.isNull() for s, c in pairs]), "metrics_histogram_pair_incomplete")
        .when(F.exists("_used", lambda n: at_(n)["least"] < all_), "metrics_series_topology_changed").when(F.exists("_counters", lambda n: at_(n)["fell"]), "metrics_counter_reset")
        .when(any_([s["scope"] != c["scope"] for s, c in pairs]), "metrics_histogram_series_mismatch").when(any_([empty(s, c) for s, c in pairs]), "metrics_histogram_delta_mismatch")
        .when(any_([x != F.floor(x) for x in whole]), "metrics_derived_value_out_of_range")
    )
    got = got.withColumn("_used", F.sort_array(used)).withColumn("_counters", counters).withColumn("code", code)
    out: dict[str, Column] = {"observations": all_}
    for c in COUNTERS:
        out[c] = at_(chosen[c])["delta"].cast("long")
        if c in RATED:
            out[RATED[c]] = F.try_divide(at_(chosen[c])["delta"], F.col("elapsed_seconds"))
    for h, (s, n) in zip(HISTOGRAMS, pairs, strict=True):
        out[MEANS[h]] = F.when(n["delta"] != 0, F.try_divide(s["delta"], n["delta"]) * 1000.0)
    for g in GAUGES:
        out["max_kv_cache_usage_fraction" if g == "kv_cache_usage" else f"max_{g}"] = at_(chosen[g])["top"] if g == "kv_cache_usage" else at_(chosen[g])["most"].cast("long")
    counted = [F.when(n.isNotNull(), F.struct(F.lit(logical).alias("key"), at_(n)["series"].alias("n"))) for logical, n in chosen.items()]
    counted += [F.when(at_(n).isNotNull(), F.struct(n.alias("key"), at_(n)["series"].alias("n"))) for n in ends.values()]
    out["source_families"] = F.col("_used")
    out["series_counts"] = F.sort_array(F.array_compact(F.array(*counted)))
    out["histogram_observation_counts"] = F.sort_array(F.array_compact(F.array(*[F.when(n.isNotNull(), F.struct(F.lit(h).alias("key"), n["delta"].cast("long").alias("n"))) for h, (_, n) in zip(HISTOGRAMS, pairs, strict=True)])))
    scopes = F.transform("_used", lambda n: at_(n)["scope"])
    out["metric_scope_consistent"] = (F.size("_used") > 0) & (F.size(F.array_distinct(scopes)) == 1)
    out["metric_scope_count"] = F.size(F.array_distinct(F.flatten(scopes)))
    for c in ("allowed", "disallowed", "unclassified"):
        out[f"{c}_finished_requests"] = at_(chosen["requests_finished"])[c].cast("long")
    good = F.col("code").isNull()
    return got.select(*keys, "elapsed_seconds", *[F.when(good, c).alias(name) for name, c in out.items()], F.lit("server_exporter_window").alias("scope"), F.lit("none").alias("decision_effect"), "code")
