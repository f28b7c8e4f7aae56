"""Requests to blocks, conditions and runs: counts, metrics, grades, costs and the best tested condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.functions import stats

# Floors and tolerances that define a decision.
LEAST_BLOCKS, LEAST_REQUESTS, LEAST_SECONDS = 3, 200, 60.0
TOKEN_TOLERANCE = 0.05
RATE_TOLERANCE, LAG_TOLERANCE = 0.05, 1.0
FINISH_REASONS = ("stop", "length", "content_filter")


def valid(status: str = "status_code", error: str = "error_code", completion: str = "completion_tokens", prompt: str = "prompt_tokens", finish: str = "finish_reason") -> Column:
    """A response counts if it has status 200, no error, output, a prompt count and a finish reason."""
    return F.coalesce((F.col(status) == 200) & F.col(error).isNull() & (F.col(completion) > 0) & F.col(prompt).isNotNull() & F.col(finish).isNotNull(), F.lit(False))


def generated() -> Column:
    """A valid response that the model produced (no cache hit)."""
    return valid() & ~F.coalesce("cache_hit", F.lit(False))


def within_slo(e2e_ms: float | None, ttft_ms: float | None) -> Column:
    """Whether a request meets the thresholds that are set; a missing first-token time fails one."""
    ok = F.lit(True)
    if e2e_ms is not None:
        ok = ok & (F.col("e2e_seconds") * 1000 <= e2e_ms)
    if ttft_ms is not None:
        ok = ok & F.coalesce(F.col("ttft_seconds") * 1000 <= ttft_ms, F.lit(False))
    return ok


def _histogram(rows: Column, field: str) -> Column:
    """Sorted (key, n) of the values of a field in an array of counted combinations; null without any."""
    values = F.array_sort(F.array_distinct(F.array_compact(F.transform(rows, lambda r: r[field]))))
    entries = F.transform(values, lambda v: F.struct(v.alias("key"), F.aggregate(F.filter(rows, lambda r: r[field] == v), F.lit(0).cast("long"), lambda n, r: n + r["n"]).alias("n")))
    return F.when(F.size(values) > 0, entries)


def request_counts(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Attempted, valid and invalid requests per group, and sorted counts by status (null: transport), error and finish reason.

    Requests are counted by combination of codes before the shuffle; what meets in a group is one row a combination.
    """
    parts = {
        "status_counts": F.coalesce(F.col("status_code").cast("string"), F.lit("transport")),
        "error_counts": F.when(F.col("error_code") != "", F.col("error_code")),
        "finish_reason_counts": F.when(F.col("finish_reason") != "", F.col("finish_reason")),
    }
    coded = requests.select(*keys, valid().alias("_ok"), *[v.alias(f"_{k}") for k, v in parts.items()])
    counted = coded.groupBy(*keys, *[f"_{k}" for k in parts]).agg(F.count("*").alias("n"), F.count_if("_ok").alias("_valid"))
    out = counted.groupBy(*keys).agg(F.sum("n").alias("attempted"), F.sum("_valid").alias("valid"), F.collect_list(F.struct("n", *[f"_{k}" for k in parts])).alias("_rows"))
    return out.select(*keys, "attempted", "valid", (F.col("attempted") - F.col("valid")).alias("invalid"), *[_histogram(F.col("_rows"), f"_{k}").alias(k) for k in parts])


def _totals(requests: DataFrame, keys: list[str], e2e_ms: float | None, ttft_ms: float | None, percentiles: bool) -> DataFrame:
    """Counts, tokens, span and latency summaries per group: one aggregation, and two more passes for exact percentiles of inputs of any size."""
    one = percentiles and stats.fits_one_task(requests)
    ok, gpu = valid(), generated()
    hit = ok & F.coalesce("cache_hit", F.lit(False))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    tokens = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long")
    ms = {n: stats.finite(F.when(gpu, F.col(c)) * 1000.0) for n, c in (("e2e_ms", "e2e_seconds"), ("ttft_ms", "ttft_seconds"))}
    out = requests.groupBy(*keys).agg(
        F.count("*").alias("attempted"), F.count_if(ok).alias("valid"), tokens("completion_tokens", ok).alias("completion_tokens"), tokens("prompt_tokens", ok).alias("prompt_tokens"),
        tokens("completion_tokens", gpu).alias("gpu_completion_tokens"), F.count_if(hit).alias("cache_hit_count"), tokens("completion_tokens", hit).alias("cache_completion_tokens"),
        F.count_if(ok & within_slo(e2e_ms, ttft_ms)).alias("slo_passing"), ((F.max(micros) - F.min(micros)) / 1e6).alias("wall_seconds"),
        *[c for n, v in ms.items() for c in (F.count(v).alias(f"_n_{n}"), F.avg(v).alias(f"_m_{n}"), *([stats.points(v).alias(f"_p_{n}")] if one else []))],
    )
    plain = [c for c in out.columns if c not in keys and not c.startswith("_")]
    part = lambda n: (F.col(f"_n_{n}"), F.col(f"_m_{n}"))
    if not percentiles:
        return out.select(*keys, *plain, *[F.struct(part(n)[0].alias("count"), part(n)[1].alias("mean")).alias(n) for n in ms])
    if one:
        return out.select(*keys, *plain, *[stats.summary_struct(*part(n), F.col(f"_p_{n}")).alias(n) for n in ms])
    both = stats.join_same(out, stats.percentiles(requests, keys, ms), keys, "left")
    return both.select(*keys, *plain, *[stats.summary_struct(*part(n), F.col(n)).alias(n) for n in ms])


def _rates(totals: DataFrame, slo: bool) -> DataFrame:
    positive = F.when(F.col("wall_seconds") > 0, F.col("wall_seconds"))
    return totals.select(
        "*", F.try_divide("valid", positive).alias("requests_per_second"), F.try_divide("gpu_completion_tokens", positive).alias("output_tokens_per_second"),
        F.try_divide(F.col("attempted") - F.col("valid"), F.col("attempted")).alias("error_rate"),
        (F.try_divide("slo_passing", positive) if slo else F.lit(None).cast("double")).alias("goodput_per_second"),
    )


def metrics(requests: DataFrame, keys: list[str], e2e_ms: float | None = None, ttft_ms: float | None = None, percentiles: bool = True) -> DataFrame:
    """Diagnostic metrics per group over the requests' own span: tokens, rates, error rate, latency summaries (with ``percentiles``, or of count and mean alone) and goodput.

    Latencies and the token rate come from generated responses; goodput spans cache hits too. A null key is a group of its own.
    """
    return _rates(_totals(requests, keys, e2e_ms, ttft_ms, percentiles), e2e_ms is not None or ttft_ms is not None)


def block_report(blocks: DataFrame) -> DataFrame:
    """Validity and offered-rate evidence of blocks.

    Needs complete, attempted, valid, offered_requests, target_rate, launch_window_seconds and lag_p95_ms.
    """
    rate = F.when((F.col("target_rate").isNotNull()) & (F.col("launch_window_seconds") > 0) & (F.col("offered_requests") >= 2), (F.col("offered_requests") - 1) / F.col("launch_window_seconds"))
    off = F.abs(rate - F.col("target_rate")) / F.col("target_rate")
    lag = F.col("lag_p95_ms") / (1000.0 / F.col("target_rate"))
    reached = F.col("target_rate").isNull() | (F.coalesce(off <= RATE_TOLERANCE, F.lit(False)) & F.coalesce(lag <= LAG_TOLERANCE, F.lit(False)))
    return blocks.withColumns({
        "block_valid": F.col("complete") & (F.col("attempted") == F.col("valid")) & (F.col("attempted") > 0),
        "invalid_reasons": stats.reasons((~F.col("complete"), "incomplete_block"), (F.col("attempted") > F.col("valid"), "one_or_more_invalid_responses")),
        "achieved_offered_request_rate": rate, "offered_rate_relative_error": off, "scheduler_lag_interval_ratio_p95": lag, "open_loop_target_achieved": reached,
    })


def condition_aggregate(requests: DataFrame, keys: list[str], block: str = "block_index", e2e_ms: float | None = None, ttft_ms: float | None = None) -> DataFrame:
    """Conditions from requests: pooled metrics over the sum of the blocks' walls, and block means with Student-t intervals.

    Pooled percentiles come from the requests, repeated-block intervals from the blocks' own percentiles. Blocks and
    pools are groups of one aggregation, in which each request counts twice.
    """
    levels = F.array(F.struct(F.lit(False).alias("_pool"), F.col(block).alias("_block")), F.struct(F.lit(True).alias("_pool"), F.lit(None).cast(requests.schema[block].dataType).alias("_block")))
    groups = _totals(requests.select("*", F.inline(levels)), [*keys, "_pool", "_block"], e2e_ms, ttft_ms, True)
    one = ~F.col("_pool")
    rated = _rates(groups, False)
    of = lambda c: F.when(one, F.col(c))
    held = [c for c in groups.columns if c not in (*keys, "_pool", "_block", "wall_seconds")]
    over = rated.groupBy(*keys).agg(
        F.first(F.when(F.col("_pool"), F.struct(*held)), ignorenulls=True).alias("_held"), F.count_if(one).alias("blocks"), F.sum(of("wall_seconds")).alias("wall_seconds"),
        F.min(F.when(one, F.col("attempted") == F.col("valid"))).alias("all_blocks_valid"), stats.t_interval(of("output_tokens_per_second")).alias("tokens_ci"), stats.t_interval(of("requests_per_second")).alias("requests_ci"),
        stats.t_interval(of("e2e_ms.p95")).alias("e2e_p95_ci"), stats.t_interval(of("ttft_ms.p95")).alias("ttft_p95_ci"),
    )
    pooled = over.select(*keys, "_held.*", "wall_seconds", "blocks", "all_blocks_valid", "tokens_ci", "requests_ci", "e2e_p95_ci", "ttft_p95_ci")
    return _rates(pooled, e2e_ms is not None or ttft_ms is not None)


def grade(conditions: DataFrame, mode: str = "benchmark", target: Column | None = None, warmup: Column | None = None, open_loop: bool = False) -> DataFrame:
    """decision_grade and its sorted reasons of conditions (all_blocks_valid, blocks, valid, wall_seconds)."""
    reached, warm = target if target is not None else F.lit(True), warmup if warmup is not None else F.lit(True)
    few, floor = F.col("blocks") < LEAST_BLOCKS, (F.col("valid") < LEAST_REQUESTS) & (F.col("wall_seconds") < LEAST_SECONDS)
    benchmark = F.lit(mode == "benchmark")
    why = stats.reasons(
        (~warm, "warmup_failed"), (~F.col("all_blocks_valid"), "invalid_or_incomplete_block"), (~benchmark, "smoke_mode_is_not_decision_grade"),
        (benchmark & few, "fewer_than_three_blocks"), (benchmark & ~few & floor, "measurement_floor_not_met"),
        (benchmark & ~reached, "open_loop_target_rate_not_achieved" if open_loop else "closed_loop_target_concurrency_not_observed"),
    )
    return conditions.withColumn("decision_ineligible_reasons", why).withColumn("decision_grade", benchmark & warm & F.col("all_blocks_valid") & reached & ~few & ~floor)


def cost_columns(kind: Column, elapsed: Column, tokens: Column, hourly: Column, active_rate: Column, workers: Column, billed: Column, supplied: Column, limit: Column) -> dict[str, Column]:
    """Upper bound, elapsed estimate, final cost with its basis, and cost per million output tokens, by cost kind."""
    dedicated, active, given = kind == "dedicated_hourly", kind == "serverless_active_seconds", kind == "user_supplied"
    final = F.when(dedicated, hourly * elapsed / 3600.0).when(active, active_rate * billed).when(given, supplied)
    return {
        "upper_bound": F.when(dedicated, hourly * limit / 3600.0).when(active, F.greatest(active_rate * workers * limit, F.coalesce(active_rate * billed, F.lit(0.0)))).when(given, supplied),
        "elapsed_estimate": F.when(dedicated, hourly * elapsed / 3600.0).when(active, active_rate * workers * elapsed),
        "final_cost": final,
        "basis": F.when(dedicated, "observed_client_wall_time").when(active & billed.isNull(), "billing_active_seconds_not_supplied").when(active, "user_supplied_billed_active_seconds").when(given, "user_supplied_run_total").otherwise("billing_unknown"),
        "cost_per_million_output_tokens": F.when(tokens > 0, F.try_divide(final, tokens) * 1_000_000.0),
    }


def best_tested(conditions: DataFrame, run: list[str], value: str, e2e_ms: float | None = None, ttft_ms: float | None = None, mode: str = "benchmark") -> DataFrame:
    """Per run the valid condition of the highest block-mean token rate that meets the SLOs (the first by ``value`` on a tie), its state and reasons.

    Runs of only invalid conditions and runs where none meets the SLOs get a row that says so.
    """
    smoke = F.lit(mode == "smoke")
    meets = F.lit(True)
    for limit, ci in ((e2e_ms, "e2e_p95_ci"), (ttft_ms, "ttft_p95_ci")):
        if limit is not None:
            meets = meets & F.coalesce(F.col(f"{ci}.high") <= limit, F.lit(False))
    ok = F.col("all_blocks_valid")
    marked = conditions.withColumn("_eligible", ok & meets)
    w = Window.partitionBy(*run)
    ranked = marked.withColumns({
        "_first": F.row_number().over(w.orderBy(F.col("_eligible").desc(), F.col("tokens_ci.mean").desc_nulls_last(), value)),
        "_most": F.max(value).over(w), "_nvalid": F.count_if(ok).over(w), "_neligible": F.count_if("_eligible").over(w), "_grade": F.min(F.when(ok, F.col("decision_grade"))).over(w),
        "_hi": F.max(F.when(ok, F.try_divide("completion_tokens", "valid"))).over(w), "_lo": F.min(F.when(ok, F.try_divide("completion_tokens", "valid"))).over(w),
        "_tokens": F.min(F.when(ok, (F.col("completion_tokens") > 0) & (F.col("valid") > 0))).over(w),
    })
    rivals = F.collect_list(F.when(F.col("_eligible") & (F.col("_first") > 1), F.struct(F.col("tokens_ci.low").alias("l"), F.col("tokens_ci.high").alias("h")))).over(w)  # the conditions of one run
    overlap = F.exists("_rivals", lambda r: stats.intervals_overlap(F.col("tokens_ci.low"), F.col("tokens_ci.high"), r["l"], r["h"]))
    chosen = ranked.withColumn("_rivals", rivals).where("_first = 1").withColumn("_meets", overlap)
    spread = F.when(F.col("_tokens"), (F.col("_hi") - F.col("_lo")) / F.col("_hi"))
    comparable = F.coalesce(spread <= TOKEN_TOLERANCE, F.lit(False))
    bench, boundary = ~smoke, F.col(value) == F.col("_most")
    why = stats.reasons(
        (smoke, "smoke_sample_is_not_decision_grade"), (bench & ~F.col("_grade"), "one_or_more_tested_conditions_are_not_decision_grade"),
        (~comparable, "completion_tokens_per_response_not_comparable_across_conditions"), (bench & (F.col("_nvalid") > 1), "multi_condition_order_not_counterbalanced"),
        (bench & boundary, "search_boundary_reached"), (F.col("_meets"), "throughput_confidence_intervals_overlap"),
    )
    available = F.col("_neligible") > 0
    keep = lambda c: F.when(available, c)
    return chosen.select(
        *run, available.alias("available"), keep(F.col(value)).alias("value"), keep(F.col("tokens_ci.mean")).alias("block_mean_output_tokens_per_second"), keep(spread).alias("token_spread"), keep(boundary).alias("boundary_reached"),
        F.when(F.col("_nvalid") == 0, "invalid").when(~available, "inconclusive").when(smoke, "not_applicable_smoke").when(F.size(why) > 0, "inconclusive").otherwise("supported").alias("state"),
        F.when(F.col("_nvalid") == 0, F.array(F.lit("no_valid_conditions"))).when(~available, F.array(F.lit("no_valid_condition_meets_slo"))).otherwise(why).alias("reasons"),
    )


def merge_summaries(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries of blocks (count, mean) as one: a mean weighted by count; percentiles cannot be merged and are null."""
    mean = F.try_divide(F.sum(F.col("mean") * F.col("count")), F.sum("count"))
    none = [F.lit(None).cast("double").alias(p) for p in ("p50", "p90", "p95", "p99")]
    return summaries.groupBy(*keys).agg(F.sum("count").cast("long").alias("count"), mean.alias("mean")).select("*", *none)


def prefix_sums(rows: DataFrame, keys: list[str], order: list[str], slot: Column, sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running sums by ``keys`` in ``order``, in two passes, so that a group of any length is many tasks.

    ``slot`` cuts the order into pieces: it must not decrease along ``order`` (an hour of a time, a million of a number). Each piece is summed up on
    its own, sums before it are carried from the pieces before (one row a piece, combined before the shuffle), and the running sum inside a piece
    is a window of that piece alone. Null values count as zero.
    """
    given = rows.withColumns({"_slot": slot, **{f"_v{i}": F.coalesce(v, F.lit(0)) for i, v in enumerate(sums.values())}})
    pieces = given.groupBy(*keys, "_slot").agg(*[F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(sums))])
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slot").alias("_at"), *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_c{i}") for i in range(len(sums))])
    within = Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = given.withColumns({f"_r{i}": F.sum(f"_v{i}").over(within) for i in range(len(sums))})
    same = F.col("_slot").eqNullSafe(F.col("_at"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return inside.join(carried, same).select(*rows.columns, *[(F.col(f"_r{i}") + F.col(f"_c{i}")).cast("long").alias(name) for i, name in enumerate(sums)])


def running_budget(requests: DataFrame, keys: list[str], order: list[str], requests_limit: int, tokens_limit: int, errors_limit: int, slot: Column | None = None) -> DataFrame:
    """Running requests, tokens and errors in launch order, and the code of the first limit that each row stands at (null before). With ``slot`` a run is many tasks (``prefix_sums``)."""
    sums = {"run_requests": F.lit(1), "run_tokens": F.col("completion_tokens"), "run_errors": (~valid()).cast("int")}
    out = prefix_sums(requests, keys, order, F.lit(0) if slot is None else slot, sums)
    stop = F.when(F.col("run_requests") >= requests_limit, "max_requests").when(F.col("run_tokens") >= tokens_limit, "max_output_tokens").when(F.col("run_errors") >= errors_limit, "max_errors")
    return out.withColumn("stop", stop)


def peak_in_flight(spans: DataFrame, keys: list[str], start: str, end: str, width: int | None = None) -> DataFrame:
    """Most spans open at once per group, by a sweep over starts and ends; a span that ends when another starts is closed first.

    With ``width`` (of start and end, whole numbers) the sweep is cut into pieces of that width: each gives its own change and its highest prefix, and
    the peak is the highest of these above what the pieces before carry, so a group of any length is many tasks.
    """
    events = spans.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("e"))
    slot = F.lit(0) if width is None else F.floor(F.col("e.t") / width)
    inside = Window.partitionBy(*keys, "_slot").orderBy("e.t", "e.d").rowsBetween(Window.unboundedPreceding, 0)
    pieces = events.withColumn("_slot", slot).withColumn("_open", F.sum("e.d").over(inside)).groupBy(*keys, "_slot").agg(F.sum("e.d").alias("_d"), F.max("_open").alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("_peak", F.col("_top") + F.coalesce(F.sum("_d").over(before), F.lit(0))).groupBy(*keys).agg(F.max("_peak").cast("long").alias("peak_in_flight"))


def first_output(chunks: DataFrame, starts: DataFrame, keys: list[str], at: str, output: str, started: str) -> DataFrame:
    """ttft_seconds of each request of ``starts``: its first chunk that holds output less its start; null if none does."""
    first = chunks.where(F.col(output)).groupBy(*keys).agg(F.min(at).alias("_first"))
    return starts.join(first, keys, "left").select(*keys, (F.col("_first") - F.col(started)).alias("ttft_seconds"))
