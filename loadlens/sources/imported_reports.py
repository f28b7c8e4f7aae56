"""Aggregate reports of the other load generator: an allowlist of numeric paths, read from a report's tree in one pass.

Nothing but these numbers leaves a report. What must hold of each path is data (PATHS); the first path that fails, in their order, names the code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.operators.contract import nodes
from loadlens.sources.files import SAFE_INT, strict_json

# Fixed values of the format: versions, fields of a summary and of totals, the metrics, and those with one value a request.
VERSION, TOOL_VERSION, KIND = 2, "0.7.3", "generative_benchmark"
SUMMARY = ("mean", "median", "mode", "variance", "std_dev", "min", "max", "count", "total_sum")
PERCENTILES = ("p50", "p90", "p95", "p99")
TOTALS = ("successful", "errored", "incomplete", "total")
METRICS = ("requests_per_second", "request_concurrency", "request_latency", "time_to_first_token_ms", "time_per_output_token_ms", "inter_token_latency_ms", "output_tokens_per_second", "prompt_token_count", "output_token_count")
PER_REQUEST = ("requests_per_second", "request_concurrency", "request_latency", "time_to_first_token_ms", "prompt_token_count", "output_token_count")
SHAPE, NUMBER, UNEQUAL = "invalid_report_shape", "invalid_report_number", "inconsistent_report_totals"

_B = "/benchmarks/[0]"
_M, _S = f"{_B}/metrics", f"{_B}/scheduler_metrics"


def _totals(at: str) -> list[tuple[str, str]]:
    return [(at, "object"), *((f"{at}/{t}", "count") for t in TOTALS)]


def _summary(name: str) -> list[tuple[str, str]]:
    at = f"{_M}/{name}/successful"
    return [(f"{_M}/{name}", "object"), (at, "object"), *((f"{at}/{f}", "count" if f == "count" else "number") for f in SUMMARY), (f"{at}/percentiles", "object"), *((f"{at}/percentiles/{p}", "number") for p in PERCENTILES)]


#: Paths in the order in which they are judged, in the steps between which totals are compared: (path, what stands there).
PATHS = {
    "head": [("", "object"), ("/metadata", "object"), ("/metadata/version", "integer")],
    "totals": [("/benchmarks", "array"), (_B, "object"), (f"{_B}/duration", "number"), (_M, "object"), *_totals(f"{_M}/request_totals")],
    "scheduler": [(_S, "object"), *_totals(f"{_S}/requests_made")],
    "summaries": [x for m in METRICS for x in _summary(m)],
}
_TEXTS = ("/metadata/guidellm_version", f"{_B}/type_", "/benchmarks/[1]")


def _wrong(what: Column, kind: Column, value: Column) -> Column:
    """The code of a node that is not what the path asks for; null for a sound one."""
    number = F.when(kind.isin("integer", "number"), value.try_cast("double"))
    bounded = F.coalesce((number >= 0) & (number <= SAFE_INT), F.lit(False))
    return (
        F.when(what.isin("object", "array"), F.when(~F.coalesce(kind == what, F.lit(False)), SHAPE)).when(what == "integer", F.when(~F.coalesce(kind == "integer", F.lit(False)), NUMBER))
        .when(what == "count", F.when(~(F.coalesce(kind == "integer", F.lit(False)) & bounded), NUMBER)).otherwise(F.when(~bounded, NUMBER))
    )


def imported_reports(reports: DataFrame, key: str = "id", report: str = "report") -> DataFrame:
    """key, code, duration_seconds, the four totals, success_rate, error_rate, prompt_tokens, output_tokens and metrics (``name.field`` to number) of each report.

    ``code`` is the first thing that is wrong; everything else is null then. Only nodes on the allowlist leave the report's row, and meet by
    report in one group of at most as many rows as the list is long. Repeated keys count as one report and must not occur.
    """
    spark = reports.sparkSession
    rows = reports.select(key, strict_json(F.col(report)).alias("root"))
    allowed = F.broadcast(spark.createDataFrame([(p,) for step in PATHS.values() for p, _ in step] + [(p,) for p in _TEXTS], "path string"))  # a fixed number of rows
    found = nodes(rows, key, "root", 7).join(allowed, "path", "left_semi").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("path", F.struct("kind", "value")))).alias("n"))
    all_ = rows.select(key, F.col("root").isNull().alias("_broken")).join(found, key, "left")
    at = lambda path: F.try_element_at("n", F.lit(path))
    count = lambda path: at(path)["value"].try_cast("double").cast("long")
    number = lambda path: at(path)["value"].try_cast("double")

    def first(step: str) -> Column:
        listed = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(w).alias("w")) for p, w in PATHS[step]])
        judged = F.transform(listed, lambda x: _wrong(x["w"], F.try_element_at("n", x["p"])["kind"], F.try_element_at("n", x["p"])["value"]))
        return F.try_element_at(F.filter(judged, lambda c: c.isNotNull()), F.lit(1))

    no = lambda c: ~F.coalesce(c, F.lit(False))
    made = [count(f"{_M}/request_totals/{t}") for t in TOTALS]
    scheduled = [count(f"{_S}/requests_made/{t}") for t in TOTALS]
    whole = lambda m: number(f"{_M}/{m}/successful/total_sum")
    differ = F.lit(False)
    for a, b in zip(made, scheduled, strict=True):
        differ = differ | no(a == b)
    counted = F.lit(False)
    for m in PER_REQUEST:
        counted = counted | no(count(f"{_M}/{m}/successful/count") == made[0])
    code = F.coalesce(
        F.when(F.col("_broken"), "invalid_report_json"), first("head"), F.when(no(number("/metadata/version") == VERSION), "unsupported_report_schema"), F.when(no(at("/metadata/guidellm_version")["value"] == TOOL_VERSION) | no(at("/metadata/guidellm_version")["kind"] == "string"), "unsupported_report_version"),
        F.when(at("/benchmarks/[1]").isNotNull(), SHAPE), F.when(at(_B).isNotNull() & no(at(f"{_B}/type_")["value"] == KIND), SHAPE), first("totals"), F.when(no(made[0] + made[1] + made[2] == made[3]), UNEQUAL), F.when((made[3] > 0) & no(number(f"{_B}/duration") > 0), "invalid_report_duration"),
        first("scheduler"), F.when(no(scheduled[0] + scheduled[1] + scheduled[2] == scheduled[3]) | differ, UNEQUAL), first("summaries"), F.when(counted, UNEQUAL), F.when(no(whole("prompt_token_count") == F.floor(whole("prompt_token_count"))) | no(whole("output_token_count") == F.floor(whole("output_token_count"))), NUMBER),
    )
    judged = all_.withColumn("code", code)
    keep = lambda c: F.when(F.col("code").isNull(), c)
    head, tail = f"{_M}/", "/successful/"
    named = lambda p: F.replace(F.replace(F.replace(p, F.lit(head), F.lit("")), F.lit(tail), F.lit(".")), F.lit("percentiles/"), F.lit(""))
    numbers = F.map_filter("n", lambda p, v: p.startswith(head) & p.contains(tail) & v["kind"].isin("integer", "number"))
    metrics = F.map_from_entries(F.transform(F.map_entries(numbers), lambda e: F.struct(named(e["key"]).alias("key"), e["value"]["value"].try_cast("double").alias("value"))))
    share = lambda a: F.when(made[3] > 0, a / made[3]).otherwise(0.0)
    return judged.select(
        key, "code", keep(number(f"{_B}/duration")).alias("duration_seconds"), *[keep(c).alias(t) for c, t in zip(made, TOTALS, strict=True)], keep(share(made[0])).alias("success_rate"), keep(share(made[1] + made[2])).alias("error_rate"),
        keep(whole("prompt_token_count").cast("long")).alias("prompt_tokens"), keep(whole("output_token_count").cast("long")).alias("output_tokens"), keep(metrics).alias("metrics"),
    )
