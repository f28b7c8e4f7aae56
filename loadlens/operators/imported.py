"""Blocks and conditions of aggregate reports that another load generator measured.

Such reports hold totals and distributions, no responses, so nothing of them counts towards a decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.functions import stats

# Codes of imported blocks.
FAILED, EMPTY, SHORT = "guidellm_reported_error_or_incomplete_request", "no_requests_measured", "configured_block_floor_not_reached"
NONE_COMPLETE, NO_GOODPUT = "no_operationally_complete_conditions", "guidellm_aggregate_contract_cannot_calculate_slo_goodput"


def blocks(imported: DataFrame, requests: int | None = None, seconds: float | None = None) -> DataFrame:
    """``imported`` (successful, errored, incomplete, total, duration_seconds) with attempted, invalid, valid and invalid_reasons.

    A block is valid if nothing failed, something was tried, and it reached ``requests`` or lasted ``seconds``.
    """
    failures = F.col("errored") + F.col("incomplete")
    floors = [c for c in (F.col("total") >= requests if requests is not None else None, F.col("duration_seconds") >= seconds if seconds is not None else None) if c is not None]
    reached = F.lit(False)
    for floor in floors:
        reached = reached | F.coalesce(floor, F.lit(False))
    why = F.array_compact(F.array(F.when(failures > 0, FAILED), F.when(F.col("total") == 0, EMPTY), F.when(~reached, SHORT)))
    return imported.withColumns({"attempted": F.col("total").cast("long"), "invalid": failures.cast("long"), "valid": (failures == 0) & (F.col("total") > 0) & reached, "invalid_reasons": why})


def conditions(measured: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Per condition: whether all ``expected`` blocks are valid, counts, wall time, the pooled rate and the block mean with its interval.

    ``measured``: rows of ``blocks`` with output_tokens. Metrics are null where a block is missing or invalid.
    """
    rate = F.try_divide("output_tokens", "duration_seconds")
    got = measured.withColumn("_rate", rate).groupBy(*keys).agg(
        ((F.count("*") == expected) & F.min("valid")).alias("valid"), F.count("*").alias("blocks"), F.sum("attempted").alias("attempted"), F.sum("invalid").alias("invalid"), F.sum("duration_seconds").alias("wall_seconds"),
        F.try_divide(F.sum("output_tokens"), F.sum("duration_seconds")).alias("_pooled"), stats.t_interval("_rate").alias("_ci"),
    )
    keep = lambda c: F.when(F.col("valid"), c)
    return got.select(*keys, "valid", "blocks", "attempted", "invalid", "wall_seconds", keep(F.col("_pooled")).alias("output_tokens_per_second"), keep(F.col("_ci")).alias("tokens_ci"))


def best_tested(tested: DataFrame, run: list[str], value: str, slo: Column | bool = False, smoke: bool = False) -> DataFrame:
    """Per run the valid condition of the highest block-mean rate (the first by ``value`` on a tie), or why none is named.

    ``slo`` says that the run has a latency limit: aggregates cannot tell goodput, so then none is named. Never more than a description.
    """
    limited = slo if isinstance(slo, Column) else F.lit(slo)
    w = Window.partitionBy(*run)
    ranked = tested.withColumns({"_k": F.row_number().over(w.orderBy(F.col("valid").desc(), F.col("tokens_ci.mean").desc_nulls_last(), value)), "_most": F.max(value).over(w)})
    named = F.col("valid") & ~limited
    keep = lambda c: F.when(named, c)
    return ranked.where("_k = 1").select(
        *run, named.alias("available"), keep(F.col(value)).alias("value"), keep(F.col("tokens_ci.mean")).alias("block_mean_output_tokens_per_second"), keep(F.col("output_tokens_per_second")).alias("pooled_output_tokens_per_second"),
        keep(F.col(value) == F.col("_most")).alias("boundary_reached"), F.when(~F.col("valid"), "invalid").otherwise("not_applicable_smoke" if smoke else "inconclusive").alias("state"),
        F.when(~F.col("valid"), NONE_COMPLETE).when(limited, NO_GOODPUT).alias("reason"),
    )
