"""Seeded, order-dependent statistics: bootstrap intervals, reservoir samples and prompt order, replayed with the same generator.

They need the values in a defined order, so every function takes an order column; one group is one task.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bounds of the diagnostics.
SAMPLE, RESAMPLES, SALT, RESERVOIR = 1024, 300, 0x5A17, 4096


def _quantile(ordered: list[float], fraction: float) -> float:
    at = (len(ordered) - 1) * fraction
    low = int(at)
    high = min(low + 1, len(ordered) - 1)
    w = at - low
    return ordered[low] if w == 0 else ordered[low] * (1.0 - w) + ordered[high] * w


def bootstrap_bounds(values: list[float], fraction: float, seed: int, resamples: int = RESAMPLES) -> tuple[float | None, float | None, int]:
    """Low and high of a seeded bootstrap of a percentile, and how many values it looked at."""
    values = [v for v in values if v is not None and math.isfinite(v)]
    if len(values) > SAMPLE:
        picked = random.Random(seed ^ SALT).sample(range(len(values)), SAMPLE)
        values = [values[i] for i in sorted(picked)]
    n = len(values)
    if n < 2:
        return None, None, n
    draw = random.Random(seed).randrange
    found = sorted(_quantile(sorted(values[draw(n)] for _ in range(n)), fraction) for _ in range(resamples))
    return _quantile(found, 0.025), _quantile(found, 0.975), n


def bootstrap_interval(rows: DataFrame, keys: list[str], order: str, value: str, fraction: float, seed: int) -> DataFrame:
    """Per group the seeded bootstrap interval of a percentile: n, analysis_sample_n, low, high."""
    kinds = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        values = [None if pd.isna(v) else float(v) for v in pdf[value]]
        low, high, n = bootstrap_bounds(values, fraction, seed)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), sum(v is not None and math.isfinite(v) for v in values), n, low, high]], columns=[*keys, "n", "analysis_sample_n", "low", "high"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, analysis_sample_n long, low double, high double"
    return rows.select(*keys, order, value).groupBy(*keys).applyInPandas(run, schema)


def reservoir(values: list[float], seed: int, cap: int = RESERVOIR) -> list[float]:
    """The first ``cap`` values; each later one replaces a random place of all seen so far, if that is in the reservoir."""
    kept, draw = list(values[:cap]), random.Random(seed).randrange
    for seen, v in enumerate(values[cap:], cap + 1):
        at = draw(seen)
        if at < cap:
            kept[at] = v
    return kept


def reservoir_sample(rows: DataFrame, keys: list[str], order: str, value: str, seed: int, cap: int = RESERVOIR) -> DataFrame:
    """Per group the seeded reservoir of ``value``, one row per place."""
    kinds = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = reservoir(pdf.sort_values(order, kind="stable")[value].tolist(), seed, cap)
        out = pd.DataFrame({value: kept, "place": range(len(kept))})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "place", value]]

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", place long, {value} double"
    return rows.select(*keys, order, F.col(value).cast("double")).groupBy(*keys).applyInPandas(run, schema)


def prompt_order(n: int, seed: int) -> list[int]:
    """Seeded shuffle of prompt positions."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def assigned_prompts(requests: DataFrame, prompts: DataFrame, launch: str, n: int, seed: int) -> DataFrame:
    """Each request with the prompt of its launch number: prompts are taken cyclically in their shuffled order. ``n`` prompts, numbered by prompt_pos."""
    spark = requests.sparkSession
    order = spark.createDataFrame(list(enumerate(prompt_order(n, seed))), "_slot int, prompt_pos int")
    slot = F.pmod(F.col(launch), F.lit(n)).cast("int")
    return requests.withColumn("_slot", slot).join(F.broadcast(order), "_slot").drop("_slot").join(prompts, "prompt_pos", "left")
