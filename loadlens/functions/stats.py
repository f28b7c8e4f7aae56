"""Statistics as column builders: finite values, percentiles, Student-t intervals, deltas, tolerant equality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Two-sided 95 % Student-t critical values for 1 to 30 degrees of freedom.
T_975 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228,
    2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086,
    2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)
#: 97.5th percentile of the normal distribution.
Z_975 = 1.959963984540054

#: Fractions of every latency summary.
SUMMARY = (0.50, 0.90, 0.95, 0.99)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(value: Column | str) -> Column:
    """The value as a double; null where it is null, NaN or infinite."""
    x = _col(value).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def percentile(value: Column | str, fraction: float) -> Column:
    """Aggregate for small groups: exact percentile of the finite values by linear interpolation; null of none.

    It buffers a group's distinct values in one task; ``percentiles`` is the form for groups of any size.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("a percentile fraction lies between 0 and 1")
    return F.percentile(finite(value), F.lit(fraction))


def t_critical(df: Column | str) -> Column:
    """Critical value for ``df`` degrees of freedom: the table to 30, a Cornish-Fisher expansion beyond; null under 1."""
    d, z = _col(df), Z_975
    n = d.cast("double")
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
    far = F.lit(z)
    for power, term in enumerate(terms, 1):
        far = far + F.lit(term) / F.pow(n, F.lit(power))
    table = F.array(*[F.lit(x) for x in T_975])
    return F.when(d.between(1, len(T_975)), F.element_at(table, F.greatest(F.least(d, F.lit(len(T_975))), F.lit(1)).cast("int"))).when(d > len(T_975), far)


def t_interval(value: Column | str) -> Column:
    """Aggregate: struct of n, mean, low and high of the finite values. Under two values the bounds are null."""
    x = finite(value)
    n, mean = F.count(x), F.avg(x)
    half = t_critical(n - 1) * F.stddev_samp(x) / F.sqrt(n.cast("double"))
    return F.struct(n.alias("n"), mean.alias("mean"), (mean - half).alias("low"), (mean + half).alias("high"))


#: Histogram buckets of ``percentiles`` for each doubling of a value.
BUCKETS = 512
#: Boundary buckets that are broadcast at most; more are joined by a shuffle.
MOST_EDGES = 20_000
#: Estimated bytes of input up to which a task may buffer the distinct values of a group.
ONE_TASK_BYTES = 512 << 20


def fits_one_task(rows: DataFrame, most: int = ONE_TASK_BYTES) -> bool:
    """Whether the optimizer's estimate of ``rows`` is at most ``most`` bytes. It chooses a plan, never a result."""
    return int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= most


def points(value: Column, fractions: tuple[float, ...] = SUMMARY) -> Column:
    """Aggregate for small groups: array of exact percentiles of the finite values; null of none."""
    return F.percentile(finite(value), F.array(*[F.lit(float(f)) for f in fractions]))


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on all ``keys``, where null equals null; the keys of ``left`` stay."""
    names = {k: f"_same{i}" for i, k in enumerate(keys)}
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], F.lit(True))
    return left.join(right.withColumnsRenamed(names), on, how).drop(*names.values())


def bucket(value: Column) -> Column:
    """Number of a histogram bucket that never falls as ``value`` rises: ``BUCKETS`` for each doubling, on both sides of zero."""
    size = F.floor(F.log2(F.abs(value)) * BUCKETS) + 1075 * BUCKETS  # the least double is 2^-1074
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("long")


def percentiles(rows: DataFrame, keys: list[str], values: dict[str, Column], fractions: tuple[float, ...] = SUMMARY, one_task: int = ONE_TASK_BYTES) -> DataFrame:
    """Exact percentiles of the finite values of each group: ``keys`` and per name of ``values`` an array by fraction, interpolated linearly.

    Beyond ``one_task`` bytes two passes that never hold a group: the first counts values by bucket and finds the
    buckets that hold the wanted ranks, the second counts the distinct values of those buckets alone. Smaller inputs
    take one aggregation; both give the same values. A name without a value in a group is null, a group without any
    has no row; a null key is a group of its own.
    """
    if not all(0 <= f <= 1 for f in fractions):
        raise ValueError("a percentile fraction lies between 0 and 1")
    if fits_one_task(rows, one_task):
        got = rows.groupBy(*keys).agg(*[points(v, fractions).alias(name) for name, v in values.items()])
        return got.where(reduce(lambda a, b: a | b, [F.col(name).isNotNull() for name in values]))
    pairs = F.array(*[F.struct(F.lit(name).alias("_name"), finite(v).alias("_v")) for name, v in values.items()])
    rows = rows.select(*keys, F.inline(pairs)).where("_v is not null").withColumn("_b", bucket(F.col("_v")))
    series, place = [*keys, "_name"], [*keys, "_name", "_b"]
    shares = F.array(*[F.lit(float(f)) for f in fractions])
    both = lambda x: (F.floor(x), F.ceil(x))
    ranks = F.array_distinct(F.flatten(F.transform(shares, lambda f: F.array(*both((F.col("_all") - 1) * f)))))
    wanted = reduce(lambda a, b: a | b, [(r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n")) for f in fractions for r in both((F.col("_all") - 1) * F.lit(float(f)))])
    held = F.filter(ranks, lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n")))
    hist = rows.groupBy(*place).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*series)
    hist = hist.withColumns({"_upto": F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(w)})
    edges = hist.where(wanted).select(*place, (F.col("_upto") - F.col("_n")).alias("_before"), "_all")
    few = edges.limit(MOST_EDGES + 1).collect()
    if len(few) <= MOST_EDGES:
        edges = F.broadcast(rows.sparkSession.createDataFrame(few, edges.schema))
    counts = join_same(rows, edges, place).groupBy(*place, "_v").agg(F.count("*").alias("_n"), F.first("_before").alias("_before"), F.first("_all").alias("_all"))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*place).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("_upto", upto).where(wanted).withColumn("_at", F.transform(held, lambda r: F.struct(r.alias("r"), F.col("_v").alias("v"))))
    of = {name: F.col("_name") == name for name in values}
    got = found.groupBy(*keys).agg(*[c for i, (name, mine) in enumerate(of.items()) for c in (F.max(F.when(mine, F.col("_all"))).alias(f"_all{i}"), F.flatten(F.collect_list(F.when(mine, F.col("_at")))).alias(f"_at{i}"))])  # two ranks a fraction

    def interpolated(n: Column, at: Column) -> Column:
        def point(f: Column) -> Column:
            pos = (n - 1) * f
            lo, hi = (F.try_element_at(at, r) for r in (F.floor(pos), F.ceil(pos)))
            return F.when(lo == hi, lo).otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi)

        return F.when(n.isNotNull(), F.transform(shares, point))

    return got.select(*keys, *[interpolated(F.col(f"_all{i}"), F.map_from_entries(f"_at{i}")).alias(name) for i, name in enumerate(values)])


def summary_struct(count: Column, mean: Column, at: Column) -> Column:
    """Struct of count, mean and the percentiles of ``SUMMARY``."""
    return F.struct(count.alias("count"), mean.alias("mean"), *[at[i].alias(f"p{int(f * 100)}") for i, f in enumerate(SUMMARY)])


def summaries_ms(rows: DataFrame, keys: list[str], seconds: dict[str, Column]) -> DataFrame:
    """Per group and name a struct of count, mean, p50, p90, p95 and p99 of seconds, in milliseconds. The scale is applied before interpolation."""
    ms = {name: finite(v * 1000.0) for name, v in seconds.items()}
    sums = rows.groupBy(*keys).agg(*[c for name, v in ms.items() for c in (F.count(v).alias(f"_n_{name}"), F.avg(v).alias(f"_m_{name}"))])
    both = join_same(sums, percentiles(rows, keys, ms), keys, "left")
    return both.select(*keys, *[summary_struct(F.col(f"_n_{n}"), F.col(f"_m_{n}"), F.col(n)).alias(n) for n in ms])


def relative_delta_percent(candidate: Column | str, baseline: Column | str) -> Column:
    """(candidate / baseline - 1) in percent; null where either is not finite or the baseline is 0."""
    return finite((F.try_divide(finite(candidate), finite(baseline)) - 1.0) * 100.0)


def intervals_overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Whether two intervals meet; one without finite bounds meets everything."""
    a, b, c, d = (finite(x) for x in (low_a, high_a, low_b, high_b))
    open_ended = a.isNull() | b.isNull() | c.isNull() | d.isNull()
    return open_ended | ((a <= d) & (c <= b))


def close(a: Column | str, b: Column | str, rel: float = 1e-6, least: float = 1e-9) -> Column:
    """Equality up to ``rel`` of the larger magnitude, or ``least``."""
    x, y = _col(a).cast("double"), _col(b).cast("double")
    return F.abs(x - y) <= F.greatest(F.lit(rel) * F.greatest(F.abs(x), F.abs(y)), F.lit(least))


def relative_spread(value: Column | str) -> Column:
    """Aggregate: (max - min) / max."""
    x = _col(value)
    return F.try_divide(F.max(x) - F.min(x), F.max(x))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Sorted array of the codes whose condition is true; a null condition is not."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in pairs]))))
