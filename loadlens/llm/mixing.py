"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.llm.common import identified, staged, table, text_size

HASH_BITS = 60
DIGIT_BITS = 15


def row_hash(doc_id: str, seed: str = "") -> Column:
    """60 uniform bits from the document's id: equal on every run and at every size."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))), 1, HASH_BITS // 4), 16, 10).cast("long")


def ranked_sources(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """``sources`` with ``_w``: the weights repeat along the sources in code-point order, null last.

    The rank is counted per range partition and offset by the partitions before, so no task holds all sources.
    """
    order = [F.col("_source").asc_nulls_last()]
    parts = staged(sources.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "sources")
    before = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = before.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1 + F.col("_before")
    table = F.array(*[F.lit(float(w)) for w in weights])
    return parts.join(F.broadcast(before), "_p").withColumn("_w", F.element_at(table, (rank % len(weights) + 1).cast("int"))).drop("_p", "_before")  # one row a partition


def with_targets(sources: DataFrame, share: float, repeats: float) -> DataFrame:
    """``sources`` with ``target``: ``share`` of all sizes dealt by weight, no source above ``repeats`` times its size, the excess dealt again by weight until none is above.

    Each round is one distributed sum; the driver holds three numbers. A round saturates at least one more source.
    """
    cap = F.col("source_size") * F.lit(float(repeats))
    total, weight = sources.agg(F.sum("source_size").cast("double"), F.sum("_w")).first()
    budget, level = (total or 0.0) * share, 0.0
    level = budget / weight if weight else 0.0
    while True:
        full = cap <= F.col("_w") * F.lit(level)
        held, free = sources.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("_w")))).first()
        if not free:
            level = None
            break
        again = (budget - (held or 0.0)) / free
        if again <= level:
            break
        level = again
    return sources.withColumn("target", cap if level is None else F.least(cap, F.col("_w") * F.lit(level)))


def _thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source the hash below which rows get one more copy.

    Level by level the sizes are summed in 2^15 buckets of the boundary bucket before; after the last level a bucket is one hash value, whose rows go in if that is nearer to the budget.
    """
    digits = HASH_BITS // DIGIT_BITS
    edge = plan.select("_source", "_left", F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_done"))
    for level in range(digits):
        shift = HASH_BITS - DIGIT_BITS * (level + 1)
        at = edge.select(F.col("_source").alias("_s"), "_prefix", "_left", "_done")
        inside = rows.join(at, rows["_source"].eqNullSafe(at["_s"]) & (F.shiftright(rows["_h"], shift + DIGIT_BITS) == at["_prefix"]))
        sums = inside.groupBy("_source", F.shiftright("_h", shift).alias("_b")).agg(F.sum("_size").alias("_g"), F.first("_left").alias("_left"), F.first("_done").alias("_done"))
        upto = F.sum("_g").over(Window.partitionBy("_source").orderBy("_b"))  # at most 2^15 rows a source
        sums = sums.withColumn("_after", F.col("_done") + upto).withColumn("_from", F.col("_after") - F.col("_g"))
        edge = staged(sums.where((F.col("_from") <= F.col("_left")) & (F.col("_left") < F.col("_after"))).select("_source", "_left", F.col("_b").alias("_prefix"), F.col("_from").alias("_done"), "_g"), "edge")
    into = 2 * F.col("_done") + F.col("_g") <= 2 * F.col("_left")
    return edge.select(F.col("_source").alias("_s"), F.when(into, F.col("_prefix") + 1).otherwise(F.col("_prefix")).alias("_threshold"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, repeats: float = 2.0, seed: str = "") -> DataFrame:
    """Deal ``share`` of all words to the sources of ``docs`` by weight and choose the documents that fill each target.

    Every document gets ``floor(target / source_size)`` copies; the rest of the target goes to the documents
    whose hash lies below the source's threshold, so a larger target only ever adds documents. Documents are
    taken whole: a source's words differ from its target by at most half of the documents at one hash value.

    Returns _rid, doc_id, source, size, source_size, target, taken.
    Null or empty text: size 0, taken 0. A null source is a source of its own, last in order. A null doc_id has one
    hash value of its own; rows that share a doc_id share the hash and are taken together. A very long text is taken whole like any other, its words counted in its row. An empty table
    gives an empty result; extra columns are ignored.
    """
    rows = staged(identified(docs.select("doc_id", "source", "text")).select("_rid", "doc_id", F.col("source").alias("_source"), text_size("text").alias("_size"), row_hash("doc_id", seed).alias("_h")), "sized")
    sources = rows.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    plan = with_targets(ranked_sources(sources, weights), share, repeats)
    plan = plan.withColumn("_copies", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)))
    plan = staged(plan.withColumn("_left", F.col("target") - F.col("_copies") * F.col("source_size")), "plan")
    limits = _thresholds(rows, plan.where("source_size > 0"))
    plan = plan.join(limits, plan["_source"].eqNullSafe(limits["_s"]), "left").select(F.col("_source").alias("_s"), "source_size", "target", "_copies", "_threshold")
    out = rows.join(plan, rows["_source"].eqNullSafe(plan["_s"]))
    more = F.when(F.col("_h") < F.col("_threshold"), 1).otherwise(0)
    return out.select("_rid", "doc_id", F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * (F.col("_copies") + more)).cast("long").alias("taken"))


def op1_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY source),
c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         sum(2.0::DOUBLE * source_size) OVER o AS caps, sum(w) OVER o AS ws,
         sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget, sum(w) OVER () AS wall
  FROM s WINDOW o AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT max(CASE WHEN wall - ws + w > 0 THEN (budget - (caps - cap)) / (wall - ws + w) END) AS lvl FROM c),
t AS (SELECT source, source_size, least(cap, w * lvl) AS target FROM c, l),
g AS (
  SELECT source, h, sum(size) AS g FROM d GROUP BY source, h),
b AS (
  SELECT source, h, g, sum(g) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) - g AS done FROM g)
SELECT d.doc_id, d.size, t.source_size, t.target,
       (d.size * (CASE WHEN t.source_size = 0 THEN 0 ELSE floor(t.target / t.source_size)
         + CASE WHEN 2 * b.done + b.g <= 2 * (t.target - floor(t.target / t.source_size) * t.source_size) THEN 1 ELSE 0 END END))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
       JOIN b ON d.source IS NOT DISTINCT FROM b.source AND d.h = b.h
"""
