"""Exact dedup with a heavy-hitter split: frequent digests are resolved map-side, the rest by an ordinary shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import SPACE, chosen, identified, staged, table

#: Misra-Gries keeps at most 1 / SUPPORT counters, so at most so many digests are ever broadcast (100 bytes each).
SUPPORT = 1 / 2000


def digest(text: Column | str) -> Column:
    """SHA-256 (lower-case hex) of the text without white space; null counts as empty."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.sha2(F.regexp_replace(whole, SPACE + "+", ""), 256)


def _keepers(rows: DataFrame) -> DataFrame:
    """One row per digest: the row that stays (most code points, then smallest doc_id, null last, then first row) and the group's size."""
    best = F.min(F.struct((-F.col("_len")).alias("l"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_rid").alias("r")))
    return rows.groupBy("_digest").agg(best.alias("_best"), F.count("*").alias("group_size")).select("_digest", F.col("_best.d").alias("keep_id"), F.col("_best.r").alias("_keep_rid"), "group_size")


def exact_groups(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Group equal texts of ``docs`` (equal after deleting white space) and choose the row of each group that stays.

    1. Misra-Gries (``freqItems``) over the digests gives at most ``1 / support`` candidates, among them every digest of more than ``support`` of the rows.
    2. Their exact counts and keepers come from one map-side combined aggregation; candidates with one row fall out.
    3. Verified winners are broadcast (at most ``1 / support`` rows) and resolve their rows without a shuffle.
    4. All other digests are grouped by an ordinary shuffle; none of them holds more than ``support`` of the rows.

    Returns _rid, doc_id, keep_id, group_size, kept, text_sha256 for every row, dropped ones too.
    Null text counts as empty, and all empty texts are one group. Repeated rows (same doc_id and text) are one
    group of which one row stays. A null doc_id is largest. Very long texts are digested whole, in one expression of their
    row. Extra columns are ignored; an empty table gives an empty result.
    """
    return _resolved(identified(docs.select("doc_id", "text")), support)


def _resolved(docs: DataFrame, support: float) -> DataFrame:
    """``exact_groups`` of rows that have their ``_rid``."""
    rows = staged(docs.select("_rid", "doc_id", F.unhex(digest("text")).alias("_digest"), F.length(F.coalesce("text", F.lit(""))).alias("_len")), "digests")
    likely = F.broadcast(rows.stat.freqItems(["_digest"], support).select(F.explode("_digest_freqItems").alias("_digest")))
    heavy = staged(_keepers(rows.join(likely, "_digest", "left_semi")).where("group_size > 1"), "heavy")
    light = rows.join(F.broadcast(heavy.select("_digest")), "_digest", "left_anti")
    resolved = rows.join(F.broadcast(heavy), "_digest").unionByName(light.join(_keepers(light), "_digest"))
    return resolved.select("_rid", "doc_id", "keep_id", "group_size", (F.col("_rid") == F.col("_keep_rid")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))


def dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Null and empty texts are one group, of which one row stays; ties, repeated rows, long texts and empty tables are as in ``exact_groups``.
    """
    return chosen(docs, lambda rows: _resolved(rows, support).where("kept"), ["doc_id", "text"])


def op7_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS k, count(*) OVER (PARTITION BY h) AS c,
         first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS keep_id FROM d)
SELECT doc_id, keep_id, c AS group_size, k = 1 AS kept, h AS text_sha256 FROM r
"""
