"""Filter interaction audit: what each filter removes in every order of the filters, and its Shapley share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import WORD, staged, table

#: More filters than this have too many orders to list (8! = 40320).
MOST_FILTERS = 8


def swaps(n: int) -> Iterator[int]:
    """Places i of the single swaps (i with i + 1) that visit every order of ``n`` things once, from 0, 1, 2, ... on.

    Each thing has a direction; the largest one whose neighbour in its direction is smaller moves there, and all larger ones turn.
    """
    order, step = list(range(n)), [-1] * n
    while True:
        movable = [i for i in range(n) if 0 <= i + step[order[i]] < n and order[i + step[order[i]]] < order[i]]
        if not movable:
            return
        i = max(movable, key=lambda x: order[x])
        thing = order[i]
        j = i + step[thing]
        order[i], order[j] = order[j], order[i]
        for other in range(thing + 1, n):
            step[other] = -step[other]
        yield min(i, j)


def walk(cells: np.ndarray, names: str) -> Iterator[tuple[str, np.ndarray]]:
    """Every order of the filters with its steps, then ("", Shapley sums).

    ``cells``: parts x 2^n masks x 3 counts (rows, good, toxic), bit i of a mask being the failure of filter i. A step is
    parts x (kept, removed, redundant, good_lost, toxic_lost). A swap of neighbours changes only those two steps; the
    others are carried along.
    """
    n = len(names)
    masks = np.arange(1 << n)
    fails = [(masks >> i & 1).astype(bool) for i in range(n)]

    def step(before: int, i: int) -> np.ndarray:
        """Filter ``i`` after the filters of the bit set ``before``."""
        free = (masks & before) == 0
        here, late, left = cells[:, free & fails[i]].sum(1), cells[:, ~free & fails[i], 0].sum(1), cells[:, free & ~fails[i], 0].sum(1)
        return np.stack([left, here[:, 0], late, here[:, 1], here[:, 2]], 1)

    order, before, steps = list(range(n)), [(1 << i) - 1 for i in range(n)], []
    steps = [step(before[i], i) for i in range(n)]
    shapley = np.zeros((len(cells), n), np.int64)

    def visit() -> tuple[str, np.ndarray]:
        for at, i in enumerate(order):
            shapley[:, i] += steps[at][:, 1]
        return "".join(names[i] for i in order), np.stack(steps, 1)

    yield visit()
    for i in swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        before[i + 1] = before[i] | 1 << order[i]
        steps[i], steps[i + 1] = step(before[i], order[i]), step(before[i + 1], order[i + 1])
        yield visit()
    yield "", shapley


def audit(rows: DataFrame, filters: dict[str, Column], part: Column, good: Column, toxic: Column) -> DataFrame:
    """One row for each part, order of the filters and step: what the step's filter removes and what it costs.

    ``filters``: one letter each and the condition under which a row fails it. Rows are counted by part and mask of failed
    filters (combined before the shuffle: at most 2^n cells a part); the walk over the orders sees only these cells, in
    tasks of whole parts. Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley (removed by
    the step's filter, summed over all orders). A condition that is null counts as passed, a null part as the empty string, null labels as no.
    Repeated rows count each, as ties do; an empty table gives an empty result; other columns of ``rows`` are ignored.
    """
    names = "".join(filters)
    if not 1 <= len(names) <= MOST_FILTERS or any(len(x) != 1 for x in filters):
        raise ValueError(f"1 to {MOST_FILTERS} filters with names of one letter")
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    marked = rows.select(F.coalesce(part, F.lit("")).alias("part"), mask.alias("mask"), F.coalesce(good, F.lit(False)).alias("good"), F.coalesce(toxic, F.lit(False)).alias("toxic"))
    cells = marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("g"), F.count_if("toxic").alias("t"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "g", "t")).alias("cells"))  # at most 2^n cells
    orders = math.factorial(len(names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 256):  # 256 parts at once bound the memory of a task
                some = batch.iloc[low : low + 256]
                counts = np.zeros((len(some), 1 << len(names), 3), np.int64)
                for k, found in enumerate(some["cells"]):
                    for c in found:
                        counts[k, c["mask"]] = c["n"], c["g"], c["t"]
                said = list(walk(counts, names))
                shapley, blocks = said[-1][1], []
                for order, steps in said[:-1]:
                    at = [names.index(x) for x in order]
                    alone = counts[:, [1 << i for i in at], 0]
                    blocks.append(np.concatenate([steps, alone[:, :, None], shapley[:, at][:, :, None]], 2))
                whole = np.stack(blocks, 1).reshape(-1, 7)  # part, order, step
                out = pd.DataFrame(whole, columns=["kept", "removed", "redundant", "good_lost", "toxic_lost", "unique_fails", "shapley"])
                out["part"] = np.repeat(some["part"].to_numpy(), orders * len(names))
                out["filter_order"] = np.tile(np.repeat([o for o, _ in said[:-1]], len(names)), len(some))
                out["step"] = np.tile(np.arange(1, len(names) + 1), len(some) * orders)
                yield out[["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]]

    counted = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return parts.mapInPandas(run, f"part string, filter_order string, step int, {counted}")


def document_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, good, toxic and the failure of each of the filters a to e of every document.

    a: under 200 words; b: fewer than half of the words are distinct; c: over 3 % capitals; d: a character of ``#$%&*|``;
    e: the text of a smaller doc_id. Null text counts as empty. A null doc_id is larger than any other, and no label holds for it.
    Repeated rows of one doc_id are no copies of each other. A very long text is measured in one expression of its
    row. Labels with several rows of a doc_id hold if one of them does. The copies of a text meet their smallest doc_id by text and id at
    once, so a text that very many documents share is not one key of the join.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "lang", text.alias("_t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"))
    n = F.size("_w")
    rows = base.select(
        "doc_id", "lang", (n < 200).alias("a"), (100 * F.size(F.array_distinct("_w")) < 50 * n).alias("b"), (100 * F.regexp_count("_t", F.lit("[A-Z]")) > 3 * F.length("_t")).alias("c"), F.regexp_like("_t", F.lit("[#$%&*|]")).alias("d"),
        F.unhex(F.sha2("_t", 256)).alias("_digest"), F.col("doc_id").isNull().alias("_last"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("_id"),
    )
    rows = staged(rows, "failures")
    first = rows.groupBy("_digest").agg(F.min(F.struct("_last", "_id")).alias("m")).select("_digest", F.col("m._last").alias("_last"), F.col("m._id").alias("_id"), F.lit(False).alias("_copy"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return rows.join(first, ["_digest", "_last", "_id"], "left").join(marks, "doc_id", "left").select("doc_id", "lang", "good", "toxic", "a", "b", "c", "d", F.coalesce("_copy", F.lit(True)).alias("e"))


def op13_filter_audit(spark, sf_dir):
    rows = document_failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(rows, {x.upper(): F.col(x) for x in "abcde"}, F.col("lang"), F.col("good"), F.col("toxic"))


OP13_SQL = r"""
WITH l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT part, d.doc_id, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
         (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x))::int + 8 * regexp_matches(x, '[#$%&*|]')::int
         + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY x), min(d.doc_id) OVER (PARTITION BY x) IS NOT NULL)::int AS mask
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS b FROM f GROUP BY ALL),
s AS (SELECT i, chr(65 + i::int) AS x FROM range(5) t(i)),
o AS (SELECT a.x || b.x || e.x || g.x || h.x AS filter_order FROM s a, s b, s e, s g, s h WHERE len(list_distinct([a.i, b.i, e.i, g.i, h.i])) = 5),
p AS (SELECT filter_order, k::int AS step, filter_order[k] AS x, 1 << (ascii(filter_order[k]) - 65) AS bit, coalesce(list_sum([1 << (ascii(filter_order[j]) - 65) FOR j IN range(1, k)]), 0)::int AS before FROM o, range(1, 6) t(k)),
r AS (
  SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::bigint AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::bigint AS removed,
         coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::bigint AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::bigint AS unique_fails,
         coalesce(sum(g) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::bigint AS good_lost, coalesce(sum(b) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::bigint AS toxic_lost
  FROM c, p GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::bigint AS shapley FROM r
"""
