"""Suffix-array dedup of byte strings: every byte covered by a 200-byte string that also starts elsewhere is removed.

Every 200-byte string has one content-defined anchor, and equal strings have it at the same place, so only strings of equal
anchors can be equal. The strings that an anchor owns start at neighbouring bytes: together they are its surroundings.
Surroundings that are equal as a whole are counted, and resolved, by their hash; those that share
an anchor and a longer run but differ are brought together in shards, whose suffixes are sorted by induced sorting
(``suffix_sort``). Text without a repeated anchor is read but never sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.llm.anchors import GRAM, LENGTH, anchors, hashes, mixed, prefix_sums
from loadlens.llm.common import identified, shared_dir, staged, table
from loadlens.llm.suffix_sort import MEMORY, Store, repeated, sort_suffixes

#: Strings of an anchor that start within STEP bytes share a run of KEYED bytes, which keys them.
STEP = 40
KEYED = LENGTH - STEP
#: Different surroundings of an anchor from which they are dealt out by their longer runs.
HOT = 64
SHARD_BYTES = 2 << 20
#: Surroundings that share a run, up to which they are sorted as one shard; the strings of more are dealt out by their whole LENGTH bytes.
LARGE = SHARD_BYTES // (2 * LENGTH)
RID = "struct<f:long,i:long>"
_rid = pa.struct([("f", pa.int64()), ("i", pa.int64())])


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each anchor's position, the reach of the strings it owns to both sides, its hash, and the hash of those strings together."""
    for batch in batches:
        rids, rows = batch.column("_rid"), batch.column("text").to_pylist()
        index, cols = [], []
        for k, text in enumerate(rows):
            data = np.frombuffer(_bytes(text), np.uint8)
            n = len(data)
            if n < LENGTH:
                continue
            sums, inverse = prefix_sums(data)
            starts = np.arange(n - GRAM + 1)
            grams = hashes(sums, inverse, starts, starts + GRAM)
            at, first, last = anchors(grams)
            left, right = at - first, last + LENGTH - at
            around = hashes(sums, inverse, at - left, at + right) ^ mixed(left.astype(np.uint64))
            index.append(np.full(len(at), k))
            cols.append((at, left, right, grams[at].view(np.int64), around.view(np.int64)))
        if index:
            flat = [np.concatenate(c) for c in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([rids.take(pa.array(np.concatenate(index))), pa.array(flat[0]), *(pa.array(c.astype(np.int32)) for c in flat[1:3]), *(pa.array(c) for c in flat[3:])], ["_rid", "pos", "left", "right", "a", "c"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The surroundings of chosen anchors as bytes, where they lie (a number of the row plus the byte), and the hashes of their longer runs."""
    for batch in batches:
        out = []
        for row, text, points in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), batch.column("points").to_pylist(), strict=True):
            raw = _bytes(text)
            for p in points:
                pos, left, right = p["pos"], p["left"], p["right"]
                data = raw[pos - left : pos + right]
                keys = []
                near = left + LENGTH - len(data)  # bytes from the last owned start to the anchor
                for back in range(near // STEP * STEP, left + 1, STEP):  # of strings that start back to back + STEP - 1 bytes before the anchor
                    a = left - back
                    if a >= 0:
                        keys.append(int.from_bytes(hashlib.blake2b(data[a : a + KEYED], digest_size=8, salt=bytes([back])).digest(), "big", signed=True))
                out.append({"a": p["a"], "c": p["c"], "hot": p["hot"], "place": row + pos - left, "data": data, "keys": keys})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("a", pa.int64()), ("c", pa.int64()), ("hot", pa.bool_()), ("place", pa.int64()), ("data", pa.binary()), ("keys", pa.list_(pa.int64()))]))


def _sorter(memory: int, folder: str | None):
    """Starts of repeated strings in each of a shard's surroundings, as runs (from, to) relative to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, names, lie = Store(memory, folder), [], []

        def strings() -> Iterator[bytes]:
            for batch in batches:
                names.append(np.stack([batch.column(x).to_numpy() for x in ("a", "c")], axis=1))
                lie.append(batch.column("place").to_numpy())
                yield from (x.as_py() for x in batch.column("data"))

        text, starts = store.text(strings())
        if not len(starts):
            return
        name, places = np.concatenate(names), np.concatenate(lie)
        order, prefix = sort_suffixes(text, LENGTH, store)
        marks = repeated(text, order, prefix, starts, places, LENGTH, store)
        open_at = None  # a run that the block before left open; runs never cross a separator, where no string of LENGTH bytes starts
        for i, j in store.blocks(len(text)):
            edges = np.flatnonzero(np.diff(np.concatenate(([open_at is not None], marks[i:j])).astype(np.int8))) + i
            edges = np.concatenate(([open_at] if open_at is not None else [], edges)).astype(np.int64)
            open_at = int(edges[-1]) if len(edges) % 2 else None
            begin, end = edges[: len(edges) // 2 * 2 : 2], edges[1::2]
            owner = np.searchsorted(starts, begin, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(pa.array(name[owner, k]) for k in (0, 1)), pa.array((begin - starts[owner]).astype(np.int32)), pa.array((end - starts[owner]).astype(np.int32))], ["a", "c", "s", "e"])

    return run


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each owned string of the surroundings: its start, where it lies, and its hash."""
    for batch in batches:
        for a, c, place, text in zip(*(batch.column(x).to_pylist() for x in ("a", "c", "place", "data")), strict=True):
            sums, inverse = prefix_sums(np.frombuffer(text, np.uint8))
            starts = np.arange(len(text) - LENGTH + 1)
            found = hashes(sums, inverse, starts, starts + LENGTH).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), a)), pa.array(np.full(len(starts), c)), pa.array(starts.astype(np.int32)), pa.array(starts + place), pa.array(found)], ["a", "c", "s", "place", "h"])


def _counted(strings: DataFrame) -> DataFrame:
    """Starts of repeated strings in surroundings (a, c, place, data), as ``_sorter`` gives them, by native counts: no task holds a group."""
    each = strings.mapInArrow(_strings, "a long, c long, s int, place long, h long")
    again = each.groupBy("a", "h").agg(F.min("place").alias("p"), F.max("place").alias("q")).where("p < q").select("a", "h")
    return each.join(again, ["a", "h"]).select("a", "c", "s", (F.col("s") + 1).alias("e"))


def shards(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, c, shard) of surroundings that share a run with others, and (a, c) of those that share one with more than LARGE - 1 others."""
    runs = cut.select("a", "c", "hot", F.explode("keys").alias("k"))
    shares = runs.groupBy("a", "k").agg(F.count("*").alias("m")).where("m > 1")
    shard = F.when(F.col("hot"), F.xxhash64("a", "k")).otherwise(F.xxhash64("a"))
    held = staged(runs.join(shares, ["a", "k"]).select("a", "c", (F.col("hot") & (F.col("m") > LARGE)).alias("large"), shard.alias("shard")).distinct(), "held")
    return held.where("not large").select("a", "c", "shard"), held.where("large").select("a", "c").distinct()


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes, removed bytes and spans, and the digest of what is kept."""
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw = _bytes(text)
            kept, at, removed, runs, sha = 0, 0, 0, 0, hashlib.sha256()
            for s in sorted((x["s"], x["e"]) for x in spans or ()):
                if s[1] <= at and runs:
                    continue
                if s[0] > at or not runs:
                    sha.update(raw[at : s[0]])
                    kept += s[0] - at
                    runs += 1
                    removed += s[1] - s[0]
                else:
                    removed += s[1] - at
                at = s[1]
            sha.update(raw[at:])
            rows.append((len(raw), removed, runs, sha.hexdigest()))
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _scratch(spark: SparkSession) -> str | None:
    """The shared folder as a path of the file system, where scratch files of large shards go; None (the workers' own) where it has no such path."""
    folder = shared_dir(spark)
    return folder.removeprefix("file://") if folder.startswith(("/", "file:///")) else None


def repeated_spans(docs: DataFrame, memory: int = MEMORY) -> DataFrame:
    """(_rid, s, e) byte spans of ``docs`` (with _rid and text) that repeated strings cover; spans may overlap.

    Shards of more than ``memory`` bytes are sorted in scratch files.
    """
    spark = docs.sparkSession
    seen = staged(docs.select("_rid", "text").mapInArrow(_occurrences, f"_rid {RID}, pos long, left int, right int, a long, c long"), "anchors")
    kinds = seen.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("_rid", "pos", "left", "right")).alias("one"))
    kinds = staged(kinds, "kinds")
    shared = kinds.groupBy("a").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    known = staged(kinds.join(shared, "a").select("a", "c", "n", "kinds", "one"), "shared")
    again = staged(seen.join(known.select("a", "c", "n", "kinds"), ["a", "c"]), "again")
    whole = again.where("n > 1").select("_rid", (F.col("pos") - F.col("left")).alias("s"), (F.col("pos") + F.col("right")).alias("e"))
    # Different surroundings of one anchor: fetch one of each kind, keep those that share a longer run with another, sort the suffixes.
    points = known.where("kinds > 1").select(F.col("one._rid").alias("_rid"), F.struct("one.pos", "one.left", "one.right", "a", "c", (F.col("kinds") > HOT).alias("hot")).alias("p"))
    points = points.groupBy("_rid").agg(F.collect_list("p").alias("points"))  # at most one document's anchors
    cut = staged(docs.select("_rid", "text").join(points, "_rid").select(F.shiftright(F.xxhash64("_rid"), 1).alias("row"), "text", "points").mapInArrow(_cut_out, "a long, c long, hot boolean, place long, data binary, keys array<long>"), "cut")
    held, large = shards(cut)
    strings = held.join(cut.select("a", "c", "place", "data"), ["a", "c"])
    counted = _counted(large.join(cut.select("a", "c", "place", "data"), ["a", "c"]))
    size = cut.agg(F.sum(F.octet_length("data") + 1)).first()[0] or 0
    parts = max(1, -(-size // SHARD_BYTES), spark.sparkContext.defaultParallelism)
    found = staged(strings.repartition(int(parts), "shard").select("a", "c", "place", "data").mapInArrow(_sorter(memory, _scratch(spark)), "a long, c long, s int, e int").unionByName(counted).distinct(), "found")
    some = again.select("_rid", "pos", "left", "a", "c").join(found, ["a", "c"]).select("_rid", (F.col("pos") - F.col("left") + F.col("s")).alias("s"), (F.col("pos") - F.col("left") + F.col("e") - 1 + LENGTH).alias("e"))
    return whole.unionByName(some)


def remove_repeats(docs: DataFrame, memory: int = MEMORY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``.

    Matches never cross rows; repeated rows repeat each other. Null and empty texts have no byte. Texts under 200 bytes
    hold no string to repeat. A very long text is hashed whole in one task, about eighty bytes of memory a byte; where bytes tie, all are
    removed. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = identified(docs.select("doc_id", "text")).select("_rid", "doc_id", "text")
    spans = repeated_spans(rows, memory).groupBy("_rid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))  # at most one document's anchors
    return rows.join(spans, "_rid", "left").select("doc_id", "text", "spans").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op6_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
