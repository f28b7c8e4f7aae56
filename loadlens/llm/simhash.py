"""SimHash near-dedup: a byte-position inverted index with count filtering, verified by Hamming distance.

Two fingerprints of 8 bytes that differ in at most 3 bits share at least 5 of their bytes. Single bytes make
postings of a 256th of all fingerprints, so the index is keyed by four positional bytes at a time: the 14 blocks
below are the complements of a Steiner system S(3, 4, 8), so whichever three positions differ, one block avoids
them. Inside a posting, shared positional bytes are tallied, pairs under the guaranteed minimum fall out, and the
rest are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import identified, staged, table
from loadlens.llm.components import components

BYTES = 8
#: Postings up to this size are compared in one task; larger ones are split by the nibbles of their free bytes.
POSTING = 1024


def steiner_blocks() -> list[tuple[int, ...]]:
    """The 14 blocks of four of S(3, 4, 8): the four-sets of 0..7 whose binary numbers sum to zero without carry."""
    return [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]


def _lowered(text: str) -> bytes:
    """UTF-8 of the text with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower()


def shingle_hashes(text: str | None, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included; the whole sequence if there are fewer words."""
    words = _lowered(text).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    view, h = memoryview(line), xxhash.xxh64_intdigest
    return np.array([h(view[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; no hashes give zero."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    if not n:
        return 0
    bits = hashes.astype(">u8").view(np.uint8).reshape(n, 8)
    for i in range(0, n, 65536):
        counts += np.unpackbits(bits[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_signed(fingerprint(shingle_hashes(t.as_py(), k))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("_rid"), batch.column("doc_id"), pa.array(got, pa.int64())], ["_rid", "doc_id", "fp"])

    return run


def _blocks_of(value, width: int):
    """SQL keys of the 14 blocks: block number above the four chosen fields of ``width`` bits."""
    fields = [F.shiftrightunsigned(value, width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(8)]
    keys = []
    for block in steiner_blocks():
        key = F.lit(0).cast("long")
        for i in block:
            key = F.shiftleft(key, width).bitwiseOR(fields[i])
        keys.append(key)
    return keys


def _groups(postings: DataFrame, keys: list[str]) -> DataFrame:
    """``postings`` of keys that two or more fingerprints have, with the key's count ``n``."""
    counts = postings.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return postings.join(counts, keys)


def _forest(fps: np.ndarray, most: int, least_bytes: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of all pairs that share ``least_bytes`` bytes and differ in at most ``most`` bits."""
    left, links = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            diff = left ^ at
            shared = (diff.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            near = (shared >= least_bytes) & (np.bitwise_count(diff) <= most)
            if near.any():
                found = left[near]
                links += [(int(at), int(x)) for x in found]
                queue += list(found)
                left = left[~near]
    return links


def _link(most: int):
    least = BYTES - most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            flat, ends = column.flatten().to_numpy().view(np.uint64), np.diff(column.offsets.to_numpy())
            starts = np.concatenate(([0], np.cumsum(ends)[:-1])).astype(int)
            links: list[tuple[int, int]] = []
            two = starts[ends == 2]
            a, b = flat[two], flat[two + 1]
            diff = np.ascontiguousarray(a ^ b)
            ok = ((diff.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= least) & (np.bitwise_count(diff) <= most)
            links += list(zip(a[ok].tolist(), b[ok].tolist(), strict=True))
            for s, n in zip(starts[ends > 2].tolist(), ends[ends > 2].tolist(), strict=True):
                links += _forest(np.ascontiguousarray(flat[s : s + n]), most, least)
            arr = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(arr[:, 0]), pa.array(arr[:, 1])], ["a", "b"])

    return run


def links(fps: DataFrame, most: int = 3, posting: int = POSTING) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) of at most ``most`` <= 3 differing bits, enough of them to connect
    what all of them connect.

    A posting of more than ``posting`` fingerprints is keyed again by four of the eight nibbles of its four free
    bytes, by the same blocks; that leaves 16 free bits, so a posting then has at most 65536 fingerprints.
    """
    if not 0 <= most <= 3:
        raise ValueError("the index guarantees shared bytes for 0 to 3 differing bits")
    blocks = steiner_blocks()
    keyed = fps.select("fp", F.posexplode(F.array(*_blocks_of(F.col("fp"), 8))).alias("block", "key"))
    found = staged(_groups(keyed, ["block", "key"]), "postings")
    small = found.where(F.col("n") <= posting).groupBy("block", "key").agg(F.collect_list("fp").alias("fps"))
    free = []  # the 32 bits outside each block
    for block in blocks:
        rest = F.lit(0).cast("long")
        for i in (i for i in range(8) if i not in block):
            rest = F.shiftleft(rest, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)))
        free.append(rest)
    large = found.where(F.col("n") > posting).select("fp", "block", "key", F.element_at(F.array(*free), F.col("block") + 1).alias("rest"))
    again = large.select("fp", "block", "key", F.posexplode(F.array(*_blocks_of(F.col("rest"), 4))).alias("block2", "key2"))
    split = _groups(again, ["block", "key", "block2", "key2"]).groupBy("block", "key", "block2", "key2").agg(F.collect_list("fp").alias("fps"))
    rows = small.select("fps").unionByName(split.select("fps"))
    return rows.mapInArrow(_link(most), "a long, b long")


def near_groups(docs: DataFrame, k: int = 3, most: int = 3) -> DataFrame:
    """Fingerprint of every text of ``docs`` and the component it belongs to.

    Copies are collapsed to their fingerprint before the index is built, so a group of any number of copies is one
    posting. Returns _rid, doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).
    Null and empty texts have fingerprint zero, linked like any other. Rows with a null doc_id are members, but never name
    a component unless no other row can. Repeated rows belong together, and ids that tie name one component. A very long text is fingerprinted whole in its row. Extra columns are ignored; an empty table gives an empty result.
    """
    prints = staged(identified(docs.select("doc_id", "text")).select("_rid", "doc_id", "text").mapInArrow(_fingerprints(k), "_rid struct<f:long,i:long>, doc_id long, fp long"), "prints")
    first = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("d")), "classes")
    roots = components(links(first.select("fp"), most))
    grouped = staged(first.join(roots, first["fp"] == roots["node"]).select("fp", "d", "root"), "roots")
    named = grouped.join(grouped.groupBy("root").agg(F.min("d").alias("component_id")), "root").select("fp", F.col("component_id").alias("c"))
    classes = first.join(named, "fp", "left").select("fp", F.when(F.col("c").isNull(), F.col("d")).otherwise(F.col("c")).alias("component_id"))
    return prints.join(classes, "fp").select("_rid", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
