"""Near-duplicate groups at a Jaccard similarity, by the byte-position inverted index of ``simhash``.

Sign bits cannot serve here: texts that share 80 % of their five-word shingles differ in 9 of 64 sign bits on average, and in up
to 15 on the test tables, so no byte of two fingerprints need be equal. The fingerprint is therefore one
byte of each of 64 min-wise hashes: two texts of similarity s agree in a position with probability s + (1 - s) / 256. The
index is keyed by four positional bytes. In small postings, shared positional bytes are tallied, pairs below the minimum fall
out, and the exact similarity of the rest is computed from all their shingles. Larger postings are not expanded into pairs: their
members are compared by their shingles in blocks, and each block gives the links of a spanning forest.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import chosen, identified, staged
from loadlens.llm.components import components
from loadlens.llm.simhash import shingle_hashes

WORDS, SIMILARITY = 5, 0.8
POSITIONS, KEYED = 64, 4
#: Positions in which two texts of similarity 0.8 agree, less 4.3 standard deviations.
LEAST = 38
#: Postings up to this size are expanded into pairs (at most 1.5 a member). The members of larger ones are compared by their shingles, in blocks.
POSTING = 4
#: Members and shingles that a block should have, and leaders that every block of a posting is given first.
BLOCK, BLOCK_SHINGLES, LEADERS = 2048, 2_000_000, 2
#: A shingle is counted by a matrix product where more than this share of the pairs of two blocks hold it, and pair by pair elsewhere.
DENSE = 1 / 64
_COLUMNS, _PAIRS = 2048, 4_000_000
RID = "struct<f:long,i:long>"
_rng = np.random.default_rng(20)
_MUL = _rng.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(text, k))


def minwise(shingles: np.ndarray) -> bytes:
    """One byte of the least hash in each position; zeros for an empty text."""
    if not len(shingles):
        return bytes(POSITIONS)
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        h = shingles[i : i + 4096, None] * _MUL + _ADD
        h ^= h >> np.uint64(33)
        np.minimum(least, (h * np.uint64(0xFF51AFD7ED558CCD)).min(axis=0), out=least)
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, signs, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, k)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                signs.append(minwise(s))
                sizes.append(len(s))
            yield pa.RecordBatch.from_arrays([batch.column("_rid"), batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(signs, pa.binary()), pa.array(sizes, pa.int64())], ["_rid", "doc_id", "digest", "sign", "size"])

    return run


def _pairs_within(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for members in batch.column("members").to_pylist():
                sets = np.array([m["set"] for m in members])
                signs = np.frombuffer(b"".join(m["sign"] for m in members), np.uint8).reshape(-1, POSITIONS)
                shared = (signs[:, None] == signs[None]).sum(axis=2)
                i, j = np.nonzero(np.triu(shared >= least, 1))
                out += zip(sets[i].tolist(), sets[j].tolist(), strict=True)
            arr = np.unique(np.sort(np.array(out, np.int64).reshape(-1, 2), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(arr[:, 0]), pa.array(arr[:, 1])], ["a", "b"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of shared shingles of each member of ``left`` with each of ``right``."""
    nl, nr = len(left), len(right)
    out = np.zeros((nl, nr), np.float32)  # exact for up to 2^24 shingles
    terms = np.unique(np.concatenate([*left, *right, np.empty(0, np.int64)]), return_inverse=True)[1]
    cut = sum(map(len, left))
    sides = []
    for members, ids in ((left, terms[:cut]), (right, terms[cut:])):
        order = np.argsort(ids, kind="stable")
        sides.append((ids[order], np.repeat(np.arange(len(members)), [len(m) for m in members])[order], np.bincount(ids, minlength=terms.max(initial=-1) + 1)))
    (lt, lo, lc), (rt, ro, rc) = sides
    both = lc.astype(np.float64) * rc
    dense = np.flatnonzero(both > DENSE * nl * nr)
    for a in range(0, len(dense), _COLUMNS):
        part = dense[a : a + _COLUMNS]
        column = np.full(len(lc), -1)
        column[part] = np.arange(len(part))
        marks = []
        for t, o, n in ((lt, lo, nl), (rt, ro, nr)):
            at = column[t]
            m = np.zeros((n, len(part)), np.float32)
            m[o[at >= 0], at[at >= 0]] = 1
            marks.append(m)
        out += marks[0] @ marks[1].T
    rare = np.flatnonzero((both > 0) & (both <= DENSE * nl * nr))
    lstart, rstart, flat = np.cumsum(lc) - lc, np.cumsum(rc) - rc, out.reshape(-1)
    cuts = np.searchsorted(np.cumsum(both[rare]), np.arange(_PAIRS, both[rare].sum() + _PAIRS, _PAIRS))
    for part in np.split(rare, cuts[:-1]) if len(rare) else ():
        if not len(part):
            continue
        # Each entry of a term on the left meets the term's entries on the right.
        le = np.repeat(lstart[part] - (np.cumsum(lc[part]) - lc[part]), lc[part]) + np.arange(lc[part].sum())
        many = rc[lt[le]]
        re = np.repeat(rstart[lt[le]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        np.add.at(flat, np.repeat(lo[le], many) * nr + ro[re], np.float32(1))
    return out


def spanning(left: list[np.ndarray], right: list[np.ndarray] | None, roots: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (numbers of members, those of ``right`` after those of ``left``) of at least ``similarity`` that connect all that such links connect.

    Without ``right`` the members of ``left`` are compared with one another, else with those of ``right`` only.
    Members of one root count as linked.
    """
    nl, n = len(left), len(roots)
    other = left if right is None else right
    common = overlaps(left, other)
    sizes = [np.array([len(s) for s in side], np.float64) for side in (left, other)]
    alike = common >= similarity * (sizes[0][:, None] + sizes[1][None] - common) - 1e-6
    _, group, counts = np.unique(roots, return_inverse=True, return_counts=True)
    groups = np.split(np.argsort(group, kind="stable"), np.cumsum(counts)[:-1])
    waiting, links = np.ones(n, bool), []
    for g in np.argsort(-counts, kind="stable"):
        if not waiting[groups[g][0]]:
            continue
        queue = deque(groups[g].tolist())
        waiting[groups[g]] = False
        while queue:
            i = queue.popleft()
            if right is None:
                near = np.flatnonzero(alike[i] & waiting)
            elif i < nl:
                near = np.flatnonzero(alike[i] & waiting[nl:]) + nl
            else:
                near = np.flatnonzero(alike[:, i - nl] & waiting[:nl])
            for j in near.tolist():
                if waiting[j]:
                    links.append((i, j))
                    queue.extend(groups[group[j]].tolist())
                    waiting[groups[group[j]]] = False
    return links


def _forest(similarity: float):
    def run(piece: pa.Table) -> pa.Table:
        mine, sets, roots = piece.column("mine").to_numpy(), piece.column("set").to_numpy(), piece.column("root").to_numpy()
        shingles = [x.values.to_numpy() for x in piece.column("s").combine_chunks()]
        order = np.argsort(~mine, kind="stable")
        cut = int(mine.sum())
        found = spanning([shingles[k] for k in order[:cut]], [shingles[k] for k in order[cut:]] if cut < len(sets) else None, roots[order], similarity)
        arr = np.sort(sets[order][np.array(found, np.int64).reshape(-1, 2)], axis=1)
        return pa.table({"a": arr[:, 0], "b": arr[:, 1]})

    return run


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, n, shingles, set, sign) of the members of each posting of two or more, with the members and shingles of the posting.

    Of postings with the same members one stays: near copies share most of their keys.
    """
    part = lambda i: F.substring("sign", i * KEYED + 1, KEYED)
    keys = F.array(*[F.xxhash64(F.lit(i), part(i)) for i in range(POSITIONS // KEYED)])
    postings = classes.select("set", "sign", "size", F.explode(keys).alias("key"))
    content = [F.bit_xor(F.xxhash64("set", F.lit(seed))).alias(f"x{seed}") for seed in range(2)]
    sizes = postings.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), *content).where("n > 1")
    once = sizes.groupBy("n", "shingles", "x0", "x1").agg(F.min("key").alias("key")).select("key", "n", "shingles")
    return staged(postings.join(once, "key").select("key", "n", "shingles", "set", "sign"), "buckets")


def candidates(small: DataFrame, least: int = LEAST) -> DataFrame:
    """Pairs (a, b) of members (key, set, sign) of small postings that share at least ``least`` positional bytes."""
    return small.groupBy("key").agg(F.collect_list(F.struct("set", "sign")).alias("members")).select("members").mapInArrow(_pairs_within(least), "a long, b long").distinct()


def linked(large: DataFrame, sets: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of at least ``similarity`` that link all that such pairs inside a posting of ``large`` (key, n, shingles, set) link.

    Postings are dealt into blocks. Each block is compared in itself, with the leaders of its posting: first its members of
    least hash, then those with most links. Where a posting of several blocks is still not one group, each two of its blocks are compared.
    """
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    members = staged(large.select("key", "set", blocks.alias("g"), F.pmod(F.xxhash64("set"), blocks).cast("int").alias("i"), F.col("set").alias("root")), "members")
    several = members.where("g > 1").drop("root")

    def compare(pieces: DataFrame) -> DataFrame:
        return staged(pieces.join(sets, "set").select("key", "i", "j", "mine", "set", "root", "s").groupBy("key", "i", "j").applyInArrow(_forest(similarity), "a long, b long").distinct(), "links")

    def led(parts: DataFrame) -> DataFrame:
        best = F.array(*[F.min(F.struct("rank", F.xxhash64("set", F.lit(k)).alias("h"), "set", "root")) for k in range(LEADERS)])
        leaders = parts.groupBy("key", "g").agg(best.alias("l")).select("key", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("i"), "l").select("key", "i", F.explode("l").alias("l"))
        return parts.select("key", "i", "set", "root").unionByName(leaders.select("key", "i", "l.set", "l.root")).distinct().select("*", F.col("i").alias("j"), F.lit(True).alias("mine"))

    def apart(links: DataFrame) -> DataFrame:
        """Members of the postings that ``links`` do not make one group, with their groups."""
        now = several.join(components(links).withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
        open_keys = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        return staged(now.join(open_keys, "key"), "apart")

    whole = members.where("g = 1").select("key", "i", "set", "root", F.col("i").alias("j"), F.lit(True).alias("mine"))
    found = compare(whole.unionByName(led(members.where("g > 1").withColumn("rank", F.lit(0).cast("long")))))
    if several.isEmpty():
        return found
    rest = apart(found)
    if not rest.isEmpty():
        links = found.select(F.explode(F.array("a", "b")).alias("set")).groupBy("set").agg((-F.count("*")).alias("rank"))
        found = found.unionByName(compare(led(rest.join(links, "set", "left").fillna(0, ["rank"]))))
        rest = apart(found)
    if not rest.isEmpty():
        other = rest.select("key", "i", "set", "root", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o")).where("i <> o")
        found = found.unionByName(compare(other.select("key", F.least("i", "o").alias("i"), F.greatest("i", "o").alias("j"), (F.col("i") < F.col("o")).alias("mine"), "set", "root")))
    return found.distinct()


def _shingled(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("set"), pa.array([shingle_set(t, k).view(np.int64) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))], ["set", "s"])

    return run


def near_duplicates(docs: DataFrame, k: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """_rid, doc_id and keeper (the _rid that stays) of every row: rows are one group if a chain of pairs of at least ``similarity`` links them.

    Rows of equal shingle sets (by a digest of 128 bits) are one class, and only classes are compared. The smallest doc_id of a group stays (null
    last, then the first row). Null and empty texts are alike. Texts are read whole: a very long one is one array of eight bytes a word in the task
    that reads it, and its shingles count towards the size of a block. Postings above POSTING members are not expanded into
    pairs: blocks of them are searched for links by their shingles, until all pairs are compared or in one group.
    Repeated rows and ties are one class. An empty table gives an empty result; extra columns, whatever their names, are ignored.
    """
    return _grouped(identified(docs.select("doc_id", "text")), k, similarity)


def _grouped(rows: DataFrame, k: int, similarity: float) -> DataFrame:
    """``near_duplicates`` of rows that have their ``_rid``."""
    rows = rows.select("_rid", "doc_id", "text")
    signs = staged(rows.mapInArrow(_signatures(k), f"_rid {RID}, doc_id long, digest binary, sign binary, size long"), "signs")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_rid").alias("r")))
    classes = signs.groupBy("digest").agg(first.alias("first"), F.first("sign").alias("sign"), F.first("size").alias("size"))
    classes = staged(classes.withColumn("set", F.monotonically_increasing_id()), "classes")  # written once, so numbers stay
    postings = _buckets(classes)
    small, large = postings.where(F.col("n") <= POSTING), postings.where(F.col("n") > POSTING)
    pairs = staged(candidates(small), "pairs")
    met = pairs.select(F.explode(F.array("a", "b")).alias("set")).unionByName(large.select("set")).distinct()
    wanted = classes.join(met, "set").select("set", F.col("first.r").alias("_rid"))
    sets = staged(rows.select("_rid", "text").join(wanted, "_rid").select("set", "text").mapInArrow(_shingled(k), "set long, s array<long>"), "sets")
    both = pairs.join(sets.select(F.col("set").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("set").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    alike = common >= similarity * (F.size("sa") + F.size("sb") - common) - 1e-6
    roots = components(both.where(alike).select("a", "b").unionByName(linked(large, sets, similarity)))
    grouped = staged(classes.select("set", "first").join(roots, F.col("set") == F.col("node")).select("set", "first", "root"), "grouped")
    kept = grouped.join(grouped.groupBy("root").agg(F.min("first").alias("best")), "root").select("set", "best")
    named = classes.select("digest", "set", "first").join(kept, "set", "left").select("digest", F.coalesce("best", "first").getField("r").alias("keeper"))
    return signs.join(named, "digest").select("_rid", "doc_id", "keeper")


def drop_near_duplicates(docs: DataFrame, k: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Null and empty texts have no shingle and are copies of each other. Of a group one row stays, also where rows repeat or tie. A very long
    text is shingled whole by the task of its row. An empty table gives an empty result.
    """
    return chosen(docs, lambda rows: _grouped(rows, k, similarity).where(F.col("_rid") == F.col("keeper")), ["doc_id", "text"])
