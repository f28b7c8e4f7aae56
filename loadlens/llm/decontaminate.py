"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND, then verified by overlap.

The test items are the indexed collection, and every passage of every document is a query. Impacts are divided by the
item's score against itself, so one threshold (a share of a full match) holds for all items and prunes by upper bounds:
terms that cannot reach it even together are not opened, blocks of items whose block maxima cannot reach it are skipped,
and only items in the blocks left are scored in full. Retrieval is complete: it returns every item at or above the threshold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import filtered, staged, table

TOKEN = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
#: Share of the item's self score from which an item is retrieved.
THRESHOLD = 0.5
#: Share of the question's and of the answer's word trigrams that the passage must hold.
OVERLAP = 0.5
GRAM = 3
#: Passages of a document whose bounds are computed at once.
PASSAGES = 512
#: Wide blocks whose maxima are summed for all passages of a document at once, and cells of their table.
WIDE_BLOCKS, WIDE_CELLS = 64, 25_000_000
#: Items per posting block, and items per index; more items are searched index by index, so no more than these are broadcast at once.
BLOCK, ITEMS = 8, 20_000


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def parts(text: str | None) -> tuple[list[str], list[str]]:
    """Question and answer of an item: the last line is the answer; of one line, the last third of its words."""
    lines = [t for line in (text or "").splitlines() if (t := tokens(line))]
    if len(lines) > 1:
        return [w for line in lines[:-1] for w in line], lines[-1]
    words = lines[0] if lines else []
    cut = max(1, len(words) * 2 // 3)
    return words[:cut], words[cut:]


def ngrams(words: list[str], n: int = GRAM) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlap(part: list[str], found: dict[int, set]) -> float:
    """Share of the part's n-grams among the passage's; an empty part is covered."""
    grams = ngrams(part)
    return len(grams & found[min(GRAM, len(part))]) / len(grams) if grams else 1.0


@dataclass
class Index:
    ids: list[int]
    parts: list[tuple[list[str], list[str]]]
    window: int
    vocab: dict[str, int] = field(default_factory=dict)
    upper: np.ndarray | None = None  # per term, the last entry for words outside
    starts: np.ndarray | None = None  # postings of a term, items ascending
    items: np.ndarray | None = None
    impacts: np.ndarray | None = None
    block_starts: np.ndarray | None = None  # blocks of a term and their maxima
    blocks: np.ndarray | None = None
    maxima: np.ndarray | None = None
    coarse: np.ndarray | None = None  # per term (the last row for words outside) the maxima of a few wide blocks


class _Ids(dict):
    """Term numbers; words outside have the number after the last."""

    def __missing__(self, word: str) -> int:
        return self.outside


@dataclass
class Counts:
    """What scores and passages take from the whole benchmark: items, their mean and greatest length, and items by word."""

    items: int
    mean: float
    longest: int
    df: dict[str, int]


def build(rows: list[tuple[int, str | None]], whole: Counts | None = None) -> Index:
    """Inverted index of (item_id, text) rows, which are all items or, with the counts of all, a part. Items without a word match nothing."""
    rows = [(i, t) for i, t in rows if tokens(t)]
    docs = [Counter(tokens(t)) for _, t in rows]
    sizes = [sum(d.values()) for d in docs]
    n, df = len(docs), Counter(w for d in docs for w in d)
    whole = whole or Counts(n, sum(sizes) / max(1, n), max(sizes, default=1), df)
    index = Index([i for i, _ in rows], [parts(t) for _, t in rows], 2 * whole.longest)
    index.vocab = {w: k for k, w in enumerate(sorted(df))}
    postings: list[list[tuple[int, float]]] = [[] for _ in df]
    for k, (d, size) in enumerate(zip(docs, sizes, strict=True)):
        one = {w: np.log(1 + (whole.items - whole.df[w] + 0.5) / (whole.df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * size / whole.mean)) for w, c in d.items()}
        full = sum(one.values())
        for w, x in one.items():
            postings[index.vocab[w]].append((k, x / full))
    flat = [p for term in postings for p in term]
    index.items, index.impacts = np.array([p[0] for p in flat], np.int64), np.array([p[1] for p in flat], np.float64)
    index.starts = np.concatenate(([0], np.cumsum([len(t) for t in postings]))).astype(np.int64)
    index.upper = np.array([max(x for _, x in t) for t in postings] + [0.0])
    block_rows, counts = [], []
    for term in postings:
        best: dict[int, float] = {}
        for k, x in term:
            best[k // BLOCK] = max(best.get(k // BLOCK, 0.0), x)
        block_rows += sorted(best.items())
        counts.append(len(best))
    index.blocks, index.maxima = np.array([b for b, _ in block_rows], np.int64), np.array([x for _, x in block_rows], np.float64)
    index.block_starts = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    wide = -(-max(1, n) // int(max(1, min(n or 1, WIDE_BLOCKS, WIDE_CELLS // (len(df) + 1)))))
    index.coarse = np.zeros((len(df) + 1, -(-max(1, n) // wide)), np.float32)
    np.maximum.at(index.coarse, (np.repeat(np.arange(len(df)), np.diff(index.starts)), index.items // wide), index.impacts.astype(np.float32) * np.float32(1 + 1e-6))
    return index


def _ranges(starts: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Positions of all postings of the terms."""
    a, n = starts[terms], starts[terms + 1] - starts[terms]
    ends = np.cumsum(n)
    return np.repeat(a - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def search(index: Index, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """(item position, score) of every item at or above the threshold for the distinct ``terms`` of a passage."""
    threshold -= 1e-9
    upper = index.upper[terms]
    order = np.argsort(upper)
    reach = np.cumsum(upper[order])
    if not len(reach) or reach[-1] < threshold:
        return []
    essential = terms[order[np.searchsorted(reach, threshold) :]]  # what lies below cannot reach the threshold by itself
    opened = np.unique(index.blocks[_ranges(index.block_starts, essential)])
    at = _ranges(index.block_starts, terms)
    slot = np.searchsorted(opened, index.blocks[at])
    slot[slot == len(opened)] = 0
    known = opened[slot] == index.blocks[at]
    bound = np.bincount(slot[known], weights=index.maxima[at][known], minlength=len(opened))
    live = opened[bound >= threshold]
    if not len(live):
        return []
    at = _ranges(index.starts, terms)
    items = index.items[at]
    inside = np.isin(items // BLOCK, live)
    items, where = np.unique(items[inside], return_inverse=True)
    scores = np.bincount(where, weights=index.impacts[at][inside])
    return [(int(i), float(s)) for i, s in zip(items, scores, strict=True) if s >= threshold]


def leaks(index: Index, text: str | None, threshold: float = THRESHOLD, least: float = OVERLAP) -> dict[int, tuple[float, float, float]]:
    """Per leaked item position: best score, and question and answer overlap of that passage.

    Passages are windows of twice the longest item, half a window apart, so any item lies whole in one.
    """
    words, found = tokens(text), {}
    if not words or not index.ids:
        return found
    outside = len(index.vocab)
    lookup = _Ids(index.vocab) if not isinstance(index.vocab, _Ids) else index.vocab
    lookup.outside, index.vocab = outside, lookup
    ids = np.fromiter(map(lookup.__getitem__, words), np.int64, len(words))
    step = index.window // 2
    count = max(1, -(-(len(words) - step) // step))
    for first in range(0, count, PASSAGES):
        last = min(count, first + PASSAGES)
        part = ids[first * step : (last + 1) * step]
        inside = np.flatnonzero(part < outside)
        piece = inside // step
        known = part[inside]
        # A passage is two pieces: each word counts once for the passage that its piece begins and once for the one before.
        pairs = np.unique(np.concatenate((piece * outside + known, (piece - 1) * outside + known)))
        pairs = pairs[(pairs >= 0) & (pairs < (last - first) * outside)]
        if not len(pairs):
            continue
        passage, terms_of = np.divmod(pairs, outside)
        heads = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        bounds = np.add.reduceat(index.coarse[terms_of], heads, axis=0).max(axis=1)
        ends = np.append(heads[1:], len(pairs))
        for h in np.flatnonzero(bounds >= threshold - 1e-4).tolist():
            start = (first + int(passage[heads[h]])) * step
            end = min(len(words), start + index.window)
            terms = terms_of[heads[h] : ends[h]]
            _verify(index, words, start, end, terms, threshold, least, found)
    return found


def _verify(index: Index, words: list[str], start: int, end: int, terms: np.ndarray, threshold: float, least: float, found: dict[int, tuple[float, float, float]]) -> None:
    """Search one passage in full and keep the items whose question and answer it holds."""
    hits = search(index, terms, threshold)
    if hits:
        grams = {n: {tuple(words[i : i + n]) for i in range(start, end - n + 1)} for n in range(1, GRAM + 1)}
        for item, score in hits:
            q, a = (overlap(p, grams) for p in index.parts[item])
            if q >= least and a >= least and (item not in found or score > found[item][0]):
                found[item] = (score, q, a)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words and the distinct words of each item that has any."""
    for batch in batches:
        found = [(p, w) for p, t in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist(), strict=True) if (w := tokens(t))]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([len(w) for _, w in found], pa.int64()), pa.array([sorted(set(w)) for _, w in found], pa.list_(pa.string()))], ["part", "size", "words"])


def indexes(benchmark: DataFrame, items: int = ITEMS) -> list[Index]:
    """Indexes of at most ``items`` items each over the whole benchmark table; null ids and null texts match nothing.

    Items are weighed and passages cut by counts of the whole table, so rows do not depend on the number of indexes.
    """
    rows = staged(benchmark.select("item_id", "text").where("item_id is not null and text is not null").dropDuplicates(), "items")
    n = max(1, -(-rows.count() // items))
    if n == 1:
        return [build(sorted((r["item_id"], r["text"]) for r in rows.collect()))]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * n)))
    words = staged(rows.select("part", "text").mapInArrow(_words, "part long, size long, words array<string>"), "item_words")
    count, total, longest = words.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    each = words.select("part", F.explode("words").alias("word"))
    df = staged(each.distinct().join(each.groupBy("word").agg(F.count("*").alias("n")), "word"), "item_counts")

    def part(k: int) -> Index:
        known = {r["word"]: r["n"] for r in df.where(F.col("part") == k).select("word", "n").collect()}  # the words of one index
        return build(sorted((r["item_id"], r["text"]) for r in rows.where(F.col("part") == k).collect()), Counts(count, (total or 0) / max(1, count), longest or 1, known))

    return [part(k) for k in range(2 * n)]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: float = OVERLAP) -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, score, question_overlap, answer_overlap.

    Documents are read whole, in one pass per index and without a shuffle; of a very long one, PASSAGES passages are bounded at a
    time. Null and empty texts leak nothing; repeated rows give their rows each, and of passages that tie the first counts; an empty
    benchmark or document table gives an empty result; extra columns are ignored.
    """
    out = None
    for index in indexes(benchmark):
        packed = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], packed=packed) -> Iterator[pa.RecordBatch]:
            index = packed.value
            for batch in batches:
                rows = [(d, index.ids[i], *got) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for i, got in leaks(index, t, threshold, least).items()]
                yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "score", "question_overlap", "answer_overlap"), r, strict=True)) for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))

        got = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = got if out is None else out.unionByName(got)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns, whatever their names.

    Null and empty texts leak nothing and stay. Repeated rows stay or go together; scores that tie with the threshold count as above it. Very long
    texts are judged passage by passage, whole. An empty table gives an empty result, an empty benchmark keeps all rows.
    """
    for index in indexes(benchmark):
        packed = docs.sparkSession.sparkContext.broadcast(index)
        docs = filtered(docs, lambda packed=packed: lambda text: not leaks(packed.value, text, threshold, least))
    return docs


def op4_decontaminate(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
