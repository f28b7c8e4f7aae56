"""Toxicity by compression distance: two zstandard dictionaries, one of ordinary text and one that also holds toxic text.

A window is one word, set between two fixed runs of common words that both dictionaries hold, so its compressed length
differs only by what the dictionaries know of that word. Windows that the toxic dictionary saves enough bytes on
are hits; how many bytes are enough, and the logistic function of its hits that is a document's score, are calibrated on the training rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import filtered, staged, table
from loadlens.llm.simhash import shingle_hashes

LETTERS = re.compile(r"[^\W\d_]+")
#: At most so many labelled rows of each class train the dictionaries and the calibration; they are chosen by hash.
TRAIN_ROWS = 4000
#: A toxic window is trained on if its word, or a prefix of four letters or more, occurs in this share of the toxic rows (and in LEAST_DOCS), this many times as often as in ordinary rows.
SHARE, LEAST_DOCS, LIFT, DEVIATIONS = 0.015, 4, 4.0, 4.0
#: A prefix must occur in so many times the toxic rows of its most frequent word.
STEM = 1.4
#: Least hashes by which copies among the training rows are found.
SKETCH = 8
#: Most frequent ordinary words in both dictionaries, and most words and marks (words or prefixes) of the toxic one.
ORDINARY_WORDS, TOXIC_WORDS, TOXIC_MARKS = 8000, 4000, 2000
#: Bytes saved from which a window may be a hit; the training rows decide which.
SAVED = (1, 2, 3, 4)
#: Longer words are several windows.
WINDOW = 64
_CACHE = 300_000


def words(text: str | None) -> list[str]:
    found = LETTERS.findall(text.lower()) if text else []
    if any(len(w) > WINDOW for w in found):
        found = [w[i : i + WINDOW] for w in found for i in range(0, len(w), WINDOW)]
    return found


def _units(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in range(4, len(word)))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that have a word or prefix, and occurrences of each word, combined per task."""
    seen: dict[str, list[int]] = {}

    def out():
        keys = list(seen)
        cols = np.array([seen[k] for k in keys], np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(cols[:, i]) for i in range(4))], ["unit", "t", "o", "tn", "on"])
        seen.clear()

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts = Counter(words(text))
            for unit in {u for w in counts for u in _units(w)}:
                row = seen.setdefault(unit, [0, 0, 0, 0])
                row[0 if toxic else 1] += 1
                row[2 if toxic else 3] += counts.get(unit, 0)
            if len(seen) > 1_000_000:
                yield from out()
    if seen:
        yield from out()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least hashes of each text's three-word shingles under SKETCH orders."""
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            h = shingle_hashes(text, 3)
            out.append([int((h * np.uint64(2 * i + 1) ^ (h >> np.uint64(7 + i))).min().view(np.int64)) for i in range(SKETCH)] if len(h) else [])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "keys"])


def without_copies(sample: DataFrame) -> DataFrame:
    """The rows of a bounded sample of which fewer than half of the sketch belongs to an earlier row: words of one copied text count once."""
    keys = staged(sample.select("doc_id", "text").mapInArrow(_sketch, "doc_id long, keys array<long>").select("doc_id", F.posexplode("keys").alias("i", "k")), "sketch")
    owner = keys.groupBy("i", "k").agg(F.min("doc_id").alias("o"))
    copies = keys.join(owner, ["i", "k"]).groupBy("doc_id").agg(F.count_if(F.col("o") != F.col("doc_id")).alias("n")).where(F.col("n") >= SKETCH // 2)
    return sample.join(copies, "doc_id", "left_anti")


@dataclass
class Model:
    """Contents of the dictionaries, the fixed words around a window, and the calibrated weights."""

    ordinary: bytes
    toxic: bytes
    before: bytes
    after: bytes
    weights: list[float]
    enough: int = 0


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=18, chain_log=18, hash_log=17, search_log=9, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


class Windows:
    """Bytes that the toxic dictionary saves on each window; remembers up to _CACHE words."""

    def __init__(self, model: Model):
        self.model, self.saved = model, {}
        self.ordinary, self.toxic = _compressor(model.ordinary), _compressor(model.toxic)

    def __call__(self, word: str) -> int:
        got = self.saved.get(word)
        if got is None:
            m = self.model
            x = m.before + word.encode("utf-8", "surrogatepass") + m.after
            got = len(self.ordinary.compress(x)) - len(self.toxic.compress(x))
            if len(self.saved) >= _CACHE:
                self.saved.clear()
            self.saved[word] = got
        return got

    def hits(self, text: str | None) -> tuple[int, list[int]]:
        """Windows of the text, and how many of them save at least as many bytes as each of SAVED."""
        saved = [self(w) for w in words(text)]
        return len(saved), [sum(b >= least for b in saved) for least in SAVED]

    def features(self, text: str | None) -> list[float]:
        found = words(text)
        return features(len(found), sum(self(w) >= self.model.enough for w in found))


def features(n: int, hits: int) -> list[float]:
    """Any hit, hits, share of hits, and words, the counts as logarithms."""
    return [float(hits > 0), math.log1p(hits), math.log1p(1000 * hits / n) if n else 0.0, math.log1p(n)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> list[float]:
    """Newton steps for a logistic regression with an intercept (last)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    keep[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _score(weights: list[float], features: list[float]) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * f for w, f in zip(weights, [*features, 1.0], strict=True))))))


def held_out_part(doc_id, parts: int):
    """crc32 of the id as text (null: empty text), modulo ``parts``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Fit both dictionaries and the calibration; None where a class has no row.

    Training rows are labelled rows of fold 1 to 4 (crc32 of the id modulo 5), at most ``rows`` of each class.
    Words and prefixes are counted on the executors; the driver gets those above the support, and the
    features of the training rows.
    """
    named = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(held_out_part("doc_id", 5) != 0)
    order = F.xxhash64("doc_id")
    picked = staged(named.where("toxic = 1").orderBy(order, "doc_id").limit(rows).unionByName(named.where("toxic = 0").orderBy(order, "doc_id").limit(rows)), "picked")
    sample = staged(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic"), "sample")
    sample = staged(without_copies(sample), "distinct")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    nt, no = sizes.get(1, 0), sizes.get(0, 0)
    if not nt or not no:
        return None
    counts = staged(sample.mapInArrow(_count, "unit string, t long, o long, tn long, on long").groupBy("unit").agg(*[F.sum(c).alias(c) for c in ("t", "o", "tn", "on")]), "units")
    share = (F.col("t") + F.col("o")) / (nt + no)
    deviation = (F.col("t") - share * nt) / F.sqrt(share * nt * (1 - share) + 1e-9)
    lift = (F.col("t") + 0.5) / (nt + 1) / ((F.col("o") + 0.5) / (no + 1))
    word = ~F.col("unit").endswith("*")
    stems = F.transform(F.sequence(F.lit(4), F.greatest(F.length("unit") - 1, F.lit(4))), lambda k: F.concat(F.substring("unit", F.lit(1), k), F.lit("*")))
    likely = staged(counts.where((F.col("t") >= max(LEAST_DOCS, SHARE * nt)) & (deviation >= DEVIATIONS) & (lift >= LIFT)).orderBy(deviation.desc(), "unit").limit(TOXIC_MARKS).select("unit", "t"), "likely")
    # A prefix is a mark of its own only if no single word makes up most of it: the stem of many words, not the start of one.
    tops = counts.where(word & (F.col("t") > 0)).select(F.explode(stems).alias("unit"), F.col("t").alias("w")).join(F.broadcast(likely.select("unit")), "unit").groupBy("unit").agg(F.max("w").alias("top"))
    strong = {r["unit"] for r in likely.join(tops, "unit", "left").where(word | (F.col("t") >= STEM * F.col("top"))).select("unit").collect()}
    marks = F.array(*[F.lit(u) for u in sorted(strong)]).cast("array<string>")
    toxic = [r["unit"] for r in counts.where(word & (F.col("tn") > 0) & F.arrays_overlap(F.concat(F.array("unit"), stems), marks)).orderBy(F.desc("tn"), "unit").limit(TOXIC_WORDS).select("unit").collect()]
    common = [r["unit"] for r in counts.where(word & (F.col("on") > 0)).orderBy(F.desc("on"), "unit").limit(ORDINARY_WORDS).select("unit").collect()]
    known = set(toxic)
    common = [w for w in common if w not in known] or ["a"]
    around = (" ".join(common[:24]) + " ").encode()
    shared = (" " + " ".join(reversed(common)) + " ").encode() + around
    model = Model(shared, (" " + " ".join(reversed(toxic)) + " ").encode() + shared, b" " + around[:-24] + b" ", b" " + around[-24:], [])

    def hits(batches):
        windows = Windows(model)
        for batch in batches:
            got = [windows.hits(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.int64()), pa.array([h for _, h in got], pa.list_(pa.int64())), batch.column("toxic").cast(pa.int64())], ["n", "hits", "y"])

    found = sample.mapInArrow(hits, "n long, hits array<long>, y long").collect()  # at most 2 * rows rows
    y = np.array([r["y"] for r in found], float)
    fits = []
    for k, enough in enumerate(SAVED):
        x = np.array([features(r["n"], r["hits"][k]) for r in found], float)
        weights = _logistic(x, y)
        p = np.clip([_score(weights, f) for f in x.tolist()], 1e-9, 1 - 1e-9)
        fits.append((float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()), enough, weights))
    _, model.enough, model.weights = min(fits)
    return model


def scorer(model: Model | None) -> Callable[[str | None], float]:
    """Score of a text; without a model every score is 0."""
    windows = Windows(model) if model else None
    return lambda text: _score(model.weights, windows.features(text)) if windows else 0.0


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row of ``docs``, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([of(t) for t in batch.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op5_toxicity(spark, sf_dir):
    """Null and empty texts have no hit and get the calibrated base score; repeated rows and ties score alike; labels of one
    document that disagree count as toxic; a class without a training row, so an empty label table, scores everything 0, and an
    empty document table gives an empty result. Very long texts are scored whole, as a list of their words in one task.
    Extra columns are ignored."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (held_out_part("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns, whatever their names.

    Null and empty texts have the lowest score and stay; a score of exactly one half is toxic. Repeated rows are judged alike, very long texts word by
    word and whole. An empty table gives an empty result; without labels nothing is toxic.
    """
    model = train(docs, labels)

    def start():
        of = scorer(model)
        return lambda text: of(text) < 0.5

    return filtered(docs, start)
