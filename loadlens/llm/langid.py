"""Language identification: known words by per-language log frequency, unseen words by progressively shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadlens.llm.common import staged, table
from loadlens.llm.toxicity import held_out_part

LETTERS = re.compile(r"[^\W\d_]+")
#: About so many rows of each language train the model; they are chosen by hash.
TRAIN_ROWS = 1500
#: Units kept per language: words, and n-grams of each length. Together they bound the model that is broadcast.
TOP_WORDS, TOP_GRAMS = 20_000, {5: 12_000, 4: 8_000, 3: 4_000, 2: 1_000, 1: 300}
SMOOTHING = 0.5
LONGEST = 5
_CACHE = 200_000
WORD_KIND = 0


def grams(word: str, n: int) -> list[str]:
    padded = f"_{word}_" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of words and n-grams by language, combined per task."""
    seen: Counter = Counter()

    def out():
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], ["lang", "kind", "unit", "n"])
        seen.clear()

    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            for word, n in Counter(LETTERS.findall((text or "").lower())).items():
                seen[lang, WORD_KIND, word] += n
                for k in range(1, LONGEST + 1):
                    for g in grams(word, k):
                        seen[lang, k, g] += n
            if len(seen) > 500_000:
                yield from out()
    if seen:
        yield from out()


class Model:
    """Per-language log frequencies: one matrix row for each known word, and for each unseen word met lately."""

    def __init__(self, langs: list[str], tables: dict[int, tuple[list[str], np.ndarray]]):
        self.langs, self.grams = langs, {k: dict(zip(units, rows, strict=True)) for k, (units, rows) in tables.items() if k != WORD_KIND}
        units, rows = tables[WORD_KIND]
        self.known = len(units)
        self.matrix = np.zeros((self.known + _CACHE, max(1, len(langs))), np.float32)
        self.matrix[: self.known] = rows
        self.words = {u: i for i, u in enumerate(units)}
        self.unseen: dict[str, int] = {}

    def backoff(self, word: str) -> np.ndarray:
        """Mean over the word's longest n-grams of which one is known; zeros if none is."""
        for n in range(LONGEST, 0, -1):
            known = [v for g in grams(word, n) if (v := self.grams[n].get(g)) is not None]
            if known:
                return np.mean(known, axis=0, dtype=np.float32)
        return np.zeros(self.matrix.shape[1], np.float32)

    def row(self, word: str) -> int:
        at = self.words.get(word)
        if at is None:
            at = self.unseen.get(word)
        if at is None:
            at = self.unseen[word] = self.known + len(self.unseen)
            self.matrix[at] = self.backoff(word)
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its posterior probability; ``und`` and 0 without a letter."""
        counts = Counter(LETTERS.findall((text or "").lower()))
        if not counts or not self.langs:
            return "und", 0.0
        total, found, times = np.zeros(len(self.langs)), list(counts), np.array(list(counts.values()), np.float64)
        for i in range(0, len(found), _CACHE):
            if len(self.unseen) + len(found[i : i + _CACHE]) > _CACHE:
                self.unseen.clear()
            total += times[i : i + _CACHE] @ self.matrix[[self.row(w) for w in found[i : i + _CACHE]]]
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], dict[int, dict[str, list[float]]]]:
    """Learn from rows with a language whose crc32 of the id modulo 4 is not 2, about ``rows`` of each language.

    Counting runs on the executors; the driver gets the most frequent units of each language, a bounded number.
    """
    learn = docs.select("doc_id", "text", "lang").where((held_out_part("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = staged(learn.groupBy("lang").agg(F.count("*").alias("_n")), "langs")
    share = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit("lang")), F.lit(1_000_000)) / 1e6
    sample = learn.join(sizes, "lang").where(share * F.col("_n") < rows).select("text", "lang")
    counts = staged(sample.mapInArrow(_count, "lang string, kind int, unit string, n long").groupBy("lang", "kind", "unit").agg(F.sum("n").alias("n")), "counts")
    most = F.element_at(F.create_map(*[F.lit(x) for k, v in {WORD_KIND: TOP_WORDS, **TOP_GRAMS}.items() for x in (k, v)]), F.col("kind"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "unit"))).where(F.col("_r") <= most)
    kept = ranked.select("lang", "kind", "unit", "n").collect()
    totals = {(r["lang"], r["kind"]): (r["n"], r["u"]) for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("u")).collect()}
    langs = sorted({k[0] for k in totals})
    at = {x: i for i, x in enumerate(langs)}
    tables: dict[int, dict[str, list[float]]] = {k: {} for k in range(LONGEST + 1)}
    base = {k: [math.log(SMOOTHING / (totals.get((x, k), (0, 0))[0] + SMOOTHING * (totals.get((x, k), (0, 0))[1] + 1))) for x in langs] for k in tables}
    for r in kept:
        row = tables[r["kind"]].setdefault(r["unit"], list(base[r["kind"]]))
        n, u = totals[r["lang"], r["kind"]]
        row[at[r["lang"]]] = math.log((r["n"] + SMOOTHING) / (n + SMOOTHING * (u + 1)))
    return langs, tables


def identify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0, as is everything where no language can be learned.
    A null doc_id counts as an empty id. Ties go to the first language in order. Repeated rows are predicted alike. A very long text is
    read whole by the task of its row: its words are counted first, so it costs a number for each different word. Extra columns are ignored; an
    empty table gives an empty result.
    """
    langs, tables = train(docs, rows)
    packed = docs.sparkSession.sparkContext.broadcast((langs, {k: (list(t), np.array(list(t.values()), np.float32).reshape(-1, max(1, len(langs)))) for k, t in tables.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts = packed.value
        model = Model(names, parts)
        for batch in batches:
            got = [model.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (held_out_part("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_langid(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))
