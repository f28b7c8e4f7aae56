"""Periodic runs of words: maximal stretches that repeat with a period, found by Lyndon words under both orders."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import WORD, table

#: A run has so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Rounds of cutting texts at words that are too rare for a run. They only save work: a cut never goes through a run.
CUTS = 8
#: Words whose numbers a task holds at once, unless one text has more.
AT_ONCE = 1 << 18
_MOD, _BASE = (1 << 61) - 1, 1_000_003_337
_NEAR = 4

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Extensions:
    """Longest common extensions of two places of a sequence: the first words one by one, then by galloping and binary search over prefix hashes."""

    def __init__(self, s: Sequence[int]) -> None:
        self.s, self.n = s, len(s)
        self.sums, self.powers = [0], [1]
        for x in s:
            self.sums.append((self.sums[-1] * _BASE + x + 1) % _MOD)
            self.powers.append(self.powers[-1] * _BASE % _MOD)

    def _same(self, i: int, j: int, n: int) -> bool:
        h, p = self.sums, self.powers[n]
        return (h[i + n] - h[i] * p - h[j + n] + h[j] * p) % _MOD == 0

    def right(self, i: int, j: int) -> int:
        """Number of equal words from places i < j on."""
        s, most, near = self.s, self.n - j, 0
        while near < most and near < _NEAR and s[i + near] == s[j + near]:
            near += 1
        if near < _NEAR or near == most:
            return near
        return self._search(most, lambda n: self._same(i, j, n))

    def left(self, i: int, j: int) -> int:
        """Number of equal words that end before places i < j."""
        s, most, near = self.s, i, 0
        while near < most and near < _NEAR and s[i - 1 - near] == s[j - 1 - near]:
            near += 1
        if near < _NEAR or near == most:
            return near
        return self._search(most, lambda n: self._same(i - n, j - n, n))

    @staticmethod
    def _search(most: int, same) -> int:
        low, high = _NEAR, min(2 * _NEAR, most)
        while high < most and same(high):
            low, high = high, min(2 * high, most)
        if high == most and same(most):
            return most
        while high - low > 1:  # low is equal, high is not
            middle = (low + high) // 2
            low, high = (middle, high) if same(middle) else (low, middle)
        return low


def _verified(s: Sequence[int], start: int, end: int, period: int) -> tuple[int, int]:
    """Ends of the run, compared word by word; stretched or cut about its middle where a hash was wrong."""
    if s[start : end - period] == s[start + period : end] and (start == 0 or s[start - 1] != s[start - 1 + period]) and (end == len(s) or s[end] != s[end - period]):
        return start, end
    low = high = (start + end - period) // 2
    while low > 0 and s[low - 1] == s[low - 1 + period]:
        low -= 1
    while high + period < len(s) and s[high] == s[high + period]:
        high += 1
    return low, high + period


def runs_of(s: Sequence[int], words: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``s`` that has ``words`` words and ``periods`` (three or more) periods, by start, then period.

    A stack of next smaller suffixes, filled from the right, gives the longest Lyndon word at each place. Every
    run of three periods repeats, at two places at least, the longest Lyndon word of one of the two orders of words; its
    period is that word's length and so its smallest. A place whose Lyndon word stands again behind it is extended both
    ways; places inside a run that is known with their period are not.
    """
    if periods < 3:
        raise ValueError("runs of fewer than three periods need not repeat a Lyndon word behind itself")
    n, found = len(s), {}
    if n < max(words, periods):
        return []
    ext = Extensions(s)
    right = ext.right
    for t in (s, [-x for x in s]):
        after = [n] * (n + 1)  # the next smaller suffix; an end is smaller than any word
        known: dict[int, tuple[int, int]] = {}
        for i in range(n - 1, -1, -1):
            e, a = i + 1, t[i]
            while e < n:
                b = t[e]
                if a > b:
                    break
                if a == b:
                    same = right(i, e)
                    if e + same == n or t[i + same] > t[e + same]:
                        break
                e = after[e]
            after[i] = e
            p = e - i
            if e + p <= n and a == t[e] and p * periods <= n:
                low, high = known.get(p, (0, 0))
                if low <= i and e + p <= high:
                    continue
                same = right(i, e)
                if same >= p:
                    low, high = _verified(s, i - ext.left(i, e), e + same, p)
                    known[p] = low, high
                    if high - low >= max(words, periods * p):
                        found[low, high - low] = min(p, found.get((low, high - low), p))
    return sorted(((low, length, p) for (low, length), p in found.items()), key=lambda r: (r[0], r[2]))


def pieces(ids: np.ndarray, text: np.ndarray, words: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> Iterator[tuple[int, int]]:
    """Places (from, to) of the stretches of ``ids`` that can hold a run. ``text`` is the number of each word's text, ascending.

    Every word of a run stands ``periods`` times in it, so no run contains a word that is rarer in its stretch.
    """
    at, part = np.arange(len(ids)), text.astype(np.int64)
    for _ in range(CUTS):
        if not len(at):
            return
        _, which, count = np.unique(part * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        keep = count[which] >= periods
        if keep.all():
            break
        at, part = at[keep], part[keep]
        opens = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(part) != 0)])[: len(at)]
        part = np.cumsum(opens) - 1
        long = np.bincount(part, minlength=1)[part] >= words if len(at) else np.zeros(0, bool)
        at, part = at[long], part[long]
    if len(at):
        cuts = np.flatnonzero((np.diff(at) > 1) | (np.diff(part) != 0)) + 1
        for low, high in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(at)]]), strict=True):
            yield int(at[low]), int(at[high - 1]) + 1


def periodic_runs(rows: DataFrame, words: str = "words", keep: Sequence[str] = ("doc_id",), least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """The columns ``keep``, ``runs`` and ``collapsed`` of each row: the runs of its words (by start, then period), and the words that are left, joined by one space, when what follows the first period of any run is dropped.

    A row's words are judged in one task, which holds numbers for them and a few arrays of that size, so a very long text
    costs memory in proportion to its length. A null array counts as empty. Repeated rows are judged each;
    runs that start together are in order of their period. Extra columns are ignored; an empty table gives an empty result.
    """
    none = F.array().cast("array<string>")
    given = rows.select(*keep, F.coalesce(F.col(words), none).alias("_w"))
    kinds = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "runs array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed string"])

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Slices of about AT_ONCE words; a longer text is one of its own."""
        after = np.cumsum(pc.list_value_length(batch.column("_w")).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < len(after):
            high = max(low + 1, int(np.searchsorted(after, (after[low - 1] if low else 0) + AT_ONCE, "right")))
            yield batch.slice(low, high - low)
            low = high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole)):
            column = batch.column("_w")
            sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            flat = column.flatten()
            ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            text = np.repeat(np.arange(len(sizes)), sizes)
            found: list[tuple[int, int, int, int]] = []
            change = np.zeros(len(ids) + 1, np.int64)
            for low, high in pieces(ids, text, least, periods) if len(ids) else ():
                of = int(text[low])
                for start, length, period in runs_of(ids[low:high].tolist(), least, periods):
                    found.append((of, low + start - int(starts[of]), length, period))
                    change[low + start + period] += 1
                    change[low + start + length] -= 1
            found.sort(key=lambda r: (r[0], r[1], r[3]))
            table_ = np.array(found, np.int64).reshape(-1, 4)
            ends = np.concatenate([[0], np.cumsum(np.bincount(table_[:, 0], minlength=len(sizes)))]).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(table_[:, k]) for k in (1, 2, 3)], fields=list(RUN)))
            left = np.cumsum(change)[:-1] == 0
            bounds = np.concatenate([[0], np.cumsum(left)])[starts].astype(np.int32)
            kept = flat.filter(pa.array(left)) if found else flat
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), kept), " ")
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], runs, collapsed], [*keep, "runs", "collapsed"])

    return given.mapInArrow(run, schema)


def planted_words(doc_id: Column, words: Column) -> Column:
    """The contract's words: in a tenth of the texts the words from a place on repeat with a period. A null doc_id changes nothing."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, n = F.expr("0L") + F.floor(h / 10), F.size(words)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    again = F.transform(words, lambda x, i: F.when(i < a, x).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))
    return F.when((h % 10 == 0) & (n > 0), again).otherwise(words)


def op12_periodic(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)).alias("w"))
    found = periodic_runs(words.select("doc_id", planted_words(F.col("doc_id"), F.col("w")).alias("words")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda b, x: F.when(b.isNull() | (x["length"] * b["period"] > b["length"] * x["period"]), x).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(x["start"], F.lit(","), x["length"], F.lit(","), x["period"], F.lit("\n"))), "")
    said = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return said.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("(1000 * b.length) div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
