"""Periodic runs against a brute-force reading of their definition."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loadlens.llm import periodic
from loadlens.llm.queries import QUERIES
from tests.conftest import SF


def plain_runs(s, least=6, periods=4):
    """All runs by their definition: for each period, maximal stretches of words equal to the one a period before."""
    found, n = {}, len(s)
    for q in range(1, n // periods + 1):
        i = q
        while i < n:
            if s[i] != s[i - q]:
                i += 1
                continue
            j = i
            while j < n and s[j] == s[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(least, periods * q):
                found.setdefault((start, length), q)  # the smallest period comes first
            i = j
    return sorted(((a, n_, q) for (a, n_), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    said = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(said), sha(kept))


@pytest.mark.parametrize("sf_dir", [SF, "edge"])
def test_query_equals_brute_force(spark, edge, sf_dir):
    at = edge["full"] if sf_dir == "edge" else sf_dir
    docs = [(i, t) for i, t in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect() if len(t or "") < 30000]
    rows = QUERIES["op12_periodic"](spark, at)
    assert rows.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got, want = [str(tuple(r)) for r in rows.collect()], sorted(str(plain_row(*d)) for d in docs)
    assert len(want) > 10 and set(want) <= set(got)


@given(st.lists(st.integers(0, 2), max_size=60))
@settings(max_examples=400, deadline=None)
def test_runs_of_small_alphabets(s):
    assert periodic.runs_of(s) == plain_runs(s)
    assert periodic.runs_of(s, 3, 3) == plain_runs(s, 3, 3)


@pytest.mark.parametrize("seed", range(40))
def test_planted_powers(seed):
    rng = random.Random(seed)
    s = []
    while len(s) < 600:
        root = [rng.randrange(rng.choice([2, 5, 50])) for _ in range(rng.randrange(1, 30))]
        s += (root * rng.randrange(1, 9))[: rng.randrange(1, 200)] if rng.random() < 0.7 else [rng.randrange(90) for _ in range(30)]
    want = plain_runs(s)
    assert periodic.runs_of(s) == want
    ids = np.array(s)
    cut = sorted((low + a, b, c) for low, high in periodic.pieces(ids, np.zeros(len(s), np.int64)) for a, b, c in periodic.runs_of(s[low:high]))
    assert cut == sorted(want)


def test_fibonacci_words_and_one_word():
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    assert periodic.runs_of(b, 3, 3) == plain_runs(b, 3, 3)
    assert periodic.runs_of([7] * 50000) == [(0, 50000, 1)]


def test_wrong_hashes_are_noticed(monkeypatch):
    s = [1, 2, 3] * 10 + [4, 5] * 9 + [6] * 20
    monkeypatch.setattr(periodic.Extensions, "_same", lambda self, i, j, n: self.s[i : i + n] == self.s[j : j + n] or n > 9)
    assert set(plain_runs(s)) <= set(periodic.runs_of(s)) and all(r in plain_runs(s) for r in periodic.runs_of(s))


def test_extra_columns_and_nulls(spark):
    rows = spark.createDataFrame([(1, ["a", "b"] * 4 + ["c"], "x"), (None, None, "y"), (2, [], None)], "doc_id long, words array<string>, runs string")
    got = {r["doc_id"]: r for r in periodic.periodic_runs(rows).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 8, 2)] and got[1]["collapsed"] == "a b c" and got[None]["runs"] == [] and got[2]["collapsed"] == ""


def test_slices_of_a_batch(spark, monkeypatch):
    rows = spark.createDataFrame([(i, ["a", "b"] * (i % 5) + ["c"] * (i % 7)) for i in range(40)] + [(99, ["x"] * 50)], "doc_id long, words array<string>").coalesce(1)
    whole = sorted(map(str, periodic.periodic_runs(rows).collect()))
    monkeypatch.setattr(periodic, "AT_ONCE", 9)
    assert sorted(map(str, periodic.periodic_runs(rows).collect())) == whole
