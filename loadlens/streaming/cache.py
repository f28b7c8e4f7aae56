"""Similarity cache and in-flight dedup of prompt streams: batch replay and Structured Streaming.

Decisions depend on the order of arrival and on what was not matched, so one cache is one key: its requests are
folded in order. Separate caches run side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Cache:
    """First-in first-out store of prompts. A lookup takes the exact prompt, else the first inserted one that is similar enough."""

    ttl: float = 3600.0
    size: int = 1000
    threshold: float = 0.85
    store: dict[str, float] = field(default_factory=dict)
    words: dict[str, frozenset] = field(default_factory=dict)
    evictions: int = 0

    def _drop(self, prompt: str) -> None:
        del self.store[prompt]
        self.words.pop(prompt, None)
        self.evictions += 1

    def expire(self, now: float) -> None:
        for p in [p for p, at in self.store.items() if now - at > self.ttl]:
            self._drop(p)

    def lookup(self, prompt: str, now: float) -> str | None:
        self.expire(now)
        if prompt in self.store:
            return prompt
        mine = frozenset(prompt.lower().split())
        for p in self.store:
            if p not in self.words:
                self.words[p] = frozenset(p.lower().split())
            union = len(mine | self.words[p])
            if (len(mine & self.words[p]) / union if union else 0.0) >= self.threshold:
                return p
        return None

    def put(self, prompt: str, now: float) -> None:
        """A known prompt gets the new time but keeps its place; a new one at capacity pushes out the oldest."""
        self.expire(now)
        if prompt not in self.store and len(self.store) >= self.size:
            self._drop(next(iter(self.store)))
        self.store[prompt] = now


def _step(cache: Cache, prompt: str, now: float) -> tuple[str, str | None, int]:
    found = cache.lookup(prompt, now)
    if found is None:
        cache.put(prompt, now)
    return ("miss" if found is None else "exact" if found == prompt else "similar"), found, cache.evictions


def replay(requests: DataFrame, cache: str, order: str, prompt: str, now: str, ttl: float = 3600.0, size: int = 1000, threshold: float = 0.85) -> DataFrame:
    """Decision log: per request the outcome (exact, similar, miss), the prompt that served it and evictions so far. A miss is stored."""
    kinds = dict(requests.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state = pdf.sort_values(order, kind="stable"), Cache(ttl, size, threshold)
        got = [_step(state, p, float(t)) for p, t in zip(pdf[prompt], pdf[now], strict=True)]
        return pd.DataFrame({cache: pdf[cache], order: pdf[order], "outcome": [g[0] for g in got], "served_by": [g[1] for g in got], "evictions": [g[2] for g in got]})

    return requests.select(cache, order, prompt, now).groupBy(cache).applyInPandas(run, f"{cache} {kinds[cache]}, {order} {kinds[order]}, outcome string, served_by string, evictions long")


def hit_rate(log: DataFrame, keys: list[str]) -> DataFrame:
    hits = F.count_if(F.col("outcome") != "miss")
    return log.groupBy(*keys).agg(hits.alias("hits"), F.count_if(F.col("outcome") == "miss").alias("misses"), F.try_divide(hits, F.count("*")).alias("hit_rate"))


def synthetic_hits(hits: DataFrame, latency: str = "e2e_seconds", tokens: str = "completion_tokens") -> DataFrame:
    """Timings of a cached answer: first token at nine tenths of the latency, then tokens 0.1 ms apart."""
    n = F.greatest(F.col(tokens) - 1, F.lit(0)).cast("int")
    return hits.withColumns({"ttft_seconds": 0.9 * F.col(latency), "tpot_seconds": F.lit(0.0001), "inter_chunk_seconds": F.array_repeat(F.lit(0.0001), n), "cache_hit": F.lit(True)})


def scoped_replay(requests: DataFrame, cache: str, order: str, prompt: str, scope: str, now: str, ttl: float = 3600.0, size: int = 1000, threshold: float = 0.85) -> DataFrame:
    """As ``replay``, with answers kept by exact scope under the similar prompt: outcome is served only if the scope is there too.

    ``counted`` is what the cache counts (a similar prompt is a hit whatever its scope); ``served`` is what it answers.
    """
    kinds = dict(requests.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, scopes, out = Cache(ttl, size, threshold), {}, []
        for p, s, t in pdf.sort_values(order, kind="stable")[[prompt, scope, now]].itertuples(index=False):
            found = state.lookup(p, float(t))
            scopes = {k: v for k, v in scopes.items() if k in state.store}
            served = found is not None and s in scopes.get(found, ())
            if not served:
                key = found if found is not None else p
                state.put(key, float(t))
                scopes.setdefault(key, set()).add(s)
            out.append(("hit" if found is not None else "miss", served))
        pdf = pdf.sort_values(order, kind="stable")
        return pd.DataFrame({cache: pdf[cache], order: pdf[order], "counted": [o[0] for o in out], "served": [o[1] for o in out]})

    return requests.select(cache, order, prompt, scope, now).groupBy(cache).applyInPandas(run, f"{cache} {kinds[cache]}, {order} {kinds[order]}, counted string, served boolean")


def in_flight(requests: DataFrame, key: list[str], order: str, arrival: str, seconds: str) -> DataFrame:
    """leader of each request: the running request of the same key that it waits for, or itself. A leader runs until its arrival plus its seconds.

    The requests of a key are sorted by arrival in one partition and read in one pass, so a key is never held as a whole.
    """
    kinds = dict(requests.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, until, leader = None, float("-inf"), None
        for pdf in batches:
            out = []
            for *k, o, a, s in pdf.itertuples(index=False):
                if k != now or not a < until:
                    now, leader, until = k, o, a + s
                out.append(leader)
            yield pd.DataFrame({order: pdf[order], "leader": out})

    ordered = requests.select(*key, order, arrival, seconds).repartition(*key).sortWithinPartitions(*key, arrival, order)
    return ordered.mapInPandas(run, f"{order} {kinds[order]}, leader {kinds[order]}")


def cache_stream(requests: DataFrame, cache: str, order: str, prompt: str, now: str, ttl: float = 3600.0, size: int = 1000, threshold: float = 0.85) -> DataFrame:
    """The cache over a stream: state is one list per cache, in order of insertion. Rows of a batch are taken in ``order``."""
    kinds = dict(requests.dtypes)
    out = f"{cache} {kinds[cache]}, {order} {kinds[order]}, outcome string, served_by string"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = Cache(ttl, size, threshold)
        if state.exists:
            prompts, times, held.evictions = state.get
            held.store = dict(zip(prompts, times, strict=True))
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        got = [_step(held, p, float(t)) for p, t in zip(rows[prompt], rows[now], strict=True)]
        state.update((list(held.store), list(held.store.values()), held.evictions))
        yield pd.DataFrame({cache: rows[cache].tolist(), order: rows[order].tolist(), "outcome": [g[0] for g in got], "served_by": [g[1] for g in got]})

    return requests.select(cache, order, prompt, now).groupBy(cache).applyInPandasWithState(run, out, "prompts array<string>, times array<double>, evictions long", "append", "NoTimeout")


def windowed_counts(events: DataFrame, at: str, keys: list[str], width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events per tumbling window and key of a stream (or a table); windows close ``late`` after their end."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("_at", late)
    return timed.groupBy(F.window("_at", width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")
