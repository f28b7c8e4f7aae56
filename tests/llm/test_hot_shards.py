import hashlib

import numpy as np

from loadlens.llm import suffix_dedup


def test_hot_runs_are_dealt_out_by_whole_strings(spark, monkeypatch):
    """One passage in many documents that differ at its edges: no shard above the limit, and the bytes that brute force removes."""
    monkeypatch.setattr(suffix_dedup, "LARGE", 20)
    sizes, real = [], suffix_dedup.shards

    def spy(cut):
        held, large = real(cut)
        sizes.append((max([r["count"] for r in held.groupBy("a", "shard").count().collect()], default=0), large.count()))
        return held, large

    monkeypatch.setattr(suffix_dedup, "shards", spy)
    rng = np.random.default_rng(4)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage, edges = letters(700), [letters(30) for _ in range(6)]
    rows = [(i, letters(250) + (edges[i % 6] if i % 2 else "") + passage + (edges[i % 5] if i % 3 else "") + letters(250)) for i in range(150)]
    seen = {}
    for i, t in rows:
        for at in range(len(t) - 199):
            seen.setdefault(t[at : at + 200], []).append((i, at))
    cover = {i: np.zeros(len(t), bool) for i, t in rows}
    for places in seen.values():
        for i, at in places if len(places) > 1 else ():
            cover[i][at : at + 200] = True
    got = {r["doc_id"]: r["kept_sha256"] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: hashlib.sha256(np.frombuffer(t.encode(), np.uint8)[~cover[i]].tobytes()).hexdigest() for i, t in rows}
    assert sizes[0][0] <= 20 and sizes[0][1] > 20
