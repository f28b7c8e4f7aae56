"""The registered cache queries against plain Python, on prompts that differ only after their first 40 characters."""

from collections import Counter, defaultdict

from __spark_entry__ import queries
from loadlens.streaming.cache import Cache


def test_cache_queries_judge_whole_prompts(spark, tmp_path):
    head = "please explain in a few short words what this is about"
    rows = [(8 * (i % 9) + i % 2, i, "user", f"{head} {' '.join(f'w{(i * k) % 7}' for k in range(1, 12))}{' twin' if i % 3 else ''}") for i in range(60)] + [(1, 99, "assistant", "no prompt")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if role == "user":
            by[conv % 8].append((conv * 1000 + turn, text, conv * 10.0 + turn, str(turn % 2)))
    log, scoped = [], []
    for key, arrivals in by.items():
        one, two, scopes = Cache(2000.0, 50, 0.6), Cache(2000.0, 50, 0.6), {}
        for seq, text, now, scope in sorted(arrivals):
            found = one.lookup(text, now)
            if found is None:
                one.put(text, now)
            log.append((key, seq, "miss" if found is None else "exact" if found == text else "similar", found, one.evictions))
            found = two.lookup(text, now)
            scopes = {k: v for k, v in scopes.items() if k in two.store}
            served = found is not None and scope in scopes.get(found, ())
            if not served:
                two.put(text if found is None else found, now)
                scopes.setdefault(text if found is None else found, set()).add(scope)
            scoped.append((key, seq, "miss" if found is None else "hit", served))
    run = lambda name: queries()[name](spark, str(tmp_path))
    assert sorted(map(tuple, run("c01_similarity_cache").select("cache", "seq", "outcome", "served_by", "evictions").collect())) == sorted(log)
    assert sorted(map(tuple, run("c04_scoped_cache").select("cache", "seq", "counted", "served").collect())) == sorted(scoped)
    total, missed = Counter(r[0] for r in log), Counter(r[0] for r in log if r[2] == "miss")
    assert {r["cache"]: (r["hits"], r["misses"], r["hit_rate"]) for r in run("a19_cache_hit_rate").collect()} == {k: (n - missed[k], missed[k], (n - missed[k]) / n) for k, n in total.items()}
