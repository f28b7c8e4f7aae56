import numpy as np

from loadlens.llm import decontaminate


def test_several_indexes_give_the_rows_of_one(spark, monkeypatch):
    """Whole and partial copies of items of unequal length, so scores and passages depend on counts of the whole table."""
    rng = np.random.default_rng(5)
    items = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, int(rng.integers(6, 60))) % 500) + f" own{i}") for i in range(60)]
    pieces = [t.split() for _, t in items]
    docs = [(i, " ".join(["x", *w[: max(3, int(len(w) * share * 2 / 3))], *w[-max(3, int(len(w) * share / 3)) :], *(f"y{j}" for j in range(int(rng.integers(0, 200))))])) for i, (w, share) in enumerate((w, s) for w in pieces for s in (1.0, 0.75, 0.6, 0.5))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lambda: sorted(map(tuple, decontaminate.contaminated(table, bench).collect()))
    one = rows()
    kept = sorted(r[0] for r in decontaminate.drop_contaminated(table, bench).collect())
    indexes = decontaminate.indexes
    monkeypatch.setattr(decontaminate, "indexes", lambda b: indexes(b, items=25))
    assert len(decontaminate.indexes(bench)) > 1 and len(one) >= 60
    assert any(r[2] < 0.9 for r in one) and rows() == one
    assert sorted(r[0] for r in decontaminate.drop_contaminated(table, bench).collect()) == kept
