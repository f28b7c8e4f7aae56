"""What the stages say of nulls, empty texts, repeats and empty tables beside them."""

import pytest

from loadlens.llm import decontaminate, exact_dedup, near_dedup, toxicity

LONG = "one two three four five six seven eight nine ten " * 3000
ROWS = [(1, None), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, "plain words of a short text"), (5, LONG), (6, LONG + "end"), (None, "x")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def left(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect())


def test_without_labels_nothing_is_toxic(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len(left(toxicity.drop_toxic(docs, labels))) == len(ROWS)


def test_null_and_empty_texts_are_not_toxic(spark):
    at = "/root/testdata/sf0.01"
    base = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text")
    more = base.unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    kept = left(toxicity.drop_toxic(more, spark.read.parquet(f"{at}/labels.parquet")))
    assert {(False, -1), (False, -2)} <= set(kept) and len(kept) < base.count()


def test_copies_keep_one_row(docs):
    kept = left(exact_dedup.dedup(docs))
    assert [k for k in kept if k[1] in (1, 2)] == [(False, 1)] and kept.count((False, 3)) == 1 and (False, 5) in kept and (True, 0) in kept


def test_near_copies_keep_one_row(docs):
    kept = left(near_dedup.drop_near_duplicates(docs))
    assert len([k for k in kept if k[1] in (1, 2) and not k[0]]) == 1 and kept.count((False, 3)) == 1 and len([k for k in kept if k[1] in (5, 6)]) == 1


def test_an_empty_benchmark_keeps_all(spark, docs):
    assert len(left(decontaminate.drop_contaminated(docs, spark.createDataFrame([], "item_id long, text string")))) == len(ROWS)
    assert len(left(decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")))) == len(ROWS)
