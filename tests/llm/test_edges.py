"""Every operator and stage on edge tables and on empty tables."""

import hashlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from loadlens.llm.queries import ORACLE_SQL, QUERIES
from tests.helpers import assert_same

NOT_PER_ROW = {"op4_decontaminate", "op13_filter_audit"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_for_each_row(spark, edge, name):
    rows = QUERIES[name](spark, edge["full"]).collect()
    table = "pages" if name in ("op3_html", "op9_warc") else "documents"
    if name not in NOT_PER_ROW:
        assert len(rows) == spark.read.parquet(f"{edge['full']}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_empty_results(spark, edge, name):
    assert QUERIES[name](spark, edge["none"]).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_edges_equal_sql(spark, edge, name):
    assert_same(QUERIES[name](spark, edge["full"]), ORACLE_SQL[name], edge["full"])


def test_repeats_of_edges(spark, edge):
    got = {(r["doc_id"], r["n_bytes"]): r for r in QUERIES["op6_suffix_dedup"](spark, edge["full"]).collect()}
    assert got[10, 300]["n_removed"] == 300 and got[9, 1000]["n_removed"] == 1000 and got[9, 1000]["n_spans"] == 1
    assert got[3, 0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert [r["n_removed"] for k, r in got.items() if k[0] == 5] == [next(k[1] for k in got if k[0] == 5)]


def test_empty_texts_share_the_zero_fingerprint(spark, edge):
    got = [r for r in QUERIES["op2_simhash"](spark, edge["full"]).collect() if r["doc_id"] in (3, 4, 7)]
    assert {(r["fingerprint"], r["component_id"]) for r in got} == {("0" * 16, 3)}


def test_language_without_letters(spark, edge):
    got = {r["doc_id"]: r for r in QUERIES["op8_langid"](spark, edge["full"]).collect()}
    assert {got[i]["lang_pred"] for i in (0, 3, 4, 7)} == {"und"}


def test_pipeline_runs_on_edges(spark, edge):
    docs = spark.read.parquet(f"{edge['full']}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, edge["full"])
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    kept = sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] is not None)
    assert 1 not in kept and 2 not in kept and kept.count(5) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, edge["full"]).count() == docs.count()


CLASHES = ("_rid", "_text", "_score", "_digest", "digest", "set", "a.b", "c`d", "text.x", "toxic", "kept", "size", "item_id")


@pytest.mark.parametrize("number", range(4))
def test_stages_carry_clashing_columns(spark, edge, number):
    _, stage = corpus_pipeline.STAGES[number]
    docs = spark.read.parquet(f"{edge['full']}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    plain = sorted(map(str, stage(spark, docs, edge["full"]).collect()))
    more = docs.withColumns({c: F.lit(f"mine {i}") for i, c in enumerate(CLASHES)})
    got = stage(spark, more, edge["full"])
    assert got.columns == more.columns
    rows = got.collect()
    assert sorted(str(Row(**{c: r[c] for c in docs.columns})) for r in rows) == plain
    assert all(r[c] == f"mine {i}" for r in rows for i, c in enumerate(CLASHES))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_operators_ignore_clashing_columns(spark, edge, name, tmp_path):
    for t in ("documents", "pages", "labels", "benchmark"):
        df = spark.read.parquet(f"{edge['full']}/{t}.parquet")
        df.withColumns({c: F.lit("x") for c in CLASHES if c not in df.columns}).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == QUERIES[name](spark, edge["full"]).count()


def test_pipeline_runs_on_empty_tables(spark, edge):
    assert corpus_pipeline.run(spark, edge["none"]).count() == 0
