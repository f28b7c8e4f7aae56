"""Saved report files, progress states and running sums in pieces."""

import json
import os
import stat

import pytest
from pyspark.sql import functions as F

from loadlens.operators import runs
from loadlens.sources import report_store
from loadlens.streaming import progress

DEEP = {"b": {"y": 1, "x": [1.5, {"k": "é", "j": None}]}, "a": True}


def saved(spark, path, rows, **how):
    report_store.save_reports(spark.createDataFrame(rows, "name string, report string").repartition(3), str(path), **how)


def test_one_private_file_a_report_with_sorted_keys(spark, tmp_path):
    saved(spark, tmp_path, [(f"r{i}.json", json.dumps({**DEEP, "n": i})) for i in range(7)])
    assert sorted(os.listdir(tmp_path)) == [f"r{i}.json" for i in range(7)]
    for i in range(7):
        at = tmp_path / f"r{i}.json"
        assert stat.S_IMODE(at.stat().st_mode) == 0o600
        assert at.read_text() == json.dumps({**DEEP, "n": i}, indent=2, sort_keys=True) + "\n"


def test_an_existing_target_is_refused_and_nothing_changes(spark, tmp_path):
    (tmp_path / "b").write_text("mine")
    with pytest.raises(Exception, match="report_already_exists"):
        saved(spark, tmp_path, [("a", "{}"), ("b", "{}"), ("c", "{}")])
    assert os.listdir(tmp_path) == ["b"] and (tmp_path / "b").read_text() == "mine"
    os.symlink("/nowhere", tmp_path / "d")
    with pytest.raises(Exception, match="report_already_exists"):
        saved(spark, tmp_path, [("d", "{}")])
    saved(spark, tmp_path, [("b", "{}"), ("c", "{}")], replace=True)
    assert (tmp_path / "b").read_text() == "{}\n" and sorted(os.listdir(tmp_path)) == ["b", "c", "d"]


@pytest.mark.parametrize("bad", ['{"a": {"b": [NaN]}}', '{"a": {"b": -Infinity}}', '{"a": {"b": 1e999}}', '{"a": 1, "a": 2}', "[]", "{", None])
def test_reports_that_are_refused_leave_nothing(spark, tmp_path, bad):
    with pytest.raises(Exception, match="report"):
        saved(spark, tmp_path, [("a", "{}"), ("b", bad)])
    assert os.listdir(tmp_path) == []


@pytest.mark.parametrize("name", ["", ".x", "a/b", "../x", "n" * 300])
def test_names_that_are_no_names(spark, tmp_path, name):
    with pytest.raises(Exception, match="invalid_report_name"):
        saved(spark, tmp_path, [(name, "{}")])


def test_a_name_given_twice_publishes_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="report_name_given_twice"):
        saved(spark, tmp_path, [("a", "{}"), ("b", "{}"), ("a", '{"x": 1}')])
    assert os.listdir(tmp_path) == []


def test_a_name_taken_before_the_commit_undoes_it(tmp_path):
    writer = report_store._Writer({"path": str(tmp_path)}, replace=False)
    first = writer.write(iter([{"name": "a", "report": "{}"}, {"name": "b", "report": "{}"}]))
    (tmp_path / "b").write_text("other")
    with pytest.raises(FileExistsError):
        writer.commit([first])
    assert os.listdir(tmp_path) == ["b"] and (tmp_path / "b").read_text() == "other"
    writer = report_store._Writer({"path": str(tmp_path)}, replace=False)
    second = writer.write(iter([{"name": "c", "report": "{}"}]))
    writer.abort([second, None])
    assert os.listdir(tmp_path) == ["b"]
    with pytest.raises(FileNotFoundError):
        writer.write(iter([{"name": "c", "report": "{}"}]))


def test_files_are_checked_before_they_are_opened(spark, tmp_path, monkeypatch):
    (tmp_path / "good").write_text(json.dumps(DEEP))
    (tmp_path / "large").write_text(" " * 501)
    (tmp_path / "bytes").write_bytes(b'{"a": "\xff"}')
    (tmp_path / ".hidden").write_text("{}")
    os.symlink(tmp_path / "good", tmp_path / "link")
    os.mkdir(tmp_path / "folder")
    os.mkfifo(tmp_path / "pipe")
    got = {r["file"]: r["code"] for r in report_store.scan_reports(spark, str(tmp_path), 500).collect()}
    assert got == {"good": None, "large": "report_exceeds_size_limit", "bytes": "report_unreadable", "link": "report_not_regular_file", "folder": "report_not_regular_file", "pipe": "report_not_regular_file"}
    reader = report_store._Reader({"path": str(tmp_path), "mostBytes": "500"})
    assert reader._open(str(tmp_path / "link"))[1] == "report_unreadable" and reader._open(str(tmp_path / "pipe"))[1] == "report_not_regular_file" and reader._open(str(tmp_path / "large"))[1] == "report_exceeds_size_limit"


def test_filters_on_names_reach_the_listing(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"r{i:02}").write_text("{}")
    rows = report_store.scan_reports(spark, str(tmp_path))
    assert rows.where("file in ('r01', 'r07', 'x')").count() == 2 and rows.where("file like 'r1%' and code is null").count() == 10
    reader = report_store._Reader({"path": str(tmp_path)})
    rest = list(reader.pushFilters([report_store.StringStartsWith(("file",), "r2"), report_store.EqualTo(("code",), "x")]))
    assert len(rest) == 1 and sum(len(p.files) for p in reader.partitions()) == 10


def test_scans_are_cut_by_size(tmp_path, monkeypatch):
    monkeypatch.setattr(report_store, "TASK_BYTES", 10_000)
    for i in range(20):
        (tmp_path / f"r{i:02}").write_text(" " * 2000)
    parts = report_store._Reader({"path": str(tmp_path)}).partitions()
    assert len(parts) > 5 and sorted(f for p in parts for f, *_ in p.files) == [f"r{i:02}" for i in range(20)]


def state(spark, path):
    return {r["run"]: (r["seq"], r["body"]) for r in progress.read_progress(spark, path).collect()}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    at, schema = str(tmp_path / "p"), "run string, seq int, body string"
    one = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 1, "z"), ("a", 3, "x")], schema)
    two = spark.createDataFrame([("a", 2, "late"), ("b", 5, "w"), ("c", None, "n")], schema)
    for batch, epoch in ((one, 0), (two, 1), (two, 1), (two, 1)):
        progress.upsert(batch, epoch, at, ["run"], ["seq"])
        assert len(state(spark, at)) == (2 if epoch == 0 else 3)
    assert state(spark, at) == {"a": (3, "y"), "b": (5, "w"), "c": (None, "n")}
    progress.upsert(one.limit(0), 2, at, ["run"], ["seq"])
    assert len(state(spark, at)) == 3 and sorted(p.name for p in (tmp_path / "p").iterdir()) == ["epoch=1", "epoch=2"]


def test_a_half_written_state_is_not_read(spark, tmp_path):
    at = str(tmp_path / "p")
    progress.upsert(spark.createDataFrame([("a", 1, "x")], "run string, seq int, body string"), 4, at, ["run"], ["seq"])
    os.makedirs(f"{at}/epoch=5/_temporary")
    assert state(spark, at) == {"a": (1, "x")}
    with pytest.raises(FileNotFoundError):
        progress.read_progress(spark, str(tmp_path / "none"))


def test_a_stream_ends_with_the_latest_of_each(spark, tmp_path):
    log = spark.range(2000).selectExpr("id % 37 AS run", "id * 7919 % 2003 AS seq", "cast(id AS string) AS body")
    log.repartition(7).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second finds nothing new
        progress.progress_sink(stream, ["run"], ["seq"], str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    want = {r["run"]: (r["seq"], r["body"]) for r in log.groupBy("run").agg(F.max_by(F.struct("seq", "body"), "seq").alias("m")).select("run", "m.*").collect()}
    assert state(spark, str(tmp_path / "out")) == want


@pytest.mark.parametrize("width", [1, 10, 997, 10**9])
def test_running_sums_in_pieces(spark, width):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id % 2 END AS k", "id AS i", "CASE WHEN id % 5 > 0 THEN id % 11 END AS v").repartition(5)
    got = {r["i"]: (r["a"], r["n"]) for r in runs.prefix_sums(rows, ["k"], ["i"], F.floor(F.col("i") / width), {"a": F.col("v"), "n": F.lit(1)}).collect()}
    want, sums = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r["i"]):
        a, n = sums.get(r["k"], (0, 0))
        sums[r["k"]] = want[r["i"]] = (a + (r["v"] or 0), n + 1)
    assert got == want


@pytest.mark.parametrize("width", [None, 1, 50, 100_000])
def test_peak_of_one_group_in_pieces(spark, width):
    spans = spark.range(2000).selectExpr("id % 2 AS k", "id * 7919 % 4001 AS a", "id * 7919 % 4001 + id % 97 AS z")
    got = {r["k"]: r["peak_in_flight"] for r in runs.peak_in_flight(spans, ["k"], "a", "z", width).collect()}
    for k in (0, 1):
        moves = sorted(x for r in spans.collect() if r["k"] == k for x in ((r["a"], 1), (r["z"], -1)))
        now = top = 0
        for _, move in moves:
            now += move
            top = max(top, now)
        assert got[k] == top
