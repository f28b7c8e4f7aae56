"""What the driver holds of a write or a scan is a path a task, not a name a report."""

import os
import pickle

import pytest

from loadlens.sources import report_store


def _written(writer, tasks, each):
    return [writer.write(iter([{"name": f"r{t}-{i}", "report": "{}"} for i in range(each)])) for t in range(tasks)]


def test_what_tasks_tell_the_driver_does_not_grow(tmp_path):
    writer = report_store._Writer({"path": str(tmp_path)}, replace=False)
    few, many = _written(writer, 1, 3), [writer.write(iter([{"name": f"m{i}", "report": "{}"} for i in range(600)]))]
    assert len(pickle.dumps(many)) == len(pickle.dumps(few)) < 500
    writer.commit(few + many)
    assert len(os.listdir(tmp_path)) == 603 and sorted(os.listdir(tmp_path))[0] == "m0"


@pytest.mark.parametrize("replace", [False, True])
def test_a_name_of_two_tasks_publishes_nothing(tmp_path, monkeypatch, replace):
    monkeypatch.setattr(report_store, "_BLOCK", 40)
    (tmp_path / "old").write_text("mine")
    writer = report_store._Writer({"path": str(tmp_path)}, replace=replace)
    done = [*_written(writer, 3, 20), writer.write(iter([{"name": n, "report": "{}"} for n in ("z\n", "r1-7", "é")]))]
    with pytest.raises(ValueError, match="report_name_given_twice"):
        writer.commit(done)
    assert os.listdir(tmp_path) == ["old"] and (tmp_path / "old").read_text() == "mine"


def test_a_name_taken_late_undoes_all_that_was_published(tmp_path):
    writer = report_store._Writer({"path": str(tmp_path)}, replace=False)
    done = _written(writer, 3, 20)
    (tmp_path / "r2-5").write_text("other")
    with pytest.raises(FileExistsError):
        writer.commit(done)
    assert os.listdir(tmp_path) == ["r2-5"] and (tmp_path / "r2-5").read_text() == "other"


def test_a_scan_keeps_a_path_a_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(report_store, "TASK_BYTES", 100 * 4096)
    at, lists = tmp_path / "in", tmp_path / "lists"
    at.mkdir()
    lists.mkdir()
    for i in range(1000):
        (at / f"a report, number {i:04} of many").write_text(f'{{"n": {i}}}')
    reader = report_store._Reader({"path": str(at), "lists": str(lists)})
    parts = reader.partitions()
    assert 10 <= len(parts) <= 12 and len(pickle.dumps(parts)) < 200 * len(parts) + 500
    got = sorted(r for p in parts for r in reader.read(p))
    assert got == sorted((f"a report, number {i:04} of many", len(f'{{"n": {i}}}'), f'{{"n": {i}}}', None) for i in range(1000))
    assert report_store.scan_reports(spark, str(at)).where("code is null").count() == 1000
