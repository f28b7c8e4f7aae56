"""Imported aggregate reports: every path of the allowlist, missing and of another kind."""

import copy
import json

from loadlens.operators import imported
from loadlens.sources import imported_reports as source


def sound(n=6, errored=0):
    totals = {"successful": n, "errored": errored, "incomplete": 0, "total": n + errored}
    summary = {**dict.fromkeys(source.SUMMARY, 1.5), "count": n, "total_sum": 60, "percentiles": dict.fromkeys(source.PERCENTILES, 2)}
    metrics = {"request_totals": totals, **{m: {"successful": copy.deepcopy(summary), "errored": {"note": "dropped"}} for m in source.METRICS}}
    return {"metadata": {"version": 2, "guidellm_version": "0.7.3", "host": "secret"}, "benchmarks": [{"type_": "generative_benchmark", "duration": 12.0, "metrics": metrics, "scheduler_metrics": {"requests_made": copy.deepcopy(totals)}}]}


def changed(path, change):
    report = sound()
    at, keys = report, [int(k[1:-1]) if k.startswith("[") else k for k in path.split("/")[1:]]
    for k in keys[:-1]:
        at = at[k]
    change(at, keys[-1])
    return json.dumps(report)


def read(spark, bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, report string").repartition(4)
    return {r["id"]: r for r in source.imported_reports(df).collect()}


def test_every_path_counts(spark):
    paths = [(p, what) for step in source.PATHS.values() for p, what in step if p]
    bodies, want = [], []
    for p, what in paths:
        for change in (lambda at, k: at.__delitem__(slice(k, k + 1)) if isinstance(at, list) else at.pop(k), lambda at, k: at.__setitem__(k, "x"), lambda at, k: at.__setitem__(k, True), lambda at, k: at.__setitem__(k, -1)):
            bodies.append(changed(p, change))
            want.append(source.SHAPE if what in ("object", "array") else source.NUMBER)
    got = read(spark, bodies)
    code = {i: r["code"] for i, r in got.items()}
    version = [i for i, b in enumerate(bodies) if isinstance(json.loads(b).get("metadata"), dict) and json.loads(b)["metadata"].get("version") == -1]
    assert {i: (code[i], want[i]) for i in code if code[i] != want[i] and i not in version} == {}
    assert [code[i] for i in version] == ["unsupported_report_schema"]
    assert all(r["metrics"] is None and r["total"] is None for r in got.values())


def test_sums_and_numbers(spark):
    def with_(f):
        report = sound()
        f(report, report["benchmarks"][0])
        return json.dumps(report)

    def summary(b, m):
        return b["metrics"][m]["successful"]

    cases = [
        (json.dumps(sound()), None), (json.dumps(sound(6, 2)), None), (with_(lambda r, b: b["metrics"]["request_totals"].update(total=7)), source.UNEQUAL), (with_(lambda r, b: b["scheduler_metrics"]["requests_made"].update(successful=5, errored=1)), source.UNEQUAL), (with_(lambda r, b: b.update(duration=0)), "invalid_report_duration"),
        (with_(lambda r, b: summary(b, "request_latency").update(count=5)), source.UNEQUAL), (with_(lambda r, b: summary(b, "inter_token_latency_ms").update(count=5)), None), (with_(lambda r, b: summary(b, "output_token_count").update(total_sum=1.5)), source.NUMBER), (with_(lambda r, b: summary(b, "request_latency").update(count=6.0)), source.NUMBER),
        (with_(lambda r, b: summary(b, "request_latency").update(mean=9007199254740993)), source.NUMBER), (with_(lambda r, b: r["benchmarks"].append({})), source.SHAPE), (with_(lambda r, b: r["metadata"].update(version=3)), "unsupported_report_schema"), (with_(lambda r, b: r["metadata"].update(guidellm_version=None)), "unsupported_report_version"), (with_(lambda r, b: b.update(type_="x")), source.SHAPE),
        ("{", "invalid_report_json"), (None, "invalid_report_json"), ('{"metadata":{"version":2},"metadata":{}}', "invalid_report_json"), ("[]", source.SHAPE), (json.dumps(sound(0)), None),
    ]
    got = read(spark, [b for b, _ in cases])
    assert [(i, got[i]["code"]) for i, (_, c) in enumerate(cases) if got[i]["code"] != c] == []
    assert len(got[0]["metrics"]) == 9 * 13 and got[0]["metrics"]["request_latency.p90"] == 2.0 and got[0]["output_tokens"] == 60 and (got[1]["success_rate"], got[1]["error_rate"]) == (0.75, 0.25) and got[18]["success_rate"] == 0.0
    blocks = imported.blocks(source.imported_reports(spark.createDataFrame([(0, cases[0][0]), (1, cases[1][0])], "id int, report string")), requests=5)
    assert {r["id"]: r["valid"] for r in blocks.collect()} == {0: True, 1: False}
