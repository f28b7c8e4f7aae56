"""Polling windows as a stream: equal to the batch, with state across deliveries and a timer for what does not come."""

import random

from pyspark.sql import functions as F

from loadlens.operators import windows
from loadlens.streaming import polling, progress

SCHEMA = "run string, seq long, at double, recognized_samples long, ended boolean"


def deliver(spark, at, rows, **how):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{at}/in")
    out = polling.stream_polling_windows(stream, "run", "at", "ended", **how)
    out.writeStream.outputMode("update").foreachBatch(lambda b, n: progress.upsert(b, n, f"{at}/out", ["run"], ["after_seq", "closed"])).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return {r["run"]: r for r in progress.read_progress(spark, f"{at}/out").collect()}


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    runs = {}
    for i in range(30):
        t, rows = 0.0, []
        for seq in range(rng.randrange(1, 14)):
            rows.append([f"r{i}", seq, t, rng.randrange(400), False])
            t += rng.choice([1.0, 1.0, 2.0, 5.0, 5.5 if i % 5 == 0 else 1.0])
        rows[-1][4] = True
        runs[i] = [tuple(r) for r in rows]
    whole = [r for rows in runs.values() for r in rows]
    bounds = {"most_observations": 8, "most_samples": 1800, "most_gap": 5.0}
    for low, high in ((0, 4), (4, 9), (9, 99)):
        part = [r for r in whole if low <= r[1] < high]
        rng.shuffle(part)
        got = deliver(spark, str(tmp_path), part, late="1 day", **bounds)
    want = windows.polling_windows(spark.createDataFrame(whole, SCHEMA), ["run"], "at", **bounds).collect()
    columns = ["before_seq", "after_seq", "observations", "recognized_samples", "elapsed", "code"]
    assert {k: [r[c] for c in columns] for k, r in got.items()} == {r["run"]: [r[c] for c in columns] for r in want}
    assert len({r["code"] for r in want}) >= 4 and all(r["closed"] for r in got.values())


def test_a_timer_closes_a_silent_run(spark, tmp_path):
    at = str(tmp_path)
    deliver(spark, at, [("a", 0, 0.0, 1, False), ("a", 1, 1.0, 1, False), ("b", 0, 0.0, 1, False)])
    got = deliver(spark, at, [("b", 1, 4.0, 1, False), ("c", 0, 4.0, 1, False)])
    assert (got["a"]["code"], got["a"]["closed"]) == (None, False)
    deliver(spark, at, [("b", 2, 8.0, 1, False), ("c", 1, 8.0, 1, True)])
    got = deliver(spark, at, [("b", 3, 9.0, 1, True), ("c", 2, 9.0, 1, False)])
    assert (got["a"]["code"], got["a"]["closed"], got["a"]["after_seq"]) == ("experimental_metrics_sample_gap_exceeded", True, 1)
    assert (got["b"]["code"], got["b"]["closed"], got["b"]["observations"]) == (None, True, 2)
    assert got["c"]["after_seq"] == 1 and got["c"]["closed"]


def test_nulls_and_extra_columns(spark, tmp_path):
    rows = spark.createDataFrame([("x", 0, None, None, None)], SCHEMA).withColumn("code", F.lit("mine"))
    rows.write.parquet(f"{tmp_path}/in")
    out = polling.stream_polling_windows(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "run", "at", "ended")
    out.writeStream.outputMode("update").format("memory").queryName("nulls_polled").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.table("nulls_polled").collect()] == [("x", 0, 0, 0, 0, 0.0, "experimental_metrics_window_invalid", False)]
