"""The latest partial report of each run, kept up to date by a stream: an upsert that a replayed batch does not change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: States that are kept: the newest and the one that a replay of its batch starts from.
KEPT = 2


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose state has been written whole, ascending."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("epoch=")]
    return sorted(int(p.getName()[6:]) for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _forget(spark: SparkSession, path: str, epochs: list[int]) -> None:
    jvm = spark._jvm
    for n in epochs:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/epoch={n}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last by ``order``; of rows that tie, the one that is largest as JSON. Combined before the shuffle, so a key with very many rows is no large group."""
    every = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order], F.to_json(F.struct(*sorted(rows.columns))), F.struct(*rows.columns).alias("row"))
    return rows.groupBy(*keys).agg(F.max(every).alias("_m")).select("_m.row.*")


def upsert(batch: DataFrame, epoch: int, path: str, keys: list[str], order: list[str]) -> None:
    """Write the state of ``epoch`` below ``path``: the latest row of each key among the state before it and the batch.

    The state before is the newest of a smaller number, so a batch that is replayed after a failure writes the same state again. A late row
    does not replace a later one. The state has one row a key; states older than the last two are deleted.
    """
    spark = batch.sparkSession
    before = [n for n in _epochs(spark, path) if n < epoch]
    rows = batch if not before else batch.unionByName(spark.read.parquet(f"{path}/epoch={before[-1]}"))
    latest(rows, keys, order).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    _forget(spark, path, [n for n in before if n not in [*before, epoch][-KEPT:]])


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The newest state: one row a key."""
    found = _epochs(spark, path)
    if not found:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/epoch={found[-1]}")


def progress_sink(stream: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that keeps the latest row of each key of a stream under ``path`` until its input is used up."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: upsert(batch, epoch, path, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

