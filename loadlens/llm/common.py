"""Shared pieces of the training-data operators: table access, staging, row identity."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract: space and the five controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: A word of every contract: a longest run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Set only where it is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loadlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # the session has ended: its folder goes with it
        return


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver exits."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, gives exact sizes to the planner."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def carried(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def identified(df: DataFrame, name: str = "_rid") -> DataFrame:
    """``df`` with ``name``, an orderable identity of the physical row that stays the same when the plan runs again.

    Rows of a file scan are named by file and row index; other inputs are staged once and numbered. Operators select
    their own columns first, so that no other column of the input can clash with theirs.
    """
    try:
        return df.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")))
    except AnalysisException:
        return staged(df.withColumn(name, F.struct(F.lit(0).cast("long").alias("f"), F.monotonically_increasing_id().alias("i"))), "rows")


def chosen(docs: DataFrame, choose: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose ``_rid`` is among those that ``choose`` returns for ``columns`` with ``_rid``."""
    name = fresh_name(docs, "_rid")
    rows = identified(docs, name)
    kept = choose(rows.select(*columns, F.col(name).alias("_rid"))).select(F.col("_rid").alias(name))
    return rows.join(kept, name, "left_semi").select(*carried(docs))


def filtered(docs: DataFrame, start: Callable[[], Callable[[str | None], bool]], column: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose ``column`` passes the test that ``start`` gives once a task.

    Columns travel under positional names, so theirs may hold any character.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[c.alias(n) for c, n in zip(carried(docs), names, strict=True)])
    at = [c.lower() for c in docs.columns].index(column.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = start()
        for batch in batches:
            yield batch.filter(pa.array([passes(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def doc_order(doc_id: str) -> list[Column]:
    """Sort fields by which the smallest doc_id comes first and null last."""
    return [F.col(doc_id).isNull(), F.col(doc_id)]


def text_size(text: Column | str) -> Column:
    """Number of words of ``text``; null counts as empty."""
    return F.coalesce(F.regexp_count(text if isinstance(text, Column) else F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
