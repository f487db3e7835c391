"""Written tables that cut lineage, and broadcasts of counted size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: While a table is written: few rows in a batch between JVM and Python, as texts can be long, and shuffle files go when the write is over.
WRITING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
#: Bytes that a row of two or three numbers takes in a broadcast hash relation, and the most that a broadcast may take.
ROW_BYTES = 64
BROADCAST_BYTES = 8 << 20


@contextmanager
def changed(spark: SparkSession, pairs: dict[str, str]) -> Iterator[None]:
    """The session's settings changed for a moment, and put back."""
    before = {k: spark.conf.get(k, None) for k in pairs}
    for k, v in pairs.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  A local session that names none (tests) gets a temporary one; on a
    cluster that would be another folder on every machine, so it is an error."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        path = tempfile.mkdtemp(prefix="daybook-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def grouped(rows: int | None) -> dict[str, str]:
    """Writer options for row groups of so many rows: a task that writes or reads rows of megabytes holds one group of them, however large
    its part of the table is."""
    return {} if rows is None else {"parquet.block.row.count.limit": str(rows)}


def settle(df: DataFrame, group: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there, so a lost
    executor costs nothing that came before, and later plans scan only the columns they need.  The folder goes with the
    application, or earlier by discard().  group is the number of rows in a row group, for large rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/daybook-{uuid.uuid4().hex}"
    with changed(spark, WRITING):
        df.write.options(**grouped(group)).parquet(path)
    forget_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a settled table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/daybook-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def forget(spark: SparkSession, path: str) -> None:
    """Delete what lies under path, if there is anything."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def forget_at_end(spark: SparkSession, path: str) -> None:
    """path is deleted when the application ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with no: the number, from 0, of each row in that order.  Rows are ranged, sorted within their ranges and numbered there; only
    the sizes of the ranges, one row each, meet in one task."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = settle(rows)
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    out = rows.withColumn("_part", part).join(fit(sizes), "_part")
    return out.withColumn("no", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


#: Rows that a task sorts or groups at a time, where their number is counted.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as so many rows need, if those are more than a shuffle has anyway: what a task holds does not grow
    with the table."""
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def fit(df: DataFrame, bytes_per_row: int = ROW_BYTES, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows stay below limit bytes as a hash relation; else with a hint for a merge join, so
    that Spark does not broadcast it for being small as a file."""
    return F.broadcast(df) if df.count() * bytes_per_row <= limit else df.hint("merge")
