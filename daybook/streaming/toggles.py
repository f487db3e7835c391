"""Toggles folded per key, on tables and on streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def toggle_state(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, n, is_set): a key is set after an odd number of toggles.  On a stream: update mode, one counter per key."""
    out = events.groupBy(key).agg(F.count("*").alias("n"))
    return out.withColumn("is_set", F.col("n") % 2 == 1)


def listing(state: DataFrame, key: str = "user_id") -> DataFrame:
    return state.where("is_set").select(key)


def start(events: DataFrame, path: str, checkpoint: str, key: str = "user_id"):
    """The fold as a running query: each batch writes the keys that it changed under path, by its number, so a batch that runs
    again replaces its own files.  The counters live in the state store of checkpoint; nothing is kept in the driver."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return toggle_state(events, key).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).start()


def latest(spark: SparkSession, path: str, key: str = "user_id") -> DataFrame:
    """The state that a running fold has written so far: the last row of each key."""
    rows = spark.read.parquet(path).groupBy(key).agg(F.max_by(F.struct("n", "is_set"), "batch").alias("s"))
    return rows.select(key, "s.n", "s.is_set")
