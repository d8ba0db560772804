"""Incremental facts from a folder of event files.

Every micro-batch is reduced to one row a key before it meets the state, and the state is
Spark's own: a watermark bounds what late events can still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, schema: str | T.StructType = EVENT, files: int = 100) -> DataFrame:
    """A stream of Parquet event files, at most `files` new ones a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by type in tumbling windows; later events than `late` are dropped."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return rows.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def deduplicated(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events once by id, among those within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def keep_latest(events: DataFrame, folder: str, checkpoint: str):
    """Keep the newest event of each user as Parquet under folder/batch=N; a batch reads the
    last state before it that is there, merges, and writes the next one, so a repeated batch
    gives the same files and older states may be removed."""
    spark = events.sparkSession

    def last_before(number: int) -> int | None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        known = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
        return max((n for n in known if n < number), default=None)

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select("user_id", "event_id", "ts", "event_type", "value")
        before = last_before(number)
        if before is not None:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{folder}/batch={before}"))
        newest = rows.groupBy("user_id").agg(F.max_by(F.struct("event_id", "ts", "event_type", "value"), F.struct("ts", "event_id")).alias("r"))
        newest.select("user_id", "r.*").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
