"""Ratings as a stream: an extension for rating sheets that arrive as files and events that arrive late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from joinery.functions.scalars import reviewer_of
from joinery.operators.ratings import latest
from joinery.sources.files import RATINGS

KEYS = ["reviewer", "model_type", "experiment_id"]


def rating_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """New `*_ratings.csv` files of a folder as a stream of text cells."""
    rows = spark.readStream.schema(RATINGS).option("header", True).option("pathGlobFilter", "*_ratings.csv").option("maxFilesPerTrigger", per_trigger).csv(folder)
    return rows.select("*", F.col("_metadata.file_modification_time").alias("saved_at"), reviewer_of(F.col("_metadata.file_name")).alias("reviewer"))


def versions(spark: SparkSession, table: str) -> list[int]:
    """The complete versions of an upserted table."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("v")]
    return sorted(int(p.getName()[1:]) for p in done if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The latest complete version of an upserted table."""
    done = versions(spark, table)
    return spark.read.parquet(f"{table}/v{done[-1]}") if done else None


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps the last saved row of each (reviewer, model, design) in a table of versions.

    Batch n writes version n from the last complete version before it, so a repeated batch writes the same rows again.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, table) if v < n]
        rows = batch if not before else batch.unionByName(spark.read.parquet(f"{table}/v{before[-1]}"))
        latest(rows, KEYS, ["saved_at"]).write.mode("overwrite").parquet(f"{table}/v{n}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per tumbling window and key; rows later than the watermark are dropped by a streaming run."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if events.isStreaming else rows
    return rows.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", key, "n", "total")
