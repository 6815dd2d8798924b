"""Streams of files: artifacts are read again as they arrive, and results are kept current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.scratch import Scratch


def refresh(spark: SparkSession, folder: str, schema, derive: Callable[[DataFrame], None], state: str, pattern: str = "*.json") -> None:
    """Hands every file of a folder that hasn't been seen to derive, a batch at a time, and ends. state holds what was seen, so
    a file that fails is handed over again next time."""
    files = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("multiLine", True).json(folder)
    files.writeStream.foreachBatch(lambda df, _: derive(df)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def by_day(events: DataFrame) -> DataFrame:
    """(day, event_type, n, total) of events (ts, event_type, value), late ones counted for two days."""
    days = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "2 days").groupBy(F.window("at", "1 day"), "event_type")
    return days.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


def daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """by_day over all files that are there, as a stream; each batch's whole result replaces the one before."""
    scratch = Scratch(spark)
    out = f"{scratch.root}/daily"
    folder, _, name = path.rpartition("/")
    is_file = not scratch._fs().getFileStatus(scratch._path(path)).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    stream = reader.option("pathGlobFilter", name).parquet(folder) if is_file else reader.parquet(path)
    done = by_day(stream).writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    done.option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("day timestamp_ntz, event_type string, n long, total double").parquet(out)
