"""Structured Streaming over event files: windows with watermarks, deduplication, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.scratch import shared_dir


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of one Parquet table; its schema is that of the files there now."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def written(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a bounded stream gives, as Parquet files below spark.checkpoint.dir; nothing passes through the driver.

    In complete mode each batch replaces the table, so what is read is the last one.
    """
    spark = stream.sparkSession
    folder = shared_dir(spark)
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows")  # what is read if no batch comes
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        out = out.format("parquet").option("path", f"{folder}/rows")
    else:
        out = out.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{folder}/rows"))
    out.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """(user_id, start, n): runs of a user's events with less than gap between one and the next."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def layer_counts(events: DataFrame) -> DataFrame:
    """(event_type, n, total): running counts of a trace by type."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def envelopes(events: DataFrame) -> DataFrame:
    """(event_id, type, sender_kind, sender_id, trace_id, body): events as the bus carries them; a trace is a user's session."""
    session = F.concat(F.lit("s"), F.col("user_id"))
    return events.select("event_id", F.lit("event").alias("type"), F.lit("agent").alias("sender_kind"), F.concat(F.lit("u"), F.col("user_id")).alias("sender_id"), F.md5(session).alias("trace_id"), F.col("event_type").alias("body"))
