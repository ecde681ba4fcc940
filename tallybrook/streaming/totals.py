"""Structured Streaming: weekly totals and first-seen flags."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.sources.storage import scratch


def weekly(events: DataFrame) -> DataFrame:
    """user_id, week, n and total of value by windows of seven days; rows a week behind the watermark are dropped."""
    g = events.withWatermark("ts", "7 days").groupBy("user_id", F.window("ts", "7 days"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", F.col("window.start").cast("timestamp_ntz").alias("week"), "n", "total")


def weekly_scored(requests: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """page_domain, week, n and est_bytes of requests that are priced as they arrive: score joins the stream with tables."""
    priced = score(requests).withWatermark("ts", "7 days").groupBy("page_domain", F.window("ts", "7 days"))
    return priced.agg(F.count(F.lit(1)).alias("n"), F.sum("est_bytes").alias("est_bytes")).select("page_domain", F.col("window.start").cast("timestamp_ntz").alias("week"), "n", "est_bytes")


def firsts(events: DataFrame, horizon: str = "400 days") -> DataFrame:
    """The first event of each (user_id, event_type) within the horizon; state older than that is forgotten."""
    return events.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type", "ts")


def run_to_end(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Run a query over a Parquet table as a stream until all of it is read; returns what it wrote."""
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a glob, as the table may be one file
    out = scratch(spark, "stream")
    frame = build(source.withColumn("ts", F.col("ts").cast("timestamp")))

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/{'all' if mode == 'complete' else f'epoch={epoch}'}")

    query = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state-{uuid.uuid4().hex}").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    done = spark.read.schema(frame.schema)
    return done.parquet(f"{out}/data/all") if mode == "complete" else done.parquet(f"{out}/data/*")
