"""Queries of the catalogue that run as streams over all events, each with the same result in DuckDB's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.plans.catalogue import ORACLES, query, r6
from gradeloom.sources.session import table
from gradeloom.sources.shared import shared_folder
from gradeloom.streaming import pipelines


def _stream(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """The events as a stream, and a folder of its own for tables and checkpoints."""
    schema = table(spark, sf, "events").schema
    source = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/events.parquet")
    folder = source.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(source).isDirectory()
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(f"{sf}/events.parquet") if folder else reader.option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query(ORACLES["checkpoint_latest"])
def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The latest event of each user by a stream of upserts into buckets; the same rows as ``checkpoint_latest``."""
    stream, base = _stream(spark, sf)
    pipelines.upsert_sink(stream, f"{base}/table", f"{base}/checkpoint", ["user_id"], ["ts", "event_id"]).awaitTermination()
    out = pipelines.version(spark, f"{base}/table")
    return (out if out is not None else spark.createDataFrame([], stream.schema)).select("user_id", "event_id", "event_type", "value")


@query(
    """
SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 20 OR row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 5 AS budget_violation FROM events"""
)
def stream_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Users as episodes, types of events as tools: calls beyond 20, or 5 of a tool, by counters in a stream's state."""
    stream, base = _stream(spark, sf)
    marked = pipelines.budget_stream(stream, "user_id", "event_type", "event_id", 20, 5, "ts", "1000 days")
    pipelines.append_sink(marked, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(marked.schema).parquet(f"{base}/table").select("user_id", "event_id", "event_type", "budget_violation")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def stream_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Running count, total and mean of each type of event, as they stand when all events are in."""
    stream, base = _stream(spark, sf)
    live = pipelines.live_summary(stream, "event_type", "value")
    pipelines.whole_sink(live, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(live.schema).parquet(f"{base}/table").select("event_type", "n", F.round("total", 4).alias("total"), r6("mean").alias("mean"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_once(spark: SparkSession, sf: str) -> DataFrame:
    """Each user and type once, though the stream is started a second time on the same checkpoint."""
    stream, base = _stream(spark, sf)
    first = pipelines.once(stream.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id", "event_type"], "ts", "1000 days").select("user_id", "event_type")
    for _ in range(2):
        pipelines.append_sink(first, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(first.schema).parquet(f"{base}/table").select("user_id", "event_type")
