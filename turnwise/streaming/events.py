"""Structured Streaming over the event log.

Every query here reads the table as a stream with the `availableNow` trigger, runs the same
transformations that the batch form runs, and writes Parquet through a checkpoint in the
shared folder; its result is the table that the stream wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from turnwise.registry import register
from turnwise.session import shared_dir
from turnwise.sources.tables import table

SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, from a folder of part files or a single file; watermarks need TIMESTAMP."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    source = spark.readStream.schema(SCHEMA)
    source = source.parquet(f"{sf_dir}/events.parquet") if folder else source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return source.withColumn("at", F.col("ts").cast("timestamp"))


def run(df: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream to the end of its input and returns what it wrote; nothing, if there was no input."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/turnwise/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], df.schema).write.parquet(f"{base}/out/batch=-1")
    put = each or (lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}"))
    df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(StructType([*df.schema.fields, StructField("batch", IntegerType())])).parquet(f"{base}/out").drop("batch")


def newest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of a complete- or update-mode result the last state of each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("_s")).select(*keys, "_s.*")


@register("st01_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st01_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by hour; the last state of each window is kept."""
    w = stream(spark, sf_dir).withWatermark("at", "1 day").groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    out = run(w.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n"), "update")
    return newest(out, ["hour", "event_type"], "n")


@register("st02_cursor_read", "SELECT event_id, event_type FROM events WHERE event_id > 500 AND event_type IN ('click', 'purchase') ORDER BY event_id LIMIT 100")
def st02_cursor_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the feed after a cursor (100 entries)."""
    return table(spark, sf_dir, "events").where((F.col("event_id") > 500) & F.col("event_type").isin("click", "purchase")).orderBy("event_id").limit(100).select("event_id", "event_type")


@register("st05_idempotent", "SELECT DISTINCT user_id, event_type FROM events")
def st05_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At-least-once delivery: a completion key counts once."""
    return run(stream(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]))


@register("st06_late_versions", "SELECT user_id, max(event_id) AS version, max_by(event_type, event_id) AS state FROM events GROUP BY 1")
def st06_late_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older or equal versions change nothing."""
    kept = stream(spark, sf_dir).groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("m")).select("user_id", F.col("m.event_id").alias("version"), F.col("m.event_type").alias("state"))
    return newest(run(kept, "update"), ["user_id"], "version")


@register("st10_projection", "SELECT user_id, count(*) AS entries, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY 1")
def st10_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read model that the stream keeps up to date."""
    kept = stream(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("entries"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))
    return newest(run(kept, "update"), ["user_id"], "entries")
