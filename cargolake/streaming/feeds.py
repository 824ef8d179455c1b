"""Structured Streaming forms: log replay (S8/S9), idempotent consumption
(T12) and watermarked windowed aggregates (streaming A5, M1-M4, M7).  Workers
that apply micro-batches to stored tables are in ``streaming.workers``.

Sources are file streams here (no Kafka jar in the image); on a cluster the
same plans run on ``readStream.format("kafka")`` with
``startingOffsets=earliest`` and ``kafka.isolation.level=read_committed``.
Checkpoints always live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolake.operators import metrics
from cargolake.session import checkpoint_dir

DEFAULT_WATERMARK = "10 minutes"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def kafka_source(spark: SparkSession, servers: str, topics: list[str]) -> DataFrame:
    """Several topics as one stream, replay from the earliest offset,
    read-committed.  Needs the spark-sql-kafka package on the cluster."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", ",".join(topics)).option("startingOffsets", "earliest")
            .option("kafka.isolation.level", "read_committed").load()
            .select("topic", "partition", "offset", F.col("key").cast("string"), F.col("value").cast("string")))


def replay_files(spark: SparkSession, path: str, schema: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Replay a recorded log (parquet files) as a stream."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def run_available_now(df: DataFrame, sink_path: str, checkpoint: str, output_mode: str = "append") -> None:
    """Drain everything available, exactly-once into a parquet sink."""
    q = (df.writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint)
         .outputMode(output_mode).trigger(availableNow=True).start())
    q.awaitTermination()


def run_upserts(df: DataFrame, sink_path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Drain everything available in update mode; the newest row of each key.

    Each micro-batch overwrites its own folder, so a repeated batch is written
    once.  Unlike append mode this holds the windows that the watermark has
    not passed yet, so the drained result equals the batch result."""
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{sink_path}/part={number}")

    q = (df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination()
    rows = df.sparkSession.read.parquet(sink_path).drop("part")
    newest = F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.col("_batch"))
    return rows.groupBy(*keys).agg(newest.alias("_row")).select("_row.*")


def as_event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP (zone-aware); fixtures are TIMESTAMP_NTZ."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def dedup_stream(events: DataFrame, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """T12 (stream): at-least-once input, each event id kept once; state is
    bounded by the watermark."""
    return as_event_time(events).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def windowed_request_rate(requests: DataFrame, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """M1 (stream): requests per second per service per minute."""
    r = as_event_time(requests).withWatermark("ts", watermark)
    return (r.groupBy("service", F.window("ts", "1 minute"))
            .agg((F.count(F.lit(1)) / F.lit(60.0)).alias("per_second"))
            .select("service", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "per_second"))


def latency_panes_stream(requests: DataFrame, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """M3/M4 (stream): bucket counts per service and minute.  They add up, so sliding windows of any length
    (``metrics.quantiles_of_panes``) need no state of their own."""
    r = as_event_time(requests).withWatermark("ts", watermark)
    return (r.groupBy("service", F.window("ts", "1 minute").alias("window")).agg(*metrics.histogram_aggs(F.col("duration_s")))
            .select("service", F.col("window.start").cast("timestamp_ntz").alias("pane"), *metrics.BUCKET_COLS))


def error_panes_stream(requests: DataFrame, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """M7 (stream): requests and 5xx answers per minute over all services."""
    r = as_event_time(requests).withWatermark("ts", watermark)
    return (r.groupBy(F.window("ts", "1 minute").alias("window"))
            .agg(F.count_if(F.col("status").between(500, 599)).alias("errors"), F.count(F.lit(1)).alias("requests"))
            .select(F.col("window.start").cast("timestamp_ntz").alias("pane"), "errors", "requests"))


def daily_chain_stats_stream(records: DataFrame, watermark: str = "1 day") -> DataFrame:
    """A5 (stream): per (date, network) counts."""
    r = as_event_time(records, "created_at").withWatermark("created_at", watermark)
    st = F.upper(F.trim("status"))
    return (r.groupBy(F.window("created_at", "1 day").alias("day"), "network")
            .agg(F.count(F.lit(1)).alias("total_transactions"),
                 F.count_if(st == "CONFIRMED").cast("bigint").alias("confirmed"),
                 F.count_if(st == "FAILED").cast("bigint").alias("failed"),
                 F.sum("gas_used").cast("bigint").alias("total_gas_used"))
            .select(F.to_date(F.col("day.start")).alias("transaction_date"), "network", "total_transactions",
                    "confirmed", "failed", "total_gas_used"))


def refresh_daily(spark: SparkSession, table_path: str, fresh: DataFrame, date_col: str) -> None:
    """A13 (incremental): rewrite only the dates present in ``fresh`` with
    dynamic partition overwrite; other dates stay untouched."""
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_col).parquet(table_path)


def changed_keys_refresh(current: DataFrame, recomputed_for_keys: DataFrame, key: str) -> DataFrame:
    """A13 (incremental by key): keep rows of unchanged keys, replace the
    rows of the changed keys with their recomputation."""
    keys = recomputed_for_keys.select(key).distinct()
    return current.join(keys, key, "left_anti").unionByName(recomputed_for_keys)
