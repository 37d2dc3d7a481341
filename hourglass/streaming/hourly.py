"""Hourly statistics under Structured Streaming (A1 on an unbounded event source).

The same aggregate as :func:`hourglass.operators.aggregates.hourly_stats`,
keyed by absolute event-time hour windows.  The stream runs in ``update``
mode; a live source should be given a ``watermark`` so that the state store
drops closed hours (later events are then dropped too), while a bounded drain
of stored files, whose order says nothing about event time, has none and loses
no event.  Every micro-batch appends only the groups it changed (tagged with its
batch id) to a Parquet table in the shared checkpoint folder.  The current
result is the latest version of each group -- a distributed
``first_per_key`` over that table, never a collect to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourglass.functions.columns import EPOCH_NTZ
from hourglass.operators.timeline import first_per_key
from hourglass.session import scratch_path

EVENT_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                "value double, props string")
KEYS = ("user_id", "hour", "event_type")


def hourly_stats_streaming(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Streaming DataFrame of (user_id, hour, event_type) -> mean / count / std."""
    # Streaming event time must be TIMESTAMP; read the NTZ wall clock as a UTC
    # instant (micros since epoch) so windows do not depend on the session zone.
    micros = F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), F.col("ts"))
    src = events.withColumn("__et", F.timestamp_micros(micros))
    if watermark:
        src = src.withWatermark("__et", watermark)
    agg = (src.groupBy("user_id", F.window("__et", "1 hour").alias("w"), "event_type")
           .agg(F.avg("value").alias("MEAN"), F.count("value").alias("COUNT"),
                F.stddev_samp("value").alias("STDDEV")))
    return agg.select("user_id", F.timestamp_add("MICROSECOND", F.unix_micros(F.col("w.start")), F.expr(EPOCH_NTZ)).alias("hour"), "event_type",
                      "MEAN", "COUNT", "STDDEV")


def run_to_table(stream: DataFrame, out_path: str, checkpoint: str) -> None:
    """Drain the available input: each micro-batch appends its updated groups with its batch id."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("__batch", F.lit(batch_id)).write.mode("append").parquet(out_path)

    q = (stream.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_groups(spark: SparkSession, out_path: str) -> DataFrame:
    """Latest version of every group written by :func:`run_to_table`."""
    t = spark.read.parquet(out_path).withColumn("__neg_batch", -F.col("__batch"))
    return first_per_key(t, list(KEYS), ["__neg_batch"]).drop("__batch", "__neg_batch")


def hourly_stats_stream(spark: SparkSession, sf_dir: str, table: str = "events",
                        watermark: str | None = None, files_per_trigger: int = 64) -> DataFrame:
    """Stream the event files through the hourly aggregate; return the final group values."""
    stream = (spark.readStream.schema(EVENT_SCHEMA)
              .option("maxFilesPerTrigger", files_per_trigger)
              # a pattern, not a plain path: the stream reader takes only those for a file as well as a folder
              .parquet(f"{sf_dir.rstrip('/')}/{table}.parque[t]"))
    out = scratch_path(spark, "hourly-stream")
    run_to_table(hourly_stats_streaming(stream, watermark), out, scratch_path(spark, "hourly-stream-ckpt"))
    return latest_groups(spark, out)
