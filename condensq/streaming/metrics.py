"""Request metrics over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from condensq.operators.monitoring import request_metrics


def stream_request_metrics(
    stream: DataFrame, width: str = "15 seconds", delay: str | None = None, ts: str = "ts",
    kind: str = "event_type", latency: str = "value",
) -> DataFrame:
    """Tumbling-window metrics. Without `delay` every row counts, however late; with it the state of
    closed windows is freed and rows later than that are dropped."""
    timed = stream.withWatermark(ts, delay) if delay else stream
    return request_metrics(timed, width, ts, kind, latency)


def write_updates(
    df: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Changed windows of each micro-batch, under its number: a batch that runs again overwrites
    itself, and open windows are written too."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode("update")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(save).start()


def latest_windows(spark: SparkSession, path: str, keys: tuple[str, ...] = ("window_start", "event_type")) -> DataFrame:
    """The last written state of every window, open ones included."""
    newest = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    rows = spark.read.parquet(path).withColumn("_n", F.row_number().over(newest))
    return rows.filter("_n = 1").drop("_n", "batch")
