"""Scoring of a stream of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from condensq.operators.models import Bundle, score_batch


def stream_scores(
    stream: DataFrame, bundle: Bundle, delay: str | None = None, explain: bool = True
) -> DataFrame:
    """Scored rows of a request stream; a request id counts once.

    Without `delay` ids are kept for good, and no request is lost whatever its time or order. With
    it ids are kept that long after their `ts`, and rows later than that are dropped.
    """
    if delay:
        once = stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id"])
    else:
        once = stream.dropDuplicates(["request_id"])
    return score_batch(once, bundle, explain)


def write_stream(
    df: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Parquet sink; with its checkpoint every row is written exactly once."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start(path)
