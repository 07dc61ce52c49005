"""Each request once, with bounded state and nothing lost unseen.

`dropDuplicates` keeps every id for good, and with a watermark rows that come too late vanish. Here
an id is remembered until a timer of its own fires, and each row of the input comes out with what
became of it, late ones included.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

KEPT, DUPLICATE, LATE = "kept", "duplicate", "late"

#: Timers and several state variables need this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(moment: datetime | None) -> int | None:
    if moment is None:
        return None
    if moment.tzinfo is None:
        moment = moment.astimezone(timezone.utc)
    return int(moment.timestamp() * 1000)


class OncePerKey(StatefulProcessor):
    """State of one id: until when it counts as seen. A timer at that moment clears it."""

    def __init__(self, ts: str, delay_ms: int) -> None:
        self.ts, self.delay = ts, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        known = self.seen.exists()
        found = [(_millis(r[self.ts]), r) for r in rows]
        for at, row in sorted(found, key=lambda x: (x[0] is None, x[0] or 0)):
            if known:
                outcome = DUPLICATE
            elif at is not None and at <= passed:
                outcome = LATE
            else:
                outcome, known = KEPT, True
                until = max(passed if at is None else at, passed, 0) + self.delay
                self.seen.update((until,))
                self.handle.registerTimer(until)
            yield Row(**row.asDict(), outcome=outcome)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def _length_ms(spark: SparkSession, delay: str) -> int:
    """Milliseconds of a duration such as `10 minutes`."""
    return int(spark.sql(f"SELECT interval {delay}").first()[0].total_seconds() * 1000)


def once_per_key(
    stream: DataFrame, key: str = "request_id", ts: str = "ts", delay: str = "1 hour"
) -> DataFrame:
    """The rows of the stream with `outcome`: `kept` for the first of an id, `duplicate` for others
    while the id is known, `late` for unknown ids older than the watermark (newest `ts` less
    `delay`), which may or may not have been seen before.

    An id is known until the watermark passes its `ts` plus `delay`; a repeat that comes later than
    that and is not late itself counts as new. Rows without a `ts` are never late; rows without an
    id are one id. Of several rows of an id in a micro-batch the oldest is kept.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # Spark drops late rows before stateful operators that read a watermarked column. So the
    # watermark is moved by a branch of its own, of which no row is left.
    clock = stream.withWatermark(ts, delay).where(F.col(ts).isNull() & F.col(ts).isNotNull())
    rows = stream.unionByName(clock)
    out = T.StructType([*stream.schema.fields, T.StructField("outcome", T.StringType())])
    return rows.groupBy(key).transformWithState(
        OncePerKey(ts, _length_ms(spark, delay)), out, "Append", "EventTime"
    )


def write_outcomes(
    outcomes: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Rows by micro-batch and outcome; a batch that runs again overwrites itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("outcome").parquet(f"{path}/batch={number}")

    writer = outcomes.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(save).start()


def read_outcomes(outcomes: DataFrame, path: str) -> DataFrame:
    """What `write_outcomes` wrote of `outcomes`, with the number of the micro-batch as `batch`."""
    schema = outcomes.schema.add("batch", T.LongType())
    return outcomes.sparkSession.read.schema(schema).parquet(path)
