"""Score series in long form (key, pos, value), positions 1, 2, ... without gaps.

A key may be arbitrarily long: every operator works on fixed-size chunks of positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensq.operators.ranking import row_numbers, running_totals

CHUNK = 4096


def _chunk(pos: str, size: int) -> Column:
    return F.floor((F.col(pos) - 1) / size)


def number_rows(
    df: DataFrame, key: str, order: Sequence[str], bucket: Column, pos: str = "pos"
) -> DataFrame:
    """Give each row of a key its position; `bucket` must rise with `order`."""
    return row_numbers(df, [F.col(c) for c in order], bucket, [key], pos)


def to_long(df: DataFrame, key: str, scores: str) -> DataFrame:
    """One row per array element."""
    return df.select(key, F.posexplode(scores).alias("pos", "value")).withColumn(
        "pos", F.col("pos") + 1
    )


def sliding_max(
    df: DataFrame, key: str, width: int = 20, pos: str = "pos", value: str = "value",
    chunk: int = CHUNK,
) -> DataFrame:
    """Largest mean of `width` neighbours per key, the plain mean for shorter keys."""
    if chunk < width:
        raise ValueError("chunk must be at least as long as the window")
    own = _chunk(pos, chunk)
    last_rows = F.pmod(F.col(pos) - 1, F.lit(chunk)) >= chunk - width + 1
    # The tail of a chunk is copied into the next one, so windows never cross a chunk.
    spread = df.select(
        key, pos, value, own.alias("_own"),
        F.explode(
            F.when(last_rows, F.array(own, own + 1)).otherwise(F.array(own))
        ).alias("_chunk"),
    )
    frame = Window.partitionBy(key, "_chunk").orderBy(pos).rowsBetween(-(width - 1), 0)
    means = spread.withColumn("_mean", F.avg(value).over(frame)).where("_own = _chunk")
    return means.groupBy(key).agg(
        F.coalesce(F.max(F.when(F.col(pos) >= width, F.col("_mean"))), F.avg(value)).alias(
            "max_window_mean"
        )
    )


def runs_above(
    df: DataFrame, key: str, threshold: float, pos: str = "pos", value: str = "value",
    chunk: int = CHUNK,
) -> DataFrame:
    """Number and greatest length of the contiguous runs above a threshold, per key."""
    flagged = df.select(
        key, pos, F.coalesce(F.col(value) > threshold, F.lit(False)).alias("_above")
    )
    counted = running_totals(
        flagged, {"_upto": F.col("_above").cast("long")}, [F.col(pos)], _chunk(pos, chunk), [key]
    )
    # Within a run the position and the running count rise together.
    island = F.when(F.col("_above"), F.col(pos) - F.col("_upto"))
    runs = counted.groupBy(key, island.alias("_island")).agg(F.count(F.lit(1)).alias("_n"))
    return runs.groupBy(key).agg(
        F.count("_island").alias("n_runs"),
        F.coalesce(F.max(F.when(F.col("_island").isNotNull(), F.col("_n"))), F.lit(0)).alias(
            "longest_run"
        ),
    )
