"""Row-wise arithmetic that keeps missing values missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL are one thing here: NaN becomes NULL in every floating column."""
    floating = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c)
            for c in df.columns
        ]
    )


def to_number(col: Column) -> Column:
    """Lenient number: text that is none gives NULL, and so does NaN."""
    number = F.trim(col.cast("string")).try_cast("double")
    return F.when(~F.isnan(number), number)


def any_ge(cols: list[Column], threshold: float) -> Column:
    """True if any column reaches the threshold; missing counts as no."""
    return reduce(
        lambda a, b: a | b, [F.coalesce(c >= F.lit(threshold), F.lit(False)) for c in cols]
    )


def strongest_abs(cols: list[Column]) -> Column:
    return F.greatest(F.lit(0.0), *[F.abs(c) for c in cols])


def ratio(num: Column, den: Column) -> Column:
    """num/den, NULL where the divisor is 0 or missing."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def cv(mean: Column, std: Column) -> Column:
    return F.when(mean > 0, std / mean)


def pass_rate(n: Column, requested: Column) -> Column:
    return F.when(requested > 0, n / requested).otherwise(F.lit(0.0))


def round_columns(df: DataFrame, digits: dict[str, int], half_even: bool = True) -> DataFrame:
    rounder = F.bround if half_even else F.round
    return df.withColumns({c: rounder(F.col(c), d) for c, d in digits.items()})
