"""Order-dependent operators without a single-task window.

A window with few or no partition keys sorts everything in one task. Here rows first get a
bucket that rises with the sort order; windows then run inside a bucket, and the few bucket
totals supply what came before. The results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensq.functions.keys import seeded_digest
from condensq.session import cut_lineage


def _cut_count(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _with_cuts(df: DataFrame, value: Column, buckets: int | None) -> DataFrame:
    """`_cuts`: approximate quantiles of `value`, rising, a scalar subquery read once; `_below`: how
    many of them lie below the value, by binary search (0 for null)."""
    n = buckets or _cut_count(df)
    shares = [i / n for i in range(1, n)]
    cuts = df.agg(F.percentile_approx(value, shares, max(10_000, 10 * n)).alias("cuts")).scalar()
    below = F.aggregate(
        F.lit([1 << k for k in reversed(range(n.bit_length()))]), F.lit(0),
        lambda at, step: F.when(F.get("_cuts", at + step - 1) < value, at + step).otherwise(at),
    )
    return df.withColumn("_cuts", cuts).withColumn("_below", below)


def with_range_bucket(
    df: DataFrame, value: Column, buckets: int | None = None, name: str = "_range"
) -> DataFrame:
    """Add a bucket number rising with `value`."""
    return _with_cuts(df, value, buckets).withColumn(name, F.col("_below")).drop("_cuts", "_below")


def with_tied_bucket(
    df: DataFrame, value: Column, key: Column, buckets: int | None = None, name: str = "_range"
) -> DataFrame:
    """Add a bucket rising with (value, md5(key)).

    A value that holds many rows is itself a cut point; its rows get buckets of their own, split
    by the digest that also breaks the ties, so no value can fill a task.
    """
    is_cut = F.coalesce(F.get("_cuts", F.col("_below")) == value, F.lit(False))
    digest = F.when(is_cut, F.substring(F.md5(key.cast("string")), 1, 2)).otherwise(F.lit(""))
    bucket = F.struct(
        F.col("_below").alias("b"), is_cut.cast("int").alias("t"), digest.alias("d")
    )
    return _with_cuts(df, value, buckets).withColumn(name, bucket).drop("_cuts", "_below")


def digest_bucket(digest: Column, digits: int = 3) -> Column:
    """Bucket of a hex digest: its leading digits rise with it and spread evenly."""
    return F.substring(digest, 1, digits)


def running_totals(
    df: DataFrame,
    totals: dict[str, Column],
    order: Sequence[Column],
    bucket: Column,
    by: Sequence[str] = (),
) -> DataFrame:
    """Add running sums (current row included) along `order` within `by`.

    `bucket` must rise with `order`; `order` must be free of ties.
    """
    by = list(by)
    # One struct key: its hash serves window, totals and join alike, and NULL keys stay a group.
    cell = F.struct(*by, bucket.alias("_bucket"))
    work = df.withColumns({"_cell": cell, **{f"_v_{k}": c for k, c in totals.items()}})
    sums = work.groupBy("_cell").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in totals])
    # One row per bucket of a group, so this window stays small whatever the table size.
    before = (
        Window.partitionBy(*[F.col(f"_cell.{c}") for c in by])
        .orderBy("_cell._bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0)
    offsets = sums.select(
        "_cell", *[F.coalesce(F.sum(f"_s_{k}").over(before), zero).alias(f"_o_{k}") for k in totals]
    )
    local = (
        Window.partitionBy("_cell")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = work.withColumns({f"_l_{k}": F.sum(f"_v_{k}").over(local) for k in totals})
    # Without groups there are only as many offsets as buckets.
    out = out.join(offsets if by else F.broadcast(offsets), "_cell", "left")
    return out.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_l_{k}") + F.coalesce(F.col(f"_o_{k}"), zero)).alias(k) for k in totals],
    )


def row_numbers(
    df: DataFrame,
    order: Sequence[Column],
    bucket: Column,
    by: Sequence[str] = (),
    name: str = "row_number",
) -> DataFrame:
    """1-based position along `order` within `by`."""
    out = running_totals(df, {name: F.lit(1).cast("long")}, order, bucket, by)
    return out


def ranked_by_value(
    df: DataFrame, value: str, key: str, descending: bool = False, name: str = "rank"
) -> DataFrame:
    """Global position by value, ties by md5 of the key."""
    signed = -F.col(value) if descending else F.col(value)
    work = df.withColumn("_signed", signed.cast("double"))
    work = with_tied_bucket(work, F.col("_signed"), F.col(key))
    order = [F.col("_signed"), F.md5(F.col(key).cast("string")), F.col(key)]
    return row_numbers(work, order, F.col("_range"), name=name).drop("_signed", "_range")


def ntile_of(position: Column, total: Column, tiles: int) -> Column:
    """Tile of a 1-based position: the first `total % tiles` tiles hold one row more."""
    size = F.floor(total / tiles).cast("long")
    extra = F.pmod(total, F.lit(tiles)).cast("long")
    in_large = F.floor((position - 1) / (size + 1)) + 1
    in_small = extra + F.floor((position - 1 - extra * (size + 1)) / F.greatest(size, F.lit(1))) + 1
    return F.when(position <= extra * (size + 1), in_large).otherwise(in_small).cast("int")


def quantile_tile(
    df: DataFrame, col: str, key: str, n: int = 4, mode: str = "exact", name: str = "tile"
) -> DataFrame:
    """NTILE(n) along `col`; `mode='approx'` needs no shuffle but gives tiles of near-equal size."""
    if mode == "approx":
        return with_range_bucket(df, F.col(col), n, name).withColumn(name, F.col(name) + 1)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = ranked_by_value(df, col, key, name="_pos").withColumn("_total", total)
    tile = ntile_of(F.col("_pos"), F.col("_total"), n)
    return ranked.withColumn(name, tile).drop("_pos", "_total")


def tile_average(df: DataFrame, tile: str, value: str, name: str) -> DataFrame:
    """Mean of `value` per tile on every row; the few means are joined, not windowed."""
    means = df.groupBy(tile).agg(F.avg(value).alias(name))
    return df.join(F.broadcast(means), tile)  # one row per tile


def seeded_order(
    df: DataFrame, key: str, seed, by: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """Repeatable shuffle: 1-based position in digest order within `by`."""
    work = df.withColumn("_digest", seeded_digest(F.col(key), seed))
    out = row_numbers(
        work, [F.col("_digest"), F.col(key)], digest_bucket(F.col("_digest")), by, name
    )
    return out.drop("_digest")


_LOG_STEPS = 2  # bins a factor of e, in the first round


def _log_bin(v: Column) -> Column:
    """Bin rising with a finite number: its sign and order of magnitude."""
    size = F.floor(F.ln(F.abs(v)) * _LOG_STEPS) + 750 * _LOG_STEPS  # above 0 for the least double
    return F.coalesce(F.signum(v) * size, F.lit(0.0)).cast("int")


def _even_bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    return F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")


def _inside(base: DataFrame, open_: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Rows _g, c, lo, hi, v: values of column number c that lie in an open interval."""
    spans = open_.select("_g", F.struct("c", "lo", "hi").alias("s")).distinct()
    spans = spans.groupBy("_g").agg(F.collect_list("s").alias("_spans"))  # a few for each column
    # Without groups the intervals are one row; with many, their size decides at run time.
    met = base.join(spans if by else F.broadcast(spans), "_g")
    value = F.get(F.array(*cols), F.col("_s.c"))
    return (
        met.withColumn("_s", F.explode("_spans"))
        .select("_g", "_s.c", "_s.lo", "_s.hi", value.alias("v"))
        .where(F.col("v").between(F.col("lo"), F.col("hi")))
    )


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float] = (0.5,),
    by: Sequence[str] = (),
    bins: int = 4096,
    small: int = 10_000,
) -> DataFrame:
    """Interpolated quantiles per column (and group): one row per (by, feature, prob).

    Selection in rounds. A round counts the values of an interval by bin, all columns, groups and
    questions in one pass, and goes on in the one bin that holds the wanted position, from its least
    to its greatest value. The first round's bins are orders of magnitude, the others even parts, so
    a double is found after six rounds at most. Rounds end where one value is left, or at most
    `small` values, which one more pass orders. So no task orders more than `small` values, whatever
    the number of rows or ties; counts are combined before they are shuffled. Null is skipped; the
    order is that of Spark (infinities at the ends, then NaN).
    """
    by, cols = list(by), list(cols)
    group = F.struct(*by, F.lit(0).alias("_all"))
    base = df.select(
        group.alias("_g"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)]
    )
    names = [f"_{i}" for i in range(len(cols))]
    top = F.lit(float("inf"))

    def totals(i: int) -> Column:
        v = F.col(f"_{i}")
        finite = F.when((v < top) & (v > -top), v)
        return F.struct(
            F.lit(i).alias("c"), F.count(v).alias("n"), F.count_if(v == -top).alias("low"),
            F.count(finite).alias("left"), F.count_if(v == top).alias("high"),
            F.min(finite).alias("lo"), F.max(finite).alias("hi"),
        )

    stats = base.groupBy("_g").agg(F.array(*[totals(i) for i in range(len(cols))]).alias("s"))
    stats = stats.select("_g", F.explode("s").alias("s")).select("_g", "s.*").where("n > 0")
    # Both positions of each question; an open one has no value yet.
    asked = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate(probs)])
    exact = (F.col("n") - 1) * F.col("q.p")
    ends = F.array(F.floor(exact), F.ceil(exact))
    state = stats.withColumn("q", F.explode(asked)).select(
        "*", (exact - F.floor(exact)).alias("w"), F.posexplode(ends).alias("e", "pos")
    )
    rest = F.col("pos") - F.col("low")
    value = (
        F.when(rest < 0, -top)
        .when(rest >= F.col("left") + F.col("high"), F.lit(float("nan")))
        .when(rest >= F.col("left"), top)
        .when(F.col("lo") == F.col("hi"), F.col("lo"))
    )
    state = state.select("_g", "c", "q.k", "w", "e", rest.alias("pos"), "left", "lo", "hi",
                         value.alias("value"))
    on = ["_g", "c", "lo", "hi"]
    number = 0
    while True:
        state = cut_lineage(state)
        open_ = state.where("value IS NULL")
        most = open_.agg(F.max("left")).first()[0]
        if most is None or most <= small:
            break
        found = _inside(base, open_, names, by)
        v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
        bin_ = _even_bin(v, lo, hi, bins) if number else _log_bin(v)
        counts = found.groupBy(*on, bin_.alias("bin")).agg(
            F.count(F.lit(1)).alias("b"), F.min("v").alias("_lo"), F.max("v").alias("_hi")
        )
        upto = Window.partitionBy(*on).orderBy("bin")  # a row a bin
        counts = counts.withColumn("_before", F.sum("b").over(upto) - F.col("b"))
        at = F.col("pos") - F.col("_before")
        state = open_.join(counts, on).where((at >= 0) & (at < F.col("b"))).select(
            "_g", "c", "k", "w", "e", at.alias("pos"), F.col("b").alias("left"),
            F.col("_lo").alias("lo"), F.col("_hi").alias("hi"),
            F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("value"),
        ).unionByName(state.where("value IS NOT NULL"))
        number += 1
    if most is not None:
        lists = _inside(base, open_, names, by).groupBy(*on).agg(
            F.sort_array(F.collect_list("v")).alias("_values")  # `small` at most
        )
        last = open_.join(lists, on).withColumn("value", F.get("_values", F.col("pos").cast("int")))
        state = last.drop("_values").unionByName(state.where("value IS NOT NULL"))
    both = state.groupBy("_g", "c", "k", "w").agg(
        F.max(F.when(F.col("e") == 0, F.col("value"))).alias("a"),
        F.max(F.when(F.col("e") == 1, F.col("value"))).alias("b"),
    )
    between = F.col("a") + (F.col("b") - F.col("a")) * F.col("w")
    return both.select(
        *[F.col(f"_g.{c}").alias(c) for c in by],
        F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("c") + 1).alias("feature"),
        F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("k") + 1).alias("prob"),
        F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between).alias("quantile"),
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order, by a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the given order."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def best_per_key(df: DataFrame, keys: Sequence[str], scores: Sequence[Column], ord_col: str):
    """The row of highest lexicographic score per key; equal scores go to the lowest `ord_col`."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*scores, (-F.col(ord_col)).alias("_ord"))
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), rank).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def importance_rank(df: DataFrame, value: str, name: str = "feature") -> DataFrame:
    """1-based rank by falling value. One row per model feature, so a plain window is enough."""
    order = Window.orderBy(F.col(value).desc_nulls_last(), F.col(name))
    return df.withColumn("rank", F.row_number().over(order))


def ranked(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows with their position; only those n rows are ranked."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
