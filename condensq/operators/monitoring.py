"""Drift, data quality, classification quality and request metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from condensq.operators.aggregates import summarise_columns
from condensq.operators.metrics import metric_table
from condensq.operators.models import fit_medians, impute, score
from condensq.operators.ranking import running_totals
from condensq.session import cut_lineage


def _bounds(long: DataFrame) -> DataFrame:
    return long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def drift(
    ref: DataFrame, cur: DataFrame, cols: Sequence[str], bins: int = 10, threshold: float = 0.1
) -> DataFrame:
    """Jensen-Shannon distance per numeric feature over equal-width bins both sets share."""
    both = [
        df.select(*[F.col(c).cast("double").alias(c) for c in cols])
        .unpivot([], list(cols), "feature", "value")
        .where("value IS NOT NULL")
        .withColumn("side", F.lit(side))
        for df, side in ((ref, "r"), (cur, "c"))
    ]
    long = both[0].unionByName(both[1])
    placed = long.join(F.broadcast(_bounds(long)), "feature")  # one row per feature
    width = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(width * bins), F.lit(bins - 1)))
    hist = placed.groupBy("feature", F.coalesce(b, F.lit(0)).alias("bin")).agg(
        F.count_if(F.col("side") == "r").alias("r"), F.count_if(F.col("side") == "c").alias("c")
    )
    totals = hist.groupBy("feature").agg(F.sum("r").alias("rn"), F.sum("c").alias("cn"))
    shares = hist.join(F.broadcast(totals), "feature").select(
        "feature", (F.col("r") / F.col("rn")).alias("p"), (F.col("c") / F.col("cn")).alias("q")
    )
    m = (F.col("p") + F.col("q")) / 2

    def part(c: str):
        return F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / m)).otherwise(F.lit(0.0))

    js = F.sqrt(F.greatest(F.sum((part("p") + part("q")) / 2), F.lit(0.0)))
    out = shares.groupBy("feature").agg(F.round(js, 6).alias("distance"))
    return out.withColumn("drifted", F.col("distance") >= threshold)


def drift_categorical(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Chi-square of the current category counts against the reference shares."""
    sides = [
        df.select(*[F.col(c).cast("string").alias(c) for c in cols])
        .unpivot([], list(cols), "feature", "category")
        .groupBy("feature", "category")
        .agg(F.count(F.lit(1)).alias(n))
        for df, n in ((ref, "r"), (cur, "c"))
    ]
    same = ["feature", "category"]
    left, right = (
        d.withColumn("category", F.coalesce("category", F.lit("<missing>"))) for d in sides
    )
    counts = left.join(right, same, "full").na.fill(0, ["r", "c"])
    totals = counts.groupBy("feature").agg(F.sum("r").alias("rn"), F.sum("c").alias("cn"))
    cells = counts.join(F.broadcast(totals), "feature")  # one row per feature
    expected = F.col("r") * F.col("cn") / F.col("rn")
    term = F.when(expected > 0, (F.col("c") - expected) ** 2 / expected)
    return cells.groupBy("feature").agg(
        F.round(F.sum(term), 6).alias("chi2"),
        F.count(F.lit(1)).alias("n_categories"),
        F.count_if(F.col("r") == 0).alias("n_new_categories"),
    )


def dataset_drift(per_feature: DataFrame, share: float = 0.5) -> DataFrame:
    """Whole-set verdict from the share of drifted features."""
    part = F.avg(F.col("drifted").cast("double"))
    return per_feature.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count_if("drifted").alias("n_drifted"),
        F.round(part, 4).alias("share_drifted"),
        (part >= share).alias("dataset_drift"),
    )


def quality_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows, missing values, min, max, mean and deviation per column in one pass."""
    return summarise_columns(
        df, cols,
        lambda v: {
            "n": F.count(F.lit(1)), "n_missing": F.count_if(v.isNull()), "min": F.min(v),
            "max": F.max(v), "mean": F.round(F.avg(v), 6), "std": F.round(F.stddev_samp(v), 6),
        },
    )


def duplicate_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Number of rows beyond the first of each distinct combination."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates")
    )


def classification_report(
    ref: DataFrame, cur: DataFrame, model, cols: Sequence[str]
) -> DataFrame:
    """Quality of a model on both sets, missing values filled from the reference."""
    medians = fit_medians(ref, cols)
    both = ref.withColumn("dataset", F.lit("reference")).unionByName(
        cur.withColumn("dataset", F.lit("current")), allowMissingColumns=True
    )
    # Metrics read the scores several times; the model walks them once.
    return metric_table(cut_lineage(score(impute(both, medians), model)), ["dataset"])


def request_metrics(
    events: DataFrame, width: str = "15 seconds", ts: str = "ts", kind: str = "event_type",
    latency: str = "value",
) -> DataFrame:
    """Count, mean and latency quantiles per window and handler; batch or stream."""
    q = F.percentile_approx(latency, [0.5, 0.95, 0.99], 1000)
    return (
        events.groupBy(F.window(ts, width).alias("w"), kind)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(latency).alias("mean_latency"), q.alias("q"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "n",
            "mean_latency", F.get("q", 0).alias("p50"), F.get("q", 1).alias("p95"),
            F.get("q", 2).alias("p99"),
        )
    )


def latency_histogram(
    events: DataFrame, edges: Sequence[float], kind: str = "event_type", latency: str = "value"
) -> DataFrame:
    """Cumulative bucket counts (at most each edge) per handler."""
    return events.groupBy(kind).agg(
        *[F.count_if(F.col(latency) <= e).alias(f"le_{e:g}") for e in edges],
        F.count(F.lit(1)).alias("n"), F.sum(latency).alias("total"),
    )


# Requests in flight ---------------------------------------------------------------------------

def _grid(spans: DataFrame, by: Sequence[str], block: int) -> DataFrame:
    """Every tick from `first` to `last` of each group, made block by block."""
    blocks = F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))
    inside = F.sequence(
        F.greatest("first", F.col("_block") * block),
        F.least("last", F.col("_block") * block + block - 1),
    )
    return spans.withColumn("_block", F.explode(blocks)).select(*by, F.explode(inside).alias("k"))


def in_flight(
    requests: DataFrame, tick: int = 15, by: Sequence[str] = ("event_type",), start: str = "start",
    end: str = "end", block: int = 4096,
) -> DataFrame:
    """(by, tick, n_in_flight, peak): requests under way at each `tick` seconds of the epoch, and the
    most at once since the tick before (after its own instant).

    A sweep line: a request counts from its start, up to but not at its end, so it adds 1 at one
    moment and takes 1 away at another. Changes are summed by moment, then by tick, and carried on
    through blocks of ticks; pairs of requests and ticks never meet. Requests without a start or
    with no length are left out, those without an end stay open. Groups have ticks from their first
    change to their last.
    """
    by = list(by)
    begun, over = F.col(start).cast("timestamp"), F.col(end).cast("timestamp")
    moments = F.array(
        F.struct(F.unix_micros(begun).alias("at"), F.lit(1).alias("d")),
        F.struct(F.unix_micros(over).alias("at"), F.lit(-1).alias("d")),
    )
    real = requests.where(begun.isNotNull() & (over.isNull() | (over > begun)))
    changes = real.select(*by, F.explode(moments).alias("m")).where("m.at IS NOT NULL")
    changes = changes.groupBy(*by, F.col("m.at").alias("at")).agg(F.sum("m.d").alias("d"))
    # The tick at which a change is seen first. A tick has one row a microsecond at most.
    seen = -F.floor(-F.col("at") / (tick * 1_000_000))
    w = Window.partitionBy(*by, "k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    changes = changes.withColumn("k", seen.cast("long")).withColumn("_sum", F.sum("d").over(w))
    ticks = changes.groupBy(*by, "k").agg(F.sum("d").alias("d"), F.max("_sum").alias("top"))
    spans = ticks.groupBy(*by).agg(F.min("k").alias("first"), F.max("k").alias("last"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"g.{c}").eqNullSafe(F.col(f"t.{c}"))
    full = _grid(spans, by, block).alias("g").join(
        ticks.alias("t"), same & (F.col("g.k") == F.col("t.k")), "left"
    ).select(*[f"g.{c}" for c in by], "g.k", F.coalesce("t.d", F.lit(0)).alias("d"), "t.top")
    total = running_totals(full, {"n": F.col("d")}, [F.col("k")], F.floor(F.col("k") / block), by)
    before = F.col("n") - F.col("d")
    return total.select(
        *by, F.timestamp_seconds(F.col("k") * tick).alias("tick"), F.col("n").alias("n_in_flight"),
        F.greatest(before, before + F.coalesce("top", F.lit(0))).alias("peak"),
    )


# Mergeable latency quantiles ------------------------------------------------------------------

def rank_error(k: int) -> float:
    """Rank error of a KLL sketch with parameter k, at 99 % confidence."""
    return 2.296 / k**0.9021


def latency_sketches(
    events: DataFrame, width: str = "15 seconds", ts: str = "ts", kind: str = "event_type",
    latency: str = "value", k: int = 4096,
) -> DataFrame:
    """(window_start, window_end, kind, n, total, sketch) per window and handler; batch or stream.

    The sketch (KLL) keeps what quantiles need: it is exact up to about `k` values and later off by
    `rank_error(k)` of the rank at most, whatever the number of rows, and sketches merge.
    """
    value = F.col(latency).cast("double")
    return (
        events.groupBy(F.window(ts, width).alias("w"), kind)
        .agg(
            F.count(value).alias("n"), F.sum(value).alias("total"),
            F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind,
                "n", "total", "sketch")
    )


def merge_sketches(
    sketches: DataFrame, width: str, by: Sequence[str] = ("event_type",), k: int = 4096
) -> DataFrame:
    """The same for wider windows (hours from minutes, days from hours), from sketches alone. With
    fewer columns in `by` than before, handlers merge as well."""
    return (
        sketches.groupBy(F.window("window_start", width).alias("w"), *by)
        .agg(
            F.sum("n").alias("n"), F.sum("total").alias("total"),
            F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by,
                "n", "total", "sketch")
    )


def sketch_quantiles(
    sketches: DataFrame, probs: Sequence[float] = (0.5, 0.95, 0.99), keep: Sequence[str] = ()
) -> DataFrame:
    """Quantiles of each sketch as columns p50, p95, ...; null where it holds no value."""

    def at(p: float):
        return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p)))

    names = list(keep) or [c for c in sketches.columns if c not in ("sketch", "total")]
    return sketches.select(
        *names, (F.col("total") / F.col("n")).alias("mean_latency"),
        *[at(p).alias(f"p{100 * p:g}".replace(".", "_")) for p in probs],
    )


def share_at_most(sketches: DataFrame, limits: Sequence[float]) -> DataFrame:
    """Share of values up to each limit, from the sketch: the rank of a service-level bound."""
    return sketches.select(
        *[c for c in sketches.columns if c != "sketch"],
        *[F.kll_sketch_get_rank_double("sketch", F.lit(float(x))).alias(f"up_to_{x:g}") for x in limits],
    )
