"""Group summaries, all built on map-side combinable aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensq.operators.ranking import exact_quantiles


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col(col))
    return out if n is None else out.limit(n)


def contingency(df: DataFrame, row: str, col: str, values: Sequence | None = None) -> DataFrame:
    """Two-key counts. Give `values` to spare the extra pass that finds them."""
    grouped = df.groupBy(row).pivot(col, list(values) if values else None)
    out = grouped.agg(F.count(F.lit(1)))
    return out.na.fill(0, [c for c in out.columns if c != row])


def overview(genes: DataFrame, features: DataFrame, predictions: DataFrame) -> DataFrame:
    one = F.lit(1)
    n_f = features.agg(F.count(one)).scalar()
    n_p = predictions.agg(F.count(one)).scalar()
    return genes.agg(
        F.count(one).alias("n_genes"),
        F.sum("class").alias("n_positives"),
        (F.count(one) - F.sum("class")).alias("n_negatives"),
    ).select(
        "n_genes", n_f.alias("n_features_rows"), n_p.alias("n_predictions"), "n_positives",
        "n_negatives",
    )


def group_accuracy(df: DataFrame, by: str, means: dict[str, tuple[str, int]]) -> DataFrame:
    hit = F.when(F.col("pred") == F.col("class"), 1.0).otherwise(0.0)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_genes"),
        F.sum("class").alias("n_positives"),
        F.round(F.avg(hit), 3).alias("accuracy"),
        *[F.round(F.avg(c), d).alias(name) for name, (c, d) in means.items()],
    )


def coverage(df: DataFrame, col: str, value: str) -> DataFrame:
    present = F.col(col).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("total_genes"),
        F.count(col).alias("with_shap"),
        F.round(F.count(col) * 100.0 / F.count(F.lit(1)), 1).alias("shap_pct"),
        F.round(F.avg(F.when(present, F.col(value))), 3).alias("mean_prob_with_shap"),
        F.round(F.avg(F.when(~present, F.col(value))), 3).alias("mean_prob_no_shap"),
    )


def summarise_columns(
    df: DataFrame, cols: Sequence[str], stats: Callable[[Column], dict[str, Column]], by=()
) -> DataFrame:
    """One row per (by, feature) with the given statistics.

    All columns are summed side by side in one aggregate; only its small result is turned long.
    """
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            *[s.alias(n) for n, s in stats(F.col(c).cast("double")).items()],
        )
        for c in cols
    ]
    wide = df.groupBy(*by).agg(F.array(*entries).alias("_s"))
    return wide.select(*by, F.explode("_s").alias("_s")).select(*by, "_s.*")


def describe_by(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """n, median, mean, sample deviation, min, max per group and column."""
    by = list(by)
    stats = summarise_columns(
        df, cols,
        lambda v: {"n": F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v),
                   "max": F.max(v)},
        by,
    )
    keys = [*by, "feature"]
    med = exact_quantiles(df, cols, by=by).select(
        *[F.col(c).alias(f"_{c}") for c in keys], F.col("quantile").alias("median")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return stats.join(med, same, "left").drop(*[f"_{c}" for c in keys])


def class_separation(df: DataFrame, cols: Sequence[str], label: str = "class") -> DataFrame:
    """Mean per class and their ratio per feature; infinite when only the divisor is 0."""
    out = summarise_columns(
        df, cols,
        lambda v: {"mean_pos": F.avg(F.when(F.col(label) == 1, v)),
                   "mean_neg": F.avg(F.when(F.col(label) == 0, v))},
    )
    ratio = F.when(F.col("mean_neg") == 0, F.lit(float("inf"))).otherwise(
        F.try_divide("mean_pos", "mean_neg")
    )
    return out.withColumn("ratio", ratio)


def column_digest(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """min, median, max and missing count per column."""
    stats = summarise_columns(
        df, cols,
        lambda v: {"min": F.min(v), "max": F.max(v), "n_missing": F.count_if(v.isNull())},
    )
    med = exact_quantiles(df, cols).select("feature", F.col("quantile").alias("median"))
    return stats.join(med, "feature", "left")


def distinct_count(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    agg = F.approx_count_distinct(col) if approx else F.count_distinct(col)
    return df.agg(agg.alias(f"n_{col}"))


def majority_class(df: DataFrame, cluster: str, label: str, ord_col: str) -> DataFrame:
    """Most frequent label per cluster; equal counts go to the label seen first."""
    per = df.groupBy(cluster, label).agg(
        F.count(F.lit(1)).alias("_n"), F.min(ord_col).alias("_first")
    )
    return per.groupBy(cluster).agg(
        F.min_by(label, F.struct(-F.col("_n"), "_first")).alias("majority_class"),
        F.sum("_n").alias("n_members"),
    )


def budget_total(df: DataFrame, tier: str = "tier", budget: str = "n_conf") -> DataFrame:
    return df.agg(
        F.coalesce(F.sum(F.when(F.col(tier) > 1, F.col(budget))), F.lit(0)).alias("total_samples")
    )


def share_of_total(df: DataFrame, col: str, name: str, digits: int = 3) -> DataFrame:
    """Percentage of the column total."""
    total = df.agg(F.sum(col).alias("t")).scalar()
    return df.withColumn(name, F.round(F.col(col) / total * 100, digits))


def class_weights(df: DataFrame, label: str = "class", mode: str = "balanced") -> DataFrame:
    """`n/(k*n_c)` per class, or 1 and neg/pos; one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    everything = Window.partitionBy()  # two classes, two rows
    if mode == "balanced":
        weight = F.sum("n_c").over(everything) / (F.count("n_c").over(everything) * F.col("n_c"))
    else:
        neg = F.sum(F.when(F.col(label) == 0, F.col("n_c"))).over(everything)
        weight = F.when(F.col(label) == 1, neg / F.col("n_c")).otherwise(F.lit(1.0))
    return counts.withColumn("weight", weight)


def state_summary(work: DataFrame, state: DataFrame, key: str = "key") -> DataFrame:
    """Completed, failed and pending tasks per tier with the mean run time of completed ones."""
    joined = work.join(state.select(key, "status", "runtime_sec"), key, "left")
    is_ = lambda s: F.coalesce(F.col("status") == s, F.lit(False))
    return joined.groupBy("tier").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.count_if(is_("completed")).alias("n_completed"),
        F.count_if(is_("failed")).alias("n_failed"),
        F.count_if(~is_("completed")).alias("n_pending"),
        F.avg(F.when(is_("completed"), F.col("runtime_sec"))).alias("mean_runtime"),
    )


def corpus_manifest(chunks: DataFrame, source: str = "source") -> DataFrame:
    return chunks.groupBy(source).agg(F.count(F.lit(1)).alias("n_chunks"))


def weighted(df: DataFrame, weights: DataFrame, label: str = "class") -> DataFrame:
    """Attach the per-class weight; only the two classes of a binary label are kept."""
    two = weights.where(F.col(label).isin(0, 1)).select(label, "weight")
    return df.join(F.broadcast(two), label)


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, one pass, long form."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).agg(
        F.array(
            *[
                F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r"))
                for a, b in pairs
            ]
        ).alias("m")
    )
    return wide.select(F.explode("m").alias("m")).select("m.*")

