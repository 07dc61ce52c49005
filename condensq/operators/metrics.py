"""Evaluation of scored rows (label, prob): counts, curves, areas, calibration, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condensq.operators.ranking import running_totals, with_range_bucket


def _safe(num: Column, den: Column) -> Column:
    """num/den with 0 for an empty divisor."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion(
    df: DataFrame, threshold: float = 0.5, by: Sequence[str] = (), label: str = "class",
    prob: str = "prob_pos",
) -> DataFrame:
    """tn, fp, fn, tp at one threshold."""
    hit, pos = F.col(prob) >= threshold, F.col(label) == 1
    return df.groupBy(*by).agg(
        F.count_if(~hit & ~pos).alias("tn"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"),
        F.count_if(hit & pos).alias("tp"),
    )


def confusion_shares(counts: DataFrame) -> DataFrame:
    """Row-normalised and overall shares of the four counts."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    add = {}
    for c in ("tn", "fp", "fn", "tp"):
        row = tn + fp if c in ("tn", "fp") else fn + tp
        add[f"{c}_row"] = _safe(F.col(c), row)
        add[f"{c}_pct"] = _safe(F.col(c) * 100.0, tn + fp + fn + tp)
    return counts.withColumns(add)


def rates(counts: DataFrame) -> DataFrame:
    """F1 of both classes, their mean, precision and recall; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    f1_pos = _safe(2 * tp, 2 * tp + fp + fn)
    f1_neg = _safe(2 * tn, 2 * tn + fp + fn)
    return counts.withColumns(
        {
            "f1_pos": f1_pos,
            "f1_neg": f1_neg,
            "f1_macro": (f1_pos + f1_neg) / 2,
            "precision": _safe(tp, tp + fp),
            "recall": _safe(tp, tp + fn),
            "accuracy": _safe(tp + tn, tp + tn + fp + fn),
        }
    )


def class_metrics(df, threshold=0.5, by=(), label="class", prob="prob_pos") -> DataFrame:
    return rates(confusion(df, threshold, by, label, prob))


def cumulative_counts(
    df: DataFrame, by: Sequence[str] = (), label: str = "class", prob: str = "prob_pos"
) -> DataFrame:
    """Running tp and fp by falling score, one row per distinct score.

    Equal scores are merged first; the running sums then work bucket by bucket.
    """
    by = list(by)
    per = df.groupBy(*by, prob).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    placed = with_range_bucket(per, F.col(prob))
    return running_totals(
        placed, {"tp": F.col("pos"), "fp": F.col("neg")}, [F.col(prob).desc()],
        -F.col("_range"), by,
    ).drop("_range")


def _totals(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg")
    )


def _area_columns() -> dict[str, Column]:
    """AUROC (NULL if a class is absent) and average precision (0 without positives).

    The totals are sums of the same cumulative rows.
    """
    n_pos, n_neg = F.sum("pos"), F.sum("neg")
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    gain = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return {"auroc": F.try_divide(wins, n_pos * n_neg), "auprc": F.coalesce(F.try_divide(gain, n_pos), F.lit(0.0))}


def areas(
    df: DataFrame, by: Sequence[str] = (), label: str = "class", prob: str = "prob_pos"
) -> DataFrame:
    """AUROC (rank form, ties count half) and step-wise average precision."""
    cum = cumulative_counts(df, by, label, prob)
    return cum.groupBy(*by).agg(*[c.alias(n) for n, c in _area_columns().items()])


def auroc(df, by=(), label="class", prob="prob_pos") -> DataFrame:
    return areas(df, by, label, prob).drop("auprc")


def average_precision(df, by=(), label="class", prob="prob_pos") -> DataFrame:
    return areas(df, by, label, prob).drop("auroc")


def roc_points(
    df: DataFrame, by: Sequence[str] = (), label: str = "class", prob: str = "prob_pos"
) -> DataFrame:
    """False and true positive rate at every distinct score; NULL where a class is absent."""
    cum = cumulative_counts(df, by, label, prob)
    tot = _totals(df, by, label)
    cum = cum.join(tot, list(by)) if by else _attach_one(cum, tot)
    return cum.select(
        *by, F.col(prob).alias("threshold"), F.try_divide("fp", "n_neg").alias("fpr"),
        F.try_divide("tp", "n_pos").alias("tpr"),
    )


def pr_points(
    df: DataFrame, by: Sequence[str] = (), label: str = "class", prob: str = "prob_pos"
) -> DataFrame:
    """Precision and recall at every distinct score; without positives the recall is one."""
    cum = cumulative_counts(df, by, label, prob)
    tot = _totals(df, by, label)
    cum = cum.join(tot, list(by)) if by else _attach_one(cum, tot)
    return cum.select(
        *by, F.col(prob).alias("threshold"),
        _safe(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.coalesce(F.try_divide("tp", "n_pos"), F.lit(1.0)).alias("recall"),
    )


def _attach_one(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Columns of a one-row frame as scalar subqueries."""
    return df.withColumns({c: one_row.select(c).scalar() for c in one_row.columns})


def threshold_sweep(
    df: DataFrame, lo: int = 30, hi: int = 70, by: Sequence[str] = (), label: str = "class",
    prob: str = "prob_pos",
) -> DataFrame:
    """All count metrics at thresholds lo/100 .. hi/100.

    Each row falls into the step of the highest threshold it reaches; the few step counts are
    then summed downwards, so the rows are read once and never multiplied.
    """
    by = list(by)
    steps = [i / 100 for i in range(lo, hi + 1)]
    reached = F.size(F.filter(F.array(*map(F.lit, steps)), lambda t: F.col(prob) >= t))
    hist = df.groupBy(*by, reached.alias("reached")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    grid = F.explode(
        F.array(
            *[
                F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold"))
                for i, t in enumerate(steps)
            ]
        )
    )
    # The histogram has one row per step and group; meeting it with the grid stays that small.
    cells = hist.select("*", grid.alias("g")).select(*hist.columns, "g.*")
    over = F.col("reached") >= F.col("i")
    counts = cells.groupBy(*by, "threshold").agg(
        F.sum(F.when(~over, F.col("neg")).otherwise(0)).alias("tn"),
        F.sum(F.when(over, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~over, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(over, F.col("pos")).otherwise(0)).alias("tp"),
    )
    return rates(counts)


def best_threshold(
    curve: DataFrame, by: Sequence[str] = (), min_f1_pos: float | None = None
) -> DataFrame:
    """Threshold of the best macro F1 (lowest on ties); with a floor on the positive F1 also
    the one of the best negative F1 above it, else the former."""
    best = F.max_by("threshold", F.struct("f1_macro", -F.col("threshold")))
    cols = [best.alias("best_threshold"), F.max("f1_macro").alias("best_f1_macro")]
    if min_f1_pos is not None:
        ok = F.when(F.col("f1_pos") >= min_f1_pos, F.struct("f1_neg", -F.col("threshold")))
        cols.append(F.coalesce(F.max_by("threshold", ok), best).alias("constrained_threshold"))
    return curve.groupBy(*by).agg(*cols)


def brier(df, by=(), label="class", prob="prob_pos") -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(prob) - F.col(label)) ** 2).alias("brier"))


def calibration_curve(df, bins: int = 10, by=(), label="class", prob="prob_pos") -> DataFrame:
    """Mean prediction and share of positives in equal-width bins; 1.0 joins the last bin."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(prob).alias("mean_predicted"),
        F.avg(F.col(label).cast("double")).alias("fraction_positive"),
    )


def curated_check(preds: DataFrame, ids: DataFrame, key: str = "gene_id") -> DataFrame:
    """Correct and total on the members of a curated set."""
    hit = (F.col("pred") == F.col("class")).cast("int")
    return preds.join(ids.select(key), key, "left_semi").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(hit), F.lit(0)).alias("n_correct"),
        F.avg(hit.cast("double")).alias("accuracy"),
    )


def curated_misses(preds: DataFrame, ids: DataFrame, key: str = "gene_id") -> DataFrame:
    return preds.join(ids.select(key), key, "left_semi").where("pred <> class")


def metric_table(df: DataFrame, by: Sequence[str], label="class", prob="prob_pos") -> DataFrame:
    """Counts, F1s, AUROC, AUPRC and Brier score per group (run, split, ...).

    Everything follows from the cumulative counts per distinct score, so the rows are read once.
    """
    by = list(by)
    cum = cumulative_counts(df, by, label, prob)
    p, hit = F.col(prob), F.col(prob) >= 0.5
    part = lambda c, keep: F.sum(F.when(keep, F.col(c)).otherwise(0))
    loss = F.sum(F.col("pos") * (1 - p) ** 2 + F.col("neg") * p**2)
    out = cum.groupBy(*by).agg(
        part("neg", ~hit).alias("tn"), part("neg", hit).alias("fp"),
        part("pos", ~hit).alias("fn"), part("pos", hit).alias("tp"),
        *[c.alias(n) for n, c in _area_columns().items()],
        F.try_divide(loss, F.sum(F.col("pos") + F.col("neg"))).alias("brier"),
    )
    return rates(out)


METRICS = ("auroc", "auprc", "f1_macro", "f1_pos", "f1_neg", "brier")


def impact_table(
    before: DataFrame, after: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Before, after and difference per key and metric."""
    keys = list(keys)
    b = before.unpivot(keys, list(metrics), "metric", "before")
    a = after.unpivot(keys, list(metrics), "metric", "after")
    return b.join(a, [*keys, "metric"], "full").withColumn(
        "delta", F.col("after") - F.col("before")
    )


def suspicious_labels(df: DataFrame, lo: float = 0.35, hi: float = 0.50) -> DataFrame:
    """Negatives scored between the bounds."""
    return df.where((F.col("class") == 0) & F.col("prob_pos").between(lo, hi))


def suspicious_share(df: DataFrame, lo: float = 0.35, hi: float = 0.65) -> DataFrame:
    neg = F.col("class") == 0
    hit = F.count_if(neg & F.col("prob_pos").between(lo, hi))
    return df.agg(
        hit.alias("n_ambiguous"),
        F.count_if(neg).alias("n_negatives"),
        F.round(F.try_divide(hit * 100.0, F.count_if(neg)), 1).alias("pct_ambiguous"),
    )


def model_card(preds: DataFrame, curated: DataFrame) -> DataFrame:
    """(fact, value) rows: test confusion, ambiguous negatives, curated accuracy."""
    test = confusion(preds.where("split = 'test'")).unpivot(
        [], ["tn", "fp", "fn", "tp"], "fact", "value"
    )
    share = suspicious_share(preds).unpivot(
        [], ["n_ambiguous", "n_negatives"], "fact", "value"
    )
    check = curated_check(preds, curated).unpivot([], ["n", "n_correct"], "fact", "value")
    check = check.withColumn("fact", F.concat(F.lit("curated_"), "fact"))
    rows = test.unionByName(share).unionByName(check)
    return rows.withColumn("value", F.col("value").cast("long"))


def rank_shift(base: DataFrame, new: DataFrame) -> DataFrame:
    """Rank change per feature (base - new); NEW or DROPPED where one side lacks it."""
    b = base.select("feature", F.col("rank").alias("base_rank"))
    n = new.select("feature", F.col("rank").alias("new_rank"))
    delta = F.col("base_rank") - F.col("new_rank")
    status = (
        F.when(F.col("base_rank").isNull(), "NEW")
        .when(F.col("new_rank").isNull(), "DROPPED")
        .when(delta > 0, "up").when(delta < 0, "down").otherwise("same")
    )
    return b.join(n, "feature", "full").withColumns({"shift": delta, "status": status})

