"""Star tables and reporting marts built from stage outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condensq.functions.labels import confidence, label_text, short_name
from condensq.functions.numeric import round_columns
from condensq.operators.explain import attribution_columns
from condensq.operators.ranking import first_per_key, running_totals, with_range_bucket
from condensq.operators.tables import enrich
from condensq.schemas import STAR_FEATURES


def build_genes(isoforms: DataFrame, tiers: DataFrame, splits: DataFrame, ord_col: str):
    """One row per gene; the first of several isoform rows counts."""
    base = first_per_key(isoforms, ["gene_id"], [ord_col]).select(
        "gene_id", "transcript_id", short_name(F.col("description_prot")).alias("gene_name"),
        F.col("class").cast("int").alias("class"), "condition",
    )
    out = enrich(base, first_per_key(tiers.select("gene_id", "tier"), ["gene_id"], ["tier"]), "gene_id")
    return enrich(
        out, first_per_key(splits.select("gene_id", "split"), ["gene_id"], ["split"]), "gene_id"
    )


def build_features(
    matrix: DataFrame, ord_col: str, cols: Sequence[str] = STAR_FEATURES
) -> tuple[DataFrame, list[str]]:
    """(features table, wanted columns the matrix lacks)."""
    have = [c for c in cols if c in matrix.columns]
    one = first_per_key(matrix.select("gene_id", ord_col, *have), ["gene_id"], [ord_col])
    return one.select("gene_id", *have), [c for c in cols if c not in have]


def build_predictions(preds: DataFrame, attrs: DataFrame, ord_col: str = "row_id") -> DataFrame:
    """Scores with the stored attribution columns, joined on the explicit row id."""
    ids = preds.select("gene_id", ord_col, "prob_pos", "pred")
    wide = attribution_columns(ids, attrs, ord_col)
    return first_per_key(wide, ["gene_id"], [ord_col]).drop(ord_col)


LANDSCAPE_FEATURES = [
    "utr3_au_content", "rrach_count", "rrach_per_kb", "mrna_length", "cds_length", "utr3_length",
    "idr_percent", "rmsf_mean", "rmsf_nterm50", "rmsf_nterm_cterm_ratio", "di_CG", "di_UA",
    "mfe_per_nt",
]


def landscape(preds: DataFrame, matrix: DataFrame, ord_col: str | None = None) -> DataFrame:
    """Predictions beside their main features, with confidence and class names, rounded."""
    feats = [c for c in LANDSCAPE_FEATURES if c in matrix.columns]
    side = matrix.select("gene_id", *feats, *([ord_col] if ord_col else []))
    if ord_col:
        side = first_per_key(side, ["gene_id"], [ord_col]).drop(ord_col)
    # Names used by the reports.
    names = ("High (≥0.75)", "Medium (0.55–0.75)", "Low (<0.55)")
    classes = ("P-body enriched", "Not enriched")
    # Fixed values end.
    known = F.when(F.col("class").isin(0, 1), label_text(F.col("class"), *classes))
    out = preds.join(side, "gene_id", "left").withColumns(
        {"confidence": confidence(F.col("prob_pos"), names=names), "class_label": known}
    )
    doubles = {c: 5 for c, t in out.dtypes if t == "double"}
    return round_columns(out, doubles)


def feature_vs_prob(matrix: DataFrame, preds: DataFrame, feature: str) -> DataFrame:
    """(gene, class, feature value, score) for the rows that have a score."""
    scores = preds.select("gene_id", "prob_pos").where("prob_pos IS NOT NULL")
    return matrix.select("gene_id", "class", feature).join(scores, "gene_id")


def population_context(df: DataFrame, cols: Sequence[str], key: str = "gene_id") -> DataFrame:
    """Share of each class that lies below a row's value, per feature.

    Distinct values with class counts are summed in bucketed order and joined back, so every row
    can be asked about at once.
    """
    long = df.select(key, "class", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [key, "class"], list(cols), "feature", "value"
    ).where("value IS NOT NULL")
    per = long.groupBy("feature", "value").agg(
        F.count_if(F.col("class") == 1).alias("pos"), F.count_if(F.col("class") == 0).alias("neg")
    )
    # Cut points come from all features together; each feature uses its part of the scale.
    cum = running_totals(
        with_range_bucket(per, F.col("value")),
        {"pos_upto": F.col("pos"), "neg_upto": F.col("neg")}, [F.col("value")],
        F.col("_range"), ["feature"],
    )
    totals = per.groupBy("feature").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    below = cum.join(F.broadcast(totals), "feature").select(  # one row per feature
        "feature", "value",
        F.try_divide(F.col("pos_upto") - F.col("pos"), F.col("n_pos")).alias("below_pos"),
        F.try_divide(F.col("neg_upto") - F.col("neg"), F.col("n_neg")).alias("below_neg"),
    )
    return long.select(key, "feature", "value").join(below, ["feature", "value"])

