"""The analytical questions asked of the star schema. `star` is the joined star."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condensq.operators.aggregates import coverage, group_accuracy, overview
from condensq.operators.metrics import suspicious_labels, suspicious_share
from condensq.operators.ranking import quantile_tile, ranked, tile_average
from condensq.operators.tables import contrast_panel, search_name, top_n


def _r(col: str, digits: int, name: str | None = None):
    return F.round(col, digits).alias(name or col)


def q_overview(genes: DataFrame, features: DataFrame, predictions: DataFrame) -> DataFrame:
    return overview(genes, features, predictions)


def q_top(star: DataFrame, n: int = 20) -> DataFrame:
    return top_n(star.where(F.col("class") == 1), "prob_pos", n).select(
        "gene_id", "gene_name", "prob_pos", "rrach_count", _r("idr_percent", 1, "idr_pct"),
        _r("utr3_au_content", 3, "utr3_au"), _r("rmsf_nterm_cterm_ratio", 2, "rmsf_ratio"),
    )


def q_quartiles(star: DataFrame, col: str = "utr3_au_content", mode: str = "exact") -> DataFrame:
    base = star.where(F.col(col).isNotNull()).select("gene_id", "class", col, "prob_pos")
    return quantile_tile(base, col, "gene_id", 4, mode, "quartile").groupBy("quartile").agg(
        F.count(F.lit(1)).alias("n_genes"), F.sum("class").alias("n_positives"),
        F.round(F.avg(col), 3).alias(f"mean_{col}"),
        F.round(F.avg("prob_pos"), 3).alias("mean_prob_pos"),
    )


def q_joint_filter(star: DataFrame, min_ratio: float = 2.0, min_rate: float = 15.0) -> DataFrame:
    ratio, rate = F.col("rmsf_nterm_cterm_ratio"), F.col("rrach_per_kb")
    hit = ratio.isNotNull() & rate.isNotNull() & (ratio > min_ratio) & (rate > min_rate)
    return star.where(hit).select(
        "gene_id", "gene_name", "class", _r("rmsf_nterm_cterm_ratio", 2, "rmsf_ratio"),
        _r("rrach_per_kb", 1), _r("idr_percent", 1, "idr_pct"), _r("prob_pos", 3),
    )


def q_panels(star: DataFrame, hi: float = 0.75, lo: float = 0.25, n: int = 150) -> DataFrame:
    return contrast_panel(star, hi, lo, n)


def q_ambiguous(star: DataFrame, lo: float = 0.35, hi: float = 0.65) -> DataFrame:
    return suspicious_labels(star, lo, hi).select(
        "gene_id", "gene_name", "condition", _r("prob_pos", 3),
        _r("utr3_au_content", 3, "utr3_au"), "rrach_count", _r("idr_percent", 1, "idr_pct"), "tier",
    )


def q_ambiguous_share(star: DataFrame, lo: float = 0.35, hi: float = 0.65) -> DataFrame:
    return suspicious_share(star, lo, hi)


def q_tier_accuracy(star: DataFrame, split: str = "test") -> DataFrame:
    return group_accuracy(
        star.where(F.col("split") == split), "tier",
        {
            "mean_prob": ("prob_pos", 3), "mean_idr_pct": ("idr_percent", 1),
            "mean_rmsf": ("rmsf_mean", 1),
        },
    )


def q_attr_coverage(predictions: DataFrame) -> DataFrame:
    return coverage(predictions, "shap_mrna_length", "prob_pos")


def q_top_importance(importance: DataFrame, n: int = 15) -> DataFrame:
    return importance.select("feature", _r("mean_abs_shap", 4), "rank").orderBy("rank").limit(n)


def q_ranked_panel(
    star: DataFrame, min_prob: float = 0.85, min_count: int = 15, n: int = 50
) -> DataFrame:
    hit = star.where((F.col("prob_pos") > min_prob) & (F.col("rrach_count") > min_count))
    return ranked(hit, [F.desc("prob_pos"), F.col("gene_id")], n).select(
        "gene_id", "prob_pos", "utr3_au_content", "rrach_count", "idr_percent", "rank"
    )


def q_tile_avg(star: DataFrame, col: str = "utr3_au_content") -> DataFrame:
    base = star.select("gene_id", "class", col, "prob_pos")
    tiled = quantile_tile(base, col, "gene_id", 4, "exact", "au_quartile")
    return tile_average(tiled, "au_quartile", "prob_pos", "mean_prob_by_quartile")


def detail(star: DataFrame) -> DataFrame:
    """The 22 columns of the detail page, rounded, for every gene."""
    return star.select(
        "gene_id", "gene_name", "condition", "class", "tier", "split", _r("prob_pos", 4), "pred",
        "mrna_length", "cds_length", "utr3_length", "utr5_length", _r("utr3_au_content", 4),
        "rrach_count", _r("rrach_per_kb", 2), _r("idr_percent", 2), _r("rmsf_mean", 2),
        _r("rmsf_nterm50", 2), _r("rmsf_cterm50", 2),
        _r("rmsf_nterm_cterm_ratio", 3, "rmsf_ratio"), _r("n_residues", 0), _r("mfe_per_nt", 4),
    )


def q_detail(star: DataFrame, gene_id: str) -> DataFrame:
    return detail(star.where(F.col("gene_id") == F.lit(gene_id)))


def q_search(star: DataFrame, term: str) -> DataFrame:
    return search_name(star, term).select(
        "gene_id", "gene_name", "class", _r("prob_pos", 4)
    ).orderBy(F.desc("prob_pos"), "gene_id")


def lookup_sql(spark: SparkSession, gene_id: str, view: str = "predictions") -> DataFrame:
    """Point query with a bound parameter."""
    return spark.sql(
        f"SELECT * FROM {view} WHERE gene_id = :id", args={"id": gene_id.strip().upper()}
    )
