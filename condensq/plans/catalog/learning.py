"""Models on the labelled star: training, calibration, attribution, projection.

Models have the settings of `config.py`. A model is fitted once per application and input, and the
queries that need it share it.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from condensq.config import BoostSettings, ForestSettings
from condensq.operators import explain as X
from condensq.operators import models as L
from condensq.operators.metrics import metric_table
from condensq.operators.monitoring import classification_report
from condensq.operators.tables import feature_columns
from condensq.plans import star as S
from condensq.plans.catalog import query
from condensq.session import cut_lineage, dealt

FOREST = ForestSettings()
BOOST = BoostSettings()
COLS = [
    "mrna_length", "au_content", "gc_content", "di_CG", "di_UA", "utr3_length", "utr3_au_content",
    "rrach_per_kb", "idr_percent", "rmsf_nterm50", "n_residues",
]


def matrix(spark, d):
    """Labelled rows with their features; the label-derived length is no feature."""
    g = S.genes(spark, d).where(F.col("class") >= 0).select("gene_id", "class", "split")
    return g.join(S.features(spark, d).select("gene_id", *COLS), "gene_id")


_FITTED: dict[tuple, object] = {}


def once(spark, d, name, fit):
    """What `fit()` gives, worked out once per application and input: models and small tables."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _FITTED:
        _FITTED[key] = fit()
    return _FITTED[key]


def prepared(spark, d):
    def fill():
        filled, medians = L.imputation_policy(matrix(spark, d), COLS)
        # Trees take long for few bytes: rows keep all slots busy.
        return dealt(cut_lineage(filled)), medians

    return once(spark, d, "prepared", fill)


def forest(spark, d, seed=FOREST.seed):
    """(rows, fitted forest)"""
    df, _ = prepared(spark, d)
    params = replace(FOREST, seed=seed)
    train = df.where("split = 'train'")
    return df, once(spark, d, f"forest-{seed}", lambda: L.fit_forest(train, COLS, params=params))


def leaves(spark, d, seed=FOREST.seed):
    """The forest's leaf table."""
    _, model = forest(spark, d, seed)
    return once(
        spark, d, f"leaves-{seed}",
        lambda: cut_lineage(X.leaf_table(X.node_table(model.stages[-1], spark))),
    )


def calibrated(spark, d):
    """(rows, calibrated forest)"""
    df, _ = prepared(spark, d)
    train = df.where("split = 'train'")
    fit = lambda: L.fit_calibrated(train, COLS, "gene_id", params=FOREST)
    return df, once(spark, d, "calibrated", fit)


@query("imputation_medians", S.STAR_SQL + """, t AS (
  SELECT f.* FROM features f JOIN genes USING (gene_id) WHERE class >= 0 AND split = 'train')
SELECT 'rmsf_nterm50' AS feature, round(median(rmsf_nterm50), 6) AS quantile FROM t
UNION ALL SELECT 'mrna_length', round(median(mrna_length), 6) FROM t
UNION ALL SELECT 'idr_percent', round(median(idr_percent), 6) FROM t""")
def imputation_medians(spark, d):
    from condensq.operators.ranking import exact_quantiles

    train = matrix(spark, d).where("split = 'train'")
    out = exact_quantiles(train, ["rmsf_nterm50", "mrna_length", "idr_percent"])
    return out.select("feature", F.round("quantile", 6).alias("quantile"))


@query("rf_scores")
def rf_scores(spark, d):
    df, model = forest(spark, d)
    return L.score(df, model).select("gene_id", "class", "split", "prob_pos", "pred", "correct")


@query("gbt_scores")
def gbt_scores(spark, d):
    df, _ = L.imputation_policy(matrix(spark, d), COLS, "none")
    cols = feature_columns(df, drop=["is_val"])

    def fit():
        rows = df.where("split <> 'test'").withColumn("is_val", F.col("split") == "val").persist()
        model = L.fit_boosting(rows, cols, params=BOOST)
        rows.unpersist()
        return model

    model = once(spark, d, "boosting", fit)
    return L.score(df, model).select("gene_id", "class", "split", "prob_pos", "pred")


@query("baseline_scores")
def baseline_scores(spark, d):
    """The two-feature forest on mRNA and coding length, which larger models must beat."""
    g = S.genes(spark, d).where(F.col("class") >= 0).select("gene_id", "class", "split")
    rows = g.join(S.features(spark, d).select("gene_id", "mrna_length", "cds_length"), "gene_id")
    filled, _ = L.imputation_policy(rows, ["mrna_length", "cds_length"])
    model = once(
        spark, d, "baseline", lambda: L.fit_baseline(filled.where("split = 'train'"), params=FOREST)
    )
    # Metrics read the scores several times; the forest walks them once.
    return metric_table(cut_lineage(L.score(filled, model)), ["split"])


@query("calibrated_scores")
def calibrated_scores(spark, d):
    df, model = calibrated(spark, d)
    return model.transform(df).select("gene_id", "class", "split", "prob_pos")


@query("class_weight_sweep")
def class_weight_sweep(spark, d):
    df, _ = prepared(spark, d)
    best, results = once(
        spark, d, "sweep",
        lambda: L.sweep_class_weight(
            df.where("split = 'train'"), df.where("split = 'val'"), COLS, params=FOREST
        ),
    )
    return spark.createDataFrame(
        [(k, v, k == best) for k, v in results.items()], "weights string, f1_macro double, best boolean"
    )


def explained(spark, d, seed=FOREST.seed):
    df, model = forest(spark, d, seed)
    return once(
        spark, d, f"explained-{seed}",
        lambda: cut_lineage(
            X.forest_attribution(L.score(df, model), leaves(spark, d, seed), COLS, "gene_id")
        ),
    )


@query("attributions")
def attributions(spark, d):
    return X.attributions_long(explained(spark, d), "gene_id", COLS)


@query("importance_comparison")
def importance_comparison(spark, d):
    """Importance by two forests that differ in their seed."""
    named = {}
    for name, seed in (("first", FOREST.seed), ("second", FOREST.seed + 1)):
        rows = X.attributions_long(explained(spark, d, seed), "gene_id", COLS)
        named[name] = X.global_importance(rows)
    return X.compare_importance(named)


@query("pca_2d")
def pca_2d(spark, d):
    df, _ = prepared(spark, d)
    return L.project_2d(df, COLS).select("gene_id", "class", "pc1", "pc2")


@query("classification_report")
def report(spark, d):
    df = matrix(spark, d)
    _, model = forest(spark, d)
    return classification_report(
        df.where("split = 'train'"), df.where("split = 'test'"), model, COLS
    )


def request_bundle(spark, d) -> L.Bundle:
    """Scoring bundle: the forest on what a sequence alone tells, and one feature it does not."""
    cols = ["mrna_length", "au_content", "di_CG", "utr3_au_content", "rrach_per_kb", "rmsf_nterm50"]

    def fit():
        filled, medians = L.imputation_policy(matrix(spark, d), cols)
        return L.Bundle(L.fit_forest(filled.where("split = 'train'"), cols, params=FOREST), cols, medians)

    return once(spark, d, "bundle", fit)


def requests(spark, d):
    """Every document as a scoring request; some texts hold too few bases."""
    s = S.sequences(spark, d)
    return s.select(
        F.col("doc_id").cast("string").alias("request_id"), "gene_id",
        F.col("seq").alias("mrna_seq"), F.lit(None).cast("string").alias("protein_seq"),
    )


@query("request_scoring")
def request_scoring(spark, d):
    return L.score_batch(requests(spark, d), request_bundle(spark, d))


@query("request_validation", S.with_sql(S.SEQ_SQL) + """
SELECT CASE WHEN length(seq) < 50 THEN 'error' ELSE 'ok' END AS status, count(*) AS n
FROM seqs GROUP BY 1""")
def request_validation(spark, d):
    good, bad = L.validate_requests(requests(spark, d))
    both = good.select(F.lit("ok").alias("status")).unionByName(
        bad.select(F.lit("error").alias("status"))
    )
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
