"""Evaluation of stored scores, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from condensq.operators import metrics as M
from condensq.operators import splits as K
from condensq.plans import star as S
from condensq.plans.catalog import query
from condensq.plans.catalog.questions import curated
from condensq.plans.star import SCORED

_CONF = """count(*) FILTER (prob_pos < {t} AND class = 0) AS tn,
  count(*) FILTER (prob_pos >= {t} AND class = 0) AS fp,
  count(*) FILTER (prob_pos < {t} AND class = 1) AS fn,
  count(*) FILTER (prob_pos >= {t} AND class = 1) AS tp"""
_RATES = """
  round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1_pos,
  round(coalesce(2.0::DOUBLE * tn / nullif(2 * tn + fp + fn, 0), 0), 9) AS f1_neg,
  round((coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)
   + coalesce(2.0::DOUBLE * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 9) AS f1_macro,
  round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision,
  round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall,
  round(coalesce((tp + tn)::DOUBLE / nullif(tp + tn + fp + fn, 0), 0), 9) AS accuracy"""
_RATE_COLS = ["f1_pos", "f1_neg", "f1_macro", "precision", "recall", "accuracy"]


def _rounded(df, cols, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("confusion", SCORED + f"SELECT split, {_CONF.format(t='0.5')} FROM scored GROUP BY split")
def confusion(spark, d):
    return M.confusion(S.scored(spark, d), by=["split"])


@query("confusion_shares", SCORED + f""", c AS (SELECT {_CONF.format(t='0.5')} FROM scored)
SELECT *, round(tn::DOUBLE / (tn + fp), 9) AS tn_row, round(fp::DOUBLE / (tn + fp), 9) AS fp_row,
       round(fn::DOUBLE / (fn + tp), 9) AS fn_row, round(tp::DOUBLE / (fn + tp), 9) AS tp_row,
       round(tn * 100.0::DOUBLE / (tn + fp + fn + tp), 9) AS tn_pct,
       round(fp * 100.0::DOUBLE / (tn + fp + fn + tp), 9) AS fp_pct,
       round(fn * 100.0::DOUBLE / (tn + fp + fn + tp), 9) AS fn_pct,
       round(tp * 100.0::DOUBLE / (tn + fp + fn + tp), 9) AS tp_pct FROM c""")
def confusion_shares(spark, d):
    out = M.confusion_shares(M.confusion(S.scored(spark, d)))
    return _rounded(out, [f"{c}_{k}" for c in ("tn", "fp", "fn", "tp") for k in ("row", "pct")])


@query("f1_table", SCORED + f""", c AS (
  SELECT split, {_CONF.format(t='0.5')} FROM scored GROUP BY split)
SELECT split, tn, fp, fn, tp, {_RATES} FROM c""")
def f1_table(spark, d):
    return _rounded(M.class_metrics(S.scored(spark, d), by=["split"]), _RATE_COLS)


_CUM = """, per AS (
  SELECT {by} prob_pos, count(*) FILTER (class = 1) AS pos, count(*) FILTER (class = 0) AS neg
  FROM scored GROUP BY ALL),
cum AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         sum(pos) OVER ({part}) AS np, sum(neg) OVER ({part}) AS nn
  FROM per WINDOW w AS ({part} ORDER BY prob_pos DESC))
"""
_ALL = _CUM.format(by="", part="")
_BY = _CUM.format(by="split,", part="PARTITION BY split")
_AUROC = "round(sum(neg * (tp - pos / 2.0::DOUBLE)) / nullif(max(np) * max(nn), 0), 9)"
_AUPRC = "round(coalesce(sum(pos * tp::DOUBLE / (tp + fp)) / nullif(max(np), 0), 0), 9)"


@query("auroc", SCORED + _BY + f"SELECT split, {_AUROC} AS auroc FROM cum GROUP BY split")
def auroc(spark, d):
    return _rounded(M.auroc(S.scored(spark, d), ["split"]), ["auroc"])


@query("auprc", SCORED + _BY + f"SELECT split, {_AUPRC} AS auprc FROM cum GROUP BY split")
def auprc(spark, d):
    return _rounded(M.average_precision(S.scored(spark, d), ["split"]), ["auprc"])


@query("areas_overall", SCORED + _ALL + f"SELECT {_AUROC} AS auroc, {_AUPRC} AS auprc FROM cum")
def areas_overall(spark, d):
    return _rounded(M.areas(S.scored(spark, d)), ["auroc", "auprc"])


@query("roc_curve", SCORED + _BY + """
SELECT split, prob_pos AS threshold, round(fp::DOUBLE / nullif(nn, 0), 9) AS fpr,
       round(tp::DOUBLE / nullif(np, 0), 9) AS tpr FROM cum""")
def roc_curve(spark, d):
    return _rounded(M.roc_points(S.scored(spark, d), ["split"]), ["fpr", "tpr"])


@query("pr_curve", SCORED + _ALL + """
SELECT prob_pos AS threshold, round(tp::DOUBLE / (tp + fp), 9) AS precision,
       round(tp::DOUBLE / np, 9) AS recall FROM cum""")
def pr_curve(spark, d):
    return _rounded(M.pr_points(S.scored(spark, d)), ["precision", "recall"])


_SWEEP = f""", grid AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(30, 71) r(i)),
c AS (SELECT threshold, {_CONF.format(t='threshold')} FROM scored, grid WHERE split = 'val'
      GROUP BY threshold),
curve AS (SELECT threshold, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp,
          {_RATES} FROM c)
"""


def _val_curve(spark, d):
    return M.threshold_sweep(S.scored(spark, d).where("split = 'val'"))


@query("threshold_sweep", SCORED + _SWEEP + "SELECT * FROM curve")
def threshold_sweep(spark, d):
    return _rounded(_val_curve(spark, d), _RATE_COLS)


@query("best_threshold", SCORED + _SWEEP + """
SELECT (SELECT threshold FROM curve ORDER BY f1_macro DESC, threshold LIMIT 1) AS best_threshold,
       (SELECT max(f1_macro) FROM curve) AS best_f1_macro,
       coalesce((SELECT threshold FROM curve WHERE f1_pos >= 0.5
                 ORDER BY f1_neg DESC, threshold LIMIT 1),
                (SELECT threshold FROM curve ORDER BY f1_macro DESC, threshold LIMIT 1))
         AS constrained_threshold""")
def best_threshold(spark, d):
    out = M.best_threshold(_val_curve(spark, d), min_f1_pos=0.5)
    return _rounded(out, ["best_f1_macro"])


@query("brier", SCORED + """
SELECT split, round(avg((prob_pos - class)**2), 9) AS brier FROM scored GROUP BY split""")
def brier(spark, d):
    return _rounded(M.brier(S.scored(spark, d), ["split"]), ["brier"])


@query("calibration_curve", SCORED + """
SELECT least(floor(prob_pos * 10), 9)::INTEGER AS bin, count(*) AS n,
       round(avg(prob_pos), 9) AS mean_predicted, round(avg(class), 9) AS fraction_positive
FROM scored GROUP BY 1""")
def calibration_curve(spark, d):
    return _rounded(
        M.calibration_curve(S.scored(spark, d)), ["mean_predicted", "fraction_positive"]
    )


_CURATED = """, hc AS (SELECT s.* FROM scored s JOIN seqs q USING (gene_id)
                     JOIN labels l ON l.doc_id = q.doc_id WHERE l.toxic = 1)
"""


@query("curated_check", SCORED + _CURATED + """
SELECT count(*) AS n, sum((pred = class)::INTEGER)::BIGINT AS n_correct,
       round(avg((pred = class)::INTEGER), 9) AS accuracy FROM hc""")
def curated_check(spark, d):
    return _rounded(M.curated_check(S.scored(spark, d), curated(spark, d)), ["accuracy"])


@query("curated_misses", SCORED + _CURATED + """
SELECT gene_id, class, prob_pos FROM hc WHERE pred <> class""")
def curated_misses(spark, d):
    out = M.curated_misses(S.scored(spark, d), curated(spark, d))
    return out.select("gene_id", "class", "prob_pos")


@query("suspicious_labels", SCORED + """
SELECT gene_id, prob_pos FROM scored
WHERE class = 0 AND split = 'test' AND prob_pos BETWEEN 0.35 AND 0.5""")
def suspicious_labels(spark, d):
    test = S.scored(spark, d).where("split = 'test'")
    return M.suspicious_labels(test).select("gene_id", "prob_pos")


def runs(spark, d):
    """Three scored runs: the stored one, a flattened one, one scored by a feature."""
    s = S.scored(spark, d).select("gene_id", "class", "split", "prob_pos")
    flat = s.withColumn("prob_pos", F.col("prob_pos") * 0.5 + 0.25)
    seq = S.features(spark, d).select("gene_id", "au_content")
    third = s.join(seq, "gene_id").withColumn("prob_pos", F.coalesce("au_content", F.lit(0.5)))
    return (
        s.withColumn("run", F.lit("stored"))
        .unionByName(flat.withColumn("run", F.lit("flat")))
        .unionByName(third.drop("au_content").withColumn("run", F.lit("au")))
    )


_RUNS = S.with_sql(S.SEQ_SQL, S.GENES_SQL, S.FEATURES_SQL, S.PREDICTIONS_SQL, S.SCORED_SQL) + """
, runs AS (
  SELECT 'stored' AS run, split, class, prob_pos FROM scored
  UNION ALL SELECT 'flat', split, class, prob_pos * 0.5::DOUBLE + 0.25::DOUBLE FROM scored
  UNION ALL SELECT 'au', split, class, coalesce(au_content, 0.5) FROM scored JOIN features
    USING (gene_id)),
per AS (SELECT run, split, prob_pos, count(*) FILTER (class = 1) AS pos,
               count(*) FILTER (class = 0) AS neg FROM runs GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
               sum(pos) OVER (PARTITION BY run, split) AS np,
               sum(neg) OVER (PARTITION BY run, split) AS nn
        FROM per WINDOW w AS (PARTITION BY run, split ORDER BY prob_pos DESC)),
ar AS (SELECT run, split, """ + _AUROC + " AS auroc, " + _AUPRC + """ AS auprc
       FROM cum GROUP BY 1, 2),
cc AS (SELECT run, split, """ + _CONF.format(t="0.5") + """,
              round(avg((prob_pos - class)**2), 9) AS brier FROM runs GROUP BY 1, 2),
mt AS (SELECT run, split, tn, fp, fn, tp, """ + _RATES + """, auroc, auprc, brier
       FROM cc JOIN ar USING (run, split))
"""


@query("metric_table", _RUNS + "SELECT * FROM mt")
def metric_table(spark, d):
    out = M.metric_table(runs(spark, d), ["run", "split"])
    return _rounded(out, [*_RATE_COLS, "auroc", "auprc", "brier"])


@query("impact_table", _RUNS + """, l AS (
  SELECT run, split, metric, v
  FROM (SELECT run, split, auroc, auprc, f1_macro, f1_pos, f1_neg, brier FROM mt)
  UNPIVOT INCLUDE NULLS (v FOR metric IN (auroc, auprc, f1_macro, f1_pos, f1_neg, brier)))
SELECT b.split, b.metric, b.v AS before, a.v AS after, round(a.v - b.v, 6) AS delta
FROM (SELECT * FROM l WHERE run = 'stored') b FULL JOIN (SELECT * FROM l WHERE run = 'flat') a
  USING (split, metric)""")
def impact_table(spark, d):
    t = M.metric_table(runs(spark, d), ["run", "split"])
    t = _rounded(t, ["auroc", "auprc", "f1_macro", "f1_pos", "f1_neg", "brier"])
    out = M.impact_table(
        t.where("run = 'stored'").drop("run"), t.where("run = 'flat'").drop("run"), ["split"]
    )
    return _rounded(out, ["delta"], 6)


@query("run_history", _RUNS + """
SELECT run, split, auroc, f1_macro, CASE run WHEN 'au' THEN 0 WHEN 'stored' THEN 1 ELSE 2 END
         AS phase_order
FROM mt""")
def run_history(spark, d):
    from condensq.operators.registry import run_history as history

    t = M.metric_table(runs(spark, d), ["run", "split"])
    order = F.when(F.col("run") == "au", 0).when(F.col("run") == "stored", 1).otherwise(2)
    phases = runs(spark, d).select("run").distinct().withColumn("phase_order", order)
    out = history(t.select("run", "split", "auroc", "f1_macro"), phases)
    return _rounded(out, ["auroc", "f1_macro"])


# Splits --------------------------------------------------------------------------------------

_DIG = "md5({k}::VARCHAR || '|42')"


@query("cluster_split", S.with_sql(S.SEQ_SQL) + f""", lab AS (
  SELECT gene_id, gene_name || condition AS cl, class FROM seqs),
per AS (SELECT cl, class, count(*) AS n, min(gene_id) AS f FROM lab GROUP BY 1, 2),
maj AS (SELECT cl, arg_min(class, {{'n': -n, 'f': f}}) AS m FROM per GROUP BY 1),
pl AS (SELECT cl, m, row_number() OVER (PARTITION BY m ORDER BY {_DIG.format(k='cl')}, cl) AS p,
              count(*) OVER (PARTITION BY m) AS n FROM maj)
SELECT gene_id, cl, CASE WHEN m NOT IN (0, 1) THEN 'train'
         WHEN p <= floor(n * 0.7::DOUBLE) THEN 'train'
         WHEN p <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END
         AS split
FROM lab JOIN pl USING (cl)""")
def cluster_split(spark, d):
    g = S.genes(spark, d).select(
        "gene_id", F.concat("gene_name", "condition").alias("cl"), "class"
    )
    return K.cluster_split(g, "cl", "class", "gene_id").select("gene_id", "cl", "split")


@query("random_split", SCORED + f""", pl AS (
  SELECT gene_id, class, row_number() OVER (PARTITION BY class
           ORDER BY {_DIG.format(k='gene_id')}, gene_id) AS p,
         count(*) OVER (PARTITION BY class) AS n FROM genes)
SELECT gene_id, CASE WHEN class NOT IN (0, 1) THEN 'train'
         WHEN p <= floor(n * 0.7::DOUBLE) THEN 'train'
         WHEN p <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END
         AS split FROM pl""")
def random_split(spark, d):
    g = S.genes(spark, d).select("gene_id", "class")
    return K.random_split(g, "gene_id", "class").select("gene_id", "split")


@query("kfold", SCORED + f"""
SELECT gene_id, class, ((row_number() OVER (PARTITION BY class
         ORDER BY {_DIG.format(k='gene_id')}, gene_id) - 1) % 5)::INTEGER AS fold
FROM genes""")
def kfold(spark, d):
    return K.kfold(S.genes(spark, d).select("gene_id", "class"), "gene_id", "class")


@query("leakage_audit", SCORED + """
SELECT gene_name, count(DISTINCT split) AS n_splits, count(*) AS n_rows FROM genes
GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def leakage_audit(spark, d):
    return K.leakage_audit(S.genes(spark, d), "gene_name")


@query("copies_across_splits", SCORED + """
SELECT md5(d.text) AS digest, count(DISTINCT split) AS n_splits, count(*) AS n_rows
FROM genes g JOIN seqs USING (gene_id) JOIN documents d USING (doc_id)
GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def copies_across_splits(spark, d):
    docs = S.documents(spark, d).select(S.locus(F.col("doc_id")).alias("gene_id"), "text")
    rows = docs.join(S.genes(spark, d).select("gene_id", "split"), "gene_id")
    return K.copies_across_splits(rows, "text")


@query("seeded_sample", SCORED + f"""
SELECT gene_id, class FROM genes ORDER BY {_DIG.format(k='gene_id')}, gene_id LIMIT 200""")
def seeded_sample(spark, d):
    return K.seeded_sample(S.genes(spark, d).select("gene_id", "class"), "gene_id", 200)
