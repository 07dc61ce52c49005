"""What must hold of results that SQL cannot compute: models, attributions, superposition, encoders.

Each entry takes every row of its operator's result, states what holds of it as flags, and has the
SQL that gives the rows and true flags.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from condensq.operators import explain as X
from condensq.operators import models as L
from condensq.operators import retrieval as P
from condensq.operators import structure as J
from condensq.plans import star as S
from condensq.plans.catalog import QUERIES, query
from condensq.plans.catalog import learning as Q
from condensq.session import cut_lineage

_LABELLED = S.STAR_SQL + ", lab AS (SELECT gene_id, class, split FROM genes JOIN features USING (gene_id) WHERE class >= 0)"


def _probability(c="prob_pos"):
    return F.coalesce(F.col(c).between(0, 1), F.lit(False))


@query("rf_invariants", _LABELLED + """
SELECT gene_id, class, split, true AS in_range, true AS decided, true AS judged FROM lab""")
def rf_invariants(spark, d):
    out = QUERIES["rf_scores"](spark, d)
    return out.select(
        "gene_id", "class", "split", _probability().alias("in_range"),
        (F.col("pred") == (F.col("prob_pos") >= 0.5).cast("int")).alias("decided"),
        (F.col("correct") == (F.col("pred") == F.col("class")).cast("int")).alias("judged"),
    )


@query("gbt_invariants", _LABELLED + """
SELECT gene_id, class, split, true AS in_range, true AS decided FROM lab""")
def gbt_invariants(spark, d):
    out = QUERIES["gbt_scores"](spark, d)
    return out.select(
        "gene_id", "class", "split", _probability().alias("in_range"),
        (F.col("pred") == (F.col("prob_pos") >= 0.5).cast("int")).alias("decided"),
    )


@query("calibration_invariants", _LABELLED + """
SELECT gene_id, class, split, true AS in_range, true AS is_mean FROM lab""")
def calibration_invariants(spark, d):
    """The score is the mean of the members' sigmoids, taken one by one."""
    df, model = Q.calibrated(spark, d)
    both = model.transform(df)
    mean = F.lit(0.0)
    for i, (forest, slope, intercept) in enumerate(model.members):
        both = L.score(both.drop("pred", "correct", "pred_error"), forest, f"raw{i}")
        mean = mean + 1 / (1 + F.exp(-(F.lit(slope) * F.col(f"raw{i}") + F.lit(intercept))))
    gap = F.abs(mean / len(model.members) - F.col("prob_pos"))
    return both.select(
        "gene_id", "class", "split", _probability().alias("in_range"), (gap < 1e-9).alias("is_mean")
    )


@query("baseline_invariants", _LABELLED + """
SELECT split, count(*) AS n, true AS counts_agree, true AS in_range FROM lab GROUP BY 1""")
def baseline_invariants(spark, d):
    out = QUERIES["baseline_scores"](spark, d)
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    hits = F.abs(F.col("accuracy") - (F.col("tp") + F.col("tn")) / n) < 1e-9
    rates = [F.coalesce(F.col(c).between(0, 1), F.lit(True)) for c in ("auroc", "auprc", "brier", "f1_macro")]
    inside = rates[0] & rates[1] & rates[2] & rates[3]
    return out.select("split", n.cast("long").alias("n"), hits.alias("counts_agree"), inside.alias("in_range"))


@query("sweep_invariants", """
SELECT w AS weights, true AS in_range, 1::BIGINT AS n_best, true AS best_is_top
FROM (VALUES ('balanced'), ('neg=1.5'), ('neg=2.0'), ('neg=2.5')) t(w)""")
def sweep_invariants(spark, d):
    out = QUERIES["class_weight_sweep"](spark, d)
    whole = out.agg(F.count_if("best").alias("n_best"), F.max("f1_macro").alias("top"),
                    F.max(F.when(F.col("best"), F.col("f1_macro"))).alias("chosen"))
    return out.join(F.broadcast(whole)).select(  # four rows and one
        "weights", F.col("f1_macro").between(0, 1).alias("in_range"), "n_best",
        (F.col("top") == F.col("chosen")).alias("best_is_top"),
    )


@query("attribution_invariants", _LABELLED + """
SELECT gene_id, 11::BIGINT AS n_features, true AS adds_up FROM lab""")
def attribution_invariants(spark, d):
    """Attributions of the whole forest and its base value add up to its probability."""
    df, model = Q.forest(spark, d)
    leaves = Q.leaves(spark, d)
    out = X.forest_attribution(L.score(df, model), leaves, Q.COLS, "gene_id")
    total = F.aggregate("attributions", F.col("base_value"), lambda a, x: a + x)
    return out.select(
        "gene_id", F.size("attributions").cast("long").alias("n_features"),
        (F.abs(total - F.col("prob_pos")) < 1e-9).alias("adds_up"),
    )


@query("leaf_rescoring", _LABELLED + "SELECT gene_id, true AS same FROM lab")
def leaf_rescoring(spark, d):
    """The forest's probability again, from its leaf table by bounds and sums alone."""
    df, model = Q.forest(spark, d)
    rows = cut_lineage(L.score(df, model))
    sums = X.forest_leaf_sums(rows, Q.leaves(spark, d), Q.COLS, "gene_id")
    n = Q.FOREST.trees
    scores = rows.groupBy("gene_id").agg(F.first("prob_pos").alias("prob_pos"))
    return scores.join(sums, F.col("gene_id").eqNullSafe(F.col("key"))).select(
        "gene_id", ((F.abs(F.col("total") / n - F.col("prob_pos")) < 1e-9) & (F.col("met") == n)).alias("same")
    )


@query("importance_invariants", """
SELECT 11::BIGINT AS n_features, 11::BIGINT AS n_first, 11::BIGINT AS n_second, true AS shifts_agree""")
def importance_invariants(spark, d):
    out = QUERIES["importance_comparison"](spark, d)
    return out.agg(
        F.count_distinct("feature").alias("n_features"), F.count_distinct("rank_first").alias("n_first"),
        F.count_distinct("rank_second").alias("n_second"),
        F.min(F.abs("shift_second") == F.abs(F.col("rank_first") - F.col("rank_second"))).alias("shifts_agree"),
    )


@query("pca_invariants", _LABELLED + """
SELECT count(*) AS n, true AS centred, true AS uncorrelated, true AS ordered FROM lab""")
def pca_invariants(spark, d):
    """Components are centred, uncorrelated, and the first one varies more."""
    out = QUERIES["pca_2d"](spark, d)
    return out.agg(
        F.count(F.lit(1)).alias("n"),
        ((F.abs(F.avg("pc1")) < 1e-6) & (F.abs(F.avg("pc2")) < 1e-6)).alias("centred"),
        (F.abs(F.corr("pc1", "pc2")) < 1e-6).alias("uncorrelated"),
        (F.var_samp("pc1") >= F.var_samp("pc2")).alias("ordered"),
    )


@query("report_invariants", _LABELLED + """
SELECT CASE split WHEN 'train' THEN 'reference' ELSE 'current' END AS dataset, count(*) AS n, true AS in_range
FROM lab WHERE split IN ('train', 'test') GROUP BY 1""")
def report_invariants(spark, d):
    out = QUERIES["classification_report"](spark, d)
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    inside = F.coalesce(F.col("auroc").between(0, 1), F.lit(True))  # undefined where one class is missing
    return out.select("dataset", n.cast("long").alias("n"), inside.alias("in_range"))


_REQUESTS = S.with_sql(S.SEQ_SQL) + """
SELECT doc_id::VARCHAR AS request_id, CASE WHEN length(seq) < 50 THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN length(seq) < 50 THEN printf('mrna_seq has %d characters, needs 50', length(seq)) END AS error,
       true AS consistent"""


def _consistent(explain: bool):
    """Label, confidence and strongest features follow from the probability and from each other."""
    p = F.col("prob_pos")
    label = F.col("prediction") == F.when(p >= 0.5, "enriched").otherwise("not_enriched")
    sure = F.when(p >= 0.75, "high").when(p >= 0.55, "medium").otherwise("low")
    fine = _probability() & label & (F.col("confidence") == sure) & F.array_contains("imputed_features", "rmsf_nterm50")
    if explain:
        fine = fine & F.size("top_features").between(1, 5)
    empty = F.col("prob_pos").isNull() & F.col("prediction").isNull()
    return F.coalesce(F.when(F.col("status") == "ok", fine).otherwise(empty), F.lit(False))


@query("request_invariants", _REQUESTS + " FROM seqs")
def request_invariants(spark, d):
    out = QUERIES["request_scoring"](spark, d)
    return out.select("request_id", "status", "error", _consistent(True).alias("consistent"))


@query("stream_invariants", _REQUESTS + " FROM seqs")
def stream_invariants(spark, d):
    out = QUERIES["streaming_scores"](spark, d)
    return out.select("request_id", "status", "error", _consistent(False).alias("consistent"))


@query("chunk_invariants", r"""
SELECT doc_id, true AS parts, true AS within_size, true AS from_start, true AS to_end FROM documents
WHERE length(regexp_replace(text, '\s', '', 'g')) > 0""")
def chunk_invariants(spark, d):
    """Chunks are parts of their text and no longer than allowed; the first one starts with the text
    and the last one ends with it."""
    docs = S.documents(spark, d).select("doc_id", "text")
    bare = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    chunks = QUERIES["chunk_recursive"](spark, d).join(docs.withColumn("bare", bare), "doc_id")
    return chunks.groupBy("doc_id").agg(
        F.min(F.contains("text", "chunk_text")).alias("parts"),
        F.min(F.length("chunk_text").between(1, P.CHUNK_SIZE)).alias("within_size"),
        F.min_by(F.startswith("bare", "chunk_text"), "chunk").alias("from_start"),
        F.max_by(F.endswith("bare", "chunk_text"), "chunk").alias("to_end"),
    )


@query("retrieval_invariants", """
SELECT item_id AS query_id, 5::BIGINT AS n_hits, true AS in_range, true AS falling FROM benchmark""")
def retrieval_invariants(spark, d):
    """Five different chunks a question, at falling cosines."""
    out = QUERIES["text_retrieval"](spark, d)
    scores = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda r: r.score)
    return out.groupBy("query_id").agg(
        F.count_distinct("chunk_id").alias("n_hits"),
        F.min(F.col("score").between(-1, 1.0001)).alias("in_range"),
        (scores == F.reverse(F.array_sort(scores))).alias("falling"),
    )


@query("rmsf_of_rigid_motion", """
SELECT label::VARCHAR AS structure, 0.0::DOUBLE AS rmsf_mean, 0.0::DOUBLE AS rmsf_max, 0.0::DOUBLE AS rmsf_nterm50
FROM embeddings GROUP BY 1""")
def rmsf_of_rigid_motion(spark, d):
    """Frames that are turned and shifted copies of one frame do not fluctuate."""
    atoms = S.atoms(spark, d)
    one = J.first_frames(atoms)
    frames = atoms.select("structure", "frame").distinct().withColumnRenamed("frame", "_f")
    t = F.col("_f") * 0.37  # an angle of its own for each frame
    moved = one.join(frames, "structure").withColumn("frame", F.col("_f"))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    turned = {
        "x": F.cos(t) * x - F.sin(t) * y + F.col("_f"), "y": F.sin(t) * x + F.cos(t) * y - F.col("_f") / 2,
        "z": z + 5 * F.sin(t),
    }
    out = J.rmsf(moved.withColumns(turned).drop("_f"), ends=3)
    return out.select("structure", *[F.abs(F.round(c, 3)).alias(c) for c in ("rmsf_mean", "rmsf_max", "rmsf_nterm50")])


@query("routing_sources", """
SELECT label::VARCHAR AS structure, CASE WHEN label % 3 = 0 THEN 'static' ELSE 'ensemble' END AS feature_source,
       true AS has_values, CASE WHEN label % 3 > 0 THEN count(*) END AS n_conformations,
       CASE WHEN label % 3 > 0 THEN round_even(count(*) / 100.0::DOUBLE, 4) END AS pass_rate
FROM embeddings GROUP BY label""")
def routing_sources(spark, d):
    out = QUERIES["ensemble_routing"](spark, d)
    whole = F.col("n_conformations").cast("long").alias("n_conformations")
    return out.select("structure", "feature_source", F.col("rg_mean").isNotNull().alias("has_values"), whole, "pass_rate")
