"""Questions about the star schema, marts and group summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from condensq.operators import aggregates as agg
from condensq.operators import metrics, tables
from condensq.operators.lookup import lookup
from condensq.plans import analytics, marts
from condensq.plans import star as S
from condensq.plans.catalog import query
from condensq.plans.star import SCORED, STAR_SQL, locus_sql

_JOINED = "predictions p JOIN genes g USING (gene_id) JOIN features f USING (gene_id)"


@query("accuracy_by_tier", STAR_SQL + f"""
SELECT g.tier, count(*) AS n_genes, sum(g.class)::BIGINT AS n_positives,
       round(avg(CASE WHEN p.pred = g.class THEN 1.0::DOUBLE ELSE 0 END), 3) AS accuracy,
       round(avg(p.prob_pos), 3) AS mean_prob, round(avg(f.idr_percent), 1) AS mean_idr_pct,
       round(avg(f.rmsf_mean), 1) AS mean_rmsf
FROM {_JOINED} WHERE g.split = 'test' GROUP BY g.tier""")
def accuracy_by_tier(spark, d):
    return analytics.q_tier_accuracy(S.star(spark, d))


@query("overview_counts", STAR_SQL + """
SELECT (SELECT count(*) FROM genes) AS n_genes, (SELECT count(*) FROM features) AS n_features_rows,
       (SELECT count(*) FROM predictions) AS n_predictions,
       (SELECT sum(class)::BIGINT FROM genes) AS n_positives,
       (SELECT count(*) - sum(class)::BIGINT FROM genes) AS n_negatives""")
def overview_counts(spark, d):
    return analytics.q_overview(S.genes(spark, d), S.features(spark, d), S.predictions(spark, d))


@query("top_candidates", STAR_SQL + f"""
SELECT gene_id, g.gene_name, p.prob_pos, f.rrach_count, round(f.idr_percent, 1) AS idr_pct,
       round(f.utr3_au_content, 3) AS utr3_au, round(f.rmsf_nterm_cterm_ratio, 2) AS rmsf_ratio
FROM {_JOINED} WHERE g.class = 1 ORDER BY p.prob_pos DESC, gene_id LIMIT 20""")
def top_candidates(spark, d):
    return analytics.q_top(S.star(spark, d))


@query("quartile_profile", STAR_SQL + f""", base AS (
  SELECT gene_id, g.class, f.utr3_au_content, p.prob_pos,
         ntile(4) OVER (ORDER BY f.utr3_au_content, md5(gene_id), gene_id) AS quartile
  FROM {_JOINED} WHERE f.utr3_au_content IS NOT NULL)
SELECT quartile::INTEGER AS quartile, count(*) AS n_genes, sum(class)::BIGINT AS n_positives,
       round(avg(utr3_au_content), 3) AS mean_utr3_au_content,
       round(avg(prob_pos), 3) AS mean_prob_pos
FROM base GROUP BY quartile""")
def quartile_profile(spark, d):
    return analytics.q_quartiles(S.star(spark, d))


@query("joint_filter", STAR_SQL + f"""
SELECT gene_id, g.gene_name, g.class, round(f.rmsf_nterm_cterm_ratio, 2) AS rmsf_ratio,
       round(f.rrach_per_kb, 1) AS rrach_per_kb, round(f.idr_percent, 1) AS idr_pct,
       round(p.prob_pos, 3) AS prob_pos
FROM {_JOINED}
WHERE f.rmsf_nterm_cterm_ratio > 2.0 AND f.rrach_per_kb > 15.0""")
def joint_filter(spark, d):
    return analytics.q_joint_filter(S.star(spark, d))


_PANEL = """SELECT gene_id, g.gene_name, g.condition, round(p.prob_pos, 4) AS prob_pos,
       f.rrach_count, round(f.utr3_au_content, 4) AS utr3_au_content,
       round(f.idr_percent, 2) AS idr_percent, '{tag}' AS probe_type
FROM """ + _JOINED + """ WHERE g.class = {c} AND p.prob_pos {op}
ORDER BY p.prob_pos {way}, gene_id LIMIT 150"""


@query("contrast_panel", STAR_SQL + "SELECT * FROM ("
       + _PANEL.format(tag="positive_probe", c=1, op="> 0.75", way="DESC")
       + ") UNION ALL SELECT * FROM ("
       + _PANEL.format(tag="negative_probe", c=0, op="< 0.25", way="ASC") + ")")
def contrast_panel(spark, d):
    return analytics.q_panels(S.star(spark, d))


@query("ambiguous_negatives", STAR_SQL + f"""
SELECT gene_id, g.gene_name, g.condition, round(p.prob_pos, 3) AS prob_pos,
       round(f.utr3_au_content, 3) AS utr3_au, f.rrach_count, round(f.idr_percent, 1) AS idr_pct,
       g.tier
FROM {_JOINED} WHERE g.class = 0 AND p.prob_pos BETWEEN 0.35::DOUBLE AND 0.65::DOUBLE""")
def ambiguous_negatives(spark, d):
    return analytics.q_ambiguous(S.star(spark, d))


@query("ambiguous_share", SCORED + """
SELECT count(*) FILTER (class = 0 AND prob_pos BETWEEN 0.35 AND 0.65) AS n_ambiguous,
       count(*) FILTER (class = 0) AS n_negatives,
       round(count(*) FILTER (class = 0 AND prob_pos BETWEEN 0.35 AND 0.65) * 100.0::DOUBLE
             / count(*) FILTER (class = 0), 1) AS pct_ambiguous
FROM scored""")
def ambiguous_share(spark, d):
    return analytics.q_ambiguous_share(S.scored(spark, d))


@query("attribution_coverage", STAR_SQL + """
SELECT count(*) AS total_genes, count(shap_mrna_length) AS with_shap,
       round(count(shap_mrna_length) * 100.0::DOUBLE / count(*), 1) AS shap_pct,
       round(avg(CASE WHEN shap_mrna_length IS NOT NULL THEN prob_pos END), 3)
         AS mean_prob_with_shap,
       round(avg(CASE WHEN shap_mrna_length IS NULL THEN prob_pos END), 3) AS mean_prob_no_shap
FROM predictions""")
def attribution_coverage(spark, d):
    return analytics.q_attr_coverage(S.predictions(spark, d))


@query("ranked_panel", STAR_SQL + f""", ranked AS (
  SELECT gene_id, p.prob_pos, f.utr3_au_content, f.rrach_count, f.idr_percent,
         row_number() OVER (ORDER BY p.prob_pos DESC, gene_id)::INTEGER AS "rank"
  FROM {_JOINED} WHERE p.prob_pos > 0.85 AND f.rrach_count > 15)
SELECT * FROM ranked WHERE "rank" <= 50""")
def ranked_panel(spark, d):
    return analytics.q_ranked_panel(S.star(spark, d))


@query("tile_average", STAR_SQL + f""", tiled AS (
  SELECT gene_id, g.class, f.utr3_au_content, p.prob_pos,
         ntile(4) OVER (ORDER BY f.utr3_au_content, md5(gene_id), gene_id)::INTEGER AS au_quartile
  FROM {_JOINED})
SELECT gene_id, class, utr3_au_content, prob_pos, au_quartile,
       round(avg(prob_pos) OVER (PARTITION BY au_quartile), 9) AS mean_prob_by_quartile
FROM tiled""")
def tile_average(spark, d):
    out = analytics.q_tile_avg(S.star(spark, d))
    return out.withColumn("mean_prob_by_quartile", F.round("mean_prob_by_quartile", 9))


@query("entity_detail", STAR_SQL + f"""
SELECT gene_id, g.gene_name, g.condition, g.class, g.tier, g.split,
       round(p.prob_pos, 4) AS prob_pos, p.pred, f.mrna_length, f.cds_length, f.utr3_length,
       f.utr5_length, round(f.utr3_au_content, 4) AS utr3_au_content, f.rrach_count,
       round(f.rrach_per_kb, 2) AS rrach_per_kb, round(f.idr_percent, 2) AS idr_percent,
       round(f.rmsf_mean, 2) AS rmsf_mean, round(f.rmsf_nterm50, 2) AS rmsf_nterm50,
       round(f.rmsf_cterm50, 2) AS rmsf_cterm50,
       round(f.rmsf_nterm_cterm_ratio, 3) AS rmsf_ratio, round(f.n_residues, 0) AS n_residues,
       round(f.mfe_per_nt, 4) AS mfe_per_nt
FROM {_JOINED}""")
def entity_detail(spark, d):
    return analytics.detail(S.star(spark, d))


@query("name_search", STAR_SQL + f"""
SELECT gene_id, g.gene_name, g.class, round(p.prob_pos, 4) AS prob_pos
FROM {_JOINED} WHERE lower(g.gene_name) LIKE '%src1%'""")
def name_search(spark, d):
    return analytics.q_search(S.star(spark, d), "SRC1")


@query("lookup_status", STAR_SQL + f"""
, ids AS (SELECT {locus_sql('c_custkey')} AS gene_id FROM customer)
SELECT gene_id, CASE WHEN prob_pos IS NULL THEN 'not_found' ELSE 'found' END AS status,
       round_even(prob_pos, 6) AS prob_pos,
       CASE WHEN pred = 1 THEN 'enriched' WHEN pred = 0 THEN 'not_enriched' END AS prediction,
       CASE WHEN prob_pos >= 0.75 THEN 'high' WHEN prob_pos >= 0.55 THEN 'medium'
            WHEN prob_pos IS NOT NULL THEN 'low' END AS confidence,
       CASE WHEN prob_pos IS NOT NULL THEN
         (shap_mrna_length IS NOT NULL)::INTEGER * 6 END AS n_attributions
FROM ids LEFT JOIN predictions USING (gene_id)""")
def lookup_status(spark, d):
    ids = S.customers(spark, d).select(F.lower("gene_id").alias("gene_id"))
    out = lookup(ids, S.predictions(spark, d))
    return out.withColumn("n_attributions", F.when(
        F.col("top_shap").isNotNull(), F.size("top_shap"))).drop("top_shap")


@query("landscape_mart", STAR_SQL + """
SELECT gene_id, s.class, s.split, round_even(p.prob_pos, 5) AS prob_pos, p.pred,
       round_even(f.utr3_au_content, 5) AS utr3_au_content, f.rrach_count,
       round_even(f.rrach_per_kb, 5) AS rrach_per_kb, f.mrna_length, f.cds_length, f.utr3_length,
       round_even(f.idr_percent, 5) AS idr_percent, round_even(f.rmsf_mean, 5) AS rmsf_mean,
       round_even(f.rmsf_nterm50, 5) AS rmsf_nterm50,
       round_even(f.rmsf_nterm_cterm_ratio, 5) AS rmsf_nterm_cterm_ratio,
       round_even(f.mfe_per_nt, 5) AS mfe_per_nt,
       CASE WHEN p.prob_pos >= 0.75 THEN 'High (≥0.75)'
            WHEN p.prob_pos >= 0.55 THEN 'Medium (0.55–0.75)' ELSE 'Low (<0.55)' END AS confidence,
       CASE s.class WHEN 1 THEN 'P-body enriched' WHEN 0 THEN 'Not enriched' END AS class_label
FROM predictions p JOIN genes s USING (gene_id) LEFT JOIN features f USING (gene_id)""")
def landscape_mart(spark, d):
    preds = S.predictions(spark, d).select("gene_id", "prob_pos", "pred").join(
        S.genes(spark, d).select("gene_id", "class", "split"), "gene_id"
    )
    return marts.landscape(preds, S.features(spark, d)).drop("di_CG", "di_UA")


@query("genes_mart", f"""
WITH iso AS (
  SELECT {locus_sql('o_custkey')} AS gene_id, o_orderkey AS transcript_id, o_totalprice,
         o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k
  FROM orders)
SELECT i.gene_id, i.transcript_id, c.c_name AS gene_name,
       CASE WHEN i.o_totalprice > 250000 THEN 1 ELSE 0 END AS class, i.o_orderstatus AS condition,
       CASE WHEN c.c_acctbal < 2000 THEN 1 WHEN c.c_acctbal < 6000 THEN 2 ELSE 3 END AS tier,
       CASE WHEN c.c_mktsegment = 'BUILDING' THEN NULL ELSE lower(c.c_mktsegment) END AS split
FROM iso i JOIN (SELECT *, {locus_sql('c_custkey')} AS gene_id FROM customer) c USING (gene_id)
WHERE k = 1""")
def genes_mart(spark, d):
    c = S.customers(spark, d)
    o = S.table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    iso = o.select(
        "gene_id", F.col("o_orderkey").alias("transcript_id"),
        F.concat("c_name", F.lit(":p, order of "), "o_orderdate").alias("description_prot"),
        (F.col("o_totalprice") > 250000).cast("int").alias("class"),
        F.col("o_orderstatus").alias("condition"), F.col("o_orderkey").alias("ord"),
    )
    tiers = c.select("gene_id", S.assign_tier(F.col("c_acctbal"), 2000, 6000).alias("tier"))
    splits = c.where("c_mktsegment <> 'BUILDING'").select(
        "gene_id", F.lower("c_mktsegment").alias("split")
    )
    return marts.build_genes(iso, tiers, splits, "ord")


@query("features_mart", STAR_SQL + """
SELECT gene_id, mrna_length, cds_length, utr3_length, utr5_length, rrach_count,
       round(utr3_au_content, 6) AS utr3_au_content, round(packing_x_idr, 6) AS packing_x_idr,
       round(rmsf_mean, 6) AS rmsf_mean
FROM features""")
def features_mart(spark, d):
    matrix = S.features(spark, d).withColumn("ord", F.col("mrna_length"))
    table, _ = marts.build_features(matrix, "ord")
    keep = ["gene_id", "mrna_length", "cds_length", "utr3_length", "utr5_length", "rrach_count"]
    return table.select(
        *keep, *[F.round(c, 6).alias(c) for c in ("utr3_au_content", "packing_x_idr", "rmsf_mean")]
    )


@query("predictions_mart", SCORED + """
SELECT gene_id, prob_pos, pred, shap_mrna_length, shap_cds_length, "shap_di_CG",
       shap_utr3_au_content, shap_rrach_per_kb, shap_rmsf_nterm50
FROM predictions""")
def predictions_mart(spark, d):
    # The stored columns are taken apart by row id and put back, as a fresh run would do.
    p = S.predictions(spark, d).withColumn("row_id", F.xxhash64("gene_id"))
    shap = [c for c in p.columns if c.startswith("shap_")]
    long = p.unpivot(["row_id"], shap, "feature", "attribution").where("attribution IS NOT NULL")
    long = long.withColumn("feature", F.substring("feature", 6, 100))
    return marts.build_predictions(p.select("row_id", "gene_id", "prob_pos", "pred"), long)


@query("feature_prob_table", STAR_SQL + """
SELECT gene_id, g.class, round(f.rmsf_mean, 6) AS rmsf_mean, p.prob_pos
FROM features f JOIN genes g USING (gene_id) JOIN predictions p USING (gene_id)
WHERE p.prob_pos IS NOT NULL""")
def feature_prob_table(spark, d):
    matrix = S.features(spark, d).join(S.genes(spark, d).select("gene_id", "class"), "gene_id")
    out = marts.feature_vs_prob(matrix, S.predictions(spark, d), "rmsf_mean")
    return out.withColumn("rmsf_mean", F.round("rmsf_mean", 6))


@query("population_context", STAR_SQL + """, v AS (
  SELECT gene_id, class, 'rrach_count' AS feature, rrach_count::DOUBLE AS value
  FROM features JOIN genes USING (gene_id)
  UNION ALL
  SELECT gene_id, class, 'rmsf_mean', rmsf_mean FROM features JOIN genes USING (gene_id)
  WHERE rmsf_mean IS NOT NULL),
counts AS (SELECT feature, value, count(*) FILTER (class = 1) AS pos,
                  count(*) FILTER (class = 0) AS neg FROM v GROUP BY 1, 2),
cum AS (SELECT feature, value,
               coalesce(sum(pos) OVER w, 0) AS pb, coalesce(sum(neg) OVER w, 0) AS nb,
               sum(pos) OVER (PARTITION BY feature) AS np,
               sum(neg) OVER (PARTITION BY feature) AS nn
        FROM counts WINDOW w AS (PARTITION BY feature ORDER BY value
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT v.feature, v.gene_id, round(v.value, 6) AS value, round(pb::DOUBLE / np, 6) AS below_pos,
       round(nb::DOUBLE / nn, 6) AS below_neg
FROM v JOIN cum USING (feature, value)""")
def population_context(spark, d):
    df = S.features(spark, d).join(S.genes(spark, d).select("gene_id", "class"), "gene_id")
    out = marts.population_context(df, ["rrach_count", "rmsf_mean"])
    return out.select(
        "feature", "gene_id",
        *[F.round(c, 6).alias(c) for c in ("value", "below_pos", "below_neg")],
    )


@query("model_card", SCORED + """, s AS (
  SELECT *, prob_pos >= 0.5 AS hit,
         gene_id IN (SELECT seqs.gene_id FROM seqs JOIN labels USING (doc_id) WHERE toxic = 1)
           AS curated
  FROM scored)
SELECT unnest(['tn', 'fp', 'fn', 'tp', 'n_ambiguous', 'n_negatives', 'curated_n',
               'curated_n_correct']) AS fact,
       unnest([count(*) FILTER (split = 'test' AND class = 0 AND NOT hit),
               count(*) FILTER (split = 'test' AND class = 0 AND hit),
               count(*) FILTER (split = 'test' AND class = 1 AND NOT hit),
               count(*) FILTER (split = 'test' AND class = 1 AND hit),
               count(*) FILTER (class = 0 AND prob_pos BETWEEN 0.35 AND 0.65),
               count(*) FILTER (class = 0), count(*) FILTER (curated),
               count(*) FILTER (curated AND pred = class)]) AS value
FROM s""")
def model_card(spark, d):
    return metrics.model_card(S.scored(spark, d), curated(spark, d))


def curated(spark, d):
    """Ids of the rows a second label marks."""
    marked = S.table(spark, d, "labels").where("toxic = 1")
    return marked.select(S.locus(F.col("doc_id")).alias("gene_id"))


@query("correlation", STAR_SQL + """
SELECT a.f AS a, b.f AS b, round(corr(a.v, b.v), 6) AS r
FROM (SELECT gene_id, unnest(['mrna_length', 'au_content', 'rrach_count', 'idr_percent']) AS f,
             unnest([mrna_length::DOUBLE, au_content, rrach_count::DOUBLE, idr_percent]) AS v,
             unnest([1, 2, 3, 4]) AS i FROM features WHERE mrna_length > 0) a
JOIN (SELECT gene_id, unnest(['mrna_length', 'au_content', 'rrach_count', 'idr_percent']) AS f,
             unnest([mrna_length::DOUBLE, au_content, rrach_count::DOUBLE, idr_percent]) AS v,
             unnest([1, 2, 3, 4]) AS i FROM features WHERE mrna_length > 0) b
  ON a.gene_id = b.gene_id AND a.i <= b.i
GROUP BY 1, 2""")
def correlation(spark, d):
    cols = ["mrna_length", "au_content", "rrach_count", "idr_percent"]
    f = S.features(spark, d).where("mrna_length > 0")
    return agg.correlation_pairs(f, cols).withColumn("r", F.round("r", 6))


# Group summaries -----------------------------------------------------------------------------

@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, d):
    return agg.value_counts(S.table(spark, d, "events"), "event_type")


@query("top_values", """
SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 10""")
def top_values(spark, d):
    return agg.value_counts(S.table(spark, d, "documents"), "source", 10)


@query("contingency", SCORED + """
SELECT split, count(*) FILTER (class = 0) AS "0", count(*) FILTER (class = 1) AS "1"
FROM scored GROUP BY split""")
def contingency(spark, d):
    return agg.contingency(S.scored(spark, d), "split", "class", [0, 1])


_LONG = """, v AS (
  SELECT class, 'mrna_length' AS feature, mrna_length::DOUBLE AS value
  FROM features JOIN genes USING (gene_id)
  UNION ALL SELECT class, 'idr_percent', idr_percent FROM features JOIN genes USING (gene_id)
  UNION ALL SELECT class, 'rmsf_mean', rmsf_mean FROM features JOIN genes USING (gene_id))
"""


def _feature_rows(spark, d):
    return S.features(spark, d).join(S.genes(spark, d).select("gene_id", "class"), "gene_id")


_THREE = ["mrna_length", "idr_percent", "rmsf_mean"]


@query("describe_by_class", STAR_SQL + _LONG + """
SELECT class, feature, count(value) AS n, round(avg(value), 6) AS mean,
       round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
       round(max(value), 6) AS max, round(median(value), 6) AS median
FROM v GROUP BY 1, 2""")
def describe_by_class(spark, d):
    out = agg.describe_by(_feature_rows(spark, d), ["class"], _THREE)
    return out.select("class", "feature", "n", *[
        F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max", "median")])


@query("class_separation", STAR_SQL + _LONG + """
SELECT feature, round(avg(value) FILTER (class = 1), 6) AS mean_pos,
       round(avg(value) FILTER (class = 0), 6) AS mean_neg,
       round(avg(value) FILTER (class = 1) / avg(value) FILTER (class = 0), 6) AS ratio
FROM v GROUP BY 1""")
def class_separation(spark, d):
    out = agg.class_separation(_feature_rows(spark, d), _THREE)
    return out.select("feature", *[
        F.round(c, 6).alias(c) for c in ("mean_pos", "mean_neg", "ratio")])


@query("column_digest", STAR_SQL + _LONG + """
SELECT feature, round(min(value), 6) AS min, round(max(value), 6) AS max,
       count(*) FILTER (value IS NULL) AS n_missing, round(median(value), 6) AS median
FROM v GROUP BY 1""")
def column_digest(spark, d):
    out = agg.column_digest(S.features(spark, d), _THREE)
    return out.select("feature", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"),
                      "n_missing", F.round("median", 6).alias("median"))


@query("feature_quantiles", """
SELECT 'value' AS feature, event_type, p AS prob, round(quantile_cont(value, p), 6) AS quantile
FROM events, (VALUES (0.05::DOUBLE), (0.5), (0.95)) t(p) GROUP BY 1, 2, 3""".replace(
    "quantile_cont(value, p)",
    "CASE p WHEN 0.05 THEN quantile_cont(value, 0.05) WHEN 0.5 THEN quantile_cont(value, 0.5) "
    "ELSE quantile_cont(value, 0.95) END"))
def feature_quantiles(spark, d):
    from condensq.operators.ranking import exact_quantiles

    out = exact_quantiles(
        S.table(spark, d, "events"), ["value"], (0.05, 0.5, 0.95), ["event_type"]
    )
    return out.withColumn("quantile", F.round("quantile", 6))


@query("distinct_counts", "SELECT count(DISTINCT user_id) AS n_user_id FROM events")
def distinct_counts(spark, d):
    return agg.distinct_count(S.table(spark, d, "events"), "user_id")


@query("majority_class", SCORED + """, c AS (
  SELECT gene_name, class, count(*) AS n, min(gene_id) AS f FROM genes GROUP BY 1, 2)
SELECT gene_name, arg_min(class, {'n': -n, 'f': f}) AS majority_class, sum(n)::BIGINT AS n_members
FROM c GROUP BY 1""")
def majority_class(spark, d):
    return agg.majority_class(S.genes(spark, d), "gene_name", "class", "gene_id")


@query("class_weights", SCORED + """
SELECT class, count(*) AS n_c,
       round((SELECT count(*) FROM scored)::DOUBLE / (2 * count(*)), 9) AS weight
FROM scored GROUP BY class""")
def class_weights(spark, d):
    out = agg.class_weights(S.scored(spark, d))
    return out.withColumn("weight", F.round("weight", 9))


# Joins and set operations --------------------------------------------------------------------

@query("composite_enrichment", """
SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, p.p_brand, s.s_name
FROM lineitem l LEFT JOIN part p ON p_partkey = l_partkey
LEFT JOIN (SELECT s_suppkey, s_nationkey, s_name FROM supplier WHERE s_acctbal > 0) s
  ON s_suppkey = l_suppkey AND s_nationkey = l_linenumber""")
def composite_enrichment(spark, d):
    line = S.table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"
    )
    part = S.table(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey")
    supp = S.table(spark, d, "supplier").where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("l_linenumber"), "s_name"
    )
    out = tables.enrich(line, part, "l_partkey", ["p_brand"])
    return tables.enrich(out, supp, ["l_suppkey", "l_linenumber"], ["s_name"])


@query("semi_anti_sets", """
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
                       THEN 'kept' ELSE 'missing' END AS status
FROM customer""")
def semi_anti_sets(spark, d):
    c = S.table(spark, d, "customer").select("c_custkey")
    o = S.table(spark, d, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("c_custkey")
    )
    kept = tables.keep_in(c, o, "c_custkey").withColumn("status", F.lit("kept"))
    return tables.union_all(
        kept, tables.not_in(c, o, "c_custkey").withColumn("status", F.lit("missing"))
    )


@query("set_operations", """
SELECT op, count(*) AS n FROM (
  SELECT 'intersection' AS op, k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
    INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')
  UNION ALL
  SELECT 'difference', k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
    EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')
  UNION ALL
  SELECT 'union', k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
    UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'))
GROUP BY op""")
def set_operations(spark, d):
    o = S.table(spark, d, "orders")
    a = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    b = o.where("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("k"))
    parts = [
        tables.set_op(a, b, op).agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
        for op in ("intersection", "difference", "union")
    ]
    return tables.union_all(*parts)


@query("union_loose", """
SELECT 'customer' AS side, c_nationkey AS nation, c_mktsegment AS segment, NULL AS s_name,
       count(*) AS n FROM customer GROUP BY 2, 3
UNION ALL SELECT 'supplier', s_nationkey, NULL, s_name, 1 FROM supplier""")
def union_loose(spark, d):
    c = S.table(spark, d, "customer").groupBy(
        F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
    ).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("customer"))
    s = S.table(spark, d, "supplier").select(
        F.lit("supplier").alias("side"), F.col("s_nationkey").alias("nation"), "s_name",
        F.lit(1).cast("long").alias("n"),
    )
    return tables.union_loose(c, s).select("side", "nation", "segment", "s_name", "n")


@query("fallback_lookup", """
WITH ids AS (SELECT c_custkey, c_name AS id, 'p' || c_nationkey AS alt FROM customer),
hits AS (
  SELECT c_custkey, 0 AS prio, s_suppkey AS v FROM ids
    JOIN supplier ON replace(id, 'Customer', 'Supplier') = s_name
  UNION ALL
  SELECT c_custkey, 1, n_nationkey FROM ids JOIN nation ON alt = 'p' || n_nationkey
    AND n_regionkey < 3)
SELECT i.c_custkey, arg_min(h.v, h.prio) AS accession, min(h.prio)::INTEGER AS matched_by
FROM ids i LEFT JOIN hits h USING (c_custkey) GROUP BY 1""")
def fallback_lookup(spark, d):
    ids = S.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    supp = S.table(spark, d, "supplier").select(
        F.col("s_name").alias("key"), F.col("s_suppkey").alias("value")
    )
    nat = S.table(spark, d, "nation").where("n_regionkey < 3").select(
        F.concat(F.lit("p"), "n_nationkey").alias("key"),
        F.col("n_nationkey").cast("long").alias("value"),
    )
    keyed = ids.select(
        "c_custkey", F.concat_ws("|", "c_name", F.concat(F.lit("p"), "c_nationkey")).alias("id")
    )
    direct = F.replace(F.split_part("id", F.lit("|"), F.lit(1)), F.lit("Customer"), F.lit("Supplier"))
    out = tables.lookup_fallback(
        keyed, [(supp, direct), (nat, F.split_part("id", F.lit("|"), F.lit(2)))], "id", "accession"
    )
    return out.select("c_custkey", "accession", "matched_by")


@query("dedupe_first", """
SELECT o_custkey, o_orderkey, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k
  FROM orders) WHERE k = 1""")
def dedupe_first(spark, d):
    o = S.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return tables.dedupe_first(o, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("patch_upsert", """
SELECT c_custkey, c_name, CASE WHEN s_suppkey IS NOT NULL THEN s_nationkey ELSE c_nationkey END
         AS c_nationkey,
       CASE WHEN s_suppkey IS NOT NULL THEN s_acctbal ELSE c_acctbal END AS c_acctbal
FROM customer LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON c_custkey = s_suppkey""")
def patch_upsert(spark, d):
    c = S.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    s = S.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"),
        F.col("s_acctbal").alias("c_acctbal"),
    )
    return tables.patch(c, s, "c_custkey", ["c_nationkey", "c_acctbal"], F.col("c_acctbal") > 0)


@query("latest_state", """
SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k
  FROM events) WHERE k = 1""")
def latest_state(spark, d):
    from condensq.operators.ranking import latest_per_key

    e = S.table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return latest_per_key(e, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("importance_rank", STAR_SQL + """, long AS (
  UNPIVOT (SELECT gene_id, shap_mrna_length, shap_cds_length, "shap_di_CG", shap_utr3_au_content,
                  shap_rrach_per_kb, shap_rmsf_nterm50 FROM predictions)
  ON COLUMNS(* EXCLUDE gene_id) INTO NAME feature VALUE v)
SELECT feature, round(avg(abs(v)), 9) AS mean_abs_shap,
       row_number() OVER (ORDER BY avg(abs(v)) DESC, feature)::INTEGER AS "rank"
FROM long GROUP BY feature""")
def importance_rank(spark, d):
    return importance(spark, d).withColumn("mean_abs_shap", F.round("mean_abs_shap", 9))


def attribution_rows(spark, d):
    p = S.predictions(spark, d)
    shap = [c for c in p.columns if c.startswith("shap_")]
    return p.unpivot(["gene_id"], shap, "feature", "attribution").where("attribution IS NOT NULL")


def importance(spark, d):
    from condensq.operators.explain import global_importance

    return global_importance(attribution_rows(spark, d))


_IMPORTANCE_SQL = STAR_SQL + """, long AS (
  UNPIVOT (SELECT gene_id, class, split, shap_mrna_length, shap_cds_length, "shap_di_CG",
                  shap_utr3_au_content, shap_rrach_per_kb, shap_rmsf_nterm50
           FROM predictions JOIN genes USING (gene_id))
  ON COLUMNS(* EXCLUDE (gene_id, class, split)) INTO NAME feature VALUE v)
"""


@query("importance_share", _IMPORTANCE_SQL + """, imp AS (
  SELECT replace(feature, 'shap_', '') AS feature, avg(abs(v)) AS m FROM long GROUP BY 1)
SELECT feature, round(m, 9) AS mean_abs_shap, round(m / sum(m) OVER () * 100, 3) AS shap_pct,
       row_number() OVER (ORDER BY m DESC, feature)::INTEGER AS "rank",
       CASE feature WHEN 'mrna_length' THEN 'RNA-length' WHEN 'cds_length' THEN 'RNA-length'
         WHEN 'di_CG' THEN 'RNA-dinucleotide' WHEN 'utr3_au_content' THEN 'RNA-structure'
         WHEN 'rrach_per_kb' THEN 'RNA-m6A' ELSE 'Protein-dynamic' END AS category
FROM imp""")
def importance_share(spark, d):
    from condensq.operators.explain import global_importance, importance_share

    rows = attribution_rows(spark, d).withColumn("feature", F.replace(
        "feature", F.lit("shap_"), F.lit("")))
    out = importance_share(global_importance(rows))
    return out.withColumn("mean_abs_shap", F.round("mean_abs_shap", 9))


@query("rank_shift", _IMPORTANCE_SQL + """, b AS (
  SELECT feature, row_number() OVER (ORDER BY avg(abs(v)) DESC, feature)::INTEGER AS base_rank
  FROM long WHERE split = 'train' AND feature <> 'shap_cds_length' GROUP BY 1),
n AS (
  SELECT feature, row_number() OVER (ORDER BY avg(abs(v)) DESC, feature)::INTEGER AS new_rank
  FROM long WHERE split <> 'train' GROUP BY 1)
SELECT feature, base_rank, new_rank, base_rank - new_rank AS shift,
       CASE WHEN base_rank IS NULL THEN 'NEW' WHEN new_rank IS NULL THEN 'DROPPED'
            WHEN base_rank > new_rank THEN 'up' WHEN base_rank < new_rank THEN 'down'
            ELSE 'same' END AS status
FROM b FULL JOIN n USING (feature)""")
def rank_shift(spark, d):
    from condensq.operators.explain import global_importance

    rows = attribution_rows(spark, d).join(S.genes(spark, d).select("gene_id", "split"), "gene_id")
    base = rows.where("split = 'train' AND feature <> 'shap_cds_length'")
    return metrics.rank_shift(
        global_importance(base), global_importance(rows.where("split <> 'train'"))
    )
