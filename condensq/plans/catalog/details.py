"""Second modes and inner parts of operators whose main results other entries compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from condensq.functions.sequence import length_normalise
from condensq.operators import aggregates as agg
from condensq.operators import labelling as B
from condensq.operators import metrics as M
from condensq.operators import models as L
from condensq.operators import retrieval as P
from condensq.operators import splits as K
from condensq.operators import tables
from condensq.operators import transcripts as T
from condensq.operators.lookup import lookup
from condensq.operators.ranking import row_numbers, with_tied_bucket
from condensq.plans import marts
from condensq.plans import star as S
from condensq.plans.catalog import query
from condensq.plans.catalog.formats import _annotation_file, _folder
from condensq.plans.catalog.labels import _RESOLVED, blocks, protein
from condensq.plans.catalog.learning import matrix, once
from condensq.plans.catalog.text import _TOP3, attribution_arrays
from condensq.plans.star import EXONS_SQL, PREDICTIONS_SQL, SCORED, STAR_SQL, locus_sql, with_sql
from condensq.sources import records as R
from condensq.sources import tables as IO

# Files ---------------------------------------------------------------------------------------


@query("csv_table_scan", """
SELECT s_suppkey::BIGINT AS s_suppkey, s_name, CASE WHEN s_nationkey % 4 > 0 THEN s_acctbal END AS s_acctbal
FROM supplier""")
def csv_table_scan(spark, d):
    """A CSV file with a header, NaN for missing numbers, read by its suffix."""
    s = S.table(spark, d, "supplier")
    number = F.when(F.col("s_nationkey") % 4 > 0, F.col("s_acctbal")).otherwise(F.lit(float("nan")))
    path = f"{_folder(spark)}/suppliers.csv"
    s.select("s_suppkey", "s_name", number.alias("s_acctbal")).write.option("header", True).csv(path)
    return IO.read_table(spark, path, "s_suppkey bigint, s_name string, s_acctbal double")


@query("bi_export", """
SELECT 'landscape' AS part, p_partkey::VARCHAR AS key, p_retailprice AS number FROM part
UNION ALL SELECT 'importance', s_name, s_acctbal FROM supplier
UNION ALL SELECT 'history', n_name, n_nationkey::DOUBLE FROM nation""")
def bi_export(spark, d):
    """The three flat tables for reporting tools, read back."""
    path = _folder(spark)
    IO.export_bi(
        S.table(spark, d, "supplier").select("s_name", "s_acctbal"),
        S.table(spark, d, "part").select("p_partkey", "p_retailprice"),
        S.table(spark, d, "nation").select("n_name", F.col("n_nationkey").cast("double").alias("k")), path,
    )
    out = None
    for part, folder in (("landscape", "probability_landscape"), ("importance", "feature_importance"),
                         ("history", "pipeline_history")):
        rows = spark.read.option("header", True).csv(f"{path}/{folder}").toDF("key", "number")
        rows = rows.select(F.lit(part).alias("part"), "key", F.col("number").cast("double").alias("number"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("annotation_not_found", with_sql(EXONS_SQL) + """
SELECT o_orderkey::VARCHAR || CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '' END AS transcript_id
FROM orders WHERE o_orderstatus = 'F' AND (o_orderkey % 3 = 0 OR o_orderkey NOT IN (SELECT transcript_id FROM exons))""")
def annotation_not_found(spark, d):
    """Wanted transcripts that an annotation file does not have."""
    want = S.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(
        F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise("")
    ).alias("transcript_id"))
    _, missing = R.filter_annotation(R.read_annotation(spark, _annotation_file(spark, d)), want)
    return missing


@query("transcript_kinds", with_sql(EXONS_SQL) + """
SELECT gene_id::VARCHAR AS gene_id, transcript_id::VARCHAR AS transcript_id, count(*) AS n_exons,
       CASE WHEN transcript_id % 3 > 0 THEN 'protein_coding' ELSE 'ncRNA' END AS biotype,
       transcript_id % 5 = 0 AS is_canonical
FROM exons GROUP BY 1, 2, 4, 5""")
def transcript_kinds(spark, d):
    """Biotype and canonical flag, which only the transcript lines of an annotation have."""
    x = S.exons(spark, d)
    ids = {c: F.col(c).cast("string") for c in ("gene_id", "transcript_id")}

    def attrs(more):
        pairs = [v for k, c in {**ids, **more}.items() for v in (F.lit(k), c)]
        return F.create_map(*pairs).alias("attrs")

    place = ["start", "end", F.col("contig").alias("seqname"), "strand"]
    exons = x.select(F.lit("exon").alias("feature"), *place, attrs({}))
    tx = x.groupBy("gene_id", "transcript_id", "contig", "strand").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    )
    number = F.col("transcript_id")
    lines = tx.select(F.lit("transcript").alias("feature"), *place, attrs({
        "transcript_biotype": F.when(number % 3 > 0, "protein_coding").otherwise("ncRNA"),
        "tag": F.when(number % 5 == 0, "Ensembl_canonical").otherwise("basic"),
    }))
    out = T.transcript_meta(exons.unionByName(lines))
    return out.select("gene_id", "transcript_id", "n_exons", "biotype", "is_canonical")


# Labels and tables ---------------------------------------------------------------------------

@query("conflict_strategies", _RESOLVED + """
SELECT gene_id, s AS strategy, is_pos AND NOT (is_neg AND s <> 'enriched') AS keep_pos,
       is_neg AND NOT (is_pos AND s <> 'depleted') AS keep_neg,
       CASE WHEN is_pos AND is_neg THEN CASE s WHEN 'enriched' THEN 'kept_as_positive'
         WHEN 'depleted' THEN 'kept_as_negative' ELSE 'dropped' END END AS disposition
FROM sides, (VALUES ('enriched'), ('depleted'), ('drop')) t(s)""")
def conflict_strategies(spark, d):
    rna = B.rna_evidence(blocks(spark, d)).join(
        protein(spark, d).select(
            "gene_id", B.any_ge([F.col(c) for c in B.PROTEIN_SIGNALS], 0.0).alias("hit")
        ), "gene_id", "left",
    )
    pos = (F.col("enriched_ns") | F.col("enriched_hs")) & F.coalesce("hit", F.lit(False))
    neg = F.col("depleted_ns") | F.col("depleted_hs")
    out = None
    for s in ("enriched", "depleted", "drop"):
        one = B.resolve_conflicts(rna, pos, neg, ["log2fc_ns", "log2fc_hs"], s).select(
            "gene_id", F.lit(s).alias("strategy"), "keep_pos", "keep_neg", "disposition"
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("labelled_order", _RESOLVED + """, kept AS (
  SELECT *, is_pos AND NOT (is_neg AND up < down) AS p FROM sides WHERE is_pos OR is_neg),
r AS (SELECT gene_id, CASE WHEN p THEN 1 ELSE 0 END AS class,
             greatest(abs(coalesce(log2fc_ns, 0)), abs(coalesce(log2fc_hs, 0))) AS strength FROM kept)
SELECT gene_id, row_number() OVER (ORDER BY class DESC, strength DESC, gene_id) AS position FROM r""")
def labelled_order(spark, d):
    """Place of each gene in the sorted label table, without a task that holds them all."""
    out = B.build_labels(B.rna_evidence(blocks(spark, d)), protein(spark, d))
    # Rising with the order: negatives come after all positives.
    place = -F.col("class").cast("double") * 1e6 - F.col("strongest_rna_log2fc")
    work = with_tied_bucket(out.withColumn("_place", place), F.col("_place"), F.lit(0))
    order = [F.col("class").desc(), F.col("strongest_rna_log2fc").desc(), F.col("gene_id")]
    return row_numbers(work, order, F.col("_range"), name="position").select("gene_id", "position")


@query("availability_by_status", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS has_dynamic FROM orders""")
def availability_by_status(spark, d):
    o = S.table(spark, d, "orders").withColumn("status", F.when(
        F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed"))
    return o.select("o_orderkey", tables.has_dynamic(o).alias("has_dynamic"))


@query("class_weight_ratio", SCORED + """
, n AS (SELECT count(*) FILTER (class = 1) AS p, count(*) FILTER (class = 0) AS q FROM scored)
SELECT class, count(*) AS n_c, round(CASE class WHEN 1 THEN (SELECT q::DOUBLE / p FROM n) ELSE 1 END, 9) AS weight
FROM scored GROUP BY class""")
def class_weight_ratio(spark, d):
    out = agg.class_weights(S.scored(spark, d), mode="ratio")
    return out.withColumn("weight", F.round("weight", 9))


@query("stemloops_per_kb", """
SELECT p_partkey, round(CASE WHEN p_size % 7 > 0 THEN p_size / (p_size % 7 * 100 / 1000.0::DOUBLE) END, 9)
       AS n_stemloops_per_kb, round(coalesce(p_size::DOUBLE / nullif(p_size % 7 * 100, 0), 0), 9) AS utr5_fraction
FROM part""")
def stemloops_per_kb(spark, d):
    part = S.table(spark, d, "part").select(
        "p_partkey", F.col("p_size").alias("n_stemloops"), F.col("p_size").alias("utr5_length"),
        (F.col("p_size") % 7 * 100).alias("mrna_length"),
    )
    out = length_normalise(part)
    return out.select("p_partkey", *[F.round(c, 9).alias(c) for c in ("n_stemloops_per_kb", "utr5_fraction")])


@query("mapped_values", """
SELECT o_orderkey, coalesce(c_mktsegment, 'unknown') AS segment FROM orders LEFT JOIN
  (SELECT * FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey""")
def mapped_values(spark, d):
    o = S.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    c = S.table(spark, d, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment")
    )
    return tables.map_values(o, c, "key", "segment", "unknown").select("o_orderkey", "segment")


@query("common_ids", """
SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def common_ids(spark, d):
    a = S.table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"))
    b = S.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"))
    return tables.keep_common(a, b, "custkey")


@query("top_in_category", """
SELECT category, feature, value FROM (
  SELECT p_brand AS category, p_partkey AS feature, p_retailprice AS value,
         row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part)
WHERE k <= 7""")
def top_in_category(spark, d):
    """The first features of every category; a report of a fixed length."""
    part = S.table(spark, d, "part").select(
        F.col("p_brand").alias("category"), F.col("p_partkey").alias("feature"),
        F.col("p_retailprice").alias("value"),
    )
    names = [r["category"] for r in part.select("category").distinct().collect()]  # a few dozen brands
    out = None
    for name in names:
        one = tables.top_in_category(part, name, "value", 7)
        out = one if out is None else out.unionByName(one)
    return out


@query("head_rows", """
SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 12""")
def head_rows(spark, d):
    """The first rows of a sorted table; all of them where no number is given."""
    s = S.table(spark, d, "supplier").select("s_suppkey", "s_acctbal").orderBy("s_acctbal", "s_suppkey")
    return tables.head_n(tables.head_n(s, None), 12)


@query("monitored_rows", SCORED + """
SELECT 'all' AS batch, gene_id FROM scored
UNION ALL SELECT 'sample', gene_id FROM (
  SELECT gene_id FROM scored ORDER BY md5(gene_id || '|42'), gene_id LIMIT 50)""")
def monitored_rows(spark, d):
    """The rows a drift report looks at: all, or a repeatable sample of a fixed size."""
    rows = S.scored(spark, d).select("gene_id")
    every, some = K.current_batch(rows, "gene_id", None), K.current_batch(rows, "gene_id", 50)
    return every.select(F.lit("all").alias("batch"), "gene_id").unionByName(
        some.select(F.lit("sample").alias("batch"), "gene_id")
    )


@query("missing_columns", "SELECT unnest(['rmsf_mean', 'rrach_count']) AS feature")
def missing_columns(spark, d):
    """Wanted columns that a feature matrix lacks."""
    f = S.features(spark, d).withColumn("ord", F.col("mrna_length")).drop("rmsf_mean", "rrach_count")
    table, missing = marts.build_features(f, "ord")
    absent = [c for c in missing if c not in table.columns]
    wanted = S.features(spark, d).columns
    return spark.createDataFrame([(c,) for c in sorted(absent) if c in wanted], "feature string")


# Scores and evidence -------------------------------------------------------------------------

_SHAP = """, l AS (
  UNPIVOT (SELECT gene_id, shap_mrna_length AS mrna_length, shap_cds_length AS cds_length, "shap_di_CG" AS "di_CG",
           shap_utr3_au_content AS utr3_au_content, shap_rrach_per_kb AS rrach_per_kb, shap_rmsf_nterm50 AS rmsf_nterm50
    FROM predictions) ON mrna_length, cds_length, "di_CG", utr3_au_content, rrach_per_kb, rmsf_nterm50
  INTO NAME feature VALUE v)"""


@query("lookup_attributions", STAR_SQL + f"""
, ids AS (SELECT {locus_sql('c_custkey')} AS gene_id FROM customer){_SHAP}
SELECT gene_id, feature, round_even(v, 6) AS shap FROM ids JOIN l USING (gene_id) WHERE v IS NOT NULL""")
def lookup_attributions(spark, d):
    """Names and values of the attributions that a lookup returns."""
    ids = S.customers(spark, d).select(F.lower("gene_id").alias("gene_id"))
    out = lookup(ids, S.predictions(spark, d)).where("top_shap IS NOT NULL")
    return out.select("gene_id", F.explode("top_shap").alias("feature", "shap"))


@query("evidence_parts", with_sql(PREDICTIONS_SQL) + _TOP3 + f""", docs AS (
  SELECT {locus_sql('doc_id')} AS gene_id, source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents),
ids AS (SELECT {locus_sql('doc_id')} AS gene_id FROM labels),
f AS (SELECT gene_id, string_agg(feature, ',' ORDER BY k) AS strongest FROM o GROUP BY 1)
SELECT gene_id, strongest, source, CASE WHEN length(flat) <= 400 THEN flat
       ELSE regexp_replace(substr(flat, 1, 400), '\\s?\\S*$', '') || '…' END AS snippet
FROM ids LEFT JOIN f USING (gene_id) LEFT JOIN docs USING (gene_id)""")
def evidence_parts(spark, d):
    """The evidence itself: features by strength, source and shortened passage."""
    docs = S.documents(spark, d)
    hits = docs.select(
        S.locus(F.col("doc_id")).alias("gene_id"), F.lit(1).alias("rank"), "source",
        F.lit(0).alias("page"), F.lit(1.0).alias("score"), "text",
    )
    ids = S.table(spark, d, "labels").select(S.locus(F.col("doc_id")).alias("gene_id"))
    out = P.evidence_table(ids, S.predictions(spark, d).select("gene_id", "prob_pos", "pred"),
                           attribution_arrays(spark, d), hits)
    names = F.transform(F.filter("attributions", lambda a: a.attribution.isNotNull()), lambda a: a.feature)
    first = F.get("passages", 0)
    return out.select(
        "gene_id", F.when(F.size(names) > 0, F.array_join(names, ",")).alias("strongest"),
        first["source"].alias("source"), first["snippet"].alias("snippet"),
    )


@query("page_numbers", r"""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, (i - 1)::INTEGER AS page, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM p)
WHERE regexp_matches(l[i], '[\p{L}\p{N}]')""")
def page_numbers(spark, d):
    """Pages of paged texts (here a line is a page) with their numbers."""
    docs = S.documents(spark, d).select("doc_id", F.translate("text", "\n", "\f").alias("text"))
    return P.page_texts(docs)


@query("suspicious_in_band", SCORED + """
SELECT gene_id, prob_pos FROM scored WHERE class = 0 AND prob_pos BETWEEN 0.1 AND 0.9""")
def suspicious_in_band(spark, d):
    """Doubtful negatives of all splits within a wide band, so that there are some."""
    return M.suspicious_labels(S.scored(spark, d), 0.1, 0.9).select("gene_id", "prob_pos")


@query("imputed_values", STAR_SQL + """
, t AS (SELECT gene_id, split, rmsf_nterm50, idr_percent FROM features JOIN genes USING (gene_id) WHERE class >= 0),
m AS (SELECT p, median(rmsf_nterm50) AS r, median(idr_percent) AS i FROM t, (VALUES ('train'), ('all')) v(p)
      WHERE p = 'all' OR split = 'train' GROUP BY 1)
SELECT gene_id, p AS policy, round(coalesce(rmsf_nterm50, r), 6) AS rmsf_nterm50,
       round(coalesce(idr_percent, i), 6) AS idr_percent, NULL::DOUBLE AS missing FROM t, m
UNION ALL SELECT gene_id, 'none', round(coalesce(rmsf_nterm50, 0), 6), round(coalesce(idr_percent, 0), 6),
       (rmsf_nterm50 IS NULL)::INTEGER::DOUBLE FROM t""")
def imputed_values(spark, d):
    """Rows as each of the three policies fills them."""
    cols, out = ["rmsf_nterm50", "idr_percent"], None
    for policy in ("train", "all", "none"):
        rows, _ = L.imputation_policy(matrix(spark, d).select("gene_id", "split", *cols), cols, policy)
        flag = F.col("rmsf_nterm50_missing") if policy == "none" else F.lit(None).cast("double")
        one = rows.select("gene_id", F.lit(policy).alias("policy"), *[F.round(c, 6).alias(c) for c in cols],
                          flag.alias("missing"))
        out = one if out is None else out.unionByName(one)
    return out


@query("bundle_roundtrip", STAR_SQL + """
SELECT gene_id, true AS same_score, true AS same_medians FROM features JOIN genes USING (gene_id) WHERE class >= 0""")
def bundle_roundtrip(spark, d):
    """A saved scoring bundle, loaded again, scores every row as before."""
    from condensq.plans.catalog.learning import request_bundle

    bundle = request_bundle(spark, d)

    def saved():
        path = f"{_folder(spark)}/bundle"
        L.save_bundle(bundle, path, spark)
        return path

    again = L.load_bundle(once(spark, d, "saved bundle", saved), spark)
    fixed = again.features == bundle.features and again.medians == bundle.medians
    rows = L.impute(matrix(spark, d), bundle.medians)
    one = L.score(rows, bundle.model).drop("pred", "correct", "pred_error").withColumnRenamed("prob_pos", "before")
    both = L.score(one, again.model)
    return both.select("gene_id", (F.col("before") == F.col("prob_pos")).alias("same_score"),
                       F.lit(fixed).alias("same_medians"))
