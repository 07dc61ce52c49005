"""Label construction, quality flags and sequence features."""

from __future__ import annotations

from pyspark.sql import functions as F

from condensq.functions import labels as L
from condensq.functions import sequence as Q
from condensq.operators import aggregates as agg
from condensq.operators import labelling as B
from condensq.operators import tables
from condensq.plans import star as S
from condensq.plans.catalog import query
from condensq.plans.star import STAR_SQL, h_sql, locus_sql, with_sql

_BLOCKS = {
    name: [f"{name}_id", f"{name}_text", f"{name}_fc_ns", f"{name}_fc_hs"] for name in B.LISTS
}
_NAMES = ["gene_id", "description", "log2fc_ns", "log2fc_hs"]


def sheet(spark, d):
    """Four side-by-side blocks per row, cells partly unusable, as a spreadsheet has them."""
    o = S.table(spark, d, "orders")
    gid = S.locus(F.col("o_custkey"))
    prio, status, key = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey")
    member = {
        "enriched_ns": prio.isin("1-URGENT", "2-HIGH") & (key % 4 != 0),
        "enriched_hs": (status == "F") & (key % 4 != 1),
        "depleted_ns": (prio == "5-LOW") & (key % 6 == 0),
        "depleted_hs": (status == "P") & (key % 8 == 0),
    }
    fc_ns = (F.floor(F.col("o_totalprice") / 1000) - 250) / F.lit(100.0)
    fc_hs = (F.floor(F.col("o_totalprice") / 7) % 1000 - 500) / F.lit(100.0)
    cells = []
    for name, hit in member.items():
        cells += [
            F.when(hit, gid).otherwise("n/a").alias(f"{name}_id"),
            F.concat(F.lit("order "), key).alias(f"{name}_text"),
            F.when(key % 17 == 0, "n.d.").otherwise(fc_ns.cast("string")).alias(f"{name}_fc_ns"),
            F.when(key % 19 != 0, fc_hs.cast("string")).alias(f"{name}_fc_hs"),
        ]
    return o.select(key.alias("row"), *cells)


def blocks(spark, d):
    return B.unpivot_blocks(sheet(spark, d), _BLOCKS, _NAMES, "row")


def protein(spark, d):
    c = S.customers(spark, d)
    bal, n = F.col("c_acctbal"), F.col("c_nationkey")
    return c.select(
        "gene_id", F.col("c_name").alias("description_prot"),
        F.when(n % 3 == 0, (bal - 8000) / 1000).alias("log2fc_ap_ns"),
        F.when(n % 3 == 1, (bal - 5000) / 1000).alias("log2fc_ap_hs"),
        F.when(n % 5 == 0, (bal - 2000) / 1000).alias("log2fc_pdl_ns"),
        F.lit(None).cast("double").alias("log2fc_pdl_hs"),
    )


_FC_NS = "CASE WHEN o_orderkey % 17 <> 0 THEN (floor(o_totalprice / 1000)::BIGINT - 250) / 100.0::DOUBLE END"
_FC_HS = ("CASE WHEN o_orderkey % 19 <> 0 THEN (floor(o_totalprice / 7)::BIGINT % 1000 - 500) "
          "/ 100.0::DOUBLE END")
_MEMBER = {
    "enriched_ns": "o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 4 <> 0",
    "enriched_hs": "o_orderstatus = 'F' AND o_orderkey % 4 <> 1",
    "depleted_ns": "o_orderpriority = '5-LOW' AND o_orderkey % 6 = 0",
    "depleted_hs": "o_orderstatus = 'P' AND o_orderkey % 8 = 0",
}
_BLOCKS_SQL = "blocks AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS list_name, {i} AS li, o_orderkey AS ord, {locus_sql('o_custkey')} AS gene_id, "
    f"'order ' || o_orderkey AS description, {_FC_NS} AS ns, {_FC_HS} AS hs FROM orders WHERE {w}"
    for i, (n, w) in enumerate(_MEMBER.items())
) + ")"
_EVIDENCE_SQL = """evidence AS (
  SELECT gene_id, arg_min(description, li * 1000000000000 + ord) AS description,
         arg_min(ns, li * 1000000000000 + ord) FILTER (ns IS NOT NULL) AS log2fc_ns,
         arg_min(hs, li * 1000000000000 + ord) FILTER (hs IS NOT NULL) AS log2fc_hs,
         bool_or(list_name = 'enriched_ns') AS enriched_ns,
         bool_or(list_name = 'enriched_hs') AS enriched_hs,
         bool_or(list_name = 'depleted_ns') AS depleted_ns,
         bool_or(list_name = 'depleted_hs') AS depleted_hs
  FROM blocks GROUP BY gene_id)"""
_PROTEIN_SQL = f"""protein AS (
  SELECT {locus_sql('c_custkey')} AS gene_id,
         CASE WHEN c_nationkey % 3 = 0 THEN (c_acctbal - 8000) / 1000 END AS ap_ns,
         CASE WHEN c_nationkey % 3 = 1 THEN (c_acctbal - 5000) / 1000 END AS ap_hs,
         CASE WHEN c_nationkey % 5 = 0 THEN (c_acctbal - 2000) / 1000 END AS pdl_ns
  FROM customer)"""
_JOINED_SQL = """joined AS (
  SELECT e.*, coalesce(ap_ns >= 0, false) OR coalesce(ap_hs >= 0, false)
         OR coalesce(pdl_ns >= 0, false) AS hit,
         greatest(coalesce(log2fc_ns, 0), coalesce(log2fc_hs, 0), 0) AS up,
         abs(least(coalesce(log2fc_ns, 0), coalesce(log2fc_hs, 0), 0)) AS down
  FROM evidence e LEFT JOIN protein USING (gene_id)),
sides AS (
  SELECT *, (enriched_ns OR enriched_hs) AND hit AS is_pos, depleted_ns OR depleted_hs AS is_neg
  FROM joined)"""


@query("block_unpivot", with_sql(_BLOCKS_SQL) + """
SELECT list_name, gene_id, description, ns AS log2fc_ns, hs AS log2fc_hs FROM blocks""")
def block_unpivot(spark, d):
    out = blocks(spark, d)
    return out.select("list_name", "gene_id", "description", *[
        B.to_number(F.col(c)).alias(c) for c in ("log2fc_ns", "log2fc_hs")])


@query("membership_merge", with_sql(_BLOCKS_SQL, _EVIDENCE_SQL) + "SELECT * FROM evidence")
def membership_merge(spark, d):
    return B.rna_evidence(blocks(spark, d))


@query("any_ge", with_sql(_PROTEIN_SQL) + """
SELECT gene_id, coalesce(ap_ns >= 0.75, false) OR coalesce(ap_hs >= 0.75, false)
       OR coalesce(pdl_ns >= 0.75, false) AS protein_enriched
FROM protein""")
def any_ge(spark, d):
    cols = [F.col(c) for c in B.PROTEIN_SIGNALS]
    return protein(spark, d).select("gene_id", B.any_ge(cols, 0.75).alias("protein_enriched"))


_RESOLVED = with_sql(_BLOCKS_SQL, _EVIDENCE_SQL, _PROTEIN_SQL, _JOINED_SQL)


@query("conflict_resolution", _RESOLVED + """
SELECT gene_id, is_pos AND NOT (is_neg AND up < down) AS keep_pos,
       is_neg AND NOT (is_pos AND up >= down) AS keep_neg, is_pos AND is_neg AS conflict_resolved,
       CASE WHEN is_pos AND is_neg THEN
         CASE WHEN up >= down THEN printf('kept_as_positive (enr=%.2f > dep=%.2f)', up, down)
              ELSE printf('kept_as_negative (dep=%.2f > enr=%.2f)', down, up) END END AS disposition
FROM sides""")
def conflict_resolution(spark, d):
    rna = B.rna_evidence(blocks(spark, d)).join(
        protein(spark, d).select(
            "gene_id", B.any_ge([F.col(c) for c in B.PROTEIN_SIGNALS], 0.0).alias("hit")
        ), "gene_id", "left",
    )
    pos = (F.col("enriched_ns") | F.col("enriched_hs")) & F.coalesce("hit", F.lit(False))
    neg = F.col("depleted_ns") | F.col("depleted_hs")
    out = B.resolve_conflicts(rna, pos, neg, ["log2fc_ns", "log2fc_hs"])
    return out.select("gene_id", "keep_pos", "keep_neg", "conflict_resolved", "disposition")


@query("condition_label", _RESOLVED + """, kept AS (
  SELECT *, is_pos AND NOT (is_neg AND up < down) AS p FROM sides WHERE is_pos OR is_neg)
SELECT gene_id, CASE WHEN p THEN 1 ELSE 0 END AS class,
       CASE WHEN NOT p THEN 'depleted' WHEN enriched_ns AND enriched_hs THEN 'both'
            WHEN enriched_ns THEN 'NS' ELSE 'HS' END AS condition,
       greatest(abs(coalesce(log2fc_ns, 0)), abs(coalesce(log2fc_hs, 0))) AS strongest_rna_log2fc
FROM kept""")
def condition_label(spark, d):
    out = B.build_labels(B.rna_evidence(blocks(spark, d)), protein(spark, d))
    return B.sort_labelled(out).select("gene_id", "class", "condition", "strongest_rna_log2fc")


# Quality and tiers ---------------------------------------------------------------------------

_PROT = ("regexp_replace(upper(regexp_replace(text, '[^A-Za-z.]', '', 'g')), '[BJOUXZ]', '', 'g')")


def proteins(spark, d):
    """Amino-acid letters of each labelled text; `.` stands for a stop."""
    docs = S.table(spark, d, "documents")
    lab = S.table(spark, d, "labels").select("doc_id", F.lit(True).alias("known"))
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z.]", ""))
    aa = F.regexp_replace(letters, "[BJOUXZ]", "")
    return docs.join(lab, "doc_id", "left").select(
        "doc_id", "n_chars", "lang", F.when(F.col("known"), aa).otherwise("").alias("protein")
    )


@query("qc_cascade", f"""
WITH p AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN '' ELSE {_PROT} END AS protein
           FROM documents d LEFT JOIN labels l USING (doc_id)),
f AS (SELECT doc_id, length(protein) AS protein_len,
             CASE WHEN length(protein) = 0 THEN 'no_CDS' WHEN length(protein) < 30
                  THEN 'short_protein'
                  WHEN contains(left(protein, (length(protein) - 1)::INTEGER), '.')
                  THEN 'internal_stop_codon' ELSE 'pass' END AS qc_flag FROM p)
SELECT *, protein_len > 0 AS has_cds, qc_flag = 'pass' AS qc_pass FROM f""")
def qc_cascade(spark, d):
    p = proteins(spark, d)
    return p.select(
        "doc_id", F.length("protein").alias("protein_len"),
        L.qc_flag(F.col("protein")).alias("qc_flag"),
    ).withColumns({"has_cds": F.col("protein_len") > 0, "qc_pass": F.col("qc_flag") == "pass"})


@query("tiering", STAR_SQL + """
SELECT gene_id, CASE WHEN idr_percent < 10 THEN 1 WHEN idr_percent < 30 THEN 2 ELSE 3 END AS tier,
       CASE WHEN idr_percent < 10 THEN 100 WHEN idr_percent < 30 THEN 50 ELSE 100 END AS n_conf
FROM features""")
def tiering(spark, d):
    return tiers(spark, d)


def tiers(spark, d):
    f = S.features(spark, d).select("gene_id", L.assign_tier(F.col("idr_percent")).alias("tier"))
    return f.withColumn("n_conf", L.tier_budget(F.col("tier")))


@query("tier_budget", STAR_SQL + """
SELECT sum(CASE WHEN idr_percent < 10 THEN 0 WHEN idr_percent < 30 THEN 50 ELSE 100 END)::BIGINT
       AS total_samples FROM features""")
def tier_budget(spark, d):
    return agg.budget_total(tiers(spark, d))


_REFERENCE_SQL = f"""reference AS (
  SELECT {locus_sql('doc_id')} AS gene_id,
         CASE toxic * 2 + quality WHEN 0 THEN 'NUMT_contaminant' WHEN 1 THEN 'flanking_real_gene'
              WHEN 2 THEN 'ambiguous' ELSE 'other' END AS classification FROM labels)"""


@query("quarantine", with_sql(S.SEQ_SQL, S.GENES_SQL, _REFERENCE_SQL) + """
SELECT gene_id, class,
       CASE WHEN classification = 'NUMT_contaminant' THEN 'EXCLUDE'
            WHEN classification = 'ambiguous' THEN 'HELD_OUT'
            WHEN classification IS NOT NULL THEN 'RETAIN'
            WHEN gene_id LIKE 'AT2G000%' THEN 'EXCLUDE' ELSE 'RETAIN' END AS decision,
       CASE WHEN classification = 'NUMT_contaminant' THEN 'NUMT_contaminant (CSV)'
            WHEN classification = 'flanking_real_gene' THEN 'flanking_real_gene (CSV)'
            WHEN classification = 'ambiguous' THEN 'ambiguous (CSV) — manual review required'
            WHEN classification IS NOT NULL THEN 'unknown_csv_class=' || classification
            WHEN gene_id LIKE 'AT2G000%' THEN
              'AT2G06/07xxx not in NUMT CSV — precautionary (pericentromeric)'
            ELSE 'not_pericentromeric' END AS reason
FROM genes LEFT JOIN reference USING (gene_id)""")
def quarantine(spark, d):
    kind = F.element_at(
        F.array(*[F.lit(x) for x in ("NUMT_contaminant", "flanking_real_gene", "ambiguous", "other")]),
        F.col("toxic") * 2 + F.col("quality") + 1,
    )
    ref = S.table(spark, d, "labels").select(
        S.locus(F.col("doc_id")).alias("gene_id"), kind.alias("classification")
    )
    genes = S.genes(spark, d).select("gene_id", "class")
    return B.quarantine(genes, ref, ("AT2G000",))


@query("missing_profile", STAR_SQL + """, n AS (SELECT count(*) AS n,
  count(*) - count(rmsf_mean) AS rmsf_mean, count(*) - count(idr_percent) AS idr_percent,
  count(*) - count(rmsf_nterm_cterm_ratio) AS rmsf_nterm_cterm_ratio FROM features),
l AS (UNPIVOT n ON rmsf_mean, idr_percent, rmsf_nterm_cterm_ratio INTO NAME feature VALUE n_missing)
SELECT feature, n_missing, n_missing * 100.0::DOUBLE / n AS pct_missing,
       CASE WHEN n_missing = 0 THEN 'complete' WHEN n_missing * 100.0 / n > 10 THEN 'over_10'
            WHEN n_missing * 100.0 / n > 5 THEN 'over_5' ELSE 'up_to_5' END AS band
FROM l""")
def missing_profile(spark, d):
    return tables.missing_profile(
        S.features(spark, d), ["rmsf_mean", "idr_percent", "rmsf_nterm_cterm_ratio"]
    )


@query("confidence", with_sql(S.PREDICTIONS_SQL) + """
SELECT gene_id, CASE WHEN prob_pos >= 0.75 THEN 'high' WHEN prob_pos >= 0.55 THEN 'medium'
                     ELSE 'low' END AS confidence,
       CASE WHEN prob_pos >= 0.75 OR prob_pos <= 0.25 THEN 'High'
            WHEN prob_pos >= 0.55 OR prob_pos <= 0.45 THEN 'Medium' ELSE 'Low' END AS symmetric,
       CASE WHEN pred = 1 THEN 'enriched' ELSE 'not_enriched' END AS prediction
FROM predictions""")
def confidence(spark, d):
    p = F.col("prob_pos")
    return S.predictions(spark, d).select(
        "gene_id", L.confidence(p).alias("confidence"), L.confidence_symmetric(p).alias("symmetric"),
        L.label_text(F.col("pred")).alias("prediction"),
    )


@query("decisions", S.SCORED + """
SELECT gene_id, CASE WHEN prob_pos >= 0.56 THEN 1 ELSE 0 END AS pred_56,
       CASE WHEN pred = class THEN 1 ELSE 0 END AS correct,
       round(abs(prob_pos - class), 9) AS pred_error FROM scored""")
def decisions(spark, d):
    p = F.col("prob_pos")
    return S.scored(spark, d).select(
        "gene_id", L.decide(p, 0.56).alias("pred_56"),
        (F.col("pred") == F.col("class")).cast("int").alias("correct"),
        F.round(F.abs(p - F.col("class")), 9).alias("pred_error"),
    )


@query("availability", STAR_SQL + """
SELECT gene_id, CASE WHEN rmsf_mean IS NOT NULL OR rmsf_nterm50 IS NOT NULL
                      OR rmsf_cterm50 IS NOT NULL THEN 1 ELSE 0 END AS has_dynamic
FROM features""")
def availability(spark, d):
    f = S.features(spark, d)
    return f.select("gene_id", tables.has_dynamic(f, "values").alias("has_dynamic"))


@query("short_names", """
SELECT s_suppkey, s_name AS short_name, s_name || ':p, made by ' || s_nationkey AS description
FROM supplier""")
def short_names(spark, d):
    s = S.table(spark, d, "supplier")
    text = F.concat("s_name", F.lit(":p, made by "), "s_nationkey")
    return s.select("s_suppkey", L.short_name(text).alias("short_name"), text.alias("description"))


@query("valid_ids", f"""
SELECT doc_id, regexp_full_match(trim(raw), 'AT\\d.{{6,}}') AS valid FROM (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' ' || {locus_sql('doc_id')} || ' '
    WHEN 1 THEN lower({locus_sql('doc_id')}) WHEN 2 THEN 'AT1G' || doc_id
    ELSE {locus_sql('doc_id')} END AS raw FROM documents)""")
def valid_ids(spark, d):
    k = F.col("doc_id")
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit(" "), S.locus(k), F.lit(" ")))
        .when(k % 4 == 1, F.lower(S.locus(k)))
        .when(k % 4 == 2, F.concat(F.lit("AT1G"), k)).otherwise(S.locus(k))
    )
    return S.table(spark, d, "documents").select("doc_id", L.valid_gene_id(raw).alias("valid"))


# Sequence features ---------------------------------------------------------------------------

_SEQ = with_sql(S.SEQ_SQL)
_FEATS = STAR_SQL


@query("composition", _FEATS + """
SELECT gene_id, mrna_length, "fA", "fU", "fG", "fC", au_content, gc_content FROM features""")
def composition(spark, d):
    s = S.sequences(spark, d)
    return s.select("gene_id", *[c.alias(n) for n, c in Q.composition(F.col("seq")).items()])


@query("dinucleotides", _SEQ + f"SELECT gene_id, {S.DINUCLEOTIDE_SQL} FROM seqs")
def dinucleotides(spark, d):
    s = S.sequences(spark, d)
    return s.select("gene_id", *[c.alias(n) for n, c in Q.dinucleotides(F.col("seq")).items()])


@query("motif_counts", _FEATS + """
SELECT gene_id, rrach_count, rrach_per_kb, aaach_count, aaach_per_kb FROM features""")
def motif_counts(spark, d):
    s = S.sequences(spark, d)
    return s.select("gene_id", *[c.alias(n) for n, c in Q.motif_counts(F.col("seq")).items()])


@query("tail_au", _SEQ + """, t AS (
  SELECT gene_id, seq, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 0 END AS len3,
         length(seq) AS n FROM seqs),
u AS (SELECT *, CASE WHEN n = 0 THEN 0 WHEN len3 > 0 THEN len3
             ELSE greatest(floor(n * 0.2::DOUBLE)::BIGINT, 50) END AS k FROM t),
v AS (SELECT *, CASE WHEN k >= n THEN seq ELSE right(seq, k::INTEGER) END AS tail FROM u)
SELECT gene_id, k AS utr3_length, NOT (len3 > 0 AND n > 0) AS utr3_estimated,
       round_even(coalesce((length(tail) - length(translate(tail, 'AU', '')))::DOUBLE
                  / nullif(length(tail), 0), 0), 4) AS utr3_au_content
FROM v""")
def tail_au(spark, d):
    len3 = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(0)
    out = Q.add_tail(S.sequences(spark, d), "seq", len3)
    return out.select("gene_id", "utr3_length", "utr3_estimated", "utr3_au_content")


@query("region_estimates", _FEATS + """
SELECT gene_id, cds_length, utr5_length, utr3_length FROM features""")
def region_estimates(spark, d):
    return S.features(spark, d).select("gene_id", "cds_length", "utr5_length", "utr3_length")


@query("decay_flags", """
WITH t AS (SELECT p_partkey, p_size * 30 AS cds, (p_retailprice)::BIGINT AS utr3,
                  p_partkey % 500 AS aa FROM part),
m AS (SELECT *, CASE WHEN cds > 0 THEN abs(cds - (aa * 3 + 3)) ELSE -1 END AS mm FROM t)
SELECT p_partkey, mm AS cds_protein_mismatch, CASE WHEN utr3 > 1000 THEN 1 ELSE 0 END AS long_3utr,
       CASE WHEN mm > 30 AND cds > 0 AND aa > 10 THEN 1 ELSE 0 END AS ptc_proxy FROM m""")
def decay_flags(spark, d):
    p = S.table(spark, d, "part").select(
        "p_partkey", (F.col("p_size") * 30).alias("cds"),
        F.round("p_retailprice").cast("long").alias("utr3"), (F.col("p_partkey") % 500).alias("aa"),
    )
    flags = Q.decay_flags(F.col("cds"), F.col("utr3"), F.col("aa"))
    return p.select("p_partkey", *[c.alias(n) for n, c in flags.items()])


@query("engineered", _FEATS + """
SELECT gene_id, round(rmsf_nterm_cterm_ratio, 9) AS rmsf_nterm_cterm_ratio,
       round(packing_x_idr, 9) AS packing_x_idr, round(rrach_per_cds_kb, 9) AS rrach_per_cds_kb,
       round(utr3_au_x_length, 5) AS utr3_au_x_length FROM features""")
def engineered(spark, d):
    names = ["rmsf_nterm_cterm_ratio", "packing_x_idr", "rrach_per_cds_kb", "utr3_au_x_length"]
    digits = dict.fromkeys(names, 9) | {"utr3_au_x_length": 5}
    return S.features(spark, d).select("gene_id", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query("length_norm", _FEATS + """
SELECT gene_id, utr5_fraction, utr3_fraction, cds_fraction FROM features""")
def length_norm(spark, d):
    return S.features(spark, d).select("gene_id", "utr5_fraction", "utr3_fraction", "cds_fraction")


_FOLD = f"""
, f AS (SELECT gene_id, translate(seq, 'ACGU', '(.).') AS s,
               ({h_sql('mfe')} % 6001 - 3000) / 100.0::DOUBLE AS mfe, length(seq) AS n FROM seqs)
"""


@query("fold_features", _SEQ + _FOLD + r"""
SELECT gene_id, mfe, CASE WHEN mfe <> 0 THEN mfe / nullif(n, 0) END AS mfe_per_nt,
       round_even(coalesce((n - length(translate(s, '()', '')))::DOUBLE / nullif(n, 0), 0), 4)
         AS frac_paired,
       len(regexp_extract_all(s, '\([.]+\)')) AS n_stemloops
FROM f""")
def fold_features(spark, d):
    s = S.sequences(spark, d).select(
        "gene_id", F.translate("seq", "ACGU", "(.).").alias("s"),
        ((S.seeded_number(F.col("gene_id"), "mfe") % 6001 - 3000) / F.lit(100.0)).alias("e"),
    )
    feats = Q.fold_features(F.col("s"), F.col("e"))
    return s.select("gene_id", *[c.alias(n) for n, c in feats.items()])


@query("header_roundtrip", _SEQ + """
SELECT gene_id, gene_id || '.1' AS tx_id, class, condition, tier = 1 AS qc_fail,
       concat_ws('|', gene_id, gene_id || '.1', 'class' || class, condition,
                 CASE WHEN tier = 1 THEN 'QC_FAIL:short_protein' END) AS header
FROM seqs""")
def header_roundtrip(spark, d):
    s = S.sequences(spark, d)
    flag = F.when(F.col("tier") == 1, "short_protein").otherwise("pass")
    header = Q.make_header(
        F.col("gene_id"), F.concat("gene_id", F.lit(".1")), F.col("class"), F.col("condition"), flag
    )
    h = s.select(header.alias("header"))
    return h.select("header", *[c.alias(n) for n, c in Q.parse_header(F.col("header")).items()])


@query("missing_aware_filter", STAR_SQL + """
SELECT count(*) AS n, count(*) FILTER (idr_percent BETWEEN 20 AND 60) AS mid_idr,
       count(*) FILTER (rmsf_mean > 10 AND packing_density > 10) AS dynamic_and_packed
FROM features""")
def missing_aware_filter(spark, d):
    return S.features(spark, d).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("idr_percent").between(20, 60)).alias("mid_idr"),
        F.count_if((F.col("rmsf_mean") > 10) & (F.col("packing_density") > 10)).alias(
            "dynamic_and_packed"
        ),
    )
