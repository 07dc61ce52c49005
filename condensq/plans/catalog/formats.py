"""Files: tables are written in a text format, read back and compared with their source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from condensq.functions.sequence import parse_header
from condensq.operators import lookup as Q
from condensq.operators import tables as T
from condensq.operators.transcripts import transcript_meta
from condensq.plans import analytics
from condensq.plans import star as S
from condensq.plans.catalog import query
from condensq.plans.catalog.questions import importance
from condensq.plans.catalog.text import _CORPUS, corpus, queries
from condensq.plans.star import EVENTS_SQL, EXONS_SQL, PREDICTIONS_SQL, STAR_SQL, with_sql
from condensq.session import checkpoint_dir
from condensq.sources import records as R
from condensq.sources import tables as IO

_SEQ = with_sql(S.SEQ_SQL)


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


@query("fasta_roundtrip", _SEQ + """
SELECT gene_id, gene_id || '.1' AS tx_id, class, condition, tier = 1 AS qc_fail, seq FROM seqs""")
def fasta_roundtrip(spark, d):
    s = S.sequences(spark, d)
    rows = s.select(
        "gene_id", F.concat("gene_id", F.lit(".1")).alias("tx_id"), "class", "condition", "seq",
        F.when(F.col("tier") == 1, "short_protein").otherwise("pass").alias("qc_flag"),
    )
    path = _folder(spark)
    R.write_fasta(rows, path)
    return R.read_fasta(spark, f"{path}/class=*")


def _annotation_lines(spark, d):
    """Exon lines with gene lines in front, as an annotation file holds them."""
    x = S.exons(spark, d)
    attrs = F.format_string(
        'gene_id "%d"; transcript_id "%d"; exon_id "%s"; tag "basic";', "gene_id",
        "transcript_id", "exon_id",
    )
    cells = ["contig", F.lit("src"), F.lit("exon"), "start", "end", F.lit("."), "strand", F.lit(".")]
    exons = x.select(F.concat_ws("\t", *cells, attrs).alias("value"))
    g = x.groupBy("gene_id", "contig", "strand").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    gene = F.concat_ws(
        "\t", "contig", F.lit("src"), F.lit("gene"), "s", "e", F.lit("."), "strand", F.lit("."),
        F.format_string('gene_id "%d"; gene_biotype "x";', "gene_id"),
    )
    return exons.unionByName(g.select(gene.alias("value")))


def _annotation_file(spark, d) -> str:
    path = _folder(spark)
    _annotation_lines(spark, d).write.text(path)
    return path


@query("annotation_scan", with_sql(EXONS_SQL) + """
SELECT gene_id::VARCHAR AS gene_id, transcript_id::VARCHAR AS transcript_id, count(*) AS n_exons,
       contig, strand, min("start") AS tx_start, max("end") AS tx_end
FROM exons GROUP BY gene_id, transcript_id, contig, strand""")
def annotation_scan(spark, d):
    ann = R.read_annotation(spark, _annotation_file(spark, d), ["exon", "transcript"])
    return transcript_meta(ann).drop("biotype", "is_canonical")


@query("filtered_annotation", with_sql(EXONS_SQL) + """, want AS (
  SELECT o_orderkey AS transcript_id FROM orders WHERE o_orderstatus = 'F'),
kept AS (SELECT 'exon' AS feature, gene_id, "start", "end" FROM exons
         WHERE transcript_id IN (SELECT transcript_id FROM want))
SELECT feature, gene_id::VARCHAR AS gene_id, "start", "end" FROM kept
UNION ALL
SELECT 'gene', gene_id::VARCHAR, min("start"), max("end") FROM exons
WHERE gene_id IN (SELECT gene_id FROM kept) GROUP BY gene_id""")
def filtered_annotation(spark, d):
    ann = R.read_annotation(spark, _annotation_file(spark, d))
    want = S.table(spark, d, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").cast("string").alias("transcript_id")
    )
    kept, _ = R.filter_annotation(ann, want)
    return kept.select(
        "feature", F.try_element_at("attrs", F.lit("gene_id")).alias("gene_id"), "start", "end"
    )


@query("event_file_scan", with_sql(EXONS_SQL, EVENTS_SQL) + """
SELECT gene_id::VARCHAR AS gene_id, condition || ':' || event_type || ':' || event_id AS event_id,
       event_type, condition, region1_start, region1_end, region2_start, region2_end, dpsi
FROM splice WHERE gene_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000)""")
def event_file_scan(spark, d):
    """One quoted tab-separated file per event type and condition, 0-based starts."""
    ev = S.splice_events(spark, d).persist()
    base = _folder(spark)
    for kind, spans in IO.EVENT_COLUMNS.items():
        cols = []
        for i, (start, end) in enumerate(spans, 1):
            cols += [(F.col(f"region{i}_start") - 1).alias(start), F.col(f"region{i}_end").alias(end)]
        for cond in ("HS", "NS"):
            part = ev.where((F.col("event_type") == kind) & (F.col("condition") == cond))
            part.select(
                F.col("event_id").alias("ID"),
                F.concat(F.lit('"'), F.col("gene_id"), F.lit('"')).alias("GeneID"),
                F.lit('"a "b" c"').alias("geneSymbol"), F.col("contig").alias("chr"), *cols,
                F.col("dpsi").alias("IncLevelDifference"), F.lit("NA").alias("FDR"),
            ).write.option("sep", "\t").option("quote", "").option("header", True).csv(
                f"{base}/{cond}/{IO.EVENT_FILE.format(type=kind)}"
            )
    ev.unpersist()
    genes = S.table(spark, d, "customer").where("c_acctbal > 3000").select(
        F.col("c_custkey").cast("string").alias("gene_id")
    )
    out = IO.read_events(spark, {c: f"{base}/{c}" for c in ("HS", "NS")}, genes)
    return out.drop("contig", "p_value", "fdr")


@query("score_record_scan", """
SELECT vec_id::VARCHAR AS tx_id, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total
FROM embeddings""")
def score_record_scan(spark, d):
    e = S.table(spark, d, "embeddings")
    lines = F.transform("embedding", lambda x, i: F.format_string("%d\tM\t%.12f", i + 1, x.cast("double")))
    text = F.concat(
        F.lit("# Position\tResidue\tScore\n#>"), F.col("vec_id"), F.lit(" note\n"),
        F.array_join(lines, "\n"), F.lit("\n1\tM\tbad"),
    )
    path = _folder(spark)
    e.select(text.alias("value")).write.text(path)
    out = R.read_score_records(spark, path)
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    return out.select("tx_id", F.size("scores").alias("n"), F.round(total, 4).alias("total"))


@query("cluster_scan", """
SELECT o_custkey AS cluster_id, o_orderkey::VARCHAR AS transcript_id FROM orders""")
def cluster_scan(spark, d):
    o = S.table(spark, d, "orders").select(
        "o_custkey", "o_orderkey", F.format_string("0\t9aa, >g|%d|class1|HS... at 80%%", "o_orderkey").alias("line")
    )
    # A cluster may span several blocks of its number; a block holds at most 1000 order keys.
    blocks = o.groupBy("o_custkey", F.floor(F.col("o_orderkey") / 1000)).agg(F.array_join(F.collect_list("line"), "\n").alias("t"))
    path = _folder(spark)
    blocks.select(F.concat(F.lit(">Cluster "), "o_custkey", F.lit("\n"), "t").alias("value")).write.text(path)
    return R.read_clusters(spark, path).select("cluster_id", "transcript_id")


@query("state_file_scan", """
SELECT s_suppkey::VARCHAR AS key, CASE WHEN s_nationkey < 12 THEN 'completed' ELSE 'failed' END AS status,
       CASE WHEN s_nationkey < 12 THEN s_acctbal END AS runtime_sec FROM supplier""")
def state_file_scan(spark, d):
    """Two key-to-status files; the second overrides the first for the keys it holds."""
    s = S.table(spark, d, "supplier")
    first = F.struct(F.lit("failed").alias("status"))
    second = F.struct(F.lit("completed").alias("status"), F.col("s_acctbal").alias("runtime_sec"))
    paths = []
    for state, rows in ((first, s), (second, s.where("s_nationkey < 12"))):
        path = _folder(spark)
        entry = F.to_json(F.create_map(F.col("s_suppkey").cast("string"), state))
        rows.select(entry.alias("value")).write.text(path)
        paths.append(path)
    return IO.read_state(spark, paths, lines=True).select("key", "status", "runtime_sec")


@query("state_map_scan", """
SELECT s_suppkey::VARCHAR AS key, 'completed' AS status, s_acctbal AS runtime_sec, s_name AS host,
       s_nationkey::BIGINT AS attempt FROM supplier""")
def state_map_scan(spark, d):
    """One file that is one map of all keys, read by many tasks; fields unknown to the reader stay."""
    s = S.table(spark, d, "supplier")
    more = F.struct(F.col("s_name").alias("host"), F.col("s_nationkey").alias("attempt"))
    entry = F.to_json(F.struct(
        F.lit("completed").alias("status"), F.col("s_acctbal").alias("runtime_sec"), more.alias("run")
    ))
    line = F.concat(F.lit('"'), F.col("s_suppkey").cast("string"), F.lit('": '), entry)
    # Files of a folder follow each other in one map: the first opens it, the last closes it.
    path = _folder(spark)
    first, last = s.agg(F.min("s_suppkey")).scalar(), s.agg(F.max("s_suppkey")).scalar()
    text = F.concat(
        F.when(F.col("s_suppkey") == first, "{").otherwise(""), line,
        F.when(F.col("s_suppkey") == last, "}").otherwise(","),
    )
    s.select(text.alias("value"), "s_suppkey").repartitionByRange(1, "s_suppkey").sortWithinPartitions(
        "s_suppkey"
    ).select("value").write.text(path)
    run = {"host": "string", "attempt": "bigint"}
    return IO.read_state(spark, [path]).select(
        "key", "status", "runtime_sec",
        *[F.try_variant_get("entry", f"$.run.{c}", t).alias(c) for c, t in run.items()],
    )


@query("stored_star_sql", STAR_SQL + """
SELECT g.tier, g.split, count(*) AS n, round(avg(p.prob_pos), 6) AS mean_prob,
       count(f.rmsf_mean) AS n_dynamic
FROM predictions p JOIN genes g USING (gene_id) JOIN features f USING (gene_id)
GROUP BY g.tier, g.split""")
def stored_star_sql(spark, d):
    path = _folder(spark)
    tables = {"genes": S.genes(spark, d), "features": S.features(spark, d),
              "predictions": S.predictions(spark, d)}
    IO.write_star(tables, path)
    prefix = f"s{uuid.uuid4().hex}"
    IO.register_star(spark, path, prefix)
    return spark.sql(f"""
        SELECT tier, split, count(*) AS n, round(avg(prob_pos), 6) AS mean_prob,
               count(rmsf_mean) AS n_dynamic
        FROM {prefix}_predictions JOIN {prefix}_genes USING (gene_id)
        JOIN {prefix}_features USING (gene_id) GROUP BY tier, split""")


@query("star_violations", """
SELECT 'predictions: no such gene' AS problem, count(*) AS n FROM customer
WHERE c_custkey NOT IN (SELECT doc_id FROM documents) HAVING count(*) > 0
UNION ALL SELECT 'genes: duplicate or missing key', count(*) FROM labels HAVING count(*) > 0""")
def star_violations(spark, d):
    """Planted breaches: labelled genes twice, predictions for genes that do not exist."""
    genes = S.genes(spark, d).select("gene_id")
    twice = S.table(spark, d, "labels").select(S.locus(F.col("doc_id")).alias("gene_id"))
    preds = S.customers(spark, d).select("gene_id")
    out = IO.star_violations(genes.unionByName(twice), genes, preds)
    return out.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("top_importance", STAR_SQL + """, long AS (
  UNPIVOT (SELECT gene_id, shap_mrna_length, shap_cds_length, "shap_di_CG", shap_utr3_au_content,
                  shap_rrach_per_kb, shap_rmsf_nterm50 FROM predictions)
  ON COLUMNS(* EXCLUDE gene_id) INTO NAME feature VALUE v)
SELECT feature, round(avg(abs(v)), 4) AS mean_abs_shap,
       row_number() OVER (ORDER BY avg(abs(v)) DESC, feature)::INTEGER AS "rank"
FROM long GROUP BY feature""")
def top_importance(spark, d):
    path = f"{_folder(spark)}.csv"
    IO.write_table(importance(spark, d), path, kind="csv")
    view = f"csv_{uuid.uuid4().hex}"
    return IO.query_csv(
        spark, path,
        f"SELECT feature, round(mean_abs_shap, 4) AS mean_abs_shap, rank FROM {view} "
        "ORDER BY rank LIMIT 15", view,
    )


@query("normalised_predictions", with_sql(PREDICTIONS_SQL) + """
SELECT gene_id, prob_pos, pred FROM predictions""")
def normalised_predictions(spark, d):
    raw = S.predictions(spark, d).select(
        F.col("gene_id").alias("geneID"), F.col("prob_pos").cast("string").alias("prob_pos"),
        F.col("pred").cast("string").alias("pred_class"),
    )
    return T.normalise_predictions(raw)


@query("point_lookup", with_sql(PREDICTIONS_SQL) + """
SELECT gene_id, prob_pos, pred FROM predictions WHERE gene_id = 'AT3G00042'""")
def point_lookup(spark, d):
    view = f"preds_{uuid.uuid4().hex}"
    S.predictions(spark, d).select("gene_id", "prob_pos", "pred").createOrReplaceTempView(view)
    return analytics.lookup_sql(spark, " at3g00042", view)


@query("id_comparison", _CORPUS + f""", {PREDICTIONS_SQL}, ids AS (
  SELECT DISTINCT label::BIGINT AS query_id, printf('AT%dG%05d', label % 5 + 1, label) AS gene_id
  FROM embeddings)
SELECT i.query_id, i.gene_id, CASE WHEN p.prob_pos IS NULL THEN 'not_found' ELSE 'found' END AS status,
       round_even(p.prob_pos, 6) AS prob_pos,
       CASE WHEN p.prob_pos > 0.5 THEN 'retrieve' ELSE 'skip' END AS route,
       h.r::INTEGER AS "rank", h.chunk_id
FROM ids i LEFT JOIN predictions p USING (gene_id)
LEFT JOIN hits h ON h.query_id = i.query_id AND h.r <= 3 AND p.prob_pos > 0.5""")
def id_comparison(spark, d):
    q = queries(spark, d)
    ids = q.select("query_id", F.lower(S.locus(F.col("query_id"))).alias("gene_id"))
    out = Q.compare_ids(ids, S.predictions(spark, d), q, corpus(spark, d), min_prob=0.5, k=3)
    return out.select("query_id", "gene_id", "status", "prob_pos", "route", "rank", "chunk_id")


@query("accession_mapping", """
WITH ids AS (SELECT DISTINCT c_name AS gene_id FROM customer),
refs AS (SELECT 'Customer' || substr(s_name, 9) AS key, 'S' || s_suppkey AS value FROM supplier),
parts AS (SELECT 'Customer#' || printf('%09d', p_partkey) AS key, 'P' || p_partkey AS value FROM part
          WHERE p_size < 25),
cache AS (SELECT 'Customer#' || printf('%09d', n_nationkey) AS key,
                 CASE WHEN n_regionkey > 1 THEN 'C' || n_nationkey END AS value FROM nation)
SELECT i.gene_id, CASE WHEN c.key IS NOT NULL THEN c.value ELSE coalesce(r.value, p.value) END
         AS accession
FROM ids i LEFT JOIN cache c ON c.key = i.gene_id LEFT JOIN refs r ON r.key = i.gene_id
LEFT JOIN parts p ON p.key = i.gene_id""")
def accession_mapping(spark, d):
    ids = S.table(spark, d, "customer").select(F.col("c_name").alias("gene_id")).distinct()
    name = lambda k: F.format_string("Customer#%09d", k)
    refs = S.table(spark, d, "supplier").select(
        F.concat(F.lit("Customer"), F.substring("s_name", 9, 20)).alias("key"),
        F.concat(F.lit("S"), "s_suppkey").alias("value"),
    )
    parts = S.table(spark, d, "part").where("p_size < 25").select(
        name("p_partkey").alias("key"), F.concat(F.lit("P"), "p_partkey").alias("value")
    )
    cache = S.table(spark, d, "nation").select(
        name("n_nationkey").alias("key"),
        F.when(F.col("n_regionkey") > 1, F.concat(F.lit("C"), "n_nationkey")).alias("value"),
    )
    out, _ = Q.map_accessions(ids, refs, parts, cache)
    return out.select("gene_id", "accession")


@query("parameter_grid", with_sql(S.SEQ_SQL, S.GENES_SQL, PREDICTIONS_SQL, S.SCORED_SQL) + """
SELECT t AS threshold, count(*) FILTER (prob_pos >= t) AS n_positive
FROM scored, (VALUES (0.3::DOUBLE), (0.5), (0.7)) g(t) GROUP BY t""")
def parameter_grid(spark, d):
    grid = T.param_grid(S.scored(spark, d).select("prob_pos"), [0.3, 0.5, 0.7], "threshold")
    return grid.groupBy("threshold").agg(
        F.count_if(F.col("prob_pos") >= F.col("threshold")).alias("n_positive")
    )


@query("header_fields", """
SELECT doc_id, split_part(source, 'c', 2) AS gene_id,
       CASE WHEN doc_id % 3 = 0 THEN -1 ELSE (doc_id % 3)::INTEGER END AS class
FROM documents""")
def header_fields(spark, d):
    """Headers with an unreadable class field."""
    k = F.col("doc_id") % 3
    text = F.concat_ws(
        "|", F.split_part("source", F.lit("c"), F.lit(2)), "doc_id",
        F.when(k == 0, "classX").otherwise(F.concat(F.lit("class"), k)),
    )
    docs = S.table(spark, d, "documents").select("doc_id", text.alias("header"))
    f = parse_header(F.col("header"))
    return docs.select("doc_id", f["gene_id"].alias("gene_id"), f["class"].alias("class"))
