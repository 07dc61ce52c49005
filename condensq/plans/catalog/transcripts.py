"""Interval joins, transcript choice and splicing."""

from __future__ import annotations

from pyspark.sql import functions as F

from condensq.operators import intervals as I
from condensq.operators import transcripts as T
from condensq.plans import star as S
from condensq.plans.catalog import query
from condensq.plans.star import EVENTS_SQL, EXONS_SQL, TRANSCRIPTS_SQL, with_sql

_PAIRS = with_sql(EXONS_SQL, EVENTS_SQL)


def _sides(spark, d):
    ex = S.exons(spark, d).select(
        "gene_id", "exon_id", F.col("start").alias("l_start"), F.col("end").alias("l_end")
    )
    ev = S.splice_events(spark, d).select(
        "gene_id", "event_id", F.col("region1_start").alias("r_start"),
        F.col("region1_end").alias("r_end"),
    )
    return ex, ev


@query("interval_overlap", _PAIRS + """
SELECT exon_id, event_id, least("end", region1_end) - greatest("start", region1_start) + 1 AS overlap
FROM exons x JOIN splice s ON x.gene_id = s.gene_id
 AND least("end", region1_end) - greatest("start", region1_start) + 1 >= 10""")
def interval_overlap(spark, d):
    ex, ev = _sides(spark, d)
    return I.interval_overlap(ex, ev, ["gene_id"], 10, longest=I.BIN).select("exon_id", "event_id", "overlap")


@query("interval_containment", _PAIRS + """
SELECT exon_id, event_id FROM exons x JOIN splice s ON x.gene_id = s.gene_id
 AND "start" <= region1_start + 2 AND "end" >= region1_end - 2""")
def interval_containment(spark, d):
    ex, ev = _sides(spark, d)
    return I.interval_contains(ex, ev, ["gene_id"], 2, longest=I.BIN).select("exon_id", "event_id")


@query("interval_overlap_unkeyed", """
WITH x AS (SELECT p_partkey, p_partkey * 50 + p_size AS s, p_partkey * 50 + p_size + p_size * 3 AS e
           FROM part),
y AS (SELECT s_suppkey, s_suppkey * 1000 AS s, s_suppkey * 1000 + s_nationkey * 20 AS e
      FROM supplier)
SELECT p_partkey, s_suppkey, least(x.e, y.e) - greatest(x.s, y.s) + 1 AS overlap
FROM x JOIN y ON least(x.e, y.e) - greatest(x.s, y.s) + 1 >= 1""")
def interval_overlap_unkeyed(spark, d):
    s = F.col("p_partkey") * 50 + F.col("p_size")
    x = S.table(spark, d, "part").select(
        "p_partkey", s.alias("l_start"), (s + F.col("p_size") * 3).alias("l_end")
    )
    y = S.table(spark, d, "supplier").select(
        "s_suppkey", (F.col("s_suppkey") * 1000).alias("r_start"),
        (F.col("s_suppkey") * 1000 + F.col("s_nationkey") * 20).alias("r_end"),
    )
    return I.interval_overlap(x, y, [], 1, 500).select("p_partkey", "s_suppkey", "overlap")


@query("contig_names", """
SELECT DISTINCT 'Chr' || (o_custkey % 5 + 1) AS contig, (o_custkey % 5 + 1)::VARCHAR AS plain
FROM orders""")
def contig_names(spark, d):
    c = S.exons(spark, d).select("contig").distinct()
    return c.select("contig", I.normalise_contig(F.col("contig")).alias("plain"))


@query("best_transcript", with_sql(TRANSCRIPTS_SQL) + """
SELECT gene_id, transcript_id, n_exons FROM (
  SELECT *, row_number() OVER (PARTITION BY gene_id
    ORDER BY canonical + coding DESC, n_exons DESC, transcript_id) AS k FROM tx) WHERE k = 1""")
def best_transcript(spark, d):
    return T.canonical_transcript(S.transcripts(spark, d)).select(
        "gene_id", "transcript_id", "n_exons"
    )


_MATCHES = """
regions AS (
  SELECT gene_id, event_id, event_type, condition, dpsi, region1_start AS s, region1_end AS e
  FROM splice
  UNION ALL SELECT gene_id, event_id, event_type, condition, dpsi, region2_start, region2_end
  FROM splice WHERE region2_start IS NOT NULL),
matches AS (
  SELECT DISTINCT x.gene_id, r.event_id, x.transcript_id, r.event_type, r.condition, r.dpsi
  FROM exons x JOIN regions r ON x.gene_id = r.gene_id
  WHERE CASE WHEN r.event_type = 'RI' THEN x."start" <= r.s + 2 AND x."end" >= r.e - 2
             ELSE least(x."end", r.e) - greatest(x."start", r.s) + 1 >= 10 END),
best AS (
  SELECT *, row_number() OVER (PARTITION BY m.gene_id ORDER BY abs(dpsi) DESC NULLS LAST,
           CASE WHEN condition = 'HS' THEN 0 ELSE 1 END, event_id, canonical DESC, coding DESC,
           n_exons DESC, m.transcript_id) AS k,
         count(*) OVER (PARTITION BY m.gene_id, event_id) AS n_candidates
  FROM matches m JOIN (SELECT transcript_id, n_exons, canonical, coding FROM tx) USING (transcript_id))
"""


@query("first_matching_event", with_sql(EXONS_SQL, EVENTS_SQL, TRANSCRIPTS_SQL, _MATCHES) + """
SELECT gene_id, transcript_id, event_id, event_type, condition AS event_condition, n_candidates,
       'event_' || event_type || '_overlap' || CASE WHEN n_candidates > 1
         THEN '_' || n_candidates || 'candidates' ELSE '' END AS isoform_source
FROM best WHERE k = 1""")
def first_matching_event(spark, d):
    ev = S.splice_events(spark, d)
    hits = T.event_matches(S.exons(spark, d), ev)
    out = T.first_matching_event(hits, S.transcripts(spark, d))
    return out.select(
        "gene_id", "transcript_id", "event_id", "event_type", "event_condition", "n_candidates",
        "isoform_source",
    )


@query("isoform_map", with_sql(EXONS_SQL, EVENTS_SQL, TRANSCRIPTS_SQL, _MATCHES) + """
, lab AS (SELECT c_custkey AS gene_id, CASE WHEN c_acctbal > 3000 THEN 1 ELSE 0 END AS class
          FROM customer),
canon AS (SELECT gene_id, transcript_id AS c_tx FROM (
  SELECT *, row_number() OVER (PARTITION BY gene_id
    ORDER BY canonical + coding DESC, n_exons DESC, transcript_id) AS k FROM tx) WHERE k = 1),
picked AS (
  SELECT l.gene_id, l.class, coalesce(CASE WHEN l.class = 1 THEN b.transcript_id END, c_tx)
           AS transcript_id,
         CASE WHEN l.class = 1 AND b.event_id IS NOT NULL THEN b.event_type END AS event_type,
         CASE WHEN l.class = 1 THEN (SELECT count(*) FROM splice s WHERE s.gene_id = l.gene_id)
              ELSE 0 END AS n_events
  FROM lab l LEFT JOIN (SELECT * FROM best WHERE k = 1) b USING (gene_id)
  LEFT JOIN canon USING (gene_id))
SELECT p.gene_id, class, transcript_id, event_type, n_events, n_exons
FROM picked p JOIN tx USING (transcript_id)""")
def isoform_map(spark, d):
    lab = S.table(spark, d, "customer").select(
        F.col("c_custkey").alias("gene_id"), (F.col("c_acctbal") > 3000).cast("int").alias("class")
    )
    out = T.map_isoforms(
        lab, S.splice_events(spark, d), S.exons(spark, d), S.transcripts(spark, d)
    )
    return out.select("gene_id", "class", "transcript_id", "event_type", "n_events", "n_exons")


def annotation(spark, d):
    """Exon lines as annotation rows; the return flag stands for the region kind."""
    x = S.exons(spark, d)
    flag = F.col("l_returnflag")
    kind = F.when(flag == "A", "five_prime_utr").when(flag == "N", "CDS").otherwise(
        "three_prime_utr"
    )
    attrs = F.create_map(
        F.lit("gene_id"), F.col("gene_id").cast("string"), F.lit("transcript_id"),
        F.col("transcript_id").cast("string"),
    )
    return x.select(
        F.col("contig").alias("seqname"), kind.alias("feature"), "start", "end", "strand",
        attrs.alias("attrs"),
    )


@query("region_lengths", with_sql(EXONS_SQL) + """
SELECT transcript_id::VARCHAR AS transcript_id,
       coalesce(sum("end" - "start" + 1) FILTER (l_returnflag = 'A'), 0)::BIGINT AS utr5_length,
       coalesce(sum("end" - "start" + 1) FILTER (l_returnflag = 'N'), 0)::BIGINT AS cds_length,
       coalesce(sum("end" - "start" + 1) FILTER (l_returnflag = 'R'), 0)::BIGINT AS utr3_length
FROM exons GROUP BY 1""")
def region_lengths(spark, d):
    return T.region_lengths(annotation(spark, d))


@query("transcript_meta", with_sql(EXONS_SQL) + """
SELECT gene_id::VARCHAR AS gene_id, transcript_id::VARCHAR AS transcript_id, count(*) AS n_exons,
       min("start") AS tx_start, max("end") AS tx_end FROM exons GROUP BY 1, 2""")
def transcript_meta(spark, d):
    ann = annotation(spark, d).withColumn("feature", F.lit("exon"))
    return T.transcript_meta(ann).select(
        "gene_id", "transcript_id", "n_exons", "tx_start", "tx_end"
    )


_SPLICED = with_sql(S.SEQ_SQL, EXONS_SQL) + """, pieces AS (
  SELECT x.transcript_id, x.strand, x."start", x."end", x.exon_id, substr(q.seq, x."start"::INTEGER,
         (x."end" - x."start" + 1)::INTEGER) AS piece
  FROM exons x JOIN seqs q ON q.doc_id = x.gene_id),
spliced AS (
  SELECT transcript_id, strand, string_agg(piece, '' ORDER BY "start", "end", exon_id) AS s
  FROM pieces GROUP BY 1, 2),
oriented AS (
  SELECT transcript_id, CASE WHEN strand = '-' THEN reverse(translate(s, 'ACGU', 'UGCA')) ELSE s END
         AS seq FROM spliced)
"""


def spliced(spark, d):
    contigs = S.sequences(spark, d).select(F.col("doc_id").cast("string").alias("contig"), "seq")
    ex = S.exons(spark, d).withColumn("contig", F.col("gene_id").cast("string"))
    return T.spliced_sequence(ex, T.tile_contigs(contigs, 512), 512)


@query("spliced_sequence", _SPLICED + "SELECT transcript_id, seq FROM oriented WHERE seq <> ''")
def spliced_sequence(spark, d):
    return spliced(spark, d).where("seq <> ''")


@query("translated", _SPLICED + """, codons AS (
  SELECT transcript_id, unnest(range(0, length(seq) // 3)) AS i, seq FROM oriented)
SELECT transcript_id, count(*) AS n_codons,
       count(*) FILTER (substr(seq, i * 3 + 1, 3) IN ('UAA', 'UAG', 'UGA')) AS n_stops,
       count(*) FILTER (substr(seq, i * 3 + 1, 3) = 'AUG') AS n_met,
       count(*) FILTER (substr(seq, i * 3 + 1, 2) = 'GG') AS n_gly
FROM codons GROUP BY transcript_id""")
def translated(spark, d):
    from condensq.functions.sequence import substring_count, translate_cds

    aa = spliced(spark, d).select("transcript_id", translate_cds(F.col("seq")).alias("aa"))
    count = lambda c: substring_count(F.col("aa"), c)
    return aa.where("aa <> ''").select(
        "transcript_id", F.length("aa").cast("long").alias("n_codons"),
        count(".").alias("n_stops"), count("M").alias("n_met"), count("G").alias("n_gly"),
    )
