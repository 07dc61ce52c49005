"""The star schema and the other inputs of the query catalog, derived from the given tables.

The second half of the module states the same derivations as SQL text for the side-by-side check.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condensq.functions.keys import seeded_number
from condensq.functions.labels import assign_tier, decide
from condensq.functions.sequence import (
    engineer_features,
    length_normalise,
    sequence_features,
)
from condensq.schemas import ATTRIBUTION_FEATURES
from condensq.session import checkpoint_dir, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def locus(key):
    """Locus-style id of a number."""
    return F.format_string("AT%dG%05d", (key % 5 + 1).cast("int"), key.cast("long"))


def _h(salt: str):
    return seeded_number(F.col("gene_id"), salt)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, spread over the executors: work per text outweighs moving it once."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: ids, label, the bases found in its text."""
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    bases = F.translate(F.regexp_replace(F.upper("text"), "[^ACGTU]+", ""), "T", "U")
    rows = docs.join(labels, "doc_id", "left").select(
        "doc_id", locus(F.col("doc_id")).alias("gene_id"), F.col("source").alias("gene_name"),
        F.coalesce("quality", F.lit(-1)).alias("class"), F.col("lang").alias("condition"),
        "n_chars", bases.alias("seq"),
    )
    return rows.withColumns(
        {
            "aa_len": F.when(F.col("class") >= 0, F.floor(F.length("seq") / 4)).otherwise(0),
            "tier": assign_tier(F.col("n_chars"), 1000, 3000),
        }
    )


def derive_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _h("split") % 100
    return sequences(spark, sf_dir).select(
        "gene_id", F.concat("gene_id", F.lit(".1")).alias("transcript_id"), "gene_name", "class",
        "condition", "tier",
        F.when(part < 70, "train").when(part < 85, "val").otherwise("test").alias("split"),
    )


def derive_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence features as computed; ensemble features are digest numbers, missing in tier 1."""
    s = sequences(spark, sf_dir)
    s = sequence_features(s, "seq", F.col("aa_len"), digits=10)
    dynamic = lambda salt, span, div: F.when(
        F.col("tier") > 1, (_h(salt) % span) / F.lit(float(div))
    )
    s = s.withColumns(
        {
            "idr_percent": (_h("idr") % 100003) / F.lit(1000.03),
            "rmsf_mean": dynamic("rmsf", 40009, 1000.07),
            "rmsf_nterm50": dynamic("nt", 50021, 1000.07),
            "rmsf_cterm50": dynamic("ct", 20011, 1000.07),
            "packing_density": dynamic("pack", 30011, 1000.07),
            "mfe_per_nt": -((_h("mfe") % 60013) / F.lit(100003.0)),
            "n_residues": F.col("aa_len").cast("double"),
            "long_3utr": (F.col("utr3_length") > 1000).cast("int"),
            "ptc_proxy": F.lit(0),
        }
    )
    s = s.withColumn("mfe", F.col("mfe_per_nt") * F.col("mrna_length"))
    out = engineer_features(length_normalise(s))
    return out.drop(
        "doc_id", "gene_name", "class", "condition", "n_chars", "aa_len", "tier", "seq"
    )


def derive_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select(locus(F.col("doc_id")).alias("gene_id"))
    prob = _h("p") / F.lit(4294967296.0)
    sampled = _h("sampled") % 3 == 0
    shap = [
        F.when(sampled, (_h(f"shap_{c}") % 2001 - 1000) / F.lit(10000.0)).alias(f"shap_{c}")
        for c in ATTRIBUTION_FEATURES
    ]
    return ids.select(
        "gene_id", prob.alias("prob_pos"), decide(prob).alias("pred"), *shap
    )


_DERIVE = {
    "genes": derive_genes, "features": derive_features, "predictions": derive_predictions,
}
_STORED: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A star table, written once per application to the shared folder and read back from there.

    Questions then scan the few columns they name, with their filters pushed to the files,
    instead of taking every text apart again.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = f"{checkpoint_dir(spark)}/star-{uuid.uuid4().hex}/{name}"
        _DERIVE[name](spark, sf_dir).write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "genes")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "features")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "predictions")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with their stored score."""
    g = genes(spark, sf_dir).where(F.col("class") >= 0)
    return g.join(predictions(spark, sf_dir), "gene_id")


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        predictions(spark, sf_dir)
        .join(genes(spark, sf_dir), "gene_id")
        .join(features(spark, sf_dir), "gene_id")
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes of the interval and labelling inputs."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        locus(F.col("c_custkey")).alias("gene_id"), "c_custkey", "c_name", "c_nationkey",
        "c_acctbal", "c_mktsegment",
    )


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order = transcript, line = exon, customer = gene."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    line = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    start = (F.col("l_linenumber") - 1) * 400 + F.col("l_partkey") % 300 + 1
    return line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("gene_id"), F.col("l_orderkey").alias("transcript_id"),
        F.concat(F.lit("Chr"), (F.col("o_custkey") % 5 + 1).cast("string")).alias("contig"),
        F.when(F.col("o_custkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        start.cast("long").alias("start"),
        (start + F.col("l_quantity").cast("long") * 8).cast("long").alias("end"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("exon_id"),
        "l_partkey", "l_returnflag", "l_linestatus", "l_suppkey", "l_discount", "l_tax",
    )


def splice_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines as splice events of their gene, on shifted coordinates."""
    x = exons(spark, sf_dir).where("l_returnflag = 'R'")
    kind = F.element_at(
        F.array(*[F.lit(k) for k in ("SE", "RI", "A3SS", "A5SS", "MXE")]),
        (F.col("l_partkey") % 5 + 1).cast("int"),
    )
    shift = F.col("l_suppkey") % 50
    second = F.col("l_partkey") % 5 == 4
    return x.select(
        "gene_id", F.col("exon_id").alias("event_id"), kind.alias("event_type"),
        F.lower("contig").alias("contig"),
        F.when(F.col("l_linestatus") == "F", "HS").otherwise("NS").alias("condition"),
        (F.col("start") + shift).alias("region1_start"), (F.col("end") + shift).alias("region1_end"),
        F.when(second, F.col("start") + 500).alias("region2_start"),
        F.when(second, F.col("end") + 500).alias("region2_end"),
        F.round(F.col("l_discount") - F.col("l_tax"), 2).alias("dpsi"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript metadata from orders and their lines."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_exons")
    )
    o = table(spark, sf_dir, "orders")
    return o.join(n, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("gene_id"), F.col("o_orderkey").alias("transcript_id"), "n_exons",
        F.when(F.col("o_orderstatus") == "F", "protein_coding").otherwise("lncRNA").alias("biotype"),
        F.col("o_orderpriority").startswith("1").alias("is_canonical"),
        F.col("o_orderkey").alias("ord"),
    )


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score array per embedding, moved into the score range."""
    e = table(spark, sf_dir, "embeddings")
    scores = F.transform("embedding", lambda x: x.cast("double") * 2 + 0.5)
    return e.select("vec_id", "label", scores.alias("scores"))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding = frame of atoms, three numbers each, the last ones padded with 0, and three atoms
    to a residue; label = structure."""
    e = table(spark, sf_dir, "embeddings")
    last = F.ceil(F.size("embedding") / 3).cast("int") - 1
    i = F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("i")
    flat = e.select("label", "vec_id", "embedding", i)
    xyz = [
        (F.coalesce(F.get("embedding", F.col("i") * 3 + j).cast("double"), F.lit(0.0)) * 40).alias(a)
        for j, a in enumerate("xyz")
    ]
    names = F.array(F.lit("N"), F.lit("CA"), F.lit("C"))
    return flat.select(
        F.col("label").cast("string").alias("structure"), F.col("vec_id").alias("frame"),
        (F.col("i") + 1).cast("long").alias("atom_id"),
        (F.floor(F.col("i") / 3) + 1).cast("long").alias("res_id"),
        F.element_at(names, F.col("i") % 3 + 1).alias("atom_name"),
        (F.lit(12.0) + F.col("i") % 3).alias("mass"),
        *xyz,
    )


# The same derivations for DuckDB ------------------------------------------------------------

_H = "('0x' || substr(md5(gene_id || '|{0}'), 1, 8))::BIGINT"


def h_sql(salt: str) -> str:
    return _H.format(salt)


_LOCUS = "printf('AT%dG%05d', ({0} % 5 + 1)::INTEGER, {0}::BIGINT)"


def locus_sql(col: str) -> str:
    return _LOCUS.format(col)


def _count_sql(chars: str) -> str:
    return f"(length(seq) - length(translate(seq, '{chars}', '')))::DOUBLE"


def _pair_sql(pair: str) -> str:
    return (
        f"CASE WHEN length(seq) > 1 THEN len(list_filter(range(1, length(seq)), "
        f"lambda i: substr(seq, i, 2) = '{pair}'))::DOUBLE / (length(seq) - 1) ELSE 0 END AS di_{pair}"
    )


SEQ_SQL = f"""
seqs AS (
  SELECT d.doc_id, {locus_sql('d.doc_id')} AS gene_id, d.source AS gene_name,
         coalesce(l.quality, -1) AS class, d.lang AS condition, d.n_chars,
         translate(regexp_replace(upper(d.text), '[^ACGTU]', '', 'g'), 'T', 'U') AS seq,
         CASE WHEN d.n_chars < 1000 THEN 1 WHEN d.n_chars < 3000 THEN 2 ELSE 3 END AS tier
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""

GENES_SQL = f"""
genes AS (
  SELECT gene_id, gene_id || '.1' AS transcript_id, gene_name, class, condition, tier,
         CASE WHEN {h_sql('split')} % 100 < 70 THEN 'train'
              WHEN {h_sql('split')} % 100 < 85 THEN 'val' ELSE 'test' END AS split
  FROM seqs
)"""

_DI = ", ".join(_pair_sql(a + b) for a in "AUGC" for b in "AUGC")

FEATURES_SQL = f"""
f1 AS (
  SELECT *, length(seq) AS mrna_length,
         CASE WHEN class >= 0 THEN length(seq) // 4 ELSE 0 END AS aa_len,
         greatest(floor(length(seq) * 0.1::DOUBLE)::BIGINT, 50) AS lead
  FROM seqs
),
f2 AS (
  SELECT *,
         CASE WHEN aa_len > 0 THEN aa_len * 3 + 3
              ELSE floor(mrna_length * 0.55::DOUBLE)::BIGINT END AS cds_length,
         CASE WHEN aa_len > 0 AND aa_len * 3 + 3 + lead >= mrna_length
              THEN greatest(mrna_length - (aa_len * 3 + 3) - 50, 0) ELSE lead END AS utr5_length
  FROM f1
),
f3 AS (
  SELECT *,
         CASE WHEN mrna_length = 0 THEN 0
              WHEN mrna_length - cds_length - utr5_length > 0
              THEN mrna_length - cds_length - utr5_length
              ELSE greatest(floor(mrna_length * 0.2::DOUBLE)::BIGINT, 50) END AS utr3_length
  FROM f2
),
f4 AS (
  SELECT *, CASE WHEN utr3_length >= mrna_length THEN seq
                 ELSE right(seq, utr3_length::INTEGER) END AS tail
  FROM f3
),
f5 AS (
  SELECT gene_id, tier, seq, mrna_length, cds_length, utr5_length, utr3_length,
         {_count_sql('A')} / nullif(mrna_length, 0) AS "fA",
         {_count_sql('U')} / nullif(mrna_length, 0) AS "fU",
         {_count_sql('G')} / nullif(mrna_length, 0) AS "fG",
         {_count_sql('C')} / nullif(mrna_length, 0) AS "fC",
         {_count_sql('AU')} / nullif(mrna_length, 0) AS au_content,
         {_count_sql('GC')} / nullif(mrna_length, 0) AS gc_content,
         round_even(coalesce((length(tail) - length(translate(tail, 'AU', '')))::DOUBLE
                    / nullif(length(tail), 0), 0), 10) AS utr3_au_content,
         len(regexp_extract_all(seq, '[AG][AG]AC[ACU]')) AS rrach_count,
         len(regexp_extract_all(seq, 'AAAC[ACU]')) AS aaach_count,
         ({h_sql('idr')} % 100003) / 1000.03::DOUBLE AS idr_percent,
         CASE WHEN tier > 1 THEN ({h_sql('rmsf')} % 40009) / 1000.07::DOUBLE END AS rmsf_mean,
         CASE WHEN tier > 1 THEN ({h_sql('nt')} % 50021) / 1000.07::DOUBLE END AS rmsf_nterm50,
         CASE WHEN tier > 1 THEN ({h_sql('ct')} % 20011) / 1000.07::DOUBLE END AS rmsf_cterm50,
         CASE WHEN tier > 1 THEN ({h_sql('pack')} % 30011) / 1000.07::DOUBLE END AS packing_density,
         -(({h_sql('mfe')} % 60013) / 100003.0::DOUBLE) AS mfe_per_nt,
         aa_len::DOUBLE AS n_residues
  FROM f4
),
features AS (
  SELECT *,
         coalesce(rrach_count / nullif(mrna_length / 1000.0::DOUBLE, 0), 0) AS rrach_per_kb,
         coalesce(aaach_count / nullif(mrna_length / 1000.0::DOUBLE, 0), 0) AS aaach_per_kb,
         coalesce(utr5_length::DOUBLE / nullif(mrna_length, 0), 0) AS utr5_fraction,
         coalesce(utr3_length::DOUBLE / nullif(mrna_length, 0), 0) AS utr3_fraction,
         coalesce(cds_length::DOUBLE / nullif(mrna_length, 0), 0) AS cds_fraction,
         CASE WHEN utr3_length > 1000 THEN 1 ELSE 0 END AS long_3utr,
         0 AS ptc_proxy,
         mfe_per_nt * mrna_length AS mfe,
         rmsf_nterm50 / (rmsf_cterm50 + 0.1::DOUBLE) AS rmsf_nterm_cterm_ratio,
         packing_density * (idr_percent / 100.0::DOUBLE) AS packing_x_idr,
         rrach_count / ((cds_length + 1.0::DOUBLE) / 1000.0::DOUBLE) AS rrach_per_cds_kb,
         utr3_au_content * utr3_length AS utr3_au_x_length
  FROM f5
)"""

DINUCLEOTIDE_SQL = _DI

PREDICTIONS_SQL = f"""
p0 AS (SELECT {locus_sql('doc_id')} AS gene_id FROM documents),
predictions AS (
  SELECT gene_id, {h_sql('p')} / 4294967296.0::DOUBLE AS prob_pos,
         CASE WHEN {h_sql('p')} / 4294967296.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS pred,
         {", ".join(
             f"CASE WHEN {h_sql('sampled')} % 3 = 0 THEN ({h_sql('shap_' + c)} % 2001 - 1000) "
             f"/ 10000.0::DOUBLE END AS shap_{c}" for c in ATTRIBUTION_FEATURES)}
  FROM p0
)"""

SCORED_SQL = """
scored AS (SELECT * FROM genes JOIN predictions USING (gene_id) WHERE class >= 0)"""

EXONS_SQL = """
exons AS (
  SELECT o_custkey AS gene_id, l_orderkey AS transcript_id,
         'Chr' || (o_custkey % 5 + 1)::VARCHAR AS contig,
         CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
         (l_linenumber - 1) * 400 + l_partkey % 300 + 1 AS "start",
         (l_linenumber - 1) * 400 + l_partkey % 300 + 1 + l_quantity::BIGINT * 8 AS "end",
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS exon_id,
         l_partkey, l_returnflag, l_linestatus, l_suppkey, l_discount, l_tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

EVENTS_SQL = """
splice AS (
  SELECT gene_id, exon_id AS event_id,
         ['SE', 'RI', 'A3SS', 'A5SS', 'MXE'][(l_partkey % 5 + 1)::INTEGER] AS event_type,
         CASE WHEN l_linestatus = 'F' THEN 'HS' ELSE 'NS' END AS condition,
         "start" + l_suppkey % 50 AS region1_start, "end" + l_suppkey % 50 AS region1_end,
         CASE WHEN l_partkey % 5 = 4 THEN "start" + 500 END AS region2_start,
         CASE WHEN l_partkey % 5 = 4 THEN "end" + 500 END AS region2_end,
         round(l_discount - l_tax, 2) AS dpsi
  FROM exons WHERE l_returnflag = 'R'
)"""

TRANSCRIPTS_SQL = """
tx AS (
  SELECT o_custkey AS gene_id, o_orderkey AS transcript_id, n_exons,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS coding,
         CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS canonical
  FROM orders JOIN (SELECT l_orderkey, count(*) AS n_exons FROM lineitem GROUP BY 1)
    ON o_orderkey = l_orderkey
)"""

ATOMS_SQL = """
atoms AS (
  SELECT label::VARCHAR AS structure, vec_id AS frame, i + 1 AS atom_id, i // 3 + 1 AS res_id,
         ['N', 'CA', 'C'][(i % 3 + 1)::INTEGER] AS atom_name, 12.0::DOUBLE + i % 3 AS mass,
         coalesce(embedding[i * 3 + 1]::DOUBLE, 0) * 40 AS x,
         coalesce(embedding[i * 3 + 2]::DOUBLE, 0) * 40 AS y,
         coalesce(embedding[i * 3 + 3]::DOUBLE, 0) * 40 AS z
  FROM (SELECT label, vec_id, embedding, unnest(range(0, (len(embedding) + 2) // 3)) AS i FROM embeddings)
)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


STAR_SQL = with_sql(SEQ_SQL, GENES_SQL, FEATURES_SQL, PREDICTIONS_SQL)
SCORED = with_sql(SEQ_SQL, GENES_SQL, PREDICTIONS_SQL, SCORED_SQL)
