"""Line- and record-oriented text formats of sequence work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from condensq.functions.sequence import fold_features, make_header, parse_header, to_rna, wrap


def _records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """One row per record; the text up to the separator of the next one."""
    return spark.read.option("lineSep", separator).text(path)


# Annotation ----------------------------------------------------------------------------------

def parse_attributes(df: DataFrame, text: str, name: str = "attrs") -> DataFrame:
    """`key "value";` pairs as a map; a repeated key keeps all its values, comma-joined."""
    pairs = F.transform(
        F.regexp_extract_all(text, F.lit(r'(\w+)\s+"([^"]*)"'), F.lit(0)),
        lambda p: F.struct(
            F.regexp_extract(p, r"^(\w+)", 1).alias("k"),
            F.regexp_extract(p, r'"([^"]*)"', 1).alias("v"),
        ),
    )

    def as_map(found: Column) -> Column:
        keys = F.array_distinct(F.transform(found, lambda p: p["k"]))
        values = lambda k: F.transform(F.filter(found, lambda p: p["k"] == k), lambda p: p["v"])
        return F.map_from_entries(
            F.transform(keys, lambda k: F.struct(k.alias("key"), F.array_join(values(k), ",").alias("value")))
        )

    # The pairs are the argument of a lambda, so no plan works them out twice for a line.
    return df.withColumn(name, F.get(F.transform(F.array(pairs), as_map), 0))


def read_annotation(
    spark: SparkSession, path: str, features: Sequence[str] | None = None
) -> DataFrame:
    """Nine-column annotation lines; comments and short lines are skipped.

    The feature filter comes before the attribute text is taken apart.
    """
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    cells = lines.select("value", F.split("value", "\t").alias("f")).where(F.size("f") >= 9)
    if features is not None:
        cells = cells.where(F.get("f", 2).isin(list(features)))
    g = lambda i: F.get("f", i)
    named = cells.select(
        g(0).alias("seqname"), g(1).alias("source"), g(2).alias("feature"),
        g(3).try_cast("long").alias("start"), g(4).try_cast("long").alias("end"),
        g(5).alias("score"), g(6).alias("strand"), g(7).alias("frame"),
        g(8).alias("_text"), F.col("value").alias("line"),
    )
    return parse_attributes(named, "_text").drop("_text")


def filter_annotation(ann: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept lines, target transcripts not found).

    Kept: lines of target transcripts, and `gene` lines of their genes.
    """
    rows = ann.withColumns(
        {
            "transcript_id": F.try_element_at("attrs", F.lit("transcript_id")),
            "gene_id": F.try_element_at("attrs", F.lit("gene_id")),
        }
    )
    # Null-safe joins with ids that are not null: the others make Spark test each line's ids for null in
    # a filter of its own, which takes the attribute text apart once more.
    ids = targets.select(F.col("transcript_id").alias("_id")).where("_id IS NOT NULL")
    own = rows.join(ids, F.col("transcript_id").eqNullSafe(F.col("_id")), "left_semi")
    own_genes = own.select(F.col("gene_id").alias("_gene")).distinct()
    same_gene = F.col("gene_id").eqNullSafe(F.col("_gene")) & F.col("gene_id").isNotNull()
    genes = rows.where("feature = 'gene'").join(own_genes, same_gene, "left_semi")
    kept = own.select(*ann.columns).unionByName(genes.select(*ann.columns))
    there = own.select(F.col("transcript_id").alias("_id"))
    return kept, targets.join(there, F.col("transcript_id").eqNullSafe(F.col("_id")), "left_anti")


# Sequences -----------------------------------------------------------------------------------

def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, header tokens as columns, sequence in RNA letters."""
    text = F.regexp_replace("value", "^>", "")
    rec = _records(spark, path, "\n>").select(text.alias("r")).where("trim(r) <> ''")
    header = F.trim(F.substring_index(F.col("r"), "\n", 1))
    body = F.when(
        F.instr("r", "\n") > 0, F.regexp_replace("r", r"^[^\n]*\n", "")
    ).otherwise(F.lit(""))
    return rec.select(
        *[c.alias(n) for n, c in parse_header(header).items()],
        to_rna(F.regexp_replace(body, r"\s", "")).alias("seq"),
    )


def write_fasta(df: DataFrame, path: str, width: int = 80, mode: str = "error") -> None:
    """Wrapped records in one folder per class; read one folder or all of them."""
    flag = F.col("qc_flag") if "qc_flag" in df.columns else None
    header = make_header(F.col("gene_id"), F.col("tx_id"), F.col("class"), F.col("condition"), flag)
    text = F.concat(F.lit(">"), header, F.lit("\n"), wrap(F.col("seq"), width))
    df.select(text.alias("value"), "class").write.mode(mode).partitionBy("class").text(path)


def read_score_records(spark: SparkSession, path: str) -> DataFrame:
    """(tx_id, scores) from records that start with `#>id`; third field of each data line."""
    rec = _records(spark, path, "#>").where("trim(value) <> ''")
    lines = F.split("value", "\n")
    # The part before the first record mark holds comments only.
    tx = F.regexp_extract(F.get(lines, 0), r"^\s*(\S+)", 1)
    data = F.filter(
        F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))),
        lambda x: (F.trim(x) != "") & ~x.startswith("#"),
    )
    fields = F.transform(data, lambda x: F.split(F.trim(x), r"\s+"))
    scores = F.filter(
        F.transform(fields, lambda f: F.get(f, 2).try_cast("double")), lambda s: s.isNotNull()
    )
    out = rec.where(~F.ltrim("value").startswith("#")).select(
        tx.alias("tx_id"), scores.alias("scores")
    )
    return out.where((F.col("tx_id") != "") & (F.size("scores") > 0))


def parse_fold_lines(df: DataFrame, line: str = "line", digits: int = 4) -> DataFrame:
    """Structure, energy and fold features of `((..)) (-1.20)` lines; NULL without an energy."""
    text = F.trim(F.col(line))
    energy = F.regexp_extract(text, r"\(\s*(-?\d+\.?\d*)\s*\)\s*$", 1).try_cast("double")
    out = df.withColumns(
        {"structure": F.regexp_extract(text, r"^(\S+)", 1), "_mfe": energy}
    )
    return out.withColumns(fold_features(F.col("structure"), F.col("_mfe"), digits)).drop("_mfe")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, seq_id, transcript_id) from cluster blocks that list their members."""
    rec = _records(spark, path, ">Cluster").where("trim(value) <> ''")
    number = F.regexp_extract("value", r"^\s*(\d+)", 1).try_cast("long")
    members = F.regexp_extract_all("value", F.lit(r">(\S+)"), F.lit(1))
    out = rec.select(number.alias("cluster_id"), F.explode(members).alias("seq_id"))
    out = out.withColumn("seq_id", F.regexp_replace("seq_id", r"\.+$", ""))
    return out.withColumn("transcript_id", F.coalesce(
        F.get(F.split("seq_id", r"\|"), 1), F.col("seq_id")))
