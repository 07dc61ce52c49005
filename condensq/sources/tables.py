"""Tables between stages: typed reads, writes, the star schema, ad-hoc SQL over files."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from condensq.functions.numeric import nan_to_null, to_number
from condensq.operators.tables import union_loose
from condensq.schemas import STAR


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header (by suffix) or Parquet; NaN becomes NULL."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if ".csv" in os.path.basename(path.rstrip("/")):
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
        return nan_to_null(reader.csv(path))
    return nan_to_null(reader.parquet(path))


def _exists(spark: SparkSession, path: str) -> bool:
    """True if the path (or a pattern) matches a file on whatever file system it names."""
    try:
        return bool(spark.read.format("binaryFile").load(path).select("path").take(1))
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return False
        raise


# Coordinate columns per splice event type; 0-based starts end in `_0base`,
# and an intron runs from the upstream exon end to the downstream exon start.
EVENT_COLUMNS = {
    "SE": [("exonStart_0base", "exonEnd")],
    "RI": [("upstreamEE", "downstreamES")],
    "A3SS": [("longExonStart_0base", "longExonEnd")],
    "A5SS": [("longExonStart_0base", "longExonEnd")],
    "MXE": [("1stExonStart_0base", "1stExonEnd"), ("2ndExonStart_0base", "2ndExonEnd")],
}
EVENT_FILE = "{type}.MATS.JC.txt"
# Fixed values end.


def read_quoted_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text read without quoting; quotes are stripped from every cell."""
    raw = (
        spark.read.option("sep", "\t").option("quote", "").option("header", True)
        .option("mode", "PERMISSIVE").csv(path)
    )
    names = [c.strip('"') for c in raw.columns]
    return raw.toDF(*names).select(
        *[F.trim(F.btrim(F.col(f"`{c}`"), F.lit('"'))).alias(c) for c in names]
    )


def read_tagged_files(
    spark: SparkSession, paths: dict[tuple[str, str], str]
) -> DataFrame | None:
    """Sibling files tagged (event_type, condition); missing ones are left out."""
    parts = [
        read_quoted_tsv(spark, path).withColumns(
            {"event_type": F.lit(kind), "condition": F.lit(cond)}
        )
        for (kind, cond), path in paths.items()
        if _exists(spark, path)
    ]
    return union_loose(*parts) if parts else None


def read_events(
    spark: SparkSession, dirs: dict[str, str], genes: DataFrame | None = None
) -> DataFrame | None:
    """Splice events of all types and conditions on one coordinate layout (1-based starts).

    `dirs` maps a condition to its folder. With `genes`, only events of those genes are kept.
    """
    paths = {
        (kind, cond): f"{folder}/{EVENT_FILE.format(type=kind)}"
        for cond, folder in dirs.items()
        for kind in EVENT_COLUMNS
    }
    raw = read_tagged_files(spark, paths)
    if raw is None:
        return None
    raw = raw.withColumnRenamed("GeneID", "gene_id")
    if genes is not None:
        raw = raw.join(genes.select("gene_id"), "gene_id", "left_semi")

    def region(i: int, side: int):
        expr = F.lit(None).cast("long")
        for kind, spans in EVENT_COLUMNS.items():
            if i < len(spans) and spans[i][side] in raw.columns:
                value = to_number(F.col(f"`{spans[i][side]}`")).cast("long")
                value = value + 1 if side == 0 else value
                expr = F.when(F.col("event_type") == kind, value).otherwise(expr)
        return expr

    number = lambda c: to_number(F.col(c)) if c in raw.columns else F.lit(None).cast("double")
    return raw.select(
        "gene_id", F.col("chr").alias("contig"),
        F.concat_ws(":", "condition", "event_type", "ID").alias("event_id"),
        "event_type", "condition",
        region(0, 0).alias("region1_start"), region(0, 1).alias("region1_end"),
        region(1, 0).alias("region2_start"), region(1, 1).alias("region2_end"),
        number("IncLevelDifference").alias("dpsi"), number("PValue").alias("p_value"),
        number("FDR").alias("fdr"),
    )


#: Ends an entry of a map of maps; files are cut here, so many tasks read one file.
_ENTRY_END = "},"


def _entries(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """(key, entry) of a file that is one JSON map, or with `lines` one map per line; `entry` is a
    variant, so no field has to be known.

    A file of one map is cut where entries end, wherever that is in the file. The ends of the pieces
    are put right and each is parsed alone. Where a piece is no map (an entry holds a map of its own
    in its middle, or a text with such an end in it), the file is parsed as a whole instead.
    """
    if lines:
        maps = spark.read.text(path).select(F.parse_json("value").alias("map"))
    else:
        piece = spark.read.option("lineSep", _ENTRY_END).text(path).where("trim(value) RLIKE '[^{}\\\\s]'")
        body = F.concat(F.lit("{"), F.regexp_replace("value", r"^\s*\{", ""))
        last = F.try_parse_json(body)
        maps = piece.select(F.coalesce(F.try_parse_json(F.concat(body, F.lit("}}"))), last).alias("map"))
        if not maps.where("map IS NULL").isEmpty():
            maps = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("map"))
    found = maps.lateralJoin(spark.tvf.variant_explode(F.col("map").outer()))
    return found.select("key", F.col("value").alias("entry"))


def read_state(spark: SparkSession, paths: list[str], lines: bool = False) -> DataFrame:
    """Key to status maps of several JSON files; for a key in two files the later file wins.

    A file is one map, or with `lines` one map per line. `entry` keeps what a state file says beside
    the known fields.
    """
    types = {"status": "string", "n_conformations": "bigint", "runtime_sec": "double",
             "error": "string", "timestamp": "string"}
    fields = [F.try_variant_get("entry", f"$.{c}", t).alias(c) for c, t in types.items()]
    parts = [
        _entries(spark, p, lines).select("key", F.lit(i).alias("file"), *fields, "entry")
        for i, p in enumerate(paths)
    ]
    merged = reduce(DataFrame.unionByName, parts)
    return merged.groupBy("key").agg(
        F.max_by(F.struct(*types, "entry"), F.struct("file", "timestamp")).alias("s")
    ).select("key", "s.*")


def query_csv(spark: SparkSession, path: str, sql: str, view: str = "csv") -> DataFrame:
    """SQL straight over a CSV file with a header, known as `csv` in the text."""
    spark.read.option("header", True).option("inferSchema", True).csv(
        path
    ).createOrReplaceTempView(view)
    return spark.sql(sql)


def write_table(df: DataFrame, path: str, mode: str = "error", kind: str = "parquet") -> None:
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Project to a table layout: columns on both sides, typed; absent ones are NULL."""
    have = set(df.columns)
    return nan_to_null(
        df.select(
            *[
                (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in schema
            ]
        )
    )


def write_star(tables: dict[str, DataFrame], path: str) -> None:
    """Rebuild the star tables from scratch."""
    for name, df in tables.items():
        conform(df, STAR[name]).write.mode("overwrite").parquet(f"{path}/{name}")


def star_violations(genes: DataFrame, features: DataFrame, predictions: DataFrame) -> DataFrame:
    """Primary and foreign key breaches, which Spark does not enforce."""
    out = None
    for name, df in (("genes", genes), ("features", features), ("predictions", predictions)):
        twice = df.groupBy("gene_id").count().where("count > 1 OR gene_id IS NULL")
        rows = twice.select("gene_id", F.lit(f"{name}: duplicate or missing key").alias("problem"))
        if name != "genes":
            orphan = df.join(genes.select("gene_id"), "gene_id", "left_anti")
            rows = rows.unionByName(
                orphan.select("gene_id", F.lit(f"{name}: no such gene").alias("problem"))
            )
        out = rows if out is None else out.unionByName(rows)
    return out


def register_star(spark: SparkSession, path: str, prefix: str = "") -> None:
    """Temporary views over the written star tables."""
    if prefix and not re.fullmatch(r"\w+", prefix):
        raise ValueError(f"not a name: {prefix}")
    for name in STAR:
        view = f"{prefix}_{name}" if prefix else name
        spark.read.parquet(f"{path}/{name}").createOrReplaceTempView(view)


def export_bi(importance: DataFrame, landscape: DataFrame, history: DataFrame, path: str) -> None:
    """Three flat tables for reporting tools. Only the two small ones become single files."""
    write_table(importance.coalesce(1), f"{path}/feature_importance", "overwrite", "csv")
    write_table(landscape, f"{path}/probability_landscape", "overwrite", "csv")
    write_table(history.coalesce(1), f"{path}/pipeline_history", "overwrite", "csv")
