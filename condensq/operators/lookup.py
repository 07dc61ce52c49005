"""Lookups of stored scores for a table of requested ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condensq.functions.arrays import drop_null_map
from condensq.functions.labels import confidence, label_text
from condensq.operators.retrieval import retrieve_if
from condensq.operators.tables import lookup_fallback, mapping_coverage
from condensq.schemas import ATTRIBUTION_FEATURES


def lookup(ids: DataFrame, predictions: DataFrame) -> DataFrame:
    """Stored score, label, confidence and attribution map per requested id.

    Ids match in upper case; an unknown id gets status `not_found`.
    """
    asked = ids.select(F.upper(F.trim("gene_id")).alias("gene_id"))
    out = asked.join(predictions, "gene_id", "left")
    found = F.col("prob_pos").isNotNull()
    shap = drop_null_map({c: F.col(f"shap_{c}") for c in ATTRIBUTION_FEATURES})
    return out.select(
        "gene_id",
        F.when(found, "found").otherwise("not_found").alias("status"),
        F.bround("prob_pos", 6).alias("prob_pos"),
        F.when(found, label_text(F.col("pred"))).alias("prediction"),
        F.when(found, confidence(F.col("prob_pos"))).alias("confidence"),
        F.when(found, shap).alias("top_shap"),
    )


def compare_ids(
    ids: DataFrame, predictions: DataFrame, queries: DataFrame, chunks: DataFrame,
    min_prob: float = 0.8, k: int = 5,
) -> DataFrame:
    """Lookup rows side by side with passages for the certain ones.

    ids: query_id, gene_id; queries: query_id, embedding.
    """
    keyed = ids.withColumn("gene_id", F.upper(F.trim("gene_id")))
    found = keyed.join(lookup(ids.select("gene_id").distinct(), predictions), "gene_id", "left")
    return retrieve_if(found, queries, chunks, min_prob, k)


def map_accessions(
    ids: DataFrame, references: DataFrame, names: DataFrame, cache: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(ids with accession, coverage counts).

    Order: cached answer, direct reference, gene name, upper-cased reference. Each mapping has
    columns key and value; a cached NULL is a known miss and ends the search.
    """
    g = F.col("gene_id")
    steps = [(references, g), (names, g), (references, F.upper(g))]
    if cache is None:
        out = lookup_fallback(ids, steps, "gene_id", "accession")
        return out, mapping_coverage(out, "accession")
    known = cache.select(F.col("key").alias("gene_id"), F.col("value").alias("_cached"),
                         F.lit(True).alias("_known"))
    marked = ids.join(known, "gene_id", "left")
    fresh = lookup_fallback(
        marked.where("_known IS NULL").select("gene_id").distinct(), steps, "gene_id", "accession"
    )
    out = marked.join(fresh, "gene_id", "left").withColumn(
        "accession", F.when(F.col("_known"), F.col("_cached")).otherwise(F.col("accession"))
    ).drop("_cached", "_known")
    return out, mapping_coverage(out, "accession")
