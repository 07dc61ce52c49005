"""A corpus pipeline: toxic documents go, repeated line blocks go, one document of each group of
near copies stays, sources are mixed to their targets, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given. All stages but the last
return the columns of documents; a stage's result is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condensq.llm import lines, mixing, near_copies, packing, toxicity
from condensq.llm.common import documents, n_words, stored


def _carried(docs: DataFrame, *names: str) -> DataFrame:
    """doc_id, text, the named columns, and all others in one struct, so that columns of any name
    pass a stage unread and unchanged."""
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    return docs.select("doc_id", "text", *names, others.alias("_doc"))


def _given_back(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` from rows of `_carried`, with the text these have now."""
    doc = F.col("_doc")
    return found.select(
        *(F.col("text") if c == "text" else doc.getField(c).alias(c) for c in docs.columns)
    )


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the severity model does not reject. Null and empty texts stay; without labels of
    both kinds all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.score(_carried(docs), toxicity.fit(docs, labels))
    return _given_back(scored.filter("not rejected"), docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line blocks of earlier ones; those with no word left go. Null and empty
    texts stay. Of equal texts the smallest id keeps its lines."""
    found = lines.dedup_lines(_carried(docs)).filter((F.col("n_deleted") == 0) | (n_words(F.col("text")) > 0))
    kept = _given_back(found, docs)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles of a Jaccard share of 0.8 or more: the
    smallest id, of equal ids the smallest digest of text. Texts without words are one group."""
    return _given_back(near_copies.one_of_each(_carried(docs), shingle=5, threshold=0.8), docs)


def one_of_near_fingerprints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As `one_of_near_copies`, of groups that SimHash fingerprints link too: those of `op1_simhash`,
    which differ in 2 bits at most. The shingles find the near copies that lie further apart."""
    found = near_copies.one_of_each(_carried(docs), shingle=5, threshold=0.8, budget=2)
    return _given_back(found, docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, as often as it takes them. Texts without words are not taken."""
    return _given_back(mixing.mixed(_carried(docs, "source")), docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 2048 ids."""
    return packing.pack(docs, keep_cache=False)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash", one_of_near_fingerprints),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: Models, digests and encoders are beyond SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
