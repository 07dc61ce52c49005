"""Helpers shared by the corpus operators: batches, bucketed prefix sums and components.

Every operator reads the columns it names and no others, so extra columns of any name do no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from condensq.session import checkpoint_dir, cut_lineage

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A batch of very long texts has to fit beside the heap.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for written intermediate files in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared checkpoint folder and read back: later steps read it, whatever
    executors are lost, and its columns are compressed."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def slices(
    batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 8 << 20
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `max_bytes` of text at most (one row at least)."""
    for batch in batches:
        start, total = 0, 0
        lengths = [n or 0 for n in pc.binary_length(batch.column(text)).to_pylist()]
        for i, n in enumerate(lengths):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def buckets_for(rows: int, per_bucket: int = 50_000) -> int:
    return max(1, -(-rows // per_bucket))


def with_rank(df: DataFrame, keys: list[str], order: list[str], n_buckets: int) -> DataFrame:
    """`rank`: 0, 1, ... inside `keys`, by (bucket, order), where the bucket is a digest of `order`.

    No task holds a whole key: windows run inside (keys, bucket) and bucket counts carry on. Rows
    equal in keys and order get ranks of their own in any order.
    """
    inside = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n_buckets)).cast("int"))
    counts = inside.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *(F.col(k).alias(f"_k_{k}") for k in keys),
        F.col("_b").alias("_ob"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    ranked = inside.withColumn("_rn", F.row_number().over(w) - 1)
    same = F.col("_b") == F.col("_ob")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return ranked.join(offsets, same).select(
        *df.columns, (F.col("_rn") + F.col("_offset")).cast("long").alias("rank")
    )


def range_cuts(df: DataFrame, column: str, n_buckets: int) -> list:
    """At most `n_buckets - 1` cut points of a number column, close to equal shares of the rows."""
    if n_buckets < 2:
        return []
    at = [i / n_buckets for i in range(1, n_buckets)]
    found = df.select(F.percentile_approx(column, at, 100 * n_buckets)).first()[0]
    return sorted(set(found or []))


def range_bucket(value: Column, cuts: list) -> Column:
    """Number of cut points at or below the value, by binary search; null counts as below all."""
    if not cuts:
        return F.lit(0)
    mid = len(cuts) // 2
    upper = range_bucket(value, cuts[mid + 1 :])
    return F.when(value >= F.lit(cuts[mid]), upper + F.lit(mid + 1)).otherwise(
        range_bucket(value, cuts[:mid])
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge between two nodes.

    Alternating large-star and small-star steps (Kiveris et al. 2014) until the edges stand still.
    A step moves each edge once, so a hub costs what its edges cost; minima combine before the
    shuffle and AQE splits a hub's join.
    """
    links = edges.select(
        F.greatest(a, b).alias("x"), F.least(a, b).alias("y")
    ).filter("x > y").distinct()
    links = cut_lineage(links)
    before = None
    while True:
        both = links.union(links.select("y", "x")).toDF("x", "y")
        low = both.groupBy(F.col("x").alias("k")).agg(F.min("y").alias("m"))
        low = low.withColumn("m", F.least("m", "k"))
        large = both.join(low, F.col("x") == F.col("k")).filter("y > x")
        large = large.select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        low = large.groupBy(F.col("x").alias("k")).agg(F.min("y").alias("m"))
        joined = large.join(low, F.col("x") == F.col("k"))
        small = joined.select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x > y")
        links = cut_lineage(small.union(joined.select("x", "m")).toDF("x", "y").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = links.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct()
    return links.select(F.col("x").alias("node"), F.col("y").alias("component")).union(roots)
