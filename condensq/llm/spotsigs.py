"""SpotSigs fingerprints with DataFrame functions only.

A spot is a common word (anchor). Its signature is the anchor with the chain of content words, those
that are not common, which follow it within a span. A text's fingerprint is the set of its
signatures; likeness is the Jaccard share of common signatures.

Edge cases: a text without anchors has a spot at each word; one without words (null counts as
empty) has one signature, its own digest, so equal texts always have equal fingerprints and sets are
never empty; repeated rows and ids count each, in order of id, then of text digest; rows without an
id come last; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Common words of English, French, German and Spanish (fixed values).
COMMON = (
    "a an and are as at be by for from has have he her his i in is it its not of on or she that the "
    "their there they this to was were what when which who will with you "
    "au aux ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas "
    "plus pour qu que qui sa se ses son sur un une vous "
    "als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für im "
    "ist mit nach nicht noch nur oder sein sich sie sind so und um von vor wie wird zu zum zur "
    "al con como del el ella ellos era esta este fue ha hay lo los las más mi muy no nos para pero "
    "por si sin su sus también te todo un una y ya"
).split()


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def signatures(df: DataFrame, text: str, into: str, chain: int = 3, span: int = 8) -> DataFrame:
    """`df` with the sorted distinct 32-bit signatures of a text column."""
    words, spots = f"_{into}_words", f"_{into}_spots"

    def following(i: Column) -> Column:
        content = F.filter(F.slice(F.col(words), i + 2, span), lambda y: ~y.isin(COMMON))
        return F.slice(content, 1, chain)

    df = df.withColumn(words, _words(F.coalesce(F.col(text), F.lit(""))))
    at_anchors = F.transform(
        F.col(words), lambda x, i: F.when(x.isin(COMMON), F.hash(x, following(i)))
    )
    df = df.withColumn(spots, F.array_compact(at_anchors))
    everywhere = F.transform(F.col(words), lambda x, i: F.hash(F.slice(F.col(words), i + 1, chain)))
    own = F.array(F.hash(F.coalesce(F.col(text), F.lit(""))))
    found = (
        F.when(F.size(spots) > 0, F.col(spots)).when(F.size(words) > 0, everywhere).otherwise(own)
    )
    return df.withColumn(into, F.array_sort(F.array_distinct(found))).drop(words, spots)


def likeness(a: str, b: str) -> Column:
    """Jaccard share of two signature sets."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def printed(signature_set: str) -> Column:
    """Fingerprint as text: its signatures in order."""
    return F.array_join(F.col(signature_set).cast("array<string>"), " ")


def _bucket_cuts(docs: DataFrame, rows_each: int) -> list:
    """Smallest ids of range buckets but the lowest, from Spark's own range partitioning."""
    n = docs.count()
    buckets = min(100_000, max(1, math.ceil(n / rows_each)))
    if buckets == 1:
        return []
    ids = docs.select("doc_id").repartitionByRange(buckets, "doc_id")
    low = ids.groupBy(F.spark_partition_id().alias("part")).agg(F.min("doc_id").alias("low"))
    found = sorted({r["low"] for r in low.collect() if r["low"] is not None})  # one a bucket
    return found[1:]


def _bucket(value: Column, cuts: list) -> Column:
    """Number of cuts at or below the value (0 for null), by binary search."""
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    if not steps:
        return F.lit(0)
    held = F.lit(cuts)
    return F.aggregate(
        F.lit(steps), F.lit(0),
        lambda at, step: F.when(F.get(held, at + step - 1) <= value, at + step).otherwise(at),
    )


def with_next(docs: DataFrame, rows_each: int = 4000) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs): each document with the next one in descending
    doc_id, the last with the first.

    Texts are dealt once, into range buckets; a bucket also gets the first document of the one
    after it, so no row looks beyond its bucket.
    """
    narrow = docs.select("doc_id", "text")
    cuts = _bucket_cuts(docs, rows_each)
    placed = narrow.withColumn("_bucket", _bucket(F.col("doc_id"), cuts))
    heads = placed.groupBy("_bucket").agg(F.max("doc_id").alias("_head")).collect()  # one a bucket
    heads.sort(key=lambda r: -r["_bucket"])
    before = [heads[-1], *heads[:-1]] if heads else []
    kind = docs.schema["doc_id"].dataType.simpleString()
    guests = docs.sparkSession.createDataFrame(
        [(r["_head"], b["_bucket"]) for r, b in zip(heads, before)], f"_head {kind}, _bucket int"
    )
    extra = narrow.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("_head"))).drop("_head")
    every = placed.withColumn("_guest", F.lit(0)).unionByName(extra.withColumn("_guest", F.lit(1)))
    every = every.withColumn("text", F.coalesce("text", F.lit("")))
    order = Window.partitionBy("_bucket").orderBy(
        "_guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text"
    )
    every = every.withColumn("next_text", F.lead("text").over(order))
    every = signatures(every, "text", "sigs").withColumn("next_sigs", F.lead("sigs").over(order))
    return every.filter("_guest = 0").drop("_guest", "_bucket")


def edited(text: str = "text", next_text: str = "next_text") -> Column:
    """A text whose last half of code points gives way to as many of the next text (or all of it)."""
    half = F.floor(F.length(text) / 2).cast("int")
    head = F.substring(F.col(text), F.lit(1), F.length(text) - half)
    return F.concat(head, F.substring(F.col(next_text), F.lit(1), half))


def near_pairs(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness) of distinct signature sets at least `threshold` alike.

    `df` has doc_id and sigs; a set is named by its smallest doc_id. Sets are partitioned by length
    in geometric steps: only neighbouring partitions can hold a pair. A pair shares one of its
    rarest signatures (prefix filter); lengths are checked before sets are.
    """
    sets = df.groupBy("sigs").agg(F.min("doc_id").alias("id")).withColumn("n", F.size("sigs"))
    rare = sets.select(F.explode("sigs").alias("s")).groupBy("s").agg(F.count("*").alias("c"))
    ranked = sets.select("id", "n", F.explode("sigs").alias("s")).join(rare, "s")
    prefix = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    few = ranked.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("o"))
    few = few.select("id", "n", F.explode(F.slice(F.col("o"), F.lit(1), prefix.cast("int"))).alias("o"))
    part = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9)
    few = few.select("id", "n", F.col("o.s").alias("s"), part.alias("p"))
    left = few.select(F.col("id").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array("p", F.col("p") + 1)).alias("p"))
    right = few.select(F.col("id").alias("b"), F.col("n").alias("nb"), "s", "p")
    pairs = left.join(right, ["s", "p"]).filter(
        (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    )
    pairs = pairs.filter(F.col("na") >= threshold * F.col("nb") - 1e-9).select("a", "b").distinct()
    sa = sets.select(F.col("id").alias("a"), F.col("sigs").alias("sa"))
    sb = sets.select(F.col("id").alias("b"), F.col("sigs").alias("sb"))
    found = pairs.join(sa, "a").join(sb, "b").withColumn("likeness", likeness("sa", "sb"))
    return found.filter(F.col("likeness") >= threshold - 1e-9).select("a", "b", "likeness")
