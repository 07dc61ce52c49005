"""Similarity clusters of sequences: exact prefix-filter join, connected components.

Every pair at or above the threshold counts. Members of one class are not compared with each other
once they are known to be linked, so a large group of near copies costs linear work.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from condensq.session import cut_lineage, fits


def shingles(df: DataFrame, text: str, k: int, unit: str = "chars", name: str = "items"):
    """Add the distinct hashed runs of k characters or k words of a text.

    A shorter text is one run; a text without characters or words has none. The pieces are a
    column of their own first: inside the lambda they would be cut again for every run.
    """
    if unit == "chars":
        pieces = F.split(text, "")
    else:
        pieces = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    pieces = F.filter(pieces, lambda t: t != "")
    n = F.size("_pieces")
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))),
        lambda i: F.xxhash64(F.slice("_pieces", i, k)),
    )
    out = df.withColumn("_pieces", pieces)
    none = F.array().cast("array<bigint>")
    return out.withColumn(
        name, F.when(n > 0, F.array_sort(F.array_distinct(runs))).otherwise(none)
    ).drop("_pieces")


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.try_divide(common.cast("double"), F.size(a) + F.size(b) - common)


def common_items(sets: DataFrame, most: int = 200_000, share: int = 16) -> np.ndarray:
    """Items that many sets hold, rarest first: an estimate from one set in `share`. It only orders
    the items of a set, so it decides what a join costs and not what it finds."""
    part = sets.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0) if share > 1 else sets
    # A plain explode infers a filter on `items`, which would cut each text again for every run.
    part = part.select(F.explode_outer("items").alias("h"))
    counts = part.groupBy("h").agg(F.count("h").alias("c")).where("c >= 8")
    # As an array: so many row objects would take tens of megabytes of the driver.
    found = counts.orderBy(F.desc("c"), "h").limit(most).select("h").toArrow()
    return found.column("h").to_numpy()[::-1].astype(np.int64)


def prefix_of(items: np.ndarray, common: np.ndarray, threshold: float) -> np.ndarray:
    """The first items of a set in one order for all sets: common items last, others by hash. Two sets
    at least `threshold` alike share an item of these."""
    keep = len(items) - math.ceil(threshold * len(items) - 1e-9) + 1
    order = np.argsort(common)
    at = np.searchsorted(common, items, sorter=order)
    place = order[np.minimum(at, len(order) - 1)] if len(order) else np.zeros(len(items), np.int64)
    known = common[place] == items if len(order) else np.zeros(len(items), bool)
    return items[np.lexsort((items, np.where(known, place + 1, 0)))][:keep]


def prefix_items(sets: DataFrame, common: np.ndarray, threshold: float) -> DataFrame:
    """(item, id, n, pos): the prefix of each set of distinct `items`, its size and places."""
    held = sets.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = batch.column("items").offsets.to_numpy(), batch.column("items").values
            values = values.to_numpy(zero_copy_only=False)
            parts = [prefix_of(values[i:j], held.value, threshold) for i, j in zip(offsets, offsets[1:])]
            if parts:
                sizes = np.array([len(p) for p in parts])
                at = np.repeat(np.arange(len(parts)), sizes)
                place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.record_batch(
                    [pa.array(np.concatenate(parts)), batch.column("id").take(pa.array(at)),
                     pa.array(np.diff(offsets)[at].astype(np.int32)), pa.array(place.astype(np.int32))],
                    ["item", "id", "n", "pos"],
                )

    kind = sets.schema["id"].dataType.simpleString()
    return sets.select("id", "items").mapInArrow(run, f"item long, id {kind}, n int, pos int")


def _possible(a: str, b: str, threshold: float) -> Column:
    """Sizes and places of a common item leave room for `threshold`."""
    na, nb, pa_, pb = (F.col(f"{x}.{c}") for c in ("n", "pos") for x in (a, b))
    room = F.least(pa_, pb) + 1 + F.least(na - pa_ - 1, nb - pb - 1)
    return (F.least(na, nb) >= threshold * F.greatest(na, nb) - 1e-9) & (
        room >= threshold / (1 + threshold) * (na + nb) - 1e-9
    )


def alike_links(
    prefixes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float, large: int = 16
) -> DataFrame:
    """(src, dst): links whose components are those of all pairs of sets at least `threshold` alike.

    `prefixes` has `prefix_items` of sets, `sets_of` gives (id, items) of a frame of ids. Sets that
    share a prefix item are candidates; sizes and places rule most out and the whole sets decide.
    Where more than `large` sets share an item, they first meet one of them twice over, so that near
    copies are one class at linear cost; then all pairs of different classes are compared.
    """

    def alike(pairs: DataFrame) -> DataFrame:
        pairs = cut_lineage(pairs.distinct())
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        sets = sets_of(ids)
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(
            sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b"
        )
        same = both.where(jaccard(F.col("x"), F.col("y")) >= threshold)
        return cut_lineage(same.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())

    w = Window.partitionBy("item")
    # The one large shuffle: flat rows, size and place in one number, structs only behind it.
    packed = F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")
    dealt = prefixes.select("item", "id", packed.alias("at")).repartition("item")
    n, pos = F.shiftright("at", 32).cast("int"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    listed = dealt.select("item", F.struct("id", n.alias("n"), pos.alias("pos")).alias("me"))
    listed = listed.withColumn("head", F.min("me").over(w)).withColumn("last", F.max("me").over(w))
    listed = listed.where("head.id <> last.id").drop("last").dropDuplicates(["item", "me"])
    listed = cut_lineage(listed)
    crowded = listed.groupBy("item").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > large)
    pending = cut_lineage(listed.join(crowded.select("item"), "item", "left_semi"))
    links = None
    for again in (True, False):
        paired = pending.where("me.id <> head.id")
        tried = paired.where(_possible("head", "me", threshold))
        found = alike(tried.select(F.col("head.id").alias("a"), F.col("me.id").alias("b")))
        links = found if links is None else links.unionByName(found)
        if again:
            linked = (F.col("head.id") == F.col("src")) & (F.col("me.id") == F.col("dst"))
            rest = paired.join(found, linked, "left_anti").select("item", "me")
            pending = cut_lineage(rest.withColumn("head", F.min("me").over(w)))
    classes = connected_components(links).select(F.col("id").alias("_id"), "component")
    placed = listed.join(classes, F.col("me.id") == F.col("_id"), "left").select(
        "item", "me", F.coalesce("component", "me.id").alias("class")
    )
    placed = cut_lineage(placed)
    kinds = placed.select("item", "class").distinct()
    left, right = (kinds.select("item", F.col("class").alias(c)) for c in ("ca", "cb"))
    apart = left.join(right, "item").where("ca < cb")
    pairs = apart.join(placed.select("item", F.col("class").alias("ca"), F.col("me").alias("p")), ["item", "ca"])
    pairs = pairs.join(placed.select("item", F.col("class").alias("cb"), F.col("me").alias("q")), ["item", "cb"])
    pairs = pairs.where(_possible("p", "q", threshold))
    # All common items of two prefixes are counted here; beyond them one set has only its rest.
    pairs = pairs.groupBy(F.col("p.id").alias("a"), F.col("q.id").alias("b")).agg(
        F.count(F.lit(1)).alias("c"), F.first("p.n").alias("na"), F.first("q.n").alias("nb")
    )
    rest = F.ceil(threshold * F.greatest("na", "nb") - 1e-9) - 1
    enough = F.col("c") + rest >= threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9
    pairs = pairs.where(enough).select("a", "b")
    return links.unionByName(alike(pairs))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest id of each component, for ids that occur in an edge.

    Every round each node takes the least label around it, then the label's own label.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(
        edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    ).distinct()
    both = cut_lineage(both)
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("c"))
    labels = cut_lineage(labels)
    while True:
        around = (
            both.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("c").alias("n"))
        )
        lower = labels.join(around, "id").select(
            "id", F.least("c", "n").alias("n"), F.col("c").alias("old")
        )
        hop = labels.select(F.col("id").alias("n"), F.col("c").alias("hop"))
        moved = lower.join(hop, "n", "left").select(
            "id", F.least("n", F.coalesce("hop", "n")).alias("c"), "old"
        )
        moved = cut_lineage(moved)
        labels = moved.select("id", "c")
        if moved.where("c <> old").isEmpty():
            return labels.select("id", F.col("c").alias("component"))


def similarity_clusters(
    df: DataFrame,
    id_col: str,
    seq: str,
    k: int = 8,
    threshold: float = 0.6,
    unit: str = "chars",
) -> DataFrame:
    """(id, cluster_id): cluster_id is the smallest id of the cluster.

    Identity along an alignment is approximated by the Jaccard share of common k-mers, and all pairs
    of `threshold` or more are linked. Sequences
    with equal k-mer sets are merged beforehand; those without any k-mer stay alone.
    """
    # Two independent 64-bit hashes and the size identify a set of runs.
    digest = F.struct(F.xxhash64("items"), F.xxhash64(F.lit(1), "items"), F.size("items"))
    texts = df.select(F.col(id_col).alias("id"), F.col(seq).alias("text"))

    def sets_of(ids: DataFrame) -> DataFrame:
        """Cut again from the texts where they are needed: sets take more room than texts."""
        ids = F.broadcast(ids) if fits(ids, 1_000_000) else ids
        return shingles(texts.join(ids, "id", "left_semi"), "text", k, unit).select("id", "items")

    table = shingles(texts, "text", k, unit).select(
        "id", digest.alias("digest"), (F.size("items") > 0).alias("filled")
    )
    table = cut_lineage(table)
    filled = table.where("filled")
    copies = cut_lineage(filled.groupBy("digest").agg(F.min("id").alias("rep")))
    member = filled.select("id", "digest").join(copies, "digest").select("id", "rep")
    sets = sets_of(copies.select(F.col("rep").alias("id")))
    prefixes = prefix_items(sets, common_items(sets), threshold)
    links = alike_links(prefixes, sets_of, threshold)
    comp = connected_components(links).select(F.col("id").alias("rep"), "component")
    grouped = member.join(comp, "rep", "left").select(
        "id", F.coalesce("component", "rep").alias("cluster_id")
    )
    alone = table.where("NOT filled").select("id", F.col("id").alias("cluster_id"))
    return grouped.unionByName(alone).withColumnRenamed("id", id_col)

