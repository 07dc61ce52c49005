"""One document of each group of near copies: word shingles at least `threshold` alike.

Every pair of different shingle sets with a Jaccard share of `threshold` or more is linked (prefix
filter, whole sets compared), and components of links are groups. Texts of equal sets are one class
beforehand, so copies make no pairs. With a `budget`, texts whose SimHash fingerprints (those of
`simhash`) differ in that many bits at most are linked too, by the trie's self-join.

Edge cases: texts without words (null counts as one) are a class of their own; a text of fewer words
than a shingle is one run; ids may repeat or miss, as a row is known by its id and its text; of equal
rows one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from condensq.llm import simhash
from condensq.llm.common import components, slices
from condensq.operators.similarity import alike_links, common_items, prefix_of
from condensq.session import cut_lineage, fits

_ODD = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit digests of the word runs of a text, as signed numbers.

    A-Z become a-z, and words end at the six ASCII white-space characters, as in `simhash`.
    """
    words = (text or "").encode().lower().split()
    codes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    k = min(shingle, len(codes))
    if not k:
        return np.zeros(0, np.int64)
    n = len(codes) - k + 1
    runs = np.full(n, k, np.uint64)
    for i in range(k):
        runs = _mixed(runs * np.uint64(_ODD) + codes[i : i + n])
    return np.unique(runs.view(np.int64))


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, items) of each text: the set and its digest, by which the set is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            sets = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
            ids = [xxh64_intdigest(s.tobytes()) for s in sets]
            yield pa.record_batch(
                [pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sets, pa.list_(pa.int64()))],
                ["id", "items"],
            )

    return docs.select("text").mapInArrow(run, "id long, items array<long>")


def _prefixes(docs: DataFrame, shingle: int, common: np.ndarray, threshold: float) -> DataFrame:
    """(item, id, n, pos): the prefix of each text's set; the set itself does not leave the task."""
    held = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            items, ids, sizes, places = [], [], [], []
            for text in batch.column("text").to_pylist():
                own = shingle_set(text, shingle)
                first = prefix_of(own, held.value, threshold)
                name = np.uint64(xxh64_intdigest(own.tobytes())).astype(np.int64)
                items.append(first)
                ids.append(np.full(len(first), name))
                sizes.append(np.full(len(first), len(own), np.int32))
                places.append(np.arange(len(first), dtype=np.int32))
            columns = (np.concatenate(c) for c in (items, ids, sizes, places))
            yield pa.record_batch([pa.array(c) for c in columns], ["item", "id", "n", "pos"])

    return docs.select("text").mapInArrow(run, "item long, id long, n int, pos int")


def _classes(docs: DataFrame, shingle: int, prints: bool) -> DataFrame:
    """(row, doc_id, text_key, id, fp): `id` is the digest of the row's shingle set, `fp` the SimHash
    fingerprint if `prints` ask for it, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            sets = (shingle_set(t, shingle) for t in texts)
            ids = np.array([xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            fps = np.array([simhash.fingerprint_of(t) if prints else 0 for t in texts], np.int64)
            yield pa.record_batch(
                [*(batch.column(c) for c in ("row", "doc_id", "text_key")), pa.array(ids), pa.array(fps)],
                ["row", "doc_id", "text_key", "id", "fp"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(_row().alias("row"), "doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, f"row string, doc_id {kind}, text_key long, id long, fp long")


def _row():
    """Name of a row: its id, and two digests of its text."""
    digests = (F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit(1), "text")))
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), *digests)


def _print_links(rows: DataFrame, budget: int) -> DataFrame:
    """(src, dst): links between classes whose fingerprints differ in `budget` bits at most. A class
    is linked to the least class of its fingerprint, and these by the trie's self-join."""
    known = rows.select("id", "fp").distinct()
    points = cut_lineage(known.groupBy("fp").agg(F.min("id").alias("rep")))
    own = known.join(points, "fp").select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    return own.union(simhash.links(points, budget))


def near_classes(
    docs: DataFrame, shingle: int = 5, threshold: float = 0.8, budget: int | None = None
) -> DataFrame:
    """(row, doc_id, component): a row for each row of `docs`."""
    rows = cut_lineage(_classes(docs, shingle, budget is not None))
    one = rows.groupBy("id").agg(F.min("text_key").alias("text_key"))

    def sets_of(ids: DataFrame) -> DataFrame:
        keys = one.join(ids, "id", "left_semi").select("text_key")
        keys = F.broadcast(keys) if fits(keys, 1_000_000) else keys
        texts = docs.join(keys, F.xxhash64(docs["text"]) == keys["text_key"], "left_semi")
        return cut_lineage(_sets(texts, shingle).dropDuplicates(["id"]))

    # One text in 16, chosen before it is cut: all that the order of common items needs.
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0)
    prefixes = _prefixes(docs, shingle, common_items(_sets(some, shingle), share=1), threshold)
    links = alike_links(prefixes, sets_of, threshold).select("src", "dst")
    if budget is not None:
        links = links.union(_print_links(rows, budget))
    links = components(links, "src", "dst")
    named = rows.join(links, F.col("id") == F.col("node"), "left")
    return named.select("row", "doc_id", F.coalesce("component", "id").alias("component"))


def one_of_each(
    docs: DataFrame, shingle: int = 5, threshold: float = 0.8, budget: int | None = None
) -> DataFrame:
    """The row of the smallest (doc_id, text digest) of each component, with all its columns; rows
    without an id come last."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = near_classes(docs, shingle, threshold, budget).groupBy("component").agg(first.alias("first"))
    kept = kept.select(F.col("first.row").alias("_row"))
    found = docs.withColumn("_row", _row()).join(kept, "_row", "left_semi")
    return found.dropDuplicates(["_row"]).drop("_row")
