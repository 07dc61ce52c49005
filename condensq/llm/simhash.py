"""SimHash fingerprints linked by a self-join of their binary trie.

Edge cases, all defined: null or wordless text has fingerprint zero and links like any other;
repeated rows keep a row each; null ids get the component of their fingerprint; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from condensq.llm.common import components, rows_of
from condensq.session import cut_lineage

BITS = 64


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is set in over half the XXH64 digests of the word shingles.

    A-Z become a-z, and words end at the six ASCII white-space characters, as `bytes.split` has it.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(BITS, np.int64)
    for start in range(0, n, 1 << 15):  # very long texts in blocks
        stop = min(n, start + (1 << 15))
        grams = map(b" ".join, zip(*(words[start + k : stop + k] for k in range(shingle)))) \
            if len(words) >= shingle else [b" ".join(words)]
        digests = np.fromiter((xxh64_intdigest(g, seed) for g in grams), np.uint64)
        bits = np.unpackbits(digests.view(np.uint8), bitorder="little").reshape(-1, BITS)
        counts += bits.sum(axis=0, dtype=np.int64)
    chosen = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(chosen, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number, a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint_of(t, shingle, seed) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _prefix(fp: Column, depth: int) -> Column:
    """The first `depth` bits, as a number; -1 for none."""
    return F.shiftrightunsigned(fp, BITS - depth) if depth else F.lit(-1).cast("long")


def _node_pairs(points: DataFrame, budget: int, leaf: int, step: int) -> list[tuple[int, DataFrame]]:
    """Pairs of trie nodes (depth, frame of a, b) within the budget, each of `leaf` points or fewer.

    The frontier goes down `step` bits at a time: the children of both nodes meet through an equi
    join on the parent, differing bits add up, and a pair over the budget ends there. Only pairs
    with a node of more than `leaf` points go on, so a crowded prefix is split further and others
    are not.
    """
    done = []
    frontier = points.limit(1).select(
        F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(0).alias("acc")
    )
    for depth in range(step, BITS + 1, step):
        nodes = points.groupBy(_prefix(F.col("fp"), depth).alias("node")).agg(F.count("*").alias("n"))
        nodes = nodes.withColumn(
            "parent", F.shiftrightunsigned("node", step) if depth > step else F.lit(-1).cast("long")
        )
        left = nodes.select(F.col("parent").alias("pa"), F.col("node").alias("ca"), F.col("n").alias("na"))
        right = nodes.select(F.col("parent").alias("pb"), F.col("node").alias("cb"), F.col("n").alias("nb"))
        new_bits = F.col("ca").bitwiseXOR(F.col("cb")).bitwiseAND(F.lit((1 << step) - 1))
        acc = F.col("acc") + F.bit_count(new_bits)
        pairs = (
            frontier.join(left, F.col("a") == F.col("pa"))
            .join(right, F.col("b") == F.col("pb"))
            .withColumn("acc", acc)
            .filter((F.col("acc") <= budget) & ((F.col("a") < F.col("b")) | (F.col("ca") <= F.col("cb"))))
            .select(
                F.col("ca").alias("a"), F.col("cb").alias("b"), "acc",
                (F.greatest("na", "nb") > leaf).alias("large"),
            )
        )
        pairs = cut_lineage(pairs)
        done.append((depth, pairs if depth == BITS else pairs.filter("not large")))
        frontier = pairs.filter("large").drop("large")
        if depth == BITS or frontier.isEmpty():
            break
    return done


def trie_pairs(
    a: np.ndarray, b: np.ndarray, roots: list[tuple[int, int, int, int]], depth: int, budget: int
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with a[i], b[j] within `budget` bits below the given node pairs.

    `a` and `b` are sorted; a node is a range of one of them and `roots` are pairs of ranges whose
    first `depth` bits are common to the range. All pairs of a level go down together: a node splits
    at its next bit, unlike children pay one bit, and a pair that cannot pay is pruned. A pair of
    single points is settled at once by its whole difference.
    """
    alo, ahi, blo, bhi = (np.array(x, np.int64) for x in zip(*roots))
    acc = np.bitwise_count((a[alo] ^ b[blo]) >> np.uint64(BITS - depth)).astype(np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(depth, BITS + 1):
        keep = acc <= budget
        alo, ahi, blo, bhi, acc = (x[keep] for x in (alo, ahi, blo, bhi, acc))
        single = (ahi - alo == 1) & (bhi - blo == 1)
        i, j = alo[single], blo[single]
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        found.append((i[near], j[near]))
        alo, ahi, blo, bhi, acc = (x[~single] for x in (alo, ahi, blo, bhi, acc))
        if not len(alo) or level == BITS:
            break
        bit = np.uint64(BITS - 1 - level)
        ones_a = np.concatenate([[0], np.cumsum((a >> bit) & np.uint64(1))]).astype(np.int64)
        ones_b = np.concatenate([[0], np.cumsum((b >> bit) & np.uint64(1))]).astype(np.int64)
        amid = ahi - (ones_a[ahi] - ones_a[alo])
        bmid = bhi - (ones_b[bhi] - ones_b[blo])
        parts = [
            (alo, amid, blo, bmid, acc), (amid, ahi, bmid, bhi, acc),
            (alo, amid, bmid, bhi, acc + 1), (amid, ahi, blo, bmid, acc + 1),
        ]
        alo, ahi, blo, bhi, acc = (np.concatenate(x) for x in zip(*parts))
        full = (ahi > alo) & (bhi > blo)
        alo, ahi, blo, bhi, acc = (x[full] for x in (alo, ahi, blo, bhi, acc))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _forest(i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[list, list]:
    """A spanning forest of the links x[i]-y[j]: no more rows than points."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out: tuple[list, list] = ([], [])
    for u, v in zip(x[i].tolist(), y[j].tolist()):
        ru, rv = root(u), root(v)
        if ru != rv:
            parent[ru] = rv
            out[0].append(u)
            out[1].append(v)
    return out


def links(points: DataFrame, budget: int = 2, leaf: int = 1024, step: int = 4) -> DataFrame:
    """Links (a, b) between the representatives `rep` of distinct fingerprints `fp`.

    Every pair within `budget` bits is found; each block of the trie passes on a spanning forest of
    its links, which joins the same points. A block holds at most `leaf` points on either side of a
    pair, and a point has few neighbours of distinct value, so no task grows with a group of copies.
    """

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        depth = int(pdf["depth"].iloc[0])
        own = pdf[pdf["side"] == 0].sort_values("ufp")
        other = pdf[pdf["side"] == 1].sort_values("ufp")
        x, y = own["rep"].to_numpy(), other["rep"].to_numpy()
        a, b = own["ufp"].to_numpy(), other["ufp"].to_numpy()
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        starts = np.flatnonzero(np.diff(b >> np.uint64(BITS - depth), prepend=~(b[:1] >> np.uint64(BITS - depth))))
        stops = [*starts[1:].tolist(), len(b)]
        roots = [(0, len(a), int(s), int(e)) for s, e in zip(starts, stops)]
        i, j = trie_pairs(a, b, roots, depth, budget)
        unlike = a[i] != b[j]
        u, v = _forest(i[unlike], j[unlike], x, y)
        return pd.DataFrame({"a": np.array(u, "int64"), "b": np.array(v, "int64")})

    def unsigned(pdf: pd.DataFrame) -> pd.DataFrame:
        return join(pdf.assign(ufp=pdf["fp"].to_numpy().view(np.uint64)))

    parts = []
    for depth, pairs in _node_pairs(points, budget, leaf, step):
        at = points.withColumn("node", _prefix(F.col("fp"), depth))
        one = pairs.select("a").distinct().join(at, F.col("a") == F.col("node"))
        two = pairs.select("a", "b").join(at, F.col("b") == F.col("node"))
        parts += [
            x.select(F.lit(depth).alias("depth"), F.col("a").alias("block"), F.lit(side).alias("side"), "fp", "rep")
            for side, x in enumerate((one, two))
        ]
    blocks = reduce(DataFrame.union, parts)
    return blocks.groupBy("depth", "block").applyInPandas(unsigned, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): a row for each row of `docs`; linked fingerprints share the
    smallest doc_id of their component. doc_id has to be a whole number."""
    prints = cut_lineage(fingerprints(docs, shingle, seed))
    points = prints.groupBy("fp").agg(F.min("doc_id").cast("long").alias("rep"))
    points = cut_lineage(points)
    # A fingerprint that only rows without an id have takes no part in links by id.
    found = components(links(points.filter("rep is not null"), budget))
    named = points.join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def one_of_each(docs: DataFrame, shingle: int = 3, budget: int = 2) -> DataFrame:
    """The row of the smallest doc_id of each component, with all its columns; rows without an id
    stay. Of repeated rows of that doc_id one stays."""
    kept = near_duplicates(docs, shingle, budget).filter("doc_id = component_id").select("doc_id").distinct()
    known = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return known.unionByName(docs.filter("doc_id is null"))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
