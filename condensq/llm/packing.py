"""Best-fit packing of token pieces into sequences by exact complements.

The plan is made on the histogram of piece lengths, at most `capacity` numbers however many
documents there are. Pieces then get a rank inside their length and look up their place.

Edge cases: null or empty text is a document of the separator alone; repeated rows and repeated ids
are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condensq.llm.common import buckets_for, slices, with_rank
from condensq.llm.encoding import VOCABULARY, encoder, forget
from condensq.session import cut_lineage

CAPACITY = 2048


def pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    separator: int = 0,
    vocabulary: str = VOCABULARY,
    with_ids: bool = False,
    keep_cache: bool = True,
) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32[, ids]) of every document.

    A document is its ids and the separator. A longer one than `capacity` is cut into full pieces;
    what is over comes first. `row` tells documents of equal id apart. With `keep_cache` a Python
    worker keeps its encoder for the next task, which takes memory from stages of other kinds.
    """
    ids_too = [("ids", pa.list_(pa.int32()))] if with_ids else []
    names = ["doc_id", "row", "piece", "start", "length", "ids_crc32", *(n for n, _ in ids_too)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary) if keep_cache else encoder(vocabulary, 200_000)
        end = np.array([separator], "<u4").tobytes()
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in names]
            for doc, row, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = enc.encode(text) + end
                n = len(data) // 4
                first = n % capacity or capacity
                for k, stop in enumerate(range(first, n + 1, capacity)):
                    start = max(0, stop - capacity)
                    part = data[4 * start : 4 * stop]
                    values = [doc, row, k, start, stop - start, zlib.crc32(part)]
                    if with_ids:
                        values.append(np.frombuffer(part, "<i4"))
                    for column, value in zip(out, values):
                        column.append(value)
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch(
                [pa.array(v, t) for v, t in zip(out, [*kinds, *(t for _, t in ids_too)])], names
            )

        if not keep_cache:
            forget()

    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, piece int, start long, "
        "length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    )
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return numbered.mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset): `count` pieces of that length, from
    that rank on, go to as many consecutive sequences, each at that offset.

    From the longest length down, the gap it leaves is looked up among single lengths, then among
    pairs and triples of lengths whose sum is the gap exactly; a combination is consumed as often as
    all of it is available. Where no sum fits, the gap takes the longest piece that fits, and what
    is then left is looked up again. Each step uses up a length or a gap, so there are a few runs
    for each length.
    """
    left = dict(sorted((n, c) for n, c in histogram.items() if c > 0))
    used = dict.fromkeys(left, 0)
    lengths = list(left)  # rising; a length leaves when its pieces are used up
    runs: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def available(items: list[int]) -> int:
        return min(left.get(x, 0) // items.count(x) for x in set(items))

    def exact(gap: int, taken: list[int]) -> list[int] | None:
        """Lengths summing to the gap that can be taken beside `taken`."""
        if available([*taken, gap]):
            return [gap]
        has = lambda *more: available([*taken, *more]) > 0
        top = bisect_right(lengths, gap)
        for x in reversed(lengths[:top]):
            if 2 * x < gap:
                break
            if gap - x in left and has(x, gap - x):
                return [x, gap - x]
        for x in reversed(lengths[:top]):
            if 3 * x < gap:
                break
            rest = gap - x
            for y in reversed(lengths[: bisect_right(lengths, min(x, rest - 1))]):
                if 2 * y < rest:
                    break
                if rest - y in left and has(x, y, rest - y):
                    return [x, y, rest - y]
        return None

    while lengths:
        items = [lengths[-1]]
        gap = capacity - items[0]
        while gap > 0:
            found = exact(gap, items)
            if found:
                items += found
                break
            fit = next(
                (x for x in reversed(lengths[: bisect_right(lengths, gap)]) if available([*items, x])), None
            )
            if fit is None:
                break
            items.append(fit)
            gap -= fit
        times, offset = available(items), 0
        for x in items:
            runs.append((x, used[x], times, sequence, offset))
            used[x] += times
            left[x] -= times
            offset += x
        sequence += times
        for x in set(items):
            if not left[x]:
                del left[x]
                lengths.remove(x)
    return runs


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with `sequence_id` and `offset`; all other columns stay as they are."""
    counts = found.groupBy("length").agg(F.count("*").alias("n")).collect()  # `capacity` rows at most
    places: dict[int, list[list[int]]] = {}
    for length, first, count, sequence, offset in plan({r["length"]: r["n"] for r in counts}, capacity):
        columns = places.setdefault(length, [[], [], []])
        for column, value in zip(columns, (first, sequence - first, offset)):
            column.append(value)
    total = sum(r["n"] for r in counts)
    ranked = with_rank(found, ["length"], ["doc_id", "row", "piece"], buckets_for(total))
    known = {n: tuple(np.array(c, np.int64) for c in columns) for n, columns in places.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, shift, at = known[int(length[rows[0]])]
                k = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows], offset[rows] = rank[rows] + shift[k], at[k]
            columns = [c for c in batch.schema.names if c != "rank"]
            yield pa.record_batch(
                [*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)],
                [*columns, "sequence_id", "offset"],
            )

    schema = T.StructType(
        [*found.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    return ranked.mapInArrow(place, schema)


def pack(
    docs: DataFrame, capacity: int = CAPACITY, separator: int = 0, vocabulary: str = VOCABULARY,
    keep_cache: bool = True,
) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    found = cut_lineage(pieces(docs, capacity, separator, vocabulary, keep_cache=keep_cache))
    return packed(found, capacity)


def sequences(packed_ids: DataFrame) -> DataFrame:
    """(sequence_id, ids) of placed pieces with their ids: a sequence holds `capacity` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed_ids.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten(F.col("parts.ids")).alias("ids")
    )
