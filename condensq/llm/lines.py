"""Line dedup by alignment: repeated line blocks go from the later document.

1. From each line with a word, the shortest run of lines that reaches `min_block_words` words is a row
   with its digest; so is the shortest such run that ends at the line. So each block of whole lines
   of that many words is covered by runs inside it, whatever its lines are like.
   The run's first holder is the document of smallest doc_id; each other holder is linked to it.
   So a run of any frequency costs one row a place, never pairs among holders, and a document is
   aligned with the few documents that were first with its runs.
2. For each (first, later) pair the shared runs, each at its first place in both, are put in the later
   one's order, and the longest rising sequence of their places in the first is kept: patience diff.
3. Kept runs are deleted from the later document, wherever they stand in it, with the lines without
   words between and around them. Of blocks that two documents hold in crossed order, one alignment
   keeps one; an exact copy goes whole.

Edge cases: null text stays null and has no lines; lines are cut at line feeds only; a document
whose text equals an earlier one's loses all its lines, so its text becomes empty, unless it has
fewer words than `min_block_words`; rows of equal id and text are one document and are treated
alike; a run repeated in its first holder alone stays; columns of other names travel untouched; an
empty table gives an empty result; a very long text is cut whole, in time linear in its size; rows without an id come last in the order of documents and lose their blocks like others.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from condensq.llm.common import rows_of, slices, stored

_SIGN, _ALL = 1 << 63, (1 << 64) - 1

#: Columns of a run: 128 bits of digest, its first line and the one after its last, the lines without
#: words before it (if no line with words is), after it, and if no line with words follows.
_RUN = ("h", "h2", "line", "stop", "lead", "tail", "ends")


def _digest(data: bytes) -> tuple[int, int]:
    d = xxh3_128_intdigest(data)
    return ((d & _ALL) ^ _SIGN) - _SIGN, ((d >> 64) ^ _SIGN) - _SIGN


def line_runs(text: str, min_words: int, min_block_words: int) -> list[tuple]:
    """The runs of a text as tuples of `_RUN`. Line -1 stands for the whole text, if it is no shorter."""
    data = text.encode()
    lines = data.split(b"\n")
    words = [len(x.split()) for x in lines]
    at = [i for i, n in enumerate(words) if n]
    if sum(words) < min_block_words:
        return []
    begins = [0, *accumulate(len(x) + 1 for x in lines)]
    runs, low, total = set(), 0, 0
    for high, i in enumerate(at):  # two ends: [low, high] is the shortest run that ends at line i
        total += words[i]
        while total - words[at[low]] >= min_block_words:
            total -= words[at[low]]
            low += 1
        if total >= min_block_words:
            runs.add((low, high))
    total, high = 0, -1
    for low in range(len(at)):
        while total < min_block_words and high + 1 < len(at):
            high += 1
            total += words[at[high]]
        if total < min_block_words:
            break
        runs.add((low, high))
        total -= words[at[low]]
    edges = [*at, len(lines)]
    out = [(*_digest(data + b"\n"), -1, len(lines), 0, 0, True)]
    for low, high in sorted(runs):
        i, j = at[low], at[high] + 1
        if min_words <= 1 or max(words[i:j]) >= min_words:
            lead = 0 if low else i
            out.append((*_digest(data[begins[i] : begins[j] - 1]), i, j, lead, edges[high + 1] - j, high + 1 == len(at)))
    return out


def rising(values: list) -> list[int]:
    """Positions of a longest strictly rising subsequence."""
    tails: list = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


#: Columns of a shared run as `_aligned` takes them.
_SHARED = ("h", "h2", "line", "stop", "lead", "tail", "ends", "f_line")


def _aligned(shared: list[tuple]) -> list[tuple]:
    """The shared runs of one pair of documents that their alignment keeps, in the order given: by
    line and last line of the later document."""
    firsts: dict = {}
    for run in shared:
        firsts.setdefault(run[:2], run)
    order = list(firsts.values())
    kept = {order[i][:2] for i in rising([(r[7], r[3] - r[2]) for r in order])}
    return [run for run in shared if run[:2] in kept]


def _ranges(runs: list[tuple]) -> Iterator[tuple[int, int]]:
    """Deleted (from, to) line ranges, both included, of one document, from its kept runs."""
    start = stop = reach = None
    for _, _, line, end, lead, tail, ends, _ in sorted(runs, key=lambda r: r[2:4]):
        if start is None or line > reach:
            if start is not None:
                yield start, stop - 1
            start, stop, reach = line - lead, end, end
        stop = max(stop, end + tail if ends else end)
        reach = max(reach, end + tail)
    if start is not None:
        yield start, stop - 1


def deleted_lines(docs: DataFrame, min_words: int = 1, min_block_words: int = 8) -> DataFrame:
    """(row, from, to): line ranges to delete, for `docs` with a column `row` that names a row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    types = {"h": pa.int64(), "h2": pa.int64(), "ends": pa.bool_()}

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            out: list[list] = [[] for _ in ("row", *_RUN)]
            at = []
            for i, (row, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "text")))):
                for values in line_runs(text, min_words, min_block_words) if text is not None else ():
                    at.append(i)
                    for column, value in zip(out, (row, *values)):
                        column.append(value)
            kinds = [pa.int64(), *(types.get(c, pa.int32()) for c in _RUN)]
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(v, t) for v, t in zip(out, kinds))],
                ["doc_id", "row", *_RUN],
            )

    fields = ", ".join(f"{c} {'long' if c in ('h', 'h2') else 'boolean' if c == 'ends' else 'int'}" for c in _RUN)
    found = stored(
        docs.select("row", "doc_id", "text").mapInArrow(lines, f"doc_id {kind}, row long, {fields}"), "lines"
    )
    # Documents in order: by id, those without one last, equal ids by row.
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row", "line")
    firsts = (
        found.groupBy(F.col("h").alias("fh"), F.col("h2").alias("fh2"))
        .agg(F.min(order).alias("f"), F.count("*").alias("c"))
        .filter("c > 1")
        .select("fh", "fh2", F.col("f.row").alias("first"), F.col("f.line").alias("f_line"))
    )
    same = (F.col("h") == F.col("fh")) & (F.col("h2") == F.col("fh2"))
    shared = found.join(firsts, same).filter("row <> first")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, first, held, kept, out = None, None, [], [], []
        for pair in chain(rows_of(batches, "row", "first", *_SHARED), [(None, None)]):
            if pair[:2] != (row, first):
                kept += _aligned(held) if held and held[0][2] >= 0 else held[:1]
                held = []
            if pair[0] != row:
                # A whole copy has a run at line -1, and that one is enough.
                whole = any(r[2] < 0 for r in kept)
                out += [(row, 0, -1)] if whole else [(row, *r) for r in _ranges(kept)]
                kept = []
            row, first = pair[:2]
            held.append(pair[2:])
            if len(out) > 10_000 or row is None:
                columns = list(zip(*out)) or [(), (), ()]
                kinds = (pa.int64(), pa.int32(), pa.int32())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], ["row", "from", "to"])
                out = []

    # A later document's rows share a task, a first one's do not: no group exceeds its document.
    pairs = shared.select("row", "first", *_SHARED).repartition("row")
    pairs = pairs.sortWithinPartitions("row", "first", "line", "stop")
    return pairs.mapInArrow(align, "row long, from int, to int")


def dedup_lines(docs: DataFrame, min_words: int = 1, min_block_words: int = 8) -> DataFrame:
    """All columns of `docs`, `text` without its deleted blocks, and `n_lines`, `n_deleted`.

    A run of lines counts if one of them has `min_words` words. Lines that stay are joined by line feeds
    as before. Columns of these two names are replaced; all
    others travel in one struct, so no name clashes.
    """
    row = F.xxhash64("doc_id", "text").alias("row")
    ranges = deleted_lines(docs.select(row, "doc_id", "text"), min_words, min_block_words)
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    numbered = docs.select(others.alias("_others"), "text", row)
    cuts = ranges.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("from", "to")).alias("_cuts"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    joined = numbered.join(cuts, F.col("row") == F.col("_row"), "left").drop("_row")
    lines = F.split(F.col("text"), "\n", -1)
    at = joined.withColumn("_lines", lines).withColumn(
        "_keep",
        F.when(
            F.col("_cuts").isNotNull(),
            F.filter(
                F.sequence(F.lit(0), F.size("_lines") - 1),
                lambda i: ~F.exists("_cuts", lambda c: (i >= c["from"]) & ((i <= c["to"]) | (c["to"] < 0))),
            ),
        ),
    )
    kept = F.array_join(F.transform("_keep", lambda i: F.get(F.col("_lines"), i)), "\n")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines"))
    return at.select(
        *(
            F.when(F.col("_keep").isNull(), F.col("text")).otherwise(kept).alias(c)
            if c == "text" else F.col("_others").getField(c).alias(c)
            for c in columns
        ),
        n.alias("n_lines"),
        F.when(F.col("_keep").isNull(), 0).otherwise(n - F.size("_keep")).alias("n_deleted"),
    )
