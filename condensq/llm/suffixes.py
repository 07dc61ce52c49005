"""Repeated passages by sparse suffix arrays.

1. Words get digests. A suffix is retained where the digest of the `gram` words it starts with is
   the least of a window: positions chosen by content, the same in every copy of a passage. The
   window is such that each passage of `length` words holds a retained suffix near its start, with
   `core` words after it inside the passage.
2. Retained suffixes are sorted by their digest of `core` words, and each is compared with its
   neighbours: only those equal to one go on. Equal suffixes of any number cost a comparison each.
3. Those are a row each: the digests of the words after the core, in order, those of the words before
   it, nearest first, and the places of both in the text. Sorted again, by core and the words after
   it, neighbours share the longest beginnings. A stretch of the order is extended at once: a passage
   is `l` words to the left and the rest to the right, and it counts if a second suffix of the same
   core agrees in both. What a suffix covers is one interval, as all its passages overlap.
   Cores at the edges of a stretch may go on in the next one: their passages become one row a
   stretch and are added up, and suffixes with the same passages become one row that asks for them.
   Intervals that overlap or touch join into maximal spans.

So a word is in a span exactly if a run of `length` words around it occurs at two or more places.

Edge cases: null, empty and short texts have no passages, an empty table has no spans; very long texts
are cut whole; repeated rows repeat their passages, and rows equal in id and text each get all spans;
of equal passages `first_doc` is the smallest id, null only if no holder has one; columns other than
doc_id and text are not read; words are runs of anything but the six ASCII white-space characters.
Passages are equal if the 64-bit digest of the core and 48 bits of every other word are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from condensq.llm.common import rows_of, slices, stored

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A digest of 64-bit numbers (finaliser of a public generator: shifts and odd factors)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_digests(text: str | None) -> np.ndarray:
    words = (text or "").encode().split()
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 code point of each word."""
    data = np.frombuffer(text.encode(), np.uint8)
    inside = np.concatenate([[False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]).astype(np.int32)
    return points[edges[::2]], points[edges[1::2]]


def run_digests(words: np.ndarray, n: int) -> np.ndarray:
    """Digest of each run of `n` words: a polynomial of their digests, by doubling."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out, have = np.zeros(len(words) - n + 1, np.uint64), 0
    power, block, size = _ODD, words.copy(), 1  # block[i]: digest of `size` words from i
    while True:
        if n & size:
            shift = np.uint64(pow(int(_ODD), size, 1 << 64))
            out = out * shift + block[have : have + len(out)]
            have += size
        if 2 * size > n:
            return _mix(out)
        block = block[:-size] * power + block[size:]
        power = np.uint64(pow(int(_ODD), 2 * size, 1 << 64))
        size *= 2


def retained(words: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Positions whose gram has the least digest of some window of consecutive grams (leftmost)."""
    grams = run_digests(words, gram)
    if not len(grams):
        return np.zeros(0, np.int64)
    if len(grams) <= window:
        return np.array([int(np.argmin(grams))])
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    chosen = [np.argmin(views[a : a + 4096], axis=1) + np.arange(a, min(a + 4096, len(views))) for a in range(0, len(views), 4096)]
    return np.unique(np.concatenate(chosen))


#: Bytes kept of the digest of a word beside a core.
_WIDTH = 6


def _packed(words: np.ndarray) -> np.ndarray:
    """Rows of word digests as rows of bytes whose order is that of the numbers, word by word."""
    return words.astype(">u8").view(np.uint8).reshape(*words.shape, 8)[..., 8 - _WIDTH :].reshape(len(words), -1)


def _unpacked(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data), data.shape[1] // _WIDTH, 8), np.uint8)
    out[..., 8 - _WIDTH :] = data.reshape(len(data), -1, _WIDTH)
    return out.view(">u8")[..., 0].astype(np.uint64)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows, np.uint8))]
    return pa.Array.from_buffers(pa.binary(), len(rows), buffers)


def _rows_of_bytes(column: pa.Array) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data.reshape(len(column), -1)


def _stretches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `rows`."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def passage_keys(core: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Column l: a digest of the core, `l` words before it and all but `l` of the words after it."""
    ext = right.shape[1]
    after, before = [core], [np.zeros_like(core)]
    for m in range(ext):
        after.append(_mix(after[-1] * _ODD + right[:, m]))
        before.append(_mix(before[-1] * _ODD + left[:, m]))
    return np.stack(
        [_mix(after[ext - n] + _mix(before[n] + np.uint64(n + 1))) for n in range(ext + 1)], axis=1
    )


def repeated_spans(
    docs: DataFrame, length: int = 50, gram: int = 5, window: int = 21, stretch: int = 20_000
) -> DataFrame:
    """(doc_id, start, stop, start_char, stop_char, first_doc): maximal spans of words in passages of
    `length` words that occur elsewhere too; first_doc is the smallest id with one of its passages.

    `start` and `stop` count words, `start_char` and `stop_char` code points of the text. `stretch` is
    the number of sorted suffixes a task extends at once; results do not depend on it.
    """
    if window + gram > length:
        raise ValueError("a passage has to hold a whole window of grams")
    core = length - window + 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keys, rows, at = [], [], []
            for row, text in zip(*(batch.column(c).to_pylist() for c in ("row", "text"))):
                words = word_digests(text)
                if len(words) < length:
                    continue
                cores = run_digests(words, core)
                found = retained(words, gram, window)
                found = found[found < len(cores)]
                keys.append(cores[found].view(np.int64))
                at.append(found.astype(np.int32))
                rows.append(np.full(len(found), row, np.int64))
            if keys:
                yield pa.record_batch(
                    [pa.array(np.concatenate(x)) for x in (keys, rows, at)], ["key", "row", "at"]
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Suffixes equal to a neighbour (`edge` false); the first and last of the part (`edge` true)."""
        last: tuple | None = None  # of the suffix before, and whether it is equal to the one before it
        equal, opened = False, False
        out: list[tuple] = []
        for row in chain(rows_of(batches, "key", "row", "at"), [(None, None, None)]):
            if last is not None:
                same = row[0] == last[0]
                if equal or same:
                    out.append((*last, False))
                if row[0] is None or not opened:
                    out.append((*last, True))
                    opened = True
                equal = same
            last = row
            if len(out) > 50_000 or row[0] is None:
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_())
                    yield pa.record_batch(
                        [pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["key", "row", "at", "edge"]
                    )
                out = []

    sparse = named.select("row", "text").mapInArrow(suffixes, "key long, row long, at int")
    # Place breaks ties of the key, so a suffix of any frequency spreads over parts.
    ordered = sparse.repartitionByRange("key", "row", "at").sortWithinPartitions("key", "row", "at")
    compared = stored(ordered.mapInArrow(compare, "key long, row long, at int, edge boolean"), "suffixes")
    # Two edges a part: equal ones stand on both sides of a border between parts.
    edges = compared.filter("edge").select("key", "row", "at")
    across = edges.join(
        edges.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "key", "left_semi"
    )
    starts = compared.filter("not edge").select("row", "at").union(across.select("row", "at"))
    starts = starts.groupBy("row").agg(F.collect_set("at").alias("at"))  # of one document

    ext = window - 1
    steps = np.arange(ext)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            parts = []
            for i, (row, text, found) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "text", "at")))):
                words, at = word_digests(text), np.array(found, np.int64)
                first, last = word_places(text)
                padded = np.concatenate([np.zeros(ext, np.uint64), words, np.zeros(ext, np.uint64)])
                right = padded[ext + at[:, None] + core + steps]
                left = padded[ext + at[:, None] - 1 - steps]
                head = run_digests(words, core)[at]
                begins = first[np.maximum(at[:, None] - np.arange(ext + 1), 0)].astype("<i4")
                ends = last[np.minimum(at[:, None] + length - 1 - np.arange(ext + 1), len(words) - 1)].astype("<i4")
                suffix = np.concatenate([head.astype(">u8").view(np.uint8).reshape(-1, 8), _packed(right)], axis=1)
                # Places as differences from the place of the core's first word: small numbers.
                places = np.stack([begins, ends], axis=1).reshape(len(at), -1) - first[at][:, None]
                places = places.astype("<i4").view(np.uint8).reshape(len(at), -1)
                n_left, n_right = np.minimum(at, ext), np.minimum(len(words) - at - core, ext)
                parts.append((np.full(len(at), i), np.full(len(at), row), at, first[at], n_left, n_right, suffix, _packed(left), places))
            if parts:
                i, rows, *numbers, suffix, left, places = (np.concatenate(x) for x in zip(*parts))
                yield pa.record_batch(
                    [batch.column("doc_id").take(pa.array(i)), pa.array(rows.astype(np.int64)),
                     *(pa.array(x.astype(np.int32)) for x in numbers), *map(_binary, (suffix, left, places))],
                    ["doc_id", "row", "at", "char", "n_left", "n_right", "suffix", "left", "places"],
                )

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a suffix covers (`member`), and of cores that may go on beyond a stretch how often their
        passages occur (`key`), and which suffixes have the same passages (`members` and `passages`)."""
        for batch in _stretches(batches, stretch):
            suffix, left = (_rows_of_bytes(batch.column(c)) for c in ("suffix", "left"))
            heads = suffix[:, :8].copy().view(">u8")[:, 0].astype(np.uint64)
            keys = passage_keys(heads, _unpacked(suffix[:, 8:]), _unpacked(left))
            n_left, n_right, at, char = (batch.column(c).to_numpy() for c in ("n_left", "n_right", "at", "char"))
            places = _rows_of_bytes(batch.column("places")).copy().view("<i4").reshape(len(at), 2, ext + 1)
            shifts = np.arange(ext + 1)
            # (suffix, words to the left) of each passage inside its text
            own, n = np.nonzero((shifts <= n_left[:, None]) & (ext - shifts <= n_right[:, None]))
            if not len(own):
                continue
            docs_of = batch.column("doc_id")
            order = pc.sort_indices(docs_of).to_numpy()  # nulls last
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            key = keys[own, n]
            by_key = np.argsort(key, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], key[by_key][1:] != key[by_key][:-1]]))
            counts = np.diff(np.append(edges, len(key)))
            least = np.minimum.reduceat(rank[own[by_key]], edges)
            start = at[own] - n
            begins, ends = places[own, 0, n] + char[own], places[own, 1, n] + char[own]
            open_core = (heads == heads[0]) | (heads == heads[-1])
            group = np.repeat(np.arange(len(edges)), counts)
            twice = by_key[(counts[group] > 1) & ~open_core[own[by_key]]]
            rank_of = np.empty(len(key), np.int64)
            rank_of[by_key] = least[group]
            if len(twice):  # in order of suffixes, with more words to the left as the last
                twice = np.sort(twice)
                one = np.flatnonzero(np.concatenate([[True], own[twice][1:] != own[twice][:-1]]))
                last = np.append(one[1:], len(twice)) - 1
                low, high, who = twice[last], twice[one], own[twice[one]]
                firsts = order[np.minimum.reduceat(rank_of[twice], one)]
                struct = _member(batch, who, (at[who], start[low], start[high] + length, begins[low], ends[high]))
                yield _ended(docs_of, struct, firsts)
            chosen = np.flatnonzero(open_core[own[by_key[edges]]])
            if len(chosen):
                yield _counted(
                    docs_of, heads[own[by_key[edges[chosen]]]], key[by_key[edges[chosen]]], counts[chosen], order[least[chosen]]
                )
                inside = np.zeros(keys.shape, bool)
                inside[own, n] = True
                who = np.flatnonzero(open_core & inside.any(axis=1))
                yield _going_on(batch, who, keys[who], inside[who], places[who] + char[who][:, None, None], heads[who])

    # Texts meet the places of their suffixes once; later steps have places in the text with them.
    texts = named.join(starts, "row").select("doc_id", "row", "text", "at")
    sorted_by = ["suffix", "row", "at"]
    suffix_rows = texts.mapInArrow(
        contexts,
        f"doc_id {kind}, row long, at int, char int, n_left int, n_right int, suffix binary, left binary, places binary",
    ).repartitionByRange(*sorted_by).sortWithinPartitions(*sorted_by)
    place = ["doc_id", "start", "stop", "start_char", "stop_char"]
    member = f"struct<doc_id: {kind}, row: long, at: int, start: int, stop: int, start_char: int, stop_char: int>"
    one = f"struct<doc_id: {kind}, row: long, at: int, begins: array<int>, ends: array<int>>"
    extended = stored(
        suffix_rows.mapInArrow(
            extend,
            f"core long, key long, n long, first_doc {kind}, member {member}, "
            f"passages array<struct<key: long, shift: int>>, members array<{one}>",
        ),
        "extended",
    )
    ended = extended.filter("member is not null").select("member.*", "first_doc")
    total = extended.filter("key is not null").groupBy(F.col("core").alias("_core"), F.col("key").alias("_key")).agg(
        F.sum("n").alias("_n"), F.min("first_doc").alias("_first")
    ).filter("_n > 1")
    # Suffixes with the same passages meet the counts once, by their first one; all its passages overlap.
    alike = extended.filter("members is not null").select(
        "core", F.col("members")[0]["row"].alias("_row"), F.col("members")[0]["at"].alias("_at"), "passages", "members"
    )
    each = alike.select("core", "_row", "_at", F.explode("passages").alias("p"))
    same = (F.col("core") == F.col("_core")) & (F.col("p.key") == F.col("_key"))
    met = each.join(total, same).groupBy("_row", "_at").agg(
        F.min("p.shift").alias("_low"), F.max("p.shift").alias("_high"), F.min("_first").alias("first_doc")
    )
    across = alike.select("_row", "_at", "members").join(met, ["_row", "_at"]).select(
        F.explode("members").alias("m"), "_low", "_high", "first_doc"
    ).select(
        "m.doc_id", "m.row", "m.at", (F.col("m.at") - F.col("_high")).alias("start"),
        (F.col("m.at") - F.col("_low") + length).alias("stop"), F.get("m.begins", "_high").alias("start_char"),
        F.get("m.ends", "_low").alias("stop_char"), "first_doc",
    )
    found = ended.unionByName(across)
    # Equal rows are there as often as they occur. All that follows is of one document.
    covered = found.repartition("row").groupBy("row", "at", *place).agg(
        F.count(F.lit(1)).alias("times"), F.min("first_doc").alias("first_doc")
    )
    before = Window.partitionBy("row").orderBy("start", "stop", "at").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("start", "stop", "at").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.coalesce(F.col("start") > F.max("stop").over(before), F.lit(True))
    spans = covered.withColumn("_new", begins.cast("int")).withColumn("_span", F.sum("_new").over(upto))
    spans = spans.groupBy("row", "_span").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("stop").alias("stop"),
        F.min("start_char").alias("start_char"), F.max("stop_char").alias("stop_char"),
        F.min("first_doc").alias("first_doc"), F.max("times").alias("times"),
    )
    repeated = spans.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return repeated.select("doc_id", *(F.col(c).cast("long").alias(c) for c in place[1:]), "first_doc")


def _member(batch: pa.RecordBatch, who: np.ndarray, numbers: tuple[np.ndarray, ...]) -> pa.StructArray:
    at = pa.array(who)
    columns = [batch.column("doc_id").take(at), batch.column("row").take(at)]
    columns += [pa.array(x.astype(np.int32)) for x in numbers]
    return pa.StructArray.from_arrays(columns, ["doc_id", "row", "at", "start", "stop", "start_char", "stop_char"])


_COLUMNS = ["core", "key", "n", "first_doc", "member", "passages", "members"]


def _row_batch(rows: int, doc_id: pa.DataType, **columns: pa.Array) -> pa.RecordBatch:
    """The given columns of an extended stretch, others null."""
    ints = [("doc_id", doc_id), ("row", pa.int64()), ("at", pa.int32())]
    member = pa.struct([*ints, *((c, pa.int32()) for c in ("start", "stop", "start_char", "stop_char"))])
    one = pa.struct([*ints, ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
    passage = pa.struct([("key", pa.int64()), ("shift", pa.int32())])
    kinds = [pa.int64(), pa.int64(), pa.int64(), doc_id, member, pa.list_(passage), pa.list_(one)]
    return pa.record_batch(
        [columns[c].cast(t) if c in columns else pa.nulls(rows, t) for c, t in zip(_COLUMNS, kinds)], _COLUMNS
    )


def _ended(docs_of: pa.Array, members: pa.StructArray, first: np.ndarray) -> pa.RecordBatch:
    return _row_batch(len(members), docs_of.type, member=members, first_doc=docs_of.take(pa.array(first)))


def _counted(
    docs_of: pa.Array, core: np.ndarray, key: np.ndarray, n: np.ndarray, first: np.ndarray
) -> pa.RecordBatch:
    return _row_batch(
        len(key), docs_of.type, core=pa.array(core.view(np.int64)), key=pa.array(key.view(np.int64)),
        n=pa.array(n.astype(np.int64)), first_doc=docs_of.take(pa.array(first)),
    )


def _going_on(
    batch: pa.RecordBatch, who: np.ndarray, keys: np.ndarray, inside: np.ndarray, places: np.ndarray, core: np.ndarray
) -> pa.RecordBatch:
    """A row for all suffixes that have the same passages: these, and the suffixes with their places."""
    table = np.ascontiguousarray(np.concatenate([np.where(inside, keys, 0), inside], axis=1, dtype=np.uint64))
    whole = table.view(np.dtype((np.void, table.shape[1] * 8)))[:, 0]
    _, one, group = np.unique(whole, return_index=True, return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(one)))]).astype(np.int32)
    of, shift = np.nonzero(inside[one])
    passages = pa.StructArray.from_arrays(
        [pa.array(keys[one][of, shift].view(np.int64)), pa.array(shift.astype(np.int32))], ["key", "shift"]
    )
    bounds = np.concatenate([[0], np.cumsum(inside[one].sum(axis=1))]).astype(np.int32)
    at, shifts = pa.array(who[by_group]), places.shape[2]
    lists = [
        pa.ListArray.from_arrays(
            pa.array(np.arange(len(who) + 1, dtype=np.int32) * np.int32(shifts)),
            pa.array(np.ascontiguousarray(places[by_group, side]).reshape(-1).astype(np.int32)),
        )
        for side in (0, 1)
    ]
    members = pa.StructArray.from_arrays(
        [*(batch.column(c).take(at) for c in ("doc_id", "row", "at")), *lists],
        ["doc_id", "row", "at", "begins", "ends"],
    )
    return _row_batch(
        len(one), batch.column("doc_id").type, core=pa.array(core[one].view(np.int64)),
        passages=pa.ListArray.from_arrays(pa.array(bounds), passages),
        members=pa.ListArray.from_arrays(pa.array(ends), members),
    )
