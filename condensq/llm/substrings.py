"""Substring dedup by level-wise doubling: words in windows of `length` words found twice or more go.

Lengths double up to the asked one (9, 18, 35). Of the first length, every window of `length` words
names one short window inside it, the one with the least digest, so copies name the same one. Short
windows found twice are extended to twice their length, to the right where that stays inside the
long window and to the left where it does not; windows of a level that are found once end there,
and with them the long windows built on them. It goes on until the asked length is reached or no
candidate is left.

A level is one shuffle of (digest, text, place), counted in a window by digest. Windows met more
than once in a batch are known to be repeated: one row carries their digest and the others a key of
their own, so a window that holds a third of all rows costs its shuffle key a row a batch. Texts are
shuffled once, by their digest; each level reads the same exchange.

Edge cases: null, empty and short texts lose nothing; repeated rows and equal texts of other rows
are other places, so all of their windows count as repeated, whatever the order of rows (there is no
first holder and no tie to break); windows may overlap each other; very long texts are handled
whole; an empty table gives an empty result; other columns of any name are not read. Levels before
the last use digests of 64 bits, where a false match makes a candidate too many; the last one uses
128 bits. Texts are told apart by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from condensq.llm.common import slices
from condensq.llm.suffixes import _mix, run_digests, word_digests

_SECOND = np.uint64(0xD6E8FEB86659FD93)


def level_lengths(length: int, least: int = 8) -> list[int]:
    """Window lengths from the shortest to `length`, each at most twice the one before."""
    out = [length]
    while (half := -(-out[0] // 2)) >= least:
        out.insert(0, half)
    return out


def named_windows(words: np.ndarray, lengths: list[int]) -> np.ndarray:
    """For each window of the last length, the start of the one of the first length with the least
    digest in it (leftmost)."""
    grams, wide = run_digests(words, lengths[0]), lengths[-1] - lengths[0] + 1
    if len(grams) < wide:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, wide)
    parts = [np.argmin(views[a : a + 4096], axis=1) for a in range(0, len(views), 4096)]
    return np.concatenate(parts) + np.arange(len(views))


def extended(inner: np.ndarray, outer: np.ndarray, have: int, want: int, length: int) -> np.ndarray:
    """Starts of the windows of `want` words around those of `have` words, inside the outer ones."""
    if want == length:
        return outer
    return np.where(inner + want <= outer + length, inner, inner + have - want)


def _without(chosen: np.ndarray, places: np.ndarray, n: int, keep: bool) -> np.ndarray:
    mask = np.zeros(n, bool)
    mask[places] = True
    return mask[chosen] == keep


def alive(
    words: np.ndarray, lengths: list[int], hits: np.ndarray, misses: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """(outer, inner): the windows of the last length that still count, and for each the window of
    the level reached. `hits`: repeated windows of the first level; `misses`: windows found once, a
    level each from the second on."""
    inner = named_windows(words, lengths)
    outer = np.arange(len(inner))
    ok = _without(inner, hits, len(words), True)
    inner, outer = inner[ok], outer[ok]
    for k, missed in enumerate(misses, 1):
        inner = extended(inner, outer, lengths[k - 1], lengths[k], lengths[-1])
        ok = _without(inner, missed, len(words), False)
        inner, outer = inner[ok], outer[ok]
    return outer, inner


def _lists(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    found = batch.column(column)
    values, ends = found.values.to_numpy(zero_copy_only=False), found.offsets.to_numpy()
    return (values[a:b] for a, b in zip(ends[:-1], ends[1:]))


_ROW = "key long, other long, row long, at int, state int"


def _key_rows(found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of one batch. State 0: the only one here; 1: one of several, with their digest; 2: the
    rest of the several, under keys of their own."""
    rows = np.repeat(np.array([r for r, *_ in found], np.int64), [len(at) for _, at, *_ in found])
    at, key, other = (np.concatenate(x) for x in list(zip(*found))[1:])
    _, first, inverse, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    state = np.where(counts[inverse] > 1, 2, 0).astype(np.int32)
    state[first[counts > 1]] = 1
    own = _mix(rows.view(np.uint64) + _mix(at.astype(np.uint64)))
    key = np.where(state == 2, own, key)
    columns = (key.view(np.int64), other.view(np.int64), rows, at.astype(np.int32), state)
    return pa.record_batch([pa.array(c) for c in columns], ["key", "other", "row", "at", "state"])


def _window_rows(
    batches: Iterator[pa.RecordBatch], lengths: list[int], level: int
) -> Iterator[pa.RecordBatch]:
    """The windows of a level, as key rows; the third and later copies of a text add none."""
    seen: dict[int, int] = {}
    for batch in slices(batches, "text"):
        lists = [_lists(batch, c) for c in ["hits", *(f"miss{k}" for k in range(1, level))][:level]]
        found = []
        for row, text, *own in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), *lists):
            seen[row] = seen.get(row, 0) + 1
            if seen[row] > 2:
                continue
            words = word_digests(text)
            if len(words) < lengths[-1]:
                continue
            if level:
                outer, inner = alive(words, lengths, own[0], own[1:])
                at = extended(inner, outer, lengths[level - 1], lengths[level], lengths[-1])
            else:
                at = named_windows(words, lengths)
            at = np.unique(at)
            key = run_digests(words, lengths[level])[at]
            last = lengths[level] == lengths[-1]
            other = run_digests(_mix(words + _SECOND), lengths[level])[at] if last else np.zeros_like(key)
            found.append((row, at, key, other))
        if any(len(at) for _, at, *_ in found):
            yield _key_rows(found)


def _counted(rows: DataFrame) -> DataFrame:
    same = Window.partitionBy("key", "other")
    repeated = (F.count(F.lit(1)).over(same) > 1) | (F.max("state").over(same) > 0)
    return rows.select("row", "at", repeated.alias("repeated"))


def without_repeats(docs: DataFrame, length: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, text): every document without the words covered by a
    window of `length` words that starts anywhere else too; `removed` are spans [start, stop) of word
    numbers, `text` the kept words joined by one space. Windows are judged on the input alone."""
    lengths = level_lengths(length)
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit("")).alias("text")
    texts = docs.select("doc_id", text).withColumn("row", F.xxhash64("text"))

    def rows(found: DataFrame, level: int) -> DataFrame:
        made = found.mapInArrow(lambda batches: _window_rows(batches, lengths, level), _ROW)
        return _counted(made)

    def places(found: DataFrame, name: str) -> DataFrame:
        return found.groupBy("row").agg(F.collect_set("at").alias(name)).hint("shuffle_hash")

    candidates = None
    joined = texts
    for level in range(len(lengths)):
        found = rows(texts.select("text", "row") if candidates is None else candidates, level)
        if level == 0:
            places_0 = places(found.filter("repeated"), "hits")
            candidates = texts.join(places_0, "row")
            joined = joined.join(places_0, "row", "left")
        else:
            missed = places(found.filter("not repeated"), f"miss{level}")
            candidates = candidates.join(missed, "row", "left")
            joined = joined.join(missed, "row", "left")

    names = ["hits", *(f"miss{k}" for k in range(1, len(lengths)))]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n_words, n_removed, spans, texts_left = [], [], [], []
            lists = zip(*(_lists(batch, c) for c in names))
            for text, own in zip(batch.column("text").to_pylist(), lists):
                words = text.encode().split()
                outer = np.zeros(0, np.int64)
                if len(own[0]) and len(words) >= length:
                    outer, _ = alive(word_digests(text), lengths, own[0], list(own[1:]))
                cut = np.flatnonzero(np.diff(outer) > length) if len(outer) else outer
                first = outer[np.concatenate([[0], cut + 1])] if len(outer) else outer
                stop = outer[np.concatenate([cut, [len(outer) - 1]])] + length if len(outer) else outer
                left, upto = [], 0
                for a, b in zip(first.tolist(), stop.tolist()):
                    left += words[upto:a]
                    upto = b
                left += words[upto:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                spans.append([{"start": a, "stop": b} for a, b in zip(first.tolist(), stop.tolist())])
                texts_left.append(b" ".join(left).decode())
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(spans, span), pa.array(texts_left, pa.string())],
                ["doc_id", "n_words", "n_removed", "removed", "text"],
            )

    return joined.select("doc_id", "text", *names).mapInArrow(
        kept,
        f"doc_id {kind}, n_words long, n_removed long, "
        "removed array<struct<start: long, stop: long>>, text string",
    )
