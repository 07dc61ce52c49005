"""Periodic run detection: maximal stretches of words that repeat with a period.

A run is a stretch of one document whose words `period` apart are the same, with no smaller period,
of `least` words and `times` periods at least, that no neighbouring word extends.

1. Harmonic grid. A run of period q holds max((times - 1) * q, least - q) consecutive places whose
   word is that of q words on, so every such step along the document meets one of them. Of all
   steps of all periods (n log n of them) only those go on where a few words agree.
2. Longest common extensions to the right and to the left of (i, i + q) give the run. Of a document
   with candidates only the suffixes at the places of a difference cover are sorted (blocks of
   words first, then by doubling). Two places reach cover places together after fewer words than
   the cover is long; those words are compared, and a sparse table of minima over the common
   prefixes of neighbouring suffixes tells the rest.
3. A stretch found under several periods (multiples of one) keeps the smallest.

Everything happens inside a document, so there is no shuffle. Documents of like length are laid end
to end, parted by words of their own, and handled by array operations together.

Edge cases: null, empty and short texts have no runs and keep all their words; repeated rows give
repeated results; ties between runs go to the smallest start, then period; very long texts are
handled whole (a one-word text of n words costs n log n steps); an empty table gives an empty
result; other columns of any name are not read. Words are compared exactly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from condensq.llm.common import slices

#: A difference cover of the numbers modulo 31: each difference but 0 occurs exactly once.
MODULUS, COVER = 31, (0, 1, 3, 8, 12, 18)
_BLOCK = 32  # words of the first sort, an even number not below MODULUS
_PAIRS = 1 << 20  # grid steps handled at once
_NEAR = 8  # words on one side of a step that have to agree, at most


def _first_of() -> np.ndarray:
    """By difference d: a cover number x with x + d in the cover as well."""
    out = np.zeros(MODULUS, np.int64)
    for x in COVER:
        for y in COVER:
            out[(y - x) % MODULUS] = x
    return out


_FIRST = _first_of()


class Extensions:
    """Longest common extensions to the right of places in an array of words, none below 0. Its last
    word has to be found nowhere else."""

    def __init__(self, words: np.ndarray) -> None:
        n = self.n = len(words)
        self.words = np.concatenate([words, np.zeros(_BLOCK + 1, words.dtype)])
        inside = np.zeros(MODULUS, bool)
        inside[list(COVER)] = True
        at = np.flatnonzero(inside[np.arange(n) % MODULUS])
        index = np.full(n, -1, np.int64)
        index[at] = np.arange(len(at))
        order, rank = self._by_block(at)
        levels, step = [rank], MODULUS
        while rank.max() + 1 < len(at):
            after = at + step
            more = np.where(after < n, rank[index[np.minimum(after, n - 1)]], -1)
            pair = rank * (len(at) + 1) + more + 1
            order = np.argsort(pair, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(pair[order]) != 0)])
            rank = np.empty_like(new)
            rank[order] = new
            levels.append(rank)
            step *= 2
        self.rank = np.full(n, -1, np.int64)
        self.rank[at] = rank
        self._minima(self._neighbours(at[order], index, levels))

    def _by_block(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order and rank of the cover places by their first words."""
        pairs = self.words[:-1].astype(np.int64) << 32 | self.words[1:]
        order = np.arange(len(at))
        for k in range(_BLOCK - 2, -1, -2):
            order = order[np.argsort(pairs[at[order] + k], kind="stable")]
        new = np.zeros(max(len(at) - 1, 0), bool)
        for k in range(0, _BLOCK, 2):
            new |= np.diff(pairs[at[order] + k]) != 0
        rank = np.empty(len(at), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(new)])
        return order, rank

    def _neighbours(self, place: np.ndarray, index: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each suffix with the one before it in the order (first: 0)."""
        a, b, out = place[:-1], place[1:], np.zeros(len(place), np.int64)
        have = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            i, j = a + have, b + have
            ok = (i < self.n) & (j < self.n)
            same = np.zeros(len(a), bool)
            same[ok] = levels[k][index[i[ok]]] == levels[k][index[j[ok]]]
            have += same * (MODULUS << k)
        out[1:] = have + self._compared(a + have, b + have, np.full(len(a), _BLOCK))
        return out

    def _minima(self, values: np.ndarray) -> None:
        self.table, size = [values], 1
        while 2 * size <= len(values):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-size], last[size:]))
            size *= 2

    def _compared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Number of equal words from a and b on, up to `most`."""
        out, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
        for k in range(int(most.max(initial=0))):
            i, j = a[open_] + k, b[open_] + k
            ok = (k < most[open_]) & (np.maximum(i, j) < self.n)
            ok[ok] = self.words[i[ok]] == self.words[j[ok]]
            open_ = open_[ok]
            if not len(open_):
                break
            out[open_] += 1
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of a and b (a and b differ)."""
        few = (_FIRST[(b - a) % MODULUS] - a) % MODULUS
        out = self._compared(a, b, few)
        on = np.flatnonzero(out == few)
        i, j = a[on] + few[on], b[on] + few[on]
        ok = np.maximum(i, j) < self.n
        on, i, j = on[ok], self.rank[i[ok]], self.rank[j[ok]]
        low, high = np.minimum(i, j) + 1, np.maximum(i, j) + 1
        power = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(power):
            at = power == k
            row = self.table[k]
            out[on[at]] += np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return out


def _agreeing(words: np.ndarray, i: np.ndarray, q: np.ndarray, near: int) -> np.ndarray:
    """Which steps agree with the place q on in `near` words to the right or to the left."""
    out = np.zeros(len(i), bool)
    for side in (1, -1):
        left = np.arange(len(i))
        for k in range(1, near + 1) if side < 0 else range(1, near):
            a = i[left] + side * k
            b = a + q[left]
            ok = (a >= 0) & (b < len(words))
            ok[ok] = words[a[ok]] == words[b[ok]]
            left = left[ok]
        out[left] = True
    return out


def _grid(words: np.ndarray, doc: np.ndarray, sizes: np.ndarray, least: int, times: int):
    """Steps (i, period) that a run may cross."""
    top, total = int(sizes.max()) // times, len(words)
    period = np.arange(1, top + 1)
    step = np.maximum((times - 1) * period, least - period)
    steps = -(-(total - period) // step)
    # A stretch of `step` agreeing places around i reaches half as far on one side of it.
    near = min(_NEAR, int(step.min()) // 2)
    ends = np.cumsum(steps)
    start = 0
    found = []
    while start < top:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + _PAIRS, "right")))
        counts = steps[start:stop]
        which = np.repeat(np.arange(start, stop), counts)
        i = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * step[which]
        q = period[which]
        same = words[i] == words[i + q]
        i, q = i[same], q[same]
        inside = (doc[i] == doc[i + q]) & (times * q <= sizes[doc[i]])
        i, q = i[inside], q[inside]
        ok = _agreeing(words, i, q, near)
        found.append((i[ok], q[ok]))
        start = stop
    return tuple(np.concatenate(x) for x in zip(*found))


def _laid(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, text, first): texts end to end, each after a word of its own, one more at the end."""
    own = len(texts) + 1
    parts = [x for k, t in enumerate(texts) for x in (np.array([k], np.int64), t + own)]
    sizes = np.array([len(t) + 1 for t in texts])
    doc = np.concatenate([np.repeat(np.arange(len(texts)), sizes), [len(texts)]])
    return np.concatenate([*parts, [own - 1]]), doc, np.cumsum(sizes) - sizes + 1


def runs_of(texts: list[np.ndarray], least: int = 24, times: int = 3) -> list[np.ndarray]:
    """For each text (an array of word numbers) its runs: rows start, length, period, by start."""
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(texts)
    long = [k for k, t in enumerate(texts) if len(t) >= max(least, times)]
    if not long:
        return out
    words, doc, _ = _laid([texts[k] for k in long])
    sizes = np.array([len(texts[k]) for k in long] + [0])
    i, q = _grid(words, doc, sizes, least, times)
    if not len(i):
        return out
    # Only the texts with candidates are sorted.
    first = np.cumsum(sizes[:-1] + 1) - sizes[:-1]
    chosen, place = np.unique(doc[i], return_inverse=True)
    words, doc, start = _laid([texts[long[k]] for k in chosen])
    i = i - first[chosen[place]] + start[place]
    right = Extensions(words)
    left = Extensions(words[::-1])
    n, found = len(words), []
    for k in range(0, len(i), _PAIRS):
        a, p = i[k : k + _PAIRS], q[k : k + _PAIRS]
        back = left.common(n - a, n - a - p)
        length = back + right.common(a, a + p) + p
        ok = length >= np.maximum(least, times * p)
        found.append(np.stack([(a - back)[ok], length[ok], p[ok]], axis=1))
        found = [np.unique(np.concatenate(found), axis=0)]
    (runs,) = found
    if not len(runs):
        return out
    fresh = np.concatenate([[True], (np.diff(runs[:, :2], axis=0) != 0).any(axis=1)])
    runs = runs[fresh]  # the smallest period of each stretch comes first
    owner = doc[runs[:, 0]]
    runs[:, 0] -= start[owner]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0], owner))]
    owner = np.sort(owner)
    for k in np.unique(owner):
        out[long[chosen[k]]] = runs[owner == k]
    return out


def _groups(sizes: list[int], most: int = 400_000) -> Iterator[list[int]]:
    """Numbers of texts of like length, in groups of about `most` words."""
    group, words, kind = [], 0, None
    for k in sorted(range(len(sizes)), key=sizes.__getitem__):
        if group and (sizes[k].bit_length() != kind or words + sizes[k] > most):
            yield group
            group, words = [], 0
        kind = sizes[k].bit_length()
        group.append(k)
        words += sizes[k]
    if group:
        yield group


def _strongest(runs: np.ndarray) -> int:
    """Number of the run of the greatest length / period; the first of equal ones."""
    close = runs[:, 1] / runs[:, 2]
    close = np.flatnonzero(close >= close.max() * (1 - 1e-9))
    return max(close.tolist(), key=lambda k: (Fraction(int(runs[k, 1]), int(runs[k, 2])), -k))


_RUN = "struct<start: long, length: long, period: long>"


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """(doc_id, n_words, runs, strongest, text): every document with its runs by start and period, the
    one of most periods, and its words joined by one space without those that a run repeats: words
    in a run after its first `period` ones."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        for batch in slices(batches, "text", 4 << 20):
            number = defaultdict(count().__next__)
            words = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            coded = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words]
            runs: list = [None] * len(words)
            for group in _groups([len(w) for w in words]):
                for k, r in zip(group, runs_of([coded[k] for k in group], least, times)):
                    runs[k] = r
            best, kept = [], []
            for w, r in zip(words, runs):
                if len(r):
                    edge = np.zeros(len(w) + 1, np.int64)
                    np.add.at(edge, r[:, 0] + r[:, 2], 1)
                    np.add.at(edge, r[:, 0] + r[:, 1], -1)
                    w = [w[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                    best.append(dict(zip(("start", "length", "period"), r[_strongest(r)].tolist())))
                else:
                    best.append(None)
                kept.append(b" ".join(w).decode())
            ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
            values = np.concatenate(runs)
            fields = pa.StructArray.from_arrays([pa.array(values[:, k]) for k in range(3)], fields=list(run))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), fields), pa.array(best, run), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "runs", "strongest", "text"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        found, f"doc_id {kind}, n_words long, runs array<{_RUN}>, strongest {_RUN}, text string"
    )
