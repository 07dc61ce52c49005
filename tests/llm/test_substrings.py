from collections import Counter

import numpy as np
import pytest

from condensq.llm import substrings
from tests.llm.conftest import SCHEMA


def brute(rows, length):
    texts = [(r[0], (r[1] or "").encode().split()) for r in rows]
    windows = Counter(tuple(w[s : s + length]) for _, w in texts for s in range(len(w) - length + 1))
    out = []
    for doc_id, words in texts:
        gone = np.zeros(len(words), bool)
        for s in range(len(words) - length + 1):
            if windows[tuple(words[s : s + length])] > 1:
                gone[s : s + length] = True
        kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode()
        out.append((doc_id, len(words), int(gone.sum()), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [35, 50, 3, 17])
def test_equals_brute_force(docs, corpus_rows, length):
    got = substrings.without_repeats(docs, length)
    assert got.columns == ["doc_id", "n_words", "n_removed", "removed", "text"]
    found = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in found), key=repr) == brute(corpus_rows, length)
    for r in found:
        assert r.n_removed == sum(s.stop - s.start for s in r.removed)
    assert any(r.n_removed for r in found)


def test_levels_double():
    assert substrings.level_lengths(35) == [9, 18, 35]
    assert substrings.level_lengths(50) == [13, 25, 50]
    assert substrings.level_lengths(3) == [3]
    for length in range(1, 200):
        levels = substrings.level_lengths(length)
        assert levels[-1] == length and all(b <= 2 * a for a, b in zip(levels, levels[1:]))


def test_extended_windows_stay_inside():
    for length in range(8, 120):
        levels = substrings.level_lengths(length)
        for inner in range(length - levels[0] + 1):
            at, outer = np.array([inner]), np.array([0])
            for have, want in zip(levels, levels[1:]):
                wider = substrings.extended(at, outer, have, want, length)
                assert 0 <= wider[0] <= at[0] and at[0] + have <= wider[0] + want <= length
                at = wider


def test_null_ids_long_texts_and_empty_tables(spark):
    rows = [
        (None, "a " * 40, None, None, None), (None, None, None, None, None), (1, "b " * 100_000, "", "", 0),
        (2, "c" * 200_000, "", "", 0), (3, " ".join(map(str, range(60))), "", "", 0),
        (4, "x " + " ".join(map(str, range(20, 55))) + " y", "", "", 0), (4, "", "", "", 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = substrings.without_repeats(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=repr) == brute(rows, 35)
    assert substrings.without_repeats(df.limit(0)).collect() == []


def test_many_copies_in_any_partition(spark):
    words = " ".join(map(str, range(80)))
    rows = [(k, words if k % 3 else f"{k} " + words[30:], "", "", 0) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = substrings.without_repeats(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=repr) == brute(rows, 35)
