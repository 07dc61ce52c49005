import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from condensq.llm import resampling
from tests.llm.conftest import SCHEMA

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def by_hand(rows, target, n=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    own = [features(r[1], n) for r in rows]
    s = Counter(bucket(f) for _, fs in own for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x, n)[1])
    S, T = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))

    out = []
    for (doc_id, *_), (n_words, fs) in zip(rows, own):
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(fs), weight, score, n_words])
    fit = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    places = {}
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        places.setdefault((r[0], r[1]), []).append(k)
    return sorted(((*r[:4], (places.get((r[0], r[1])) or [None]).pop(0) if places.get((r[0], r[1])) else None) for r in out), key=repr)


@pytest.mark.parametrize("n, buckets, percent", [(1, 10_000, 10), (3, 97, 50)])
def test_resample_equals_brute_force(spark, docs, corpus_rows, n, buckets, percent):
    target = [corpus_rows[k][1] for k in range(0, 30, 3)] + [None, "", "Zebra 42 écru"]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(docs, table, n, buckets, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = by_hand(corpus_rows, target, n, buckets, percent)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_null_ids_and_empty_tables(spark):
    rows = [(None, "word " * 30, None, None, None), (None, None, None, None, None), (5, "word " * 30, "", "", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "text string")
    got = resampling.resample(df, none, percent=100).collect()
    assert sorted(map(tuple, got), key=repr) == by_hand(rows, [], percent=100)
    assert resampling.resample(df.limit(0), none).collect() == []


def test_table_parts_ngrams_of_equal_keys(monkeypatch):
    """With all keys equal only the compared bytes tell the n-grams apart."""
    monkeypatch.setattr(resampling, "xxh64_intdigest", lambda b: 7)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 20))) for _ in range(60)]
    text = " ".join(rng.choices(words, k=400))
    table, owner, n_words = resampling.interned([text, None, text], 2, 1000)
    want = features(text, 1)[1] + features(text, 1)[1] + features(text, 2)[1][400:] * 2
    named = {}
    for slot, f in zip(table.slot.tolist(), want):
        assert named.setdefault(slot, f) == f
    assert len(named) == len(set(want)) == len(table.used)
    assert table.count[table.used].sum() == len(want) and n_words.tolist() == [400, 0, 400]
    counted = Counter(want)
    assert all(table.count[s] == counted[f] and table.bucket[s] == zlib.crc32(f.encode()) % 1000 for s, f in named.items())
    assert np.bincount(owner).tolist() == [799, 0, 799]


def test_very_long_word_and_text(spark):
    rows = [(1, "x" * 300_000, "", "", 0), (2, "Ab cd " * 100_000, "", "", 0), (3, "ab", "", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = resampling.resample(df, df, percent=100)
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(rows, [r[1] for r in rows], percent=100)
