import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from condensq.llm import periodic, queries
from tests.llm.conftest import SCHEMA


def brute(words, least=24, times=3):
    out = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def made(rng):
    n, kinds = rng.choice([0, 1, 5, 24, 30, 60, 150, 400]), rng.choice([1, 2, 3, 5, 50])
    words = [rng.randrange(kinds) for _ in range(n)]
    if n > 30 and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 10)
        for i in range(a, n):
            words[i] = words[a + (i - a) % p]
        if rng.random() < 0.3:
            words[rng.randrange(n)] = 99
    return words


@pytest.mark.parametrize("least, times", [(24, 3), (6, 3), (4, 2), (24, 2), (1, 2)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least + times)
    found = 0
    for _ in range(60):
        texts = [made(rng) for _ in range(rng.randint(1, 8))]
        got = periodic.runs_of([np.array(t, np.int64) for t in texts], least, times)
        for t, g in zip(texts, got):
            want = brute(t, least, times)
            found += len(want)
            assert [tuple(r) for r in g.tolist()] == want
    assert found > 50


def test_cover_holds_every_difference():
    found = {(y - x) % periodic.MODULUS for x in periodic.COVER for y in periodic.COVER}
    assert found == set(range(periodic.MODULUS))


def test_extensions_equal_brute_force():
    rng = random.Random(9)
    for n, kinds in ((1, 1), (2, 1), (70, 1), (300, 2), (500, 40)):
        words = np.array([rng.randrange(kinds) for _ in range(n)] + [kinds], np.int64)
        pairs = [(rng.randrange(n + 1), rng.randrange(n + 1)) for _ in range(300)]
        a, b = (np.array(x) for x in zip(*[p for p in pairs if p[0] != p[1]] or [(0, 1)]))
        want = []
        for i, j in zip(a, b):
            k = 0
            while max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            want.append(k)
        assert periodic.Extensions(words).common(a, b).tolist() == want


def planted(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def digest(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (
        doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def test_query_equals_brute_force(spark, docs, corpus_rows, tmp_path):
    rows = [*corpus_rows, (None, "a b " * 40, None, None, None), (None, None, None, None, None)]
    rows += [(k, "one two three " * (k % 13) + "end", "", "", 0) for k in range(1000, 1080)]
    rows = [r for r in rows if len(r[1] or "") < 30_000]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((digest(*r[:2]) for r in rows), key=repr)
    assert sum(r.n_runs for r in got) > 30
    seen = periodic.periodic_runs(docs).collect()  # columns of clashing names
    assert len(seen) == len(corpus_rows)


def test_long_and_empty(spark):
    rows = [(1, "w " * 30_000, "", "", 0), (2, "y" * 300_000, "", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    one, two = periodic.periodic_runs(df).orderBy("doc_id").collect()
    assert [tuple(r) for r in one.runs] == [(0, 30_000, 1)] and one.text == "w"
    assert not two.runs and two.strongest is None and len(two.text) == 300_000
    assert periodic.periodic_runs(df.limit(0)).collect() == []
