import random

import pytest
from pyspark.sql import functions as F

from condensq.functions import arrays as A
from condensq.operators import series as Z


def brute(v, thr=0.5, width=20):
    runs, cur = [], 0
    for x in [*v, None]:
        if x is not None and x > thr:
            cur += 1
        elif cur:
            runs.append(cur)
            cur = 0
    best = max((sum(v[i:i + width]) / width for i in range(len(v) - width + 1)), default=None)
    return len(runs), max(runs, default=0), best if best is not None else sum(v) / len(v)


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(3)
    sizes = [1, 5, 19, 20, 21, 64, 300]
    data = [(i, [round(rng.random(), 4) for _ in range(n)]) for i, n in enumerate(sizes)]
    data += [(90, [0.9] * 130), (91, [0.1] * 45), (92, [0.9] * 32 + [0.1] + [0.9] * 40)]
    return dict(data), spark.createDataFrame(data, "k int, scores array<double>").cache()


@pytest.mark.parametrize("chunk", [20, 32, 4096])
def test_long_form_matches_a_loop(scores, chunk):
    want, df = scores
    long = Z.to_long(df, "k", "scores")
    runs = {r.k: (r.n_runs, r.longest_run) for r in Z.runs_above(long, "k", 0.5, chunk=chunk).collect()}
    best = {r.k: r.max_window_mean for r in Z.sliding_max(long, "k", 20, chunk=chunk).collect()}
    for k, v in want.items():
        n, longest, m = brute(v)
        assert runs[k] == (n, longest)
        assert best[k] == pytest.approx(m)


def test_array_form_matches_a_loop(scores):
    want, df = scores
    dig = A.score_digest(F.col("scores"))
    for r in df.select("k", *[c.alias(n) for n, c in dig.items()]).collect():
        v = want[r.k]
        n, longest, m = brute(v)
        assert (r.n_idr_regions, r.longest_idr_region, r.protein_length) == (n, longest, len(v))
        assert r.max_disorder_window == pytest.approx(m, abs=6e-5)
        assert r.idr_percent == pytest.approx(100 * sum(x > 0.5 for x in v) / len(v), abs=6e-3)


def test_no_scores_give_zeros(spark):
    df = spark.createDataFrame([([],), (None,)], "s array<double>")
    dig = A.score_digest(F.col("s"))
    assert {tuple(r) for r in df.select(*dig.values()).collect()} == {(0.0, 0.0, 0.0, 0, 0, 0)}


def test_status(spark):
    df = spark.createDataFrame([([0.1], 50), ([], 50), (None, 5)], "s array<double>, n int")
    got = [r[0] for r in df.select(A.score_status(F.col("s"), F.col("n"))).collect()]
    assert got == ["computed", "failed", "skipped_short"]


def test_positions(spark, rows):
    df = spark.createDataFrame(
        [("u", 3, "d2"), ("u", 1, "d1"), ("u", 2, "d1"), ("w", 9, "d1")], "k string, o int, day string")
    got = Z.number_rows(df, "k", ["o"], F.col("day"))
    assert rows(got, "k", "o", "pos") == [("u", 1, 1), ("u", 2, 2), ("u", 3, 3), ("w", 9, 1)]


def test_too_small_chunk_is_refused(spark):
    with pytest.raises(ValueError):
        Z.sliding_max(spark.range(1), "id", 20, chunk=5)


def test_maps_and_names(spark):
    df = spark.createDataFrame([(0.1, -0.9, None, 5.0)], "a double, b double, c double, d double")
    items = A.contributions({c: F.col(c) for c in "abcd"}, {c: F.col(c) for c in "abcd"})
    r = df.select(
        A.top_features_map(items, 2).alias("m"), A.imputed_names(["a", "c"]).alias("i"),
        A.drop_null_map({c: F.col(c) for c in "abc"}).alias("d")).first()
    assert set(r.m) == {"d", "b"} and r.m["b"]["shap"] == -0.9
    assert r.i == ["c"] and r.d == {"a": 0.1, "b": -0.9}
