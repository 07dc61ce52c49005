import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from condensq.operators import ranking as R


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value; groups are uneven and one is NULL."""
    return spark.range(3000).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 3 == 0, 7.5).otherwise((F.col("id") * 7919 % 1009) / 10.0).alias("v"),
        F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 == 7, "b").alias("g"),
    ).cache()


def test_ntile_equals_the_plain_window(skewed, rows):
    plain = skewed.withColumn("tile", F.ntile(7).over(
        Window.orderBy("v", F.md5(F.col("k").cast("string")), "k")))
    got = R.quantile_tile(skewed, "v", "k", 7)
    assert rows(got, "k", "tile") == rows(plain, "k", "tile")


def test_a_frequent_value_is_split_over_buckets(skewed):
    placed = R.with_tied_bucket(skewed, F.col("v"), F.col("k"))
    largest = placed.groupBy("_range").count().agg(F.max("count")).first()[0]
    assert largest < 600  # the value alone has 1000 rows


def test_descending_rank(skewed, rows):
    order = Window.orderBy(F.desc("v"), F.md5(F.col("k").cast("string")), "k")
    plain = skewed.withColumn("rank", F.row_number().over(order))
    assert rows(R.ranked_by_value(skewed, "v", "k", True), "k", "rank") == rows(plain, "k", "rank")


def test_running_totals_keep_null_groups(skewed, rows):
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    plain = skewed.withColumn("t", F.round(F.sum("v").over(w), 6))
    got = R.running_totals(
        skewed, {"t": F.col("v")}, [F.col("k")], F.floor(F.col("k") / 100), ["g"]
    ).withColumn("t", F.round("t", 6))
    assert rows(got, "k", "t") == rows(plain, "k", "t")


def test_seeded_order_is_a_repeatable_permutation(skewed, rows):
    a = rows(R.seeded_order(skewed, "k", 42, ["g"]), "k", "position")
    assert a == rows(R.seeded_order(skewed.repartition(5), "k", 42, ["g"]), "k", "position")
    assert a != rows(R.seeded_order(skewed, "k", 43, ["g"]), "k", "position")
    per = R.seeded_order(skewed, "k", 42, ["g"]).groupBy("g").agg(
        F.count("*").alias("n"), F.max("position").alias("m"), F.count_distinct("position").alias("d"))
    assert all(r.n == r.m == r.d for r in per.collect())


@pytest.mark.parametrize("n,tiles", [(10, 4), (3, 4), (8, 4), (101, 10)])
def test_ntile_formula(spark, n, tiles):
    df = spark.range(1, n + 1)
    plain = df.select(F.ntile(tiles).over(Window.orderBy("id")).alias("a"), "id")
    got = plain.withColumn("b", R.ntile_of(F.col("id"), F.lit(n), tiles))
    assert got.where("a <> b").isEmpty()


@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_exact_quantiles(skewed, p):
    got = {r.g: r.quantile for r in R.exact_quantiles(skewed, ["v"], (p,), ["g"]).collect()}
    pdf = skewed.toPandas()
    for g in ("a", "b", None):
        vals = pdf[pdf.g.isna() if g is None else pdf.g == g].v
        assert got[g] == pytest.approx(np.quantile(vals, p))


@pytest.mark.parametrize("n", [1, 2, 7, 210, 4999, 5001, 60000])
def test_quantiles_at_any_size(spark, n):
    df = spark.range(n).select(((F.col("id") * 7919) % 10007 / 3.0).alias("v"))
    vals = df.toPandas().v
    for r in exact(df, (0.05, 0.25, 0.95)):
        assert r.quantile == pytest.approx(np.quantile(vals, r.prob), rel=1e-12)


def exact(df, probs):
    return R.exact_quantiles(df, ["v"], probs).collect()


def test_quantiles_skip_missing_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, None), (10.0, 4.0)], "a double, b double")
    got = {r.feature: r.quantile for r in R.exact_quantiles(df, ["a", "b"]).collect()}
    assert got == {"a": 2.0, "b": 4.0}


def test_first_latest_and_best_per_key(spark, rows):
    df = spark.createDataFrame(
        [("x", 2, 1, "p"), ("x", 1, 5, None), ("x", 3, 5, "q"), ("y", 1, 0, "r")],
        "k string, ord int, s int, v string")
    assert rows(R.first_per_key(df, ["k"], ["ord"]), "k", "ord") == [("x", 1), ("y", 1)]
    assert rows(R.latest_per_key(df, ["k"], ["ord"]), "k", "ord") == [("x", 3), ("y", 1)]
    best = R.best_per_key(df, ["k"], [F.col("s").alias("s1")], "ord")
    assert rows(best, "k", "ord") == [("x", 1), ("y", 1)]


def test_importance_rank_is_gapless(spark, rows):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9)], "feature string, m double")
    assert rows(R.importance_rank(df, "m"), "feature", "rank") == [("a", 2), ("b", 3), ("c", 1)]


def test_tile_average(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "t int, v double")
    got = sorted(r.m for r in R.tile_average(df, "t", "v", "m").collect())
    assert got == [2.0, 2.0, 5.0]
