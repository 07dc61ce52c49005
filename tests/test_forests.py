"""Forests that tasks grow: splits, seeds, saved form, and leaves met by words."""

import glob
import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from condensq.config import ForestSettings
from condensq.operators import explain as X
from condensq.operators import forests as R
from condensq.operators import growing as G
from condensq.operators import models as L
from condensq.session import checkpoint_dir


def gini(y, w):
    one = w[y == 1].sum() / w.sum()
    return 1 - one**2 - (1 - one) ** 2


def test_nodes_take_the_best_split():
    """Each inner node gains what the best of all splits of its drawn rows gains; leaves have none left."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 8, (300, 3)).astype(float)
    y = (x[:, 0] + rng.normal(size=300) * 2 > 4).astype(int)
    weights, p = (0.7, 1.6), ForestSettings(trees=1, max_depth=3, min_leaf=4, feature_subset="all", seed=9)
    rows = G.binned(x, y, weights)
    tree, = G.grow(rows, range(1), p)
    n = np.random.default_rng([9, 0]).poisson(1.0, 300)
    label = rows.label.astype(int)
    at = {0: np.arange(300)}
    for node, child in enumerate(tree["child"]):
        some = at[node]
        y_, n_ = label[some], n[some]
        w_ = n_ * np.asarray(weights)[y_]
        assert tree["one"][node] == n_[y_ == 1].sum() and tree["zero"][node] == n_[y_ == 0].sum()
        gains = {}
        for f, cut in itertools.product(range(3), range(7)):
            left = rows.bins[some, f] <= cut
            if min(n_[left].sum(), n_[~left].sum()) >= 4:
                parts = sum(w_[s].sum() * gini(y_[s], w_[s]) for s in (left, ~left))
                gains[f, cut] = gini(y_, w_) - parts / w_.sum()
        if child >= 0:
            best = tree["feature"][node], tree["cut"][node]
            assert gains[best] == pytest.approx(max(gains.values())) and gains[best] > 0
            left = rows.bins[some, best[0]] <= best[1]
            at[child], at[child + 1] = some[left], some[~left]
    assert (tree["child"] >= 0).any()
    # Sorted and counted cells are the same.
    many = G.grow(rows, range(5), ForestSettings(trees=5, feature_subset="sqrt"))
    cells = G._cells
    try:
        G._cells = lambda node, at, chosen, flat, packed, tagged: cells(
            np.concatenate([node, np.full(4096 * chosen.shape[0], 0)]), np.concatenate([at, np.zeros(4096 * chosen.shape[0], int)]),
            chosen, flat, np.concatenate([packed, np.zeros(4096 * chosen.shape[0], int)]), tagged)
        counted = G.grow(rows, range(5), ForestSettings(trees=5, feature_subset="sqrt"))
    finally:
        G._cells = cells
    assert all((a[c] == b[c]).all() for a, b in zip(many, counted) for c in a)


def test_thresholds_are_midpoints_or_quantiles():
    assert G.thresholds(np.array([3.0, 1.0, 1.0]), np.ones(3)).tolist() == [2.0]
    assert G.thresholds(np.full(4, 7.0), np.ones(4)).tolist() == []
    cuts = G.thresholds(np.arange(1000.0), np.ones(1000))
    assert len(cuts) == 31 and np.abs(np.diff(cuts) - 1000 / 32).max() <= 1
    assert len(G.thresholds(np.array([0.0] * 5000 + list(range(1, 100))), np.ones(5099))) <= 31


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(600).selectExpr(
        "CAST(id AS STRING) AS key", "CAST(id * 37 % 600 AS DOUBLE) AS a", "sin(id) AS b", "cos(id * id) AS c",
        "CAST(id * 37 % 600 + 150 * sin(id * 3) > 300 AS INT) AS class")


def test_order_and_partitions_decide_nothing(rows):
    p = ForestSettings(trees=20, max_depth=30)
    want = None
    for some in (rows, rows.orderBy("b").repartition(5), rows.coalesce(1)):
        model = L.fit_forest(some, ["a", "b", "c"], params=p)
        got = {r.key: r.prob_pos for r in L.score(rows, model).collect()}
        want = want or got
        assert got == want
    other = L.fit_forest(rows, ["a", "b", "c"], params=ForestSettings(trees=20, seed=43))
    assert {r.key: r.prob_pos for r in L.score(rows, other).collect()} != want


def test_scores_and_saves_make_no_forest_of_the_jvm(spark, rows):
    """Tasks grow, write and read the nodes; the forest that the JVM loads from them scores the same."""
    cols = ["a", "b", "c"]
    model = L.fit_forest(rows, cols, params=ForestSettings(trees=20))
    path = f"{checkpoint_dir(spark)}/grown"
    L.save_bundle(L.Bundle(model, cols, {c: 0.0 for c in cols}), path, spark)
    L.save_bundle(L.Bundle(model, cols, {c: 0.0 for c in cols}), path, spark)  # a second time
    again = L.load_bundle(path, spark).model
    out = L.score(L.score(rows, model).drop("pred", "correct", "pred_error"), again, "again").cache()
    assert out.where("prob_pos = again").count() == 600
    forests = model.stages[-1], again.stages[-1]
    assert all(f.__dict__.get("_java") is None for f in forests)
    assert all((f.getNumTrees, f.numFeatures, f.numClasses, f.getMaxDepth()) == (20, 3, 2, 30) for f in forests)
    assert len(glob.glob(f"{path.removeprefix('file:')}/model/stages/1_*/data/*.parquet")) >= 1
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    loaded = PipelineModel.load(f"{path}/model")  # by Spark itself
    want = loaded.transform(out).select("prob_pos", vector_to_array("probability")[1].alias("want"))
    assert want.where("prob_pos = want").count() == 600
    assert loaded.stages[-1].totalNumNodes == forests[0].totalNumNodes == R.saved_nodes(forests[0], spark).count()


def test_other_cases_go_to_sparks_fit(rows, monkeypatch):
    monkeypatch.setattr(L, "GROWN", 100)
    model = L.fit_forest(rows, ["a", "b"], params=ForestSettings(trees=5, max_depth=4))
    assert model.stages[-1].grown is None
    assert L.score(rows, model).where("correct = 1").count() > 400
    with pytest.raises(Exception):
        monkeypatch.setattr(L, "GROWN", 1000)
        L.fit_forest(rows.withColumn("a", F.lit(None).cast("double")), ["a", "b"], params=ForestSettings(trees=2))


def test_leaves_are_met_by_words():
    """Sums over any boxes, several of them around a row, values on bounds and missing values included."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (500, 4)).astype(float)
    x[7, 2] = np.nan
    leaves = []
    for k in range(150):
        f = sorted(rng.permutation(4)[: k % 5].tolist())
        low = np.where(rng.random(len(f)) < 0.3, -np.inf, rng.integers(0, 3, len(f)))
        high = np.where(rng.random(len(f)) < 0.3, np.inf, low + rng.integers(1, 5, len(f)))
        leaves.append((float(rng.random()), f, low.tolist(), np.where(np.isneginf(low), 3.0, high).tolist(), [0.5] * len(f)))
    table = pa.table(dict(zip(("value", "features", "low", "high", "share"), map(list, zip(*leaves)))))
    total, met = X.leaf_sums(x, X.flat_leaves(table))
    inside = np.array([[all(a < row[f] <= b for f, a, b in zip(fs, lo, hi)) for _, fs, lo, hi, _ in leaves] for row in x])
    assert (met == inside.sum(axis=1)).all() and met.max() > 5
    assert np.allclose(total, inside @ np.array([leaf[0] for leaf in leaves]))
    assert X.leaf_sums(x[:0], X.flat_leaves(table))[0].shape == (0,)
