import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from condensq.config import BoostSettings, ForestSettings
from condensq.operators import explain as X
from condensq.operators import forests as R
from condensq.operators import models as L
from condensq.operators.metrics import areas, brier
from condensq.operators.monitoring import classification_report
from condensq.session import checkpoint_dir, dealt, parted

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        a, b, c = rng.random(), rng.random(), rng.random()
        y = int(a + 0.5 * b + rng.gauss(0, 0.2) > 0.8)
        rows.append((f"g{i:03d}", y, ("train", "train", "val", "test")[i % 4], a,
                     None if i % 9 == 0 else b, c))
    df = spark.createDataFrame(rows, "gene_id string, class int, split string, a double, b double, c double")
    filled, medians = L.imputation_policy(df, COLS)
    return df, filled.cache(), medians


@pytest.fixture(scope="module")
def forest(data):
    _, filled, _ = data
    return L.fit_forest(filled.where("split = 'train'"), COLS, params=ForestSettings(trees=8, max_depth=4))


def test_imputation_policies(data):
    df, filled, medians = data
    train = df.where("split = 'train'").toPandas()
    assert medians["b"] == pytest.approx(np.nanmedian(train.b))
    assert filled.where("b IS NULL").isEmpty()
    _, all_medians = L.imputation_policy(df, COLS, "all")
    assert all_medians["b"] == pytest.approx(np.nanmedian(df.toPandas().b))
    flagged, _ = L.imputation_policy(df, COLS, "none")
    assert flagged.where("b_missing = 1").count() == df.where("b IS NULL").count()


def test_nan_is_imputed(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "a double")
    assert [r.a for r in L.impute(df, {"a": 9.0}).collect()] == [9.0, 9.0, 2.0]


def test_forest_scores(data, forest):
    _, filled, _ = data
    out = L.score(filled, forest)
    assert out.where("prob_pos < 0 OR prob_pos > 1").isEmpty()
    assert out.where("(prob_pos >= 0.5) <> (pred = 1)").isEmpty()
    assert areas(out.where("split = 'test'")).first().auroc > 0.8


def test_baseline_is_weaker(data, forest):
    _, filled, _ = data
    base = L.fit_baseline(filled.where("split = 'train'"), ("c",), params=ForestSettings(trees=8, max_depth=4))
    test = filled.where("split = 'test'")
    assert areas(L.score(test, base)).first().auroc < areas(L.score(test, forest)).first().auroc


def test_boosting_stops_on_validation(data):
    _, filled, _ = data
    rows = filled.where("split <> 'test'").withColumn("is_val", F.col("split") == "val")
    model = L.fit_boosting(rows, COLS, params=BoostSettings(rounds=12, max_depth=2, step=0.3))
    assert 1 <= model.stages[-1].getNumTrees <= 12
    assert areas(L.score(filled.where("split = 'test'"), model)).first().auroc > 0.8


def test_calibration_gives_probabilities(data):
    _, filled, _ = data
    model = L.fit_calibrated(filled.where("split = 'train'"), COLS, "gene_id", k=3,
                             params=ForestSettings(trees=4, max_depth=3))
    assert len(model.members) == 3
    out = model.transform(filled.where("split = 'val'"))
    assert out.where("prob_pos < 0 OR prob_pos > 1").isEmpty()
    assert brier(out).first().brier < 0.25


def test_weight_sweep_picks_the_best(data):
    _, filled, _ = data
    best, results = L.sweep_class_weight(
        filled.where("split = 'train'"), filled.where("split = 'val'"), COLS,
        params=ForestSettings(trees=3, max_depth=2), negatives=(2.0,))
    assert set(results) == {"balanced", "neg=2.0"} and results[best] == max(results.values())


def test_attributions_add_up(spark, data, forest):
    _, filled, _ = data
    nodes = X.forest_nodes(forest.stages[-1], spark)
    out = X.tree_attribution(L.score(filled, forest), nodes, COLS)
    gap = F.abs(F.aggregate("attributions", F.col("base_value"), lambda s, x: s + x) - F.col("prob_pos"))
    assert out.agg(F.max(gap)).first()[0] < 1e-9
    imp = X.global_importance(X.attributions_long(out, "gene_id", COLS)).collect()
    assert sorted(r["rank"] for r in imp) == [1, 2, 3]
    assert min(imp, key=lambda r: r["rank"]).feature == "a"


def test_attributions_equal_the_definition(spark, data, forest):
    """Shapley values by enumeration of all feature subsets."""
    _, filled, _ = data
    leaves = list(X._leaf_paths(X.forest_nodes(forest.stages[-1], spark)))
    x = np.array([[r.a, r.b, r.c] for r in filled.limit(5).collect()])

    def value(row, known):
        total = 0.0
        for v, feats, lo, hi, z in leaves:
            for f, l, h, share in zip(feats, lo, hi, z):
                v *= float(l < row[f] <= h) if f in known else share
            total += v
        return total

    got, base = X.attribute_rows(x, leaves)
    for row, phi in zip(x, got):
        assert base == pytest.approx(value(row, set()))
        for i in range(3):
            rest = [j for j in range(3) if j != i]
            want = sum(
                math.factorial(k) * math.factorial(2 - k) / 6
                * (value(row, {*s, i}) - value(row, set(s)))
                for k in range(3) for s in itertools.combinations(rest, k)
            )
            assert phi[i] == pytest.approx(want, abs=1e-12)


def test_whole_forest_attributions(spark, data):
    """Blocks of rows and groups of trees give what one walk over all leaves gives."""
    _, filled, _ = data
    model = L.fit_forest(filled.where("split = 'train'"), COLS, params=ForestSettings(trees=9, max_depth=30))
    leaves = X.leaf_table(X.node_table(model.stages[-1], spark)).cache()
    out = X.forest_attribution(L.score(filled, model), leaves, COLS, "gene_id", rows_per_block=150, trees_per_group=4)
    gap = F.abs(F.aggregate("attributions", F.col("base_value"), lambda s, x: s + x) - F.col("prob_pos"))
    assert out.count() == 400 and out.agg(F.max(gap)).first()[0] < 1e-9
    got = out.orderBy("gene_id").select("attributions", *COLS).collect()
    paths = list(X._leaf_paths(X.forest_nodes(model.stages[-1], spark)))
    assert leaves.count() == len(paths)
    want, base = X.attribute_rows(np.array([[r.a, r.b, r.c] for r in got]), paths)
    assert np.allclose([r.attributions for r in got], want, atol=1e-12)
    assert out.first().base_value == pytest.approx(base)
    assert X.forest_attribution(L.score(filled.limit(0), model), leaves, COLS, "gene_id").collect() == []


def test_importance_tables(spark):
    imp = spark.createDataFrame([("cds_length", 0.3, 1), ("zzz", 0.1, 2)], "feature string, mean_abs_shap double, rank int")
    got = {r.feature: (r.shap_pct, r.category) for r in X.importance_share(imp).collect()}
    assert got == {"cds_length": (75.0, "RNA-length"), "zzz": (25.0, "Other")}
    other = spark.createDataFrame([("zzz", 0.9, 1)], "feature string, mean_abs_shap double, rank int")
    cmp = {r.feature: (r.rank_m, r.rank_n, r.shift_n) for r in X.compare_importance({"m": imp, "n": other}).collect()}
    assert cmp == {"cds_length": (1, None, None), "zzz": (2, 1, 1)}


def test_attribution_columns(spark):
    keys = spark.createDataFrame([("g1",), ("g2",)], "gene_id string")
    attrs = spark.createDataFrame([("g1", "di_CG", 0.5), ("g1", "rmsf_nterm50", -0.1)], "gene_id string, feature string, attribution double")
    got = {r.gene_id: r for r in X.attribution_columns(keys, attrs, "gene_id").collect()}
    assert got["g1"].shap_di_CG == 0.5 and got["g1"].shap_mrna_length is None
    assert got["g2"].shap_di_CG is None


SEQ = ["mrna_length", "au_content", "rrach_per_kb", "rmsf_mean"]


@pytest.fixture(scope="module")
def bundle(spark):
    rng = random.Random(4)
    rows = [(str(i), "".join(rng.choice("AUUGC" if i % 2 else "AGGC") for _ in range(60 + i)), None, i % 2)
            for i in range(80)]
    df = spark.createDataFrame(rows, "gene_id string, mrna_seq string, protein_seq string, class int")
    from condensq.functions.sequence import compute_features

    feats = L.impute(compute_features(df), {c: 3.0 for c in SEQ})
    model = L.fit_forest(feats, SEQ, params=ForestSettings(trees=5, max_depth=3))
    return L.Bundle(model, SEQ, {c: 3.0 for c in SEQ})


def requests(spark):
    return spark.createDataFrame(
        [("r1", "g1", "AU" * 60, None), ("r2", "g2", "GGACU" * 30, "MKP"), ("r3", "g3", "AUG", None),
         ("r4", "g4", None, None)],
        "request_id string, gene_id string, mrna_seq string, protein_seq string")


def test_batch_scoring_isolates_errors(spark, bundle):
    out = {r.request_id: r for r in L.score_batch(requests(spark), bundle).collect()}
    assert [out[k].status for k in sorted(out)] == ["ok", "ok", "error", "error"]
    ok = out["r1"]
    assert 0 <= ok.prob_pos <= 1 and ok.prediction in ("enriched", "not_enriched")
    assert ok.imputed_features == ["rmsf_mean"] and len(ok.top_features) == 4
    assert out["r3"].error == "mrna_seq has 3 characters, needs 50" and out["r3"].prob_pos is None
    assert out["r1"].prediction != out["r2"].prediction


def test_bundle_roundtrip(spark, bundle):
    path = f"{checkpoint_dir(spark)}/bundle"
    L.save_bundle(bundle, path, spark)
    again = L.load_bundle(path, spark)
    assert again.features == bundle.features and again.medians == bundle.medians
    a = {r.request_id: r.prob_pos for r in L.score_batch(requests(spark), bundle, False).collect()}
    b = {r.request_id: r.prob_pos for r in L.score_batch(requests(spark), again, False).collect()}
    assert a == b


def test_batch_size_limit(spark):
    df = spark.range(501).select(F.lit("big").alias("batch_id")).unionByName(
        spark.range(500).select(F.lit("fits").alias("batch_id")))
    assert [r.batch_id for r in L.oversized_batches(df).collect()] == ["big"]


def test_projection(data):
    _, filled, _ = data
    out = L.project_2d(filled, COLS)
    r = out.agg(F.var_samp("pc1"), F.var_samp("pc2"), F.corr("pc1", "pc2")).first()
    assert r[0] >= r[1] and abs(r[2]) < 1e-6


def test_few_partitions_are_dealt_before_a_fit(spark):
    df = spark.range(5000).selectExpr("id + 0.0 AS a", "sin(id) AS b", "CAST(id % 2 AS INT) AS class").coalesce(1)
    slots = spark.sparkContext.defaultParallelism
    assert dealt(df).rdd.getNumPartitions() == min(slots, 5)
    assert dealt(df, 6000).rdd.getNumPartitions() == 1  # too small to deal
    assert dealt(df.repartition(slots + 1)).rdd.getNumPartitions() == slots + 1
    assert sorted(dealt(df).select("a").collect()) == sorted(df.select("a").collect())
    model = L.fit_forest(df, ["a", "b"], params=ForestSettings(trees=2, max_depth=3))
    assert model.stages[-1].getCacheNodeIds()


def test_groups_of_trees_are_one_forest(spark, data, monkeypatch):
    _, filled, _ = data
    train = filled.where("split = 'train'")
    monkeypatch.setattr(L, "GROVE", 3)
    params = ForestSettings(trees=8, max_depth=6)
    model = L.fit_forest(train, COLS, params=params)
    forest = model.stages[-1]
    assert forest.getNumTrees == len(forest.trees) == 8
    assert len({t.toDebugString.split("\n", 1)[1] for t in forest.trees}) == 8  # groups draw their own rows
    path = f"{checkpoint_dir(spark)}/groups"
    L.save_bundle(L.Bundle(model, COLS, {c: 0.0 for c in COLS}), path, spark)
    again = L.fit_forest(train, COLS, params=params)  # a seed gives one forest
    want = [r.prob_pos for r in L.score(filled, model).orderBy("gene_id").collect()]
    for other in (again, L.load_bundle(path, spark).model):
        assert [r.prob_pos for r in L.score(filled, other).orderBy("gene_id").collect()] == want
    # The score is the mean of the trees.
    rows = model.stages[0].transform(filled).select("gene_id", "vector").orderBy("gene_id").limit(5).collect()
    for r, p in zip(rows, want):
        votes = [t.predictProbability(r.vector)[1] for t in forest.trees]
        assert p == pytest.approx(sum(votes) / 8)


def test_parts_depend_on_rows_alone(spark):
    df = spark.range(5000)
    assert parted(df).rdd.getNumPartitions() == 1 and parted(df, 1000).rdd.getNumPartitions() == 5
    assert parted(df.repartition(3), 2000).rdd.getNumPartitions() == 3
    assert parted(df.limit(0)).rdd.getNumPartitions() == 1


def test_metrics_do_not_score_again(spark, data, forest):
    """The plan of a report reads stored scores: the model is in it no more."""
    df, _, _ = data
    out = classification_report(df.where("split = 'train'"), df.where("split = 'test'"), forest, COLS)
    assert out.count() == 2 and "UDF" not in out._jdf.queryExecution().logical().toString()


def test_forests_make_no_object_for_each_tree(spark, data, monkeypatch):
    """Neither a fit nor a load nor a score lists the trees in Python, and scores are those of Spark."""
    from pyspark.ml import classification
    from pyspark.ml.functions import vector_to_array

    made = []
    build = classification.DecisionTreeClassificationModel.__init__
    monkeypatch.setattr(
        classification.DecisionTreeClassificationModel, "__init__",
        lambda self, java=None: (made.append(1), build(self, java))[1],
    )
    monkeypatch.setattr(L, "GROVE", 4)
    monkeypatch.setattr(R, "SAVED", 3)
    _, filled, _ = data
    model = L.fit_forest(filled.where("split = 'train'"), COLS, params=ForestSettings(trees=8, max_depth=30))
    path = f"{checkpoint_dir(spark)}/quiet"
    L.save_bundle(L.Bundle(model, COLS, {c: 0.0 for c in COLS}), path, spark)
    again = L.load_bundle(path, spark).model
    out = L.score(L.score(filled, model), again, "again")
    assert not made
    want = model.transform(filled).select("gene_id", vector_to_array("probability")[1].alias("want"))
    rows = out.join(want, "gene_id").select("prob_pos", "again", "want").collect()
    assert len(rows) == 400 and all(r.prob_pos == r.again == r.want for r in rows)
    with pytest.raises(Exception, match="impute first"):
        L.score(filled.withColumn("b", F.lit(None).cast("double")), model).collect()


def test_rows_meet_the_leaves_of_all_trees(spark, data):
    """Sums over leaves by blocks are the forest's score; each row lies in one leaf of each tree."""
    _, filled, _ = data
    model = L.fit_forest(filled.where("split = 'train'"), COLS, params=ForestSettings(trees=9, max_depth=30))
    leaves = X.leaf_table(X.node_table(model.stages[-1], spark)).cache()
    rows = L.score(filled, model)
    out = X.forest_leaf_sums(rows, leaves, COLS, "gene_id", rows_per_block=150, trees_per_group=4)
    got = rows.join(out, F.col("gene_id") == F.col("key")).select("prob_pos", "total", "met").collect()
    assert len(got) == 400
    assert all(r.met == 9 and r.total / 9 == pytest.approx(r.prob_pos, abs=1e-12) for r in got)


def test_bounds_are_looked_up_once(data, monkeypatch):
    """Leaves with the same bounds share the rows inside, whether or not all can be kept."""
    rng = np.random.default_rng(3)
    x = rng.random((50, 14))
    leaves = []
    for k in (1, 3, 13, 13):
        f = [int(i) for i in rng.permutation(14)[:k]]
        leaves.append((rng.random(), f, [0.25] * k, [0.75] * k, list(rng.random(k))))
    want = X.attribute_rows(x, leaves)
    counts = []
    within = X._within
    monkeypatch.setattr(X, "_within", lambda c, held, *a: (counts.append(a in held), within(c, held, *a))[1])
    got = X.attribute_rows(x, leaves)
    assert np.array_equal(got[0], want[0]) and counts.count(False) <= 14 < len(counts)
    monkeypatch.setattr(X, "HELD", 2)
    assert np.array_equal(X.attribute_rows(x, leaves)[0], want[0])


def test_whole_trees_are_looked_up_by_pattern(spark, data, monkeypatch):
    """Few and many features on a path: the values are those of `attribute_rows`, which is not asked
    for paths of few features, and rows of several batches meet the leaves at once."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    x = rng.random((300, 14)).round(2)

    def grown(depth):
        leaves, todo = [], [({}, 0)]
        while todo:
            path, at = todo.pop()
            if at == depth or (at and rng.random() < 0.1):
                names = list(path)
                lo, hi, share = ([float(path[f][i]) for f in names] for i in range(3))
                leaves.append((float(rng.integers(0, 4) / 3), names, lo, hi, share))
                continue
            f, cut, z = int(rng.integers(14)), round(float(rng.random()), 2), float(rng.random())
            lo, hi, share = path.get(f, (-np.inf, np.inf, 1.0))
            todo += [({**path, f: (lo, min(hi, cut), share * z)}, at + 1), ({**path, f: (max(lo, cut), hi, share * (1 - z))}, at + 1)]
        return leaves

    leaves = grown(4) + grown(9) + grown(1)
    # A chain of 14 features: its leaves have up to 14 on their path.
    for k in range(14):
        path = [(f, 0.05, np.inf, 0.9) for f in range(k)] + [(k, -np.inf, 0.05, 0.1)]
        leaves.append((float(k % 2), *map(list, zip(*path))))
    leaves.append((1.0, list(range(14)), [0.05] * 14, [np.inf] * 14, [0.9] * 14))
    table = pa.table(dict(zip(("value", "features", "low", "high", "share"), map(list, zip(*leaves)))))
    want = X.attribute_rows(x, leaves)[0]
    asked = []
    rows = X.attribute_rows
    monkeypatch.setattr(X, "attribute_rows", lambda x, some: (asked.append([len(leaf[1]) for leaf in some]), rows(x, some))[1])
    got = X.attribute_trees(x, X.flat_leaves(table))
    assert np.allclose(got, want, atol=1e-12)
    assert all(w > X.ALL_PATTERNS for some in asked for w in some) and sum(map(len, asked)) <= 4
    x[7, 3] = np.nan  # lies in no leaf
    assert np.allclose(X.attribute_trees(x, X.flat_leaves(table)), rows(x, leaves)[0], atol=1e-12)
    assert X.attribute_trees(x[:0], X.flat_leaves(table)).shape == (0, 14)
    assert not X.attribute_trees(x, X.flat_leaves(table.slice(0, 0))).any()
    parts = [pd.Series(range(i)) for i in (3, 4, 2)]
    assert [len(p) for p in X._many(iter(parts), 6)] == [7, 2]
