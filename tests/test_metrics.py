import random

import pytest
from pyspark.sql import functions as F

from condensq.operators import metrics as M
from condensq.operators import splits as K

# Rows of a published threshold curve (threshold, f1_macro, f1_pos, f1_neg,
# precision, recall, tn, fp, fn, tp).
CURVE = [
    (0.30, 0.5703532136653156, 0.7770700636942676, 0.36363636363636365, 0.6455026455026455, 0.976, 20, 67, 3, 122),
    (0.54, 0.7289772727272728, 0.7954545454545454, 0.6625, 0.7553956834532374, 0.84, 53, 34, 20, 105),
    (0.56, 0.746998946998947, 0.803088803088803, 0.6909090909090909, 0.7761194029850746, 0.832, 57, 30, 21, 104),
]
# Fixed values end.


def test_rates_reproduce_the_published_curve(spark):
    df = spark.createDataFrame([(t, *c) for t, *_, a, b, d, e in CURVE for c in [(a, b, d, e)]],
                               "threshold double, tn long, fp long, fn long, tp long")
    for r, want in zip(M.rates(df).orderBy("threshold").collect(), CURVE):
        assert (r.f1_macro, r.f1_pos, r.f1_neg, r.precision, r.recall) == pytest.approx(want[1:6])
    best = M.best_threshold(M.rates(df), min_f1_pos=0.75).first()
    assert best.best_threshold == 0.56 and best.constrained_threshold == 0.56


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(9)
    data = []
    for i in range(600):
        y = int(rng.random() < 0.4)
        # A third of the rows share one score.
        p = 0.5 if i % 3 == 0 else round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.2))), 2)
        data.append((f"g{i}", y, "val" if i % 2 else "test", p))
    return data, spark.createDataFrame(data, "gene_id string, class int, split string, prob_pos double").cache()


def naive_auc(rows):
    pos = [p for _, y, _, p in rows if y]
    neg = [p for _, y, _, p in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)


def naive_ap(rows):
    n_pos = sum(y for _, y, _, _ in rows)
    ap, last = 0.0, 0.0
    for t in sorted({p for *_, p in rows}, reverse=True):
        kept = [y for _, y, _, p in rows if p >= t]
        recall = sum(kept) / n_pos
        ap += (recall - last) * sum(kept) / len(kept)
        last = recall
    return ap


def test_areas_match_all_pairs(scored):
    data, df = scored
    for r in M.areas(df, ["split"]).collect():
        part = [x for x in data if x[2] == r.split]
        assert r.auroc == pytest.approx(naive_auc(part)) and r.auprc == pytest.approx(naive_ap(part))


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "class int, prob_pos double")
    assert M.auroc(df).first().auroc is None
    assert all(r.fpr is None and r.tpr > 0 for r in M.roc_points(df).collect())
    neg = df.withColumn("class", F.lit(0))
    assert M.average_precision(neg).first().auprc == 0.0
    assert {r.recall for r in M.pr_points(neg).collect()} == {1.0}


def test_sweep_equals_single_thresholds(scored):
    _, df = scored
    sweep = {round(r.threshold * 100): r for r in M.threshold_sweep(df).collect()}
    assert len(sweep) == 41
    for t in (30, 50, 55, 70):
        one = M.class_metrics(df, t / 100).first()
        assert all(sweep[t][c] == one[c] for c in ("tn", "fp", "fn", "tp", "f1_macro"))


def test_curves_end_at_one(scored):
    _, df = scored
    roc = M.roc_points(df).orderBy("threshold").first()
    assert (roc.fpr, roc.tpr) == (1.0, 1.0)
    pr = M.pr_points(df, ["split"]).where("split = 'val'").orderBy("threshold").first()
    assert pr.recall == 1.0


def test_calibration_and_brier(scored):
    data, df = scored
    bins = M.calibration_curve(df).collect()
    assert sum(b.n for b in bins) == len(data) and all(0 <= b.bin <= 9 for b in bins)
    want = sum((p - y) ** 2 for _, y, _, p in data) / len(data)
    assert M.brier(df).first().brier == pytest.approx(want)


def test_undefined_rates_are_zero(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "class int, prob_pos double")
    r = M.class_metrics(df).first()
    assert (r.f1_pos, r.precision, r.recall) == (0.0, 0.0, 0.0) and r.f1_neg == 1.0


def test_impact_and_ranks(spark, rows):
    b = spark.createDataFrame([("m", 0.5, 0.4)], "run string, auroc double, auprc double")
    a = spark.createDataFrame([("m", 0.7, 0.1)], "run string, auroc double, auprc double")
    got = M.impact_table(b, a, ["run"], ["auroc", "auprc"])
    assert [(r.metric, round(r.delta, 6)) for r in got.orderBy("metric").collect()] == [
        ("auprc", -0.3), ("auroc", 0.2)]
    r1 = spark.createDataFrame([("x", 1), ("y", 2), ("gone", 3)], "feature string, rank int")
    r2 = spark.createDataFrame([("y", 1), ("x", 2), ("fresh", 3)], "feature string, rank int")
    assert sorted((r.feature, r["shift"], r.status) for r in M.rank_shift(r1, r2).collect()) == [
        ("fresh", None, "NEW"), ("gone", None, "DROPPED"), ("x", -1, "down"), ("y", 1, "up")]


def test_suspicious_and_curated(spark):
    df = spark.createDataFrame([("a", 0, 0.4, 0), ("b", 0, 0.5, 1), ("c", 1, 0.45, 0), ("d", 0, 0.9, 1)],
                               "gene_id string, class int, prob_pos double, pred int")
    assert {r.gene_id for r in M.suspicious_labels(df).collect()} == {"a", "b"}
    ids = spark.createDataFrame([("a",), ("c",), ("zz",)], "gene_id string")
    r = M.curated_check(df, ids).first()
    assert (r.n, r.n_correct, r.accuracy) == (2, 1, 0.5)
    assert [x.gene_id for x in M.curated_misses(df, ids).collect()] == ["c"]


# Splits --------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def clustered(spark):
    # One cluster holds a third of the rows.
    return spark.range(900).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 3 == 0, "big").otherwise((F.col("id") % 120).cast("string")).alias("cl"),
        F.when(F.col("id") % 7 == 0, -1).otherwise(F.col("id") % 2).cast("int").alias("class"),
    ).cache()


def test_clusters_stay_whole(clustered):
    out = K.cluster_split(clustered, "cl", "class", "k")
    assert out.count() == 900 and K.leakage_audit(out, "cl").isEmpty()
    assert {r.split for r in out.select("split").distinct().collect()} == {"train", "val", "test"}


def test_split_sizes_per_class(clustered):
    out = K.random_split(clustered, "k", "class")
    n = {(r["class"], r.split): r["count"] for r in out.groupBy("class", "split").count().collect()}
    for c in (0, 1):
        total = sum(v for (k, _), v in n.items() if k == c)
        assert n[c, "train"] == int(total * 0.7) and n[c, "val"] == int(total * 0.15)
    assert (-1, "test") not in n and (-1, "val") not in n


def test_split_keeps_rows_without_or_with_repeated_keys(spark):
    rows = [(None, 0, "a"), (None, 0, "b"), ("x", 0, "c"), ("x", 0, "d"), ("y", None, "e"), ("z", 1, "f")]
    out = K.random_split(spark.createDataFrame(rows, "k string, class int, v string"), "k", "class")
    assert sorted(r.v for r in out.collect()) == ["a", "b", "c", "d", "e", "f"]


def test_folds_are_even_and_stratified(clustered):
    out = K.kfold(clustered, "k", "class")
    for c in (0, 1):
        sizes = [r["count"] for r in out.where(F.col("class") == c).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_audit_finds_a_leak(spark):
    df = spark.createDataFrame([("c", "train", "t"), ("c", "test", "t"), ("d", "val", "u")],
                               "cl string, split string, text string")
    assert [r.cl for r in K.leakage_audit(df, "cl").collect()] == ["c"]
    assert K.copies_across_splits(df, "text").count() == 1


def test_sample_is_repeatable(clustered, rows):
    a = rows(K.seeded_sample(clustered, "k", 50), "k")
    assert len(set(a)) == 50 and a == rows(K.seeded_sample(clustered.repartition(7), "k", 50), "k")
    assert K.current_batch(clustered, "k", None).count() == 900
