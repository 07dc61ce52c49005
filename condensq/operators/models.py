"""Training, calibration and scoring with pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassificationModel,
)
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condensq.config import BoostSettings, ForestSettings
from condensq.functions.arrays import contributions, imputed_names, top_features_map
from condensq.functions.labels import confidence, decide, label_text
from condensq.functions.sequence import compute_features
from condensq.operators.aggregates import class_weights, weighted
from condensq.operators.forests import (
    Forest,
    ForestClassifier,
    forest_probability,
    grow_forest,
    one_forest,
    save_model,
    stored_forest,
    stored_metadata,
)
from condensq.operators.growing import Rows, binned
from condensq.operators.metrics import class_metrics
from condensq.operators.ranking import exact_quantiles
from condensq.operators.splits import kfold
from condensq.session import checkpoint_dir, cut_lineage, fits, parted

MIN_SEQUENCE = 50
MAX_BATCH = 500
GROVE = 63  # trees that grow together
GROWN = 1_000_000  # training rows up to which tasks grow whole trees; the driver bins them


# Imputation ----------------------------------------------------------------------------------

def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact median per feature, one number each, so the driver holds no data."""
    rows = exact_quantiles(df, cols).select("feature", "quantile").collect()
    found = {r["feature"]: float(r["quantile"]) for r in rows}
    return {c: found.get(c, 0.0) for c in cols}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns(
        {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(m))
         for c, m in medians.items()}
    )


def imputation_policy(
    df: DataFrame, cols: Sequence[str], policy: str = "train"
) -> tuple[DataFrame, dict[str, float]]:
    """`train`: medians of the training rows; `all`: of every row; `none`: 0 and an indicator."""
    if policy == "none":
        flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c in cols}
        return impute(df.withColumns(flags), {c: 0.0 for c in cols}), {c: 0.0 for c in cols}
    fit_on = df if policy == "all" else df.where("split = 'train'")
    medians = fit_medians(fit_on, cols)
    return impute(df, medians), medians


# Training ------------------------------------------------------------------------------------

def _assembler(cols: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol="vector", handleInvalid="error")


def fit_forest(
    df: DataFrame, cols: Sequence[str], label: str = "class",
    params: ForestSettings | None = None, weights: DataFrame | None = None,
) -> PipelineModel:
    """Random forest with balanced class weights unless others are given.

    Trees grow in tasks, each on all training rows as bins (`growing`), which take a byte a number; more
    than `GROWN` rows, and what is no case of two classes with a weight each, go to Spark's own fit.
    Neither slots nor partitions decide what a seed gives.
    """
    p = params or ForestSettings()
    spark = df.sparkSession
    train = weighted(df, weights if weights is not None else class_weights(df, label), label)
    train = train.select(*cols, F.col(label).cast("double").alias(label), "weight").persist()
    assembler = _assembler(cols)
    classifier = ForestClassifier(
        # Rows remember the node they reached in each tree, so tasks need not be sent the growing trees.
        featuresCol="vector", labelCol=label, weightCol="weight", numTrees=p.trees, maxDepth=p.max_depth,
        minInstancesPerNode=p.min_leaf, featureSubsetStrategy=p.feature_subset, seed=p.seed, cacheNodeIds=True,
    )
    try:
        rows = _training_rows(train, cols, label)
        if rows is not None:
            return PipelineModel([assembler, grow_forest(rows, p, classifier, spark)])
        return PipelineModel([assembler, _fit_by_spark(train, assembler, classifier, p)])
    finally:
        train.unpersist()


def _training_rows(train: DataFrame, cols: Sequence[str], label: str) -> Rows | None:
    """Bins of the training rows, if there are at most `GROWN` of two classes with a weight each."""
    numbers = [F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)]
    few = train.select(*numbers, F.col(label).alias("_label"), F.col("weight").cast("double").alias("_weight"))
    if not fits(few, GROWN):
        return None
    table = few.toArrow()
    held = [table.column(c).to_numpy() for c in table.column_names]
    x, y, w = np.column_stack(held[:-2]), held[-2], held[-1]
    classes, at = np.unique(y, return_index=True)
    if np.isnan(x).any() or not np.isin(classes, (0.0, 1.0)).all() or 1.0 not in classes:
        return None
    if not (w == w[at][np.searchsorted(classes, y)]).all():
        return None
    each = dict(zip(classes.tolist(), w[at].tolist()))
    return binned(x, y.astype(np.int64), (each.get(0.0, 1.0), each[1.0]))


def _fit_by_spark(train: DataFrame, assembler: VectorAssembler, classifier: ForestClassifier, p: ForestSettings) -> Forest:
    """Trees grow in groups of `GROVE`, as many at a time as there are slots: deep trees have small nodes,
    and each partition sends statistics of every node of a step, so few rows in many partitions cost
    more than they gain. Groups do not depend on the slots, so a seed gives the same forest anywhere.
    """
    spark = train.sparkSession
    rows = parted(train).persist()
    checkpoint_dir(spark)

    def grow(first: int) -> Forest:
        group = classifier.copy({
            classifier.numTrees: min(GROVE, p.trees - first), classifier.seed: p.seed + first * 1_000_003
        })
        return group.fit(assembler.transform(rows))

    try:
        rows.count()  # held before groups ask for it at once
        firsts = range(0, p.trees, GROVE)
        with ThreadPool(min(len(firsts), spark.sparkContext.defaultParallelism)) as pool:
            groves = pool.map(inheritable_thread_target(spark)(grow), firsts, chunksize=1)
    finally:
        rows.unpersist()
    return one_forest(groves)


def fit_boosting(
    df: DataFrame, cols: Sequence[str], label: str = "class", val_col: str = "is_val",
    params: BoostSettings | None = None,
) -> PipelineModel:
    """Boosted trees that stop once the validation rows no longer improve."""
    p = params or BoostSettings()
    train = weighted(df, class_weights(df.where(~F.col(val_col)), label, "ratio"), label)
    boost = GBTClassifier(
        featuresCol="vector", labelCol=label, weightCol="weight", maxIter=p.rounds,
        maxDepth=p.max_depth, stepSize=p.step, subsamplingRate=p.subsample,
        featureSubsetStrategy=p.feature_subset, minInstancesPerNode=p.min_leaf,
        validationIndicatorCol=val_col, validationTol=p.tolerance, seed=p.seed,
    )
    return Pipeline(stages=[_assembler(cols), boost]).fit(
        train.select(*cols, F.col(label).cast("double").alias(label), "weight", val_col)
    )


def fit_baseline(
    df: DataFrame, cols=("mrna_length", "cds_length"), label="class", params=None
) -> PipelineModel:
    """Two-feature forest that larger models must beat."""
    return fit_forest(df, list(cols), label, params)


def with_probability(df: DataFrame, model: PipelineModel, name: str) -> DataFrame:
    """Add the class-1 probability of a fitted pipeline."""
    assembler, last = model.stages[0], model.stages[-1]
    if isinstance(last, RandomForestClassificationModel) and last.numClasses == 2:
        return df.withColumn(name, forest_probability(last, assembler.getInputCols(), df.sparkSession))
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.drop("vector", "rawPrediction", "probability", "prediction")


def score(df: DataFrame, model: PipelineModel, prob: str = "prob_pos") -> DataFrame:
    """Add the class-1 probability, the decision and, with a class column, correctness."""
    out = with_probability(df, model, prob)
    out = out.withColumn("pred", decide(F.col(prob)))
    if "class" in df.columns:
        wrong = F.col("pred") != F.col("class")
        out = out.withColumns(
            {"correct": (~wrong).cast("int"), "pred_error": F.abs(F.col(prob) - F.col("class"))}
        )
    return out


def sweep_class_weight(
    train: DataFrame, val: DataFrame, cols: Sequence[str], label: str = "class",
    params: ForestSettings | None = None, negatives=(1.5, 2.0, 2.5),
) -> tuple[str, dict[str, float]]:
    """Best of balanced and fixed negative weights by macro F1 on the validation rows."""
    spark = train.sparkSession
    trials = {"balanced": class_weights(train, label)}
    for w in negatives:
        trials[f"neg={w}"] = spark.createDataFrame([(0, float(w)), (1, 1.0)], [label, "weight"])
    results = {}
    for name, weights in trials.items():
        model = fit_forest(train, cols, label, params, weights)
        row = class_metrics(score(val, model), label=label).select("f1_macro").first()
        results[name] = row["f1_macro"]
    return max(results, key=results.get), results


@dataclass
class CalibratedForest:
    """One forest and one sigmoid per fold; the score is their mean."""

    members: list[tuple[PipelineModel, float, float]]

    def transform(self, df: DataFrame, prob: str = "prob_pos") -> DataFrame:
        out = df
        parts = []
        for i, (model, slope, intercept) in enumerate(self.members):
            name = f"_p{i}"
            out = with_probability(out, model, name)
            parts.append(1.0 / (1.0 + F.exp(-(F.lit(slope) * F.col(name) + F.lit(intercept)))))
        mean = reduce(lambda a, b: a + b, parts) / len(parts)
        return out.withColumn(prob, mean).drop(*[f"_p{i}" for i in range(len(parts))])


def fit_calibrated(
    df: DataFrame, cols: Sequence[str], key: str, label: str = "class", k: int = 5,
    params: ForestSettings | None = None,
) -> CalibratedForest:
    """Refit per fold; fit the sigmoid on the rows each forest has not seen."""
    folded = parted(kfold(df, key, label, k)).persist()
    members = []
    for fold in range(k):
        model = fit_forest(folded.where(F.col("fold") != fold), cols, label, params)
        held = with_probability(folded.where(F.col("fold") == fold), model, "raw")
        # The sigmoid's fit reads the scores several times; the forest walks them once.
        held = cut_lineage(held.select("raw", F.col(label).cast("double").alias("label")))
        data = VectorAssembler(inputCols=["raw"], outputCol="features").transform(held)
        sig = LogisticRegression(maxIter=100).fit(data)
        members.append((model, float(sig.coefficients[0]), float(sig.intercept)))
    folded.unpersist()
    return CalibratedForest(members)


def project_2d(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Two principal components of the standardised features."""
    stages = [
        _assembler(cols),
        StandardScaler(inputCol="vector", outputCol="scaled", withMean=True, withStd=True),
        PCA(k=2, inputCol="scaled", outputCol="pcs"),
    ]
    out = Pipeline(stages=stages).fit(df).transform(df)
    pcs = vector_to_array("pcs")
    return out.select(*df.columns, pcs[0].alias("pc1"), pcs[1].alias("pc2"))


# Bundles and request scoring -----------------------------------------------------------------

@dataclass
class Bundle:
    """A fitted model with its feature order and medians."""

    model: PipelineModel
    features: list[str]
    medians: dict[str, float]

    @property
    def forest(self) -> RandomForestClassificationModel:
        return self.model.stages[-1]


def save_bundle(bundle: Bundle, path: str, spark) -> None:
    """The model as Spark saves a pipeline, and its medians. The nodes of a forest that tasks have grown
    are written by tasks; they need not come into being in the driver."""
    save_model(bundle.model, f"{path}/model", spark)
    rows = [(i, f, float(bundle.medians[f])) for i, f in enumerate(bundle.features)]
    spark.createDataFrame(rows, "ord int, feature string, median double").coalesce(
        1
    ).write.mode("overwrite").parquet(f"{path}/medians")


def load_bundle(path: str, spark) -> Bundle:
    rows = spark.read.parquet(f"{path}/medians").orderBy("ord").collect()
    first, second = stored_metadata(f"{path}/model", spark)["paramMap"]["stageUids"]
    assembler = VectorAssembler.load(f"{path}/model/stages/0_{first}")
    return Bundle(
        PipelineModel([assembler, stored_forest(f"{path}/model/stages/1_{second}", spark)]),
        [r["feature"] for r in rows],
        {r["feature"]: r["median"] for r in rows},
    )


def request_error(seq: Column) -> Column:
    """NULL for a scorable request, else what is wrong with it."""
    return (
        F.when(seq.isNull(), "mrna_seq is missing")
        .when(
            F.length(seq) < MIN_SEQUENCE,
            F.format_string("mrna_seq has %d characters, needs 50", F.length(seq)),
        )
    )


def validate_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scorable rows, error rows with a message)."""
    marked = df.withColumn("error", request_error(F.col("mrna_seq")))
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL")


def oversized_batches(df: DataFrame, batch: str = "batch_id", limit: int = MAX_BATCH) -> DataFrame:
    """Batches with more requests than a caller may send at once."""
    return df.groupBy(batch).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)


def score_requests(df: DataFrame, bundle: Bundle, explain: bool = True) -> DataFrame:
    """Features, imputation, probability, label, confidence, strongest features, imputed names."""
    from condensq.operators.explain import node_table, tree_attribution

    feats = compute_features(df).withColumn("imputed_features", imputed_names(bundle.features))
    filled = impute(feats, bundle.medians)
    scored = score(filled, bundle.model).drop("correct", "pred_error")
    out = scored.withColumns(
        {
            "prob_pos": F.bround("prob_pos", 6),
            "prediction": label_text(F.col("pred")),
            "confidence": confidence(F.col("prob_pos")),
        }
    )
    result = [*df.columns, "prob_pos", "prediction", "confidence", "imputed_features"]
    if not explain:
        return out.select(*result)
    out = tree_attribution(out, node_table(bundle.forest, df.sparkSession), bundle.features)
    items = contributions(
        {f: F.col(f) for f in bundle.features},
        {f: F.element_at("attributions", i + 1) for i, f in enumerate(bundle.features)},
    )
    return out.withColumn("top_features", top_features_map(items, 5)).select(
        *result, "top_features"
    )


def score_batch(df: DataFrame, bundle: Bundle, explain: bool = True) -> DataFrame:
    """Every request gives a row: scored with status `ok`, or an error row with its message.

    Count both by `status`, or with `DataFrame.observe` while the rows are written.
    """
    good, bad = validate_requests(df)
    scored = score_requests(good, bundle, explain).withColumn("status", F.lit("ok"))
    failed = bad.withColumn("status", F.lit("error"))
    return scored.unionByName(failed, allowMissingColumns=True)
