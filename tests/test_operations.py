import pytest
from pyspark.sql import functions as F

from condensq.config import Settings
from condensq.operators import aggregates as A
from condensq.operators import monitoring as M
from condensq.operators import registry as G
from condensq.operators.models import Bundle, fit_forest, impute
from condensq.schemas import SCORE_REQUEST, TASK_STATE
from condensq.session import cut_lineage, fits, spread
from condensq.streaming.metrics import latest_windows, stream_request_metrics, write_updates
from condensq.streaming.scoring import stream_scores, write_stream


def test_registry_appends_and_compares(spark, tmp_path, rows):
    path = str(tmp_path / "runs")
    G.log_run(spark, path, "a", "2024-04-07", {"trees": 500}, {"auroc": 0.7, "auprc": None}, {"phase": "1"})
    G.log_run(spark, path, "b", "2024-04-08", {"trees": 10, "lr": 0.1}, {"auroc": 0.8, "f1": 0.5}, {})
    runs = G.read_runs(spark, path)
    assert rows(G.compare_runs(runs, ["auroc", "f1"]), "run", "auroc") == [("a", 0.7), ("b", 0.8)]
    assert G.metrics_long(runs).count() == 3
    assert runs.where("params['lr'] = '0.1'").first().run == "b"


STATE = [("k1", "failed", 0, 1.0, "oom", "1"), ("k1", "completed", 9, 2.0, None, "2"),
         ("k2", "failed", 0, 1.0, "filter bug", "1"), ("k3", "failed", 0, 1.0, "oom", "1"),
         ("k4", "running", 0, 1.0, None, "1")]


@pytest.fixture
def queue(spark):
    work = spark.createDataFrame([(f"k{i}", 1 + i % 2) for i in range(1, 7)], "key string, tier int")
    return work, spark.createDataFrame(STATE, TASK_STATE)


def test_pending_work(queue, rows):
    work, state = queue
    keys = lambda **kw: [r[0] for r in rows(G.pending_work(work, state, **kw), "key")]
    assert keys() == ["k4", "k5", "k6"]
    assert keys(retry_failed=True) == ["k2", "k3", "k4", "k5", "k6"]
    assert keys(retry_failed=True, error_like="bug") == ["k2", "k4", "k5", "k6"]
    assert keys(tiers=[1]) == ["k4", "k6"] and keys(limit=4) == ["k4"]


def test_queue_drains(spark, queue):
    work, state = queue
    todo = G.pending_work(work, state)
    results = todo.select("key", F.lit(3).alias("n_conformations"), F.lit(0.1).alias("runtime_sec"),
                          F.lit(None).cast("string").alias("error"))
    state = state.unionByName(G.state_rows(results, "9"))
    assert G.pending_work(work, state).isEmpty()
    r = {x.tier: x for x in A.state_summary(work, G.latest_state(state)).collect()}
    assert r[1].n_tasks == 3 and r[1].n_completed + r[2].n_completed == 4


def test_external_program_failures_stay_local(spark):
    df = spark.createDataFrame([(str(i), "A" * n) for i, n in enumerate([5, 30, 31, 32, 4000, 33])] + [("x", None)],
                               "key string, seq string").coalesce(1)

    def program(chunk, timeout):
        if any(len(s) == 31 for _, s in chunk):
            raise TimeoutError("too slow")
        return {k: str(len(s)) for k, s in chunk if len(s) != 33}

    got = {r.key: r for r in G.run_external(df, program, chunk=2).collect()}
    assert len(got) == 7
    assert {k: r.status for k, r in got.items()} == {
        "0": "skipped", "1": "failed", "2": "failed", "3": "computed", "4": "skipped", "5": "failed", "x": "skipped"}
    assert got["1"].error == "TimeoutError: too slow" and got["5"].error == "no output"


def test_logs(spark):
    df = spark.createDataFrame(
        [("Filtered 100 samples down to 22 based on structure", 0), ("Completed. Done", 0), ("", 0), (None, 3),
         ("Invalid suffix '_unphysical.xtc'", 1)], "log string, exit_code int")
    got = [(r.n_conformations, r.error) for r in G.parse_run_logs(df).collect()]
    assert got == [(22, None), (-1, None), (0, None), (0, "exit_code=3"), (0, "unphysical_filter_bug")]


def test_drift(spark):
    ref = spark.range(1000).select((F.col("id") % 100).cast("double").alias("a"), (F.col("id") % 50).alias("b"),
                                   F.lit(1.0).alias("c"))
    cur = ref.select((F.col("a") * 0.2).alias("a"), "b", "c")
    got = {r.feature: r for r in M.drift(ref, cur, ["a", "b", "c"]).collect()}
    assert got["a"].drifted and not got["b"].drifted and got["b"].distance == 0.0 and got["c"].distance == 0.0
    total = M.dataset_drift(M.drift(ref, cur, ["a", "b", "c"])).first()
    assert (total.n_features, total.n_drifted, total.dataset_drift) == (3, 1, False)


def test_categorical_drift(spark):
    ref = spark.createDataFrame([("x",)] * 6 + [("y",)] * 4 + [(None,)] * 2, "k string")
    cur = spark.createDataFrame([("x",)] * 3 + [("z",)] * 3, "k string")
    r = M.drift_categorical(ref, cur, ["k"]).first()
    assert r.chi2 == pytest.approx(0 + 2 + 1) and r.n_categories == 4 and r.n_new_categories == 1


def test_quality(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (3.0,)], "a double")
    r = M.quality_summary(df, ["a"]).first()
    assert (r.n, r.n_missing, r["min"], r["max"]) == (4, 1, 1.0, 3.0)
    assert M.duplicate_rows(df, ["a"]).first()[0] == 1


def test_group_summaries(spark, rows):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 0, 2.0), ("b", 1, None), ("b", 1, 6.0)], "g string, class int, v double")
    assert rows(A.contingency(df, "g", "class")) == [("a", 1, 1), ("b", 0, 2)]
    d = {r.g: r for r in A.describe_by(df, ["g"], ["v"]).collect()}
    assert d["a"].median == 1.5 and d["b"].n == 1 and d["b"].std is None
    sep = A.class_separation(df.withColumn("z", F.lit(0.0)), ["v", "z"])
    assert {r.feature: r.ratio for r in sep.collect()} == {"v": 1.75, "z": float("inf")}
    w = {r["class"]: r.weight for r in A.class_weights(df).collect()}
    assert w == {0: 2.0, 1: 4 / 6}
    assert {r["class"]: r.weight for r in A.class_weights(df, mode="ratio").collect()} == {0: 1.0, 1: 1 / 3}
    ties = spark.createDataFrame([("c", 0, 5), ("c", 1, 2), ("d", 1, 1), ("d", 1, 9), ("d", 0, 0)], "cl string, y int, o int")
    assert rows(A.majority_class(ties, "cl", "y", "o")) == [("c", 1, 2), ("d", 1, 3)]
    assert A.column_digest(df, ["v"]).first().n_missing == 1
    assert A.distinct_count(df, "g", approx=True).first()[0] == 2


def test_stream_metrics_equal_the_batch(spark, tmp_path, rows):
    ev = spark.range(400).select(
        F.timestamp_seconds(F.col("id") * 3 + 1704067200).alias("ts"),
        F.when(F.col("id") % 3 == 0, "predict").otherwise("lookup").alias("event_type"),
        (F.col("id") % 17).cast("double").alias("value"))
    src = str(tmp_path / "in")
    ev.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = stream_request_metrics(stream, "1 minute")
    write_updates(out, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = latest_windows(spark, str(tmp_path / "out"))
    batch = M.request_metrics(ev, "1 minute")
    cols = ("window_start", "event_type", "n", "mean_latency")
    assert rows(got, *cols) == rows(batch, *cols) and got.count() > 30


def test_stream_scores_count_a_request_once(spark, tmp_path):
    cols = ["mrna_length", "au_content"]
    train = spark.createDataFrame([(float(50 + i), i / 40, i % 2) for i in range(40)],
                                  "mrna_length double, au_content double, class int")
    bundle = Bundle(fit_forest(impute(train, {}), cols, params=Settings().forest.__class__(trees=3, max_depth=2)),
                    cols, dict.fromkeys(cols, 0.0))
    req = spark.createDataFrame([("r1", 0, "g", "AU" * 40, None), ("r1", 5, "g", "AU" * 40, None),
                                 ("r2", 9, "g", "AU", None)],
                                "request_id string, s long, gene_id string, mrna_seq string, protein_seq string")
    req = req.select("request_id", F.timestamp_seconds("s").alias("ts"), "gene_id", "mrna_seq", "protein_seq")
    req.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCORE_REQUEST).parquet(str(tmp_path / "in"))
    write_stream(stream_scores(stream, bundle), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.request_id: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"r1": "ok", "r2": "error"}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_stream_scores_lose_no_request_in_any_order(spark, tmp_path):
    cols = ["mrna_length", "au_content"]
    train = spark.createDataFrame([(float(50 + i), i / 40, i % 2) for i in range(40)],
                                  "mrna_length double, au_content double, class int")
    bundle = Bundle(fit_forest(impute(train, {}), cols, params=Settings().forest.__class__(trees=3, max_depth=2)),
                    cols, dict.fromkeys(cols, 0.0))
    req = spark.range(400).select(
        F.col("id").cast("string").alias("request_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"),
        F.lit("g").alias("gene_id"), F.repeat(F.lit("AU"), 40).alias("mrna_seq"),
        F.lit(None).cast("string").alias("protein_seq"))
    src = str(tmp_path / "in")
    for start in (300, 200, 100, 0):  # latest first
        req.where((F.col("request_id").cast("int") >= start) & (F.col("request_id").cast("int") < start + 100)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCORE_REQUEST).option("maxFilesPerTrigger", 1).parquet(src)
    write_stream(stream_scores(stream, bundle, explain=False), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("request_id").distinct().count() == 400


def test_histogram(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 10.0), ("a", 70.0)], "event_type string, value double")
    r = M.latency_histogram(df, [5, 10, 50]).first()
    assert (r.le_5, r.le_10, r.le_50, r.n, r.total) == (1, 2, 2, 3, 85.0)


def test_session_helpers(spark):
    df = spark.range(10)
    assert cut_lineage(df).count() == 10
    assert fits(df, 10) and not fits(df, 9)
    few = df.coalesce(1)
    assert spread(few, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
