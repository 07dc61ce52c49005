"""Work queues, registry, logs, drift, quality, request metrics, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from condensq.operators import aggregates as agg
from condensq.operators import monitoring as R
from condensq.operators import registry as G
from condensq.operators.structure import surface_proxy
from condensq.plans import star as S
from condensq.plans.catalog import query
from condensq.plans.catalog.evaluation import _RUNS
from condensq.plans.catalog.learning import request_bundle
from condensq.plans.star import STAR_SQL
from condensq.session import checkpoint_dir
from condensq.sources.records import parse_fold_lines
from condensq.streaming.metrics import latest_windows, stream_request_metrics, write_updates
from condensq.streaming.scoring import stream_scores, write_stream


def task_states(spark, d):
    """Events as state rows: user = task, event type = outcome."""
    e = S.table(spark, d, "events")
    kind = F.col("event_type")
    status = (
        F.when(kind.isin("purchase", "view"), "completed").when(kind == "error", "failed")
        .otherwise("running")
    )
    return e.select(
        F.col("user_id").cast("string").alias("key"), status.alias("status"),
        F.lit(0).cast("long").alias("n_conformations"), F.col("value").alias("runtime_sec"),
        F.when(kind == "error", F.concat(F.lit("code "), F.col("event_id") % 3)).alias("error"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
    )


def tasks(spark, d):
    return S.table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("key"), (F.col("c_nationkey") % 3 + 1).alias("tier")
    )


_STATE_SQL = """
WITH last AS (
  SELECT user_id::VARCHAR AS key, CASE WHEN event_type IN ('purchase', 'view') THEN 'completed'
           WHEN event_type = 'error' THEN 'failed' ELSE 'running' END AS status, value AS runtime_sec,
         CASE WHEN event_type = 'error' THEN 'code ' || event_id % 3 ELSE '' END AS error,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events),
st AS (SELECT * FROM last WHERE k = 1),
work AS (SELECT c_custkey::VARCHAR AS key, c_nationkey % 3 + 1 AS tier FROM customer)
"""


@query("resume_queue", _STATE_SQL + """
SELECT w.key, w.tier FROM work w LEFT JOIN st USING (key)
WHERE w.tier IN (1, 2) AND coalesce(st.status, '') <> 'completed'
  AND NOT (coalesce(st.status, '') = 'failed' AND NOT contains(st.error, 'code 1'))""")
def resume_queue(spark, d):
    return G.pending_work(
        tasks(spark, d), task_states(spark, d), retry_failed=True, error_like="code 1", tiers=[1, 2]
    )


@query("state_summary", _STATE_SQL + """
SELECT tier, count(*) AS n_tasks, count(*) FILTER (status = 'completed') AS n_completed,
       count(*) FILTER (status = 'failed') AS n_failed,
       count(*) FILTER (coalesce(status, '') <> 'completed') AS n_pending,
       round(avg(runtime_sec) FILTER (status = 'completed'), 6) AS mean_runtime
FROM work LEFT JOIN st USING (key) GROUP BY tier""")
def state_summary(spark, d):
    out = agg.state_summary(tasks(spark, d), G.latest_state(task_states(spark, d)))
    return out.withColumn("mean_runtime", F.round("mean_runtime", 6))


@query("log_mining", r"""
WITH l AS (SELECT event_id, event_id % 4 AS m, CASE event_id % 4
    WHEN 0 THEN 'start' || chr(10) || 'Filtered 100 samples down to ' || user_id || ' based on'
    WHEN 1 THEN 'Completed. Your samples are ready' WHEN 2 THEN 'Invalid suffix ''_unphysical.xtc'''
    ELSE 'killed' END AS log FROM events)
SELECT event_id, CASE WHEN m = 0 THEN regexp_extract(log, 'down to (\d+)', 1)::BIGINT
         WHEN m = 1 THEN -1 ELSE 0 END AS n_conformations,
       CASE m WHEN 2 THEN 'unphysical_filter_bug' WHEN 3 THEN 'exit_code=3' END AS error
FROM l""")
def log_mining(spark, d):
    k = F.col("event_id") % 4
    log = (
        F.when(k == 0, F.concat(F.lit("start\nFiltered 100 samples down to "), "user_id",
                                F.lit(" based on")))
        .when(k == 1, "Completed. Your samples are ready")
        .when(k == 2, "Invalid suffix '_unphysical.xtc'").otherwise("killed")
    )
    rows = S.table(spark, d, "events").select(
        "event_id", log.alias("log"), F.when(k > 1, k).otherwise(0).alias("exit_code")
    )
    return G.parse_run_logs(rows).select("event_id", "n_conformations", "error")


@query("run_registry", _RUNS.replace(" AS run, split, class", " AS run, 'all' AS split, class").replace(
    "SELECT 'flat', split,", "SELECT 'flat', 'all',").replace("SELECT 'au', split,", "SELECT 'au', 'all',") + """
SELECT run, TIMESTAMP '2024-01-31' AS ts, round(auroc, 6) AS auroc, round(f1_macro, 6) AS f1_macro FROM mt""")
def run_registry(spark, d):
    """Metric tables of several runs, logged and read back."""
    from condensq.operators.metrics import metric_table
    from condensq.plans.catalog.evaluation import runs

    path = f"{checkpoint_dir(spark)}/registry-{uuid.uuid4().hex}"
    # One row per run reaches the driver.
    for r in metric_table(runs(spark, d), ["run"]).collect():
        G.log_run(
            spark, path, r["run"], "2024-01-31", {"threshold": 0.5},
            {"auroc": r["auroc"], "f1_macro": r["f1_macro"]}, {"data": d.rsplit("/", 1)[-1]},
        )
    out = G.compare_runs(G.read_runs(spark, path), ["auroc", "f1_macro"])
    return out.select("run", F.col("ts").cast("timestamp_ntz").alias("ts"),
                      *[F.round(c, 6).alias(c) for c in ("auroc", "f1_macro")])


@query("external_stage", S.with_sql(S.SEQ_SQL) + """
SELECT gene_id AS key, CASE WHEN length(seq) BETWEEN 20 AND 3000 THEN
         CASE WHEN seq LIKE 'GGGG%' THEN 'failed' ELSE 'computed' END ELSE 'skipped' END AS status,
       CASE WHEN length(seq) BETWEEN 20 AND 3000 AND seq NOT LIKE 'GGGG%'
         THEN (length(seq) - length(replace(seq, 'G', '')))::BIGINT END AS n_g
FROM seqs""")
def external_stage(spark, d):
    """A stand-in program counts one letter; sequences it refuses must not harm the others."""

    def program(rows, timeout):
        return {k: str(s.count("G")) for k, s in rows if not s.startswith("GGGG")}

    s = S.sequences(spark, d).select(F.col("gene_id").alias("key"), "seq")
    out = G.run_external(s, program)
    return out.select("key", "status", F.col("output").cast("long").alias("n_g"))


@query("fold_lines", S.with_sql(S.SEQ_SQL) + r"""
, f AS (SELECT gene_id, translate(seq, 'ACGU', '(.).') AS s, (doc_id % 500) AS e FROM seqs
        WHERE length(seq) > 0)
SELECT gene_id, -(e / 10.0::DOUBLE) AS mfe, len(regexp_extract_all(s, '\([.]+\)')) AS n_stemloops,
       round_even((length(s) - length(translate(s, '()', '')))::DOUBLE / length(s), 4) AS frac_paired
FROM f WHERE e > 0""")
def fold_lines(spark, d):
    s = S.sequences(spark, d).where("length(seq) > 0 AND doc_id % 500 > 0")
    line = F.concat(
        F.translate("seq", "ACGU", "(.)."),
        F.format_string(" (%6.2f)", -(F.col("doc_id") % 500) / F.lit(10.0)),
    )
    out = parse_fold_lines(s.select("gene_id", line.alias("line")))
    return out.select("gene_id", "mfe", "n_stemloops", "frac_paired")


# Drift and quality ---------------------------------------------------------------------------

_SIDES = STAR_SQL + """, r AS (
  UNPIVOT (SELECT split, mrna_length::DOUBLE AS mrna_length, idr_percent, rmsf_mean FROM features
           JOIN genes USING (gene_id) WHERE split <> 'val')
  ON mrna_length, idr_percent, rmsf_mean INTO NAME feature VALUE v),
bd AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM r GROUP BY 1),
h AS (SELECT r.feature, least(floor((v - lo) / (hi - lo) * 10), 9) AS b,
             count(*) FILTER (split = 'train') AS r, count(*) FILTER (split = 'test') AS c
      FROM r JOIN bd USING (feature) GROUP BY 1, 2),
p AS (SELECT feature, r::DOUBLE / sum(r) OVER (PARTITION BY feature) AS p,
             c::DOUBLE / sum(c) OVER (PARTITION BY feature) AS q FROM h),
js AS (SELECT feature, round(sqrt(sum((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
         + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2)), 6) AS distance
       FROM p GROUP BY 1)
"""
_COLS = ["mrna_length", "idr_percent", "rmsf_mean"]


def _train_test(spark, d):
    f = S.features(spark, d).join(S.genes(spark, d), "gene_id")
    return f.where("split = 'train'"), f.where("split = 'test'")


@query("drift_js", _SIDES + "SELECT feature, distance, distance >= 0.1 AS drifted FROM js")
def drift_js(spark, d):
    ref, cur = _train_test(spark, d)
    return R.drift(ref, cur, _COLS)


@query("dataset_drift", _SIDES + """
SELECT count(*) AS n_features, count(*) FILTER (distance >= 0.1) AS n_drifted,
       round(avg((distance >= 0.1)::INTEGER), 4) AS share_drifted,
       avg((distance >= 0.1)::INTEGER) >= 0.5 AS dataset_drift FROM js""")
def dataset_drift(spark, d):
    ref, cur = _train_test(spark, d)
    return R.dataset_drift(R.drift(ref, cur, _COLS))


@query("drift_chi2", STAR_SQL + """, l AS (
  UNPIVOT (SELECT split, gene_name, condition FROM genes WHERE split <> 'val')
  ON gene_name, condition INTO NAME feature VALUE category),
n AS (SELECT feature, category, count(*) FILTER (split = 'train') AS r,
             count(*) FILTER (split = 'test') AS c FROM l GROUP BY 1, 2),
e AS (SELECT *, r * (sum(c) OVER w)::DOUBLE / (sum(r) OVER w) AS ex FROM n
      WINDOW w AS (PARTITION BY feature))
SELECT feature, round(sum(CASE WHEN ex > 0 THEN (c - ex)**2 / ex END), 6) AS chi2,
       count(*) AS n_categories, count(*) FILTER (r = 0) AS n_new_categories
FROM e GROUP BY 1""")
def drift_chi2(spark, d):
    ref, cur = _train_test(spark, d)
    return R.drift_categorical(ref, cur, ["gene_name", "condition"])


@query("quality_summary", """
WITH l AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount FROM lineitem)
           ON l_quantity, l_extendedprice, l_discount INTO NAME feature VALUE v)
SELECT feature, count(*) AS n, 0::BIGINT AS n_missing, min(v) AS min, max(v) AS max,
       round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std FROM l GROUP BY 1""")
def quality_summary(spark, d):
    out = R.quality_summary(
        S.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]
    )
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("duplicate_rows", """
SELECT count(*) - count(DISTINCT md5(text)) AS n_duplicates FROM documents""")
def duplicate_rows(spark, d):
    docs = S.documents(spark, d).select(F.md5("text").alias("digest"))
    return R.duplicate_rows(docs, ["digest"])


@query("share_of_total", """
SELECT p_brand, round(sum(p_retailprice), 4) AS total,
       round(sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part) * 100, 3) AS pct
FROM part GROUP BY 1""")
def share_of_total(spark, d):
    t = S.table(spark, d, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("total"))
    return agg.share_of_total(t, "total", "pct").withColumn("total", F.round("total", 4))


@query("surface_proxy", """
SELECT s_suppkey, round(4 * pi() * (s_acctbal / 1000) * (s_acctbal / 1000) / (s_nationkey + 1), 6)
       AS sasa FROM supplier""")
def surface(spark, d):
    rg = F.col("s_acctbal") / 1000
    return S.table(spark, d, "supplier").select(
        "s_suppkey", F.round(surface_proxy(rg, F.col("s_nationkey") + 1), 6).alias("sasa")
    )


# Requests ------------------------------------------------------------------------------------

@query("request_metrics", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n,
       round(avg(value), 6) AS mean_latency, count(*) FILTER (value <= 100) AS up_to_100
FROM events GROUP BY 1, 2""")
def request_metrics(spark, d):
    e = S.table(spark, d, "events")
    m = R.request_metrics(e, "1 hour")
    hist = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(
        F.count_if(F.col("value") <= 100).alias("up_to_100")
    ).select(F.col("w.start").alias("window_start"), "event_type", "up_to_100")
    out = m.join(hist, ["window_start", "event_type"])
    return out.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n",
        F.round("mean_latency", 6).alias("mean_latency"), "up_to_100",
    )


@query("latency_histogram", """
SELECT event_type, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 50) AS le_50,
       count(*) FILTER (value <= 100) AS le_100, count(*) AS n, round(sum(value), 4) AS total
FROM events GROUP BY 1""")
def latency_histogram(spark, d):
    out = R.latency_histogram(S.table(spark, d, "events"), [10, 50, 100])
    return out.withColumn("total", F.round("total", 4))


def _stream(spark, d, name):
    """The files of a table as a stream; the pattern fits a single file and a folder of files."""
    path = f"{d}/{name}.parque[t]"
    return spark.readStream.schema(S.table(spark, d, name).schema).parquet(path)


def _run(spark, df):
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    write_stream(df, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


@query("streaming_metrics", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n,
       round(avg(value), 6) AS mean_latency
FROM events GROUP BY 1, 2""")
def streaming_metrics(spark, d):
    events = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    write_updates(
        stream_request_metrics(events, "1 hour"), f"{base}/out", f"{base}/state"
    ).awaitTermination()
    return latest_windows(spark, f"{base}/out").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n",
        F.round("mean_latency", 6).alias("mean_latency"),
    )


@query("streaming_scores")
def streaming_scores(spark, d):
    docs = _stream(spark, d, "documents")
    seq = F.regexp_replace(F.upper("text"), "[^ACGTU]+", "")
    req = docs.select(
        F.col("doc_id").cast("string").alias("request_id"),
        S.locus(F.col("doc_id")).alias("gene_id"), seq.alias("mrna_seq"),
        F.lit(None).cast("string").alias("protein_seq"),
    )
    return _run(spark, stream_scores(req, request_bundle(spark, d), explain=False))
