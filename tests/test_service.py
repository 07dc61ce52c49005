import os
import random
import subprocess
import time
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from condensq.operators import intervals as I
from condensq.operators import monitoring as M
from condensq.operators import ranking as R
from condensq.operators import registry as G
from condensq.streaming import dedupe as D
from condensq.streaming.metrics import latest_windows, write_updates

DAY = datetime(2024, 1, 1, tzinfo=timezone.utc)


# In flight -----------------------------------------------------------------------------------

@pytest.mark.parametrize("block", [4096, 3])
def test_in_flight_equals_counting(spark, block):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        s = DAY + timedelta(seconds=rng.choice([0, 15, 30, rng.uniform(0, 900)]))
        e = rng.choice([None, s, s - timedelta(seconds=3), *[s + timedelta(seconds=rng.choice([5, 15, 200.5]))] * 12])
        rows.append((rng.choice(["a", "b", None]), s, e))
    rows.append(("c", None, DAY))
    df = spark.createDataFrame(rows, "event_type string, start timestamp, end timestamp")
    got = {(r.event_type, r.t): (r.n_in_flight, r.peak)
           for r in M.in_flight(df, 15, block=block).withColumn("t", F.unix_seconds("tick")).collect()}
    real = [(k, s.timestamp(), e.timestamp() if e else float("inf")) for k, s, e in rows
            if s is not None and (e is None or e > s)]
    want = {}
    for kind in ("a", "b", None):
        own = [(s, e) for k, s, e in real if k == kind]
        ends = [x for p in own for x in p if x < float("inf")]
        first, last = (int(-(-f(ends) // 15)) for f in (min, max))
        for k in range(first, last + 1):
            t = 15 * k
            at = lambda m: sum(s <= m < e for s, e in own)
            moments = [s for s, _ in own if t - 15 < s <= t]
            want[kind, t] = (at(t), max([at(t - 15) if k > first else 0, *map(at, moments)]))
    assert got == want


def test_in_flight_without_requests(spark):
    df = spark.createDataFrame([], "event_type string, start timestamp, end timestamp")
    assert M.in_flight(df).collect() == []


# Sketches ------------------------------------------------------------------------------------

def _events(spark, n):
    return spark.range(n).select(
        F.timestamp_seconds(F.col("id") * 3 + 1704067200).alias("ts"),
        F.when(F.col("id") % 3 == 0, "predict").otherwise("lookup").alias("event_type"),
        F.when(F.col("id") % 50 > 0, (F.col("id") * 7919 % 100_003).cast("double")).alias("value"))


def test_merged_sketches_keep_their_error(spark):
    ev = _events(spark, 60_000).cache()
    merged = M.merge_sketches(M.merge_sketches(M.latency_sketches(ev, "1 minute", k=128), "1 hour", k=128), "30 days", k=128)
    values = ev.toPandas()
    for r in M.sketch_quantiles(merged, (0.1, 0.5, 0.99)).collect():
        own = values[values.event_type == r.event_type].value.dropna().to_numpy()
        assert r.n == len(own) and r.mean_latency == pytest.approx(own.mean())
        for p, q in ((0.1, r.p10), (0.5, r.p50), (0.99, r.p99)):
            assert abs((own <= q).mean() - p) <= 2 * M.rank_error(128)
    whole = M.merge_sketches(merged, "30 days", by=())
    r = M.share_at_most(whole, [50_000]).first()
    assert whole.count() == 1 and abs(r["up_to_50000"] - (values.value.dropna() <= 50_000).mean()) <= 2 * M.rank_error(128)


def test_sketches_of_few_or_no_values(spark):
    ev = spark.createDataFrame([(DAY, "a", 3.0), (DAY, "a", 1.0), (DAY, "a", None), (DAY, "b", None)],
                               "ts timestamp, event_type string, value double")
    got = {r.event_type: (r.n, r.mean_latency, r.p50, r.p99) for r in M.sketch_quantiles(M.latency_sketches(ev)).collect()}
    assert got == {"a": (2, 2.0, 1.0, 3.0), "b": (0, None, None, None)}


def test_streamed_sketches_merge(spark, tmp_path):
    ev = _events(spark, 3000)
    ev.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write_updates(M.latency_sketches(stream, "1 minute"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    cols = ["window_start", "event_type", "n", "p50", "p95", "p99"]
    got = M.sketch_quantiles(M.merge_sketches(latest_windows(spark, str(tmp_path / "out")), "1 day")).select(*cols)
    want = M.sketch_quantiles(M.latency_sketches(ev, "1 day")).select(*cols)  # below 4096 values: exact
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


# Each request once ---------------------------------------------------------------------------

def test_once_per_key_in_shuffled_order(spark, tmp_path):
    """Three copies of 400 requests arrive within 10 minutes of each other, in 12 micro-batches;
    then a file of old requests that are late."""
    rng = random.Random(2)
    rows = [(f"r{i}", DAY + timedelta(seconds=30 * i + k), i) for i in range(400) for k in range(3)]
    rows.sort(key=lambda r: r[1] + timedelta(seconds=rng.uniform(0, 600)))
    old = [(f"old{i}", DAY + timedelta(seconds=i), i) for i in range(7)] + [("r0", DAY, 0)]
    src = str(tmp_path / "in")
    schema = "request_id string, ts timestamp, v int"
    for k in range(12):
        spark.createDataFrame(rows[k * 100:(k + 1) * 100], schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
    spark.createDataFrame(old, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = D.once_per_key(stream, "request_id", "ts", "20 minutes")
    q = D.write_outcomes(out, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = D.read_outcomes(out, str(tmp_path / "out")).collect()
    assert len(got) == len(rows) + len(old)
    kept = sorted(r.request_id for r in got if r.outcome == "kept")
    assert kept == sorted(f"r{i}" for i in range(400))
    assert {r.request_id for r in got if r.outcome == "late"} == {r[0] for r in old}
    assert sum(r.outcome == "duplicate" for r in got) == 800
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) < 2 * 250 and held[-1] < max(held)  # an id and its timer for each of some 40 minutes


def test_once_per_key_without_ids_or_times(spark, tmp_path):
    rows = [("a", None), ("a", DAY), (None, DAY), (None, None), ("b", None)]
    spark.createDataFrame(rows, "request_id string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("request_id string, ts timestamp").parquet(str(tmp_path / "in"))
    out = D.once_per_key(stream)
    D.write_outcomes(out, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = D.read_outcomes(out, str(tmp_path / "out")).collect()
    assert sorted(((r.request_id or "", r.outcome) for r in got)) == [
        ("", "duplicate"), ("", "kept"), ("a", "duplicate"), ("a", "kept"), ("b", "kept")]


# Programs ------------------------------------------------------------------------------------

def test_a_program_that_never_ends_costs_its_chunk(spark):
    df = spark.createDataFrame([(str(i), "A" * (30 + i)) for i in range(8)], "key string, seq string").coalesce(1)

    def program(part, timeout):
        if any(k == "3" for k, _ in part):
            while True:
                time.sleep(60)
        if any(k == "5" for k, _ in part):
            os._exit(3)
        return {k: s for k, s in part}

    began = time.time()
    got = {r.key: r for r in G.run_external(df, program, chunk=2, timeout=1.5).collect()}
    assert time.time() - began < 30
    assert {k for k, r in got.items() if r.status == "computed"} == set("0167")
    assert {got[k].error for k in "23"} == {"timeout: over 1.5 seconds"}
    assert {got[k].error for k in "45"} == {"the process ended without an answer"}


def test_commands_and_what_they_start_end_at_the_limit(spark, tmp_path):
    df = spark.createDataFrame([("a", "A" * 30), ("b", "C" * 30)], "key string, seq string").coalesce(1)
    good = G.run_external(df, G.program(["awk", "-F\t", '{print $1 "\t" length($2)}']))
    assert sorted((r.key, r.output) for r in good.collect()) == [("a", "30"), ("b", "30")]
    bad = G.run_external(df, G.program(["sh", "-c", "echo no >&2; exit 4"])).collect()
    assert {(r.status, r.error) for r in bad} == {("failed", "RuntimeError: exit code 4: no")}
    mark = tmp_path / "mark"
    slow = G.run_external(df, G.program(["sh", "-c", f"sleep 3; touch {mark}"]), timeout=0.5).collect()
    assert {r.status for r in slow} == {"failed"}
    time.sleep(4)
    assert not mark.exists()  # the command's own children were ended too


def test_large_answers_pass(spark):
    df = spark.createDataFrame([("a", "A" * 3000)], "key string, seq string")
    assert len(G.run_external(df, lambda part, t: {k: s * 1000 for k, s in part}).first().output) == 3_000_000


def test_chunks_share_a_process_until_one_starts_programs(spark):
    df = spark.createDataFrame([(f"{i:02d}", "A" * 30) for i in range(12)], "key string, seq string").coalesce(1)

    def program(part, timeout):
        if part[0][0] in ("04", "08"):
            subprocess.run(["true"])
        if part[0][0] == "10":
            raise ValueError("no")
        return {k: str(os.getpid()) for k, _ in part}

    got = {r.key: r for r in G.run_external(df, program, chunk=1, timeout=20.0).collect()}
    pids = [got[f"{i:02d}"].output for i in range(12)]
    assert got["10"].error == "ValueError: no" and pids.pop(10) is None
    assert len(set(pids[:5])) == len(set(pids[5:9])) == len(set(pids[9:])) == 1
    assert len(set(pids)) == 3


# Intervals of any length ---------------------------------------------------------------------

@pytest.mark.parametrize("width", [1, 10, 1000])
def test_long_intervals_beside_short_ones(spark, rows, width):
    rng = random.Random(8)

    def make(n, base):
        return [(base + i, rng.choice(["x", None]), s, s + rng.choice([-1, 0, 3, 40, 900, 10**6, 10**9]))
                for i in range(n) for s in [rng.randint(-50, 3000)]]

    left, right = make(120, 0), make(120, 1000)
    a = spark.createDataFrame(left, "l int, g string, l_start long, l_end long")
    b = spark.createDataFrame(right, "r int, g string, r_start long, r_end long")
    want = sorted((x, y) for x, g, s, e in left for y, h, t, f in right if min(e, f) >= max(s, t))
    assert rows(I.interval_overlap(a.drop("g"), b.drop("g"), [], 1, width), "l", "r") == want
    if width == 1000:  # a hint that is wrong costs rows, not results
        near_a, near_b = a.where("l_end < 2000000").drop("g"), b.where("r_end < 2000000").drop("g")
        hinted = I.interval_overlap(near_a, near_b, [], 1, width, longest=4000)
        assert rows(hinted, "l", "r") == rows(I.interval_overlap(near_a, near_b, [], 1, width), "l", "r")
    keyed = sorted((x, y) for x, g, s, e in left for y, h, t, f in right if g == h == "x" and min(e, f) >= max(s, t))
    assert rows(I.interval_overlap(a, b, ["g"], 1, width), "l", "r") == keyed


def test_a_long_interval_costs_few_rows(spark):
    a = spark.createDataFrame([(0, 10**12)], "l_start long, l_end long")
    own = F.array(F.struct(I._level(F.col("l_start"), F.col("l_end"), 1000).alias("level"), F.lit(0).alias("side")))
    assert I._placed(a, F.col("l_start"), F.col("l_end"), 1000, own).count() <= 5


# Selection in rounds -------------------------------------------------------------------------

@pytest.mark.parametrize("small", [1, 50])
def test_quantiles_by_counting_rounds(spark, small):
    rng = np.random.default_rng(6)
    sides = [rng.lognormal(0, 20, 3000), rng.normal(0, 1e-3, 3000), np.repeat([0.0, -1.0, 7.0], 1000),
             np.ldexp(1.0, rng.integers(-1070, 1020, 3000)), np.full(3000, 5.0)]
    pdf_rows = [(("g" if i % 3 else None), *[float(s[i]) for s in sides]) for i in range(3000)]
    df = spark.createDataFrame(pdf_rows, "k string, a double, b double, c double, d double, e double")
    probs = (0.0, 0.123, 0.5, 0.999, 1.0)
    got = {(r.k, r.feature, r.prob): r.quantile
           for r in R.exact_quantiles(df, list("abcde"), probs, ["k"], bins=16 if small == 50 else 4096, small=small).collect()}
    for g in ("g", None):
        own = [r for r in pdf_rows if r[0] == g]
        for i, c in enumerate("abcde", 1):
            for p in probs:
                assert got[g, c, p] == pytest.approx(np.quantile([r[i] for r in own], p), rel=1e-9, abs=1e-300)


def test_quantiles_of_infinities_and_nan(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(v,) for v in (-inf, -inf, 1.0, 2.0, inf, nan, None)], "v double")
    got = [r.quantile for p in (0.0, 0.2, 0.4, 0.5, 0.6, 0.8) for r in R.exact_quantiles(df, ["v"], (p,)).collect()]
    assert got == [-inf, -inf, 1.0, 1.5, 2.0, inf]
    assert np.isnan(R.exact_quantiles(df, ["v"], (1.0,)).first().quantile)
    assert R.exact_quantiles(df.where("v IS NULL"), ["v"]).collect() == []


# State files and table functions -------------------------------------------------------------

def _state(n):
    return {f"k{i}": {"status": "failed" if i % 3 else "completed", "runtime_sec": i / 2, "host": f"h{i}", "tags": {"a": i}}
            for i in range(n)}


@pytest.mark.parametrize("indent", [None, 2])
def test_a_state_map_is_read_by_many_tasks(spark, tmp_path, indent):
    import json

    from condensq.sources import tables as T

    path = str(tmp_path / "s.json")
    with open(path, "w") as f:
        json.dump(_state(3000), f, indent=indent)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        pieces = spark.read.option("lineSep", "},").text(path)
        assert pieces.rdd.getNumPartitions() > 5
        got = {r.key: r for r in T.read_state(spark, [path]).withColumn("a", F.try_variant_get("entry", "$.tags.a", "int"))
               .withColumn("host", F.try_variant_get("entry", "$.host", "string")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {k: (r.status, r.runtime_sec, r.host, r.a) for k, r in got.items()} == {
        k: (v["status"], v["runtime_sec"], v["host"], v["tags"]["a"]) for k, v in _state(3000).items()}


@pytest.mark.parametrize("odd", [
    {"error": "bad },{ text", "status": "failed"}, {"tags": {"a": {"b": 1}}, "status": "failed"},
    {"status": "failed"}, {},
])
def test_odd_state_maps(spark, tmp_path, odd):
    import json

    from condensq.sources import tables as T

    for k, value in enumerate(({}, {"x": odd}, {"a": {"status": "completed"}, "x": odd, "z": {"status": "running"}})):
        path = str(tmp_path / f"{k}.json")
        with open(path, "w") as f:
            json.dump(value, f)
        got = {r.key: (r.status, r.error) for r in T.read_state(spark, [path]).collect()}
        assert got == {key: (v.get("status"), v.get("error")) for key, v in value.items()}


def test_chunks_by_table_function(spark):
    from condensq.operators import retrieval as P

    P.register_table_functions(spark)
    rng = random.Random(1)
    text = "".join(rng.choice(["word ", "longer word. ", "\n", "\n\n"]) for _ in range(900))
    spark.createDataFrame([(1, text), (2, "short"), (3, ""), (4, None), (5, "x" * 3000)], "doc_id int, text string").createOrReplaceTempView("udtf_docs")
    for mode in ("recursive", "fixed"):
        got = spark.sql(f"SELECT d.doc_id, c.* FROM udtf_docs d, LATERAL chunk_text(d.text, 500, 100, '{mode}') c").collect()
        want = P.chunk_text(spark.table("udtf_docs"), "doc_id", "text", 500, 100, mode).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 20


def test_passages_packed_by_partition(spark):
    from condensq.operators import retrieval as P

    P.register_table_functions(spark)
    rows = [(k, i, p) for k in ("a", "b") for i, p in enumerate(["xx", "yyy", None, "z" * 30, "w"])]
    spark.createDataFrame(rows[::-1], "k string, i int, passage string").createOrReplaceTempView("udtf_turns")
    got = spark.sql("SELECT * FROM pack_passages(TABLE(udtf_turns) PARTITION BY k ORDER BY (i), 8)").collect()
    want = [(0, 3, "xx\nyyy\n"), (1, 1, "z" * 30), (2, 1, "w")]
    assert sorted(map(tuple, got)) == [(k, *w) for k in ("a", "b") for w in want]
