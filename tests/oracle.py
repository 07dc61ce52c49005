"""Run a catalog query and its SQL side by side. `python -m tests.oracle [names...]`"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session() -> SparkSession:
    from condensq.session import build_session

    return build_session(
        "condensq-tests",
        **{
            "spark.master": f"local[{os.environ.get('BENCH_CPUS', '8')}]",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "<null>"
    if hasattr(v, "item"):
        v = v.item()
        if v != v:
            return "<null>"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    return sorted(
        tuple(_cell(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False)
    )


def kinds(pdf: pd.DataFrame) -> dict[str, str]:
    out = {}
    for c in pdf.columns:
        vals = [v for v in pdf[c] if v is not None and v == v]
        kind = "none"
        if vals:
            v = vals[0]
            v = v.item() if hasattr(v, "item") else v
            kind = {"int": "number", "float": "number"}.get(type(v).__name__, type(v).__name__)
        out[c] = kind
    return out


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None if both sides agree, else what differs."""
    from condensq.plans.catalog import ORACLES, QUERIES

    df = QUERIES[name](spark, sf_dir)
    got = pd.DataFrame([r.asDict(recursive=True) for r in df.collect()], columns=df.columns,
                       dtype=object)
    cur = con.execute(ORACLES[name])
    want = pd.DataFrame(cur.fetchall(), columns=[c[0] for c in cur.description], dtype=object)
    types = [str(c[1]) for c in cur.description]
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if any("DECIMAL" in t or "HUGEINT" in t for t in types):
        return f"oracle types {types}"
    a, b = rows_of(got), rows_of(want)
    spark_types = dict(df.dtypes)
    for c, t in zip(want.columns, types):
        float_like = spark_types[c] in ("double", "float")
        if float_like != (t in ("DOUBLE", "FLOAT")):
            return f"type of {c}: {spark_types[c]} != {t}"
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:4]
        return f"rows {len(a)} vs {len(b)}; e.g. {diff}"
    return None


def main(argv: list[str]) -> int:
    from condensq.plans.catalog import ORACLES, QUERIES

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in argv or list(QUERIES):
        t0 = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, name, sf_dir)
            else:
                n = QUERIES[name](spark, sf_dir).count()
                problem = None if n else "no rows"
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - t0:.2f}s "
              f"{'' if name in ORACLES else '(rows only) '}{problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
