"""Seconds per headline query; prints one JSON line.

`BENCH_SF_DIR` names the tables, `BENCH_CPUS` the local cores. The star tables the questions read
are built inside the first timed entry, `star_build`; every other entry starts from the stored star
or from the raw tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "accuracy_by_tier", "top_candidates", "quartile_profile", "joint_filter", "contrast_panel",
    "population_context", "membership_merge", "condition_label", "dinucleotides", "motif_counts",
    "describe_by_class", "interval_overlap", "first_matching_event", "spliced_sequence",
    "sliding_max", "islands", "contacts", "gyration", "cluster_split", "auroc", "threshold_sweep",
    "metric_table", "rf_scores", "attributions", "chunk_fixed", "topk_cosine", "drift_js",
    "request_metrics", "similarity_clusters",
]


def main() -> None:
    from condensq.plans import star
    from condensq.plans.catalog import QUERIES
    from condensq.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "condensq-bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the machinery (JIT, code generation, Python workers) on the smallest table.
    spark.read.parquet(f"{sf_dir}/region.parquet").groupBy("r_name").count().collect()

    seconds: dict[str, float] = {}

    def timed(name, fn) -> None:
        start = time.perf_counter()
        try:
            fn()
            seconds[name] = round(time.perf_counter() - start, 3)
        except Exception as exc:
            print(f"{name}: {exc}", file=sys.stderr)
            seconds[name] = -1.0

    def build() -> None:
        for table in (star.genes, star.features, star.predictions):
            table(spark, sf_dir)

    timed("star_build", build)
    for name in sys.argv[1:] or HEADLINE:
        timed(
            name,
            lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save(),
        )
    good = [s for s in seconds.values() if s >= 0]
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(good), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
