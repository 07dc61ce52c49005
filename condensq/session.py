"""Session defaults, checkpointing and size checks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "condensq", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a private one only on a local master that names none."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="condensq-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder, so lost executors do not replay the loop."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits(df: DataFrame, max_rows: int) -> bool:
    """True if `df` has at most `max_rows` rows; reads no more than it must to know."""
    return df.limit(max_rows + 1).count() <= max_rows


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition by key if the scan has too few partitions to keep the executors busy.

    A large table comes in enough splits and passes unchanged.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, key) if df.rdd.getNumPartitions() < slots else df


def dealt(df: DataFrame, rows_each: int = 1000) -> DataFrame:
    """Rows dealt to as many partitions as there are slots where they come in fewer, but to none of
    under `rows_each` rows: a small table can take long to work on and still come in one partition.
    """
    parts = min(df.sparkSession.sparkContext.defaultParallelism, df.count() // rows_each)
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def parted(df: DataFrame, rows_each: int = 20_000) -> DataFrame:
    """Rows in partitions of about `rows_each`: a number that depends on the rows alone."""
    return df.repartition(max(1, -(-df.count() // rows_each)))
