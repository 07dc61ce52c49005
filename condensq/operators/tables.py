"""Column handling, joins, set operations and top-k over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condensq.operators.ranking import first_per_key
from condensq.schemas import DYNAMIC_FEATURES, META_COLUMNS

_ALIASES = {"geneID": "gene_id", "pred_class": "pred", "txID": "transcript_id"}
_NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint", "long", "integer")
_LABEL_SIGNALS = ("log2fc", "dpsi")


# Columns -------------------------------------------------------------------------------------

def normalise_columns(df: DataFrame) -> DataFrame:
    """One spelling for key and prediction columns."""
    return df.withColumnsRenamed({k: v for k, v in _ALIASES.items() if k in df.columns})


def normalise_predictions(df: DataFrame) -> DataFrame:
    df = normalise_columns(df)
    types = {"gene_id": "string", "class": "int", "split": "string", "prob_pos": "double",
             "pred": "int"}
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in types.items() if c in df.columns])


def feature_columns(
    df: DataFrame, meta: Sequence[str] = META_COLUMNS, drop: Sequence[str] = ()
) -> list[str]:
    """Numeric columns that are neither meta nor dropped; label-defining signals are refused."""
    return [
        f.name
        for f in df.schema
        if f.dataType.simpleString() in _NUMERIC
        and f.name not in set(meta) | set(drop)
        and not any(s in f.name.lower() for s in _LABEL_SIGNALS)
    ]


def has_dynamic(df: DataFrame, mode: str = "status") -> Column:
    """Availability of ensemble features by task status or by any value present."""
    if mode == "status":
        return F.coalesce(F.col("status") == "completed", F.lit(False)).cast("int")
    present = [c for c in DYNAMIC_FEATURES if c in df.columns]
    return F.coalesce(*[F.col(c) for c in present]).isNotNull().cast("int")


def missing_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of missing values per column in one pass, with the two reporting bands."""
    counts = df.select(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    )
    long = counts.unpivot(["n"], list(cols), "feature", "n_missing")
    pct = F.when(F.col("n") > 0, F.col("n_missing") * 100.0 / F.col("n"))
    band = F.when(pct == 0, "complete").when(pct > 10, "over_10").when(pct > 5, "over_5")
    return long.select(
        "feature", "n_missing", pct.alias("pct_missing"), band.otherwise("up_to_5").alias("band")
    )


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`df` itself, or an error that names an offending key."""
    clash = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if clash:
        raise ValueError(f"duplicate key {clash[0].asDict()}")
    return df


# Joins ---------------------------------------------------------------------------------------

def star_join(genes: DataFrame, features: DataFrame, predictions: DataFrame) -> DataFrame:
    return predictions.join(genes, "gene_id").join(features, "gene_id")


def enrich(df: DataFrame, dim: DataFrame, keys: str | Sequence[str], cols=None) -> DataFrame:
    """Left join of the wanted columns; columns `df` already has are not taken again."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    wanted = [c for c in (cols or dim.columns) if c not in keys and c not in df.columns]
    return df.join(dim.select(*keys, *wanted), keys, "left")


def keep_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def not_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def keep_common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def map_values(
    df: DataFrame, mapping: DataFrame, key: str, value: str, default=None
) -> DataFrame:
    """Dictionary-style lookup; Spark's size threshold decides on a broadcast of the mapping."""
    out = df.join(mapping.select(key, value), key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))


def lookup_fallback(
    df: DataFrame, lookups: Sequence[tuple[DataFrame, Column]], key: str, value: str
) -> DataFrame:
    """First hit over several (mapping, key expression) pairs, in order; misses keep NULL.

    Mappings have columns `key` and `value`. Each is one equi join on the distinct keys asked
    for, so a key that many rows share is looked up once.
    """
    asked = df.select(key).where(F.col(key).isNotNull()).distinct()
    hits = [
        asked.select(key, expr.alias("_k"))
        .join(mapping.select(F.col("key").alias("_k"), "value"), "_k")
        .select(key, F.lit(i).alias("_prio"), "value")
        for i, (mapping, expr) in enumerate(lookups)
    ]
    best = reduce(DataFrame.unionByName, hits).groupBy(key).agg(
        F.min_by("value", F.struct("_prio", "value")).alias(value),
        F.min("_prio").alias("matched_by"),
    )
    return df.join(best, key, "left")


def mapping_coverage(df: DataFrame, value: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_ids"),
        F.count(value).alias("n_mapped"),
        F.round(F.count(value) * 100.0 / F.count(F.lit(1)), 1).alias("pct_mapped"),
    )


def join_by_row_id(df: DataFrame, other: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Positional join on ids written when the rows were created."""
    return df.join(other, row_id, "left")


def patch(
    df: DataFrame, updates: DataFrame, key: str, cols: Sequence[str], ok: Column | None = None
) -> DataFrame:
    """Overwrite columns where a successful replacement exists, its NULLs included."""
    good = updates if ok is None else updates.where(ok)
    renamed = good.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    out = df.join(renamed, key, "left")
    new = {c: F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in cols}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def re_enrich(dependent: DataFrame, patched: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Replace the patched columns of a dependent table."""
    return dependent.drop(*cols).join(patched.select(key, *cols), key, "left")


def param_grid(df: DataFrame, values: Sequence, name: str) -> DataFrame:
    """Every row once per parameter value; the values are literals of the plan.

    Where counts per value are wanted, count first and meet the grid afterwards, as
    `metrics.threshold_sweep` does.
    """
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


# Set operations ------------------------------------------------------------------------------

def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def union_loose(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def set_op(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    ops = {
        "intersection": lambda: a.intersect(b),
        "difference": lambda: a.subtract(b),
        "union": lambda: a.unionByName(b).distinct(),
    }
    return ops[op]()


# Sorting and top-k ---------------------------------------------------------------------------

def top_n(df: DataFrame, col: str, n: int, tie: str = "gene_id") -> DataFrame:
    return df.orderBy(F.col(col).desc_nulls_last(), F.col(tie)).limit(n)


def bottom_n(df: DataFrame, col: str, n: int, tie: str = "gene_id") -> DataFrame:
    return df.orderBy(F.col(col).asc_nulls_last(), F.col(tie)).limit(n)


def head_n(df: DataFrame, n: int | None) -> DataFrame:
    return df if n is None else df.limit(n)


def top_in_category(df: DataFrame, category: str, value: str, n: int) -> DataFrame:
    return top_n(df.where(F.col("category") == category), value, n, "feature")


def contrast_panel(star: DataFrame, hi: float = 0.75, lo: float = 0.25, n: int = 150) -> DataFrame:
    """Most certain positives and negatives, tagged."""
    cols = [
        "gene_id", "gene_name", "condition", F.round("prob_pos", 4).alias("prob_pos"),
        "rrach_count", F.round("utr3_au_content", 4).alias("utr3_au_content"),
        F.round("idr_percent", 2).alias("idr_percent"),
    ]
    pos = top_n(star.where((F.col("class") == 1) & (F.col("prob_pos") > hi)), "prob_pos", n)
    neg = bottom_n(star.where((F.col("class") == 0) & (F.col("prob_pos") < lo)), "prob_pos", n)
    return pos.select(*cols, F.lit("positive_probe").alias("probe_type")).unionByName(
        neg.select(*cols, F.lit("negative_probe").alias("probe_type"))
    )


def search_name(df: DataFrame, term: str, col: str = "gene_name") -> DataFrame:
    return df.where(F.lower(col).contains(F.lower(F.lit(term))))


def dedupe_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return first_per_key(df, [key], order)
