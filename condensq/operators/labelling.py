"""Labelled gene set from several evidence lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condensq.config import LabelSettings
from condensq.functions.labels import condition_label, valid_gene_id
from condensq.functions.numeric import any_ge, strongest_abs, to_number

LISTS = ["enriched_ns", "enriched_hs", "depleted_ns", "depleted_hs"]
PROTEIN_SIGNALS = ["log2fc_ap_ns", "log2fc_ap_hs", "log2fc_pdl_ns", "log2fc_pdl_hs"]


def unpivot_blocks(
    df: DataFrame, blocks: dict[str, Sequence[str]], names: Sequence[str], ord_col: str
) -> DataFrame:
    """Side-by-side column blocks of one row become rows; blocks without a valid id are dropped.

    `blocks` maps a list name to its columns in the order of `names` (the id first). `ord` keeps
    list order first, then row order, so "first value" stays defined afterwards.
    """
    entries = [
        F.struct(
            F.lit(label).alias("list_name"),
            *[F.col(c).cast("string").alias(n) for c, n in zip(cols, names)],
            F.struct(F.lit(i).alias("list"), F.col(ord_col).alias("row")).alias("ord"),
        )
        for i, (label, cols) in enumerate(blocks.items())
    ]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    return long.where(valid_gene_id(F.col(names[0]))).withColumn(names[0], F.trim(names[0]))


def merge_membership(
    df: DataFrame, key: str, firsts: Sequence[str], flags: dict[str, Column], ord_col: str = "ord"
) -> DataFrame:
    """One row per key: first non-null value of each column, any-true of each flag."""
    return df.groupBy(key).agg(
        *[
            F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ord_col))).alias(c)
            for c in firsts
        ],
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(name) for name, c in flags.items()],
    )


def rna_evidence(blocks: DataFrame) -> DataFrame:
    """Per-gene table of list memberships and first signals."""
    typed = blocks.withColumns(
        {c: to_number(F.col(c)) for c in ("log2fc_ns", "log2fc_hs")}
    )
    flags = {name: F.col("list_name") == name for name in LISTS}
    return merge_membership(typed, "gene_id", ["description", "log2fc_ns", "log2fc_hs"], flags)


def resolve_conflicts(
    df: DataFrame, is_pos: Column, is_neg: Column, signals: Sequence[str],
    strategy: str = "strongest",
) -> DataFrame:
    """Keep each key on one side; adds keep_pos, keep_neg, conflict_resolved and disposition."""
    if strategy not in ("enriched", "depleted", "drop", "strongest"):
        raise ValueError(f"unknown conflict strategy: {strategy}")
    parts = [F.coalesce(F.col(c), F.lit(0.0)) for c in signals]
    up = F.greatest(F.lit(0.0), *parts)
    down = F.abs(F.least(F.lit(0.0), *parts))
    conflict = is_pos & is_neg
    up_wins = up >= down
    if strategy == "strongest":
        text = F.when(
            up_wins, F.format_string("kept_as_positive (enr=%.2f > dep=%.2f)", up, down)
        ).otherwise(F.format_string("kept_as_negative (dep=%.2f > enr=%.2f)", down, up))
        drop_pos, drop_neg = ~up_wins, up_wins
    else:
        outcome = {"enriched": "kept_as_positive", "depleted": "kept_as_negative"}
        text = F.lit(outcome.get(strategy, "dropped"))
        drop_pos = F.lit(strategy != "enriched")
        drop_neg = F.lit(strategy != "depleted")
    return df.withColumns(
        {
            "keep_pos": is_pos & ~(conflict & drop_pos),
            "keep_neg": is_neg & ~(conflict & drop_neg),
            "conflict_resolved": conflict,
            "disposition": F.when(conflict, text),
        }
    )


def build_labels(
    rna: DataFrame, protein: DataFrame, settings: LabelSettings | None = None
) -> DataFrame:
    """Positives: enriched RNA and protein signal; negatives: depleted RNA."""
    cfg = settings or LabelSettings()
    prot = protein.withColumn(
        "protein_enriched", any_ge([F.col(c) for c in PROTEIN_SIGNALS], cfg.protein_threshold)
    )
    joined = rna.join(
        prot.select("gene_id", "description_prot", *PROTEIN_SIGNALS, "protein_enriched"),
        "gene_id", "left",
    )
    strongest = strongest_abs([F.col("log2fc_ns"), F.col("log2fc_hs")])
    if cfg.rna_min_abs_log2fc > 0:
        joined = joined.where(strongest >= cfg.rna_min_abs_log2fc)
    is_pos = (F.col("enriched_ns") | F.col("enriched_hs")) & F.coalesce(
        F.col("protein_enriched"), F.lit(False)
    )
    is_neg = F.col("depleted_ns") | F.col("depleted_hs")
    resolved = resolve_conflicts(
        joined, is_pos, is_neg, ["log2fc_ns", "log2fc_hs"], cfg.conflict_strategy
    ).where("keep_pos OR keep_neg")
    cls = F.when(F.col("keep_pos"), F.lit(cfg.positive)).otherwise(F.lit(cfg.negative))
    return resolved.withColumns({"class": cls, "strongest_rna_log2fc": strongest}).withColumn(
        "condition",
        condition_label(F.col("class"), F.col("enriched_ns"), F.col("enriched_hs"), cfg.negative),
    ).drop("keep_pos", "keep_neg")


def sort_labelled(df: DataFrame, signal: str = "strongest_rna_log2fc") -> DataFrame:
    return df.orderBy(
        F.col("class").desc_nulls_last(), F.col(signal).desc_nulls_last(), F.col("gene_id")
    )


# Decision and reason per reference class.
QUARANTINE = {
    "NUMT_contaminant": ("EXCLUDE", "NUMT_contaminant (CSV)"),
    "flanking_real_gene": ("RETAIN", "flanking_real_gene (CSV)"),
    "ambiguous": ("HELD_OUT", "ambiguous (CSV) — manual review required"),
}
PRECAUTION = ("EXCLUDE", "AT2G06/07xxx not in NUMT CSV — precautionary (pericentromeric)")
PREFIXES = ("AT2G06", "AT2G07")
# Fixed values end.


def quarantine(
    df: DataFrame, reference: DataFrame, prefixes: Sequence[str] = PREFIXES
) -> DataFrame:
    """Add decision and reason: listed class first, then the prefix rule, else retain."""
    listed = reference.select("gene_id", F.col("classification").alias("_c"))
    rule = F.lit(False)
    for p in prefixes:
        rule = rule | F.col("gene_id").startswith(p)

    def pick(i: int) -> Column:
        expr = None
        for name, pair in QUARANTINE.items():
            hit = F.col("_c") == name
            expr = F.when(hit, pair[i]) if expr is None else expr.when(hit, pair[i])
        other = ("RETAIN", F.concat(F.lit("unknown_csv_class="), F.col("_c")))
        return (
            expr.when(F.col("_c").isNotNull(), other[i])
            .when(rule, PRECAUTION[i])
            .otherwise(("RETAIN", "not_pericentromeric")[i])
        )

    return (
        df.join(listed, "gene_id", "left")
        .withColumns({"decision": pick(0), "reason": pick(1)})
        .drop("_c")
    )


def quarantine_outputs(df: DataFrame) -> dict[str, DataFrame]:
    """The three output tables of a decided frame."""
    return {
        "clean": df.where("decision = 'RETAIN'").drop("decision", "reason"),
        "excluded": df.where("decision = 'EXCLUDE'"),
        "held_out": df.where("decision = 'HELD_OUT'"),
    }
