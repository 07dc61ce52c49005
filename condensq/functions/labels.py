"""Row labels: conditions, quality flags, tiers, decisions, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_gene_id(col: Column) -> Column:
    """Locus code: starts with AT, third character a digit, nine characters or more."""
    return F.coalesce(F.trim(col).rlike(r"^AT\d.{6,}$"), F.lit(False))


def short_name(description: Column) -> Column:
    """Gene symbol in front of the `:p` marker of a description."""
    return F.trim(F.substring_index(F.substring_index(description, ":p,", 1), ":p", 1))


def condition_label(cls: Column, enriched_ns: Column, enriched_hs: Column, negative=0) -> Column:
    ns, hs = (F.coalesce(c, F.lit(False)) for c in (enriched_ns, enriched_hs))
    return (
        F.when(cls == negative, F.lit("depleted"))
        .when(ns & hs, F.lit("both"))
        .when(ns, F.lit("NS"))
        .otherwise(F.lit("HS"))
    )


def qc_flag(protein: Column, min_length: int = 30) -> Column:
    """First failing check of a translated sequence, else `pass`."""
    n = F.coalesce(F.length(protein), F.lit(0))
    inner = F.substring(protein, F.lit(1), n - 1)
    return (
        F.when(n == 0, F.lit("no_CDS"))
        .when(n < min_length, F.lit("short_protein"))
        .when(F.instr(inner, ".") > 0, F.lit("internal_stop_codon"))
        .otherwise(F.lit("pass"))
    )


def assign_tier(value: Column, cut1: float = 10.0, cut2: float = 30.0) -> Column:
    return F.when(value < cut1, F.lit(1)).when(value < cut2, F.lit(2)).otherwise(F.lit(3))


def tier_budget(tier: Column, budgets: tuple[int, int, int] = (100, 50, 100)) -> Column:
    return (
        F.when(tier == 1, F.lit(budgets[0]))
        .when(tier == 2, F.lit(budgets[1]))
        .otherwise(F.lit(budgets[2]))
    )


def confidence(prob: Column, high=0.75, medium=0.55, names=("high", "medium", "low")) -> Column:
    return F.when(prob >= high, F.lit(names[0])).when(prob >= medium, F.lit(names[1])).otherwise(
        F.lit(names[2])
    )


def confidence_symmetric(prob: Column) -> Column:
    """Both ends of the scale count as certain."""
    return (
        F.when((prob >= 0.75) | (prob <= 0.25), F.lit("High"))
        .when((prob >= 0.55) | (prob <= 0.45), F.lit("Medium"))
        .otherwise(F.lit("Low"))
    )


def decide(prob: Column, threshold: float = 0.5) -> Column:
    return (prob >= threshold).cast("int")


def label_text(flag: Column, positive="enriched", negative="not_enriched") -> Column:
    return F.when(flag == 1, F.lit(positive)).otherwise(F.lit(negative))


# Reporting groups of the features.
FEATURE_CATEGORIES = {
    "RNA-composition": ["fA", "fU", "fG", "fC", "au_content"],
    "RNA-dinucleotide": [f"di_{a}{b}" for a in "AUGC" for b in "AUGC"],
    "RNA-length": [
        "mrna_length", "cds_length", "utr3_length", "utr5_length", "utr3_fraction",
        "utr5_fraction", "cds_fraction",
    ],
    "RNA-structure": [
        "utr3_au_content", "mfe", "mfe_per_nt", "n_stemloops", "n_stemloops_per_kb",
    ],
    "RNA-m6A": [
        "rrach_count", "rrach_per_kb", "rrach_5utr_count", "rrach_3utr_count", "rrach_cds_count",
    ],
    "Protein-static": ["n_residues"],
    "Protein-IDR": ["idr_percent"],
    "Protein-flag": ["has_bioemu"],
    "Protein-dynamic": [
        "rmsf_mean", "rmsf_std", "rmsf_max", "rmsf_nterm50", "rmsf_cterm50", "rg_mean",
        "rg_std", "rg_cv", "contact_density", "packing_density", "sasa_per_residue", "pass_rate",
    ],
    "Engineered": [
        "rmsf_nterm_cterm_ratio", "packing_x_idr", "rrach_per_cds_kb", "utr3_au_x_length",
    ],
}
# Fixed values end.


def feature_category(feature: Column, groups=None, default: str = "Other") -> Column:
    """Group name of a feature; the lists are fixed, so they stay literals in the plan."""
    expr = None
    for group, members in (groups or FEATURE_CATEGORIES).items():
        hit = feature.isin(members)
        expr = F.when(hit, group) if expr is None else expr.when(hit, group)
    return expr.otherwise(F.lit(default))
