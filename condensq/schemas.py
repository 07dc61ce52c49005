"""Column layouts of the tables passed between stages."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "text_map": T.MapType(T.StringType(), T.StringType()),
    "number_map": T.MapType(T.StringType(), T.DoubleType()),
}


def _struct(spec: str) -> T.StructType:
    """Layout from `name type, name type`; unlike DDL text it needs no running session."""
    fields = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


GENES = _struct(
    "gene_id string, transcript_id string, gene_name string, class int, "
    "condition string, tier int, split string"
)

# The feature names of the wide matrix, in matrix order.
RNA_FEATURES = [
    "mrna_length", "fA", "fU", "fG", "fC", "au_content", "gc_content",
    "di_AA", "di_AU", "di_AG", "di_AC", "di_UA", "di_UU", "di_UG", "di_UC",
    "di_GA", "di_GU", "di_GG", "di_GC", "di_CA", "di_CU", "di_CG", "di_CC",
    "utr5_length", "utr3_length", "cds_length",
    "utr5_fraction", "utr3_fraction", "cds_fraction", "utr3_au_content",
    "rrach_count", "rrach_per_kb", "aaach_count", "aaach_per_kb",
    "mfe", "mfe_per_nt", "frac_paired", "n_stemloops", "n_stemloops_per_kb",
    "long_3utr", "ptc_proxy",
]
PROTEIN_FEATURES = [
    "idr_percent", "mean_disorder", "max_disorder_window", "n_idr_regions",
    "longest_idr_region", "rmsf_mean", "rmsf_std", "rmsf_max", "rmsf_nterm50",
    "rmsf_cterm50", "rg_mean", "rg_std", "rg_cv", "contact_density",
    "packing_density", "sasa_per_residue", "pass_rate", "n_residues",
]
ENGINEERED_FEATURES = [
    "rmsf_nterm_cterm_ratio", "packing_x_idr", "rrach_per_cds_kb", "utr3_au_x_length",
]
META_COLUMNS = [
    "gene_id", "transcript_id", "class", "condition", "qc_fail", "isoform_source",
    "event_type", "tier", "status", "feature_source", "cluster_id", "split",
]
ATTRIBUTION_FEATURES = [
    "mrna_length", "cds_length", "di_CG", "utr3_au_content", "rrach_per_kb", "rmsf_nterm50",
]
# The feature columns of the store, in store order.
STAR_FEATURES = [
    "mrna_length", "cds_length", "utr3_length", "utr5_length", "utr3_au_content",
    "rrach_count", "rrach_per_kb", "di_CG", "di_UA", "di_UG", "mfe", "mfe_per_nt",
    "au_content", "gc_content", "frac_paired", "n_stemloops_per_kb", "utr3_fraction",
    "utr5_fraction", "cds_fraction", "long_3utr", "ptc_proxy",
    "idr_percent", "rmsf_mean", "rmsf_nterm50", "rmsf_cterm50", "rmsf_std", "rmsf_max",
    "rg_mean", "rg_std", "rg_cv", "packing_density", "sasa_per_residue", "contact_density",
    "pass_rate", "n_residues", "mean_disorder", "max_disorder_window", "n_idr_regions",
    "longest_idr_region",
    "rmsf_nterm_cterm_ratio", "utr3_au_x_length", "packing_x_idr", "rrach_per_cds_kb",
]
INT_FEATURES = ["long_3utr", "ptc_proxy"]
# Fixed values end.

DYNAMIC_FEATURES = [
    c for c in PROTEIN_FEATURES if c.startswith(("rmsf_", "rg_")) or c == "pass_rate"
]
FEATURES = _struct(
    "gene_id string, "
    + ", ".join(f"{c} {'int' if c in INT_FEATURES else 'double'}" for c in STAR_FEATURES)
)
PREDICTIONS = _struct(
    "gene_id string, prob_pos double, pred int, "
    + ", ".join(f"shap_{c} double" for c in ATTRIBUTION_FEATURES)
)
STAR = {"genes": GENES, "features": FEATURES, "predictions": PREDICTIONS}

ANNOTATION = _struct(
    "seqname string, source string, feature string, start long, end long, score string, "
    "strand string, frame string, attrs text_map"
)
SEQUENCES = _struct(
    "gene_id string, tx_id string, class int, condition string, qc_fail boolean, seq string"
)
ATOMS = _struct(
    "structure string, frame long, atom_id long, res_id long, atom_name string, mass double, "
    "x double, y double, z double"
)
TASK_STATE = _struct(
    "key string, status string, n_conformations int, runtime_sec double, error string, "
    "timestamp string"
)
RUN = _struct(
    "run string, ts timestamp, params text_map, metrics number_map, "
    "tags text_map"
)
SCORE_REQUEST = _struct(
    "request_id string, ts timestamp, gene_id string, mrna_seq string, protein_seq string"
)
