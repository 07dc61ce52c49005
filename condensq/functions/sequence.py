"""Sequence features as Column expressions: counts, motifs, tails, headers, translation."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condensq.functions.numeric import ratio

BASES = "AUGC"
# Motif patterns (R = A/G, H = A/C/U).
MOTIFS = {"rrach": "[AG][AG]AC[ACU]", "aaach": "AAAC[ACU]"}
# Fixed values end.

EPS_RMSF = 0.1
EPS_CDS = 1.0


def to_rna(seq: Column) -> Column:
    return F.translate(F.upper(seq), "T", "U")


def substring_count(seq: Column, piece: str) -> Column:
    """Non-overlapping occurrences, by the length a byte-level replace takes away."""
    return ((F.length(seq) - F.length(F.replace(seq, F.lit(piece), F.lit("")))) / len(piece)).cast(
        "long"
    )


def char_count(seq: Column, chars: str) -> Column:
    return sum((substring_count(seq, c) for c in chars[1:]), substring_count(seq, chars[0]))


def pair_count(seq: Column, pair: str) -> Column:
    """Overlapping occurrences of two letters.

    Equal letters overlap, so each gets a mark in front; a letter that meets a mark has an equal
    one behind it.
    """
    if pair[0] != pair[1]:
        return substring_count(seq, pair)
    mark = "\u0001"
    marked = F.replace(seq, F.lit(pair[0]), F.lit(mark + pair[0]))
    return substring_count(marked, pair[0] + mark)


def composition(seq: Column) -> dict[str, Column]:
    """Base fractions, AU, GC and length; NULL fractions for an empty sequence."""
    n = F.length(seq)
    out = {"mrna_length": n}
    out |= {f"f{b}": ratio(char_count(seq, b), n) for b in BASES}
    out["au_content"] = ratio(char_count(seq, "AU"), n)
    out["gc_content"] = ratio(char_count(seq, "GC"), n)
    return out


def dinucleotides(seq: Column) -> dict[str, Column]:
    """Share of each of the 16 overlapping pairs; 0 for fewer than two bases."""
    pairs = F.length(seq) - 1
    return {
        f"di_{a}{b}": F.when(
            pairs > 0, pair_count(seq, a + b) / pairs
        ).otherwise(F.lit(0.0))
        for a, b in product(BASES, repeat=2)
    }


def motif_counts(seq: Column, motifs: dict[str, str] | None = None) -> dict[str, Column]:
    """Non-overlapping matches and matches per 1000 bases of each motif."""
    n = F.length(seq)
    out = {}
    for name, pattern in (motifs or MOTIFS).items():
        count = F.regexp_count(seq, F.lit(pattern))
        out[f"{name}_count"] = count
        out[f"{name}_per_kb"] = F.coalesce(ratio(count, n / 1000.0), F.lit(0.0))
    return out


def tail_length(seq: Column, len3: Column) -> Column:
    """Given 3' length, else a fifth of the sequence and at least 50."""
    n = F.length(seq)
    proxy = F.greatest(F.floor(n * 0.2), F.lit(50))
    return F.when(n == 0, F.lit(0)).when(len3 > 0, len3).otherwise(proxy).cast("long")


def add_tail(df: DataFrame, seq: str, len3: Column, digits: int = 4) -> DataFrame:
    """AU share of the 3' tail; the stand-in length replaces a missing one.

    Added in steps, so the tail is cut once and not again in every expression that reads it.
    """
    given = F.coalesce((len3 > 0) & (F.length(seq) > 0), F.lit(False))
    out = df.withColumns(
        {"utr3_length": tail_length(F.col(seq), len3), "utr3_estimated": ~given}
    ).withColumn("_tail", F.right(F.col(seq), F.col("utr3_length")))
    au = ratio(char_count(F.col("_tail"), "AU"), F.length("_tail"))
    return out.withColumn(
        "utr3_au_content", F.bround(F.coalesce(au, F.lit(0.0)), digits)
    ).drop("_tail")


def estimate_regions(n: Column, aa_len: Column) -> dict[str, Column]:
    """CDS and 5' lengths guessed from the protein length, or from fixed shares without one."""
    has_protein = F.coalesce(aa_len, F.lit(0)) > 0
    lead = F.greatest(F.floor(n * 0.1), F.lit(50))
    cds_aa = aa_len * 3 + 3
    lead_aa = F.when(cds_aa + lead >= n, F.greatest(n - cds_aa - 50, F.lit(0))).otherwise(lead)
    cds = F.when(has_protein, cds_aa).otherwise(F.floor(n * 0.55)).cast("long")
    utr5 = F.when(has_protein, lead_aa).otherwise(lead).cast("long")
    return {
        "cds_length": cds,
        "utr5_length": utr5,
        "utr3_rest": F.greatest(n - cds - utr5, F.lit(0)).cast("long"),
    }


def decay_flags(cds: Column, utr3: Column, aa_len: Column) -> dict[str, Column]:
    mismatch = F.when(cds > 0, F.abs(cds - (aa_len * 3 + 3))).otherwise(F.lit(-1))
    return {
        "cds_protein_mismatch": mismatch.cast("long"),
        "long_3utr": F.coalesce((utr3 > 1000).cast("int"), F.lit(0)),
        "ptc_proxy": F.coalesce(
            ((mismatch > 30) & (cds > 0) & (aa_len > 10)).cast("int"), F.lit(0)
        ),
    }


def length_normalise(df: DataFrame) -> DataFrame:
    """Region shares and stem-loops per 1000 bases from the length columns present."""
    n = F.col("mrna_length")
    add = {
        f"{r}_fraction": F.coalesce(ratio(F.col(f"{r}_length"), n), F.lit(0.0))
        for r in ("utr5", "utr3", "cds")
        if f"{r}_length" in df.columns
    }
    if "n_stemloops" in df.columns:
        add["n_stemloops_per_kb"] = ratio(F.col("n_stemloops"), n / 1000.0)
    return df.withColumns(add)


def engineer_features(df: DataFrame, idr_as: str = "fraction") -> DataFrame:
    """Ratio and product features; `idr_as='percent'` keeps the undivided scoring-side product."""
    have = set(df.columns)
    idr = F.col("idr_percent") if idr_as == "percent" else F.col("idr_percent") / 100.0
    recipes = {
        "rmsf_nterm_cterm_ratio": (
            {"rmsf_nterm50", "rmsf_cterm50"},
            lambda: F.try_divide(F.col("rmsf_nterm50"), F.col("rmsf_cterm50") + EPS_RMSF),
        ),
        "packing_x_idr": (
            {"packing_density", "idr_percent"}, lambda: F.col("packing_density") * idr,
        ),
        "rrach_per_cds_kb": (
            {"rrach_count", "cds_length"},
            lambda: F.try_divide(F.col("rrach_count"), (F.col("cds_length") + EPS_CDS) / 1000.0),
        ),
        "utr3_au_x_length": (
            {"utr3_au_content", "utr3_length"},
            lambda: F.col("utr3_au_content") * F.col("utr3_length"),
        ),
    }
    return df.withColumns({name: make() for name, (need, make) in recipes.items() if need <= have})


def fold_features(structure: Column, mfe: Column, digits: int = 4) -> dict[str, Column]:
    """Paired share, stem-loops and energy per base of a dot-bracket string."""
    n = F.length(structure)
    return {
        "mfe": mfe,
        # An energy of exactly zero has no per-base value in the batch feature table.
        "mfe_per_nt": F.when(mfe != 0, ratio(mfe, n)),
        "frac_paired": F.bround(
            F.coalesce(ratio(char_count(structure, "()"), n), F.lit(0.0)), digits
        ),
        "n_stemloops": F.regexp_count(structure, F.lit(r"\([.]+\)")),
    }


def make_header(gene, tx, cls, condition, flag: Column | None = None) -> Column:
    """`gene|tx|classN|condition`, plus `|QC_FAIL:reason` unless the flag is `pass`."""
    parts = [gene, tx, F.concat(F.lit("class"), cls.cast("string")), condition]
    if flag is not None:
        parts.append(F.when(flag != "pass", F.concat(F.lit("QC_FAIL:"), flag)))
    return F.concat_ws("|", *parts)


def parse_header(header: Column) -> dict[str, Column]:
    parts = F.split(header, r"\|")
    field = lambda i, default: F.coalesce(F.get(parts, i), F.lit(default))
    number = F.replace(field(2, "class0"), F.lit("class"), F.lit(""))
    return {
        "gene_id": field(0, ""),
        "tx_id": field(1, ""),
        "class": F.coalesce(number.try_cast("int"), F.lit(-1)),
        "condition": field(3, ""),
        "qc_fail": F.exists(parts, lambda p: p.contains("QC_FAIL")),
    }


def wrap(seq: Column, width: int = 80) -> Column:
    """Line breaks after every `width` characters, none at the end."""
    return F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n"))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTUacgtu", "UGCAAugcaa"))


def codon_table() -> dict[str, str]:
    """The standard code, spelled in the customary U, C, A, G order; `.` is a stop."""
    amino = "FFLLSSSSYY..CC.WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
    return {"".join(c): a for c, a in zip(product("UCAG", repeat=3), amino)}


def translate_cds(seq: Column) -> Column:
    """Amino acids of consecutive codons; unknown codons are X, a rest below three is dropped."""
    codons = F.regexp_extract_all(to_rna(seq), F.lit("(.{3})"), F.lit(1))
    table = F.create_map(*[F.lit(x) for pair in codon_table().items() for x in pair])
    return F.array_join(
        F.transform(codons, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), ""
    )


def sequence_features(df: DataFrame, seq: str, aa_len: Column, digits: int = 6) -> DataFrame:
    """Add every feature that one transcript alone determines."""
    col = F.col(seq)
    out = df.withColumns({**composition(col), **dinucleotides(col), **motif_counts(col)})
    out = out.withColumns(estimate_regions(F.col("mrna_length"), aa_len))
    return add_tail(out, seq, F.col("utr3_rest"), digits).drop("utr3_rest", "utr3_estimated")


def compute_features(
    df: DataFrame, seq: str = "mrna_seq", protein: str = "protein_seq"
) -> DataFrame:
    """All model features of a request row; what a sequence cannot tell is NULL."""
    from condensq.schemas import PROTEIN_FEATURES

    rna = to_rna(F.col(seq))
    aa_len = F.coalesce(F.length(protein), F.lit(0))
    out = sequence_features(df.withColumn("_seq", rna), "_seq", aa_len).drop("_seq")
    out = out.withColumns(
        {"long_3utr": (F.col("utr3_length") > 1000).cast("int"), "ptc_proxy": F.lit(0)}
    )
    missing = [
        c
        for c in ["mfe", "mfe_per_nt", "frac_paired", "n_stemloops", *PROTEIN_FEATURES]
        if c not in df.columns
    ]
    out = out.withColumns({c: F.lit(None).cast("double") for c in missing})
    return engineer_features(length_normalise(out), idr_as="percent")
