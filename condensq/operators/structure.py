"""Coordinate-ensemble analytics on the long atom table (see schemas.ATOMS)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME = ["structure", "frame"]
CONTACT_CUTOFF = 8.0
PACKING_CUTOFF = 6.0
END_RESIDUES = 50


def gyration_per_frame(atoms: DataFrame) -> DataFrame:
    """Mass-weighted radius of gyration of each frame, from sums alone."""
    m = F.col("mass")
    sums = atoms.groupBy(*FRAME).agg(
        F.sum(m).alias("m"),
        *[F.sum(m * F.col(a)).alias(f"m{a}") for a in "xyz"],
        F.sum(m * (F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("m2"),
    )
    centre = sum((F.col(f"m{a}") / F.col("m")) ** 2 for a in "xyz")
    return sums.select(
        *FRAME, F.sqrt(F.greatest(F.col("m2") / F.col("m") - centre, F.lit(0.0))).alias("rg")
    )


def radius_of_gyration(atoms: DataFrame) -> DataFrame:
    """Mean, population deviation and variation of the radius over the frames."""
    out = gyration_per_frame(atoms).groupBy("structure").agg(
        F.count(F.lit(1)).alias("n_conformations"),
        F.avg("rg").alias("rg_mean"),
        F.stddev_pop("rg").alias("rg_std"),
    )
    return out.withColumn("rg_cv", F.when(F.col("rg_mean") > 0, F.col("rg_std") / F.col("rg_mean")))


def first_frames(atoms: DataFrame) -> DataFrame:
    """Atoms of each structure's lowest frame."""
    first = atoms.groupBy("structure").agg(F.min("frame").alias("frame"))
    return atoms.join(first, FRAME, "left_semi")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _rotation(cov: pd.Series) -> pd.Series:
    """Row-major rotation of least squares for flattened 3x3 covariances (Kabsch)."""
    if cov.empty:
        return pd.Series([], dtype=object)
    h = np.stack(cov.to_numpy()).reshape(-1, 3, 3)
    u, _, vt = np.linalg.svd(h)
    sign = np.sign(np.linalg.det(u @ vt))
    flip = np.tile(np.eye(3), (len(h), 1, 1))
    flip[:, 2, 2] = np.where(sign < 0, -1.0, 1.0)
    return pd.Series(list((u @ flip @ vt).reshape(-1, 9)))


def superpose(atoms: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Rotate and centre every frame onto its structure's reference frame.

    The 3x3 covariance of a frame is a sum over its atoms, so frames are never gathered in one
    task; Python sees nine numbers per frame.
    """
    ref = first_frames(atoms) if reference is None else reference
    ref = ref.select("structure", "atom_id", *[F.col(a).alias(f"r{a}") for a in "xyz"])
    paired = atoms.join(ref, ["structure", "atom_id"])
    n = F.count(F.lit(1))
    cov = [
        F.sum(F.col(a) * F.col(f"r{b}")) - F.sum(a) * F.sum(f"r{b}") / n
        for a in "xyz" for b in "xyz"
    ]
    frames = paired.groupBy(*FRAME).agg(
        F.array(*cov).alias("cov"), *[F.avg(a).alias(f"c{a}") for a in "xyz"]
    )
    frames = frames.select(*FRAME, "cx", "cy", "cz", _rotation("cov").alias("rot"))
    moved = atoms.join(frames, FRAME)
    centred = [F.col(a) - F.col(f"c{a}") for a in "xyz"]

    def axis(j: int):
        return sum(centred[i] * F.element_at("rot", 3 * i + j + 1) for i in range(3))

    keep = [c for c in atoms.columns if c not in "xyz"]
    return moved.select(*keep, *[axis(j).alias(a) for j, a in enumerate("xyz")])


def rmsf_per_residue(atoms: DataFrame, atom_name: str = "CA") -> DataFrame:
    """Fluctuation of each backbone atom around its mean position after superposition."""
    aligned = superpose(atoms.where(F.col("atom_name") == atom_name))
    return aligned.groupBy("structure", "res_id").agg(
        F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rmsf")
    )


def rmsf(atoms: DataFrame, atom_name: str = "CA", ends: int = END_RESIDUES) -> DataFrame:
    """Mean, population deviation, maximum and the means over the first and last residues."""
    per = rmsf_per_residue(atoms, atom_name)
    order = Window.partitionBy("structure").orderBy("res_id")  # one row per residue
    pos = per.withColumns(
        {"_i": F.row_number().over(order), "_n": F.count(F.lit(1)).over(order.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))}
    )
    return pos.groupBy("structure").agg(
        F.avg("rmsf").alias("rmsf_mean"),
        F.stddev_pop("rmsf").alias("rmsf_std"),
        F.max("rmsf").alias("rmsf_max"),
        F.avg(F.when(F.col("_i") <= ends, F.col("rmsf"))).alias("rmsf_nterm50"),
        F.avg(F.when(F.col("_i") > F.col("_n") - ends, F.col("rmsf"))).alias("rmsf_cterm50"),
    )


def proximity_pairs(points: DataFrame, cutoff: float) -> DataFrame:
    """Pairs (a_id < b_id) of one frame closer than the cutoff.

    Space is cut into cells of cutoff width; a point meets only points of its own and the
    neighbouring cells, by an equi join.
    """
    cell = {f"c{a}": F.floor(F.col(a) / cutoff) for a in "xyz"}
    placed = points.select(*FRAME, "atom_id", "x", "y", "z").withColumns(cell)
    shifts = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    near = placed
    for a in "xyz":
        near = near.withColumn(f"c{a}", F.explode(F.transform(shifts, lambda d: F.col(f"c{a}") + d)))
    left = near.select(
        *FRAME, "cx", "cy", "cz", F.col("atom_id").alias("a_id"),
        *[F.col(a).alias(f"a{a}") for a in "xyz"],
    )
    right = placed.withColumnRenamed("atom_id", "b_id")
    d2 = sum((F.col(f"a{a}") - F.col(a)) ** 2 for a in "xyz")
    return (
        left.join(right, [*FRAME, "cx", "cy", "cz"])
        .where((F.col("a_id") < F.col("b_id")) & (d2 < cutoff * cutoff))
        .select(*FRAME, "a_id", "b_id", F.sqrt(d2).alias("distance"))
    )


def _neighbours(
    points: DataFrame, cutoff: float, name: str, per: str | Column, convention: str
) -> DataFrame:
    """Neighbours per unit and frame: both ends of a pair count, or one with `pairs`."""
    units = points.groupBy(*FRAME).agg(F.count_distinct(per).alias("_units"))
    pairs = proximity_pairs(points, cutoff).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("_pairs"))
    ends = 2 if convention == "neighbours" else 1
    return units.join(pairs, FRAME, "left").select(
        *FRAME,
        F.coalesce(F.try_divide(F.coalesce("_pairs", F.lit(0)) * ends, "_units"), F.lit(0.0)).alias(name),
    )


def contact_density(
    atoms: DataFrame, cutoff: float = CONTACT_CUTOFF, convention: str = "neighbours"
) -> DataFrame:
    """Mean number of backbone neighbours per residue, for each frame given."""
    backbone = atoms.where("atom_name = 'CA'")
    return _neighbours(backbone, cutoff, "contact_density", "atom_id", convention)


def packing_density(
    atoms: DataFrame, cutoff: float = PACKING_CUTOFF, convention: str = "neighbours"
) -> DataFrame:
    """Mean number of heavy-atom neighbours: per atom, or pairs per residue with a backbone atom."""
    heavy = atoms.where("NOT startswith(atom_name, 'H')")
    residue = F.when(F.col("atom_name") == "CA", F.col("res_id"))
    per = "atom_id" if convention == "neighbours" else residue
    return _neighbours(heavy, cutoff, "packing_density", per, convention)


def surface_proxy(rg, n):
    """Sphere surface of radius `rg` per residue."""
    return 4 * math.pi * rg * rg / n


def ensemble_features(atoms: DataFrame, requested: DataFrame) -> DataFrame:
    """All ensemble features per structure; densities come from the first frame."""
    first = first_frames(atoms)
    residues = atoms.where("atom_name = 'CA'").groupBy("structure").agg(
        F.count_distinct("res_id").alias("n_residues")
    )
    out = (
        radius_of_gyration(atoms)
        .join(residues, "structure")
        .join(rmsf(atoms), "structure", "left")
        .join(contact_density(first).drop("frame"), "structure", "left")
        .join(packing_density(first).drop("frame"), "structure", "left")
        .join(requested.select("structure", "n_requested"), "structure", "left")
    )
    rate = F.when(F.col("n_requested") > 0, F.col("n_conformations") / F.col("n_requested"))
    out = out.withColumns(
        {
            "pass_rate": F.coalesce(rate, F.lit(0.0)),
            "sasa_per_residue": surface_proxy(F.col("rg_mean"), F.col("n_residues")),
            "feature_source": F.lit("ensemble"),
        }
    ).drop("n_requested")
    whole = {"structure", "feature_source", "n_conformations", "n_residues"}
    return out.withColumns({c: F.bround(c, 4) for c in out.columns if c not in whole})


def static_features(atoms: DataFrame, min_residues: int = 10) -> DataFrame:
    """Single-structure features: pairs per residue, atoms per residue, no spread."""
    counts = atoms.groupBy(*FRAME).agg(
        F.count_distinct(F.when(F.col("atom_name") == "CA", F.col("res_id"))).alias("n_residues"),
        F.count_if(~F.col("atom_name").startswith("H")).alias("_heavy"),
    )
    out = (
        counts.join(gyration_per_frame(atoms), FRAME)
        .join(contact_density(atoms, convention="pairs"), FRAME, "left")
        .join(packing_density(atoms, convention="pairs"), FRAME, "left")
    )
    short = F.col("n_residues") < min_residues
    ok = lambda c: F.when(~short, c)
    return out.select(
        "structure",
        F.col("n_residues").cast("double").alias("n_residues"),
        ok(F.col("rg")).alias("rg_mean"),
        ok(F.lit(0.0)).alias("rg_std"),
        ok(F.lit(0.0)).alias("rg_cv"),
        ok(F.col("contact_density")).alias("contact_density"),
        ok(F.col("packing_density")).alias("packing_density"),
        ok(F.col("_heavy") / F.col("n_residues")).alias("sasa_per_residue"),
        ok(F.lit("static")).alias("feature_source"),
        F.when(short, F.format_string("too_short: %d residues", "n_residues")).alias("error"),
    )


def route_source(work: DataFrame, ensemble: DataFrame, static: DataFrame) -> DataFrame:
    """Per structure: ensemble features if its task completed, else static ones, else a marker.

    work: structure, status, protein_length.
    """
    names = [c for c in ensemble.columns if c not in ("structure", "feature_source")]
    have = set(static.columns)
    e = ensemble.select("structure", F.struct(*names).alias("e"))
    s = static.where("error IS NULL").select(
        "structure", F.struct(*[c for c in names if c in have]).alias("s")
    )
    done = F.coalesce(F.col("status") == "completed", F.lit(False))
    joined = work.join(e, "structure", "left").join(s, "structure", "left")

    def value(c: str):
        static_value = F.col(f"s.{c}") if c in have else F.lit(None)
        rest = F.when(F.col("s").isNotNull(), static_value)
        if c == "n_residues":
            rest = F.coalesce(rest, F.col("protein_length"))
        return F.when(done, F.col(f"e.{c}")).otherwise(rest).alias(c)

    source = (
        F.when(done & F.col("e").isNotNull(), "ensemble")
        .when(done, "ensemble_files_missing")
        .when(F.col("s").isNotNull(), "static")
        .otherwise("static_not_found")
    )
    return joined.select("structure", source.alias("feature_source"), *[value(c) for c in names])
