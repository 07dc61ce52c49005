import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from condensq.operators import structure as J
from condensq.schemas import ATOMS

rng = np.random.default_rng(5)


def frame_rows(structure, frame, xyz, names=None):
    return [
        (structure, frame, i + 1, i // 2 + 1, (names or ["CA", "CB"])[i % 2], 12.0 + i % 2,
         *map(float, p))
        for i, p in enumerate(xyz)
    ]


@pytest.fixture(scope="module")
def ensemble(spark):
    data, coords = [], {}
    for s in ("a", "b"):
        base = rng.normal(0, 6, (24, 3))
        for f in range(4):
            xyz = base + rng.normal(0, 1, base.shape)
            coords[s, f] = xyz
            data += frame_rows(s, f, xyz)
    return coords, spark.createDataFrame(data, ATOMS).cache()


def test_gyration(ensemble):
    coords, df = ensemble
    m = np.array([12.0 + i % 2 for i in range(24)])
    got = {(r.structure, r.frame): r.rg for r in J.gyration_per_frame(df).collect()}
    for key, xyz in coords.items():
        c = (m[:, None] * xyz).sum(0) / m.sum()
        assert got[key] == pytest.approx(math.sqrt((m * ((xyz - c) ** 2).sum(1)).sum() / m.sum()))


@pytest.mark.parametrize("cutoff", [1.5, 4.0, 8.0, 50.0])
def test_pairs_match_all_distances(ensemble, cutoff):
    coords, df = ensemble
    got = {(r.structure, r.frame, r.a_id, r.b_id) for r in J.proximity_pairs(df, cutoff).collect()}
    want = {
        (*key, i + 1, j + 1)
        for key, xyz in coords.items()
        for i, j in itertools.combinations(range(len(xyz)), 2)
        if np.linalg.norm(xyz[i] - xyz[j]) < cutoff
    }
    assert got == want


def test_densities_and_conventions(ensemble):
    coords, df = ensemble
    both = {(r.structure, r.frame): r.contact_density for r in J.contact_density(df).collect()}
    half = {(r.structure, r.frame): r.contact_density
            for r in J.contact_density(df, convention="pairs").collect()}
    xyz = coords["a", 0][::2]
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    assert both["a", 0] == pytest.approx(((d < 8).sum() - len(xyz)) / len(xyz))
    assert all(both[k] == pytest.approx(2 * half[k]) for k in both)
    pack = {(r.structure, r.frame): r.packing_density
            for r in J.packing_density(df, convention="pairs").collect()}
    xyz = coords["b", 1]
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    assert pack["b", 1] == pytest.approx(((d < 6).sum() - len(xyz)) / 2 / 12)


def rotation():
    q, r = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    return q if np.linalg.det(q) > 0 else q[:, [1, 0, 2]]


def test_rigid_motion_has_no_fluctuation(spark):
    base = rng.normal(0, 5, (20, 3))
    data = frame_rows("s", 0, base)
    for f in range(1, 5):
        data += frame_rows("s", f, base @ rotation() + rng.normal(0, 30, 3))
    r = J.rmsf(spark.createDataFrame(data, ATOMS), ends=3).first()
    assert r.rmsf_max == pytest.approx(0, abs=1e-5)


def test_mirror_image_is_not_superposed(spark):
    base = rng.normal(0, 5, (20, 3))
    data = frame_rows("s", 0, base) + frame_rows("s", 1, base * [1, 1, -1])
    assert J.rmsf(spark.createDataFrame(data, ATOMS)).first().rmsf_mean > 0.5


def test_rmsf_matches_numpy(ensemble):
    coords, df = ensemble
    ref = coords["a", 0][::2]
    ref = ref - ref.mean(0)
    moved = []
    for f in range(4):
        x = coords["a", f][::2]
        x = x - x.mean(0)
        u, _, vt = np.linalg.svd(x.T @ ref)
        sign = np.sign(np.linalg.det(u @ vt))
        moved.append(x @ u @ np.diag([1, 1, sign]) @ vt)
    per = np.sqrt(np.var(np.stack(moved), axis=0).sum(1))
    r = J.rmsf(df, ends=4).where("structure = 'a'").first()
    assert r.rmsf_mean == pytest.approx(per.mean()) and r.rmsf_std == pytest.approx(per.std())
    assert r.rmsf_nterm50 == pytest.approx(per[:4].mean())
    assert r.rmsf_cterm50 == pytest.approx(per[-4:].mean())


def test_static_features_reject_short_chains(spark, ensemble):
    _, df = ensemble
    first = J.first_frames(df)
    ok = J.static_features(first).collect()
    assert {r.feature_source for r in ok} == {"static"} and ok[0].sasa_per_residue == 2.0
    short = J.static_features(first.where("res_id <= 4"))
    assert [r.error for r in short.collect()] == ["too_short: 4 residues"] * 2


def test_source_routing(spark, ensemble):
    _, df = ensemble
    req = spark.createDataFrame([("a", 8), ("b", 0)], "structure string, n_requested int")
    ens = J.ensemble_features(df, req)
    got = {r.structure: r for r in ens.collect()}
    assert got["a"].pass_rate == 0.5 and got["b"].pass_rate == 0.0
    static = J.static_features(J.first_frames(df).where("structure = 'b'"))
    work = spark.createDataFrame(
        [("a", "completed", 5), ("b", "failed", 6), ("c", None, 7), ("d", "completed", 8)],
        "structure string, status string, protein_length int")
    out = {r.structure: r for r in J.route_source(work, ens, static).collect()}
    assert {k: r.feature_source for k, r in out.items()} == {
        "a": "ensemble", "b": "static", "c": "static_not_found", "d": "ensemble_files_missing"}
    assert out["b"].rmsf_mean is None and out["b"].rg_std == 0.0
    assert out["c"].n_residues == 7 and out["a"].rmsf_mean is not None


def test_hydrogens_do_not_pack(spark):
    data = frame_rows("s", 0, rng.normal(0, 1, (20, 3)), ["CA", "HB"])
    df = spark.createDataFrame(data, ATOMS)
    heavy = J.packing_density(df).first().packing_density
    assert heavy == J.packing_density(df.where(F.col("atom_name") == "CA")).first().packing_density
