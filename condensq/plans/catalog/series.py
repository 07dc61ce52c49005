"""Score series, coordinate ensembles and source routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from condensq.functions.arrays import score_digest
from condensq.operators import series as Z
from condensq.operators import structure as J
from condensq.plans import star as S
from condensq.plans.catalog import query
from condensq.plans.star import ATOMS_SQL, with_sql


@query("score_digest", """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 2 + 0.5) AS v
           FROM embeddings),
w AS (SELECT vec_id, max(m) AS best FROM (
  SELECT vec_id, list_sum(v[i:i + 19]) / 20 AS m
  FROM s, range(1, 46) AS r(i)) GROUP BY 1),
b AS (SELECT vec_id, v, list_aggregate(list_transform(v, lambda x: CASE WHEN x > 0.5 THEN '1'
        ELSE '0' END), 'string_agg', '') AS mask FROM s)
SELECT vec_id, round_even(100.0::DOUBLE * len(list_filter(v, lambda x: x > 0.5)) / len(v), 2)
         AS idr_percent,
       round_even(list_sum(v) / len(v), 4) AS mean_disorder,
       round_even(best, 4) AS max_disorder_window,
       len(regexp_extract_all(mask, '1+')) AS n_idr_regions,
       list_max(list_transform(regexp_extract_all(mask, '1+'), lambda x: length(x)))
         AS longest_idr_region,
       len(v) AS protein_length
FROM b JOIN w USING (vec_id)""")
def digest(spark, d):
    r = S.residues(spark, d)
    return r.select("vec_id", *[c.alias(n) for n, c in score_digest(F.col("scores")).items()])


_SERIES_SQL = """
WITH p AS (SELECT user_id, value,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)
"""


def event_series(spark, d):
    """Events of a user in time order, numbered day by day."""
    e = S.table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    return Z.number_rows(e, "user_id", ["ts", "event_id"], F.date_trunc("day", "ts"))


@query("series_positions", _SERIES_SQL + "SELECT user_id, value, pos FROM p")
def series_positions(spark, d):
    return event_series(spark, d).select("user_id", "value", "pos")


@query("sliding_max", _SERIES_SQL + """, w AS (
  SELECT user_id, pos, value,
         avg(value) OVER (PARTITION BY user_id ORDER BY pos ROWS 19 PRECEDING) AS m FROM p)
SELECT user_id, round(coalesce(max(m) FILTER (pos >= 20), avg(value)), 6) AS max_window_mean
FROM w GROUP BY 1""")
def sliding_max(spark, d):
    out = Z.sliding_max(event_series(spark, d), "user_id", 20, chunk=32)
    return out.withColumn("max_window_mean", F.round("max_window_mean", 6))


@query("islands", _SERIES_SQL + """, f AS (
  SELECT user_id, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g
  FROM p WHERE value > 50),
r AS (SELECT user_id, g, count(*) AS n FROM f GROUP BY 1, 2)
SELECT u.user_id, count(r.n) AS n_runs, coalesce(max(r.n), 0) AS longest_run
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r USING (user_id) GROUP BY 1""")
def islands(spark, d):
    return Z.runs_above(event_series(spark, d), "user_id", 50.0, chunk=32)


# Structures ----------------------------------------------------------------------------------

_RG = """, com AS (
  SELECT structure, frame, sum(mass * x) / sum(mass) AS cx, sum(mass * y) / sum(mass) AS cy,
         sum(mass * z) / sum(mass) AS cz FROM atoms GROUP BY 1, 2),
rg AS (
  SELECT structure, frame, sqrt(sum(mass * ((x - cx)**2 + (y - cy)**2 + (z - cz)**2)) / sum(mass))
         AS rg FROM atoms JOIN com USING (structure, frame) GROUP BY 1, 2)
"""


@query("gyration", with_sql(ATOMS_SQL) + _RG + """
SELECT structure, count(*) AS n_conformations, round(avg(rg), 6) AS rg_mean,
       round(stddev_pop(rg), 6) AS rg_std, round(stddev_pop(rg) / avg(rg), 6) AS rg_cv
FROM rg GROUP BY 1""")
def gyration(spark, d):
    out = J.radius_of_gyration(S.atoms(spark, d))
    return out.select("structure", "n_conformations", *[
        F.round(c, 6).alias(c) for c in ("rg_mean", "rg_std", "rg_cv")])


def _near(where: str, cutoff: str) -> str:
    return f""", sel AS (SELECT * FROM atoms WHERE {where}),
pairs AS (
  SELECT a.structure, a.frame, count(*) AS n_pairs FROM sel a JOIN sel b
    ON a.structure = b.structure AND a.frame = b.frame AND a.atom_id < b.atom_id
  WHERE (a.x - b.x)**2 + (a.y - b.y)**2 + (a.z - b.z)**2 < {cutoff}::DOUBLE**2 GROUP BY 1, 2),
units AS (SELECT structure, frame, count(*) AS n_units, count(DISTINCT res_id) AS n_res
          FROM sel GROUP BY 1, 2)
"""


@query("contacts", with_sql(ATOMS_SQL) + _near("atom_name = 'CA'", "8") + """
SELECT structure, frame, round(coalesce(n_pairs, 0) * 2.0::DOUBLE / n_units, 6) AS contact_density
FROM units LEFT JOIN pairs USING (structure, frame)""")
def contacts(spark, d):
    out = J.contact_density(S.atoms(spark, d))
    return out.withColumn("contact_density", F.round("contact_density", 6))


@query("packing", with_sql(ATOMS_SQL) + _near("true", "6") + """
SELECT structure, frame, round(coalesce(n_pairs, 0) * 2.0::DOUBLE / n_units, 6) AS packing_density
FROM units LEFT JOIN pairs USING (structure, frame)""")
def packing(spark, d):
    out = J.packing_density(S.atoms(spark, d))
    return out.withColumn("packing_density", F.round("packing_density", 6))


@query("proximity_pairs", with_sql(ATOMS_SQL) + """
SELECT a.structure, a.frame, a.atom_id AS a_id, b.atom_id AS b_id,
       round(sqrt((a.x - b.x)**2 + (a.y - b.y)**2 + (a.z - b.z)**2), 6) AS distance
FROM atoms a JOIN atoms b ON a.structure = b.structure AND a.frame = b.frame
 AND a.atom_id < b.atom_id
WHERE (a.x - b.x)**2 + (a.y - b.y)**2 + (a.z - b.z)**2 < 16""")
def proximity_pairs(spark, d):
    out = J.proximity_pairs(S.atoms(spark, d), 4.0)
    return out.withColumn("distance", F.round("distance", 6))


@query("static_features", with_sql(ATOMS_SQL) + _RG + _near("true", "6").replace("pairs AS", "hp AS")
       + """, ca AS (
  SELECT a.structure, a.frame, count(*) AS n FROM atoms a JOIN atoms b
    ON a.structure = b.structure AND a.frame = b.frame AND a.atom_id < b.atom_id
   AND a.atom_name = 'CA' AND b.atom_name = 'CA'
  WHERE (a.x - b.x)**2 + (a.y - b.y)**2 + (a.z - b.z)**2 < 64 GROUP BY 1, 2)
SELECT u.structure, nc.n::DOUBLE AS n_residues, round(rg, 6) AS rg_mean, 0.0::DOUBLE AS rg_std,
       round(coalesce(ca.n, 0) / nc.n::DOUBLE, 6) AS contact_density,
       round(coalesce(hp.n_pairs, 0) / nc.n::DOUBLE, 6) AS packing_density,
       u.n_units / nc.n::DOUBLE AS sasa_per_residue, 'static' AS feature_source
FROM units u JOIN rg USING (structure, frame)
JOIN (SELECT structure, frame, count(DISTINCT res_id) AS n FROM atoms WHERE atom_name = 'CA'
      GROUP BY 1, 2) nc USING (structure, frame)
LEFT JOIN hp USING (structure, frame) LEFT JOIN ca USING (structure, frame)""")
def static_features(spark, d):
    out = J.static_features(S.atoms(spark, d), min_residues=5)
    return out.select("structure", "n_residues", F.round("rg_mean", 6).alias("rg_mean"), "rg_std",
                      F.round("contact_density", 6).alias("contact_density"),
                      F.round("packing_density", 6).alias("packing_density"),
                      "sasa_per_residue", "feature_source")


@query("rmsf")
def rmsf(spark, d):
    return J.rmsf(S.atoms(spark, d), ends=3)


@query("ensemble_routing")
def ensemble_routing(spark, d):
    """Ensemble features for completed structures, static ones of a frame for the others."""
    atoms = S.atoms(spark, d)
    req = atoms.groupBy("structure").agg(F.lit(100).alias("n_requested"))
    static = J.static_features(J.first_frames(atoms), min_residues=5)
    work = atoms.groupBy("structure").agg(F.lit(7).alias("protein_length")).withColumn(
        "status", F.when(F.col("structure").cast("int") % 3 == 0, "failed").otherwise("completed")
    )
    return J.route_source(work, J.ensemble_features(atoms, req), static)
