import pytest
from pyspark.sql import functions as F

from condensq.config import LabelSettings
from condensq.functions import labels as L
from condensq.functions import numeric as N
from condensq.operators import labelling as B
from condensq.operators import tables as T

NAN = float("nan")


def test_unpivot_and_first_values(spark, rows):
    df = spark.createDataFrame(
        [(1, " AT1G00001 ", "one", "n.d.", "AT1G00002", "two", "-1.5"),
         (2, "AT1G00001", "late", "2.5", "header", "x", "9"),
         (3, "at1g00003", "low", "1", "AT1G00001", "dep", "-9")],
        "row int, a string, at string, av string, b string, bt string, bv string")
    long = B.unpivot_blocks(
        df, {"enriched_ns": ["a", "at", "av"], "depleted_ns": ["b", "bt", "bv"]},
        ["gene_id", "description", "log2fc_ns"], "row").withColumn("log2fc_hs", F.lit(None).cast("string"))
    assert long.count() == 4
    out = {r.gene_id: r for r in B.rna_evidence(long).collect()}
    g = out["AT1G00001"]
    assert g.description == "one" and g.log2fc_ns == 2.5 and g.log2fc_hs is None
    assert g.enriched_ns and g.depleted_ns and not g.enriched_hs


def test_threshold_and_strongest_treat_missing_as_zero(spark):
    df = spark.createDataFrame([(None, -0.5), (0.0, None), (None, None)], "a double, b double")
    cols = [F.col("a"), F.col("b")]
    got = df.select(N.any_ge(cols, 0.0), N.strongest_abs(cols)).collect()
    assert [tuple(r) for r in got] == [(False, 0.5), (True, 0.0), (False, 0.0)]


def test_lenient_numbers(spark):
    df = spark.createDataFrame([(" 1.5 ",), ("x",), ("NaN",), (None,), ("-2e3",)], "v string")
    assert [r[0] for r in df.select(N.to_number(F.col("v"))).collect()] == [1.5, None, None, None, -2000.0]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(NAN, "x"), (1.0, None)], "a double, b string")
    assert [tuple(r) for r in N.nan_to_null(df).collect()] == [(None, "x"), (1.0, None)]


CASES = {
    "strongest": [(True, False, "kept_as_positive (enr=2.00 > dep=1.00)"),
                  (False, True, "kept_as_negative (dep=3.00 > enr=0.00)"),
                  (True, False, "kept_as_positive (enr=0.00 > dep=0.00)")],
    "enriched": [(True, False, "kept_as_positive")] * 3,
    "depleted": [(False, True, "kept_as_negative")] * 3,
    "drop": [(False, False, "dropped")] * 3,
}


@pytest.mark.parametrize("strategy", CASES)
def test_conflicts(spark, strategy):
    df = spark.createDataFrame([(0, 2.0, -1.0), (1, -3.0, None), (2, None, None)],
                               "k int, ns double, hs double")
    out = B.resolve_conflicts(df, F.lit(True), F.lit(True), ["ns", "hs"], strategy).orderBy("k")
    got = [(r.keep_pos, r.keep_neg, r.disposition) for r in out.collect()]
    assert got == CASES[strategy]


def test_no_conflict_keeps_both_sides(spark):
    df = spark.createDataFrame([(1.0,)], "ns double")
    r = B.resolve_conflicts(df, F.lit(True), F.lit(False), ["ns"]).first()
    assert r.keep_pos and not r.keep_neg and r.disposition is None
    with pytest.raises(ValueError):
        B.resolve_conflicts(df, F.lit(True), F.lit(True), ["ns"], "guess")


def test_labels_end_to_end(spark, rows):
    rna = spark.createDataFrame(
        [("p", 1.0, 2.0, True, True, False, False), ("n", -1.0, None, False, False, True, False),
         ("x", 5.0, None, True, False, False, False), ("c", 1.0, -4.0, True, False, False, True)],
        "gene_id string, log2fc_ns double, log2fc_hs double, enriched_ns boolean, enriched_hs boolean, "
        "depleted_ns boolean, depleted_hs boolean")
    prot = spark.createDataFrame(
        [("p", "d", 0.0, None, None, None), ("c", "d", None, 1.0, None, None), ("x", "d", -1.0, None, None, None)],
        "gene_id string, description_prot string, log2fc_ap_ns double, log2fc_ap_hs double, "
        "log2fc_pdl_ns double, log2fc_pdl_hs double")
    out = B.build_labels(rna, prot)
    assert rows(out, "gene_id", "class", "condition", "strongest_rna_log2fc") == [
        ("c", 0, "depleted", 4.0), ("n", 0, "depleted", 1.0), ("p", 1, "both", 2.0)]
    assert [r.gene_id for r in B.sort_labelled(out).collect()] == ["p", "c", "n"]
    strict = B.build_labels(rna, prot, LabelSettings(rna_min_abs_log2fc=1.5))
    assert rows(strict, "gene_id") == [("c",), ("p",)]


def test_row_labels(spark):
    df = spark.createDataFrame(
        [(0.75, 1, "DCP1:p, decapping"), (0.55, 0, "VCS:p"), (0.5, 1, " plain "), (0.2, 0, None)],
        "p double, c int, d string")
    p = F.col("p")
    got = df.select(L.confidence(p), L.confidence_symmetric(p), L.decide(p), L.short_name(F.col("d")),
                    L.label_text(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [
        ("high", "High", 1, "DCP1", "enriched"), ("medium", "Medium", 1, "VCS", "not_enriched"),
        ("low", "Low", 1, "plain", "enriched"), ("low", "High", 0, None, "not_enriched")]


def test_quality_flags_and_tiers(spark):
    seqs = [("",), (None,), ("M" * 10,), ("M" * 20 + "." + "M" * 20,), ("M" * 40 + ".",), ("M" * 40,)]
    df = spark.createDataFrame(seqs, "s string")
    assert [r[0] for r in df.select(L.qc_flag(F.col("s"))).collect()] == [
        "no_CDS", "no_CDS", "short_protein", "internal_stop_codon", "pass", "pass"]
    t = spark.createDataFrame([(9.99,), (10.0,), (29.9,), (30.0,)], "v double")
    tier = L.assign_tier(F.col("v"))
    assert [tuple(r) for r in t.select(tier, L.tier_budget(tier)).collect()] == [
        (1, 100), (2, 50), (2, 50), (3, 100)]


def test_ids_and_categories(spark):
    df = spark.createDataFrame([("AT1G01010",), (" AT1G01010 ",), ("AT1G010",), ("ATXG01010",), (None,)], "g string")
    assert [r[0] for r in df.select(L.valid_gene_id(F.col("g"))).collect()] == [
        True, True, False, False, False]
    f = spark.createDataFrame([("di_CG",), ("rg_cv",), ("zzz",)], "f string")
    assert [r[0] for r in f.select(L.feature_category(F.col("f"))).collect()] == [
        "RNA-dinucleotide", "Protein-dynamic", "Other"]


def test_quarantine(spark, rows):
    df = spark.createDataFrame([("AT2G06001",), ("AT2G07002",), ("AT2G07003",), ("AT1G00001",), ("AT1G2",)], "gene_id string")
    ref = spark.createDataFrame(
        [("AT2G07002", "flanking_real_gene"), ("AT2G07003", "ambiguous"), ("AT1G2", "odd")],
        "gene_id string, classification string")
    out = B.quarantine(df, ref)
    assert rows(out, "gene_id", "decision") == [
        ("AT1G00001", "RETAIN"), ("AT1G2", "RETAIN"), ("AT2G06001", "EXCLUDE"),
        ("AT2G07002", "RETAIN"), ("AT2G07003", "HELD_OUT")]
    parts = B.quarantine_outputs(out)
    assert {k: v.count() for k, v in parts.items()} == {"clean": 3, "excluded": 1, "held_out": 1}


def test_feature_columns_refuse_label_signals(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3, "x", 1, 0.1)],
                               "au_content double, log2fc_ns double, class int, name string, n int, dPSI double")
    assert T.feature_columns(df) == ["au_content", "n"]
    assert T.feature_columns(df, drop=["n"]) == ["au_content"]


def test_table_operators(spark, rows):
    a = spark.createDataFrame([("k1", 1, "old"), ("k2", 2, "old"), ("k3", 3, "old")], "k string, v int, s string")
    new = spark.createDataFrame([("k1", 10, None, None), ("k2", 20, "new", "bad")],
                                "k string, v int, s string, error string")
    got = T.patch(a, new, "k", ["v", "s"], F.col("error").isNull())
    assert sorted(map(tuple, got.collect())) == [("k1", 10, None), ("k2", 2, "old"), ("k3", 3, "old")]
    assert rows(T.enrich(a, new, "k"), "k", "v", "error")[1] == ("k2", 2, "bad")
    m = spark.createDataFrame([("k1", "A")], "k string, name string")
    assert rows(T.map_values(a, m, "k", "name", "?"), "k", "name") == [
        ("k1", "A"), ("k2", "?"), ("k3", "?")]
    with pytest.raises(ValueError):
        T.assert_unique(a.unionByName(a), ["k"])
    assert T.assert_unique(a, ["k"]) is a


def test_fallback_lookup_order(spark, rows):
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "id string")
    m1 = spark.createDataFrame([("a", "first")], "key string, value string")
    m2 = spark.createDataFrame([("a", "second"), ("b", "second")], "key string, value string")
    out = T.lookup_fallback(ids, [(m1, F.col("id")), (m2, F.col("id"))], "id", "acc")
    got = sorted(map(tuple, out.select("id", "acc", "matched_by").collect()), key=str)
    assert got == [("a", "first", 0), ("a", "first", 0), ("b", "second", 1), ("c", None, None)]
