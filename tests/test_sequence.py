import pytest
from pyspark.sql import functions as F

from condensq.functions import sequence as Q

DNA = "ATGCTAGCTAGCTAGCTAGCATCGATCGATCGATCGACTAGCTAGCATCGA" * 4
BASE_FEATURES = 63


def one(spark, text, aa=0):
    df = spark.createDataFrame([(text, aa)], "t string, aa int")
    df = df.withColumn("seq", Q.to_rna(F.col("t")))
    return Q.sequence_features(df, "seq", F.col("aa")).first().asDict()


def test_alphabet_and_fractions(spark):
    r = one(spark, DNA.lower())
    assert r["seq"] == DNA.replace("T", "U")
    assert r["fA"] + r["fU"] + r["fG"] + r["fC"] == pytest.approx(1)
    assert r["au_content"] + r["gc_content"] == pytest.approx(1)
    assert sum(v for k, v in r.items() if k.startswith("di_")) == pytest.approx(1)


@pytest.mark.parametrize("text", ["AAAA", "AACAAAGA", "UUUAUUU", "GGNGG", "A", "", "NNNN", "CGCG"])
def test_overlapping_pairs_match_a_count(spark, text):
    r = one(spark, text)
    for a in "AUGC":
        for b in "AUGC":
            n = sum(text[i:i + 2] == a + b for i in range(len(text) - 1))
            assert r[f"di_{a}{b}"] == pytest.approx(n / (len(text) - 1) if len(text) > 1 else 0)


def test_motifs(spark):
    assert one(spark, "GGACUGGACUGGACU")["rrach_count"] == 3
    assert one(spark, "GGACU" * 200)["rrach_per_kb"] == pytest.approx(200)
    assert one(spark, "AAACA" + "G" * 10)["aaach_count"] == 1


def test_empty_sequence_has_no_fractions(spark):
    r = one(spark, "")
    assert r["fA"] is None and r["mrna_length"] == 0
    assert r["rrach_count"] == 0 and r["rrach_per_kb"] == 0.0 and r["utr3_length"] == 0


def test_region_estimates(spark):
    assert one(spark, "A" * 1000)["cds_length"] == 550
    assert one(spark, "A" * 1000)["utr5_length"] == 100
    assert one(spark, "A" * 300, 200)["utr5_length"] == 0
    r = one(spark, "A" * 3000, 300)
    assert (r["cds_length"], r["utr5_length"], r["utr3_length"]) == (903, 300, 1797)


def test_tail_stand_in(spark):
    df = spark.createDataFrame([("A" * 3579, 0), ("G" * 100 + "AU" * 10, 20)], "seq string, l int")
    got = Q.add_tail(df, "seq", F.col("l")).collect()
    assert got[0]["utr3_length"] == 715 and got[0]["utr3_estimated"]
    assert got[1]["utr3_au_content"] == 1.0 and not got[1]["utr3_estimated"]


def test_normalised_lengths_match_stored_rows(spark):
    df = spark.createDataFrame([(3579, 715, 0, 0, 22), (975, 195, 972, 0, 22)],
                               "mrna_length int, utr3_length int, cds_length int, utr5_length int, "
                               "n_stemloops int")
    a, b = Q.length_normalise(df).collect()
    assert a["utr3_fraction"] == pytest.approx(0.1997764738753842, abs=1e-15)
    assert b["cds_fraction"] == pytest.approx(0.9969230769230768, abs=1e-15)
    assert b["n_stemloops_per_kb"] == pytest.approx(22.56410256410257, abs=1e-12)


def test_decay_flags(spark):
    df = spark.createDataFrame([(500, 2000, 165), (0, 10, 50), (900, 10, 100), (30, 5, 5)],
                               "cds int, utr3 int, aa int")
    flags = Q.decay_flags(F.col("cds"), F.col("utr3"), F.col("aa"))
    got = df.select(*[c.alias(n) for n, c in flags.items()]).collect()
    assert [tuple(r) for r in got] == [(2, 1, 0), (-1, 0, 0), (597, 0, 1), (12, 0, 0)]


def test_engineered_features_and_missing_values(spark):
    df = spark.createDataFrame(
        [(10.0, 5.0, 20.0, 50.0, 10, 999, 0.6, 200), (None, 5.0, 20.0, None, 10, 999, 0.6, 200)],
        "rmsf_nterm50 double, rmsf_cterm50 double, packing_density double, idr_percent double, "
        "rrach_count int, cds_length int, utr3_au_content double, utr3_length int")
    a, b = Q.engineer_features(df).collect()
    assert a["rmsf_nterm_cterm_ratio"] == pytest.approx(10 / 5.1)
    assert a["packing_x_idr"] == pytest.approx(10) and a["rrach_per_cds_kb"] == pytest.approx(10)
    assert a["utr3_au_x_length"] == pytest.approx(120)
    assert b["rmsf_nterm_cterm_ratio"] is None and b["packing_x_idr"] is None
    assert Q.engineer_features(df, "percent").first()["packing_x_idr"] == pytest.approx(1000)


def test_fold_features(spark):
    df = spark.createDataFrame([("((...))..(..)", -3.0), ("....", 0.0)], "s string, e double")
    f = Q.fold_features(F.col("s"), F.col("e"))
    a, b = df.select(*[c.alias(n) for n, c in f.items()]).collect()
    assert a["n_stemloops"] == 2 and a["frac_paired"] == round(6 / 13, 4)
    assert a["mfe_per_nt"] == pytest.approx(-3 / 13) and b["mfe_per_nt"] is None


def test_header_roundtrip(spark):
    df = spark.createDataFrame([("g", "t.1", 1, "HS", "pass"), ("g", "t.2", 0, "NS", "no_CDS")],
                               "g string, t string, c int, k string, f string")
    h = df.select(Q.make_header(*[F.col(c) for c in "gtckf"]).alias("h"))
    assert [r.h for r in h.collect()] == ["g|t.1|class1|HS", "g|t.2|class0|NS|QC_FAIL:no_CDS"]
    got = h.select(*[c.alias(n) for n, c in Q.parse_header(F.col("h")).items()]).collect()
    assert [(r["class"], r["qc_fail"]) for r in got] == [(1, False), (0, True)]
    odd = spark.createDataFrame([("x|y|classZ",), ("only",)], "h string")
    got = odd.select(*[c.alias(n) for n, c in Q.parse_header(F.col("h")).items()]).collect()
    assert [(r["class"], r["condition"]) for r in got] == [(-1, ""), (0, "")]


def test_wrap_complement_translate(spark):
    df = spark.createDataFrame([("A" * 160, "AUGGCCUAAG")], "a string, b string")
    r = df.select(Q.wrap(F.col("a")).alias("w"), Q.reverse_complement(F.col("b")).alias("rc"),
                  Q.translate_cds(F.col("b")).alias("aa")).first()
    assert r.w == "A" * 80 + "\n" + "A" * 80
    assert r.rc == "CUUAGGCCAU" and r.aa == "MA."
    assert Q.codon_table()["UGG"] == "W" and len(Q.codon_table()) == 64


def test_request_features_are_complete(spark):
    df = spark.createDataFrame([(DNA, "MKPGF" * 10), (DNA, None)], "mrna_seq string, protein_seq string")
    out = Q.compute_features(df)
    names = [c for c in out.columns if c not in ("mrna_seq", "protein_seq")]
    assert len(names) == BASE_FEATURES
    a, b = out.collect()
    assert a["cds_length"] == 153 and b["cds_length"] == int(len(DNA) * 0.55)
    assert a["rmsf_mean"] is None and a["packing_x_idr"] is None and a["rrach_per_cds_kb"] is not None
