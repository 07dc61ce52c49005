import json

import pytest
from pyspark.sql import functions as F

from condensq.plans import analytics, marts
from condensq.schemas import GENES, STAR
from condensq.sources import records as R
from condensq.sources import tables as T


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_typed_and_inferred_csv(spark, tmp_path):
    p = write(tmp_path / "t.csv", "gene_id,v,n\na,1.5,3\nb,NaN,\n")
    typed = T.read_table(spark, p, "gene_id string, v double, n int")
    assert [tuple(r) for r in typed.collect()] == [("a", 1.5, 3), ("b", None, None)]
    assert dict(T.read_table(spark, p).dtypes)["n"] == "int"
    T.write_table(typed, str(tmp_path / "out"))
    assert T.read_table(spark, str(tmp_path / "out")).count() == 2
    T.write_table(typed, str(tmp_path / "o.csv"), kind="csv")
    assert T.read_table(spark, str(tmp_path / "o.csv")).count() == 2


HEAD = "ID\tGeneID\tgeneSymbol\tchr\tstrand\t{}\tIncLevelDifference\tPValue\tFDR\n"


def test_splice_events(spark, tmp_path):
    write(tmp_path / "hs/SE.MATS.JC.txt", HEAD.format("exonStart_0base\texonEnd")
          + '1\t"AT1G1"\t"GAMMA "x" Y"\tchr1\t+\t99\t200\t-0.5\t0.01\tNA\n'
          + '2\t"AT9G9"\tz\tchr1\t+\t1\t2\t0.5\t0.01\t0.5\n')
    write(tmp_path / "ns/MXE.MATS.JC.txt",
          HEAD.format("1stExonStart_0base\t1stExonEnd\t2ndExonStart_0base\t2ndExonEnd")
          + '7\t"AT1G1"\tg\t1\t-\t9\t20\t29\t40\tnan\t1\t1\n')
    write(tmp_path / "ns/RI.MATS.JC.txt", HEAD.format("upstreamEE\tdownstreamES")
          + '8\tAT1G1\tg\t1\t-\t50\t80\t0.2\t1\t1\n')
    genes = spark.createDataFrame([("AT1G1",)], "gene_id string")
    out = T.read_events(spark, {"HS": str(tmp_path / "hs"), "NS": str(tmp_path / "ns")}, genes)
    got = {r.event_id: r for r in out.collect()}
    assert set(got) == {"HS:SE:1", "NS:MXE:7", "NS:RI:8"}
    se, mxe, ri = got["HS:SE:1"], got["NS:MXE:7"], got["NS:RI:8"]
    assert (se.region1_start, se.region1_end, se.region2_start, se.dpsi, se.fdr) == (100, 200, None, -0.5, None)
    assert (mxe.region1_start, mxe.region2_start, mxe.region2_end, mxe.dpsi) == (10, 30, 40, None)
    assert (ri.region1_start, ri.region1_end) == (51, 80)
    assert T.read_events(spark, {"HS": str(tmp_path / "none")}) is None


GTF = """#!genome
1\tsrc\tgene\t1\t900\t.\t+\t.\tgene_id "g1"; gene_biotype "x";
1\tsrc\ttranscript\t1\t900\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; tag "basic"; tag "Ensembl_canonical";
1\tsrc\texon\t1\t300\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; exon_number "1";
1\tsrc\texon\t5\t9\t.\t+\t.\tgene_id "g1"; transcript_id "t2";
2\tsrc\tgene\t1\t9\t.\t-\t.\tgene_id "g2";
2\tsrc\texon\t1\t9\t.\t-\t.\tgene_id "g2"; transcript_id "u1";
short\tline
"""


def test_annotation(spark, tmp_path, rows):
    p = write(tmp_path / "a.gtf", GTF)
    ann = R.read_annotation(spark, p)
    assert ann.count() == 6
    tx = ann.where("feature = 'transcript'").first()
    assert tx.attrs["transcript_id"] == "t1" and tx.attrs["tag"] == "basic,Ensembl_canonical"
    assert R.read_annotation(spark, p, ["exon"]).count() == 3
    want = spark.createDataFrame([("t1",), ("t9",)], "transcript_id string")
    kept, missing = R.filter_annotation(ann, want)
    assert rows(kept, "feature", "start", "end") == [("exon", 1, 300), ("gene", 1, 900), ("transcript", 1, 900)]
    assert rows(missing) == [("t9",)]


FASTA = ">g1|t1|class1|HS\nATGC\nttaa\n>g2|t2|class0|NS|QC_FAIL:no_CDS\nAAA\n>g3\n"


def test_fasta_roundtrip(spark, tmp_path, rows):
    df = R.read_fasta(spark, write(tmp_path / "s.fa", FASTA))
    assert rows(df, "gene_id", "class", "qc_fail", "seq") == [
        ("g1", 1, False, "AUGCUUAA"), ("g2", 0, True, "AAA"), ("g3", 0, False, "")]
    long = df.where("gene_id <> 'g3'").withColumn("seq", F.repeat("seq", 30)).withColumn(
        "qc_flag", F.when(F.col("qc_fail"), "no_CDS").otherwise("pass"))
    out = str(tmp_path / "fa")
    R.write_fasta(long, out)
    one = spark.read.text(f"{out}/class=1")
    assert max(len(r.value) for r in one.collect()) == 80
    again = R.read_fasta(spark, f"{out}/class=*")
    assert rows(again, "gene_id", "class", "seq") == rows(long, "gene_id", "class", "seq")
    assert rows(again, "gene_id", "qc_fail") == [("g1", False), ("g2", True)]


def test_score_records(spark, tmp_path):
    p = write(tmp_path / "s.txt", "# logo\n#\n# Position\tResidue\tScore\n#>t1 extra\n1\tM\t0.95\n2\tS\tbad\n"
              "3\tS\n# note\n4\tK\t0.5\n#>t2\n\n1\tM\t0.1\n#>t3\n")
    got = {r.tx_id: r.scores for r in R.read_score_records(spark, p).collect()}
    assert got == {"t1": [0.95, 0.5], "t2": [0.1]}


def test_fold_lines(spark):
    df = spark.createDataFrame([("((...)) ( -1.20)",), ("(((....))) (-12.3)",), ("....",)], "line string")
    a, b, c = R.parse_fold_lines(df).collect()
    assert (a.structure, a.mfe, a.n_stemloops) == ("((...))", -1.2, 1)
    assert b.mfe == -12.3 and b.mfe_per_nt == pytest.approx(-1.23)
    assert c.mfe is None and c.frac_paired == 0.0


def test_cluster_blocks(spark, tmp_path, rows):
    p = write(tmp_path / "c.clstr", ">Cluster 0\n0\t351aa, >g1|t1.1|class1|HS... *\n1\t120aa, >g2|t2.1|class0|NS... at 55%\n"
              ">Cluster 12\n0\t99aa, >plain... *\n")
    assert rows(R.read_clusters(spark, p), "cluster_id", "transcript_id") == [
        (0, "t1.1"), (0, "t2.1"), (12, "plain")]


def test_state_files(spark, tmp_path, rows):
    a = write(tmp_path / "a.json", json.dumps({"k1": {"status": "failed", "error": "x"}, "k2": {"status": "completed", "runtime_sec": 2.5}}))
    b = write(tmp_path / "b.json", json.dumps({"k1": {"status": "completed"}}))
    assert rows(T.read_state(spark, [a, b]), "key", "status", "runtime_sec") == [
        ("k1", "completed", None), ("k2", "completed", 2.5)]
    c = write(tmp_path / "c.json", '{"k3": {"status": "running"}}\n{"k4": {"status": "failed"}}\n')
    assert rows(T.read_state(spark, [c], lines=True), "key", "status") == [("k3", "running"), ("k4", "failed")]


def test_sql_over_a_file(spark, tmp_path):
    p = write(tmp_path / "i.csv", "feature,mean_abs_shap,rank\na,0.123456,2\nb,0.9,1\n")
    out = T.query_csv(spark, p, "SELECT feature, round(mean_abs_shap, 4) AS m FROM csv ORDER BY rank LIMIT 15")
    assert [tuple(r) for r in out.collect()] == [("b", 0.9), ("a", 0.1235)]
    imp = T.read_table(spark, p)
    assert [r.feature for r in analytics.q_top_importance(imp, 1).collect()] == ["b"]


@pytest.fixture
def star(spark):
    iso = spark.createDataFrame(
        [("g1", "g1.2", 1, "HS", "DCP1:p, x", 2), ("g1", "g1.1", 1, "HS", "DCP1:p, x", 1), ("g2", "g2.1", 0, "NS", None, 3)],
        "gene_id string, transcript_id string, class int, condition string, description_prot string, ord int")
    tiers = spark.createDataFrame([("g1", 2)], "gene_id string, tier int")
    splits = spark.createDataFrame([("g1", "test"), ("g2", "train")], "gene_id string, split string")
    genes = marts.build_genes(iso, tiers, splits, "ord")
    matrix = spark.createDataFrame([("g1", 1, 100.0, float("nan")), ("g2", 2, 200.0, 0.5)],
                                   "gene_id string, ord int, mrna_length double, idr_percent double")
    feats, missing = marts.build_features(matrix, "ord")
    preds = spark.createDataFrame([(10, "g1", 0.9, 1), (11, "g2", 0.3, 0)], "row_id long, gene_id string, prob_pos double, pred int")
    attrs = spark.createDataFrame([(10, "di_CG", 0.25)], "row_id long, feature string, attribution double")
    return {"genes": genes, "features": feats, "predictions": marts.build_predictions(preds, attrs)}, missing


def test_star_roundtrip(spark, tmp_path, star, rows):
    tables, missing = star
    assert "rmsf_mean" in missing and "mrna_length" not in missing
    assert rows(tables["genes"], "gene_id", "transcript_id", "gene_name", "split") == [
        ("g1", "g1.1", "DCP1", "test"), ("g2", "g2.1", None, "train")]
    path = str(tmp_path / "star")
    T.write_star(tables, path)
    T.write_star(tables, path)  # rebuilds from scratch
    T.register_star(spark, path, "z")
    r = spark.sql("SELECT * FROM z_features WHERE gene_id = 'g1'").first()
    assert r.mrna_length == 100.0 and r.idr_percent is None and r.rmsf_mean is None
    assert spark.table("z_genes").schema.names == GENES.names and set(STAR) == {"genes", "features", "predictions"}
    hit = analytics.lookup_sql(spark, " G1 ".lower().upper(), "z_predictions")
    assert hit.isEmpty()  # ids are stored in lower case here
    assert spark.sql("SELECT count(*) FROM z_predictions JOIN z_genes USING (gene_id)").first()[0] == 2
    assert T.star_violations(*[spark.table(f"z_{n}") for n in STAR]).isEmpty()
    with pytest.raises(ValueError):
        T.register_star(spark, path, "z; drop")


def test_star_violations(spark, star):
    tables, _ = star
    orphan = spark.createDataFrame([("gX", 0.5, 1)], "gene_id string, prob_pos double, pred int")
    bad = T.star_violations(tables["genes"].unionByName(tables["genes"].limit(1)), tables["features"], orphan)
    assert {r.problem for r in bad.collect()} == {"genes: duplicate or missing key", "predictions: no such gene"}


def test_reports(spark, tmp_path, star):
    tables, _ = star
    preds = tables["predictions"].join(tables["genes"].select("gene_id", "class"), "gene_id")
    land = marts.landscape(preds.select("gene_id", "class", "prob_pos", "pred"), tables["features"])
    r = {x.gene_id: x for x in land.collect()}
    assert r["g1"].class_label == "P-body enriched" and r["g2"].confidence == "Low (<0.55)"
    imp = spark.createDataFrame([("a", 1.0)], "feature string, m double")
    T.export_bi(imp, land, imp, str(tmp_path / "bi"))
    assert spark.read.option("header", True).csv(str(tmp_path / "bi/probability_landscape")).count() == 2


def test_annotation_lines_are_taken_apart_once_a_scan(spark, tmp_path):
    """Three scans (lines, genes of the lines, gene lines) parse a line once each; one more parse is that
    of gene lines alone. Null ids match nothing."""
    lines = [
        'c\ts\tgene\t1\t9\t.\t+\t.\tgene_id "g1"; tag "a"; tag "b";', 'c\ts\tgene\t1\t9\t.\t+\t.\ttag "x";',
        'c\ts\texon\t1\t5\t.\t+\t.\tgene_id "g1"; transcript_id "t1";', 'c\ts\texon\t2\t5\t.\t+\t.\ttag "x";',
        'c\ts\texon\t3\t5\t.\t+\t.\ttranscript_id "t1";', 'c\ts\texon\t4\t5\t.\t+\t.\tgene_id "g2"; transcript_id "t2";',
    ]
    (tmp_path / "a.gtf").write_text("\n".join(lines))
    want = spark.createDataFrame([("t1",), ("t9",), (None,)], "transcript_id string")
    kept, missing = R.filter_annotation(R.read_annotation(spark, str(tmp_path / "a.gtf")), want)
    assert sorted((r.feature, r.start) for r in kept.collect()) == [("exon", 1), ("exon", 3), ("gene", 1)]
    assert [r.attrs for r in kept.collect() if r.feature == "gene"] == [{"gene_id": "g1", "tag": "a,b"}]
    assert {r.transcript_id for r in missing.collect()} == {"t9", None}
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 4
