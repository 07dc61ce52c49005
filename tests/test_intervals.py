import random

import pytest
from pyspark.sql import functions as F

from condensq.operators import intervals as I
from condensq.operators import transcripts as T


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(11)

    def make(n, base):
        out = []
        for i in range(n):
            s = rng.randint(1, 900)
            # Most rows share one key; lengths run from a point to many bins.
            g = "hot" if rng.random() < 0.6 else rng.choice("ab")
            out.append((base + i, g, s, s + rng.choice([0, 1, 5, 30, 250])))
        return out

    left, right = make(150, 0), make(120, 1000)
    ldf = spark.createDataFrame(left, "l int, g string, l_start int, l_end int")
    rdf = spark.createDataFrame(right, "r int, g string, r_start int, r_end int")
    return left, right, ldf, rdf


@pytest.mark.parametrize("width", [7, 100, 5000])
@pytest.mark.parametrize("k", [1, 10])
def test_overlap_matches_all_pairs(sides, rows, width, k):
    left, right, ldf, rdf = sides
    want = sorted((a, b) for a, g, s, e in left for b, h, t, f in right
                  if g == h and min(e, f) - max(s, t) + 1 >= k)
    assert rows(I.interval_overlap(ldf, rdf, ["g"], k, width), "l", "r") == want


@pytest.mark.parametrize("width", [7, 100])
@pytest.mark.parametrize("slack", [0, 2])
def test_containment_matches_all_pairs(sides, rows, width, slack):
    left, right, ldf, rdf = sides
    want = sorted((a, b) for a, g, s, e in left for b, h, t, f in right
                  if g == h and s <= t + slack and e >= f - slack
                  and min(t + slack, f - slack) <= e and max(t + slack, f - slack) >= s)
    assert rows(I.interval_contains(ldf, rdf, ["g"], slack, width), "l", "r") == want


def test_unkeyed_overlap(sides, rows):
    left, right, ldf, rdf = sides
    want = sorted((a, b) for a, _, s, e in left for b, _, t, f in right if min(e, f) >= max(s, t))
    assert rows(I.interval_overlap(ldf.drop("g"), rdf.drop("g"), [], 1, 64), "l", "r") == want


def test_coordinates_and_contigs(spark):
    df = spark.createDataFrame([("chr1", 0), ("Chr2", 5), ("3", 9), ("ChrM", 1)], "c string, start int")
    got = I.to_one_based(df).select(I.normalise_contig(F.col("c")), "start").collect()
    assert [tuple(r) for r in got] == [("1", 1), ("2", 6), ("3", 10), ("M", 2)]


META = "gene_id string, transcript_id string, n_exons long, biotype string, is_canonical boolean, ord long"


def test_canonical_choice_follows_the_sum(spark, rows):
    meta = spark.createDataFrame(
        [("g", "t1", 3, "lncRNA", True, 1), ("g", "t2", 9, "protein_coding", False, 2),
         ("g", "t3", 2, "protein_coding", True, 3), ("h", "u1", 4, "x", False, 1),
         ("h", "u2", 4, "x", False, 2)], META)
    assert rows(T.canonical_transcript(meta), "gene_id", "transcript_id") == [("g", "t3"), ("h", "u1")]


@pytest.fixture(scope="module")
def splice(spark):
    exons = spark.createDataFrame(
        [("g", "t1", "1", 100, 200), ("g", "t2", "1", 100, 400), ("g", "t3", "1", 500, 600),
         ("k", "s1", "2", 10, 90)],
        "gene_id string, transcript_id string, contig string, start long, end long")
    events = spark.createDataFrame(
        [("g", "e1", "SE", "NS", "chr1", 700, 800, None, None, 0.9),   # nothing overlaps
         ("g", "e2", "RI", "HS", "chr1", 201, 398, None, None, -0.5),  # only t2 spans it
         ("g", "e3", "SE", "NS", "chr1", 150, 160, None, None, 0.5),   # tie, but not HS
         ("g", "e4", "MXE", "HS", "chr1", 900, 950, 505, 520, 0.1)],
        "gene_id string, event_id string, event_type string, condition string, contig string, "
        "region1_start long, region1_end long, region2_start long, region2_end long, dpsi double")
    meta = spark.createDataFrame(
        [("g", "t1", 2, "protein_coding", True, 1), ("g", "t2", 5, "x", False, 2),
         ("g", "t3", 1, "x", False, 3), ("k", "s1", 1, "x", False, 4)], META)
    return exons, events, meta


def test_event_matches_and_first_event(splice, rows):
    exons, events, meta = splice
    hits = T.event_matches(exons, events)
    assert rows(hits, "event_id", "transcript_id") == [
        ("e2", "t2"), ("e3", "t1"), ("e3", "t2"), ("e4", "t3")]
    first = T.first_matching_event(hits, meta).collect()
    assert [(r.gene_id, r.event_id, r.transcript_id, r.isoform_source) for r in first] == [
        ("g", "e2", "t2", "event_RI_overlap")]


def test_isoform_map_falls_back_and_drops(spark, splice, rows):
    exons, events, meta = splice
    lab = spark.createDataFrame([("g", 1), ("k", 0), ("none", 1)], "gene_id string, class int")
    out = T.map_isoforms(lab, events, exons, meta)
    assert rows(out, "gene_id", "transcript_id", "isoform_source", "n_events") == [
        ("g", "t2", "event_RI_overlap", 4), ("k", "s1", "canonical_fallback", 0)]


def test_candidate_count_in_source(splice):
    exons, events, meta = splice
    hits = T.event_matches(exons, events.where("event_id = 'e3'"))
    r = T.first_matching_event(hits, meta).first()
    assert r.isoform_source == "event_SE_overlap_2candidates" and r.transcript_id == "t1"


def test_spliced_sequence_across_tiles(spark, rows):
    text = "".join(random.Random(1).choice("ACGT") for _ in range(95))
    contigs = spark.createDataFrame([("c", text)], "contig string, seq string")
    exons = spark.createDataFrame(
        [("p", "c", "+", 31, 58), ("p", "c", "+", 3, 12), ("m", "c", "-", 5, 14), ("m", "c", "-", 60, 95)],
        "transcript_id string, contig string, strand string, start long, end long")
    got = dict(rows(T.spliced_sequence(exons, T.tile_contigs(contigs, 10), 10)))
    rna = text.replace("T", "U")
    assert got["p"] == rna[2:12] + rna[30:58]
    minus = rna[4:14] + rna[59:95]
    assert got["m"] == minus[::-1].translate(str.maketrans("ACGU", "UGCA"))


def test_annotation_summaries(spark, rows):
    ann = spark.createDataFrame(
        [("transcript", 1, 90, {"gene_id": "g", "transcript_id": "t", "transcript_biotype": "protein_coding",
                                "tag": "basic,Ensembl_canonical"}),
         ("exon", 1, 40, {"gene_id": "g", "transcript_id": "t"}),
         ("exon", 60, 90, {"gene_id": "g", "transcript_id": "t"}),
         ("five_prime_utr", 1, 10, {"transcript_id": "t"}), ("CDS", 11, 40, {"transcript_id": "t"}),
         ("CDS", 60, 70, {"transcript_id": "t"}), ("three_prime_UTR", 71, 90, {"transcript_id": "t"}),
         ("CDS", 5, 6, {"transcript_id": "other"})],
        "feature string, start long, end long, attrs map<string,string>",
    ).withColumns({"seqname": F.lit("1"), "strand": F.lit("+")})
    m = T.transcript_meta(ann).first()
    assert (m.n_exons, m.is_canonical, m.biotype, m.tx_start, m.tx_end) == (
        2, True, "protein_coding", 1, 90)
    only = spark.createDataFrame([("t",)], "transcript_id string")
    assert rows(T.region_lengths(ann, only)) == [("t", 10, 41, 20)]


def test_lines_of_a_transcript_meet_before_they_are_sorted(spark):
    """Texts need a sort-based aggregate; it sorts a share of the transcripts, not a split of the file."""
    ann = spark.range(50).selectExpr(
        "CASE WHEN id % 5 = 0 THEN 'transcript' ELSE 'exon' END AS feature", "id AS start", "id + 9 AS end",
        "'1' AS seqname", "'+' AS strand",
        "map('gene_id', string(id % 3), 'transcript_id', string(id % 10), 'transcript_biotype', 'x') AS attrs",
    )
    out = T.transcript_meta(ann)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.rindex("Aggregate") < plan.index("Exchange hash")
    assert sum(r.n_exons for r in out.collect()) == 40


def test_matches_are_dealt_by_transcript(spark, splice, rows):
    """Matches meet the transcripts without another shuffle; repeated rows and rows without a
    transcript stay one each."""
    exons, events, meta = splice
    none = exons.where("transcript_id = 't1'").selectExpr(
        "gene_id", "CAST(NULL AS string) AS transcript_id", "contig", "start", "end")
    many = exons.unionByName(exons).unionByName(none).unionByName(none)
    hits = T.event_matches(many, events.unionByName(events))
    assert sorted(map(str, hits.select("event_id", "transcript_id").collect())) == sorted(
        f"Row(event_id='{e}', transcript_id={t!r})"
        for e, t in [("e2", "t2"), ("e3", "t1"), ("e3", "t2"), ("e3", None), ("e4", "t3")])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        hits = T.event_matches(exons, events)
        assert shuffles(hits.join(meta.drop("gene_id"), "transcript_id")) == shuffles(hits) + 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
