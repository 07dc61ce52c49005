import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from condensq.operators import lookup as Q
from condensq.operators import retrieval as P
from condensq.operators import similarity as M


def test_fixed_chunks(spark):
    df = spark.createDataFrame([(1, "x" * 1700), (2, "ab"), (3, "")], "k int, t string")
    got = {(r.k, r.chunk): len(r.chunk_text) for r in P.chunk_fixed(df, "k", "t").collect()}
    assert got == {(1, 0): 1000, (1, 1): 900, (1, 2): 100, (2, 0): 2}


def test_recursive_chunks(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(900)]
    text = "\n\n".join(
        ". ".join(" ".join(words[i + j:i + j + 9]) for j in range(0, 90, 9)) for i in range(0, 900, 90))
    df = spark.createDataFrame([(1, text), (2, "y" * 250), (3, None), (4, "short text")], "k int, t string")
    out = P.chunk_text(df, "k", "t", 100, 20).collect()
    by = {k: [r.chunk_text for r in sorted(out, key=lambda r: r.chunk) if r.k == k] for k in (1, 2, 3, 4)}
    assert all(len(c) <= 100 for v in by.values() for c in v)
    # No word is lost, and every chunk is a piece of the text.
    assert all(c in text for c in by[1])
    pos = 0
    for c in by[1]:
        at = text.find(c, max(0, pos - 120))
        assert text[pos:at].strip(" .\n") == "" if at > pos else True
        pos = at + len(c)
    assert text[pos:].strip() == ""
    assert "".join(by[2])[:100] == "y" * 100 and len(by[2]) >= 3
    assert by[3] == [] and by[4] == ["short text"]


def test_overlap_between_chunks():
    pieces = [f"w{i:02d} " for i in range(30)]
    chunks = P.pack(pieces, 40, 12)
    for a, b in zip(chunks, chunks[1:]):
        assert b.startswith(a[-3:]) or b.split()[0] in a.split()


def vectors(spark, n, name, seed):
    v = np.random.default_rng(seed).normal(size=(n, 8))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    return v, spark.createDataFrame(rows, f"{name} long, embedding array<float>")


@pytest.mark.parametrize("limit", [1000, 0])
def test_top_k_is_exact_on_both_paths(spark, limit):
    qv, q = vectors(spark, 40, "query_id", 1)
    cv, c = vectors(spark, 300, "chunk_id", 2)
    qv, cv = np.float32(qv).astype(float), np.float32(cv).astype(float)
    sim = (qv / np.linalg.norm(qv, axis=1, keepdims=True)) @ (cv / np.linalg.norm(cv, axis=1, keepdims=True)).T
    out = P.top_k(q, c.repartition(5), 4, digits=None, max_broadcast=limit, block=16, corpus_block=64).collect()
    assert len(out) == 160
    for r in out:
        assert r.chunk_id == np.argsort(-sim[r.query_id])[r["rank"] - 1]
        assert r.score == pytest.approx(sim[r.query_id, r.chunk_id])


def test_top_k_with_few_chunks_and_ties(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    c = spark.createDataFrame([(9, [2.0, 0.0]), (3, [5.0, 0.0]), (4, [0.0, 0.0])], "chunk_id long, embedding array<float>")
    got = [(r["rank"], r.chunk_id, r.score) for r in P.top_k(q, c, 5).orderBy("rank").collect()]
    assert got == [(1, 3, 1.0), (2, 9, 1.0), (3, 4, 0.0)]
    assert P.top_k(q.limit(0), c, 5).isEmpty()


def test_dedupe_and_reranking(spark, rows):
    hits = spark.createDataFrame([(1, 1, 10, 0.9, "t"), (1, 2, 11, 0.8, "t"), (1, 3, 12, 0.7, "u")],
                                 "query_id long, rank int, chunk_id long, score double, text string")
    assert rows(P.dedupe_hits(hits), "rank", "chunk_id", "text") == [(1, 10, "t"), (2, 12, "u")]


def test_retrieval_only_above_the_bound(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "query_id long, embedding array<float>")
    c = spark.createDataFrame([(7, [1.0, 0.0])], "chunk_id long, embedding array<float>")
    df = spark.createDataFrame([(1, 0.8), (2, 0.81)], "query_id long, prob_pos double")
    got = {r.query_id: (r.route, r.chunk_id) for r in P.retrieve_if(df, q, c).collect()}
    assert got == {1: ("skip", None), 2: ("retrieve", 7)}


def test_shorten(spark):
    import textwrap

    texts = ["a  b\n c", "word " * 100, "x" * 500, " ".join(["abc"] * 100), "abcd " * 79 + "abcde"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", P.shorten(F.col("t")).alias("s")).collect():
        assert r.s == textwrap.shorten(texts[r.i], 400, placeholder="…")


def test_question_and_evidence(spark):
    items = "array<struct<feature:string,value:double,attribution:double>>"
    a = spark.createDataFrame(
        [("g", [("x", 1.0, 0.1), ("y", 1.0, -0.5), ("z", 1.0, 0.3), ("w", 1.0, 0.2)]), ("h", [])],
        f"gene_id string, attributions {items}")
    text = [r[0] for r in a.select(P.build_query(F.col("gene_id"), F.col("attributions"))).collect()]
    assert "features y, z, w heat" in text[0] and "mRNA sequence features" in text[1]
    ids = a.select("gene_id")
    preds = spark.createDataFrame([("g", 0.9)], "gene_id string, prob_pos double")
    hits = spark.createDataFrame([("g", r, "s", r, 0.5, "t " * r) for r in (4, 2, 1, 3)],
                                 "gene_id string, rank int, source string, page int, score double, text string")
    out = {r.gene_id: r for r in P.evidence_table(ids, preds, a, hits).collect()}
    assert [p["rank"] for p in out["g"].passages] == [1, 2, 3]
    assert [s.feature for s in out["g"].attributions] == ["y", "z", "w", "x"]
    assert out["h"].prob_pos is None and out["h"].passages is None


def test_embeddings_have_unit_length(spark):
    df = spark.createDataFrame([(1, "red blue"), (2, "blue green green")], "chunk_id long, t string")
    out, model = P.embed_tfidf(df, "t", 64)
    norms = [sum(x * x for x in r.embedding) for r in out.collect()]
    assert all(n == pytest.approx(1, abs=1e-5) or n == 0 for n in norms)
    enc = P.embed_with(df, "t", lambda ts: [[len(t), 1.0] for t in ts]).collect()
    assert sum(x * x for x in enc[0].embedding) == pytest.approx(1, abs=1e-6)


def test_sources(spark):
    df = spark.createDataFrame([("/a/b/paper one.v2.pdf",)], "path string")
    r = P.with_source(df).first()
    assert (r.source, r.paper) == ("paper one.v2.pdf", "paper one.v2")


# Lookup --------------------------------------------------------------------------------------

def test_lookup_and_accessions(spark):
    cols = ", ".join(f"shap_{c} double" for c in Q.ATTRIBUTION_FEATURES)
    preds = spark.createDataFrame([("AT1", 0.8, 1, 0.1234567, None, None, None, None, 0.2),
                                   ("AT2", 0.6, 1, None, None, None, None, None, None)],
                                  f"gene_id string, prob_pos double, pred int, {cols}")
    ids = spark.createDataFrame([("at1 ",), ("AT2",), ("zz",)], "gene_id string")
    got = {r.gene_id: r for r in Q.lookup(ids, preds).collect()}
    assert got["AT1"].top_shap == {"mrna_length": 0.123457, "rmsf_nterm50": 0.2}
    assert got["AT1"].confidence == "high" and got["AT2"].confidence == "medium"
    assert got["AT2"].top_shap == {} and got["ZZ"].status == "not_found" and got["ZZ"].top_shap is None
    kv = "key string, value string"
    out, cover = Q.map_accessions(
        spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "gene_id string"),
        spark.createDataFrame([("a", "R1"), ("C", "R3")], kv), spark.createDataFrame([("b", "N2")], kv),
        spark.createDataFrame([("a", None), ("d", "K4")], kv))
    assert {r.gene_id: r.accession for r in out.collect()} == {"a": None, "b": "N2", "c": "R3", "d": "K4"}
    c = cover.first()
    assert (c.n_ids, c.n_mapped, c.pct_mapped) == (4, 3, 75.0)


def test_compare_ids(spark):
    cols = ", ".join(f"shap_{c} double" for c in Q.ATTRIBUTION_FEATURES)
    preds = spark.createDataFrame([("A", 0.9, 1, *[None] * 6)], f"gene_id string, prob_pos double, pred int, {cols}")
    ids = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, gene_id string")
    q = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "query_id long, embedding array<float>")
    c = spark.createDataFrame([(5, [1.0])], "chunk_id long, embedding array<float>")
    got = {r.gene_id: (r.status, r.chunk_id) for r in Q.compare_ids(ids, preds, q, c).collect()}
    assert got == {"A": ("found", 5), "B": ("not_found", None)}


# Similarity ----------------------------------------------------------------------------------

def brute_components(texts, k, threshold):
    def runs(t):
        w = [x for x in t.lower().split() if x]
        return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = {i: runs(t) for i, t in texts.items()}
    comp = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if a < b and sets[a] and sets[b] and comp[a] != comp[b]:
                    if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                        low = min(comp[a], comp[b])
                        comp = {i: low if c in (comp[a], comp[b]) else c for i, c in comp.items()}
                        changed = True
    return comp


def test_clusters_equal_brute_force(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(5000)}" for _ in range(80)] for _ in range(12)]
    texts, n = {}, 0
    for g, words in enumerate(base):
        # The first family holds more than a third of all texts, half of them exact copies.
        for j in range(40 if g == 0 else 4):
            w = list(words)
            if j % 2:
                w[rng.randrange(80)] = f"x{n}"
            texts[n] = " ".join(w)
            n += 1
    texts[n], texts[n + 1], texts[n + 2] = "", "", "lone words here"
    df = spark.createDataFrame(list(texts.items()), "id long, t string").repartition(4)
    got = {r.id: r.cluster_id for r in M.similarity_clusters(df, "id", "t", k=2, threshold=0.6, unit="words").collect()}
    assert got == brute_components(texts, 2, 0.6)


def test_clusters_hold_every_link_at_the_threshold(spark):
    rng = random.Random(9)
    texts = {}
    for g in range(60):  # pairs at exactly 0.5: 30 words of 40 common, no shared neighbour
        common = [f"g{g}w{i}" for i in range(30)]
        texts[2 * g] = " ".join([*common, *(f"g{g}a{i}" for i in range(15))])
        texts[2 * g + 1] = " ".join([*common, *(f"g{g}b{i}" for i in range(15))])
    # Members that are linked with each other and not with the smallest id, over one common passage.
    passage = [f"p{i}" for i in range(12)]
    for g in range(30):
        words = [*passage, *(f"h{g}w{i}" for i in range(rng.randrange(4, 16)))]
        for j in range(3):
            texts[1000 + 3 * g + j] = " ".join(words[: len(words) - j])
    df = spark.createDataFrame(list(texts.items()), "id long, t string").repartition(4)
    got = {r.id: r.cluster_id for r in M.similarity_clusters(df, "id", "t", k=1, threshold=0.5, unit="words").collect()}
    assert got == brute_components(texts, 1, 0.5)
    got = {r.id: r.cluster_id for r in M.similarity_clusters(df, "id", "t", k=1, threshold=0.8, unit="words").collect()}
    assert got == brute_components(texts, 1, 0.8)


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.id: r.component for r in M.connected_components(df).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[103] == 100


def test_character_runs(spark):
    df = spark.createDataFrame([("ABCAB",), ("AB",), ("",)], "t string")
    assert [len(r.items) for r in M.shingles(df, "t", 2).select("items").collect()] == [3, 1, 0]
    assert len(M.shingles(df, "t", 3).first()["items"]) == 3


def test_chunks_of_a_large_batch_come_in_parts():
    """A batch of any number of texts is cut a few texts at a time."""
    import pyarrow as pa

    texts = [None if i % 50 == 7 else "ab cd. " * (i % 40) for i in range(1000)]
    whole = pa.record_batch([pa.array(range(1000)), pa.array(texts, pa.string())], ["k", "t"])
    parts = list(P._chunk_rows(iter([whole]), ["k"], "t", 100, 20))
    assert all(len(set(p.column("k").to_pylist())) <= P.TEXTS for p in parts)
    got = [(r["k"], r["chunk"], r["chunk_text"]) for p in parts for r in p.to_pylist()]
    assert got == [(k, i, c) for k, t in enumerate(texts) if t for i, c in enumerate(P.pack(P._pieces(t, 100, 0), 100, 20))]


def test_all_vectors_meet_in_large_blocks(spark, monkeypatch):
    """What is shuffled grows with the number of blocks: a vector is copied once for every 8192."""
    from condensq.plans.catalog import text

    seen = []
    blocks = P._top_k_blocks
    monkeypatch.setattr(P, "_top_k_blocks", lambda *a: (seen.append(a[3:]), blocks(*a))[1])
    assert not text.topk_all_vectors(spark, "/root/testdata/sf0.001").isEmpty()
    assert min(seen[0]) >= 8192


def test_common_items_come_as_an_array(spark, monkeypatch):
    """The driver gets no row object for each item; the rarest common item comes first."""
    sets = spark.createDataFrame([(i, [1, 2] if i < 9 else [1, i]) for i in range(12)], "id long, items array<long>")
    frame = type(sets)
    monkeypatch.setattr(frame, "collect", lambda self: pytest.fail("collected as rows"))
    assert M.common_items(sets, share=1).tolist() == [2, 1]
    assert M.common_items(sets, most=1, share=1).tolist() == [1]
    none = M.common_items(sets.limit(0), share=1)
    assert none.tolist() == [] and none.dtype == "int64"
