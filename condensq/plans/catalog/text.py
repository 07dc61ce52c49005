"""Chunks, retrieval and evidence; similarity clusters of whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from condensq.functions.arrays import by_strength
from condensq.operators import retrieval as P
from condensq.operators.aggregates import corpus_manifest
from condensq.operators.similarity import similarity_clusters
from condensq.operators.splits import cluster_split, leakage_audit
from condensq.plans import star as S
from condensq.plans.catalog import query
from condensq.plans.star import PREDICTIONS_SQL, locus_sql, with_sql
from condensq.schemas import ATTRIBUTION_FEATURES

_CHUNKS = """
SELECT doc_id, ((i - 1) // 800)::INTEGER AS chunk, substr(text, i::INTEGER, 1000) AS chunk_text
FROM documents, range(1, greatest(length(text), 1) + 1, 800) AS r(i) WHERE length(text) > 0"""


@query("chunk_fixed", _CHUNKS)
def chunk_fixed(spark, d):
    docs = S.documents(spark, d).select("doc_id", "text")
    return P.chunk_fixed(docs, "doc_id", "text")


@query("chunk_manifest", f"""
SELECT source, count(*) AS n_chunks FROM ({_CHUNKS}) JOIN documents USING (doc_id) GROUP BY 1""")
def chunk_manifest(spark, d):
    docs = S.documents(spark, d).select("doc_id", "source", "text")
    return corpus_manifest(P.chunk_fixed(docs, "doc_id", "text"))


@query("chunk_lateral", _CHUNKS)
def chunk_lateral(spark, d):
    """The same chunks by the table function in SQL."""
    P.register_table_functions(spark)
    docs = S.documents(spark, d).select("doc_id", "text")
    return spark.sql(
        f"""SELECT d.doc_id, c.chunk, c.chunk_text
        FROM {{docs}} d, LATERAL chunk_text(d.text, {P.CHUNK_SIZE}, {P.CHUNK_OVERLAP}, 'fixed') c""",
        docs=docs,
    )


@query("packed_turns", r"""
WITH c AS (SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS n,
                  sum(length(text)) + count(*) - 1 AS size FROM conversations GROUP BY 1)
SELECT conv_id::VARCHAR AS k, n::BIGINT AS n_passages, size::BIGINT AS n_chars, true AS fits FROM c""")
def packed_turns(spark, d):
    """Turns of each conversation, in order, packed into passages of 400 characters by the table
    function's PARTITION BY; no turn is lost and a passage is longer only where a turn is."""
    P.register_table_functions(spark)
    turns = S.table(spark, d, "conversations").select(
        F.col("conv_id").alias("k"), F.col("turn").alias("i"), F.col("text").alias("passage")
    )
    rows = spark.sql(
        "SELECT * FROM pack_passages(TABLE({turns}) PARTITION BY k ORDER BY (i), 400)", turns=turns
    )
    return rows.groupBy("k").agg(
        F.sum("n_passages").alias("n_passages"),
        (F.sum(F.length("text")) + F.count(F.lit(1)) - 1).alias("n_chars"),
        F.min((F.length("text") <= 400) | (F.col("n_passages") == 1)).alias("fits"),
    )


@query("chunk_recursive")
def chunk_recursive(spark, d):
    docs = S.documents(spark, d).select("doc_id", "text")
    return P.chunk_text(docs, "doc_id", "text")


@query("page_sources", r"""
SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS source,
       regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '') AS paper FROM pages""")
def page_sources(spark, d):
    p = S.table(spark, d, "pages").select("page_id", "url")
    return P.with_source(p, "url").drop("url")


_CORPUS = """
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
           FROM embeddings),
c AS (SELECT label, i, avg(x) AS x FROM e GROUP BY 1, 2),
qn AS (SELECT label, sqrt(sum(x * x)) AS n FROM c GROUP BY 1),
en AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY 1),
dots AS (SELECT c.label AS query_id, e.vec_id AS chunk_id, sum(c.x * e.x) AS s
         FROM c JOIN e USING (i) GROUP BY 1, 2),
hits AS (
  SELECT query_id, chunk_id, s / (qn.n * en.n) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY s / (qn.n * en.n) DESC, chunk_id) AS r
  FROM dots JOIN qn ON qn.label = query_id JOIN en ON en.vec_id = chunk_id)
"""


def queries(spark, d):
    """One query vector per label: the mean of all its vectors."""
    e = S.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return packed.select(F.col("label").cast("long").alias("query_id"), F.col("v.x").alias("embedding"))


def corpus(spark, d):
    return S.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


@query("topk_cosine", _CORPUS + """
SELECT query_id, r::INTEGER AS "rank", chunk_id, round_even(score, 4) AS score
FROM hits WHERE r <= 5""")
def topk_cosine(spark, d):
    return P.top_k(queries(spark, d), corpus(spark, d), 5).withColumn(
        "query_id", F.col("query_id").cast("int")
    )


@query("topk_all_vectors", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[64] AS v FROM embeddings),
h AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, array_cosine_similarity(a.v, b.v) AS s
      FROM e a, e b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, chunk_id) AS k
      FROM h)
SELECT query_id, k::INTEGER AS "rank", round(s, 4) AS score FROM r WHERE k <= 3""")
def topk_all_vectors(spark, d):
    """Every vector against every other; forced onto the block path."""
    q = corpus(spark, d).withColumnRenamed("chunk_id", "query_id")
    out = P.top_k(q, corpus(spark, d), 3, max_broadcast=0, digits=None)
    return out.select("query_id", "rank", F.round("score", 4).alias("score"))


def hits_with_text(spark, d):
    """Hits joined with a text per chunk; many chunks share a text."""
    h = P.top_k(queries(spark, d), corpus(spark, d), 20, digits=None)
    text = S.table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("text")
    )
    return h.join(text, "chunk_id")


@query("dedupe_hits", _CORPUS + """, t AS (
  SELECT query_id, chunk_id, score, source AS text,
         row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS k
  FROM hits JOIN documents ON doc_id = chunk_id WHERE r <= 20)
SELECT query_id, text, chunk_id, round(score, 9) AS score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS "rank"
FROM t WHERE k = 1""")
def dedupe_hits(spark, d):
    out = P.dedupe_hits(hits_with_text(spark, d))
    return out.select(
        F.col("query_id").cast("int").alias("query_id"), "text", "chunk_id",
        F.round("score", 9).alias("score"), "rank",
    )


@query("score_by_rank", _CORPUS + """
SELECT r::INTEGER AS "rank", count(*) AS n, round(avg(score), 6) AS mean_score,
       round(min(score), 6) AS min_score, round(max(score), 6) AS max_score
FROM hits WHERE r <= 5 GROUP BY r""")
def score_by_rank(spark, d):
    out = P.score_by_rank(P.top_k(queries(spark, d), corpus(spark, d), 5, digits=None))
    return out.withColumns(
        {c: F.round(c, 6) for c in ("mean_score", "min_score", "max_score")}
    )


@query("conditional_retrieval", _CORPUS + """, asked AS (
  SELECT DISTINCT label::BIGINT AS query_id, label / 10.0::DOUBLE AS prob_pos FROM embeddings)
SELECT a.query_id, a.prob_pos, CASE WHEN a.prob_pos > 0.8 THEN 'retrieve' ELSE 'skip' END AS route,
       h.r::INTEGER AS "rank", h.chunk_id, round_even(h.score, 4) AS score
FROM asked a LEFT JOIN hits h ON h.query_id = a.query_id AND a.prob_pos > 0.8 AND h.r <= 5""")
def conditional_retrieval(spark, d):
    q = queries(spark, d)
    asked = q.select("query_id", (F.col("query_id") / F.lit(10.0)).alias("prob_pos"))
    return P.retrieve_if(asked, q, corpus(spark, d))


def attribution_arrays(spark, d):
    p = S.predictions(spark, d)
    items = F.array(*[
        F.struct(
            F.lit(c).alias("feature"), F.lit(None).cast("double").alias("value"),
            F.col(f"shap_{c}").alias("attribution"),
        ) for c in ATTRIBUTION_FEATURES
    ])
    return p.select("gene_id", items.alias("attributions"))


_TOP3 = """, l AS (
  UNPIVOT (SELECT gene_id, shap_mrna_length AS mrna_length, shap_cds_length AS cds_length,
                  "shap_di_CG" AS "di_CG", shap_utr3_au_content AS utr3_au_content,
                  shap_rrach_per_kb AS rrach_per_kb, shap_rmsf_nterm50 AS rmsf_nterm50
           FROM predictions) ON COLUMNS(* EXCLUDE gene_id) INTO NAME feature VALUE v),
o AS (SELECT gene_id, feature, v, row_number() OVER (PARTITION BY gene_id
        ORDER BY abs(v) DESC, feature) AS k FROM l)
"""


@query("question_text", with_sql(PREDICTIONS_SQL) + _TOP3 + """, f AS (
  SELECT gene_id, string_agg(feature, ', ' ORDER BY k) AS fs FROM o WHERE k <= 3 GROUP BY 1)
SELECT gene_id, 'P-body mRNA enrichment condensation ' || gene_id || ' RNA sequence features '
  || coalesce(fs, 'mRNA sequence features') || ' heat stress Arabidopsis' AS question
FROM predictions LEFT JOIN f USING (gene_id)""")
def question_text(spark, d):
    a = attribution_arrays(spark, d)
    return a.select(
        "gene_id", P.build_query(F.col("gene_id"), F.col("attributions")).alias("question")
    )


@query("top_attributions", with_sql(PREDICTIONS_SQL) + _TOP3 + """
SELECT gene_id, feature, v AS attribution FROM o WHERE k <= 5""")
def top_attributions(spark, d):
    a = attribution_arrays(spark, d)
    top = F.explode(F.slice(by_strength(F.col("attributions")), 1, 5)).alias("a")
    return a.select("gene_id", top).select("gene_id", "a.feature", "a.attribution")


@query("evidence_table", with_sql(PREDICTIONS_SQL) + f""", docs AS (
  SELECT {locus_sql('doc_id')} AS gene_id, text FROM documents),
ids AS (SELECT {locus_sql('doc_id')} AS gene_id FROM labels),
n AS (SELECT gene_id, count(*) AS n FROM docs JOIN ids USING (gene_id) GROUP BY 1)
SELECT i.gene_id, round_even(p.prob_pos, 6) AS prob_pos, p.pred,
       (p.shap_mrna_length IS NOT NULL)::INTEGER * 6 AS n_attributions, 1 AS n_passages,
       length(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))) > 400 AS shortened
FROM ids i LEFT JOIN predictions p USING (gene_id) LEFT JOIN docs d USING (gene_id)""")
def evidence_table(spark, d):
    docs = S.documents(spark, d)
    hits = docs.select(
        S.locus(F.col("doc_id")).alias("gene_id"), F.lit(1).alias("rank"), "source",
        F.lit(0).alias("page"), F.lit(1.0).alias("score"), "text",
    )
    ids = S.table(spark, d, "labels").select(S.locus(F.col("doc_id")).alias("gene_id"))
    preds = S.predictions(spark, d).select(
        "gene_id", F.bround("prob_pos", 6).alias("prob_pos"), "pred"
    )
    out = P.evidence_table(ids, preds, attribution_arrays(spark, d), hits)
    return out.select(
        "gene_id", "prob_pos", "pred", F.size("attributions").alias("n_attributions"),
        F.size("passages").alias("n_passages"),
        F.endswith(F.get("passages", 0)["snippet"], F.lit("…")).alias("shortened"),
    )


@query("text_retrieval")
def text_retrieval(spark, d):
    """Benchmark texts as questions over all document chunks, by tf-idf vectors."""
    docs = S.documents(spark, d).select("doc_id", "source", "text")
    chunks = P.chunk_fixed(docs, "doc_id", "text").withColumn(
        "chunk_id", F.col("doc_id") * 1000000 + F.col("chunk")
    )
    vec, model = P.embed_tfidf(chunks, "chunk_text", 256)
    ask = S.table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("chunk_text")
    )
    return P.top_k(P.apply_tfidf(ask, model), vec, 5)


#: Every pair of texts with half of their five-word runs in common, and who reaches whom by them.
_CLUSTERS = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
      FROM t),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.5 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents
                 UNION SELECT links.y, r.c FROM r JOIN links ON r.doc_id = links.x),
clusters AS (SELECT doc_id, min(c) AS cluster_id FROM r GROUP BY 1)
"""


def clusters(spark, d):
    docs = S.documents(spark, d).select("doc_id", "text")
    return similarity_clusters(docs, "doc_id", "text", k=5, threshold=0.5, unit="words")


@query("similarity_clusters", _CLUSTERS + "SELECT doc_id, cluster_id FROM clusters")
def text_clusters(spark, d):
    return clusters(spark, d)


@query("leakage_safe_split", _CLUSTERS + """, lab AS (
  SELECT doc_id, cluster_id AS cl, coalesce(quality, -1) AS class FROM clusters LEFT JOIN labels USING (doc_id)),
per AS (SELECT cl, class, count(*) AS n, min(doc_id) AS f FROM lab GROUP BY 1, 2),
maj AS (SELECT cl, arg_min(class, {'n': -n, 'f': f}) AS m FROM per GROUP BY 1),
pl AS (SELECT cl, m, row_number() OVER (PARTITION BY m ORDER BY md5(cl::VARCHAR || '|42'), cl) AS p,
              count(*) OVER (PARTITION BY m) AS n FROM maj),
sp AS (SELECT doc_id, class, CASE WHEN m NOT IN (0, 1) THEN 'train' WHEN p <= floor(n * 0.7::DOUBLE) THEN 'train'
         WHEN p <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split
       FROM lab JOIN pl USING (cl)),
leaks AS (SELECT count(*) AS n FROM p JOIN sp a ON a.doc_id = p.x JOIN sp b ON b.doc_id = p.y WHERE a.split <> b.split)
SELECT split, class, count(*) AS n, (SELECT n FROM leaks) AS n_leaking FROM sp GROUP BY 1, 2""")
def leakage_safe_split(spark, d):
    """Split by similarity cluster; the audit column counts clusters that leak (always 0)."""
    lab = S.table(spark, d, "labels").select("doc_id", F.col("quality").alias("class"))
    rows = clusters(spark, d).join(lab, "doc_id", "left").withColumn(
        "class", F.coalesce("class", F.lit(-1))
    )
    split = cluster_split(rows, "cluster_id", "class", "doc_id")
    leaks = leakage_audit(split, "cluster_id").agg(F.count(F.lit(1))).scalar()
    return split.groupBy("split", "class").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "n_leaking", leaks
    )
