"""The corpus operators as named queries over the given tables, with their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condensq.llm import (
    attribution, lines, mixing, orc_ids, packing, periodic, perplexity, resampling, simhash, spotsigs,
    substrings, suffixes, toxicity,
)
from condensq.llm.common import WORD, documents, scratch

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.select("doc_id", "toxic"))
    return toxicity.score(docs.select("doc_id", "text"), model).drop("text")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir)).drop("row")


def op4_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(documents(spark, sf_dir))


def op5_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "orc-ids")
    orc_ids.write_ids(documents(spark, sf_dir), path)
    return orc_ids.digests(orc_ids.read_ids(spark, path))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(documents(spark, sf_dir))


def op7_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = perplexity.quality(documents(spark, sf_dir))
    return found.drop("lower", "upper")


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spotsigs.with_next(documents(spark, sf_dir))
    found = found.withColumn("edited_text", spotsigs.edited())
    found = spotsigs.signatures(found, "edited_text", "edited_sigs")
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        spotsigs.printed("sigs").alias("fingerprint"),
        spotsigs.printed("edited_sigs").alias("edited_fingerprint"),
        spotsigs.likeness("sigs", "edited_sigs").alias("near_edited"),
        spotsigs.likeness("sigs", "next_sigs").alias("near_next"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixing.allocate(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return lines.dedup_lines(docs)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resampling.resample(documents(spark, sf_dir), target)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents whose digest of the id ends in 0 repeat a part of themselves to their end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    n = F.size("_words").cast("long")
    work = docs.select("doc_id", "text").withColumn("_g", F.floor(h / 10))
    work = work.withColumn("_words", F.when(h % 10 == 0, words))
    work = work.withColumn("_a", F.when(n > 0, F.pmod("_g", n)))
    work = work.withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))

    def word(w, i):
        again = F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p"))
        return F.when(i < F.col("_a"), w).otherwise(F.get("_words", again.cast("int")))

    edited = F.array_join(F.transform("_words", word), " ")
    return work.select("doc_id", F.when(F.col("_a").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_runs(documents(spark, sf_dir)))
    line = F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        best.start.alias("start"), best.length.alias("length"), best.period.alias("period"),
        F.floor(1000 * best.length / best.period).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_toxicity, op3_packing, op4_attribution, op5_orc_ids, op6_suffixes,
        op7_perplexity, op8_spotsigs, op9_mixing, op10_line_dedup,
        op11_resampling, op12_periodic, op13_substrings, pipeline,
    )
}


OP11_SQL = r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 't', NULL, coalesce(text, '') FROM benchmark
), tokens AS (
  SELECT side, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), words AS (
  SELECT side, doc_id, unnest(w) AS word FROM tokens
), bytes AS (
  SELECT word, unnest(range(1, octet_length(encode(word)) + 1)) AS i, hex(encode(word)) AS h
  FROM (SELECT DISTINCT word FROM words)
), digits AS (
  SELECT word, i, (16 * (strpos('0123456789ABCDEF', h[2 * i - 1]) - 1)
    + strpos('0123456789ABCDEF', h[2 * i]) - 1)::BIGINT AS byte
  FROM bytes
), steps AS (
  SELECT v AS low, list_reduce([v::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: xor(c >> 1, (c & 1) * 3988292384::BIGINT)) AS rest
  FROM range(256) t(v)
), sums AS (
  SELECT word, list(byte ORDER BY i) AS b FROM digits GROUP BY word
), tables AS (
  SELECT list(rest ORDER BY low) AS r FROM steps
), hashed AS (
  SELECT word, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, b),
    lambda c, x: xor(c >> 8, r[xor(c & 255, x) + 1]))) % 10000 AS bucket
  FROM sums, tables
), counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t
  FROM words JOIN hashed USING (word) GROUP BY bucket
), totals AS (
  SELECT coalesce(sum(s), 0)::BIGINT AS all_s, coalesce(sum(t), 0)::BIGINT AS all_t FROM counts
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (all_s + 10000))::DOUBLE
    / ((s + 1) * (all_t + 10000))::DOUBLE))::BIGINT AS gain
  FROM counts, totals
), weighed AS (
  SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), noisy AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT AS h
  FROM documents LEFT JOIN weighed USING (doc_id)
), scored AS (
  SELECT doc_id, n_features, weight,
    weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score
  FROM noisy
), fit AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN fit USING (doc_id)
"""

OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM texts)
), repeated AS (
  SELECT k FROM windows GROUP BY k HAVING count(*) > 1
), covered AS (
  SELECT DISTINCT doc_id, s + j AS i FROM windows SEMI JOIN repeated USING (k), range(35) t(j)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM texts
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
  FROM words ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""

#: The others are not SQL: digests, encoders, models and graph components are tested by brute force.
ORACLES: dict[str, str] = {"op11_resampling": OP11_SQL, "op13_substrings": OP13_SQL}
