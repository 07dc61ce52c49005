"""Text chunks, embeddings and exact top-k cosine retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condensq.functions.arrays import by_strength, top_k_abs
from condensq.session import fits

CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
# Separators tried from coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
# Fixed values end.
MAX_BROADCAST_QUERIES = 4096
SLICE = 2048
#: Texts that are cut into chunks at a time.
TEXTS = 128


# Chunking ------------------------------------------------------------------------------------

def chunk_fixed(
    df: DataFrame, key: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """(key, chunk, chunk_text): windows of `size` characters, `size - overlap` apart."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size - overlap))
    windows = F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(size)))
    rest = [c for c in df.columns if c != text]
    return df.where(F.length(text) > 0).select(
        *rest, F.posexplode(windows).alias("chunk", "chunk_text")
    )


def _pieces(text: str, size: int, level: int) -> list[str]:
    """Fragments of at most `size` characters, cut at the coarsest separator that serves."""
    if len(text) <= size:
        return [text]
    while level < len(SEPARATORS) - 1 and SEPARATORS[level] not in text:
        level += 1
    sep = SEPARATORS[level]
    if not sep:
        return [text[i:i + 1] for i in range(len(text))]
    head, *tail = text.split(sep)
    parts = [p for p in [head, *(sep + t for t in tail)] if p]
    return [
        q
        for p in parts
        for q in ([p] if len(p) <= size else _pieces(p, size, min(level + 1, len(SEPARATORS) - 1)))
    ]


def pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Fill chunks greedily; each one starts with the last pieces of the one before, up to
    `overlap` characters."""
    chunks, window, length = [], [], 0
    for piece in pieces:
        if window and length + len(piece) > size:
            chunks.append("".join(window).strip())
            while window and (length > overlap or length + len(piece) > size):
                length -= len(window.pop(0))
        window.append(piece)
        length += len(piece)
    chunks.append("".join(window).strip())
    return [c for c in chunks if c]


def _chunk_rows(
    batches: Iterator[pa.RecordBatch], rest: list[str], text: str, size: int, overlap: int
) -> Iterator[pa.RecordBatch]:
    """Chunks of a few texts at a time: a batch may hold thousands, whose pieces take many times their room."""
    for whole in batches:
        for start in range(0, whole.num_rows, TEXTS):
            batch = whole.slice(start, TEXTS)
            found = [pack(_pieces(t, size, 0), size, overlap) if t else [] for t in batch.column(text).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            numbers = pa.array([i for f in found for i in range(len(f))], pa.int32())
            chunks = pa.array([c for f in found for c in f], pa.string())
            columns = [*(batch.column(c).take(at) for c in rest), numbers, chunks]
            yield pa.record_batch(columns, [*rest, "chunk", "chunk_text"])


def chunk_text(
    df: DataFrame, key: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
    mode: str = "recursive",
) -> DataFrame:
    """Overlapping chunks cut at paragraph, line, sentence, word, in this order of preference."""
    if mode == "fixed":
        return chunk_fixed(df, key, text, size, overlap)

    rest = [c for c in df.columns if c != text]
    kinds = [df.schema[c] for c in rest]
    schema = T.StructType([*kinds, T.StructField("chunk", T.IntegerType()), T.StructField("chunk_text", T.StringType())])
    return df.mapInArrow(lambda batches: _chunk_rows(batches, rest, text, size, overlap), schema)


class _ChunkRows:
    """`chunk_text(text, size, overlap, mode)` as a table function: a row for each chunk."""

    def eval(self, text: str, size: int, overlap: int, mode: str):
        if not text:
            return
        if mode == "fixed":
            parts = [text[i:i + size] for i in range(0, len(text), size - overlap)]
        else:
            parts = pack(_pieces(text, size, 0), size, overlap)
        yield from enumerate(parts)


class _PackRows:
    """`pack_passages(TABLE(t) PARTITION BY k ORDER BY (i), size)`: passages of a partition, in their
    order, put together up to `size` characters a row. Needs columns k, i and passage."""

    def __init__(self):
        self.key, self.number, self.parts, self.length = None, 0, [], 0

    def _row(self):
        row = (str(self.key), self.number, len(self.parts), "\n".join(self.parts))
        self.number, self.parts, self.length = self.number + 1, [], 0
        return row

    def eval(self, row: Row, size: int):
        self.key, passage = row["k"], row["passage"] or ""
        if self.parts and self.length + 1 + len(passage) > size:
            yield self._row()
        self.length += len(passage) + (1 if self.parts else 0)
        self.parts.append(passage)

    def terminate(self):
        if self.parts:
            yield self._row()


def register_table_functions(spark) -> None:
    """Make `chunk_text` and `pack_passages` known to SQL:

        SELECT d.doc_id, c.* FROM docs d, LATERAL chunk_text(d.text, 1000, 200, 'recursive') c
    """
    spark.udtf.register(
        "chunk_text", F.udtf(_ChunkRows, returnType="chunk int, chunk_text string", useArrow=True)
    )
    spark.udtf.register(
        "pack_passages",
        F.udtf(_PackRows, returnType="k string, number int, n_passages int, text string", useArrow=True),
    )


def with_source(df: DataFrame, path: str = "path") -> DataFrame:
    """File name and its stem."""
    name = F.element_at(F.split(path, "/"), -1)
    return df.withColumns({"source": name, "paper": F.regexp_replace(name, r"\.[^.]*$", "")})


def page_texts(df: DataFrame, text: str = "text", page: str = "page") -> DataFrame:
    """One row per page of a paged text: pages end at form feeds and are numbered from 0; pages
    without a letter or digit are left out, and the numbers of the others stay."""
    rest = [c for c in df.columns if c != text]
    pages = df.select(*rest, F.posexplode(F.split(text, "\f")).alias(page, text))
    return pages.where(F.col(text).rlike(r"[\p{L}\p{N}]"))


# Embedding -----------------------------------------------------------------------------------

def embed_tfidf(df: DataFrame, text: str, dims: int = 512, fit_on: DataFrame | None = None):
    """Unit-length hashed tf-idf vectors as `embedding`; returns (frame, fitted model)."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit"),
    ]
    model = Pipeline(stages=stages).fit(df if fit_on is None else fit_on)
    return apply_tfidf(df, model), model


def apply_tfidf(df: DataFrame, model) -> DataFrame:
    out = model.transform(df).withColumn("embedding", vector_to_array("_unit", "float32"))
    return out.drop("_tokens", "_tf", "_idf", "_unit")


def embed_with(df: DataFrame, text: str, encoder) -> DataFrame:
    """Vectors of a user-supplied `encoder(list[str]) -> 2-D array`, normalised."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        if texts.empty:
            return pd.Series([], dtype=object)
        v = np.asarray(encoder(texts.tolist()), dtype=np.float64)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return pd.Series(list((v / np.where(norm == 0, 1, norm)).astype(np.float32)))

    return df.withColumn("embedding", encode(text))


# Retrieval -----------------------------------------------------------------------------------

def _unit(rows) -> np.ndarray:
    m = np.stack(rows).astype(np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


class _Best:
    """The k best (score, id) per query seen so far."""

    def __init__(self, k: int):
        self.k, self.found = k, {}

    def add(self, query_ids, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = min(self.k, scores.shape[0])
        if not keep:
            return
        for j, q in enumerate(query_ids):
            col = scores[:, j]
            edge = np.partition(col, len(col) - keep)[len(col) - keep]
            rows = np.flatnonzero(col >= edge)  # ties at the edge stay until ids decide
            mine = self.found.get(q, []) + list(zip(-col[rows], ids[rows]))
            self.found[q] = sorted(mine)[: self.k]

    def frame(self) -> pd.DataFrame:
        rows = [(q, i, -s) for q, found in self.found.items() for s, i in found]
        return pd.DataFrame(rows, columns=["query_id", "chunk_id", "score"])


_HITS = "query_id long, chunk_id long, score double"


def top_k(
    queries: DataFrame, chunks: DataFrame, k: int = 5, digits: int | None = 4,
    max_broadcast: int = MAX_BROADCAST_QUERIES, block: int = 8192, corpus_block: int = 32_768,
) -> DataFrame:
    """(query_id, rank, chunk_id, score): the k most similar chunks of every query, exact.

    queries: query_id, embedding. chunks: chunk_id, embedding. Few queries travel to the
    partitions of the corpus; many are cut into blocks that meet blocks of the corpus. Either way
    a task passes on at most k rows per query, never the scored pairs.
    """
    if fits(queries, max_broadcast):
        local = _top_k_broadcast(queries, chunks, k)
    else:
        local = _top_k_blocks(queries, chunks, k, block, corpus_block)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    out = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    value = F.col("score") if digits is None else F.bround("score", digits)
    return out.select("query_id", "rank", "chunk_id", value.alias("score"))


def _top_k_broadcast(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    rows = queries.select("query_id", "embedding").collect()  # at most max_broadcast rows
    ids = [r["query_id"] for r in rows]
    matrix = _unit([r["embedding"] for r in rows]).T if rows else None
    shared = queries.sparkSession.sparkContext.broadcast((ids, matrix))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, m = shared.value
        best = _Best(k)
        for pdf in batches:
            if qids and len(pdf):
                best.add(qids, _unit(pdf["embedding"].to_list()) @ m, pdf["chunk_id"].to_numpy())
        yield best.frame()

    return chunks.select("chunk_id", "embedding").mapInPandas(scan, _HITS)


def _top_k_blocks(
    queries: DataFrame, chunks: DataFrame, k: int, block: int, corpus_block: int
) -> DataFrame:
    """Every query block meets every corpus block once; blocks are drawn by id hash.

    A corpus block is the larger one, so queries are copied less often; it is scored in slices. What
    is shuffled grows with the number of blocks, so blocks are as large as a task has room for.
    """
    qn = max(1, -(-queries.count() // block))
    cn = max(1, -(-chunks.count() // corpus_block))

    def cells(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)
        return df.select(key, "embedding", mine, every)

    q = cells(queries, "query_id", "qb", qn, "cb", cn)
    c = cells(chunks, "chunk_id", "cb", cn, "qb", qn)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        best = _Best(k)
        if len(left) and len(right):
            ids, m = left["query_id"].to_list(), _unit(left["embedding"].to_list()).T
            for i in range(0, len(right), SLICE):
                part = right.iloc[i:i + SLICE]
                best.add(ids, _unit(part["embedding"].to_list()) @ m, part["chunk_id"].to_numpy())
        return best.frame()

    return q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(meet, _HITS)


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """Per query and exact text the best hit, ranked anew."""
    rest = [c for c in hits.columns if c not in ("query_id", "text", "rank")]
    best = hits.groupBy("query_id", "text").agg(
        F.max_by(F.struct(*rest), F.struct("score", -F.col("chunk_id"))).alias("h")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    flat = best.select("query_id", "text", *[F.col(f"h.{c}").alias(c) for c in rest])
    return flat.withColumn("rank", F.row_number().over(order))


def build_query(gene, attributions, k: int = 3):
    """Question text around the k strongest features of a row."""
    names = F.transform(top_k_abs(attributions, k), lambda s: s["feature"])
    listed = F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(
        F.lit("mRNA sequence features")
    )
    # Fixed value: wording of the question.
    form = (
        "P-body mRNA enrichment condensation %s RNA sequence features %s heat stress Arabidopsis"
    )
    return F.format_string(form, gene, listed)


def retrieve_if(
    df: DataFrame, queries: DataFrame, chunks: DataFrame, min_prob: float = 0.8, k: int = 5
) -> DataFrame:
    """Hits for rows above the bound only; the others pass with no hits.

    df: query_id, prob_pos. Returns df with `route` and one row per hit (or one without).
    """
    route = F.when(F.col("prob_pos") > min_prob, "retrieve").otherwise("skip")
    routed = df.withColumn("route", F.coalesce(route, F.lit("skip")))
    asked = queries.join(routed.where("route = 'retrieve'"), "query_id", "left_semi")
    return routed.join(top_k(asked, chunks, k), "query_id", "left")


def shorten(text, width: int = 400):
    """Whitespace collapsed; cut at a word boundary with an ellipsis when too long."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.regexp_replace(F.substring(flat, 1, width), r"\s?\S*$", "")
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(head, F.lit("…")))


def evidence_table(
    ids: DataFrame, predictions: DataFrame, attrs: DataFrame, hits: DataFrame, passages: int = 3
) -> DataFrame:
    """Per id: score, attributions by falling strength, and the first shortened passages.

    attrs: gene_id, attributions (array of structs). hits: gene_id, rank, source, page, score,
    text. Only the first passages of an id are gathered.
    """
    top = hits.where(F.col("rank") <= passages).groupBy("gene_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("rank", "source", "page", "score", shorten(F.col("text")).alias("snippet"))
            )
        ).alias("passages")
    )
    ordered = attrs.select("gene_id", by_strength(F.col("attributions")).alias("attributions"))
    return (
        ids.join(predictions, "gene_id", "left")
        .join(ordered, "gene_id", "left")
        .join(top, "gene_id", "left")
    )


def score_by_rank(hits: DataFrame) -> DataFrame:
    return hits.groupBy("rank").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"),
        F.min("score").alias("min_score"), F.max("score").alias("max_score"),
    )
