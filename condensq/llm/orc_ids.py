"""Token ids in ORC: integer runs, row indexes and Bloom filters on document ids.

A row holds a document's ids as a list of integers, which ORC stores as run-length encoded streams
by stripe. Files follow one another in rising doc_id, rows within them too, so minima and maxima of
stripes and row groups prune range reads, and Bloom filters prune point reads. Stripes are read in
parallel.

Edge cases: null or empty text is a document of the end id alone; rows of equal id stand side by
side, numbered by `copy` within their file; null ids come first; an empty table writes an empty
file set and reads back empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from condensq.llm.common import slices
from condensq.llm.encoding import VOCABULARY, encoder
from condensq.operators.ranking import with_range_bucket

ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "compression": "snappy",
}


def write_ids(docs: DataFrame, path: str, end_id: int = 2, vocabulary: str = VOCABULARY) -> None:
    """Encode every text, append `end_id`, write files in rising doc_id.

    Texts are shuffled, not ids: they are smaller. The ranges of the files come from the ids alone,
    so no text is read for them; rows of one id share a file, by digest of text. Files are numbered
    in their order.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        last, copy = object(), 0
        for batch in slices(batches, "text", 2 << 20):
            ids = batch.column("doc_id").to_pylist()
            found = [enc.encode(t) + end for t in batch.column("text").to_pylist()]
            sizes = [len(x) // 4 for x in found]
            copies = []
            for doc in ids:
                copy = copy + 1 if doc == last else 0
                last = doc
                copies.append(copy)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(found), "<i4"))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(copies, pa.int32()), pa.array(sizes, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(offsets), values)],
                ["doc_id", "copy", "n_tokens", "ids"],
            )

    rows = docs.select("doc_id", "text")
    if isinstance(docs.schema["doc_id"].dataType, T.NumericType):
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = with_range_bucket(rows, F.col("doc_id"), n, "_range")
        rows = ranged.repartitionById(n, F.col("_range").cast("int"))
    else:
        rows = rows.repartitionByRange("doc_id")
    ordered = rows.sortWithinPartitions("doc_id", F.xxhash64("text"))
    encoded = ordered.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, copy int, n_tokens int, ids array<int>"
    )
    encoded.write.options(**ORC_OPTIONS).orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, copy, n_tokens, ids, file) of the files of a folder."""
    schema = spark.read.orc(path).schema
    return spark.read.schema(schema).orc(path).select("*", F.col("_metadata.file_name").alias("file"))


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some ids; the filter reaches the reader, which skips stripes and row groups."""
    return spark.read.orc(path).filter(F.col("doc_id").isin(doc_ids))


def digests(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the ids read; start counts all ids before.

    Sums of files, a row each, carry on; the running sum inside a file is over narrow rows.
    """
    kind = stored.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values = np.ascontiguousarray(ids.values.to_numpy(), "<u4")
            at = ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.record_batch(
                [batch.column("file"), batch.column("doc_id"), batch.column("copy"),
                 pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                ["file", "doc_id", "copy", "n_tokens", "ids_crc32"],
            )

    rows = stored.select("file", "doc_id", "copy", "ids").mapInArrow(
        run, f"file string, doc_id {kind}, copy int, n_tokens long, ids_crc32 long"
    )
    within = Window.partitionBy("file").orderBy("doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.sum("n_tokens").over(within))
    totals = stored.groupBy("file").agg(F.sum("n_tokens").alias("_total"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    files = Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    before = totals.select("file", F.coalesce(F.sum("_total").over(files), F.lit(0)).alias("_before"))
    return rows.join(before, "file").select(
        "doc_id", (F.col("_before") + F.col("_upto") - F.col("n_tokens")).alias("start"),
        "n_tokens", "ids_crc32",
    )
