"""Importance resampling towards a target distribution, by hashed n-gram features.

1. The n-grams of a batch are interned in an open-addressed NumPy table: slots are probed from the
   64-bit xxhash of the n-gram's bytes, and an occurrence joins a slot only after its bytes were
   compared with the slot's. A slot stores bucket and count, so a bucket is worked out once for
   each different n-gram of a batch.
2. Bucket counts of all documents and of the target give the gain of a bucket, a table of
   `buckets` numbers (a parameter, so what travels to the tasks has a proven size).
3. Each occurrence gathers its gain through its slot; a document's weight is the mean. Weight plus
   Gumbel noise drawn from the document's id is its score, and the highest scores are the sample.
   Ranks come from ranges of scores, so no task holds all documents.

Edge cases: null and empty texts have no features, weight 0 and a score; an empty target or table
counts 0 in each bucket; ties in score go to the smaller id; repeated rows have equal scores and
ranks of their own; a null id draws as an empty one and comes last among ties; very long texts are
handled whole; other columns of any name are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from condensq.llm.common import slices, stored
from condensq.operators.ranking import row_numbers, with_range_bucket

#: Words are runs of digits, letters a-z and bytes beyond ASCII; A-Z count as a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isdigit() or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class NgramTable:
    """The different n-grams among byte ranges of `data`: `slot` tells the slot of each range; a used
    slot has the number of a range that stands for it, a bucket and a count."""

    def __init__(self, data: bytes, start: np.ndarray, size: np.ndarray, buckets: int) -> None:
        n = len(start)
        self.data, self.start, self.size = data, start, size
        padded = np.frombuffer(data + bytes(8), np.uint8)
        # Eight bytes from any place on, as one number.
        self.eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        ends = start + size
        keys = (xxh64_intdigest(data[a:b]) for a, b in zip(start.tolist(), ends.tolist()))
        self.key = np.fromiter(keys, np.uint64, n)
        self.capacity = 1 << max(1, (2 * n).bit_length())
        self.holder = np.full(self.capacity, -1, np.int64)
        self.slot = self._interned()
        used = np.flatnonzero(self.holder >= 0)
        self.bucket = np.zeros(self.capacity, np.int64)
        held = self.holder[used].tolist()
        self.bucket[used] = [zlib.crc32(data[start[k] : ends[k]]) % buckets for k in held]
        self.count = np.bincount(self.slot, minlength=self.capacity)
        self.used = used

    def _interned(self) -> np.ndarray:
        mask = np.uint64(self.capacity - 1)
        slot = (self.key & mask).astype(np.int64)
        open_ = np.arange(len(slot))
        while len(open_):
            at = slot[open_]
            free = self.holder[at] < 0
            self.holder[at[free]] = open_[free]  # of several that claim a slot, one stays
            held = self.holder[at]
            same = (self.key[open_] == self.key[held]) & (self.size[open_] == self.size[held])
            same[same] = self._equal(open_[same], held[same])
            open_ = open_[~same]
            slot[open_] = (slot[open_] + 1) & int(mask)
        return slot

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether ranges of equal sizes hold the same bytes, compared eight at a time."""
        out = a == b
        left = np.flatnonzero(~out)
        done = 0
        while len(left):
            size = self.size[a[left]] - done
            ended = size <= 0
            out[left[ended]] = True
            left, size = left[~ended], size[~ended]
            differing = self.eight[self.start[a[left]] + done] ^ self.eight[self.start[b[left]] + done]
            beyond = np.maximum(8 - size, 0).astype(np.uint64) * np.uint64(8)
            left = left[(differing << beyond) == 0]
            done += 8
        return out


def interned(texts: list, n: int, buckets: int) -> tuple[NgramTable, np.ndarray, np.ndarray]:
    """(table, owner, n_words): the runs of 1 to n words of the texts, the text of each, and the
    number of words of each text."""
    words = [words_of(t) for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    flat = [w for own in words for w in own]
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    start = np.cumsum(size + 1) - size - 1
    owner = np.repeat(np.arange(len(words)), n_words)
    left = np.cumsum(n_words)[owner] - np.arange(len(flat))  # words to the end of the text
    starts, sizes, owners = [], [], []
    for k in range(n):
        first = np.flatnonzero(left > k)
        last = first + k
        starts.append(start[first])
        sizes.append(start[last] + size[last] - start[first])
        owners.append(owner[first])
    table = NgramTable(b" ".join(flat), np.concatenate(starts), np.concatenate(sizes), buckets)
    return table, np.concatenate(owners), n_words


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """(bucket, n): features of all `text` rows by bucket; a task emits its own sums."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text", 2 << 20):
            table, *_ = interned(batch.column("text").to_pylist(), n, buckets)
            np.add.at(total, table.bucket[table.used], table.count[table.used])
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = texts.select("text").mapInArrow(counted, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000) -> np.ndarray:
    """floor(1000 * log of how much likelier the target is) for each bucket."""
    s = bucket_counts(docs, n, buckets).withColumnRenamed("n", "s")
    t = bucket_counts(target, n, buckets).withColumnRenamed("n", "t")
    spark = docs.sparkSession
    both = spark.range(buckets).toDF("bucket").join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0)
    found = both.toPandas().sort_values("bucket")  # one row for each bucket
    s, t = (found[c].to_numpy(np.float64) for c in ("s", "t"))
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, n: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each document's features."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            table, owner, n_words = interned(batch.column("text").to_pylist(), n, len(gain))
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, owner, gain[table.bucket][table.slot])
            features = np.bincount(owner, minlength=batch.num_rows)
            mean = total // np.maximum(features, 1)
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n_words, features, mean))],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        weighed, f"doc_id {kind}, n_words long, n_features long, weight long"
    )


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) of an id: the same in every run."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000,
    percent: int = 10, min_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every document; rank 1, 2, ... for the `percent` of
    those with `min_words` words that are drawn, null for the others."""
    found = weights(docs, gains(docs, target, n, buckets), n)
    found = found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    found = stored(found, "weights")  # counted, cut into ranges and ranked
    fit = found.filter(F.col("n_words") >= min_words)
    drawn = percent * fit.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    fit = with_range_bucket(fit, -F.col("score"), name="_range")
    fit = row_numbers(fit, order, F.col("_range"), name="rank").drop("_range")
    fit = fit.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = found.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return fit.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
