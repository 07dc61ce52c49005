"""Severity of toxic text by cumulative-link ordinal regression on hashed words.

P(grade > k) is the logistic function of x.w - t_k: one weight vector for all grades and a rising
threshold for each. The expected severity of a text is the sum of these probabilities over k.

Edge cases: null, empty and letterless texts have no features and get what the thresholds alone
say; repeated label rows count once; with no label, or labels of one grade only, severity is 0 and
nothing is rejected; repeated documents are scored each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condensq.llm.common import slices

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicitySettings:
    bits: int = 20  # features are word digests of so many bits
    fit_rows: int = 12_000  # bound of the labelled sample a model is fitted on, by digest of doc_id
    min_documents: int = 5  # a feature of fewer labelled documents gets no weight
    min_z: float = 6.0  # nor does one whose rates among toxic and other rows differ by fewer errors
    penalty: float = 0.1  # of the squared weights
    steps: int = 200
    reject_at: float = 0.2  # probability of any toxic grade from which a text is rejected


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # one below each grade but the lowest, rising

    def above(self, score: float) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -50, 50)))


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of a text's words and of their first 4, 5 and 6 letters, which inflected and
    compound words share: a digest, and the logarithm of the count."""
    counts: Counter[str] = Counter()
    for word, n in Counter(_LETTERS.findall((text or "").lower())).items():
        counts[word + "$"] += n
        counts[word[:4]] += n
        counts[word[:5]] += n
        counts[word[:6]] += n
    mask = (1 << bits) - 1
    index = np.fromiter((zlib.crc32(w.encode()) & mask for w in counts), np.int32, len(counts))
    return index, np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))


def fit_ordinal(
    rows: np.ndarray, index: np.ndarray, value: np.ndarray, grade: np.ndarray, size: int,
    settings: ToxicitySettings,
) -> OrdinalModel:
    """Maximum penalised likelihood by full-gradient steps of per-coordinate size (Adam).

    `rows`, `index`, `value` are the non-zero entries; `grade` counts from 0. Thresholds are the
    lowest one and exponentials of gaps, so they rise.
    """
    n, k = len(grade), int(grade.max())
    shares = [np.clip((grade > j).mean(), 1e-6, 1 - 1e-6) for j in range(k)]
    start = np.log((1 - np.array(shares)) / np.array(shares))
    theta = np.concatenate([np.zeros(size), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    low_of, high_of = grade - 1, grade  # thresholds on either side of each row's grade
    for step in range(1, settings.steps + 1):
        w, gaps = theta[:size], np.exp(theta[size + 1 :])
        t = theta[size] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(rows, value * w[index], n)
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        lo, hi = edge[low_of + 1] - score, edge[high_of + 1] - score
        s_lo, s_hi = 1 / (1 + np.exp(-np.clip(lo, -50, 50))), 1 / (1 + np.exp(-np.clip(hi, -50, 50)))
        s_lo[lo == -np.inf], s_hi[hi == np.inf] = 0, 1
        p = np.maximum(s_hi - s_lo, 1e-12)
        d_lo, d_hi = s_lo * (1 - s_lo) / p, s_hi * (1 - s_hi) / p  # of log p, by its two edges
        d_score = (d_hi - d_lo) / n  # of the mean negative log likelihood
        grad_w = np.bincount(index, value * d_score[rows], size) + settings.penalty * w / n
        d_t = np.array([(d_lo[low_of == j].sum() - d_hi[high_of == j].sum()) / n for j in range(k)])
        grad_gaps = np.array([d_t[j:].sum() for j in range(1, k)]) * gaps
        grad = np.concatenate([grad_w, [d_t.sum()], grad_gaps])
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-10)
    t = theta[size] + np.concatenate([[0], np.cumsum(np.exp(theta[size + 1 :]))])
    return OrdinalModel(theta[:size], t)


def severity_grades(toxic: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """0 for rows not toxic; toxic rows above the median share of marked words 2, the others 1."""
    among = marked[(toxic > 0) & (marked > 0)]
    middle = np.median(among) if len(among) else np.inf
    return np.where(toxic > 0, 1 + (marked > middle), 0).astype(np.int64)


def _telling(
    rows: np.ndarray, index: np.ndarray, toxic: np.ndarray, size: int, settings: ToxicitySettings
) -> np.ndarray:
    """Features whose share of documents differs between toxic and other rows beyond chance."""
    yes = np.bincount(index, toxic[rows], size)
    both = np.bincount(index, minlength=size)
    n_yes, n = max(1, toxic.sum()), len(toxic)
    n_no, share = max(1, n - toxic.sum()), both / max(1, n)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_yes + 1 / n_no))
    z = np.abs(yes / n_yes - (both - yes) / n_no) / error
    return (both >= settings.min_documents) & (z >= settings.min_z)


def _fit_sample(pdf: pd.DataFrame, settings: ToxicitySettings) -> OrdinalModel | None:
    size = 1 << settings.bits
    # Copies would count one text's words as often as it was copied.
    pdf = pdf.sort_values("doc_id").drop_duplicates("text")
    found = [features(t, settings.bits) for t in pdf["text"]]
    rows = np.repeat(np.arange(len(found), dtype=np.int32), [len(i) for i, _ in found])
    index = np.concatenate([i for i, _ in found])
    value = np.concatenate([v for _, v in found])
    del found
    target = pdf["grade" if "grade" in pdf else "toxic"].to_numpy(np.int64)
    telling = _telling(rows, index, target > target.min(), size, settings)[index]
    rows, index, value = rows[telling], index[telling], value[telling]
    if "grade" in pdf:
        grade = target
    else:
        toxic = target
        # Words far more frequent among toxic rows mark them; how much of a text they make up grades it.
        yes = np.bincount(index, toxic[rows], size) + 0.5
        no = np.bincount(index, 1 - toxic[rows], size) + 0.5
        odds = np.log(yes / no) - np.log((toxic.sum() + 1) / (len(toxic) - toxic.sum() + 1))
        marks = (odds > 3)[index]
        weight = np.bincount(rows, np.expm1(value) * marks, len(toxic))
        grade = severity_grades(toxic, weight / np.maximum(1, np.bincount(rows, minlength=len(toxic))))
    if not len(grade) or grade.max() == grade.min():
        return None
    if not len(index):  # nothing tells the grades apart
        return None
    used, small = np.unique(index, return_inverse=True)
    model = fit_ordinal(rows, small, value, grade - grade.min(), len(used), settings)
    weights = np.zeros(size)
    weights[used] = model.weights
    return OrdinalModel(weights, model.thresholds)


def fit(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> OrdinalModel | None:
    """Model of at most `fit_rows` labelled documents, fitted in one task of that bounded size.

    `labels` has doc_id and either `grade` (0, 1, ...) or `toxic` (0/1); of the latter grades are
    made by `severity_grades`.
    """
    target = "grade" if "grade" in labels.columns else "toxic"
    rows = labels.select("doc_id", target).dropna().groupBy("doc_id").agg(F.max(target).alias(target))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.fit_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # `fit_rows` rows at most
    # Rows that repeat an id meet here, so the fitting task has a text for each id of the sample.
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max(target).alias(target))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model = _fit_sample(pdf, settings)
        if model is None:
            return pd.DataFrame({"weights": [], "thresholds": []})
        return pd.DataFrame({"weights": [model.weights.tobytes()], "thresholds": [model.thresholds.tobytes()]})

    found = texts.groupBy().applyInPandas(run, "weights binary, thresholds binary").collect()
    if not found:
        return None
    return OrdinalModel(np.frombuffer(found[0]["weights"]), np.frombuffer(found[0]["thresholds"]))


def score(docs: DataFrame, model: OrdinalModel | None, settings: ToxicitySettings = ToxicitySettings()) -> DataFrame:
    """All columns of `docs` with `expected_severity`, `p_toxic` and `rejected`, row by row; columns
    of these names are replaced."""
    spark: SparkSession = docs.sparkSession
    names = ["expected_severity", "p_toxic", "rejected"]
    docs = docs.drop(*names)
    if model is None:
        return docs.withColumns({names[0]: F.lit(0.0), names[1]: F.lit(0.0), names[2]: F.lit(False)})
    held = spark.sparkContext.broadcast(model)  # 2 ** bits weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in slices(batches, "text"):
            above = []
            for text in batch.column("text").to_pylist():
                index, value = features(text, settings.bits)
                above.append(m.above(float(m.weights[index] @ value)))
            table = np.array(above).reshape(batch.num_rows, -1)
            new = [table.sum(axis=1), table[:, 0], table[:, 0] >= settings.reject_at]
            yield pa.record_batch(
                [*batch.columns, *map(pa.array, new)], [*batch.schema.names, *names]
            )

    kinds = (T.DoubleType(), T.DoubleType(), T.BooleanType())
    added = [T.StructField(name, kind) for name, kind in zip(names, kinds)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
