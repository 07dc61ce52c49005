import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def corpus(n=60, seed=1):
    """Texts with copies, near copies, shared passages and lines, very long and odd ones."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "la", "de", *("".join(rng.choices("abcdefgilmnorstué", k=rng.randint(3, 9))) for _ in range(400))]
    passage = " ".join(rng.choices(vocabulary, k=64))
    boiler = "Licensed under terms that all of these documents share."

    def text(words):
        out = rng.choices(vocabulary, k=words)
        for i in range(7, words, 9):
            out[i] += ".\n" if rng.random() < 0.4 else ","
        return " ".join(out).replace("\n ", "\n")

    rows = []
    for i in range(n):
        t = text(rng.choice([3, 25, 60, 120, 300]))
        if i % 7 == 3:
            t = t + "\n" + passage + "\n" + text(10)
        if i % 5 == 2:
            t += "\n" + boiler
        if i % 9 == 4 and rows:
            t = rows[rng.randrange(len(rows))][1]
        if i % 11 == 5 and rows:
            t = (rows[-1][1] or "") + " tail"
        rows.append([i, t, rng.choice(["en", "fr", None]), rng.choice(["b", "a", "é", None]), 0])
    rows += [
        [n, None, "en", "a", None], [n + 1, "", None, None, 0], [n + 2, "   \n\n ", "en", "b", 1],
        [n + 3, text(9000), "fr", "a", 2], [n + 4, "same line here again now\n" * 40, "en", "a", 2],
        [n + 5, "$$$ ### |||", "en", "b", 2], [n + 6, None, None, "z", 2],
    ]
    rows += [list(rows[3]), list(rows[3]), list(rows[n])]  # repeated rows
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def corpus_rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, corpus_rows):
    """The corpus with extra columns under names the operators use themselves."""
    df = spark.createDataFrame(corpus_rows, SCHEMA).repartition(5)
    for c in ("row", "key", "h", "size", "taken", "rank", "n", "fp", "component_id", "rejected", "sigs", "_b", "start"):
        df = df.selectExpr("*", f"concat('x', doc_id) AS `{c}`")
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session", autouse=True)
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
