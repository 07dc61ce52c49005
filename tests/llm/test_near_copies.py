import random

from condensq.llm import near_copies


def runs(text, k=5):
    words = [w for w in (text or "").lower().replace("\n", " ").split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def smallest(rows, threshold=0.8):
    """Ids of the first row of each class, by all pairs."""
    sets = [runs(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= threshold * len(a | b) - 1e-9:
                pairs += a != b
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {rows[i][0] for i in range(len(rows)) if root(i) == i}, pairs


def corpus():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    line = " ".join(word() for _ in range(14))
    texts = []
    for g in range(25):
        base = [word() for _ in range(rng.choice([12, 60, 200]))]
        for j in range(40 if g == 0 else 3):  # edits on both sides of the threshold
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 30) if j else 0):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w) + "\n" + line)
    texts += [texts[0]] * 5 + ["", None, "  ", "a b", "a b", "A b", "c"]
    return list(enumerate(texts))


def test_all_near_copies_at_the_threshold_go(spark):
    rows = corpus()
    want, pairs = smallest(rows)
    assert pairs > 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    import corpus_pipeline

    got = [r["doc_id"] for r in corpus_pipeline.one_of_near_copies(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_rows_of_equal_id_or_without_one(spark):
    rows = [(1, "quite different words here in one text"), (1, "another text that has the same id"),
            (1, "another text that has the same id"), (None, "no id but a text of its own"),
            (None, "no id but a text of its own"), (None, "quite different words here in one text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["text"]) for r in near_copies.one_of_each(docs).collect())
    assert got == [(-1, rows[3][1]), (1, rows[1][1]), (1, rows[0][1])]
    assert near_copies.one_of_each(docs.limit(0)).count() == 0
