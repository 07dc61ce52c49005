import numpy as np
from xxhash import xxh64_intdigest

from condensq.llm import simhash


def plain(text, k=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(items, budget):
    """{id: smallest id reachable} by all pairs."""
    parent = {i: i for i, _ in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in items:
        for j, b in items:
            if (a ^ b).bit_count() <= budget:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in items}


def test_fingerprints_and_classes_equal_brute_force(docs, corpus_rows):
    for budget in (2, 20):
        found = simhash.near_duplicates(docs, budget=budget).collect()
        assert len(found) == len(corpus_rows)
        prints = {r["doc_id"]: r["fp"] % (1 << 64) for r in found}
        assert prints == {r[0]: plain(r[1]) for r in corpus_rows}
        assert {r["doc_id"]: r["component_id"] for r in found} == classes(list(prints.items()), budget)


def test_trie_finds_every_pair_of_crowded_points(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 4, dtype=np.uint64)
    near = [c ^ np.uint64(int(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))) for c in centre for _ in range(80)]
    a = np.unique(np.concatenate([np.array(near, np.uint64), rng.integers(0, 2**63, 300, dtype=np.uint64)]))
    starts = [int(np.searchsorted(a >> np.uint64(60), p)) for p in range(17)]
    roots = [(starts[p], starts[p + 1], starts[q], starts[q + 1]) for p in range(16) for q in range(16)
             if starts[p] < starts[p + 1] and starts[q] < starts[q + 1]]
    i, j = simhash.trie_pairs(a, a, roots, 4, 2)
    want = {(x, y) for x in range(len(a)) for y in range(len(a)) if int(a[x] ^ a[y]).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist())) == want
    points = spark.createDataFrame([(int(v), k) for k, v in enumerate(a.view(np.int64))], "fp long, rep long")
    from condensq.llm.common import components

    for leaf in (4, 64, 1024):
        got = {r["node"]: r["component"] for r in components(simhash.links(points, 2, leaf)).collect()}
        full = classes([(k, int(v)) for k, v in enumerate(a)], 2)
        assert {k: got.get(k, k) for k in full} == full


def test_one_of_each_keeps_the_smallest_id(docs, empty, corpus_rows):
    got = sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    prints = {r[0]: plain(r[1]) for r in corpus_rows}
    assert got == sorted(set(classes(list(prints.items()), 2).values()))
    assert simhash.one_of_each(docs).columns == docs.columns
    assert simhash.near_duplicates(empty).count() == 0


def test_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "other words"), (5, "a b c d")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(df).collect() if r["component_id"])
    assert got == [(-1, 5), (5, 5)]
    assert simhash.one_of_each(df).count() == 3
