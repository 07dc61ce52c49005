"""Toxicity, repeated passages, line dedup, perplexity, SpotSigs and mixing."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from condensq.llm import lines, mixing, perplexity, spotsigs, suffixes, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- toxicity


def test_ordinal_fit_orders_thresholds_and_recovers_severity():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    latent = x @ [2.0, -1.0, 0.0] + rng.logistic(size=4000)
    grade = (latent > 0).astype(int) + (latent > 2)
    rows, index = np.repeat(np.arange(4000), 3), np.tile(np.arange(3), 4000)
    model = toxicity.fit_ordinal(rows, index, x.ravel(), grade, 3, toxicity.ToxicitySettings(penalty=0.0, steps=400))
    assert np.allclose(model.weights, [2, -1, 0], atol=0.2)
    assert np.allclose(model.thresholds, [0, 2], atol=0.2)


def test_toxic_words_raise_severity_and_clean_texts_stay(spark, empty):
    rng = np.random.default_rng(1)
    plain = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    bad = ["vileness", "vilefoo", "vilebar", "scumlike"]

    def text(k):
        words = list(rng.choice(plain, 60))
        words[:k] = rng.choice(bad, k)
        return " ".join(words)

    counts = [0 if i % 5 else 2 + (i // 5) % 12 for i in range(900)]
    rows = [(i, text(k), f"x{i}", "y") for i, k in enumerate(counts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rejected string, grade string")
    labels = spark.createDataFrame([(i, int(k > 0)) for i, k in enumerate(counts) if i % 3], "doc_id long, toxic int")
    model = toxicity.fit(docs.union(docs.limit(50)), labels.union(labels.limit(5)))
    assert (np.diff(model.thresholds) > 0).all()
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held_out = [i for i in range(900) if i % 3 == 0]
    assert all(found[i]["rejected"] == (counts[i] > 0) for i in held_out)
    few = np.mean([found[i]["expected_severity"] for i in held_out if 0 < counts[i] < 5])
    many = np.mean([found[i]["expected_severity"] for i in held_out if counts[i] > 9])
    assert 0.3 < few < many <= 2
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "?!")], "doc_id long, text string")
    assert not any(r["rejected"] for r in toxicity.score(odd, model).collect())
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert toxicity.fit(docs, labels.filter("toxic = 0")) is None
    assert not any(r["rejected"] for r in toxicity.score(odd, None).collect())


# --- repeated passages


def repeated(rows, length):
    """{(row number): covered spans} by counting every passage."""
    places = {}
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    for k, w in enumerate(words):
        for i in range(len(w) - length + 1):
            places.setdefault(tuple(w[i : i + length]), []).append((k, i))
    out = []
    for k, w in enumerate(words):
        start = stop = None
        ids = []
        for i in range(len(w) - length + 1):
            found = places[tuple(w[i : i + length])]
            if len(found) < 2:
                continue
            if start is not None and i > stop:
                out.append((rows[k][0], start, stop, min(ids)))
                start, ids = None, []
            if start is None:
                start = i
            stop = i + length
            ids += [rows[m][0] for m, _ in found]
        if start is not None:
            out.append((rows[k][0], start, stop, min(ids)))
    return sorted(out)


@pytest.mark.parametrize("length, gram, window", [(50, 5, 21), (12, 3, 5)])
def test_repeated_spans_equal_brute_force(docs, empty, corpus_rows, length, gram, window):
    found = suffixes.repeated_spans(docs, length, gram, window).collect()
    assert sorted((r["doc_id"], r["start"], r["stop"], r["first_doc"]) for r in found) == repeated(corpus_rows, length)
    texts = {r[0]: r[1] for r in corpus_rows}
    for r in found:
        part = texts[r["doc_id"]][r["start_char"] : r["stop_char"]]
        assert WORD.findall(part) == WORD.findall(texts[r["doc_id"]])[r["start"] : r["stop"]]
    assert suffixes.repeated_spans(empty).count() == 0


def test_a_suffix_of_a_core_on_many_stretches_is_one_row():
    """Not one for each of its passages: suffixes with the same passages share a row of counts."""
    batch = pa.record_batch({"doc_id": [5, 6, 7], "row": [50, 60, 70], "at": pa.array([3, 4, 5], pa.int32())})
    keys = np.array([[1, 2, 3], [1, 2, 3], [1, 2, 9]], np.uint64)
    inside = np.array([[True, True, False]] * 2 + [[False, True, True]])
    places = np.arange(18).reshape(3, 2, 3)
    out = suffixes._going_on(batch, np.arange(3), keys, inside, places, np.full(3, 8, np.uint64)).to_pylist()
    found = {tuple(m["doc_id"] for m in r["members"]): r for r in out}
    assert sorted(found) == [(5, 6), (7,)]
    assert [(p["key"], p["shift"]) for p in found[5, 6]["passages"]] == [(1, 0), (2, 1)]
    assert [(p["key"], p["shift"]) for p in found[7,]["passages"]] == [(2, 1), (9, 2)]
    assert found[5, 6]["members"][1] == {"doc_id": 6, "row": 60, "at": 4, "begins": [6, 7, 8], "ends": [9, 10, 11]}


def test_passages_of_cores_on_many_stretches(spark):
    shared = " ".join(f"s{i}" for i in range(9))
    rows = [(None, f"{shared} end{i % 3} of it and more words {i}") for i in range(3)]
    rows += [(i, f"w{i % 4} v{i % 5} {shared} a{i % 3} b{i % 2} c{i} d e f g h") for i in range(40)]
    rows += [(7, f"w3 v2 {shared} a1 b1 c7 d e f g h")] * 2 + [(50, None), (51, ""), (52, "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    some = suffixes.repeated_spans(df, 12, 3, 5, stretch=3).collect()
    whole = suffixes.repeated_spans(df, 12, 3, 5).collect()
    assert sorted(map(str, some)) == sorted(map(str, whole))
    known = [r for r in rows if r[0] is not None]
    found = suffixes.repeated_spans(spark.createDataFrame(known, df.schema), 12, 3, 5, stretch=3).collect()
    assert sorted((r["doc_id"], r["start"], r["stop"], r["first_doc"]) for r in found) == repeated(known, 12)


def test_run_digests_depend_on_the_run_alone():
    w = suffixes.word_digests(" ".join(map(str, range(100))) + " x " + " ".join(map(str, range(100))))
    for n in (1, 2, 5, 30, 50, 64):
        d = suffixes.run_digests(w, n)
        assert len(d) == len(w) - n + 1 and d[0] == d[101]
        assert len(set(d.tolist())) == len({tuple(w[i : i + n]) for i in range(len(d))})


# --- line dedup


def test_line_blocks_go_from_the_later_document(spark):
    a = "first line has words enough\nshort\nsecond line has words enough\nonly here in the first one"
    b = "new text of the later one\nfirst line has words enough\nshort\nsecond line has words enough\nshort\nend"
    c = "second line has words enough\nquite other words in this line\nfirst line has words enough"
    rows = [(1, a), (2, b), (3, c), (4, a), (5, None), (6, ""), (7, "short\nshort"), (8, "short\nshort")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_lines string")
    out = {r["doc_id"]: r for r in lines.dedup_lines(df, 3, 4).collect()}
    assert out[1]["text"] == a
    assert out[2]["text"] == "new text of the later one\nshort\nend" and out[2]["n_deleted"] == 3
    # Crossed lines: the alignment keeps one of the two.
    assert out[3]["n_deleted"] == 1
    assert out[4]["text"] == "" and out[4]["n_deleted"] == 4
    assert out[5]["text"] is None and out[5]["n_lines"] == 0
    assert out[6]["text"] == "" and out[7]["text"] == out[8]["text"] == "short\nshort"


def test_line_dedup_loses_no_content(docs, empty, corpus_rows):
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_deleted"]
    got = out.collect()
    assert len(got) == len(corpus_rows)
    texts = {r[0]: r[1] for r in corpus_rows}
    before, after, order = set(), set(), {}
    for r in got:
        old, new = (texts[r["doc_id"]] or "").split("\n"), (r["text"] or "").split("\n")
        assert len(old) - (0 if not r["text"] and r["n_deleted"] else len(new)) == r["n_deleted"]
        it = iter(old)
        assert not r["text"] or all(x in it for x in new)  # lines stay in order
        before |= {x for x in old if x.strip()}
        after |= set(new)
        order.setdefault(r["doc_id"], r)
        assert r["row"] == r["key"] == f"x{r['doc_id']}"  # columns of clashing names stay as they are
    assert before <= after  # each line is still in some document
    first = {}
    for i, t in sorted((i, t) for i, t in texts.items() if t and len(WORD.findall(t)) >= 8):
        if t in first:
            assert order[i]["text"] == ""
        first.setdefault(t, i)
    assert lines.dedup_lines(empty).count() == 0


def blocks(text, least):
    """Every block of whole lines with `least` words or more, first and last line with a word."""
    lines_ = text.split("\n")
    n = [len(WORD.findall(x)) for x in lines_]
    for i in range(len(lines_)):
        for j in range(i, len(lines_)):
            if n[i] and n[j] and sum(n[i : j + 1]) >= least:
                yield i, j, "\n".join(lines_[i : j + 1])


def shared_blocks(texts, least):
    """{id: blocks of it that a document of smaller id holds}, by comparing them all."""
    seen, out = set(), {}
    for doc in sorted(texts):
        own = list(blocks(texts[doc], least))
        out[doc] = [(i, j) for i, j, block in own if block in seen]
        seen |= {block for *_, block in own}
    return out


def test_line_blocks_of_every_kind_go(spark):
    long = [f"line {i} has words enough for a block by itself" for i in range(6)]
    verse = [f"verse {i}" for i in range(30)]
    texts = {
        1: [*long[:3], *verse[:9]],
        2: [*long[3:], *verse[20:]],
        3: ["mine alone", *long[:2], "", "", *long[3:5], "also mine"],  # first holders 1 and 2
        4: ["head", *verse[2:8], "tail of 4", *verse[22:27]],  # short lines only
        5: [long[0], "between", long[0], "again", long[0]],  # repeated inside the later one
        6: ["one two", "three four five six", "", "seven eight", "six only of 6"],
        7: ["x", "one two", "three four five six", "", "seven eight", "", ""],
        8: ["", "", *verse[:9], ""],
        9: [*verse[:3], "verse 77"],  # six shared words: too few
    }
    texts = {k: "\n".join(v) for k, v in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}
    for doc, found in shared_blocks(texts, 8).items():
        old = texts[doc].split("\n")
        gone = {k for i, j in found for k in range(i, j + 1)}
        assert [x for x in out[doc].split("\n") if x] == [x for k, x in enumerate(old) if x and k not in gone], doc
    assert out[8] == "" and out[3] == "mine alone\nalso mine" and out[9] == texts[9]


def test_only_lines_of_shared_blocks_go(spark):
    rng = random.Random(5)
    pool = [" ".join(f"p{i}w{k}" for k in range(rng.choice((1, 2, 3, 9)))) for i in range(25)] + [""]
    texts = {i: "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}
    dropped = 0
    for doc, found in shared_blocks(texts, 8).items():
        gone = {x for i, j in found for x in texts[doc].split("\n")[i : j + 1]}
        lost = Counter(texts[doc].split("\n")) - Counter(out[doc].split("\n"))
        dropped += len(lost)
        assert set(lost) <= gone | {""}
        # An alignment keeps one run of each first holder at least.
        assert not found or any(lost.values())
    assert dropped


# --- quality


def base(text):
    words, lines_ = WORD.findall(text or ""), (text or "").split("\n")
    runs = {}
    for i in range(len(words) - 7):
        runs.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated_ = {i + k for at in runs.values() if len(at) > 1 for i in at for k in range(8)}
    dup = sum(1 for i, x in enumerate(lines_) if WORD.search(x) and x in lines_[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated_)


def test_base_counts_equal_brute_force(corpus_rows):
    odd = ["a\xa0b \x1c c\x85", "x y z a b c d e " * 5, "\n\n a\n a\na\n", "é 😀 中\t\v\f\r\n", "a " * 9]
    for text in [*odd, *(r[1] for r in corpus_rows)]:
        assert perplexity.base_counts(text) == base(text), text


def test_kneser_ney_sums_to_one_and_backs_off():
    keys, n = np.unique(np.concatenate([perplexity.grams(t) for t in ("abracadabra, abra!", "candelabra\nbar")]), return_counts=True)
    model = perplexity.kneser_ney(keys, n)
    for context in {*(keys[:10] >> 6).tolist(), 5, 70_000}:
        every = (np.int64(context) << 6) | np.arange(64)
        assert math.isclose(np.exp(perplexity.log_probabilities(model, every)).sum(), 1, rel_tol=1e-9)
    seen = perplexity.log_probabilities(model, keys)
    assert (seen < 0).all() and seen.mean() > perplexity.log_probabilities(model, np.arange(5000, 5100)).mean()


def test_counts_and_verdicts(docs, empty, corpus_rows):
    counted = {(r["lang"], r["gram"]): r["n"] for r in perplexity.count_grams(docs).collect()}
    want = {}
    for _, text, lang, *_ in corpus_rows:
        for g in perplexity.grams(text).tolist():
            want[lang, g] = want.get((lang, g), 0) + 1
    assert counted == want
    rows = perplexity.quality(docs).collect()
    assert len(rows) == len(corpus_rows)
    for r in rows:
        b = base(next(x[1] for x in corpus_rows if x[0] == r["doc_id"]))
        assert r["base_failed"] == (b[0] < 20 or 100 * b[4] > 30 * b[0])
        assert not (r["base_failed"] and r["kept"])
        assert (r["log_perplexity"] is None) == (b[0] == 0)
    assert perplexity.quality(empty).count() == 0


def test_characters_of_a_class_are_told_apart(spark):
    """Case, digits and letters of any script decide, and the characters of a class share its probability."""
    twins = [("year 2007", "year 2079"), ("the end", "tHe eNd"), ("\u4e2d\u6587 \u4e2d\u6587", "\u4e4d\u65a7 \u4ead\u6587"), ("a, b", "a; b")]
    for a, b in twins:
        assert (perplexity.grams(a) == perplexity.grams(b)).all()
        assert len(perplexity.pairs(a)) == len(a) and (perplexity.pairs(a) != perplexity.pairs(b)).any()
    words = "The year 2007 saw the end, 2007 and \u4e2d\u6587 \u4e2d\u6587. "
    rows = [(i, words * (2 + i % 3), "en") for i in range(30)]
    rows += [(90, "tHe yEar 7392 sAw thE eNd; 8165 aNd \u4e4d\u65a7 \u4ead\u6587! " * 3, "en")]
    out = {r["doc_id"]: r for r in perplexity.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert out[90]["log_perplexity"] > 1.5 * max(out[i]["log_perplexity"] for i in range(30))
    # Against the definition: sums to one over the characters of a class, whatever goes before.
    found = np.concatenate([perplexity.pairs(r[1]) for r in rows])
    keys, n = np.unique(found, return_counts=True)
    arrays = perplexity.emissions(keys, n)
    model = perplexity.Emissions(arrays)
    codes = arrays[4]
    for before in (ord("2"), ord("e"), 0x4E2D, 0x1F600):
        p = np.exp(model(np.int64(before) << 21 | codes))
        sums = np.bincount(perplexity.classes(codes), p, 64)
        assert np.allclose(sums[np.unique(perplexity.classes(codes))], 1)
    rare = perplexity.Emissions(arrays)
    rare.rank[:], rare.table[:] = perplexity.COMMON, np.nan  # without the table
    assert np.allclose(rare(found), model(found)) and (model(found) <= 0).all()
    assert model(np.array([ord("a") << 21 | 0x10FFFF]))[0] < model(keys).min()


def test_gibberish_is_outside_the_band(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeiou")) + rng.choice(list("bcdlmnrst")) for _ in range(3)) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(words, 60)), "en") for i in range(200)]
    rows += [(900, " ".join("".join(rng.choice(list("qxzjkvw#%")) for _ in range(6)) for _ in range(60)), "en")]
    out = {r["doc_id"]: r["kept"] for r in perplexity.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not out[900] and sum(out.values()) >= 198


# --- SpotSigs


def test_next_document_and_edit(docs, corpus_rows, empty):
    for rows_each in (10, 4000):
        got = spotsigs.with_next(docs, rows_each).withColumn("e", spotsigs.edited()).collect()
        assert len(got) == len(corpus_rows)
        texts = {r[0]: r[1] or "" for r in corpus_rows}
        ids = sorted((r[0] for r in corpus_rows), reverse=True)
        following = {}
        for i, x in enumerate(ids):
            following.setdefault(x, []).append(ids[(i + 1) % len(ids)])
        for r in got:
            assert r["next_text"] in {texts[i] for i in following[r["doc_id"]]}
            t, half = r["text"], len(r["text"]) // 2
            assert r["e"] == t[: len(t) - half] + r["next_text"][:half]
    assert spotsigs.with_next(empty).count() == 0


def test_signatures_are_chains_after_anchors(spark):
    df = spark.createDataFrame(
        [(1, "The quick brown fox of the world, jumps"), (2, "the QUICK, brown: fox of the world jumps!"),
         (3, "quick brown"), (4, None), (5, ""), (6, "..."), (7, "The quick brown fox ran")],
        "doc_id long, text string",
    )
    s = {r["doc_id"]: r["s"] for r in spotsigs.signatures(df, "text", "s").collect()}
    assert s[1] == s[2] and len(s[1]) == 3  # the+quick.., of+world.., the+world..
    assert s[4] == s[5] != s[6] and all(s.values())
    assert len(set(s[7]) & set(s[1])) == 1
    pair = spark.createDataFrame([([1, 2, 3], [2, 3, 4])], "a array<int>, b array<int>")
    assert pair.select(spotsigs.likeness("a", "b")).first()[0] == 0.5


def test_near_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    sets = [sorted(rng.choice(60, rng.integers(3, 30), replace=False).tolist()) for _ in range(60)]
    sets += [sorted({*s[1:], 99}) for s in sets[:30]] + sets[:5]
    df = spark.createDataFrame(list(enumerate(sets)), "doc_id long, sigs array<int>")
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    want = set()
    for a, i in first.items():
        for b, j in first.items():
            like = len({*a} & {*b}) / len({*a} | {*b})
            if i < j and like >= 0.8:
                want.add((i, j))
    assert {tuple(sorted((r["a"], r["b"]))) for r in spotsigs.near_pairs(df).collect()} == want and want


# --- mixing


def test_quotas_refill_until_none_is_above():
    got = mixing.quotas({"a": 10, "b": 1000, "c": 100}, {"a": 1, "b": 1, "c": 1})
    assert got["a"] == 30 and got["c"] == 300 and math.isclose(sum(got.values()), 1110)
    assert mixing.quotas({"a": 0}, {"a": 1}) == {"a": 0}
    assert mixing.cyclic_weights(["b", None, "a", "é"]) == {"a": 1, "b": 2, "é": 3, None: 1}


def test_flow_is_cheapest():
    # Two sources share a pattern: fresh words of the shared one are used before any repeat.
    got = mixing.cheapest_flow({0: 10, 1: 10, 2: 10}, {0: ["a"], 1: ["a", "b"], 2: ["b"]}, {"a": 20, "b": 10})
    assert got == {0: 10, 1: 10, 2: 10}
    got = mixing.cheapest_flow({0: 10, 1: 10}, {0: ["a"], 1: ["b"]}, {"a": 25, "b": 4})
    assert got == {0: 25, 1: 4}
    assert sum(mixing.cheapest_flow({0: 10}, {0: ["a"]}, {"a": 99}).values()) == 30


def test_mix_comes_near_its_targets(docs, empty, corpus_rows, spark):
    rows = mixing.allocate(docs).collect()
    assert len(rows) == len(corpus_rows)
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in corpus_rows}
    source = {r[0]: r[3] for r in corpus_rows}
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"]
        sizes[s], taken[s], target[s] = r["source_size"], taken.get(s, 0) + r["taken"], r["target"]
    want = mixing.quotas(sizes, mixing.cyclic_weights(list(sizes)))
    for s in sizes:
        assert sizes[s] == sum(size[r[0]] for r in corpus_rows if r[3] == s)
        assert math.isclose(target[s], want[s]) and abs(taken[s] - target[s]) <= max(size.values())
    again = {(r["doc_id"], r["taken"]) for r in mixing.allocate(docs.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}
    times = {}
    for r in mixing.mixed(docs).collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
        assert r["key"] == r["size"] == f"x{r['doc_id']}"
    for i in size:
        assert times.get(i, 0) * size[i] == sum(r["taken"] for r in rows if r["doc_id"] == i)
    assert mixing.allocate(empty).count() == 0 and mixing.mixed(empty).count() == 0
    inner = docs.selectExpr("doc_id", "text", "source", "1 AS _own", "2 AS _key", "3 AS _times", "4 AS _n")
    assert {tuple(r)[3:] for r in mixing.mixed(inner).collect()} == {(1, 2, 3, 4)}
    both = docs.selectExpr("doc_id", "text", "array(source, 'all') AS sources")
    assert mixing.allocate(both, {"all": 1.0}).count() == len(corpus_rows)


def test_edited_digest(spark):
    df = spark.createDataFrame([("abcdé", "xy")], "text string, next_text string")
    assert hashlib.sha256(b"abcxy").hexdigest() == df.selectExpr("text", "next_text").withColumn("e", spotsigs.edited()).selectExpr("sha2(e, 256)").first()[0]
