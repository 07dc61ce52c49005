"""Packing, attribution and ORC files, all over encoded texts."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from condensq.llm import attribution, orc_ids, packing
from condensq.llm.encoding import Encoder, vocabulary_path


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(vocabulary_path())  # as the library has it
    return lambda text: t.encode(text or "", add_special_tokens=False)


def test_encoder_equals_the_library(library, corpus_rows):
    rng = random.Random(5)
    marks = ["a", "bc", " ", "  ", "\n", "\t", ".", ",", "é", "1", "'s", "\x1c", "\x85", " ", "<|endoftext|>", "中", "😀", "#", "ª", "Σ"]
    odd = ["".join(rng.choices(marks, k=rng.randint(0, 12))) for _ in range(4000)]
    enc = Encoder(cache_size=50)
    lengths = enc.byte_lengths()
    special = ["<|endoftext|>", "a <|endoftext|> b", " <|endoftext|>\n<|endoftext|><|endoftext|>x", "<|endoftext", "é<|endoftext|>é"]
    for text in [*odd, *special, *(r[1] for r in corpus_rows)]:
        ids = np.frombuffer(enc.encode(text), "<u4")
        assert ids.tolist() == library(text).ids, text
        assert lengths[ids].sum() == len((text or "").encode())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_is_whole_gapless_and_tight(docs, empty, corpus_rows, library):
    rows = packing.pack(docs).collect()
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["row"]), []).append(r)
    assert len(by) == len(corpus_rows)
    texts = {r[0]: r[1] for r in corpus_rows}
    for (doc, _), parts in by.items():
        ids = [*library(texts[doc]).ids, 0]
        parts.sort(key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(parts):
            assert (r["piece"], r["start"]) == (k, at) and 0 < r["length"] <= 2048
            assert k == 0 or r["length"] == 2048
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(places) <= -(-total // 2048) + 2
    assert packing.pack(empty).count() == 0


def test_sequences_hold_the_ids_of_their_pieces(docs):
    placed = packing.packed(packing.pieces(docs, with_ids=True))
    for r in packing.sequences(placed).collect():
        assert 0 < len(r["ids"]) <= 2048


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_each_piece_once(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 40): rng.randint(1, 30) for _ in range(25)}
    used, places = {}, {}
    for length, first, count, sequence, offset in packing.plan(histogram, 40):
        assert first == used.get(length, 0)
        used[length] = first + count
        for k in range(count):
            places.setdefault(sequence + k, []).append((offset, length))
    assert used == histogram
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40
    assert packing.plan({10: 4, 20: 2, 5: 8}, 40)[-1][3] == 2  # 120 in three full sequences


def test_token_spans_are_those_of_the_library(library, corpus_rows):
    enc = Encoder()
    for text in ["naïve café 😀 x", "a\n\nb", *(r[1] or "" for r in corpus_rows)]:
        first, last = attribution.token_spans(np.frombuffer(enc.encode(text), "<u4"), text, enc.byte_lengths())
        spans = library(text).offsets
        # The library's spans leave out a leading space.
        assert [(b) for b in last.tolist()] == [b for _, b in spans]
        assert all(a <= c <= a + 1 or text[a:c].isspace() for a, (c, _) in zip(first.tolist(), spans))


def test_rules_for_crossing_tokens():
    first, last = np.array([0, 2, 6, 9]), np.array([2, 6, 9, 12])
    sections = np.array([[0, 3], [3, 3], [3, 9], [10, 12]])
    for rule, tokens in (("majority", [1, 0, 2, 1, 0]), ("first", [2, 0, 1, 1, 0]), ("share", [1.25, 0, 1.75, 1, 0])):
        got, crossing = attribution.attribute_spans(first, last, sections, rule)
        assert got.tolist() == tokens
        assert crossing.sum() == 1
    got, _ = attribution.attribute_spans(first, last, np.array([[0, 2]]))
    assert got.tolist() == [1, 3]  # three in no section
    with pytest.raises(ValueError):
        attribution.attribute_spans(first, last, sections, "other")


def test_section_tokens_add_up(docs, empty, corpus_rows, library):
    rows = attribution.section_tokens(docs).collect()
    texts = {r[0]: r[1] or "" for r in corpus_rows}
    copies = {i: sum(r[0] == i for r in corpus_rows) for i in texts}
    sums, lines = {}, {}
    for r in rows:
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + r["n_tokens"]
        lines[r["doc_id"]] = lines.get(r["doc_id"], 0) + 1
    for doc, text in texts.items():
        assert sums[doc] == copies[doc] * len(library(text).ids)
        assert lines[doc] == copies[doc] * (text.count("\n") + 1)
    assert attribution.section_tokens(empty).count() == 0


def test_orc_round_trip_and_pruned_lookup(spark, docs, empty, corpus_rows, library, tmp_path):
    path = str(tmp_path / "ids")
    orc_ids.write_ids(docs, path)
    rows = sorted(orc_ids.digests(orc_ids.read_ids(spark, path)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(r[0] for r in corpus_rows)
    texts, at = {r[0]: r[1] for r in corpus_rows}, 0
    for r in rows:
        ids = [*library(texts[r["doc_id"]]).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    got = orc_ids.lookup(spark, path, [7, 9])
    assert "PushedFilters: [In(doc_id" in got._jdf.queryExecution().toString()
    assert sorted(r["doc_id"] for r in got.collect()) == [7, 9]
    orc_ids.write_ids(empty, str(tmp_path / "none"))
    assert orc_ids.digests(orc_ids.read_ids(spark, str(tmp_path / "none"))).count() == 0
