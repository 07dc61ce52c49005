"""The stages of the pipeline one after another, on a table with columns of clashing names."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from condensq.llm.common import stored
from condensq.llm.near_copies import shingle_set
from condensq.llm.simhash import fingerprint_of
from tests.llm.conftest import SCHEMA

CLASHING = ("_row", "a.b", "rejected", "n_lines", "n_deleted", "sources", "_doc", "row", "key", "_others", "_times")


@pytest.fixture(scope="module")
def stages(spark, corpus_rows, tmp_path_factory):
    """What each stage gives, with its name; the first entry is the table itself."""
    sf_dir = str(tmp_path_factory.mktemp("pipeline"))
    toxic = [(900 + k, f"you {w} {w} awful thing number {k}", "en", "a", 0) for k in range(20) for w in ("zorp",)]
    rows = [*corpus_rows, *toxic, (None, "no id here at all", "en", "b", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in CLASHING:
        docs = docs.withColumn(c, F.concat(F.lit("x"), F.coalesce("doc_id", F.lit(-1))))
    labels = [(r[0], 0, int(r[0] is not None and r[0] >= 900)) for r in rows if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, stored(stage(spark, out[-1][1], sf_dir), f"test-{name}")))
    return out


def test_columns_pass_unchanged(stages):
    columns = stages[0][1].columns
    for name, found in stages[1:-1]:
        assert found.columns == columns, name
        for c in CLASHING:
            assert found.where(F.col(f"`{c}`") != F.concat(F.lit("x"), F.coalesce("doc_id", F.lit(-1)))).isEmpty(), (name, c)


def test_toxic_documents_go_and_others_stay(stages):
    before, after = (Counter((r.doc_id, r.text) for r in s[1].collect()) for s in stages[:2])
    gone = before - after
    assert not after - before
    assert {k[0] for k in gone} == {r for r in range(900, 920)}


def test_no_text_is_made_up_by_line_dedup(stages):
    before, after = ({(r.doc_id, tuple((r.text or "").split("\n"))) for r in s[1].collect()} for s in stages[1:3])
    whole = {}
    for doc, lines in before:
        whole.setdefault(doc, []).append(lines)
    for doc, lines in after:
        assert any(is_part(lines, other) for other in whole[doc])
    assert stages[2][1].where("n_chars <> length(text)").isEmpty()


def is_part(lines, of):
    at = iter(of)
    return all(any(line == other for other in at) for line in lines)


def test_one_of_each_group_of_near_copies_stays(stages):
    """Groups by all pairs; of each exactly one document is left, the one of the smallest id."""
    rows = [(r.doc_id, r.text) for r in stages[2][1].collect()]
    sets = [frozenset(shingle_set(t).tolist()) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            alike = sets[i] == sets[j] or (sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8)
            if alike and root(i) != root(j):
                group[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), (True, 0)), (doc is None, doc or 0))
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in stages[3][1].collect())
    assert kept == sorted(least.values())


def test_mix_repeats_whole_documents_three_times_at_most(stages):
    before = {(r.doc_id, r.text) for r in stages[3][1].collect()}
    after = Counter((r.doc_id, r.text) for r in stages[4][1].collect())
    assert set(after) <= before and max(after.values()) <= 3 and len(after) > 10


def test_packing_takes_every_document_of_the_mix(stages):
    docs, pieces = stages[4][1].collect(), stages[5][1].collect()
    assert Counter(r.doc_id for r in docs) == Counter(r.doc_id for r in pieces if r.piece == 0)
    filled = Counter()
    for r in pieces:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_documents_of_near_fingerprints_are_one_group(spark, tmp_path):
    """Their shingle sets are far apart, as one phrase repeats; their SimHash fingerprints are not."""
    same = "one phrase that comes again and again " * 60
    rows = [(1, same, "en", "a", 0), (2, same + "until some other words end this text at last", "en", "a", 0),
            (3, "a text of its own that nobody else has", "en", "a", 0)]
    one, two = (set(shingle_set(r[1]).tolist()) for r in rows[:2])
    assert len(one & two) / len(one | two) < 0.8
    assert bin(fingerprint_of(rows[0][1]) ^ fingerprint_of(rows[1][1])).count("1") <= 2
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]
