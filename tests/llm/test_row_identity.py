"""Rows without a key of their own: survivors of near copies, mixing, shards, names that clash."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketgauge.llm.curriculum_mix import curriculum_mix, mixed_documents
from marketgauge.llm.parity_join import near_duplicates, survivors
from marketgauge.llm.stratified_shards import stratified_shards
from marketgauge.llm.token_counts import SALTS, salt_of

from .conftest import SCHEMA, prose
from .test_tables import linked

CLASH = ["_key", "_part", "_bucket", "_rank", "_fraction", "_slice", "_place", "_held", "_offset",
         "_local", "_size", "_before", "_of", "_weight", "_demand", "_rest", "_code", "_mine",
         "_one", "_two", "_at", "_kept", "copies", "copy", "words", "component", "code"]


def groups(rows):
    """Components of rows by brute force, as lists of row numbers; rows without words alone."""
    numbered = linked(list(enumerate(t for _, t in rows)))
    out = {}
    for number, n, component in numbered:
        out.setdefault((component, n > 0), []).append(number)
    return [(sorted(v), words) for (_, words), v in out.items()]


def check_survivors(rows, kept):
    """One row of each group stays, with the least key; rows of equal key and text are one."""
    kept, wanted = Counter(kept), 0
    for members, words in groups(rows):
        if words:
            least = min(members, key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
            here = [r for r in kept if r in {rows[i] for i in members}]
            assert len(here) == 1 and kept[here[0]] == 1 and here[0][0] == rows[least][0]
            wanted += 1
    empty = {r for r in rows if not (r[1] or "").split()}
    assert {r for r in kept if not (r[1] or "").split()} == empty
    assert sum(kept.values()) == wanted + len(empty)


def near_rows():
    a, b, c = prose(31, 200), prose(32, 200), prose(33, 150)
    return [(None, a), (None, a + " one"), (1, a + " two"), (7, a + " three"), (7, b), (7, c),
            (7, c), (8, c + " x"), (9, b + " y"), (None, None), (None, None), (5, ""), (5, None),
            (5, prose(34, 90)), (6, prose(34, 90) + " z"), (5, " \n")]


def test_survivors_are_rows(spark, odd, odd_rows, empty):
    df = spark.createDataFrame(near_rows(), "doc_id long, text string").repartition(3)
    check_survivors(near_rows(), [tuple(r) for r in survivors(df).collect()])
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"]
    out = stage(spark, odd, "")
    assert out.columns == odd.columns
    check_survivors([(r[0], r[1]) for r in odd_rows],
                    [tuple(r) for r in out.select("doc_id", "text").collect()])
    assert survivors(empty).count() == 0
    assert near_duplicates(df).columns == ["doc_id", "n_shingles", "component_id"]


@pytest.fixture(scope="module")
def one_key(spark):
    """All rows under one key or none, with columns of the operators' own names."""
    rows = [(None if i % 2 else 4, prose(100 + i, 5 + i % 9), "ab"[i % 2]) for i in range(400)]
    rows += [(None, "same text", "a")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[F.lit(c).alias(c) for c in CLASH]).repartition(4).cache()


def test_shards_of_one_key(one_key):
    out = stratified_shards(one_key, ties=("text",), rows_per_bucket=20)
    assert out.columns == [*one_key.columns, "shard", "slot"]
    rows = out.collect()
    assert len(rows) == 450 and {r._offset for r in rows} == {"_offset"}
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == [
        (s, i) for s in sorted(sizes) for i in range(sizes[s])]


def test_mix_of_one_key(one_key):
    out = curriculum_mix(one_key, ties=("text",), rows_per_bucket=20)
    assert out.columns == [*one_key.columns, "size", "source_size", "target", "taken", "readings"]
    rows = out.collect()
    assert len(rows) == 450 and {(r._offset, r._part, r.words) for r in rows} == {
        ("_offset", "_part", "words")}
    for source in "ab":
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) < 1
        assert all(r.taken <= 2 * r.size for r in own)


def test_documents_of_one_key_are_mixed(one_key):
    read = mixed_documents(one_key)
    assert read.columns == one_key.columns
    rows = read.collect()
    times = Counter((r.doc_id, r.text) for r in rows)
    have = Counter((r.doc_id, r.text) for r in one_key.collect())
    assert all(n <= 2 * have[k] for k, n in times.items()) and {r._two for r in rows} == {"_two"}
    words = sum(len(t.split()) * n for (_, t), n in have.items())
    got = sum(len(t.split()) * n for (_, t), n in times.items())
    assert abs(got / words - 1.5) < 0.1
    # The copies are read as often as rows of their source are, give or take.
    assert 25 <= times[None, "same text"] <= 100


def test_salts_are_spread():
    # The first block of each partition, and the blocks of one.
    for blocks in ([p << 24 for p in range(4096)], list(range(5 << 24, (5 << 24) + 4096))):
        used = np.bincount([salt_of(b) for b in blocks], minlength=SALTS)
        assert used.max() < 5 * len(blocks) / SALTS and (used > 0).mean() > 0.95


def test_pipeline_keeps_clashing_columns(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, SCHEMA).select(
        "*", *[F.lit(c).alias(c) for c in CLASH if c != "_key"])
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == df.columns, name
    assert docs.count() > 0 and docs.select("_rest", "_part").distinct().collect() == [
        ("_rest", "_part")]
