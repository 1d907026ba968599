"""Operators that look at the whole table."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketgauge.llm import parity_join, suffix_dedup, word_codes
from marketgauge.llm.components import components
from marketgauge.llm.curriculum_mix import (curriculum_mix, mixed_documents, source_targets,
                                            training_order)
from marketgauge.llm.merkle_fingerprints import (edit_fingerprints, edited_paragraphs, likeness,
                                                 with_fingerprint)
from marketgauge.llm.stratified_shards import stratified_shards
from marketgauge.llm.token_counts import count_tokens

from .conftest import prose

BYTES = public_tokenizers.path("byte_bpe_50k.json")
LOW = -2 ** 63


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_shards(odd, empty, documents):
    for df, per in ((odd, 50_000), (documents, 10), (odd, 1)):
        out = stratified_shards(df.drop("text"), rows_per_bucket=per, ties=("n_chars",)).collect()
        slots = defaultdict(list)
        for r in out:
            slots[r.shard].append(r.slot)
        assert len(out) == df.count()
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots[k]) for k in range(24)]
        assert max(sizes) - min(sizes) <= 1
        mixture = Counter((r.shard, r.source) for r in out)
        for source, n in Counter(r.source for r in out).items():
            assert all(abs(mixture[k, source] - n / 24) <= 1.01 for k in range(24))
    assert stratified_shards(empty).count() == 0


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 400), (None, 90)],
                                  "source string, source_size long")
    got = {r.source: (r.weight, r.target) for r in source_targets(sizes).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": 5, "b": 2, "c": 1, None: 5}
    assert sum(v[1] for v in got.values()) == pytest.approx(2250)
    caps = {"a": 20, "b": 2000, "c": 800, None: 180}
    # By hand: what is above is dealt anew until none is.
    want, open_, left = {}, dict(got), 2250.0
    while True:
        level = left / sum(got[k][0] for k in open_)
        over = [k for k in open_ if level * got[k][0] > caps[k]]
        if not over:
            break
        for k in over:
            want[k] = caps[k]
            left -= caps[k]
            del open_[k]
    want |= {k: level * got[k][0] for k in open_}
    assert all(got[k][1] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("per", [50_000, 20])
def test_mix(documents, odd, empty, per):
    for df in (documents, odd):
        out = curriculum_mix(df, rows_per_bucket=per).collect()
        assert len(out) == df.count()
        taken = Counter()
        for r in out:
            assert 0 <= r.taken <= 2 * r.size
            assert all(0 <= x.position <= 1 for x in r.readings)
            taken[r.source] += r.taken
        for r in out:
            assert abs(taken[r.source] - r.target) < 1
    assert plain(curriculum_mix(odd).select("doc_id", "taken", "target").collect()) == plain(
        curriculum_mix(odd.repartition(2)).select("doc_id", "taken", "target").collect())
    order = [r.position for r in training_order(curriculum_mix(documents)).collect()]
    assert order == sorted(order)
    assert curriculum_mix(empty).count() == 0


def test_schedules_hold(spark):
    """A source with a falling schedule is read early, one with a rising one late."""
    df = spark.createDataFrame([(i, "w " * 10, "abc"[i % 3]) for i in range(3000)],
                               "doc_id long, text string, source string")
    rows = training_order(curriculum_mix(df)).collect()
    early = Counter(r.source for r in rows if r.position < 0.5)
    whole = Counter(r.source for r in rows)
    assert early["a"] / whole["a"] == pytest.approx(0.625, abs=0.02)  # area under 1.5 to 1
    assert early["b"] / whole["b"] == pytest.approx(0.5, abs=0.02)
    assert early["c"] / whole["c"] == pytest.approx(0.375, abs=0.02)


def test_mixed_documents(documents, odd, empty):
    out = mixed_documents(documents)
    assert out.columns == documents.columns
    times = Counter(r.doc_id for r in out.collect())
    assert max(times.values()) == 2
    assert mixed_documents(odd).columns == odd.columns
    assert mixed_documents(empty).count() == 0


def test_fingerprints(odd, empty, odd_rows):
    rows = edit_fingerprints(odd).collect()
    assert len(rows) == len(odd_rows)
    by_key = defaultdict(list)
    for r in odd_rows:
        by_key[r[0]].append(r[1] or "")
    keys = sorted(by_key, key=lambda k: LOW if k is None else k)
    following = dict(zip(keys, keys[1:] + keys[:1]))
    for r in rows:
        texts = [t for t in by_key[r.doc_id] if len(t) == r.n_chars]
        edits = {hashlib.sha256((t[:len(t) - len(t) // 2] + n[:len(t) // 2]).encode()).hexdigest()
                 for t in texts for n in by_key[following[r.doc_id]]}
        assert r.edited_sha256 in edits
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[1] == prints[2] != prints[3] and prints[5] == prints[6]
    assert next(r for r in rows if r.doc_id == 1).near_next == 1
    assert 0.8 < next(r for r in rows if r.doc_id == 2).near_next < 1
    assert edit_fingerprints(empty).count() == 0


def test_edits_are_located(spark):
    a = "\n".join(prose(i, 15) for i in range(40))
    lines = a.split("\n")
    lines[20] = "changed line, here."
    df = spark.createDataFrame([(a, "\n".join(lines))], "a string, b string")
    df = with_fingerprint(with_fingerprint(df, F.col("a"), "fa"), F.col("b"), "fb")
    row = df.select(edited_paragraphs(F.col("fa"), F.col("fb")).alias("e"),
                    edited_paragraphs(F.col("fa"), F.col("fa")).alias("none"),
                    likeness(F.col("fa"), F.col("fb")).alias("near")).first()
    assert len(row.e) == 1 and len(row.e[0].leaves) == 2 and row.none == []
    assert 0.9 < row.near < 1


def test_token_counts(documents, odd, empty):
    tok = Tokenizer.from_file(BYTES)
    for df in (documents, odd):
        rows = [(r.doc_id, r.text or "") for r in df.collect()]
        want = [(k, len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids))
                for k, t in rows]
        assert plain(count_tokens(df, BYTES).collect()) == plain(want)
    assert count_tokens(empty, BYTES).count() == 0


def linked(rows, size=5):
    """Brute force: every pair by their sets."""
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        n = min(size, len(w))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), 2 ** 63), LOW if k is None else k)
    return plain((k, len(sets[i]), None if low[find(i)] == LOW else low[find(i)])
                 for i, (k, _) in enumerate(rows))


def near_group(spark):
    """A chain in which neighbours link and ends don't, one group about a hot text, and texts that
    share a passage alone."""
    words = prose(11, 400).split()
    chain = [" ".join(words[i * 3:i * 3 + 120]) for i in range(30)]
    hot = prose(12, 150).split()
    copies = [" ".join(hot[:i] + [f"new{i}"] + hot[i:]) for i in range(60)]
    passage = prose(13, 60)
    shared = [passage + " " + prose(100 + i, 120) for i in range(40)]
    small = ["a b c d e f g h", "a b c d e f g h i", "b c d e f g h i", "x", "X"]
    rows = list(enumerate(chain + copies + shared + small))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_near_duplicates(spark, documents, odd, empty):
    for df in (documents, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert plain(parity_join.near_duplicates(df).collect()) == linked(rows)
    rows, df = near_group(spark)
    assert plain(parity_join.near_duplicates(df).collect()) == linked(rows)
    assert parity_join.near_duplicates(empty).count() == 0


def test_sketches_bound_the_difference():
    r = np.random.default_rng(5)
    for _ in range(50):
        a = np.unique(r.integers(0, 2 ** 63, 300).astype(np.uint64))
        b = np.unique(np.append(a[:r.integers(200, 300)], r.integers(0, 2 ** 63, 30).astype(
            np.uint64)))
        one, two = parity_join.sketches(np.append(a, b), np.array([0, len(a), len(a) + len(b)]))
        bits = sum(bin(int(x) & (2 ** 64 - 1)).count("1") for x in one ^ two)
        assert bits <= len(np.setxor1d(a, b))


def test_linked_sets_share_a_signature():
    r = np.random.default_rng(6)
    for n in (4, 6, 9, 13, 15, 16, 19, 25, 31, 40, 63, 64, 130, 257, 900):
        for _ in range(40):
            a = np.unique(r.integers(0, 2 ** 63, n).astype(np.uint64))
            cut = int(r.integers(0, n // 5 + 1))
            new = r.integers(0, 2 ** 63, int(r.integers(0, n // 4 + 1))).astype(np.uint64)
            b = np.unique(np.append(a[cut:], new))
            both = len(np.intersect1d(a, b))
            common = parity_join.Common(np.sort(a[:n // 3]))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert set(parity_join.signatures(a, common, 80)) & set(
                    parity_join.signatures(b, common, 80))


@pytest.mark.parametrize("fold", [False, True])
def test_word_codes(odd_rows, fold, monkeypatch):
    texts = [(r[1] or "").encode() for r in odd_rows] + [b"x" * 20_000, b" a", b"b ", b"", b"aB ab"]
    want = [(t.lower() if fold else t).split() for t in texts]
    for size in (50, 10 ** 6):  # long texts are cut at white space
        monkeypatch.setattr(word_codes, "SLICE", size)
        got = [codes[a:b].tolist() for _, codes, bounds in word_codes.code_slices(
            pa.array(texts).slice(0), fold) for a, b in zip(bounds, bounds[1:])]
        assert [len(g) for g in got] == [len(w) for w in want]
        pairs = {(w, c) for g, ws in zip(got, want) for w, c in zip(ws, g)}
        assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7)] + [
        (200, 200 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100,
                   **dict.fromkeys(range(200, 250), 200)}


def stripped(rows, window=35):
    words = [(k, (t or "").encode().split()) for k, t in rows]
    seen = Counter(tuple(w[i:i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = []
    for k, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((k, len(w), sum(gone), b" ".join(
            x for x, g in zip(w, gone) if not g).decode()))
    return plain(out)


@pytest.mark.parametrize("group", [250_000, 20])
def test_repeats(documents, odd, empty, group):
    for df in (documents, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert plain(suffix_dedup.remove_repeats(df, group=group).collect()) == stripped(rows)
    assert suffix_dedup.remove_repeats(empty, group=group).count() == 0


def test_suffix_nodes():
    r = np.random.default_rng(7)
    for depth in (2, 3, 5, 9, 35):
        words = np.tile(r.integers(0, 3, 400), 2)
        starts = np.arange(len(words) - depth + 1)
        seen = Counter(tuple(words[i:i + depth]) for i in starts)
        want = [seen[tuple(words[i:i + depth])] > 1 for i in starts]
        assert suffix_dedup.repeated_suffixes(words, starts, depth).tolist() == want
