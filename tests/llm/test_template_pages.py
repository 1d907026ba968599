"""Near duplicates among pages of one template: no pairs of all members, and no link lost."""

import random

import pytest

from marketgauge.llm import parity_join


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    """The least id that links lead to, for each id."""
    sets = {i: shingles(t) for i, t in rows}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return {i: root(i) for i in ids}


def pages(count, own, seed, shared=100):
    """Pages of `shared` words of a template and up to `own` words of their own."""
    draw = random.Random(seed)
    template = [f"t{k}" for k in range(shared)]
    return [(i, " ".join(template + [f"w{draw.randrange(10 ** 6)}" for _ in range(own(draw))]))
            for i in range(count)]


@pytest.mark.parametrize("own", [lambda d: 40, lambda d: 18, lambda d: d.randrange(60),
                                 lambda d: d.choice([8, 12, 14, 25])])
def test_pages_of_a_template(spark, own):
    rows = pages(150, own, seed=3)
    draw = random.Random(5)
    for i in range(150, 200):  # near copies of some of them
        words = rows[draw.randrange(150)][1].split()
        words[draw.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in parity_join.near_duplicates(docs).collect()}
    assert got == brute_force(rows)


def test_signatures_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "MEMBERS", 7)
    rows = pages(120, lambda d: d.randrange(40), seed=11)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in parity_join.near_duplicates(docs).collect()}
    assert got == brute_force(rows)


def test_own_words_make_no_candidates(spark):
    rows = pages(400, lambda d: 40, seed=7)
    texts = spark.createDataFrame([(i, t.encode()) for i, t in rows], "node long, text binary")
    assert parity_join.rarest(texts, 5, 80).isEmpty()
    # Between the two bounds the template's elements are blocks, but no two sets may link.
    rows = pages(400, lambda d: 20, seed=7)
    texts = spark.createDataFrame([(i, t.encode()) for i, t in rows], "node long, text binary")
    found = parity_join.rarest(texts, 5, 80)
    assert not found.isEmpty() and found.filter("NOT own").isEmpty()
