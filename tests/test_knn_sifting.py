"""Nearest rows found by a product of matrices are those of exact distances."""

import numpy as np
import pandas as pd
import pytest

from marketgauge.operators import knn


def plain(asked, known, ids, k):
    """(query, id, distance) of all pairs, sorted."""
    d = np.sqrt(((asked[:, None, :] - known[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(asked)):
        out += [(i, int(ids[j]), d[i, j]) for j in np.lexsort((ids, d[i]))[:k]]
    return out


@pytest.mark.parametrize("kind", ["spread", "copies", "far", "few", "huge"])
def test_sifted_rows_are_the_nearest(kind):
    draw = np.random.default_rng(3)
    known, asked = draw.normal(size=(400, 16)), draw.normal(size=(70, 16))
    if kind == "copies":  # More equal distances than spare rows.
        known[50:300] = known[0]
        asked[:5] = known[0]
    if kind == "far":  # Rounding of the product is larger than the distances.
        known, asked = 1e7 + known * 1e-3, 1e7 + asked * 1e-3
    if kind == "few":
        known = known[:6]
    if kind == "huge":  # Squares of the norms overflow.
        known, asked = known + 2e154, asked + 2e154
    ids = draw.permutation(len(known)) * 3
    out = knn._nearest(7)(
        pd.DataFrame({"id": range(len(asked)), "vec": list(asked)}),
        pd.DataFrame({"id": ids, "label": ["a"] * len(ids), "vec": list(known)}))
    want = plain(asked, known, ids, 7)
    assert list(zip(out["id"], out["train_id"])) == [w[:2] for w in want]
    assert np.allclose(out["dist"], [w[2] for w in want], rtol=1e-12, atol=0)


def test_most_rows_need_no_second_look():
    draw = np.random.default_rng(3)
    _, _, sure = knn._sifted(draw.normal(size=(90, 64)), draw.normal(size=(3000, 64)), 31)
    assert sure.all()


def test_queries_that_reach_all_groups_are_sent_in_slices(spark, monkeypatch):
    monkeypatch.setattr(knn, "SENT_ROWS", 10)
    sizes = []
    class Frame:
        def mapInPandas(self, fn, schema):
            rows = pd.DataFrame({"id": range(100), "vec": [[float(i % 3)] for i in range(100)]})
            sizes.extend(len(p) for p in fn(iter([rows])))
    knn._reach(Frame(), np.zeros((4, 1)), np.full(4, 9.0), np.full(4, 50), 3)
    assert sum(sizes) == 400 and max(sizes) == 10
