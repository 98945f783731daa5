"""Cells around pivots: the pairs of brute force, and fewer comparisons as tables grow."""

import random

import pytest

from newsgrain.operators import structure


def sketches(rnd, n, templates, noise, m=40, kinds=50):
    base = [[rnd.randrange(kinds) for _ in range(m)] for _ in range(templates)]
    out = []
    for i in range(n):
        s = list(rnd.choice(base))
        for k in range(m):
            if rnd.random() < noise:
                s[k] = rnd.randrange(kinds)
        out.append((f"d{i % 2}", f"{i:05d}", s))
    return out


@pytest.mark.parametrize(("templates", "noise", "eps", "kinds"), [(8, 0.08, 0.2, 50), (1, 0.3, 0.3, 50), (40, 0.2, 0.35, 2), (3, 0.0, 0.0, 50)])
def test_cells_give_all_pairs(spark, monkeypatch, templates, noise, eps, kinds):
    monkeypatch.setattr(structure, "BLOCK", 16)
    rows = sketches(random.Random(templates), 160, templates, noise, kinds=kinds)
    df = spark.createDataFrame(rows, "dom string, node string, s array<int>").repartition(3)
    want = {(d, a, b) for d, a, s in rows for e, b, t in rows if d == e and a < b and sum(x != y for x, y in zip(s, t, strict=True)) <= eps * 40 + 1e-9}
    found = [(r.dom, r.a, r.b) for r in structure.Cells(structure._dealt(df, "dom"), "dom", eps).pairs().collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert {(r.dom, r.a, r.b) for r in structure.close_pairs(df, "dom", "node", "s", eps).collect()} == want


def test_the_share_falls(spark):
    """Each tenfold table has twice as many templates; the share of pairs compared goes down."""
    shares = []
    for n, templates in ((100, 3), (1000, 8), (4000, 20)):
        df = spark.createDataFrame(sketches(random.Random(n), n, templates, 0.06), "dom string, node string, s array<int>")
        shares.append(structure.compared_share(df, "dom", "node", "s", 0.15))
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.1
