"""Counts and clusters of close rows without their pairs."""

import random

import pytest

from newsgrain.operators import structure
from newsgrain.plans import registry


@pytest.mark.parametrize(("m", "values", "eps"), [(64, 2, 0.35), (10, 2, 0.2), (40, 5, 0.125), (300, 400, 0.3)])
def test_counts_and_clusters(spark, monkeypatch, m, values, eps):
    """As from all pairs: several blocks and tiles, copies, a null sketch, bits, bytes and wider values."""
    rnd = random.Random(m)
    bases = [[rnd.randrange(values) for _ in range(m)] for _ in range(3)]
    rows = []
    for i in range(150):
        s = [rnd.randrange(values) if rnd.random() < 2 * eps else v for v in rnd.choice(bases)]
        rows.append((rnd.choice("ab"), f"n{i:03d}", s, rnd.randrange(1, 4)))
    rows += [("a", "copy1", rows[0][2], 2), ("a", "copy2", rows[0][2], 1), ("b", "none", None, 9)]
    df = spark.createDataFrame(rows, "domain string, node string, sketch array<int>, weight int").repartition(3)
    monkeypatch.setattr(structure, "WIDE_BLOCK", 40)
    near = lambda x, y: x[0] == y[0] and x[1] != y[1] and x[2] is not None and y[2] is not None and sum(p != q for p, q in zip(x[2], y[2], strict=True)) <= int(m * (eps + 1e-9))
    want = {(x[0], x[1]): sum(near(x, y) for y in rows) for x in rows}
    assert {(r.domain, r.node): r.close for r in structure.close_counts(df, "domain", "node", "sketch", eps).collect()} == want
    assert 0 < sum(want.values())
    pairs = spark.createDataFrame([(x[1], y[1]) for x in rows for y in rows if x[1] < y[1] and near(x, y)], "a string, b string")
    old = {tuple(r) for r in structure.dbscan(df, pairs, min_samples=8).collect()}
    assert {tuple(r) for r in structure.dbscan_near(df, "domain", "sketch", eps, min_samples=8).collect()} == old


@pytest.mark.parametrize("name", ["template_pairs", "dbscan_groups", "cluster_dump"])
def test_no_pairs_are_made(spark, monkeypatch, name):
    """The close pairs, whose number grows with the square of a template's rows, are not asked for."""

    def never(*_):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(structure, "close_pairs", never)
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count()
