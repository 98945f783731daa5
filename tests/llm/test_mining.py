"""Hard negatives against brute force, on lengths that prune and on awkward rows."""

import math
import random

import numpy as np

from newsgrain.llm import mining

COLS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, is_anchor, scale=256, positives=5, negatives=5, low=80, high=100):
    good = []
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(scale * float(np.float32(x))) for x in v]
        if sum(x * x for x in q) < 2**61.99:
            good.append((i, q, label))
    out = []
    for i, q, label in good:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, w, strict=True)), j, m == label) for j, w, m in good if j != i and len(w) == len(q))
        for p, j, _ in [r for r in scored if r[2]][:positives]:
            fits = [(n, c) for n, c, same in scored if not same and low * -p <= 100 * -n <= high * -p]
            out += [(i, j, rank + 1, c, -p, -n) for rank, (n, c) in enumerate(fits[:negatives])]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, COLS).selectExpr("*", "1 AS id", "2 AS v", "'x' AS dim", "0 AS score").repartition(3)
    return sorted(tuple(r) for r in mining.hard_negatives(df, "vec_id % 5 = 0", **how).collect())


def random_rows(rnd, n, d):
    """Directions around a few centres, lengths over three orders of magnitude."""
    centres = [[rnd.gauss(0, 1) for _ in range(d)] for _ in range(4)]
    return [(i, [(0.5 + rnd.random()) * 10 ** rnd.uniform(-2, 1) * (c + rnd.gauss(0, 0.3)) for c in rnd.choice(centres)], rnd.randrange(3)) for i in range(n)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mining, "SHELF_BYTES", 700)
    monkeypatch.setattr(mining, "BLOCK_BYTES", 300)
    monkeypatch.setattr(mining, "WAVE", 3)
    rnd = random.Random(1)
    rows = random_rows(rnd, 240, 6)
    want = brute(rows, lambda i: i % 5 == 0)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows, positives=2, negatives=3, low=50, high=95) == brute(rows, lambda i: i % 5 == 0, positives=2, negatives=3, low=50, high=95)


def test_awkward_rows(spark):
    rnd = random.Random(2)
    rows = random_rows(rnd, 60, 4)
    same = rows[10][1]
    rows += [(100 + i, same, i % 3) for i in range(40)]  # ties
    rows += [(200, None, 1), (205, [], 1), (None, same, 1), (210, same, None), (215, [1.0, None, 2.0, 3.0], 1), (220, [1.0, math.nan, 2.0, 3.0], 1), (225, [1.0, math.inf, 2.0, 3.0], 1)]
    rows += [(230, [3e7, 3e7, 1.0, 1.0], 0), (231, [3e30, 1.0, 1.0, 1.0], 0), (235, [0.0, 0.0, 0.0, 0.0], 2)]
    rows += [(300 + i, [rnd.gauss(0, 1), 2.0], i % 2) for i in range(20)] + [(400, [1.0, 1.0, 1.0], 1)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)
    twice = rows + [rows[10], rows[10]]  # an anchor that is met three times
    assert sorted(set(mined(spark, twice))) == sorted(set(brute(twice, lambda i: i % 5 == 0)))
    assert mined(spark, []) == []
    assert mined(spark, [r for r in rows if r[0] is None or r[0] % 5]) == []  # no anchors


def test_large_scores_stay_exact(spark):
    rnd = random.Random(3)
    rows = [(i, [float(rnd.randrange(1 << 22)) for _ in range(5)], i % 2) for i in range(50)]
    want = brute(rows, lambda i: i % 5 == 0)
    assert max(r[4] for r in want) > 2**53 and mined(spark, rows) == want


def test_buckets_are_pruned():
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(20 * mining.BUCKET, 8)) * np.sort(10 ** rnd.uniform(0, 3, 20 * mining.BUCKET))[::-1, None]
    x = x[np.argsort(-(x * x).sum(axis=1))]
    ids, labels = np.arange(len(x)), rnd.integers(0, 3, len(x))
    pack = lambda a, b: mining._Pack(8, float(np.sqrt((np.floor(x[a]) ** 2).sum())), ids[a:b], labels[a:b], np.floor(x[a:b]).astype(np.int32))
    wave, best = [pack(0, 50)], mining._Best(np.full(50, mining._NONE), 5)
    taken = mining._search(pack(0, len(x)), wave, best, np.full(50, -mining._NONE), 1, True)
    assert taken < 0.3 * 50 * len(x)
    score = np.floor(x[:50]) @ np.floor(x).T
    score[(labels[:50, None] != labels) | (ids[:50, None] == ids)] = -np.inf
    assert (best.score == -np.sort(-score, axis=1)[:, :5]).all()
