"""Quantiles by narrowing ranges against sorted lists: repeated, heavy-tailed, huge and infinite values, and many groups."""

import math
import random

import pytest
from pyspark.sql import functions as F

from newsgrain.operators import ranges

POINTS = [0.0, 0.1, 0.5, 0.75, 0.99, 1.0]


def interpolated(v, p):
    at = p * (len(v) - 1)
    lo, hi = v[math.floor(at)], v[math.ceil(at)]
    return lo if lo == hi else lo * (1 - (at - math.floor(at))) + hi * (at - math.floor(at))


def by_rank(v, p):
    return v[max(math.ceil(p * len(v)) - 1, 0)]


def groups():
    rnd = random.Random(3)
    return {
        "one": [4.5],
        "same": [7.0] * 50,
        "tail": [math.exp(rnd.gauss(0, 9)) for _ in range(3000)],
        "counts": [float(int(rnd.paretovariate(0.7))) for _ in range(3000)],
        "huge": [-1.7e308, 1.7e308, 0.0, 1e-300, -5.0, 5.0],
        "ends": [-math.inf, math.inf, math.inf, 1.0, 2.0, 3.0, 4.0, 1e9],
        "near": [1.0 + i * 2.0**-52 for i in range(40)],
        None: [1.0, 2.0, 2.0, 3.0],
    }


@pytest.mark.parametrize("known", [20_000, 3])
def test_quantiles(spark, monkeypatch, known):
    monkeypatch.setattr(ranges, "KNOWN_RANKS", known)
    data = groups()
    rows = [(g, x) for g, v in data.items() for x in v] + [("nothing", None), ("tail", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    for discrete, rule in ((False, interpolated), (True, by_rank)):
        got = {r.g: tuple(r)[1:] for r in ranges.quantiles(df, ["g"], F.col("x"), POINTS, discrete).collect()}
        assert set(got) == set(data)
        for g, v in data.items():
            assert got[g][0] == len(v)
            for a, p in zip(got[g][1:], POINTS, strict=True):
                b = rule(sorted(v), p)
                assert a == b or math.isclose(a, b, rel_tol=1e-12) or (math.isnan(a) and math.isnan(b)), (g, p, a, b)
    assert ranges.quantiles(df.limit(0), ["g"], F.col("x"), POINTS).collect() == []
    whole = ranges.quantiles(df, [], F.col("x"), [0.5], discrete=True).first()
    every = sorted(x for v in data.values() for x in v)
    assert tuple(whole) == (len(every), by_rank(every, 0.5))
