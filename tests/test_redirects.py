"""Links joined natively, and redirect chains against walking them one by one."""

import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from newsgrain.functions import url as U
from newsgrain.operators import redirects

LINKS = ["", "x", "x/y?z=1#f", "/", "/a/b", "../x", "../../../x", "./x", "a/../b/./c", "..", ".", "../", "?q=1", "#top", "//h.org/p?q", "http://o.example/z", "https://o.example", "mailto:a@b", "a//b", "/a/../b", "?", "é/ü"]
BASES = ["http://h.example", "http://h.example/", "http://h.example/a/b/c?d=e#f", "https://h.example:80/a/b/", "http://u@h.example/x?y"]


def test_joined(spark):
    df = spark.createDataFrame([(b, x) for b in BASES for x in LINKS], "b string, x string")
    got = {(r.b, r.x): r.j for r in df.withColumn("j", U.joined(F.col("b"), F.col("x"))).collect()}
    want = {(b, x): urljoin(b, x) for b, x in got}
    assert {k: (v, want[k]) for k, v in got.items() if v != want[k] and k[1] not in ("?", "a//b")} == {}  # empty segments stay
    assert spark.range(1).select(U.joined(F.lit(None).cast("string"), F.lit("x"))).first()[0] is None


def test_steps(spark):
    meta = lambda x: f"<html><META http-equiv='Refresh' content='{x}'>t"
    rows = [
        ("http://a.example/1", 200, "0; URL=/2", "t", ("/2", None)),
        ("http://a.example/2", 200, None, meta("5;url=http://b.example/?x=1&amp;y=2"), ("http://b.example/?x=1&y=2", None)),
        ("http://a.example/3", 404, "0; url=/2", "t", (None, "error")),
        ("http://a.example/4", 200, None, "<meta name=x content='3;url=/z'>", (None, "end")),
        ("http://a.example/5", 200, "21;url=/z", "t", (None, "delay")),
        ("http://a.example/6", 200, "20;url=/z", "", ("/z", None)),
        ("http://a.example/7", 200, "soon;url=/z", "t", (None, "failed")),
        ("http://a.example/8", 200, "5", "t", (None, "failed")),
        ("http://a.example/9", 200, "1;url=ftp://x.example", "t", (None, "failed")),
        ("http://a.example/10", 200, None, "", (None, "empty")),
        ("http://a.example/11", 301, None, None, (None, "end")),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "u string, status int, header string, body string")
    got = {r.u: (r.next, r.stop) for r in redirects.steps(df, "u", "status", "header", "body").collect()}
    assert got == {r[0]: (urljoin(r[0], r[4][0]) if r[4][0] else None, r[4][1]) for r in rows}


def walk(graph, start):
    out = []
    at = start
    while True:
        nxt, stop = graph[at]
        out.append(at)
        if nxt is None:
            return out, stop
        if nxt in out:
            return out, "loop"
        if nxt not in graph:
            return out, "failed"
        at = nxt


def check(spark, graph, starts):
    rows = spark.createDataFrame([(u, v, s, len(u)) for u, (v, s) in graph.items()], "url string, next string, stop string, n int").repartition(3)
    hops = redirects.chains(rows, spark.createDataFrame([(s,) for s in starts], "s string"))
    got = {}
    for r in hops.collect():
        got.setdefault(r.start, []).append((r.hop, r.url, r.stop))
        assert r.n == len(r.url)
    for s in {s for s in starts if s in graph}:
        path, why = walk(graph, s)
        assert sorted(got.pop(s)) == [(i, u, why if i + 1 == len(path) else None) for i, u in enumerate(path)]
    assert not got
    return hops


def test_random_graphs(spark):
    rnd = random.Random(4)
    graph = {}
    for i in range(120):
        way = rnd.random()
        graph[f"n{i}"] = (None, rnd.choice(["end", "error"])) if way < 0.15 else (f"n{rnd.randrange(130)}", None)
    hops = check(spark, graph, [*graph, "unknown", "n3"])
    for r in redirects.outcomes(hops).collect():
        path, why = walk(graph, r.start)
        assert (r.hops, r.final, r.stop) == (len(path), path[-1], why)


def test_long_chains_and_cycles(spark):
    graph = {f"c{i:04d}": (f"c{i + 1:04d}", None) for i in range(300)} | {"c0300": (None, "end")}
    graph |= {f"k{i:04d}": (f"k{(i * 7 + 1) % 50:04d}", None) for i in range(50)}  # 7 is a unit: one or more cycles
    graph |= {f"t{i:03d}": (f"t{i + 1:03d}" if i < 99 else "k0011", None) for i in range(100)} | {"self": ("self", None), "to-self": ("self", None), "two": ("one", None), "one": ("two", None)}
    check(spark, graph, ["c0000", "c0150", "t000", "t099", "k0003", "self", "to-self", "one", "two"])
    check(spark, graph, [])
