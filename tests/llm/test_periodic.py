"""Periodic runs against brute force: small alphabets, Fibonacci and Thue-Morse words, powers, and awkward tables."""

import random

import numpy as np
import pytest

from newsgrain.llm.periodic import find_runs, periodic_runs


def brute(w, power, least):
    n, out, seen = len(w), [], set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= 2 * q and (i, length) not in seen:  # the smallest period comes first
                seen.add((i, length))
                if length >= max(least, power * q):
                    out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = [1], [0]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def words(rnd):
    kind, n = rnd.randrange(6), rnd.randrange(70)
    if kind < 2:
        return [rnd.randrange(2 + kind) for _ in range(n)]
    if kind == 2:
        return fibonacci(n)
    if kind == 3:
        return [i.bit_count() & 1 for i in range(n)]
    if kind == 4:
        period = [rnd.randrange(2) for _ in range(rnd.randrange(1, 9))]
        return (period * 20)[:n] + [rnd.randrange(3) for _ in range(5)] + period * 3
    return [7] * n


@pytest.mark.parametrize(("power", "least"), [(2, 2), (3, 1), (4, 6)])
def test_all_runs(power, least):
    rnd = random.Random(power)
    for _ in range(250):
        docs = [words(rnd) for _ in range(rnd.randrange(6))]
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        found = find_runs(np.array([x for d in docs for x in d], np.uint64), bounds, power, least)
        want = [(s + bounds[i], length, q) for i, d in enumerate(docs) for s, length, q in brute(d, power, least)]
        assert list(zip(*(x.tolist() for x in found), strict=True)) == want


def test_long_words():
    period = list(range(30_000))
    (start,), (length,), (q,) = find_runs(np.array([9] + period * 5, np.uint64), np.array([0, 150_001]))
    assert (start, length, q) == (1, 150_000, 30_000)
    assert [x.tolist() for x in find_runs(np.zeros(300_000, np.uint64), np.array([0, 300_000]))] == [[0], [300_000], [1]]
    assert not len(find_runs(np.array([i.bit_count() & 1 for i in range(1 << 16)], np.uint64), np.array([0, 1 << 16]))[0])


def collapsed(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_texts(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["é", "bb", "c"]) for _ in range(rnd.randrange(90))) for _ in range(60)]
    texts += [None, "", " \t\n", "one", "a " * 7, "  x y\nx\ty x y x  y z ", "           ", "no runs here", "w " * 100_000]
    rows = [*enumerate(texts), (None, "q q q q q q"), (4, texts[4]), (4, "other row of an id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS runs", "2 AS n_words", "3 AS id", "4 AS start").repartition(3)
    found = periodic_runs(docs).collect()
    assert len(found) == len(rows)
    got = sorted(((r.doc_id is None, r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in found)
    want = []
    for i, t in rows:
        w = (t or "").replace("\n", " ").replace("\t", " ").split(" ")
        w = [x for x in w if x]
        runs = brute(w, 4, 6) if len(w) < 1000 else [(0, len(w), 1)]
        want.append(((i is None, i), len(w), runs, collapsed(w, runs)))
    assert got == sorted(want)
    assert periodic_runs(docs.limit(0)).collect() == []


def test_query_repeats_the_named_words(spark, tmp_path):
    import hashlib
    import zlib

    from newsgrain.llm import queries

    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(120)))) for i in range(300)] + [(300, None), (None, "a a a a a a")]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and got[None].length == 6
    for i, t in rows[:-1]:
        w = (t or "").split()
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs = brute(w, 4, 6)
        r = got[i]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2])) if runs else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
