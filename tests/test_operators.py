"""Operators with literal cases: as-of edges, rules, clusters, feeds, streams, exports."""

import datetime as dt
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from newsgrain.operators import export, extract, ingest, rules, sampling, stats, structure, survey, urls
from newsgrain.sources import adapters, feeds

T0 = dt.datetime(2014, 1, 1)


def test_asof_edges(spark):
    rows = [("a", T0 + d, T0, n) for n, d in enumerate([dt.timedelta(minutes=5), dt.timedelta(minutes=5, microseconds=1), dt.timedelta(days=-1), dt.timedelta(minutes=35)])]
    df = spark.createDataFrame([*rows, ("late", T0 + dt.timedelta(days=9), T0, 7)], "k string, ts timestamp, pub timestamp, n int")
    got = {(r["k"], r["offset"]): r["n"] for r in ingest.asof_long(df, "k", "ts", "pub", ["n"]).collect()}
    assert got["a", "initial"] == 0
    assert got["a", "30m"] == 3
    assert not [k for k in got if k[0] == "late"]


def test_priority_null_first(spark):
    df = spark.createDataFrame([(1, 10, None, None), (2, 99, 1, dt.date(2014, 1, 1))], "id int, fb int, tw int, created date")
    got = df.orderBy(ingest.priority(F.col("fb"), F.col("tw"), F.col("created"), F.current_timestamp()).desc_nulls_first()).collect()
    assert [r["id"] for r in got] == [1, 2]


def test_eligibility(spark):
    df = spark.createDataFrame([(s,) for s in (None, 200, 302, -10, 404)], "s int")
    assert [r["s"] for r in df.filter(ingest.needs_download(F.col("s"))).collect()] == [None, 302]


def test_status(spark):
    df = spark.createDataFrame([(200,), (-10,), (-77,), (None,)], "s int")
    assert [r[0] for r in df.select(ingest.status_text(F.col("s"))).collect()] == ["HTTP 200", "timeout", "HTTP -77", None]


def test_rule_changes(spark):
    t = spark.createDataFrame([("d", "d", 1, None, "x"), ("d/a/", "d", 2, "<domain>q", None)], "signature string, base_domain string, modified_when int, headline_selector string, byline_selector string")
    change = spark.createDataFrame([("d", "<domain>h1"), ("d/a/", None)], "signature string, selector string")
    got = {r["signature"]: r for r in rules.set_selector(t, change, "headline", F.lit(9)).collect()}
    assert got["d"]["headline_selector"] is None and got["d"]["modified_when"] == 1
    assert got["d/a/"]["headline_selector"] is None and got["d/a/"]["modified_when"] == 9
    seen = spark.createDataFrame([("e/a/", "e")], "signature string, base_domain string")
    made = {r["signature"]: r for r in rules.get_or_create(t, seen, F.lit(5), ("headline", "byline")).collect()}
    assert made["e"]["headline_selector"] == "<default>" + rules.GLOBAL_RULES["headline"]
    assert made["e/a/"]["byline_selector"] == "<domain><default>" + rules.GLOBAL_RULES["byline"]
    assert made["d/a/"]["byline_selector"] == "<domain>x"


def test_dbscan(spark):
    nodes = spark.createDataFrame([("a1", 10), ("a2", 10), ("a3", 1), ("b1", 25), ("n", 3)], "node string, weight int")
    pairs = spark.createDataFrame([("a1", "a2", 0.1), ("a2", "a3", 0.3), ("a3", "b1", 0.3)], "a string, b string, distance double")
    got = {r["node"]: (r["cluster"], r["core"]) for r in structure.dbscan(nodes, pairs).collect()}
    assert got == {"a1": ("a1", True), "a2": ("a1", True), "a3": ("a3", True), "b1": ("a3", True), "n": (None, False)} or got["n"] == (None, False)
    assert got["b1"][1] and not got["n"][1]


def test_close_pairs_exact(spark):
    rows = [("d", f"{i:03d}", [(i * j * 7919 >> 3) & 1 for j in range(1, 33)]) for i in range(60)]
    df = spark.createDataFrame(rows, "d string, node string, s array<int>")
    got = {(r["a"], r["b"]) for r in structure.close_pairs(df, "d", "node", "s", 0.3).collect()}
    want = {(a, b) for _, a, x in rows for _, b, y in rows if a < b and sum(p != q for p, q in zip(x, y, strict=True)) / 32 <= 0.3 + 1e-9}
    assert got == want


def test_equivalence_chain(spark):
    pairs = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("x", "y")], "a string, b string")
    got = {r["node"]: r["group"] for r in urls.equivalence(pairs).collect()}
    assert {got[f"n{i:02d}"] for i in range(21)} == {"n00"} and got["y"] == "x"


def test_equivalence_long_chain_in_unlucky_order(spark):
    """A path on which the least label would advance one link a round."""
    path = ["n000", *(f"n{i:03d}" for i in range(130, 0, -1))]
    pairs = spark.createDataFrame([*zip(path, path[1:], strict=False), ("self", "self"), ("x", None)], "a string, b string")
    got = {r["node"]: r["group"] for r in urls.equivalence(pairs).collect()}
    assert got == {**dict.fromkeys(path, "n000"), "self": "self"}


def test_sampling_properties(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    got = sampling.stratified(df.repartition(7), "id", "g", 90)
    again = sampling.stratified(df.repartition(2), "id", "g", 90)
    assert got.count() == 90 and {r["id"] for r in got.collect()} == {r["id"] for r in again.collect()}
    assert {r["n"] for r in sampling.at_most(df, "g", "id", 5).groupBy("g").agg(F.count("*").alias("n")).collect()} == {5}


def test_funnel_and_coverage(spark):
    df = spark.createDataFrame([("k", i) for i in (998, 1, 1)], "k string, n int").withColumn("k", F.monotonically_increasing_id().cast("string"))
    assert stats.coverage(df, "k", "n", 99.85).count() == 3


def test_feeds(spark, tmp_path):
    (tmp_path / "a.txt").write_text("article_Id|site_Id|article_Url|article_Date\n1|2|http://x|2014-01-01T00:00:00Z\n")
    assert feeds.article_report(spark, str(tmp_path / "a.txt")).first()["article_Url"] == "http://x"
    (tmp_path / "bad.txt").write_text("x|y\n")
    with pytest.raises(ValueError, match="article_Id"):
        feeds.article_report(spark, str(tmp_path / "bad.txt"))
    (tmp_path / "s.txt").write_text("article_Id|statistic_Date|statistic_FbTotal|statistic_Tweets\n1|2014-01-01T00:00:00|5|x\n")
    row = feeds.statistics(spark, str(tmp_path / "s.txt")).first()
    assert (row["statistic_FbTotal"], row["statistic_Tweets"]) == (5, None)
    (tmp_path / "site.txt").write_text("site_Id|site_Name|site_Url|site_RssUrl|site_lastFetch|site_healthStart|site_isHealthy|site_active\n1|n|u|u|||t|\n")
    row = feeds.sites(spark, str(tmp_path / "site.txt")).first()
    assert (row["rss_url"], row["is_healthy"], row["active"], row["last_fetch"]) == (None, True, False, None)
    (tmp_path / "l.txt").write_text("id|when|url\r\n1|2014-01-01|http://a/b#c\r\n2|2014-01-01|ftp://x\n")
    assert [r["url"] for r in feeds.article_list(spark, str(tmp_path / "l.txt")).collect()] == ["http://a/b"]
    (tmp_path / "g.json").write_text('{"u1": {"share": {"share_count": 3}}, "u2": null}\nnot json\n{"u1": {"share": {"share_count": 4}}}\n')
    assert [(r["_id"], r["share"]["share_count"]) for r in feeds.graph_responses(spark, str(tmp_path / "g.json")).collect()] == [("u1", 4)]
    (tmp_path / "p.stat").write_text("302\thttp://a\ttext/html\nbad line\n200\thttp://b/\ttext/html\n")
    hops = feeds.hop_logs(spark, str(tmp_path / "p.stat"))
    assert [r["code"] for r in hops.orderBy("line").collect()] == ["302", "200"]
    pages = spark.createDataFrame([("p",), ("q",)], "name string")
    assert feeds.usable(pages, hops).count() == 2
    (tmp_path / "ids.txt").write_text("5\n# c\n6\n5\n7\n")
    assert [r["value"] for r in feeds.id_lines(spark, str(tmp_path / "ids.txt"), "6").collect()] == ["6", "7"]
    (tmp_path / "grp.txt").write_text("a\nb\n\nc\n")
    assert [(r["group"], r["value"]) for r in feeds.grouped_lines(spark, str(tmp_path / "grp.txt")).orderBy("group", "pos").collect()] == [(0, "a"), (0, "b"), (1, "c")]
    (tmp_path / "v.txt").write_text("0000001 001  NN1     word                     Z5\n")
    assert tuple(feeds.tagger_vertical(spark, str(tmp_path / "v.txt")).first())[2:] == ("0000001", "001", "NN1", "word", "Z5")
    with pytest.raises(ValueError, match="refused"):
        feeds.feed_guard(50, 1)


def test_adapters():
    class Flaky:
        batch = 2
        calls = 0

        def fetch(self, keys):
            Flaky.calls += 1
            if "bad" in keys:
                raise OSError
            return {k: {"n": 1} for k in keys}

    got = dict(adapters.fetch_all(Flaky(), ["a", "bad", "c"], retries=1))
    assert set(got) == {"a", "c"}

    class Loop:
        def get(self, url, user_agent=None):
            return [adapters.Hop(200, url, "text/html", refresh="u1")]

    assert len(adapters.follow(Loop(), "u0", lambda h: (0, h.refresh))) == 2
    assert adapters.TopicQuery().term("loc", "X").term("org", "Y").any().terms == ['(loc:("X") OR org:("Y"))']


def test_extract_pages(spark):
    pages = spark.createDataFrame([(1, "s", "<h1>A</h1>", None, "t"), (2, "s", "<p>x</p>", None, None), (3, "s", "<h1>B</h1>", 9, "t")], "id int, signature string, html string, scrape_when int, title string")
    r = spark.createDataFrame([("s", 5, "((text))h1", None, None, None)], "signature string, modified_when int, headline_selector string, dateline_selector string, byline_selector string, body_text_selector string")
    got = {x["id"]: x for x in extract.extract_pages(pages, r).collect()}
    assert set(got) == {1, 2}
    assert got[1]["headline"] == "A" and got[1]["fetch_status"] == 200 and got[2]["fetch_status"] == -3


def test_site_patterns(spark):
    pages = spark.createDataFrame([(1, "a.com", "<h2>x</h2>"), (2, "b.com", "<h1>y</h1>")], "page_id int, domain string, html string")
    pats = spark.createDataFrame([("a.com", "title", ["((text))h2"])], "domain string, field string, selectors array<string>")
    got = {r["page_id"]: (r["value"], r["which"]) for r in extract.site_patterns(pages, pats, {"title": "((text))h1"}).collect()}
    assert got == {1: ("x", 0), 2: ("y", 1)}


def test_zip_and_folders(spark):
    import io
    import zipfile

    df = spark.createDataFrame([("g", "n", 1, 200, "http://u", "<p>", "H", "B\nC"), ("g", "n", 2, 404, "http://v", None, None, None)], "grp string, name string, id int, fetch_status int, url string, html string, headline string, body_text string")
    files = export.folders(export.index(df, "grp", "name", "id"), "grp")
    got = {r["path"]: r["content"] for r in files.collect()}
    assert len(got) == 12 and got["g/lead/n.txt"] == "B\r\n" and got["g/body/n_(2).txt"] == "<JUNK: status 404>"
    row = export.zipped(files, F.lit("all")).first()
    assert len(zipfile.ZipFile(io.BytesIO(row["payload"])).namelist()) == 12


def test_linguistics(spark):
    df = spark.createDataFrame([(1, 'one two <EVENT class="OCC" tense="PAST">went</EVENT> home now')], "id int, text string")
    got = {r["attribute"]: r["example"] for r in survey.timeml_events(df, "text", "id").collect()}
    assert set(got) == {'class="OCC"', 'tense="PAST"'} and "one two went home now" in got['class="OCC"']
    rows = spark.createDataFrame([("d", 1, "-", "-", "-"), ("d", 2, "a&b", "NN", "Z"), ("d", 3, "-", "-", "-"), ("d", 4, "c", "NN", "Z")], "doc string, line int, norm string, pos string, sem string")
    xml = [r["xml"] for r in survey.tagged_xml(rows, "doc", "line").orderBy("line").collect()]
    assert xml == ['<w id="1.1" pos="NN" sem="Z">a&amp;b</w>', '<w id="2.1" pos="NN" sem="Z">c</w>']


def test_survey_rows(spark):
    hops = spark.createDataFrame([(1, 0, "301", "http://a.com/x", "m"), (1, 1, "200", "http://a.com/", "m")], "id int, line int, code string, url string, mime string")
    pages = spark.createDataFrame([(1, 10)], "id int, length int")
    dates = spark.createDataFrame([(1, "2014-01-01")], "id int, date string")
    row = survey.survey_rows(hops, pages, dates).first()
    assert (row["status"], row["start_url"], row["end_url"]) == ("200?", "http://a.com/x", "http://a.com/")


def test_stream_dead_letters(spark, tmp_path):
    from newsgrain.streaming import ingest_stream as S

    df = spark.createDataFrame([(1, "u", T0), (2, None, T0), (1, "v", T0 - dt.timedelta(days=1))], "id long, url string, spider_when timestamp")
    S.enqueue(df, str(tmp_path / "q"))
    for _ in range(2):  # a second run finds nothing new
        S.ingest(S.messages(spark, str(tmp_path / "q"), df.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")), str(tmp_path / "s"), str(tmp_path / "d"), str(tmp_path / "c")).awaitTermination()
    assert [(r["id"], r["url"]) for r in S.stored(spark, str(tmp_path / "s")).collect()] == [(1, "v")]
    assert spark.read.json(str(tmp_path / "d")).count() == 1
    with pytest.raises(ValueError, match="integer"):
        S.enqueue(spark.createDataFrame([("x",)], "id string"), str(tmp_path / "q2"))


def test_stream_purge_and_repeat(spark, tmp_path):
    from newsgrain.streaming import ingest_stream as S

    schema, q, s, d = "id long, url string, spider_when timestamp", *(str(tmp_path / x) for x in "qsd")
    S.enqueue(spark.createDataFrame([(1, None, T0), (2, "u", T0)], schema), q)
    S.ingest(S.messages(spark, q, schema), s, d, str(tmp_path / "c")).awaitTermination()
    S.repeat(spark, d, q, schema, lambda rows: rows.withColumn("url", F.lit("mended")))
    S.ingest(S.messages(spark, q, schema), s, d, str(tmp_path / "c")).awaitTermination()
    assert {(r["id"], r["url"], r["spider_when"]) for r in S.stored(spark, s).collect()} == {(1, "mended", T0), (2, "u", T0)}
    assert S.purge(spark, q) and not S.purge(spark, q)


def test_forced_extraction_and_errors(spark):
    pages = spark.createDataFrame([(1, "s", "<h1>A</h1>", 9, "t")], "id int, signature string, html string, scrape_when int, title string")
    r = spark.createDataFrame([("s", 5, "((text))h1", None, None, None)], "signature string, modified_when int, headline_selector string, dateline_selector string, byline_selector string, body_text_selector string")
    assert extract.extract_pages(pages, r).count() == 0
    assert extract.extract_pages(pages, r, force=True).first()["headline"] == "A"
    found = {x["name"]: x for x in extract.evaluate(pages, "id", {"good": "((text))h1", "bad": "h1:::["}).collect()}
    assert found["good"]["error"] is None and found["good"]["value"] == "A" and found["bad"]["error"] and found["bad"]["value"] is None


def test_stream_keeps_the_earliest_of_all_batches(spark, tmp_path):
    """A later batch brings an earlier row, then a repeat; the store keeps the earliest, also when compacted."""
    from newsgrain.streaming import ingest_stream as S

    schema, q, s = "id long, url string, spider_when timestamp", str(tmp_path / "q"), str(tmp_path / "s")
    for url, days in (("second", 2), ("first", 0), ("third", 5), ("first", 0)):
        S.enqueue(spark.createDataFrame([(7, url, T0 + dt.timedelta(days=days)), (days, url, T0)], schema), q)
        S.ingest(S.messages(spark, q, schema), s, str(tmp_path / "d"), str(tmp_path / "c")).awaitTermination()
    got = {r["id"]: r["url"] for r in S.stored(spark, s).collect()}
    assert got == {7: "first", 2: "second", 0: "first", 5: "third"}
    S.compact(spark, s, str(tmp_path / "t"))
    assert {r["id"]: r["url"] for r in spark.read.parquet(str(tmp_path / "t")).collect()} == got


def test_lines_are_numbered_over_splits(spark, tmp_path):
    """Files of several splits: numbers run on within a file, blank lines count."""
    (tmp_path / "a.txt").write_text("".join(f"a{i}\n" if i % 5 else "\n" for i in range(2000)))
    (tmp_path / "b.txt").write_text("b0\r\nb1")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {(r["file"], r["line"]): r["value"] for r in feeds.lines(spark, str(tmp_path)).collect()}
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == {("a.txt", i): f"a{i}" if i % 5 else "" for i in range(2000)} | {("b.txt", 0): "b0", ("b.txt", 1): "b1"}


def test_volumes_and_manifest(spark, monkeypatch):
    import io
    import zipfile

    monkeypatch.setattr(export, "VOLUME_BYTES", 2000)
    rows = [("a" if i % 3 else "b", f"{i:03d}.json", "".join(hashlib.md5(f"{i}:{k}".encode()).hexdigest() for k in range(10)), i) for i in range(60)]  # deflates little
    files = spark.createDataFrame(rows, "box string, path string, content string, words int")
    got = export.zipped(files, F.col("box"), ["words"]).collect()
    seen = {}
    for r in got:
        with zipfile.ZipFile(io.BytesIO(r["payload"])) as z:
            names = z.namelist()
            lines = z.read("MANIFEST.csv").decode().split()
            assert names[-1] == "MANIFEST.csv" and lines[0] == "filename,words" and [x.split(",")[0] for x in lines[1:]] == names[:-1]
            seen.setdefault(r["archive"], []).extend(names[:-1])
    assert {k: sorted(v) for k, v in seen.items()} == {b: sorted(p for x, p, *_ in rows if x == b) for b in "ab"} and len(got) > 2


def test_quantiles_ranks_and_numbers(spark):
    import random

    from newsgrain.operators import ranges

    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), float(rnd.randrange(40)) if rnd.random() > 0.1 else None, i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, x double, i int")
    got = {r["g"]: tuple(r)[1:] for r in ranges.quantiles(df, ["g"], F.col("x"), [0.0, 0.3, 0.5, 1.0]).collect()}
    want = df.groupBy("g").agg(F.count("x").alias("n"), F.percentile("x", F.array(*[F.lit(p) for p in (0.0, 0.3, 0.5, 1.0)])).alias("q")).collect()
    assert set(got) == {"a", "b", None} and all(abs(x - y) < 1e-9 for r in want for x, y in zip(got[r["g"]], (r["n"], *r["q"]), strict=True))
    every = ranges.quantiles(df, [], F.col("x"), [0.5], discrete=True).first()
    known = sorted(x for _, x, _ in rows if x is not None)
    assert tuple(every) == (len(known), known[(len(known) + 1) // 2 - 1])
    assert [(r["i"], r["k"]) for r in ranges.numbered(df, [F.desc("i")], "k").sort("k").collect()] == [(899 - k, k + 1) for k in range(900)]
    order = sampling.hash_order("i")
    kept = ranges.lowest(df, ["g"], order, "i", F.floor(F.col("_n") / 10))
    full = df.withColumn("h", order).collect()
    for g in ("a", "b", None):
        mine = sorted((r["h"], r["i"]) for r in full if r["g"] == g)
        assert {r["i"] for r in kept.collect() if r["g"] == g} == {i for _, i in mine[: len(mine) // 10]}


def test_close_pairs_both_ways(spark, monkeypatch):
    """Long bands and short ones give the pairs of brute force; short ones are compared by blocks."""
    import random

    rnd = random.Random(4)
    monkeypatch.setattr(structure, "BLOCK", 16)
    for kinds, eps in ((2, 0.35), (10**6, 0.3)):
        base = [[rnd.randrange(kinds) for _ in range(40)] for _ in range(6)]
        rows = []
        for i in range(90):
            s = list(rnd.choice(base))
            for _ in range(rnd.randrange(16)):
                s[rnd.randrange(40)] = rnd.randrange(kinds)
            rows.append((f"d{i % 2}", f"{i:03d}", s))
        want = {(d, a, b) for d, a, s in rows for e, b, t in rows if d == e and a < b and sum(x != y for x, y in zip(s, t, strict=True)) <= eps * 40 + 1e-9}
        df = spark.createDataFrame(rows, "dom string, node string, s array<int>")
        assert {(r["dom"], r["a"], r["b"]) for r in structure.close_pairs(df, "dom", "node", "s", eps).collect()} == want


def test_domain_pairs_with_a_path_of_all(spark):
    rows = [(f"d{i:03d}", "/") for i in range(60)] + [(f"d{i:03d}", f"/p{i // 3}") for i in range(60)] + [("d000", "/q"), ("d001", "/q"), ("d050", "/q")]
    df = spark.createDataFrame(rows, "d string, p string")
    paths = {}
    for d, p in rows:
        paths.setdefault(d, set()).add(p)
    for least in (1, 2, 3):
        want = {(a, b, len(paths[a] & paths[b])) for a in paths for b in paths if a < b and len(paths[a] & paths[b]) >= least}
        assert {tuple(r) for r in urls.domain_pairs(df, "d", "p", least).collect()} == want


def test_pattern_catalogues(spark):
    p = spark.createDataFrame([("b", "x.com", "h1", ".d"), ("a", "x.com", "h2", ""), ("c", "y.com", "h1", None)], "name string, domain string, title string, date string")
    got = {(r["domain"], r["field"]): r["selectors"] for r in rules.by_site(p, ["title", "date"]).collect()}
    assert got == {("x.com", "title"): ["h2", "h1"], ("x.com", "date"): [".d"], ("y.com", "title"): ["h1"]}
    assert {r["field"]: r["selectors"] for r in rules.by_field(p, ["title", "date"]).collect()} == {"title": ["h1", "h2"], "date": [".d"]}


def test_refresh_counts(spark):
    t = spark.createDataFrame([("d", "d", 1, None), ("d/a/", "d", 2, "own")], "signature string, base_domain string, modified_when int, headline_selector string")
    assert rules.refresh_counts(t, rules.refreshed(t, ("headline",)), ("headline",)).first()["headline"] == 1


def mean_silhouette(items):
    """By its definition, over all pairs."""
    out = []
    for i, (c, x) in enumerate(items):
        per = {}
        for j, (k, y) in enumerate(items):
            if i != j:
                per.setdefault(k, []).append(sum(a != b for a, b in zip(x, y, strict=True)) / len(x))
        if c not in per:
            out.append(0.0)
            continue
        inside, other = (sum(v) / len(v) for v in (per[c], min((v for k, v in per.items() if k != c), key=lambda v: sum(v) / len(v))))
        out.append((other - inside) / max(inside, other) if max(inside, other) else 0.0)
    return sum(out) / len(out)


def test_sketch_weights_and_silhouette(spark):
    df = spark.createDataFrame([("d", [1, 2])] * 3 + [("d", [1, 3])] + [("d", None)], "domain string, sketch array<bigint>")
    assert sorted(r["weight"] for r in structure.weighted_sketches(df, "domain", "sketch").collect()) == [1, 3]
    assert structure.weighted_sketches(df, "domain", "sketch", most=1).first()["weight"] == 3
    rnd = random.Random(9)
    rows = [(d, f"{d}{i}", rnd.choice([None, "p", "q", "r"]) if d == "a" else {"b": "one", "c": None}[d], rnd.randrange(1, 4), [rnd.randrange(3) for _ in range(7)]) for d, n in (("a", 40), ("b", 5), ("c", 3)) for i in range(n)]
    rows += [("a", "single", "s", 1, [0] * 7), ("a", "heavy", "t", 3, [9] * 7), ("e", "x", "p", 1, [1, 2]), ("e", "y", "q", 1, [1, 2])]
    nodes = spark.createDataFrame(rows, "domain string, node string, cluster string, weight int, sketch array<int>").repartition(3)
    for weight in (None, "weight"):
        got = {r[0]: r[1] for r in structure.silhouette(nodes, "domain", "node", "cluster", "sketch", weight).collect()}
        assert got["b"] == got["c"] == -math.inf and got["e"] == 0
        copies = [(c, s) for d, _, c, w, s in rows if d == "a" and c for _ in range(w if weight else 1)]
        assert math.isclose(got["a"], mean_silhouette(copies), rel_tol=1e-9)
