"""Planned requests with a ledger, runs that break off, and searches paged as a stream."""

import json

import pytest
from pyspark.sql import functions as F

from newsgrain.sources import service as S

MODULE = "newsgrain.sources.service"
DOMAINS = ["a.example", "b.example"]


@pytest.fixture
def entries(spark, tmp_path):
    df = spark.range(130).select(F.format_string("e%03d", "id").alias("entry"), F.concat(F.lit("http://old.example/p"), "id").alias("url"))
    known = df.select(F.explode(F.array(*[F.lit(d) for d in DOMAINS])).alias("d"), "url").select(F.concat(F.lit("http://"), "d", F.lit("/"), F.split_part("url", F.lit("/"), F.lit(4))).alias("key"))
    S.Stored.write(known.filter("key NOT LIKE '%/p5'").withColumn("body", F.to_json(F.struct(F.length("key").alias("n")))), str(tmp_path / "stored"))
    return df


def run(entries, tmp_path, transport=f"{MODULE}:Stored", **how):
    S.fetch(entries, "entry", "url", DOMAINS, str(tmp_path / "ledger"), str(tmp_path), transport, stored=str(tmp_path / "stored"), **how)


def test_runs_take_what_is_left(spark, entries, tmp_path):
    ledger = str(tmp_path / "ledger")
    assert S.entered(spark, ledger) is None
    run(entries, tmp_path, limit=2)
    first = {(r.entry, r.domain) for r in S.entered(spark, ledger).collect()}
    assert len(first) == 100
    run(entries, tmp_path)
    rows = S.entered(spark, ledger).collect()
    assert len(rows) == 260 == len({(r.entry, r.domain) for r in rows})  # nothing was asked twice
    for r in rows:
        assert (r.body is None) == r.key.endswith("/p5") and (r.body is None or json.loads(r.body) == {"n": len(r.key)})
    run(entries, tmp_path)  # nothing is left
    assert S.entered(spark, ledger).count() == 260


def test_a_run_that_breaks_off_keeps_what_it_has(spark, entries, tmp_path):
    with pytest.raises(Exception, match="service is down"):
        run(entries, tmp_path, down="/p77")
    done = S.entered(spark, str(tmp_path / "ledger"))
    before = set() if done is None else {(r.entry, r.domain) for r in done.collect()}
    assert len(before) < 260 and not any(e == "e077" for e, _ in before)
    (tmp_path / "ledger" / "parts").mkdir(parents=True, exist_ok=True)
    (tmp_path / "ledger" / "parts" / "lost.parquet").write_bytes((tmp_path / "ledger/parts" / sorted(x.name for x in (tmp_path / "ledger/parts").iterdir())[0]).read_bytes() if before else b"")
    if not before:
        (tmp_path / "ledger" / "parts" / "lost.parquet").unlink()
    run(entries, tmp_path)
    rows = S.entered(spark, str(tmp_path / "ledger")).collect()
    assert len(rows) == 260 == len({(r.entry, r.domain) for r in rows})


def test_requests_hold_fifty_keys(spark, entries, tmp_path):
    S.plan(S.pending(entries, "entry", "url", DOMAINS, None), str(tmp_path / "plan"))
    reader = S._RequestReader({"path": str(tmp_path / "plan"), "transport": f"{MODULE}:Stored", "stored": str(tmp_path / "stored")})
    sizes = [sum(b.num_rows for b in reader.read(p)) for p in reader.partitions()]
    assert sorted(sizes) == [10, 50, 50, 50, 50, 50]
    with pytest.raises(ValueError, match="50"):
        S.Stored({"stored": str(tmp_path / "stored")}).fetch([str(i) for i in range(51)])


def test_topics(spark, tmp_path):
    rows = [(f"d{i:03d}", f"2014-{1 + i % 12:02d}-{1 + i // 40:02d}", json.dumps({"t": "vote" if i % 3 else "sport"})) for i in range(300)]
    spark.createDataFrame(rows, "id string, published string, body string").write.parquet(str(tmp_path / "stored"))
    spark.dataSource.register(S.Topics)
    want = {r[0] for r in rows if "vote" in r[2] and r[1] >= "2014-03"}

    def batch(df, number):
        df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

    def go(seconds):
        stream = spark.readStream.format("topics").option("transport", f"{MODULE}:StoredTopics").option("stored", str(tmp_path / "stored")).option("query", "vote").option("since", "2014-03").option("pages", "3").load()
        q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "marks")).start()
        q.awaitTermination(seconds)
        q.stop()

    for _ in range(12):  # stopped at any page, it goes on from there
        go(4)
        got = [r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()] if (tmp_path / "out").exists() else []
        if len(got) == len(want):
            break
    assert sorted(got) == sorted(want)
    reader = S._TopicReader({"transport": f"{MODULE}:StoredTopics", "stored": str(tmp_path / "stored"), "query": "vote", "since": "2014-03", "pages": "3"})
    at, ids = reader.initialOffset(), []
    while not at["over"]:
        rows, nxt = reader.read(at)
        rows = list(rows)
        assert list(reader.readBetweenOffsets(at, nxt)) == rows
        ids, at = ids + [r[0] for r in rows], nxt
    assert sorted(ids) == sorted(want)
