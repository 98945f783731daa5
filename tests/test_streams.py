"""Keyed state and timers against the batch aggregate, and batches that are tried again."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsgrain.operators import ingest
from newsgrain.streaming import asof_stream as A
from newsgrain.streaming import ingest_stream as S

COLS = "k string, ts timestamp, published timestamp, n bigint, note string"
DAY = dt.datetime(2024, 3, 1)


def snapshots():
    """Keys with many, few and one snapshot, before publication and long after, equal times, null values, on the edges of the slack."""
    rnd, rows = random.Random(6), []
    for i in range(12):
        born = DAY + dt.timedelta(minutes=rnd.randrange(3000))
        for _ in range(400 if i == 0 else rnd.randrange(1, 12)):
            rows.append((f"k{i}", born + dt.timedelta(seconds=int(10 ** rnd.uniform(0, 5.9)) - 30), born, rnd.randrange(100), rnd.choice([None, "a", "b"])))
    for s in ingest.OFFSETS.values():
        for off in (-1, 0, 1):
            rows.append((f"edge{s}", DAY + dt.timedelta(seconds=s + 300, microseconds=off), DAY, off, "x"))
    return rows + rows[:5]


@pytest.mark.parametrize("lateness", ["20 days"])
def test_same_rows_as_the_batch(spark, tmp_path, lateness):
    rows = snapshots()
    random.Random(1).shuffle(rows)
    batch = spark.createDataFrame(rows, COLS)
    want = sorted((r.k, r.offset, r.n is None, r.n, r.note is None, r.note) for r in ingest.asof_long(batch, "k", "ts", "published", ["n", "note"]).collect())
    queue, third = str(tmp_path / "queue"), len(rows) // 3 + 1
    for i in range(3):
        spark.createDataFrame(rows[i * third : (i + 1) * third], COLS).coalesce(1).write.mode("append").parquet(queue)
        if i == 2:
            A.tick(batch, "ts", spark.createDataFrame([(DAY + dt.timedelta(days=60),)], "t timestamp")).write.mode("append").parquet(queue)
        stream = spark.readStream.schema(COLS).parquet(queue)  # the worker starts again
        work = A.run(A.asof_stream(stream, "k", "ts", "published", ["n", "note"], lateness), str(tmp_path / "out"), str(tmp_path / "marks"))
        work.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.k, r.offset, r.n is None, r.n, r.note is None, r.note) for r in out.collect()) == want
    assert work.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0  # nothing is kept
    assert spark.conf.get(A._PROVIDER[0]) != A._PROVIDER[1]


def test_offsets_close_with_time(spark, tmp_path):
    queue = str(tmp_path / "queue")
    rows = [("a", DAY + dt.timedelta(minutes=m), DAY, m, None) for m in (0, 20, 34, 36, 130)]
    spark.createDataFrame(rows, COLS).coalesce(1).write.parquet(queue)
    counts = A.asof_stream(spark.readStream.schema(COLS).parquet(queue), "k", "ts", "published", ["n"], "5 minutes")
    A.run(counts, str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
    # the time is 2:05: the offsets whose slack has passed are out, the others wait
    assert sorted((r.offset, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("1h", 36), ("30m", 34), ("initial", 0)]


def test_a_batch_tried_again_changes_nothing(spark, tmp_path, monkeypatch):
    schema = "id bigint, url string, spider_when timestamp"
    queue, store, dead, marks = (str(tmp_path / x) for x in ("queue", "store", "dead", "marks"))
    S.enqueue(spark.createDataFrame([(1, "u", DAY), (2, None, DAY), (3, "w", DAY)], schema), queue, 10)
    held = []
    real = S.earliest

    def twice(df, *how):
        if not held:  # the first try ends after its dead letters are written
            held.append(df)
            raise RuntimeError("lost")
        return real(df, *how)

    monkeypatch.setattr(S, "earliest", twice)
    with pytest.raises(Exception, match="lost"):
        S.ingest(S.messages(spark, queue, schema), store, dead, marks).awaitTermination()
    S.ingest(S.messages(spark, queue, schema), store, dead, marks).awaitTermination()
    assert [r.id for r in spark.read.schema(schema).json(dead).collect()] == [2]
    S.work(S.messages(spark, queue, schema), lambda b: b.select("id"), str(tmp_path / "sink"), str(tmp_path / "m2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 3
    # put back twice by the same try, they are there once
    S.repeat(spark, dead, queue, schema, lambda d: d.withColumn("url", F.lit("mended")))
    S.ingest(S.messages(spark, queue, schema), store, dead, marks).awaitTermination()
    assert sorted((r.id, r.url) for r in S.stored(spark, store).collect()) == [(1, "u"), (2, "mended"), (3, "w")]


def test_a_users_snapshots_in_many_files(spark, tmp_path):
    """A quarter of the stream has more files than a batch of eight had; those that came after the watermark were lost."""
    import duckdb

    from newsgrain.plans import registry

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(24).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", 128 << 20)  # each file a partition
    try:
        got = sorted(tuple(r) for r in registry.QUERIES["stream_asof"](spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.execute(registry.SQL["stream_asof"]).fetchall())


def test_batches_of_a_longer_queue(spark, tmp_path, monkeypatch):
    """The queue of 200 000 events is done in six batches at most; four messages at a time were ten and more."""
    from pyspark.sql import functions as F

    from newsgrain.plans import registry
    from newsgrain.streaming import ingest_stream as S

    rows = spark.range(200_000).select((F.col("id") % 1000).alias("user_id"), F.lit("view").alias("event_type"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    runs, ingest = [], S.ingest
    monkeypatch.setattr(S, "ingest", lambda *a: runs.append(ingest(*a)) or runs[0])
    found = registry.QUERIES["stream_ingest"](spark, str(tmp_path)).collect()
    assert len(found) == 1000 and {r.id: r.spider_when.timestamp() for r in found if r.id < 3} == {r.id: r.spider_when.timestamp() for r in rows.filter("user_id < 3").groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("spider_when")).collect()}
    assert 2 <= len(runs[0].recentProgress) <= 6
