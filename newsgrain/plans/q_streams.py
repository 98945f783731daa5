"""Streams over the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgrain.operators.ranges import written
from newsgrain.plans.base import Book
from newsgrain.plans.q_ingest import _ASOF, _snapshots
from newsgrain.streaming import asof_stream as A

BOOK = Book()
query, SQL = BOOK.query, BOOK.sql


def home(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's files in the session's checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        written(spark.range(1))
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def stream_asof(spark: SparkSession, sf: str) -> DataFrame:
    """All events as a stream of snapshots, out of order by up to three days, the worker stopped and started again after each quarter.

    A quarter is a batch, however many files it has: its files are in no order of
    time, so a batch of some of them would move the watermark past rows of the rest.
    """
    at = home(spark, "asof")
    rows = written(_snapshots(spark, sf).select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("published").cast("timestamp").alias("published"), "fb", "tw"))
    span = rows.agg(F.min(F.unix_seconds("ts")).alias("lo"), F.max(F.unix_seconds("ts")).alias("hi"))  # one row
    late = 86_400 * F.pmod(F.xxhash64("tw"), F.lit(3))
    share = (F.unix_seconds("ts") + late - F.col("lo")) / (F.col("hi") - F.col("lo") + 3 * 86_400)
    dealt = written(rows.crossJoin(F.broadcast(span)).select(*rows.columns, F.floor(4 * share).alias("part")))
    for part in range(4):
        dealt.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{at}/queue")
        if part == 3:
            end = rows.agg(F.max("ts") + F.expr("INTERVAL 12 DAYS"))
            A.tick(rows, "ts", end).write.mode("append").parquet(f"{at}/queue")
        stream = spark.readStream.schema(rows.schema).parquet(f"{at}/queue")
        A.run(A.asof_stream(stream, "user_id", "ts", "published", ["fb", "tw"], "3 days"), f"{at}/counts", f"{at}/marks").awaitTermination()
    return spark.read.parquet(f"{at}/counts").select("user_id", "offset", F.col("ts").cast("timestamp_ntz").alias("ts"), "fb", "tw")


SQL["stream_asof"] = f'{_ASOF} SELECT user_id, "offset", v.ts AS ts, v.fb AS fb, v.tw AS tw FROM a'


_DOMAINS = ["www.example.com", "m.example.org"]


@query
def counted_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Share counts of every page's address at two domains, from stored answers through a data source: a run with a limit, then one for the rest."""
    from newsgrain.plans.base import table
    from newsgrain.sources import service

    at = home(spark, "counts")
    pages = table(spark, sf, "pages").select("page_id", "url")
    keys = service.pending(pages, "page_id", "url", _DOMAINS, None).select("key").distinct()
    answers = keys.filter(F.length("key") % 7 != 0).withColumn("body", F.to_json(F.struct((F.length("key") * 3).alias("share_count"))))
    buckets = max(1, pages.count() // 2000)
    service.Stored.write(answers, f"{at}/stored", buckets)
    for limit in (3, None):
        service.fetch(pages, "page_id", "url", _DOMAINS, f"{at}/ledger", at, "newsgrain.sources.service:Stored", limit, stored=f"{at}/stored", buckets=str(buckets))
    found = service.entered(spark, f"{at}/ledger")
    return found.groupBy("entry", "domain").agg(F.max(F.get_json_object("body", "$.share_count").cast("int")).alias("shares"), F.count(F.lit(1)).alias("asked"))


SQL["counted_entries"] = """
WITH k AS (SELECT page_id, domain, 'http://' || domain || '/' || regexp_replace(url, '^[^/]*/[^/]*/[^/]*/?', '') AS key FROM pages, (VALUES ('www.example.com'), ('m.example.org')) d(domain))
SELECT CAST(page_id AS VARCHAR) AS entry, domain, CAST(CASE WHEN length(key) % 7 <> 0 THEN length(key) * 3 END AS INTEGER) AS shares, CAST(1 AS BIGINT) AS asked FROM k
"""
