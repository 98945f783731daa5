"""Queues as directories of files, processed by Structured Streaming.

A message is a JSON file.  Workers read with at-least-once delivery: a batch has
folders of its own in every table it writes, named for the worker's checkpoint
and its number, and writes them anew if it is tried again, so a repeat changes
nothing; rows that fail go to a dead-letter table and are not tried again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsgrain.operators.ingest import earliest


#: Messages keep microseconds.
TIMES = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def enqueue(rows: DataFrame, queue: str, per_message: int = 40) -> None:
    """Write rows as messages of at most ``per_message`` rows (L1, B12); rows without an integer ``id`` are refused."""
    bad = rows.filter(F.col("id").try_cast("bigint").isNull()).limit(1).count()
    if bad:
        raise ValueError("a message id is not an integer")
    rows.write.mode("append").option("maxRecordsPerFile", per_message).option("timestampFormat", TIMES).json(queue)


def messages(spark: SparkSession, queue: str, schema: str, per_trigger: int = 10) -> DataFrame:
    """The queue as a stream; ``per_trigger`` files at a time is the prefetch (L2)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("timestampFormat", TIMES).json(queue)


def batch_folder(table: str, checkpoint: str, number: int) -> str:
    """Where a worker's batch of that number writes, each time it is tried."""
    return f"{table}/run={hashlib.md5(checkpoint.encode()).hexdigest()[:12]}/batch={number}"


def ingest(stream: DataFrame, store: str, dead: str, checkpoint: str, when: str = "spider_when") -> StreamingQuery:
    """Run the worker until the queue is empty.

    The store is a log: a batch adds its earliest row of each id and reads
    nothing, so its cost does not grow with the store.  ``stored`` gives the earliest row of an id over all
    batches, in whatever order they came; ``compact`` writes that as a new store.
    """

    def merge(batch: DataFrame, number: int) -> None:
        usable = F.col("id").isNotNull() & F.col("url").isNotNull()
        batch.filter(~usable).write.mode("overwrite").json(batch_folder(dead, checkpoint, number))
        earliest(batch.filter(usable), "id", when, ["url"]).write.mode("overwrite").parquet(batch_folder(store, checkpoint, number))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, store: str, when: str = "spider_when") -> DataFrame:
    """The store's rows: the earliest of each id (L4)."""
    return earliest(spark.read.parquet(store).drop("run", "batch"), "id", when, ["url"])


def compact(spark: SparkSession, store: str, fresh: str, when: str = "spider_when") -> None:
    """Write the store's rows, one of each id, as a new store."""
    stored(spark, store, when).write.parquet(fresh)


def purge(spark: SparkSession, queue: str) -> bool:
    """Drop all messages of a queue (L3); whether there were any."""
    where = spark._jvm.org.apache.hadoop.fs.Path(queue)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def repeat(spark: SparkSession, dead: str, queue: str, schema: str, mended: Callable[[DataFrame], DataFrame]) -> None:
    """Put dead letters back into a queue after ``mended`` has set them right (L3); what still has no id or address stays dead."""
    rows = mended(spark.read.schema(schema).option("timestampFormat", TIMES).json(dead))
    enqueue(rows.filter("id IS NOT NULL AND url IS NOT NULL").drop("run", "batch"), queue)


def work(stream: DataFrame, process: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """A stateless worker: rows through ``process`` into a table."""

    def run(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(batch_folder(sink, checkpoint, number))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def depth(query: StreamingQuery) -> dict:
    """Rows processed and rate of the last trigger (L3)."""
    p = query.lastProgress
    return {"rows": 0, "rate": 0.0} if p is None else {"rows": p["numInputRows"], "rate": p["processedRowsPerSecond"]}


def download_work(articles: DataFrame) -> DataFrame:
    """What a download job has left to do (L7): sketch only, nothing, or a fetch."""
    done = F.col("fetch_status") == 200
    return articles.withColumn("task", F.when(done & F.col("structure_sketch").isNotNull(), "none").when(done, "sketch").otherwise("fetch"))


def daily_counts(stream: DataFrame, when: str, key: str, late: str = "5 minutes") -> DataFrame:
    """Extension: daily event counts with a watermark of the as-of slack."""
    return stream.withWatermark(when, late).groupBy(F.window(when, "1 day"), key).agg(F.count(F.lit(1)).alias("n"))
