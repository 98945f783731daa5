"""As-of counts from a stream of snapshots, by keyed state and event-time timers.

A key's state holds, for each offset still open, the last snapshot that counts
for it.  When the watermark passes an offset's time and slack, a timer writes its
row and takes it out of the state; after the last offset the state is gone, so it
is as large as what was published in the last five days, whatever the stream's
age.  Snapshots may come in any order within ``lateness``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from newsgrain.operators.ingest import OFFSETS, SLACK

_NAMES = list(OFFSETS)
#: Microseconds after publication up to which a snapshot counts for each offset.
_LIMITS = [(s + SLACK) * 1_000_000 for s in OFFSETS.values()]
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _rank(snapshot: Sequence) -> tuple:
    """Later snapshots count, of equal times the greater values; nulls are least."""
    return tuple((v is not None, v) for v in snapshot)


def _expiry(published: int, i: int) -> int:
    """The millisecond after an offset's last moment."""
    return (published + _LIMITS[i]) // 1000 + 1


class OpenOffsets(StatefulProcessor):
    """Keeps the best snapshot of each open offset; a timer closes an offset."""

    def __init__(self, values: Sequence[str], state: T.StructType):
        self.values, self.schema = list(values), state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else None
        best = {} if held is None else {b[0]: tuple(b[1:]) for b in held[1]}
        published, known = None if held is None else held[0], set(best)
        for r in rows:
            if r["_published"] is None:
                continue  # a tick: it only tells the time
            snapshot = (r["_when"], *(r[v] for v in self.values))
            for i, limit in enumerate(_LIMITS):
                if r["_when"] - r["_published"] <= limit and (i not in best or _rank(snapshot) > _rank(best[i])):
                    published = r["_published"] if published is None else published
                    best[i] = snapshot
        for i in set(best) - known:
            self.handle.registerTimer(_expiry(published, i))
        if best:
            self.state.update((published, [(i, *best[i]) for i in sorted(best)]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        published, best = self.state.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        left = [tuple(b) for b in best if _expiry(published, b[0]) > now]
        for b in best:
            if _expiry(published, b[0]) <= now:
                yield Row(**{"key": key[0], "offset": _NAMES[b[0]], "_when": b[1], **dict(zip(self.values, b[2:], strict=True))})
        if left:
            self.state.update((published, left))
        else:
            self.state.clear()


def _combined(rows: DataFrame, values: Sequence[str]) -> DataFrame:
    """Of each part of a batch only rows that may count: the best of a key and offset, and the latest for the time.

    So a key with many snapshots sends a few rows from each part to its state.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                order = f.sort_values(["_when", *values], na_position="first", kind="stable")
                late = order["_when"] - order["_published"]
                keep = {order.index[-1]}
                for limit in _LIMITS:
                    keep.update(order[late <= limit].drop_duplicates("key", keep="last").index)
                yield f.loc[sorted(keep)]

    return rows.mapInPandas(run, rows.schema)


def asof_stream(stream: DataFrame, key: str, when: str, published: str, values: Sequence[str], lateness: str = "1 hour") -> DataFrame:
    """(key, offset, when, values) of every offset as soon as its slack has passed; a row without ``published`` is a tick.

    A key has one time of publication.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = stream.select(F.col(key).alias("key"), F.col(when).cast("timestamp").alias("_at"), micros(when).alias("_when"), micros(published).alias("_published"), *values)
    kinds = {f.name: f.dataType for f in rows.schema}
    snapshot = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("when", T.LongType()), *[T.StructField(v, kinds[v]) for v in values]])
    state = T.StructType([T.StructField("published", T.LongType()), T.StructField("best", T.ArrayType(snapshot))])
    out = T.StructType([T.StructField("key", kinds["key"]), T.StructField("offset", T.StringType()), T.StructField("_when", T.LongType()), *[T.StructField(v, kinds[v]) for v in values]])
    timed = _combined(rows, values).withWatermark("_at", lateness)
    found = timed.groupBy("key").transformWithState(OpenOffsets(values, state), out, "Append", "EventTime")
    return found.select(F.col("key").alias(key), "offset", F.timestamp_micros("_when").alias(when), *values)


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Timers need the store that keeps state on disk; the session's own setting comes back."""
    name, value = _PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run(counts: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Write closed offsets to a table until the input is used up; the sink's own log keeps a repeated batch from counting twice."""
    with _state_store(counts.sparkSession):
        return counts.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def tick(like: DataFrame, when: str, at: DataFrame) -> DataFrame:
    """A row that only tells the time: the one value of ``at``; other columns are null."""
    return at.select(*[F.col(at.columns[0]).cast(f.dataType).alias(f.name) if f.name == when else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema])
