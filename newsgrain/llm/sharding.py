"""Sharding by best-fit-decreasing bin packing of indivisible groups (equal texts).

Groups are packed in levels, so that no task and not the driver ever meets a
number of groups that grows with the corpus.  While more than ``DRIVER_ITEMS``
items are left, they are dealt by hash into parts of about ``PART_ITEMS``, and
each part packs its items, largest first, into fixed-capacity bins: every item
enters the bin with the tightest remaining room, found in a balanced tree.  The
bins are the items of the next level.  The last level packs into the shards at
the least capacity that suffices (found by bisection), after giving a shard of
its own to any group larger than an even share.

The law is ``bytes``: shard sizes are near equal, to the size of a bin of the
last level (about 1/64 of a shard), unless one group alone is larger.

Slots: rows are sorted by range into (shard, text, id) order and numbered per
partition; partition counts, one row per shard and partition, give the offsets.
A group of any number of rows is split over ranges.

Cases: a null text has size 8 and the crc of no bytes and is a group apart from
the empty text; null ids sort first; repeated rows each get a slot; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgrain.llm.common import cut

SHARDS = 24
DRIVER_ITEMS = 20_000
PART_ITEMS = 20_000
#: Bins of a shard that the last level deals with, at least.
GRAIN = 64


class RoomTree:
    """Bins by remaining room: a treap with hashed priorities, so of logarithmic expected depth."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """(keys below, keys from) ``key``."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def add(self, room: int, number: int) -> None:
        low, high = self._split(self.root, (room, number))
        node = [(room, number), hash((number * 0x9E3779B97F4A7C15 + room) & (2**61 - 1)), None, None]
        self.root = self._merge(self._merge(low, node), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room of at least ``size``."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        parent, node = None, high
        while node[2] is not None:
            parent, node = node, node[2]
        if parent is None:
            high = node[3]
        else:
            parent[2] = node[3]
        self.root = self._merge(low, high)
        return node[0]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(bin of each size, number of bins); a size above the capacity gets a bin of its own."""
    out, tree, n = np.zeros(len(sizes), np.int64), RoomTree(), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = tree.take(size) if size <= capacity else None
        if found is None:
            room, b = capacity - size, n
            n += 1
        else:
            room, b = found[0] - size, found[1]
        out[i] = b
        if room > 0:
            tree.add(room, b)
    return out, n


def into_shards(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item: own shards for items above an even share, then the least capacity that fits the rest."""
    out = np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    used, rest = 0, int(sizes.sum())
    while used < shards - 1 and used < len(order) and int(sizes[order[used]]) * (shards - used) > rest:
        out[order[used]] = used
        rest -= int(sizes[order[used]])
        used += 1
    left = order[used:]
    if not len(left):
        return out
    low = max(-(-rest // (shards - used)), int(sizes[left].max()))
    high, best = low, None
    while best is None:
        bins, n = best_fit(sizes[left], high)
        best, high = (bins, high) if n <= shards - used else (None, high + max(1, high // 256))
    for _ in range(12):
        if low >= high:
            break
        mid = (low + high) // 2
        bins, n = best_fit(sizes[left], mid)
        if n <= shards - used:
            best, high = bins, mid
        else:
            low = mid + 1
    out[left] = used + best
    return out


def _level(capacity: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        bins, _ = best_fit(t.column("item_size").to_numpy(), capacity)
        part = pa.array(np.full(t.num_rows, t.column("_part")[0].as_py(), np.int64))
        up = pa.StructArray.from_arrays([part, pa.array(bins)], names=["part", "bin"])
        return pa.table([t.column("item"), t.column("item_size"), up], names=["item", "item_size", "up"])

    return run


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw) + 8).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(F.lit(1), F.col(text_col)).alias("h1"),
        F.xxhash64(F.lit(2), F.col(text_col), F.col(text_col).isNull()).alias("h2"),
    )
    rows = cut(rows, "sized")
    groups = cut(rows.groupBy("h1", "h2").agg(F.sum("size").alias("item_size")).withColumn("item", F.struct("h1", "h2")), "groups")
    n, total = groups.agg(F.count(F.lit(1)), F.sum("item_size")).first()
    total = total or 0
    level, chain = groups.select("item", "item_size"), []
    while n > DRIVER_ITEMS:
        parts = -(-n // PART_ITEMS)
        capacity = max(1, min(64 * total // n, total // (shards * GRAIN)))
        dealt = level.withColumn("_part", F.pmod(F.xxhash64("item"), F.lit(parts)))
        kind = level.schema["item"].dataType.simpleString()

        packed = cut(dealt.groupBy("_part").applyInArrow(_level(capacity), f"item {kind}, item_size bigint, up struct<part:bigint,bin:bigint>"), "level")
        chain.append(packed.select("item", "up"))
        level = cut(packed.groupBy("up").agg(F.sum("item_size").alias("item_size")).withColumnRenamed("up", "item"), "bins")
        was, n = n, level.count()
        if n >= was:  # a level has at most shards * GRAIN items above its capacity, so this is a fault
            raise RuntimeError("a level of bins did not shrink")
    top = sorted(level.collect(), key=lambda r: tuple(r["item"]))  # DRIVER_ITEMS at most
    where = into_shards(np.array([r["item_size"] for r in top], np.int64), shards) if top else []
    placed = spark.createDataFrame([(tuple(r["item"]), int(s)) for r, s in zip(top, where, strict=True)], level.select("item").schema.add("shard", T.IntegerType()))
    for step in reversed(chain):
        placed = step.join(placed.withColumnRenamed("item", "up"), "up").select("item", "shard")
    placed = placed.select(F.col("item.h1").alias("h1"), F.col("item.h2").alias("h2"), "shard")
    found = rows.join(placed, ["h1", "h2"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    ordered = found.select("doc_id", "size", "text_crc32", "shard", "h1").repartitionByRange(parts, "shard", "h1", "doc_id").sortWithinPartitions("shard", "h1", F.col("doc_id").asc_nulls_first())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for b in batches:
            s = b.column(3).to_numpy()
            first = np.searchsorted(s, s, "left")  # sorted by shard
            inner = np.arange(len(s)) - first + seen[s]
            seen += np.bincount(s, minlength=shards)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(np.full(len(s), part, np.int32)), pa.array(inner)], names=["doc_id", "size", "text_crc32", "shard", "_part", "_inner"])

    numbered = cut(ordered.mapInArrow(number, f"doc_id {id_type}, size bigint, text_crc32 bigint, shard int, _part int, _inner bigint"), "slots")
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return numbered.join(offsets, ["shard", "_part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_base") + F.col("_inner")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
