"""Best-fit packing of token sequences with certified repacking.

Documents become pieces of at most ``capacity`` tokens.  Pieces are dealt to
partitions by hash; each partition packs best-fit decreasing and proves a lower
bound on its bins with dual feasible functions: the threshold family of
Martello and Toth (1990) for every threshold and the rounding family of Fekete
and Schepers (2001).  A partition whose bins meet the bound is certified and
final.  One with a gap keeps its fuller sequences and gives up the pieces of
its emptiest ones, which are dealt anew among all such partitions and packed
again, for a fixed number of rounds; the last round keeps what it packs, proven
or not.  ``certificate`` reports sequences and bounds of every partition and of
the whole.

Partitions hold about ``PART_PIECES`` pieces whatever the corpus, and a
partition's work is near linear: bins are found by remaining room in a bit set.

Cases: null and empty texts are the end id alone; null ids are packed like
others; repeated rows are packed each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgrain.llm.common import cut, lean
from newsgrain.llm.tokens import encoder

CAPACITY = 4096
PART_PIECES = 8192
ROUNDS = 3
#: Of a partition with a gap, at least this share of its sequences is given up.
GIVE_UP = 0.04


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each length, and the bins' loads."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room = 0  # bit r is set while some bin has r tokens left
    by_room: dict[int, list[int]] = {}
    loads: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fit = room >> need
        if fit:
            left = need + (fit & -fit).bit_length() - 1
            pile = by_room[left]
            b = pile.pop()
            if not pile:
                room &= ~(1 << left)
        else:
            b, left = len(loads), capacity
            loads.append(0)
        bins[i], offsets[i] = b, loads[b]
        loads[b] += need
        left -= need
        if left:
            by_room.setdefault(left, []).append(b)
            room |= 1 << left
    return bins, offsets, np.array(loads, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual feasible functions."""
    return _bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def _bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """The bound for so many pieces of each length from 0."""
    if not count.any():
        return 0
    size = np.arange(capacity + 1, dtype=np.int64)
    n, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    between = lambda c, lo, hi: c[np.maximum(hi, lo)] - c[lo]  # noqa: E731  sizes lo <= s < hi
    half = capacity // 2
    a = np.arange(0, half + 1)
    big = between(n, capacity - a + 1, np.full_like(a, capacity + 1))
    mid_n, mid_t = between(n, np.full_like(a, half + 1), capacity - a + 1), between(total, np.full_like(a, half + 1), capacity - a + 1)
    small = between(total, a, np.full_like(a, half + 1))
    best = int((big + mid_n + np.maximum(0, -(-(small - (mid_n * capacity - mid_t)) // capacity))).max())
    for k in range(1, 33):  # sizes rounded to k-ths, those on the grid kept as they are
        scaled = (k + 1) * size
        kept = scaled % capacity == 0
        value = np.where(kept, size * k, scaled // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, int(-(-int((value * count).sum()) // (k * capacity))))
    return best


def pack_partition(lengths: np.ndarray, capacity: int, final: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, loose) of the pieces: those given up are loose."""
    bins, offsets, loads = best_fit(lengths, capacity)
    gap = len(loads) - lower_bound(lengths, capacity)
    if final or gap <= 0:
        return bins, offsets, np.zeros(len(lengths), bool)
    given = min(len(loads), max(8 * gap, int(GIVE_UP * len(loads))))
    out = np.zeros(len(loads), bool)
    out[np.argsort(loads, kind="stable")[:given]] = True
    out &= loads < capacity
    return bins, offsets, out[bins]


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces: (doc_id, piece, start, length, ids_crc32)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema[0].dataType.simpleString()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for lo, ids, bounds in enc.encode(batch.column(1)):
                m = len(bounds) - 1
                sizes = np.diff(bounds) + 1
                every = np.full(len(ids) + m, end_id, "<u4")
                every[np.arange(len(ids)) + np.repeat(np.arange(m), sizes - 1)] = ids
                parts = -(-sizes // capacity)
                row = np.repeat(np.arange(m), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                at = ((np.cumsum(sizes) - sizes)[row] + start) * 4
                view = memoryview(every).cast("B")
                crc = [zlib.crc32(view[x : x + 4 * n]) for x, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(lean(tokenize), f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


def _packer(names: list[str], capacity: int, r: int, final: bool) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        bins, offsets, loose = pack_partition(t.column("length").to_numpy(), capacity, final)
        seq = (np.int64(r) << 58) | (np.int64(t.column("_group")[0].as_py()) << 24) | bins
        return pa.table([*t.select(names).columns, pa.array(seq), pa.array(offsets), pa.array(loose)], names=[*names, "sequence_id", "offset", "_loose"])

    return run


def pack(rows: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Add (sequence_id, offset) to rows with a ``length`` between 1 and capacity."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    names = rows.columns
    done, left = [], cut(rows, "pieces")
    for r in range(rounds):
        groups = max(1, -(-left.count() // PART_PIECES))
        final = r + 1 == rounds or groups == 1
        dealt = left.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(r)), F.lit(groups)).cast("bigint"))

        packed = cut(dealt.groupBy("_group").applyInArrow(_packer(names, capacity, r, final), f"{fields}, sequence_id bigint, offset bigint, _loose boolean"), "packed")
        done.append(packed.filter(~F.col("_loose")).drop("_loose"))
        if final:
            break
        left = packed.filter("_loose").select(*names)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(partition, sequences, bound, certified) of each partition of a packing, and of the whole in the row with a null partition.

    The whole's bound comes from the counts of each length, one row per length.
    """
    spark = packed.sparkSession
    part = F.shiftright("sequence_id", 24).alias("partition")
    sizes = packed.select(part, "length", "sequence_id")

    def prove(t: pa.Table) -> pa.Table:
        bound = lower_bound(t.column("length").to_numpy(), capacity)
        n = len(np.unique(t.column("sequence_id").to_numpy()))
        return pa.table([t.column("partition")[:1], pa.array([n]), pa.array([bound]), pa.array([n == bound])], names=["partition", "sequences", "bound", "certified"])

    each = sizes.groupBy("partition").applyInArrow(prove, "partition bigint, sequences bigint, bound bigint, certified boolean")
    counts = {r["length"]: r["count"] for r in packed.groupBy("length").count().collect()}  # capacity rows at most
    bound = _bound_of_counts(np.array([counts.get(i, 0) for i in range(capacity + 1)], np.int64), capacity)
    n = packed.select("sequence_id").distinct().count()
    return each.unionByName(spark.createDataFrame([(None, n, bound, n == bound)], each.schema))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack: one row per piece with its sequence and place."""
    return pack(pieces(docs, vocabulary, end_id, capacity, id_col, text_col), capacity)
