"""Hard-negative mining by norm-bucketed search.

Vectors become integers, ``floor(scale * x)``, so that every inner product is
exact.  All candidates are sorted by length, longest first, and written as
shelves; a shelf is searched in buckets of ``BUCKET`` vectors.  The anchors are
written as blocks of ``BLOCK_BYTES`` and taken ``WAVE`` blocks at a time: a wave
(16 MB at most) goes to all tasks, and the shelves stay where they lie, so
nothing but the few best rows of each task is shuffled.

A wave is searched twice.  First for the positives, the ``positives`` best rows
of an anchor's own label; then for the negatives of each anchor and positive,
rows of other labels whose score lies in a window under the positive's.  An
anchor skips a bucket when its length times that of the bucket's longest vector
(Cauchy and Schwarz) is below the window's lower limit or below the worst of the
best scores found so far.  The shelf of the longest vectors is searched first,
and what it gives is the limit from which all other tasks start; shelves that no
anchor of a wave can reach are not read.  Skipped rows are proven not to be in
the result, so it is exact and has no bound on candidates.  Vectors of about one
length leave nothing to skip (README has figures).

Cases: rows with a null id, label or vector, an empty vector, or null or
non-finite components take no part, nor do those whose squared integer length
reaches 2**62, as their scores would not fit a long; scores are taken between
vectors of one dimension only; ties go to the smaller id; an anchor's own id is
never its positive or negative; rows that repeat an id are met each, as anchors
too; anchors without positives, and windows without rows, give no rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgrain.llm.common import cut, forget, lean, shared_dir

#: Vectors that are pruned together, and bytes of vectors of a shelf and of a block of anchors.
BUCKET, SHELF_BYTES, BLOCK_BYTES = 512, 1 << 20, 1 << 18
#: Blocks of anchors that are searched together.
WAVE = 64
_NONE = np.iinfo(np.int64).min + 1
_PACKED = [("part", pa.int64()), ("dim", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("raw", pa.binary())]
_PACKED_DDL = "part bigint, dim int, longest double, ids binary, labels binary, raw binary"


def _vectors(rows: DataFrame, scale: float) -> DataFrame:
    """(id, label, dim, norm, raw): integer vectors with their squared length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(2)
            sizes = np.diff(col.offsets.to_numpy()) if len(col) else np.zeros(0, np.int64)
            if len(col) and not col.null_count and (sizes == sizes[0]).all() and sizes[0]:
                x = col.flatten()
                bad = x.is_null().to_numpy(zero_copy_only=False).reshape(len(col), -1).any(axis=1)
                parts = [(np.arange(len(col)), x.fill_null(0.0).to_numpy().reshape(len(col), -1), bad)]
            else:
                parts = [(np.array([i]), np.array([v], np.float64), np.zeros(1, bool)) for i, v in enumerate(col.to_pylist()) if v and None not in v]
            for at, x, bad in parts:
                with np.errstate(all="ignore"):
                    y = np.floor(scale * x)
                    norm = (y * y).sum(axis=1)
                    good = np.flatnonzero(np.isfinite(x).all(axis=1) & (norm < 2.0**61.99) & ~bad)
                y = y[good].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at[good])), b.column(1).take(pa.array(at[good])), pa.array(np.full(len(good), x.shape[1], np.int32)), pa.array(norm[good]), pa.array([r.tobytes() for r in y], pa.binary())],
                    names=["id", "label", "dim", "norm", "raw"],
                )

    return rows.mapInArrow(run, "id bigint, label bigint, dim int, norm double, raw binary")


def _packs(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Vectors in order of length as rows of about ``size`` bytes, numbered from the longest of each dimension on."""

    def pack(part: int, dim: int, held: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(held).combine_chunks()
        values = [[part], [dim], [math.sqrt(t.column("norm")[0].as_py())], [t.column("id").to_numpy().tobytes()], [t.column("label").to_numpy().tobytes()], [b"".join(t.column("raw").to_pylist())]]
        return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, (_, kind) in zip(values, _PACKED, strict=True)], names=[c for c, _ in _PACKED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, rows, dim = TaskContext.get().partitionId() << 32, [], 0, -1
        for b in batches:
            t = pa.Table.from_batches([b])
            dims = t.column("dim").to_numpy()
            while len(t):
                if rows and (dims[0] != dim or rows >= max(1, size // (4 * dim))):
                    yield pack(part, dim, held)
                    part, held, rows = part + 1, [], 0
                dim = int(dims[0])
                n = min(int(np.searchsorted(dims, dim, "right")), max(1, size // (4 * dim)) - rows)
                held.append(t.slice(0, n))
                rows, t, dims = rows + n, t.slice(n), dims[n:]
        if rows:
            yield pack(part, dim, held)

    order = ["dim", F.col("norm").desc(), "id", "label"]
    ordered = vectors.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ordered.mapInArrow(lean(run), _PACKED_DDL), name)


@dataclass
class _Pack:
    """Vectors of one dimension; ``first`` is the number of the first of them in its wave."""

    dim: int
    longest: float
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    first: int = 0

    @staticmethod
    def read(dim: int, longest: float, ids: bytes, labels: bytes, raw: bytes) -> _Pack:
        return _Pack(dim, longest, np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(raw, np.int32).reshape(-1, dim))

    def __post_init__(self):
        self.norms = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)  # never short


def _products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of integer rows: in doubles while all sums are below 2**53."""
    if bound < 2.0**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a.astype(np.int64) @ b.astype(np.int64).T


class _Best:
    """The k best (score, id) of each key, higher scores first, then smaller ids; a kept score of a key bounds what may follow."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor, k
        self.score, self.id = np.full((len(floor), k), _NONE), np.full((len(floor), k), np.iinfo(np.int64).max)

    @property
    def limit(self) -> np.ndarray:
        return np.maximum(self.floor, self.score[:, -1])

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        keys = np.unique(key)
        key = np.concatenate([key, np.repeat(keys, self.k)])
        score = np.concatenate([score.astype(np.int64), self.score[keys].ravel()])
        ids = np.concatenate([ids, self.id[keys].ravel()])
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        keep = place < self.k
        self.score[key[keep], place[keep]], self.id[key[keep], place[keep]] = score[keep], ids[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, place = np.nonzero(self.score > _NONE)
        return key, self.score[key, place], self.id[key, place]


def _search(shelf: _Pack, wave: list[_Pack], best: _Best, ceiling: np.ndarray, width: int, same: bool) -> int:
    """Add to ``best`` what a shelf has for each anchor's ``width`` keys; returns how many products were taken.

    Keys are anchor * width + j.  Scores are at most the key's ceiling, and of rows of the anchor's label or of others.
    """
    taken = 0
    for block in wave:
        if block.dim != shelf.dim:
            continue
        mine = slice(block.first * width, (block.first + len(block.ids)) * width)
        top = ceiling[mine].reshape(-1, width)
        for lo in range(0, len(shelf.ids), BUCKET):
            limit = best.limit[mine].reshape(-1, width)
            least = np.where(top >= limit, limit, np.iinfo(np.int64).max).min(axis=1)
            longest = shelf.norms[lo : lo + BUCKET].max()
            on = np.flatnonzero(block.norms * longest >= least)
            if not len(on):
                continue
            ids, labels = shelf.ids[lo : lo + BUCKET], shelf.labels[lo : lo + BUCKET]
            score = _products(block.vectors[on], shelf.vectors[lo : lo + BUCKET], block.longest * longest)
            taken += score.size
            fits = (score >= least[on, None]) & (score <= top[on].max(axis=1)[:, None])
            a, c = np.nonzero(fits)
            right = ((block.labels[on[a]] == labels[c]) == same) & (block.ids[on[a]] != ids[c])
            a, c = a[right], c[right]
            s, a, ids = score[a, c].astype(np.int64), on[a], ids[c]
            found = [(np.flatnonzero((s >= limit[a, j]) & (s <= top[a, j])), j) for j in range(width)]
            if any(len(x) for x, _ in found):
                best.add(np.concatenate([(block.first + a[x]) * width + j for x, j in found]), np.concatenate([s[x] for x, _ in found]), np.concatenate([ids[x] for x, _ in found]))
    return taken


def _searched(shelves: DataFrame, wave: list[_Pack], floor: np.ndarray, ceiling: np.ndarray, width: int, k: int, same: bool) -> DataFrame:
    """(key, score, id): the k best of each key over all shelves; every task sends its own k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(floor, k)
        for b in batches:
            for r in b.to_pylist():
                _search(_Pack.read(r["dim"], r["longest"], r["ids"], r["labels"], r["raw"]), wave, best, ceiling, width, same)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in best.rows()], names=["key", "score", "id"])

    rows = shelves.select("dim", "longest", "ids", "labels", "raw").mapInArrow(lean(run), "key bigint, score bigint, id bigint")
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), "id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _found(rows: DataFrame, best: _Best) -> _Best:
    """The rows of a wave, ``k`` a key at most, as an array on the driver."""
    t = rows.select("key", "score", "id").toArrow()
    if t.num_rows:
        best.add(*(t.column(c).to_numpy() for c in ("key", "score", "id")))
    return best


def _reachable(shelves: DataFrame, wave: list[_Pack], floor: np.ndarray, width: int) -> DataFrame:
    """Shelves whose longest vector some anchor of the wave can reach its limit with."""
    out = F.lit(False)
    for dim in sorted({b.dim for b in wave}):
        of = [b for b in wave if b.dim == dim]
        ratio = min(float(np.min(floor[b.first * width : (b.first + len(b.ids)) * width].reshape(-1, width).min(axis=1) / np.maximum(b.norms, 1e-300))) for b in of)
        out = out | ((F.col("dim") == dim) & (F.col("longest") * (1 + 1e-9) >= F.lit(ratio)))
    return shelves.filter(out)


def hard_negatives(
    rows: DataFrame,
    anchors: str | Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all rows that ``anchors`` selects.

    A negative's score is between ``low`` and ``high`` percent of the positive's.
    """
    spark = rows.sparkSession
    condition = F.expr(anchors) if isinstance(anchors, str) else anchors
    usable = rows.withColumn("_anchor", F.coalesce(condition, F.lit(False))).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), "_anchor"
    )
    usable = usable.filter("id IS NOT NULL AND label IS NOT NULL AND size(v) > 0")
    shelves = _packs(_vectors(usable.select("id", "label", "v"), scale), SHELF_BYTES, "shelves")
    blocks = _packs(_vectors(usable.filter("_anchor").select("id", "label", "v"), scale), BLOCK_BYTES, "anchors")
    firsts = {r["dim"]: r["part"] for r in shelves.groupBy("dim").agg(F.min("part").alias("part")).collect()}
    parts = [r["part"] for r in blocks.select("part").orderBy("part").collect()]  # a number for each block of anchors
    out = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], schema).write.parquet(out)
    for lo in range(0, len(parts), WAVE):
        held = blocks.filter(F.col("part").between(parts[lo], parts[min(lo + WAVE, len(parts)) - 1])).orderBy("part").collect()
        wave, n = [], 0
        for r in held:
            wave.append(_Pack.read(r["dim"], r["longest"], r["ids"], r["labels"], r["raw"]))
            wave[-1].first, n = n, n + len(wave[-1].ids)
        longest = F.col("part").isin([firsts[d] for d in {b.dim for b in wave}])

        def best(floor: np.ndarray, ceiling: np.ndarray, width: int, k: int, same: bool, wave=wave, longest=longest) -> DataFrame:
            first = _found(_searched(shelves.filter(longest), wave, floor, ceiling, width, k, same), _Best(floor, k))
            return _searched(_reachable(shelves, wave, first.limit, width), wave, first.limit, ceiling, width, k, same)

        nothing = np.full(n, _NONE)
        found = _found(best(nothing, np.full(n, -_NONE), 1, positives, True), _Best(nothing, positives))
        scores, there = found.score.ravel(), found.score.ravel() > _NONE
        floor = np.array([-((-low * s) // 100) if t else -_NONE for s, t in zip(scores.tolist(), there.tolist(), strict=True)], np.int64)
        ceiling = np.array([high * s // 100 if t else _NONE for s, t in zip(scores.tolist(), there.tolist(), strict=True)], np.int64)
        anchor = np.repeat(np.concatenate([b.ids for b in wave]), positives)
        positive = found.id.ravel()

        def named(batches: Iterator[pa.RecordBatch], anchor=anchor, positive=positive, scores=scores) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key = b.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(anchor[key]), pa.array(positive[key]), b.column(1), b.column(2), pa.array(scores[key]), b.column(3)], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        negative = best(floor, ceiling, positives, negatives, False).select("key", F.col("place").cast("int"), "id", "score")
        negative.mapInArrow(named, schema).write.mode("append").parquet(out)
    forget(shelves)
    forget(blocks)
    return spark.read.schema(schema).parquet(out)
