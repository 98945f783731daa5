"""Embedding near-dedup by an epsilon grid order join.

Equal vectors are one class, met once with its multiplicity.  The classes are
rotated to principal axes (the covariance of all rows is summed on the
executors; a matrix of the dimension reaches the driver), laid on a grid with
cells of the join distance on the ``AXES`` leading ones, and sorted in the
lexicographic order of their cells.  The sorted sequence is cut into blocks of
``BLOCK`` vectors.  Pairs of sequence intervals are joined recursively from the
whole sequence down: each step splits both intervals into ``FAN`` parts and
drops the pairs whose boxes are farther apart than the join distance.  Pairs of
blocks are also dropped by centre and radius, which bound all axes; pairs that
the same bound proves fully linked are counted without being compared, so a
dense group of near copies costs its blocks, not its pairs.  The rest is
compared block by block: first on ``LEAD`` leading axes, where the product of
what is left of two unit vectors bounds the rest of their cosine, and what that
leaves in double precision.

How much the boxes prune depends on the data: vectors of few strong dimensions
leave ever fewer pairs of blocks as they grow in number; vectors spread evenly
over many dimensions leave most, whatever the order (README has figures).

Each comparison returns counts and a spanning forest of the links found, never
the pairs.  Blocks travel by shelves of ``SHELF``: a task holds two shelves
and compares the pairs of their blocks that are left, so that without any
pruning a vector is sent once per shelf and not once per block.

Vectors of each length are joined on their own.

Cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, and vectors of different lengths do not link; a
row with a null id is returned with no links, a null component, and kept; rows that share an id are compared each and share their links and component;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgrain.llm.common import components, cut, lean

AXES, LEAD = 6, 16
BLOCK = 256
#: Blocks that are stored, and sent to a comparison, together.
SHELF = 64
FAN = 8
_LO, _HI = [f"lo{i}" for i in range(AXES)], [f"hi{i}" for i in range(AXES)]
_LEAF = [("leaf", pa.int32()), ("least", pa.int64()), ("weight", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), *[(c, pa.float64()) for c in [*_LO, *_HI]]]


def _valid(rows: DataFrame) -> DataFrame:
    """(id, raw): finite nonzero vectors as packed doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            raw: list[bytes | None] = []
            flat = col.flatten()
            if len(col) and not col.null_count and not flat.null_count and len({*np.diff(col.offsets.to_numpy()).tolist()}) == 1:
                x = flat.to_numpy().astype(np.float64).reshape(len(col), -1)
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                raw = [r.tobytes() if g else None for r, g in zip(x, good, strict=True)]
            else:
                for v in col.to_pylist():
                    x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
                    raw.append(x.tobytes() if len(x) and np.isfinite(x).all() and (x != 0).any() else None)
            keep = pa.array([r is not None for r in raw], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), pa.array([r for r in raw if r is not None], pa.binary())], names=["id", "raw"])

    return rows.mapInArrow(run, "id bigint, raw binary")


def _unit(raw: list[bytes]) -> np.ndarray:
    return _unit_rows(b"".join(raw), len(raw))


def _unit_rows(raw: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(raw, np.float64).reshape(n, -1)
    scale = np.abs(x).max(axis=1, keepdims=True)  # first to 1, so no square overflows
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _axes(classes: DataFrame, dim: int) -> np.ndarray:
    """The principal axes of all unit vectors, as columns, the leading ones first."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            if b.num_rows:
                u = np.hstack([_unit(b.column(0).to_pylist()), np.ones((b.num_rows, 1))])
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 32]), pa.array([total.tobytes()], pa.binary())], names=["slot", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in t.column("sums"))
        return pa.table([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = classes.select("raw").mapInArrow(sums, "slot bigint, sums binary").groupBy("slot").applyInArrow(add, "sums binary")
    total = sum(np.frombuffer(r["sums"]) for r in parts.collect())  # 32 rows at most
    total = total.reshape(dim + 1, dim + 1)
    n = max(total[-1, -1], 1)
    mean = total[-1, :-1] / n
    _, vectors = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return np.ascontiguousarray(vectors[:, ::-1])


def _blocks(classes: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """Blocks of the epsilon grid order with boxes, centres and radii."""
    k = axes.shape[1]
    cells = ", ".join(f"c{i} int" for i in range(k))

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z = np.floor(_unit(b.column(1).to_pylist()) @ axes / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(z[:, i]) for i in range(k))], names=["id", "raw", "mult", *(f"c{i}" for i in range(k))])

    def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def leaf(i: int, u: np.ndarray, ids: np.ndarray, mult: np.ndarray) -> dict:
            z = u @ axes
            centre = u.mean(axis=0)
            norm = float(np.sqrt((centre * centre).sum()))
            centre = centre / norm if norm > 0 else u[0]
            radius = float(np.arccos(np.clip(u @ centre, -1, 1)).max())
            box = {name: float(v) for names, row in ((_LO, z.min(axis=0)), (_HI, z.max(axis=0))) for name, v in zip(names, [*row, *[0.0] * (AXES - k)], strict=True)}
            return {"leaf": i, "least": int(ids.min()), "weight": int(mult.sum()), "centre": centre.tolist(), "radius": radius, **box}

        def flush(t: pa.Table) -> pa.RecordBatch:
            nonlocal seq
            raw = t.column("raw").to_pylist()
            u, ids, mult = _unit(raw), t.column("id").to_numpy(), t.column("mult").to_numpy()
            cuts = range(0, t.num_rows, BLOCK)
            leaves = [leaf(i, u[x : x + BLOCK], ids[x : x + BLOCK], mult[x : x + BLOCK]) for i, x in enumerate(cuts)]
            row = [part, seq, ids.astype("<i8").tobytes(), mult.astype("<i8").tobytes(), b"".join(raw), leaves]
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.struct(_LEAF))], strict=True)], names=["part", "seq", "ids", "mult", "raw", "leaves"])

        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= SHELF * BLOCK:
                t = pa.Table.from_batches(held)
                yield flush(t.slice(0, SHELF * BLOCK))
                held = t.slice(SHELF * BLOCK).to_batches()
        if any(x.num_rows for x in held):
            yield flush(pa.Table.from_batches(held))

    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(n, -(-classes.count() // (SHELF * BLOCK // 2))))  # a partition fills half a shelf at least
    order = [f"c{i}" for i in range(k)] + ["id"]
    ordered = classes.mapInArrow(grid, f"id bigint, raw binary, mult bigint, {cells}").repartitionByRange(n, *order).sortWithinPartitions(*order)
    box = ", ".join(f"{c}: double" for c in [*_LO, *_HI])
    return ordered.mapInArrow(cut_blocks, f"part int, seq int, ids binary, mult binary, raw binary, leaves array<struct<leaf: int, least: bigint, weight: bigint, centre: array<double>, radius: double, {box}>>")


def _numbered(blocks: DataFrame) -> DataFrame:
    """A row per block (leaf) with its place ``idx`` in the order of the whole sequence."""
    leaves = blocks.select("part", "seq", F.inline("leaves"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = leaves.groupBy("part").agg(F.count(F.lit(1)).alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    return leaves.join(bases, "part").withColumn("idx", F.col("base") + SHELF * F.col("seq") + F.col("leaf")).drop("base")


def _near(eps: float) -> F.Column:
    """Whether the boxes of a and b come within eps."""
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"b.{lo}") - F.col(f"a.{hi}"), F.col(f"a.{lo}") - F.col(f"b.{hi}")), 2) for lo, hi in zip(_LO, _HI, strict=True)), F.lit(0.0))
    return gap <= eps * eps


def _block_pairs(meta: DataFrame, n: int, eps: float) -> DataFrame:
    """Pairs (a, b) of blocks, a <= b, that the recursion over sequence intervals leaves."""
    box = [F.min(c).alias(c) for c in _LO] + [F.max(c).alias(c) for c in _HI]
    levels = [meta.select(F.col("idx").alias("node"), *_LO, *_HI)]
    while n > 1:
        n = -(-n // FAN)
        levels.append(levels[-1].withColumn("node", F.floor(F.col("node") / FAN)).groupBy("node").agg(*box))
    pairs = levels[-1].select(F.col("node").alias("pa"), F.col("node").alias("pb"))
    for level in reversed(levels[:-1]):
        parts = level.withColumn("up", F.floor(F.col("node") / FAN))
        a, b = parts.alias("a"), parts.alias("b")
        met = pairs.join(a, F.col("pa") == F.col("a.up")).join(b, F.col("pb") == F.col("b.up"))
        pairs = met.filter((F.col("a.node") <= F.col("b.node")) & _near(eps)).select(F.col("a.node").alias("pa"), F.col("b.node").alias("pb"))
    return pairs


FOUND = "id bigint, links bigint, peer bigint"


def _compare(threshold: float, lead: np.ndarray):  # noqa: ANN202
    """Rows (same shelf, pairs of its blocks, two shelves' ids, multiplicities, vectors) to FOUND."""

    def forest(hit: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        la, lb, top = ia.copy(), ib.copy(), np.iinfo(np.int64).max
        while True:
            na = np.minimum(la, np.where(hit, lb[None, :], top).min(axis=1))
            nb = np.minimum(lb, np.where(hit, na[:, None], top).min(axis=0))
            if (na == la).all() and (nb == lb).all():
                return la, lb
            la, lb = na, nb

    def led(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the length of the rest, in single precision."""
        z = units @ lead
        return z.astype(np.float32), np.sqrt(np.maximum(0.0, 1.0 - (z * z).sum(axis=1))).astype(np.float32)

    def links(a: np.ndarray, b: np.ndarray, la: tuple[np.ndarray, np.ndarray], lb: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        may = la[0] @ lb[0].T + la[1][:, None] * lb[1][None, :] >= threshold - 1e-5
        if 50 * np.count_nonzero(may) > may.size:
            return a @ b.T >= threshold
        x, y = np.nonzero(may)
        may[x, y] = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
        return may

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                ids_a, mult_a, ids_b, mult_b = (np.frombuffer(b.column(j)[i].as_py(), "<i8") for j in (2, 3, 5, 6))
                units_a, units_b = (_unit_rows(b.column(j)[i].as_py(), n) for j, n in ((4, len(ids_a)), (7, len(ids_b))))
                lead_a, lead_b = led(units_a), led(units_b)
                for pair in b.column(1)[i].as_py():
                    x, y = slice(BLOCK * pair["a"], BLOCK * pair["a"] + BLOCK), slice(BLOCK * pair["b"], BLOCK * pair["b"] + BLOCK)
                    same = b.column(0)[i].as_py() and pair["a"] == pair["b"]
                    hit = links(units_a[x], units_b[y], *((z[at], rest[at]) for (z, rest), at in ((lead_a, x), (lead_b, y))))
                    if same:
                        np.fill_diagonal(hit, False)
                    if not hit.any():
                        continue
                    ia, ib = ids_a[x], ids_b[y]
                    la, lb = forest(hit, ia, ib)
                    rows = hit.any(axis=1)
                    out.append((ia[rows], (hit @ mult_b[y])[rows], la[rows]))
                    if not same:
                        cols = hit.any(axis=0)
                        out.append((ib[cols], (mult_a[x] @ hit)[cols], lb[cols]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["id", "links", "peer"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row; vectors link at a cosine of ``threshold`` or more."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v"))
    good = cut(_valid(rows.filter("id IS NOT NULL")), "vectors")
    sizes = [r["bytes"] for r in good.select(F.length("raw").alias("bytes")).distinct().orderBy("bytes").collect()]
    alone = rows.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not sizes:
        return alone
    parts = [_join(good.filter(F.length("raw") == size), size, threshold) for size in sizes]
    known, edges = (reduce(DataFrame.unionByName, side) for side in zip(*parts, strict=True))
    label = components(edges)
    known = known.join(label, "id", "left").select("raw", "links", "mult", F.coalesce("component", "id").alias("component"))
    linked = good.join(known, "raw").groupBy("id").agg(F.max(F.col("links") + F.col("mult") - 1).alias("links"), F.min("component").alias("component"))
    out = rows.select("id").join(linked, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _join(good: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Classes (id, raw, mult, links) and edges (a, b) of the vectors of one length."""
    spark = good.sparkSession
    classes = cut(good.groupBy("raw").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("mult")).select("id", "raw", "mult"), "classes")
    eps = math.sqrt(2 - 2 * threshold) + 1e-9
    axes = _axes(classes, size // 8)
    blocks = cut(_blocks(classes, axes[:, :AXES], eps), "blocks")
    meta = cut(_numbered(blocks), "meta")
    pairs = _block_pairs(meta, meta.count(), eps)
    ball = meta.select("idx", "part", "seq", "leaf", "centre", "radius", "least", "weight")
    a, b = (ball.select(*[F.col(c).alias(f"{c}_{s}") for c in ball.columns]) for s in "ab")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))))
    limit = math.acos(threshold)
    met = pairs.join(a, F.col("pa") == F.col("idx_a")).join(b, F.col("pb") == F.col("idx_b")).withColumn("angle", angle)
    met = met.filter(F.col("angle") - F.col("radius_a") - F.col("radius_b") <= limit + 1e-6)
    met = met.withColumn("full", F.col("angle") + F.col("radius_a") + F.col("radius_b") < limit - 1e-6)
    met = cut(met.select("pa", "pb", "full", *[f"{c}_{s}" for s in "ab" for c in ("part", "seq", "leaf", "least", "weight")]), "pairs")
    data = blocks.select("part", "seq", "ids", "mult", "raw")
    da, db = (data.select(*[F.col(c).alias(f"{c}_{s}") for c in data.columns]) for s in "ab")
    shelves = ["part_a", "seq_a", "part_b", "seq_b"]  # at most SHELF * SHELF pairs of blocks each
    todo = met.filter(~F.col("full")).groupBy(*shelves).agg(F.collect_list(F.struct(F.col("leaf_a").alias("a"), F.col("leaf_b").alias("b"))).alias("todo"))
    todo = todo.join(da, ["part_a", "seq_a"]).join(db, ["part_b", "seq_b"]).withColumn("same", (F.col("part_a") == F.col("part_b")) & (F.col("seq_a") == F.col("seq_b")))
    wide = todo.select("same", "todo", "ids_a", "mult_a", "raw_a", "ids_b", "mult_b", "raw_b").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = cut(wide.mapInArrow(lean(_compare(threshold, axes[:, :LEAD])), FOUND), "found")
    # fully linked pairs of blocks: each member of one gains the weight of the other
    full = met.filter("full")
    side = lambda s: [F.col(f"{c}_{s}").alias(c) for c in ("part", "seq", "leaf")]
    to = F.least("least_a", "least_b").alias("to")
    gain = full.select(*side("a"), F.col("weight_b").alias("gain"), to, (F.col("pa") == F.col("pb")).alias("own"))
    gain = gain.unionByName(full.filter("pa <> pb").select(*side("b"), F.col("weight_a").alias("gain"), to, F.lit(False).alias("own")))
    gains = gain.groupBy("part", "seq", "leaf").agg(F.sum("gain").alias("gain"), F.min("to").alias("to"), F.bool_or("own").alias("own"))
    gains = gains.groupBy("part", "seq").agg(F.collect_list(F.struct("leaf", "gain", "to", "own")).alias("gains"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(x.num_rows):
                ids, mult = (np.frombuffer(x.column(j)[i].as_py(), "<i8") for j in (0, 1))
                for g in x.column(2)[i].as_py():
                    at = slice(BLOCK * g["leaf"], BLOCK * g["leaf"] + BLOCK)
                    more = g["gain"] - (mult[at] if g["own"] else np.zeros(len(ids[at]), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(more.astype(np.int64)), pa.array(np.full(len(more), g["to"], np.int64))], names=["id", "links", "peer"])

    dense = gains.join(data.select("part", "seq", "ids", "mult"), ["part", "seq"]).select("ids", "mult", "gains").mapInArrow(members, FOUND)
    links = full.select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    every = cut(found.unionByName(dense), "links")
    edges = every.select(F.col("id").alias("a"), F.col("peer").alias("b")).unionByName(links)
    counts = every.groupBy("id").agg(F.sum("links").alias("links"))
    return classes.join(counts, "id", "left").select("id", "raw", "mult", F.coalesce("links", F.lit(0)).alias("links")), edges
