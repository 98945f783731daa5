"""Page structure: tag paths, sketches, distances, clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgrain.operators.ranges import quantiles, written

N_HASHES = 100


@F.pandas_udf(T.ArrayType(T.StringType()))
def tag_paths(html: pd.Series) -> pd.Series:
    """The set of root-to-node tag paths and ``tag/[@attr=value]`` leaves of class, property and itemprop (K1), sorted."""
    from newsgrain.functions.dom import parse, paths

    return html.map(lambda x: sorted(paths(parse(x))) if x else [])


@F.pandas_udf(T.ArrayType(T.LongType()))
def sketch(paths: pd.Series) -> pd.Series:
    """MinHash of a set of paths (K2): the k-th value is the least xxh32 of a path followed by k dots."""
    import xxhash

    def one(p: np.ndarray | None) -> list[int] | None:
        if p is None or not len(p):
            return None
        states = [xxhash.xxh32(x.encode()) for x in p]
        out = []
        for _ in range(N_HASHES):
            out.append(min(s.intdigest() for s in states))
            for s in states:
                s.update(b".")
        return out

    return paths.map(one)


def md5_sketch(items: Column, n: int) -> Column:
    """MinHash by md5 with a number appended: the same in any SQL engine; null for an empty set."""
    return F.when(F.size(items) > 0, F.array(*[F.array_min(F.transform(items, lambda x: F.md5(F.concat(x, F.lit(f":{k}"))))) for k in range(n)]))  # noqa: B023


def hamming(a: Column, b: Column) -> Column:
    """Share of positions in which two sketches differ (K6)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def weighted_sketches(df: DataFrame, domain: str, sketch_col: str, most: int = 20_000) -> DataFrame:
    """Distinct sketches of a domain with their number, the heaviest ones (K5)."""
    per = df.dropna(subset=[sketch_col]).groupBy(domain, sketch_col).agg(F.count(F.lit(1)).alias("weight"))
    w = Window.partitionBy(domain).orderBy(F.desc("weight"), F.xxhash64(sketch_col))
    return per.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r").withColumn("node", F.concat_ws("/", domain, F.md5(F.to_json(sketch_col))))


#: Nodes of a block when a domain's pairs are compared block by block.
BLOCK = 512


def close_pairs(nodes: DataFrame, domain: str, node: str, sketch_col: str, eps: float) -> DataFrame:
    """Pairs of a domain at distance at most eps (E12), each once.

    Exact either way.  Cut the m positions into floor(eps * m) + 1 bands: two
    sketches that differ in at most floor(eps * m) positions agree in some band as
    a whole, so only rows that share a band meet, in the first that they share.
    Where bands are too short to tell rows apart (a count says that they would make
    more than a quarter of all pairs meet), rows are dealt to cells around pivots,
    and only what the triangle inequality cannot part is compared; where a count
    says that this leaves more than half of all pairs, blocks of rows are compared,
    each pair once.
    """
    m = F.size(sketch_col)
    bands = F.floor(m * eps + 1e-9).cast("int") + 1
    keyed = nodes.select(domain, F.col(node).alias("node"), F.col(sketch_col).alias("s"), bands.alias("k"), m.alias("m"))
    band = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.xxhash64(i, F.slice("s", F.floor(i * F.col("m") / F.col("k")).cast("int") + 1, (F.floor((i + 1) * F.col("m") / F.col("k")) - F.floor(i * F.col("m") / F.col("k"))).cast("int"))))
    keyed = keyed.withColumn("bands", band)
    sizes = keyed.groupBy(domain).agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c").cast("double") * F.col("c")))
    meet = keyed.select(domain, F.posexplode("bands").alias("i", "key")).groupBy(domain, "i", "key").agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c").cast("double") * F.col("c")))
    every, banded = sizes.first()[0] or 0.0, meet.first()[0] or 0.0
    if banded > every / 4:
        blocks = _dealt(nodes.select(F.col(domain), F.col(node).alias("node"), F.col(sketch_col).alias("s")), domain)
        cells = Cells(blocks, domain, eps)
        return cells.pairs() if 2 * cells.compared() <= every / 2 else _by_blocks(blocks, domain, eps)
    rows = keyed.select(domain, "node", "s", "bands", F.posexplode("bands").alias("i", "key"))
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col(f"a.{domain}") == F.col(f"b.{domain}")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.node") < F.col("b.node")))
    first = F.array_position(F.zip_with("a.bands", "b.bands", lambda x, y: x == y), F.lit(True)) == F.col("a.i") + 1
    near = met.filter(first).withColumn("distance", hamming(F.col("a.s"), F.col("b.s"))).filter(F.col("distance") <= eps + 1e-9)
    return near.select(F.col(f"a.{domain}").alias(domain), F.col("a.node").alias("a"), F.col("b.node").alias("b"), "distance")


def _dealt(rows: DataFrame, domain: str) -> DataFrame:
    """(domain, block, rows): about BLOCK rows a block, however large the domain."""
    sizes = rows.groupBy(F.col(domain).alias("_d")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
    dealt = rows.filter("s IS NOT NULL").join(sizes, F.col(domain) == F.col("_d")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")))
    return written(dealt.groupBy(domain, "block").agg(F.collect_list(F.struct("node", "s")).alias("rows")))


def _matrix(rows: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and sketches of a block."""
    held = rows.values
    sketches = held.field("s")
    return held.field("node").to_numpy(zero_copy_only=False), sketches.flatten().to_numpy(zero_copy_only=False).reshape(len(sketches), -1)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions in which each row of a differs from each of b."""
    out = np.empty((len(a), len(b)), np.int32)
    step = max(1, (1 << 22) // max(1, b.size))
    for lo in range(0, len(a), step):
        out[lo : lo + step] = (a[lo : lo + step, None, :] != b[None, :, :]).sum(axis=2)
    return out


def _compared(met: DataFrame, domain: str, eps: float) -> DataFrame:
    """Close pairs of rows (domain, same, rows of one block, rows of another); of a block with itself each pair once."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for i in range(t.num_rows):
                (na, sa), (nb, sb) = _matrix(t.column(2)[i]), _matrix(t.column(3)[i])
                apart, m = _apart(sa, sb), sa.shape[1]
                x, y = np.nonzero(apart <= m * (eps + 1e-9))
                if t.column(1)[i].as_py():
                    x, y = x[x < y], y[x < y]
                left, right = na[x], nb[y]
                low, high, kind = np.minimum(left, right), np.maximum(left, right), t.schema[2].type.value_type.field("node").type
                yield pa.RecordBatch.from_arrays([pa.array([t.column(0)[i].as_py()] * len(x), t.schema[0].type), pa.array(low.tolist(), kind), pa.array(high.tolist(), kind), pa.array(apart[x, y] / m, pa.float64())], names=["d", "a", "b", "distance"])

    kinds = {f.name: f.dataType for f in met.schema}
    node = kinds["rows_a"].elementType["node"].dataType.simpleString()
    found = met.mapInArrow(compare, f"d {kinds[domain].simpleString()}, a {node}, b {node}, distance double")
    return found.withColumnRenamed("d", domain)


def _by_blocks(blocks: DataFrame, domain: str, eps: float) -> DataFrame:
    """All pairs of a domain, a pair of blocks a row."""
    a, b = (blocks.select(domain, F.col("block").alias(f"block_{x}"), F.col("rows").alias(f"rows_{x}")) for x in "ab")
    met = a.join(b, domain).filter("block_a <= block_b").select(domain, (F.col("block_a") == F.col("block_b")).alias("same"), "rows_a", "rows_b")
    return _compared(met, domain, eps)


#: Pivots of a domain, and rows among which they are looked for.
PIVOTS, PIVOT_SAMPLE = 64, 512


class Cells:
    """Rows of a domain in cells around pivots, for pairs at distance at most eps.

    A row is at home with its nearest pivot.  Of two close rows at home with p and
    q < p, the first is at most 2 eps farther from q than from p; so it visits the
    cells of smaller number for which that holds, and meets the other there.  In a
    cell, rows whose distances from its pivot differ by more than eps cannot be
    close, so only neighbouring rings of that distance are compared.  Pivots are
    taken far apart, from a sample by hash; any choice gives the same pairs.
    """

    def __init__(self, blocks: DataFrame, domain: str, eps: float):
        self.domain, self.eps = domain, eps
        rows = blocks.select(F.col(domain).alias("_d"), F.inline("rows"))
        first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_d").orderBy(F.xxhash64("node"), "node"))).filter(F.col("_r") <= PIVOT_SAMPLE)
        sample = first.groupBy("_d").agg(F.array_sort(F.collect_list(F.struct("_r", "node", "s"))).alias("sample"))
        self.met = blocks.join(written(sample.mapInArrow(self._pivots(), f"_d {rows.schema['_d'].dataType.simpleString()}, pivots binary")), F.col(domain) == F.col("_d"))
        self.kinds = {f.name: f.dataType for f in blocks.schema}

    @staticmethod
    def _pivots() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                out = []
                for held in t.column(1):
                    _, s = _matrix(held)
                    taken, near = [0], _apart(s, s[:1])[:, 0]
                    while len(taken) < min(PIVOTS, len(s)) and near.max() > 0:  # the row farthest from all taken
                        taken.append(int(near.argmax()))
                        near = np.minimum(near, _apart(s, s[taken[-1:]])[:, 0])
                    out.append(s[taken].astype(np.int64).tobytes())
                yield pa.RecordBatch.from_arrays([t.column(0), pa.array(out, pa.binary())], names=["_d", "pivots"])

        return run

    def _assigned(self) -> Callable[[pa.RecordBatch, int], tuple]:
        eps = self.eps

        def one(t: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
            """(nodes, sketches, row, cell, whether at home, ring) of a block's rows in their cells."""
            nodes, s = _matrix(t.column(1)[i])
            m = s.shape[1]
            far = _apart(s.astype(np.int64), np.frombuffer(t.column(2)[i].as_py(), np.int64).reshape(-1, m))
            most = int(m * (eps + 1e-9))
            home = far.argmin(axis=1)
            near = far.min(axis=1)
            visit = (far <= near[:, None] + 2 * most) & (np.arange(far.shape[1]) < home[:, None])
            row, cell = np.nonzero(visit)
            row, cell, at = np.concatenate([np.arange(len(s)), row]), np.concatenate([home, cell]), np.arange(len(s) + len(row)) < len(s)
            return nodes, s, row, cell, at, far[row, cell] // max(1, most)

        return one

    def _source(self) -> DataFrame:
        return self.met.select(self.domain, "rows", "pivots")

    def counts(self) -> DataFrame:
        """(domain, cell, ring, homes, visits)."""
        one = self._assigned()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                for i in range(t.num_rows):
                    _, _, _, cell, at, ring = one(t, i)
                    keys, back = np.unique(np.stack([cell, ring]), axis=1, return_inverse=True)
                    homes = np.bincount(back.ravel(), at, keys.shape[1]).astype(np.int64)
                    every = np.bincount(back.ravel(), minlength=keys.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array([t.column(0)[i].as_py()] * keys.shape[1], t.schema[0].type), pa.array(keys[0].astype(np.int32)), pa.array(keys[1].astype(np.int32)), pa.array(homes), pa.array(every - homes)], names=["d", "cell", "ring", "homes", "visits"])

        found = self._source().mapInArrow(run, f"d {self.kinds[self.domain].simpleString()}, cell int, ring int, homes bigint, visits bigint")
        return found.groupBy("d", "cell", "ring").agg(F.sum("homes").alias("homes"), F.sum("visits").alias("visits"))

    def compared(self) -> float:
        """Pairs of rows that cells compare."""
        c = written(self.counts())
        side = c.select("d", "cell", F.explode(F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1)).alias("ring"), F.col("ring").alias("_ring"), F.col("homes").alias("_h"), F.col("visits").alias("_v"))
        met = c.join(side, ["d", "cell", "ring"])
        found = met.agg(F.sum(F.col("homes") * (F.col("_h") * 0.5 + F.col("_v")))).first()[0]
        return found or 0.0

    def pairs(self) -> DataFrame:
        """The close pairs, each once."""
        one, domain = self._assigned(), self.domain
        row = self.kinds["rows"].elementType

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                for i in range(t.num_rows):
                    _, _, which, cell, at, ring = one(t, i)
                    held = t.column(1)[i].values.take(pa.array(which))
                    yield pa.RecordBatch.from_arrays([pa.array([t.column(0)[i].as_py()] * len(which), t.schema[0].type), pa.array(cell.astype(np.int32)), pa.array(at), pa.array(ring.astype(np.int32)), held], names=["d", "cell", "home", "ring", "row"])

        placed = written(self._source().mapInArrow(run, f"d {self.kinds[domain].simpleString()}, cell int, home boolean, ring int, row {row.simpleString()}"))
        keys = ["d", "cell", "home", "ring"]
        sizes = placed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_parts"))
        parts = placed.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("row.node"), F.col("_parts")))
        blocks = written(parts.groupBy(*keys, "part").agg(F.collect_list("row").alias("rows")))
        a = blocks.filter("home").select("d", "cell", F.col("ring").alias("ring_a"), F.col("part").alias("part_a"), F.col("rows").alias("rows_a"))
        b = blocks.select("d", "cell", "home", F.col("ring").alias("ring_b"), F.col("part").alias("part_b"), F.col("rows").alias("rows_b"))
        later = (F.col("ring_b") > F.col("ring_a")) | ((F.col("ring_b") == F.col("ring_a")) & (F.col("part_b") >= F.col("part_a")))
        same = F.col("home") & (F.col("ring_a") == F.col("ring_b")) & (F.col("part_a") == F.col("part_b"))
        met = a.join(b, ["d", "cell"]).filter((F.abs(F.col("ring_a") - F.col("ring_b")) <= 1) & (~F.col("home") | later))
        return _compared(met.select(F.col("d").alias(domain), same.alias("same"), "rows_a", "rows_b"), domain, self.eps)


def compared_share(nodes: DataFrame, domain: str, node: str, sketch_col: str, eps: float) -> float:
    """The share of all pairs of rows of a domain that cells leave to be compared."""
    blocks = _dealt(nodes.select(F.col(domain), F.col(node).alias("node"), F.col(sketch_col).alias("s")), domain)
    n = F.size("rows").cast("double")
    every = blocks.groupBy(domain).agg(F.sum(n).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    return Cells(blocks, domain, eps).compared() / every if every else 0.0


#: Rows of a block whose pairs are only counted, and of a tile of it.
WIDE_BLOCK, TILE = 2048, 256


def _codes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two blocks position by position, in as few bytes as tell their values apart."""
    both = np.concatenate([a, b])
    if both.size and both.min() >= 0 and both.max() < 256:
        coded = both.astype(np.uint8).T
    else:
        coded = np.stack([np.unique(x, return_inverse=True)[1].ravel() for x in both.T])
        coded = coded.astype(np.uint8 if coded.max(initial=0) < 256 else np.uint16)
    if coded.max(initial=0) < 2 and np.little_endian:  # two values: words of bits
        bits = np.packbits(coded.T, axis=1)
        wide = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
        wide[:, : bits.shape[1]] = bits
        coded = np.ascontiguousarray(wide.view(np.uint64).T)
    return np.ascontiguousarray(coded[:, : len(a)]), np.ascontiguousarray(coded[:, len(a) :])


def _near_tiles(a: np.ndarray, b: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, whether close) of each tile of rows of a against all of b: which differ in at most so many positions."""
    m = a.shape[1]
    x, y = _codes(a, b)
    kind = np.uint8 if m < 256 else np.uint32
    for lo in range(0, len(a), TILE):
        part = x[:, lo : lo + TILE]
        apart = np.zeros((part.shape[1], len(b)), kind)
        for k in range(len(x)):
            if x.dtype == np.uint64:
                apart += np.bitwise_count(part[k][:, None] ^ y[k][None, :])
            else:
                apart += part[k][:, None] != y[k][None, :]
        yield lo, apart <= most


class Near:
    """What is asked of the rows within eps of a row of the same domain, without a row for each pair.

    Rows are dealt to blocks; a task compares two blocks and gives a figure a row, or a
    spanning forest, instead of their close pairs.  So what is written grows with
    rows times blocks, while close pairs grow with the square of a template's rows.
    ``extra`` columns go with the rows.
    """

    def __init__(self, nodes: DataFrame, domain: str, node: str, sketch_col: str, eps: float, extra: str | None = None):
        self.eps, self.domain = eps, domain
        rows = nodes.select(F.col(domain).alias("d"), F.col(node).alias("node"), F.col(sketch_col).alias("s"), (F.lit(1) if extra is None else F.col(extra)).alias("w")).filter("s IS NOT NULL AND d IS NOT NULL")
        sizes = rows.groupBy(F.col("d").alias("_d")).agg(F.ceil(F.count(F.lit(1)) / WIDE_BLOCK).alias("_blocks"))
        dealt = rows.join(sizes, F.col("d") == F.col("_d")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")))
        self.node = rows.schema["node"].dataType.simpleString()
        self.blocks = written(dealt.groupBy("d", "block").agg(F.collect_list(F.struct("node", "s", "w")).alias("rows")))

    def _met(self, labels: DataFrame | None = None) -> DataFrame:
        """(same, rows of a, rows of b) of each pair of blocks, dealt to all tasks."""
        blocks = self.blocks
        if labels is not None:
            rows = blocks.select("d", "block", F.inline("rows")).drop("w").join(labels, "node", "left")
            blocks = written(rows.groupBy("d", "block").agg(F.collect_list(F.struct("node", "s", "w")).alias("rows")))
        pairs = blocks.select("d", F.col("block").alias("x")).join(blocks.select("d", F.col("block").alias("y")), "d").filter("x <= y")
        parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        a = blocks.select("d", F.col("block").alias("x"), F.col("rows").alias("rows_a"))
        b = blocks.select("d", F.col("block").alias("y"), F.col("rows").alias("rows_b"))
        met = pairs.join(a, ["d", "x"]).join(b, ["d", "y"])
        return met.repartition(parts, "d", "x", "y").select((F.col("x") == F.col("y")).alias("same"), "rows_a", "rows_b")

    def _found(self, met: DataFrame, figure: Callable, kind: str) -> DataFrame:
        """(node, v, or a and b): what ``figure`` makes of the tiles of each pair of blocks."""
        eps = self.eps
        names = [x.split()[0] for x in kind.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                for i in range(t.num_rows):
                    (na, sa), (nb, sb) = _matrix(t.column(1)[i]), _matrix(t.column(2)[i])
                    wa, wb = (c[i].values.field("w") for c in (t.column(1), t.column(2)))
                    most = int(sa.shape[1] * (eps + 1e-9))
                    for left, right in figure(t.column(0)[i].as_py(), (na, wa), (nb, wb), lambda sa=sa, sb=sb, most=most: _near_tiles(sa, sb, most)):
                        yield pa.RecordBatch.from_arrays([pa.array(left.tolist()).cast(kinds[0]), pa.array(right.tolist()).cast(kinds[1])], names=names)

        kinds = [{"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in kind.split(", ")]
        return met.mapInArrow(run, kind)

    def weights(self) -> DataFrame:
        """(node, v): the sum of ``extra`` (or the number) of the other rows within eps; rows without any may be missing."""

        def figure(same: bool, a: tuple, b: tuple, tiles: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            (na, wa), (nb, wb) = ((n, w.to_numpy(zero_copy_only=False).astype(np.int64)) for n, w in (a, b))
            left, right = np.zeros(len(na), np.int64), np.zeros(len(nb), np.int64)
            plain = bool((wa == 1).all() and (wb == 1).all())
            for lo, close in tiles():
                own = slice(lo, lo + len(close))
                left[own] = close.sum(axis=1) if plain else close.astype(np.float64) @ wb
                if not same:
                    right += close.sum(axis=0) if plain else (wa[own] @ close.astype(np.float64)).astype(np.int64)
            if same:
                left -= wa  # itself
                yield na, left
            else:
                yield np.concatenate([na, nb]), np.concatenate([left, right])

        return self._found(self._met(), figure, f"node {self.node}, v bigint").groupBy("node").agg(F.sum("v").alias("v"))

    def links(self, kept: DataFrame) -> DataFrame:
        """(a, b): links within eps among the nodes of ``kept`` that connect what all such links connect; of two blocks fewer than their rows."""

        def figure(same: bool, a: tuple, b: tuple, tiles: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            ka, kb = (w.is_valid().to_numpy(zero_copy_only=False) for _, w in (a, b))
            every = []
            close = np.concatenate([c for _, c in tiles()]) & ka[:, None] & kb[None, :]
            left, right = close.any(axis=1), close.any(axis=0)  # not yet reached
            while left.any():  # breadth first, from a row of a over both sides
                front = np.array([int(left.argmax())])
                left[front] = False
                while len(front):
                    new = np.flatnonzero(close[front].any(axis=0) & right)
                    every.append((front[close[np.ix_(front, new)].argmax(axis=0)], new))
                    right[new] = False
                    front = np.flatnonzero(close[:, new].any(axis=1) & left)
                    every.append((front, new[close[np.ix_(front, new)].argmax(axis=1)] if len(front) else front))
                    left[front] = False
            if every:
                x, y = (np.concatenate([e[i] for e in every]) for i in (0, 1))
                na, nb = a[0][x], b[0][y]
                if (na != nb).any():
                    yield na[na != nb], nb[na != nb]

        mark = kept.select("node", F.lit(1).alias("w"))
        return self._found(self._met(mark), figure, f"a {self.node}, b {self.node}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def least(self, labels: DataFrame) -> DataFrame:
        """(node, v): the least label of (node, w) that a row within eps has, itself included."""

        def figure(same: bool, a: tuple, b: tuple, tiles: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            la, lb = a[1].to_pylist(), b[1].to_pylist()
            names = np.array(sorted({x for x in (*la, *lb) if x is not None}), dtype=object)
            none, place = len(names), {x: i for i, x in enumerate(names)}
            ra, rb = (np.array([none if x is None else place[x] for x in v]) for v in (la, lb))
            left, right = np.full(len(ra), none), np.full(len(rb), none)
            for lo, close in tiles():
                own = slice(lo, lo + len(close))
                left[own] = np.where(close, rb[None, :], none).min(axis=1, initial=none)
                right = np.minimum(right, np.where(close, ra[own][:, None], none).min(axis=0, initial=none))
            for nodes, best in ((a[0], left), (b[0], right)):
                has = best < none
                if has.any():
                    yield nodes[has], names[best[has]]

        kind = labels.schema["w"].dataType.simpleString()
        return self._found(self._met(labels), figure, f"node {self.node}, v {kind}").groupBy("node").agg(F.min("v").alias("v"))


def close_counts(nodes: DataFrame, domain: str, node: str, sketch_col: str, eps: float) -> DataFrame:
    """(domain, node, close): how many other rows of its domain a row is within eps of; equal sketches are compared once."""
    rows = nodes.select(F.col(domain).alias("d"), F.col(node).alias("node"), F.col(sketch_col).alias("s"))
    groups = rows.filter("d IS NOT NULL AND s IS NOT NULL").groupBy("d", "s").agg(F.count(F.lit(1)).alias("w"))
    groups = written(groups.withColumn("id", F.monotonically_increasing_id()))
    found = Near(groups, "d", "id", "s", eps, "w").weights()
    sums = groups.join(found.withColumnRenamed("node", "id"), "id", "left").select("d", "s", (F.col("w") - 1 + F.coalesce("v", F.lit(0))).alias("close"))
    return rows.join(sums, ["d", "s"], "left").select(F.col("d").alias(domain), F.col("node").alias(node), F.coalesce("close", F.lit(0)).alias("close"))


def dbscan(nodes: DataFrame, pairs: DataFrame, node: str = "node", weight: str = "weight", min_samples: float = 20) -> DataFrame:
    """(node, cluster, core): weighted DBSCAN on the pairs within eps (K7).

    Core: own weight and neighbours' weights reach min_samples.  Clusters are the
    components of core pairs, named by their least node; a border node joins the
    least cluster next to it; noise has a null cluster.
    """
    from newsgrain.operators.urls import equivalence

    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    w = nodes.select(F.col(node).alias("x"), F.col(weight).alias("w"))
    around = both.join(w.select(F.col("x").alias("y"), F.col("w").alias("v")), "y").groupBy("x").agg(F.sum("v").alias("v"))
    core = written(w.join(around, "x", "left").select("x", (F.col("w") + F.coalesce("v", F.lit(0)) >= min_samples).alias("core")))
    cores = core.filter("core").select("x")
    inner = both.join(cores, "x").join(cores.select(F.col("x").alias("y")), "y").filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    named = equivalence(inner)
    label = cores.join(named.select(F.col("node").alias("x"), F.col("group").alias("g")), "x", "left").select("x", F.coalesce("g", "x").alias("cluster"))
    border = both.join(label.select(F.col("x").alias("y"), "cluster"), "y").groupBy("x").agg(F.min("cluster").alias("near"))
    out = core.join(label, "x", "left").join(border, "x", "left")
    return out.select(F.col("x").alias(node), F.coalesce("cluster", "near").alias("cluster"), "core")


def dbscan_near(nodes: DataFrame, domain: str, sketch_col: str, eps: float, node: str = "node", weight: str = "weight", min_samples: float = 20) -> DataFrame:
    """(node, cluster, core): ``dbscan`` on the rows of a domain within eps of each other, without their pairs (K7)."""
    from newsgrain.operators.urls import equivalence

    near = Near(nodes, domain, node, sketch_col, eps, weight)
    w = nodes.select(F.col(node).alias("node"), F.col(weight).alias("w"))
    core = written(w.join(near.weights(), "node", "left").select("node", (F.col("w") + F.coalesce("v", F.lit(0)) >= min_samples).alias("core")))
    cores = core.filter("core").select("node")
    named = equivalence(written(near.links(cores))).withColumnRenamed("group", "g")
    label = written(cores.join(named, "node", "left").select("node", F.coalesce("g", "node").alias("cluster")))
    border = near.least(label.withColumnRenamed("cluster", "w"))
    out = core.join(label, "node", "left").join(border, "node", "left")
    return out.select(F.col("node").alias(node), F.coalesce("cluster", "v").alias("cluster"), "core")


def relabelled(labels: DataFrame, domain: str, cluster: str, weight: str) -> DataFrame:
    """Clusters numbered per domain by falling weight from 1; noise stays null."""
    per = labels.dropna(subset=[cluster]).groupBy(domain, cluster).agg(F.sum(weight).alias("cluster_weight"))
    return per.withColumn("structure_group", F.row_number().over(Window.partitionBy(domain).orderBy(F.desc("cluster_weight"), cluster)))


def cluster_quality(labels: DataFrame, domain: str, cluster: str, weight: str) -> DataFrame:
    """Clusters, share of weight inside them, and the entropy of the weights with noise as a class."""
    per = labels.groupBy(domain, cluster).agg(F.sum(weight).alias("w"))
    share = F.col("w") / F.sum("w").over(Window.partitionBy(domain))
    parts = per.withColumn("p", share)
    return parts.groupBy(domain).agg(F.count(cluster).alias("clusters"), (100 * F.sum(F.when(F.col(cluster).isNotNull(), F.col("p")).otherwise(0.0))).alias("inliers"), (-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


def silhouette(nodes: DataFrame, domain: str, node: str, cluster: str, sketch_col: str, weight: str | None = None) -> DataFrame:
    """(domain, silhouette): the mean silhouette of clustered sketches under Hamming distance, without any pairs.

    The distance of a sketch to a whole cluster is a sum over positions of how
    many members hold another value there, so counts of (cluster, position,
    value) give every mean distance exactly, in one join and time linear in the
    number of sketches.  With ``weight`` a sketch stands for so many equal ones.
    Noise (a null cluster) takes no part; a cluster of one counts 0; a domain with
    fewer than two clusters has minus infinity.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    rows = nodes.select(F.col(domain).alias("d"), F.col(node).alias("x"), F.col(cluster).alias("own"), w.cast("long").alias("w"), F.col(sketch_col).alias("s")).filter("own IS NOT NULL AND s IS NOT NULL")
    sizes = rows.groupBy("d", F.col("own").alias("c")).agg(F.sum("w").alias("size"))
    places = rows.select("d", "x", "own", "w", F.size("s").alias("m"), F.posexplode("s").alias("k", "v"))
    counts = places.groupBy("d", "k", "v", F.col("own").alias("c")).agg(F.sum("w").alias("n"))
    equal = places.join(counts, ["d", "k", "v"]).groupBy("d", "x", "own", "w", "m", "c").agg(F.sum("n").alias("equal"))
    apart = (F.col("m") * F.col("size") - F.col("equal")) / F.col("m")
    near = equal.join(sizes, ["d", "c"]).groupBy("d", "x", "own", "w").agg(
        F.max(F.when(F.col("c") == F.col("own"), F.col("size"))).alias("size"),
        F.max(F.when(F.col("c") == F.col("own"), apart)).alias("inside"),
        F.min(F.when(F.col("c") != F.col("own"), apart / F.col("size"))).alias("other"),
    )
    mean = F.when(F.col("size") > 1, F.col("inside") / (F.col("size") - 1))
    other = F.coalesce("other", F.lit(1.0))  # no value in common with any other cluster
    widest = F.greatest(mean, other)
    each = F.when(F.col("size") <= 1, 0.0).when(widest == 0, 0.0).otherwise((other - mean) / widest)
    several = sizes.groupBy("d").agg(F.count(F.lit(1)).alias("clusters"))
    per = near.groupBy("d").agg((F.sum(each * F.col("w")) / F.sum("w")).alias("silhouette"))
    every = nodes.select(F.col(domain).alias("d")).distinct().join(several, "d", "left").join(per, "d", "left")
    return every.select(F.col("d").alias(domain), F.when(F.col("clusters") >= 2, F.col("silhouette")).otherwise(F.lit(float("-inf"))).alias("silhouette"))


def cluster_summary(nodes: DataFrame, domain: str, node: str, cluster: str, sketch_col: str, weight: str, core: str) -> DataFrame:
    """Per domain the figures that go with its clusters (B11): number, cores, share of weight inside, entropy, silhouette."""
    figures = cluster_quality(nodes, domain, cluster, weight)
    cores = nodes.groupBy(domain).agg(F.count_if(F.col(core)).alias("cores"), F.count(F.lit(1)).alias("sketches"), F.sum(weight).alias("weight"))
    shape = silhouette(nodes, domain, node, cluster, sketch_col)
    return figures.join(cores, domain).join(shape, domain)


def write_clusters(nodes: DataFrame, summary: DataFrame, domain: str, folder: str) -> None:
    """A dump of clusters (B11): ``sketches`` with weights, labels and cores and ``summary``, both by domain."""
    nodes.write.partitionBy(domain).parquet(f"{folder}/sketches")
    summary.write.json(f"{folder}/summary")


def distance_summary(pairs: DataFrame, domain: str) -> DataFrame:
    """Least, median, greatest and mean distance (K8)."""
    d = F.col("distance")
    middle = quantiles(pairs, [domain], d, [0.5]).select(F.col(domain).alias("_d"), F.col("_q0").alias("median"))
    per = pairs.groupBy(domain).agg(F.min(d).alias("least"), F.max(d).alias("greatest"), F.avg(d).alias("mean"))
    return per.join(middle, F.col(domain).eqNullSafe(F.col("_d"))).select(domain, "least", "median", "greatest", "mean")


def group_counts(df: DataFrame, signature: str, group: str, least: int = 5, top: int = 5) -> DataFrame:
    """Per signature its most frequent structure groups as text, by falling count."""
    per = df.dropna(subset=[group]).groupBy(signature, group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    ranked = per.withColumn("_r", F.row_number().over(Window.partitionBy(signature).orderBy(F.desc("n"), group))).filter(F.col("_r") <= top)
    listed = F.array_sort(F.collect_list(F.struct("_r", F.col(group).cast("string").alias("g"))))
    return ranked.groupBy(signature).agg(F.array_join(F.transform(listed, lambda x: x["g"]), ",").alias("structure_groups"))


def sign_bits(vector: Column) -> Column:
    """The signs of a vector as 0 and 1, a sketch of its direction."""
    return F.transform(vector, lambda x: (x > 0).cast("int"))

