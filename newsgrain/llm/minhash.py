"""MinHash near-dedup with an LSH forest.

Texts are sets of hashed word shingles; two link at a Jaccard similarity of the
threshold or more, confirmed on the full sets.

* Equal sets are one class, found by a count on a 128-bit fingerprint; only one
  row of a class goes on.
* Each of ``TREES`` trees puts classes that share a prefix of its min-hashes, of
  the least depth, into a region, sorted by set size.  Neighbours in a region
  are joined into families unless their sizes alone rule out a link; as the
  sizes rise, no pair across such a gap can link either.  So a family holds all
  pairs of a region that could link, and no pair is listed for that.
* Sets are built where the texts lie, for the ids that a bitmap of fixed size at
  most (``BITMAP_BITS``) does not rule out, so other texts are not shuffled; a join
  then keeps exactly the members.
* Families are sorted by set size and cut into shelves of ``SHELF_SETS`` sets; a
  shelf is compared with itself, and with the later shelves of a family that
  does not end in it, unless sizes rule out any link.  Within a comparison, sets
  too many of whose shingles no other set there has are left out (they can link
  with nothing), which empties families that only share a template.  The rest
  is compared by blocks, as products of incidence matrices over shared shingles,
  and pairs of blocks whose sizes are too far apart are passed over.  A
  comparison returns a spanning forest of the links found.  A link is missed only if no tree puts its ends into
  one region.  The least depth is the largest at which that has a chance below
  1e-5 for a pair right at the threshold: 5 at 0.85 (7.7e-7), 4 at 0.8 (3.2e-6).

Sorted regions are range partitions, so a region of any size is split; the last
row of a partition and the first of the next are joined up on their own.  Joins may be split
for skew.  Every step is written to the shared folder.

Cases: null and empty texts have empty sets and link with nothing; a text of
fewer words than a shingle is one shingle; a row with a null id is returned
with a null component and kept; rows that share an id are one document; ties
take the smallest id; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgrain.llm import kernel
from newsgrain.llm.common import components, cut, forget, lean

TREES, DEPTH = 24, 6
#: Sets and shingles of a shelf at most (one longer set makes a shelf of its own), and sets of a block.
SHELF_SETS, SHELF_SHINGLES, BLOCK_SETS = 4096, 1_000_000, 256
#: Binary logarithm of the most bits of the bitmap of family members; 16 bits a member as long as that suffices.
BITMAP_BITS, MARKERS = 25, 8
_N = TREES * DEPTH
_MULT = kernel.mix(np.arange(1, _N + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def least_depth(percent: int) -> int:
    """The deepest prefix that still finds a pair at the threshold with a chance of 1 - 1e-5."""
    fits = [d for d in range(1, DEPTH + 1) if (1 - (percent / 100) ** d) ** TREES <= 1e-5]
    return max(fits, default=1)


def shingle_sets(w: kernel.Words, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document; ASCII letters are lower-cased."""
    h = w.hashes(lower=True)
    g = kernel.grams(h, k)
    out = []
    for a, z in zip(w.bounds.tolist(), w.bounds[1:].tolist(), strict=False):
        if z - a >= k:
            out.append(np.unique(g[a : z - k + 1]))
        elif z > a:
            out.append(kernel.grams(h[a:z], z - a) ^ np.uint64(z - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The min-hashes of sets that lie one behind the other, a row each, in uint32; no set is empty."""
    out = np.empty((len(starts), _N), np.uint32)
    for i, m in enumerate(_MULT):
        out[:, i] = np.minimum.reduceat(flat * m, starts) >> np.uint64(32)
    return out


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """(doc, n, f1, f2, sig): set size, fingerprint and min-hashes (null for an empty set) of (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = kernel.text_buffers(b.column(1))
            for lo, hi in kernel.chunks(offsets):
                sets = shingle_sets(kernel.words(data, offsets[lo : hi + 1]), k)
                n = np.array([len(s) for s in sets], np.int64)
                filled = np.flatnonzero(n)
                f1, f2, sig = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), [None] * len(n)
                if len(filled):
                    flat, starts = np.concatenate(sets), (np.cumsum(n) - n)[filled]
                    f1[filled] = np.add.reduceat(kernel.mix(flat + np.uint64(1)), starts).view(np.int64)
                    f2[filled] = np.add.reduceat(kernel.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), starts).view(np.int64)
                    for i, row in zip(filled.tolist(), signatures(flat, starts).astype(">u4"), strict=True):
                        sig[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())], names=["doc", "n", "f1", "f2", "sig"])

    return docs.mapInArrow(lean(run), "doc bigint, n bigint, f1 bigint, f2 bigint, sig binary")


def _adjacent(reps: DataFrame, depth: int, percent: int) -> DataFrame:
    """(a, b): neighbours by size in a region of some tree whose sizes leave a link possible, and edge rows (b null) of partitions."""
    width = 4 * DEPTH

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(n * TREES, width)[:, : 4 * depth]
            at = np.arange(n * TREES + 1, dtype=np.int32) * np.int32(4 * depth)
            keys = pa.BinaryArray.from_buffers(pa.binary(), n * TREES, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(sig))])
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), keys, *(pa.array(np.repeat(b.column(i).to_numpy(), TREES)) for i in (1, 0))], names=["tree", "key", "n", "doc"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for b in batches:
            if not b.num_rows:
                continue
            if last is None:
                yield _edge_batch(part=2 * part, row=b.slice(0, 1))
            else:
                b = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
            tree, n, doc = (b.column(i).to_numpy() for i in (0, 2, 3))
            key = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(tree), -1)
            same = (tree[1:] == tree[:-1]) & (key[1:] == key[:-1]).all(axis=1) & (100 * n[:-1] >= percent * n[1:])
            yield _edge_batch(doc[1:][same], doc[:-1][same])
            last = b.slice(b.num_rows - 1)
        if last is not None:
            yield _edge_batch(part=2 * part + 1, row=last)

    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = reps.select("doc", "n", "sig").mapInArrow(explode, "tree int, key binary, n bigint, doc bigint")
    return rows.repartitionByRange(n, "tree", "key", "n", "doc").sortWithinPartitions("tree", "key", "n", "doc").mapInArrow(neighbours, "a bigint, b bigint, place int, tree int, key binary, n bigint")


def _joined(x: tuple, y: tuple, percent: int) -> bool:
    """Whether (tree, key, size, ...) rows x and y, in order, share a region and sizes that may link."""
    return x[0] == y[0] and x[1] == y[1] and 100 * x[2] >= percent * y[2]


def _edge_batch(a: np.ndarray | None = None, b: np.ndarray | None = None, part: int = 0, row: pa.RecordBatch | None = None) -> pa.RecordBatch:
    """Pairs (a, b), or the first or last row of a partition with its place."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
    if row is not None:
        cols = [row.column(3), pa.nulls(1, kinds[1]), pa.array([part], kinds[2]), *row.columns[:3]]
    else:
        cols = [pa.array(a, kinds[0]), pa.array(b, kinds[1]), *(pa.nulls(len(a), k) for k in kinds[2:])]
    return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(cols, kinds, strict=True)], names=["a", "b", "place", "tree", "key", "n"])


def _candidates(reps: DataFrame, depth: int, percent: int) -> DataFrame:
    """(a, b): chains of the regions of all trees."""
    found = cut(_adjacent(reps, depth, percent), "neighbours")
    ends = sorted(found.filter("place IS NOT NULL").collect(), key=lambda r: r["place"])  # 2 rows per partition
    extra = [(y["a"], x["a"]) for x, y in zip(ends, ends[1:], strict=False) if _joined((x["tree"], x["key"], x["n"]), (y["tree"], y["key"], y["n"]), percent)]
    pairs = found.filter("place IS NULL").select("a", "b")
    return pairs.unionByName(reps.sparkSession.createDataFrame(extra, "a bigint, b bigint")) if extra else pairs


SHELVES = "part int, seq int, first bigint, last bigint, rows int, least int, most int, family binary, doc binary, n binary, shingles binary"


def _probes(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two places of each id in a bitmap."""
    h = kernel.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return [(x >> np.uint64(64 - bits)).astype(np.int64) for x in (h, kernel.mix(h ^ np.uint64(0x5851F42D4C957F2D)))]


def _bitmap(members: DataFrame) -> tuple[int, np.ndarray]:
    """(binary logarithm of the bits, bitmap) of the ids in column doc; the driver gets the bitmap alone."""
    bits = min(BITMAP_BITS, max(16, (16 * members.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, bool)
        for b in batches:
            for at in _probes(b.column(0).to_numpy(), bits):
                held[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([np.packbits(held).tobytes()], pa.binary())], names=["slot", "bits"])

    def merge(t: pa.Table) -> pa.Table:
        out = np.zeros(1 << (bits - 3), np.uint8)
        for x in t.column("bits"):
            out |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"bits": pa.array([out.tobytes()], pa.binary())})

    found = members.select("doc").coalesce(MARKERS).mapInArrow(lean(mark), "slot bigint, bits binary").groupBy("slot").applyInArrow(merge, "bits binary").collect()
    return bits, np.frombuffer(found[0]["bits"], np.uint8) if found else np.zeros(1 << (bits - 3), np.uint8)


def _shelves(docs: DataFrame, families: DataFrame, k: int) -> DataFrame:
    """Shelves of the family members' sets, in order of family and set size."""
    shipped = docs.sparkSession.sparkContext.broadcast(_bitmap(families))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held = shipped.value
        for b in batches:
            may = np.ones(b.num_rows, bool)
            for at in _probes(b.column(0).to_numpy(), bits):
                may &= (held[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            b = b.filter(pa.array(may))
            data, offsets = kernel.text_buffers(b.column(1))
            for lo, hi in kernel.chunks(offsets):
                found = shingle_sets(kernel.words(data, offsets[lo : hi + 1]), k)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([len(x) for x in found], pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc", "n", "shingles"])

    def cut_shelves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, total
            family, doc, n, raw = zip(*held, strict=True)
            row = [part, seq, family[0], family[-1], len(held), min(n), max(n), *(np.array(v, "<i8").tobytes() for v in (family, doc, n)), b"".join(raw)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 3, *[pa.binary()] * 4]
            seq, held, total = seq + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)], names=["part", "seq", "first", "last", "rows", "least", "most", "family", "doc", "n", "shingles"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (len(held) == SHELF_SETS or total + row[2] > SHELF_SHINGLES):
                    yield flush()
                held.append(row)
                total += row[2]
        if held:
            yield flush()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.filter("doc IS NOT NULL").mapInArrow(lean(sets), "doc bigint, n int, shingles binary")
    members = found.join(families, "doc").select("family", "doc", "n", "shingles")
    return members.repartitionByRange(n, "family", "n", "doc").sortWithinPartitions("family", "n", "doc").mapInArrow(lean(cut_shelves), SHELVES)


def _shared(owner: np.ndarray, token: np.ndarray, g: int, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sets that may link, owner and token of their shared shingles): a set needs ``percent`` of its shingles in other sets."""
    alive = np.ones(g, bool)
    while len(token):
        often = np.bincount(token) > 1
        keep = often[token]
        owner, token = owner[keep], token[keep]
        bad = alive & (100 * np.bincount(owner, minlength=g) < percent * n)
        if not bad.any():
            break
        alive &= ~bad
        keep = alive[owner]
        owner, token = owner[keep], token[keep]
    return alive if len(token) else np.zeros(g, bool), owner, token


def _forest(doc: np.ndarray, n: np.ndarray, flat: np.ndarray, percent: int, split: int | None = None) -> list[tuple[int, int]]:
    """Edges that join the linked sets, each to the least id it reaches; with ``split`` only sets on different sides need comparing.

    Sets stand in order of size, on each side of the split.
    """
    g = len(doc)
    if g < 2:
        return []
    owner = np.repeat(np.arange(g, dtype=np.int32), n)
    order = np.argsort(flat)
    fresh = flat[order]
    fresh = np.concatenate([[True], fresh[1:] != fresh[:-1]])
    alive, owner, token = _shared(owner[order], (np.cumsum(fresh) - 1).astype(np.int32), g, n, percent)
    if split is not None and not (alive[:split].any() and alive[split:].any()):
        return []
    # the left sets by side, in blocks; each block's shared shingles stay sorted by token
    label = np.arange(g)
    sides = [np.flatnonzero(alive)] if split is None else [np.flatnonzero(alive[:split]), split + np.flatnonzero(alive[split:])]
    cuts = [[side[x : x + BLOCK_SETS] for x in range(0, len(side), BLOCK_SETS)] for side in sides]
    number, place = np.full(g, -1, np.int32), np.zeros(g, np.int32)
    blocks = [b for side in cuts for b in side]
    for i, b in enumerate(blocks):
        number[b], place[b] = i, np.arange(len(b))
    by = np.argsort(number[owner], kind="stable")
    edges = np.searchsorted(number[owner][by], np.arange(len(blocks) + 1))
    held = [(place[owner[by[x:y]]], *np.unique(token[by[x:y]], return_inverse=True)) for x, y in zip(edges, edges[1:], strict=False)]
    first = len(cuts[0])
    for i, a in enumerate(blocks):
        for j in range(i if split is None else max(i, first), len(blocks)):
            b = blocks[j]
            if (split is not None and i >= first) or 100 * min(n[a].max(), n[b].max()) < percent * max(n[a].min(), n[b].min()):
                continue
            roots = np.unique(label[np.concatenate([a, b])])
            if len(roots) == 1:  # all of them are joined already
                continue
            shared = _product(held[i], held[j], len(a), len(b))
            linked = 100 * shared >= percent * (n[a][:, None] + n[b][None, :] - shared)
            if i == j:
                np.fill_diagonal(linked, False)
            if linked.any():
                _join(label, a, b, linked)
    return [(int(doc[x]), int(top)) for x, top in _least(doc, label) if doc[x] != top]


def _product(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], rows: int, cols: int) -> np.ndarray:
    """How many tokens each set of one block shares with each of another; a block: (set, distinct tokens, the token's number) by token."""
    out = np.zeros((rows, cols), np.float32)
    _, *both = np.intersect1d(a[1], b[1], assume_unique=True, return_indices=True)
    n, sides = len(both[0]), []
    for (place, distinct, number), at in zip((a, b), both, strict=True):
        column = np.full(len(distinct), -1)
        column[at] = np.arange(n)
        column = column[number]
        sides.append((place[column >= 0], column[column >= 0]))
    for lo in range(0, n, 4096):
        m = [np.zeros((size, min(4096, n - lo)), np.float32) for size in (rows, cols)]
        for x, (place, column) in zip(m, sides, strict=True):
            f, t = np.searchsorted(column, (lo, lo + 4096))
            x[place[f:t], column[f:t] - lo] = 1
        out += m[0] @ m[1].T
    return out


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> None:
    """Give all sets of what ``linked`` joins the least label among them."""
    la, lb, top = label[a], label[b], len(label)
    while True:
        na = np.minimum(la, np.where(linked, lb[None, :], top).min(axis=1))
        nb = np.minimum(lb, np.where(linked, na[:, None], top).min(axis=0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    to = np.arange(len(label))  # old labels to new ones, until none moves
    np.minimum.at(to, label[a], la)
    np.minimum.at(to, label[b], lb)
    while (to[to] != to).any():
        to = to[to]
    label[:] = to[label]


def _least(doc: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """(place, least id of its class) of every set."""
    order = np.lexsort((doc, label))
    first = np.concatenate([[True], label[order][1:] != label[order][:-1]])
    least = doc[order[first]][np.cumsum(first) - 1]
    return list(zip(order.tolist(), least.tolist(), strict=True))


def _links(shelves: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of all links between members of a family."""

    def one(b: pa.RecordBatch, i: int, at: int) -> tuple[np.ndarray, ...]:
        family, doc, n = (np.frombuffer(b.column(at + j)[i].as_py(), "<i8") for j in range(3))
        flat = np.frombuffer(b.column(at + 3)[i].as_py(), np.uint64)
        return family, doc, n, flat, np.concatenate([[0], np.cumsum(n)])

    def batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[j] for e in edges], pa.int64()) for j in (0, 1)], names=["a", "b"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges: list[tuple[int, int]] = []
            for i in range(b.num_rows):
                family, doc, n, flat, at = one(b, i, 0)
                cuts = np.flatnonzero(np.concatenate([[True], family[1:] != family[:-1], [True]]))
                for x, y in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                    edges += _forest(doc[x:y], n[x:y], flat[at[x] : at[y]], percent)
            yield batch(edges)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges: list[tuple[int, int]] = []
            for i in range(b.num_rows):
                key, sides = b.column(0)[i].as_py(), []
                for at in (1, 5):
                    family, doc, n, flat, edge = one(b, i, at)
                    x, y = np.searchsorted(family, (key, key + 1))
                    sides.append((doc[x:y], n[x:y], flat[edge[x] : edge[y]]))
                doc, n, flat = (np.concatenate(v) for v in zip(*sides, strict=True))
                edges += _forest(doc, n, flat, percent, len(sides[0][0]))
            yield batch(edges)

    payload = ["family", "doc", "n", "shingles"]
    inner = shelves.select(*payload).mapInArrow(lean(within), "a bigint, b bigint")
    # a family that runs on into another shelf is the last of one and the first of the other
    meta = shelves.select("part", "seq", "least", "most", "first", "last")
    ends = meta.select("part", "seq", F.explode(F.array_distinct(F.array("first", "last"))).alias("key"), F.when(F.col("first") == F.col("last"), F.struct("least", "most")).alias("range"))
    a, b = ends.alias("a"), ends.alias("b")
    later = (F.col("a.part") < F.col("b.part")) | ((F.col("a.part") == F.col("b.part")) & (F.col("a.seq") < F.col("b.seq")))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & later)
    # sizes rise along a family: a pair of whole shelves is skipped where the sizes are too far apart
    far = F.col("a.range").isNotNull() & F.col("b.range").isNotNull() & (100 * F.col("a.range.most") < percent * F.col("b.range.least"))
    met = met.filter(~far).select(F.col("a.key").alias("key"), F.col("a.part").alias("pa"), F.col("a.seq").alias("sa"), F.col("b.part").alias("pb"), F.col("b.seq").alias("sb"))
    left = shelves.select(F.col("part").alias("pa"), F.col("seq").alias("sa"), *[F.col(c).alias(f"{c}_a") for c in payload])
    right = shelves.select(F.col("part").alias("pb"), F.col("seq").alias("sb"), *[F.col(c).alias(f"{c}_b") for c in payload])
    both = met.join(left, ["pa", "sa"]).join(right, ["pb", "sb"]).select("key", *[f"{c}_a" for c in payload], *[f"{c}_b" for c in payload])
    return inner.unionByName(both.mapInArrow(lean(across), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row; texts link at ``percent`` of 100 or more."""
    spark, depth = docs.sparkSession, least_depth(percent)
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    sketches = cut(sketch(plain, k), "sketches")
    filled = sketches.filter("n > 0 AND doc IS NOT NULL")
    classes = cut(filled.groupBy("n", "f1", "f2").agg(F.min("doc").alias("rep")), "classes")
    reps = cut(filled.join(classes.select("n", "f1", "f2", F.col("rep").alias("doc")), ["n", "f1", "f2", "doc"], "left_semi").dropDuplicates(["doc"]).select("doc", "n", "sig"), "reps")
    families = cut(components(_candidates(reps, depth, percent)).select(F.col("id").alias("doc"), F.col("component").alias("family")), "families")
    forget(reps)
    shelves = cut(_shelves(plain, families, k), "shelves")
    links = cut(_links(shelves, percent), "links")
    forget(shelves)
    final = components(links).select(F.col("id").alias("rep"), F.col("component").alias("top"))
    whole = classes.join(final, "rep", "left").select("n", "f1", "f2", F.coalesce("top", "rep").alias("top"))
    out = sketches.select("doc", "n", "f1", "f2").join(whole, ["n", "f1", "f2"], "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("top", "doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))
