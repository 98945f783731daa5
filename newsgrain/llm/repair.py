"""Token ids in Re-Pair compressed shards with random-access decoding.

Shard format (one binary value per shard): the magic ``RPS2``; seven
little-endian uint64: documents, symbols, rules, first nonterminal, tokens, bits
of a symbol, bits of a length; then uint64 symbol starts and token starts of the
documents (one more entry each than documents), and three arrays of bit-packed
big-endian numbers, each filled to a byte: the rules as pairs of symbols, the
rules' expansion lengths, and the symbols.

Re-Pair (Larsson and Moffat, 2000) in rounds of falling frequency: a round names
the pairs that occur at least as often as its bar, replaces their occurrences (of
two that overlap the more frequent one), and halves the bar.  Rounds go on until
no pair is left that occurs ``LEAST`` times without overlap: a rule costs two
symbols and a length, so one for a pair that occurs twice never pays.  Counts
are exact.  An occurrence keeps the last count of its pair as an upper bound (a
pair's count only falls), so a round looks only at what its bar may reach.

A pair never spans two documents, so each is decoded alone from its symbols.

Layout: documents are dealt by ranges of the id and sorted, cut into shards of
about ``SHARD_TOKENS`` tokens, and written by Spark's own writer, so a lost
task is simply run again; shard (part, seq) order is id order.

Cases: null and empty texts hold only the end id; null ids come first; repeated
ids stay separate documents, in order of their text's crc32; a document longer
than a shard makes one of its own; an id column that holds no integers is an
error; an empty table writes no shard and reads back as an empty result; other
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgrain.llm.common import lean
from newsgrain.llm.tokens import encoder, gather

MAGIC = b"RPS2"
SHARD_TOKENS = 2_000_000
#: Least occurrences of a pair that gets a name.
LEAST = 3
SHARDS = "part int, seq int, documents bigint, tokens bigint, ids binary, payload binary"
_HEAD = "<4s7Q"
_MULT = np.uint64(0x9E3779B97F4A7C15)
_HALF, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
#: The bound of an occurrence that was never counted.
_NEW = np.int32(2**31 - 1)


def _every_other(joined: np.ndarray) -> np.ndarray:
    """Of runs of joined entries every other one, from the left; joined[i] ties i and i + 1."""
    n = len(joined) + 1
    fresh = np.ones(n, bool)
    fresh[1:] = ~joined
    run = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return (np.arange(n) - run) % 2 == 0


def compress(ids: np.ndarray, bounds: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbol bounds of the documents, rules as pairs); nonterminals count from ``first``."""
    n = len(ids)
    sym, gone = ids.astype(np.uint32), np.zeros(n, bool)
    nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    last = np.zeros(n, bool)
    last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
    bound = np.where(last, np.int32(0), _NEW)
    rules: list[np.ndarray] = []
    made, bar = 0, int(_NEW)
    while True:
        at = np.flatnonzero(bound >= min(bar, int(_NEW) - 1))
        pairs = np.zeros(0, np.uint64)
        if len(at):
            key = (sym[at].astype(np.uint64) << _HALF) | sym[nxt[at]]
            bits = min(20, max(8, (4 * len(at)).bit_length()))
            slot = ((key * _MULT) >> np.uint64(64 - bits)).astype(np.int64)
            joint = np.ones(len(at), bool)  # of a a a only every other pair can be replaced
            twin = np.flatnonzero((key >> _HALF) == (key & _LOW))
            if len(twin):
                joint[twin[~_every_other((twin[1:] == twin[:-1] + 1) & (at[twin[1:]] == nxt[at[twin[:-1]]]))]] = False
            sums = np.bincount(slot if joint.all() else slot[joint], minlength=1 << bits).astype(np.int32)  # no less than any pair's count
            upper = sums[slot]
            bound[at] = upper
            bar = max(LEAST, min(bar, int(sums.max())) // 2)
            c = np.flatnonzero(joint & (upper >= bar))
            order = np.argsort(key[c])
            seen = key[c[order]]
            edge = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1], [True]])) if len(seen) else np.zeros(1, np.int64)
            count = np.diff(edge)
            of = np.empty(len(c), np.int32)
            of[order] = np.repeat(np.arange(len(count), dtype=np.int32), count)
            bound[at[c]] = count[of]  # exact, so that a pair too rare is not counted again
            often = count >= bar
            pairs, chosen = seen[edge[:-1]][often], often[of]
            p, where = at[c[chosen]], (np.cumsum(often) - 1)[of[chosen]]
            count = count[often]
        if not len(pairs):
            if bar == LEAST:
                break
            bar = max(LEAST, bar // 2)
            continue
        rank = np.empty(len(pairs), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(pairs))
        r = rank[where]
        near = p[1:] == nxt[p[:-1]]
        beaten = np.zeros(len(p), bool)
        beaten[1:] |= near & (r[:-1] < r[1:])
        beaten[:-1] |= near & (r[1:] < r[:-1])
        p, where = p[~beaten], where[~beaten]
        used = np.bincount(where, minlength=len(pairs)) >= max(LEAST, bar // 2)  # the most frequent pair is never beaten
        keep = used[where]
        p, name = p[keep], (np.cumsum(used) - 1)[where[keep]]
        second = nxt[p]
        after = nxt[second]
        sym[p] = (first + made + name).astype(np.uint32)
        gone[second], bound[second] = True, 0
        last[p], nxt[p] = last[second], after
        inner = after < n
        prv[after[inner]] = p[inner]
        bound[p] = np.where(last[p], np.int32(0), _NEW)
        before = prv[p]
        before = before[before >= 0]
        bound[before[~last[before]]] = _NEW
        pairs = pairs[used]
        rules.append(np.stack([pairs >> _HALF, pairs & _LOW], axis=1).astype(np.uint32))
        made += len(pairs)
    left = np.concatenate([[0], np.cumsum(~gone)])
    return sym[~gone].astype(np.uint32), left[bounds], np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansions(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat ids, starts, lengths) of what each rule stands for."""
    sides, n = rules.astype(np.int64), len(rules)
    lengths, steps = np.zeros(n, np.int64), []
    inner = np.where(sides >= first, sides - first, -1)
    waits = np.arange(n)
    while len(waits):  # rules whose sides are known, again and again
        known = (inner[waits] < 0) | (lengths[inner[waits]] > 0)
        now = waits[known.all(axis=1)]
        lengths[now] = np.where(inner[now] < 0, 1, lengths[inner[now]]).sum(axis=1)
        steps.append(now)
        waits = waits[~known.all(axis=1)]
    starts = np.cumsum(lengths) - lengths
    flat = np.zeros(int(lengths.sum()), np.uint32)
    for now in steps:
        to = starts[now]
        for side in (0, 1):
            at, x = inner[now, side], sides[now, side]
            flat[to[at < 0]] = x[at < 0]
            size = lengths[at[at >= 0]]
            flat[gather(np.arange(len(flat)), to[at >= 0], size)] = gather(flat, starts[at[at >= 0]], size)
            to = to + np.where(at < 0, 1, lengths[at])
    return flat, starts, lengths


def _bits(values: np.ndarray, width: int) -> bytes:
    """Big-endian numbers of ``width`` bits, filled to a byte."""
    block = 1 << 17
    parts = []
    for lo in range(0, len(values), block):
        raw = values[lo : lo + block].astype(">u4").view(np.uint8).reshape(-1, 4)
        parts.append(np.packbits(np.unpackbits(raw, axis=1)[:, 32 - width :]).tobytes())
    return b"".join(parts)


def _unbits(raw: np.ndarray, lo: int, hi: int, width: int) -> np.ndarray:
    """Numbers lo..hi of a bit-packed array."""
    out, block = [np.zeros(0, np.uint32)], 1 << 17
    for x in range(lo, hi, block):
        y = min(hi, x + block)
        some = np.unpackbits(raw[x * width // 8 : -(-y * width // 8)])
        wide = np.zeros((y - x, 32), np.uint8)
        wide[:, 32 - width :] = some[x * width % 8 :][: (y - x) * width].reshape(y - x, width)
        out.append(np.packbits(wide, axis=1).view(">u4")[:, 0].astype(np.uint32))
    return np.concatenate(out)


def pack(ids: np.ndarray, bounds: np.ndarray, first: int) -> bytes:
    symbols, at, rules = compress(ids, bounds, first)
    lengths = expansions(rules, first)[2]
    width = max(1, (first + len(rules) - 1).bit_length())
    wide = max(1, int(lengths.max()).bit_length()) if len(rules) else 1
    head = struct.pack(_HEAD, MAGIC, len(bounds) - 1, len(symbols), len(rules), first, len(ids), width, wide)
    return b"".join([head, at.astype("<u8").tobytes(), bounds.astype("<u8").tobytes(), _bits(rules.reshape(-1), width), _bits(lengths, wide), _bits(symbols, width)])


class Shard:
    """A shard's documents, decoded one at a time or all at once."""

    def __init__(self, payload: bytes):
        magic, docs, self.n, rules, self.first, self.tokens, self.width, wide = struct.unpack_from(_HEAD, payload)
        if magic != MAGIC:
            raise ValueError("not a Re-Pair shard")
        at = struct.calcsize(_HEAD)

        def read(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out

        self.symbol_bounds = read("<u8", docs + 1).astype(np.int64)
        self.bounds = read("<u8", docs + 1).astype(np.int64)
        self.rules = _unbits(read("u1", -(-2 * rules * self.width // 8)), 0, 2 * rules, self.width).reshape(-1, 2)
        self.lengths = _unbits(read("u1", -(-rules * wide // 8)), 0, rules, wide)
        self._symbols = read("u1", -(-self.n * self.width // 8))
        self._flat, self._starts, _ = expansions(self.rules, self.first)

    def _expand(self, lo: int, hi: int) -> np.ndarray:
        s = _unbits(self._symbols, lo, hi, self.width).astype(np.int64)
        named = s >= self.first
        flat = np.concatenate([self._flat, s[~named].astype(np.uint32)])
        starts, lengths = np.zeros(len(s), np.int64), np.ones(len(s), np.int64)
        starts[named], lengths[named] = self._starts[s[named] - self.first], self.lengths[s[named] - self.first]
        starts[~named] = len(self._flat) + np.arange(int((~named).sum()))
        return gather(flat, starts, lengths)

    def document(self, i: int) -> np.ndarray:
        """The ids of document i alone."""
        return self._expand(int(self.symbol_bounds[i]), int(self.symbol_bounds[i + 1]))

    def all(self) -> np.ndarray:
        return self._expand(0, self.n)


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", first: int | None = None) -> None:
    """Encode all texts, each followed by ``end_id``, into shards in ``folder`` in ascending id order."""
    if first is None:
        first = encoder(vocabulary).tokenizer.get_vocab_size(with_added_tokens=True)
    if not isinstance(docs.select(id_col).schema[0].dataType, T.IntegralType):
        raise TypeError(f"{id_col} holds no integers")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    check = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))  # rows without an id, or of one id, fill several ranges too
    source = source.repartitionByRange(n, "id", check).sortWithinPartitions(F.col("id").asc_nulls_first(), check)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(vocabulary), TaskContext.get().partitionId(), 0
        names: list = []
        held: list[np.ndarray] = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, names, held, sizes
            ids = np.concatenate(held)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            id_bytes = np.array([-1 if x is None else x for x in names], "<i8").tobytes() + np.array([x is None for x in names]).tobytes()
            row = [[part], [seq], [len(names)], [len(ids)], [id_bytes], [pack(ids, bounds, first)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            seq, names, held, sizes = seq + 1, [], [], []
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "seq", "documents", "tokens", "ids", "payload"])

        waiting = 0
        for b in batches:
            keys = b.column(0).to_pylist()
            for lo, ids, bounds in enc.encode(b.column(1)):
                m = len(bounds) - 1
                out = np.full(len(ids) + m, end_id, np.int32)
                out[np.arange(len(ids)) + np.repeat(np.arange(m), np.diff(bounds))] = ids
                held.append(out)
                sizes += (np.diff(bounds) + 1).tolist()
                names += keys[lo : lo + m]
                waiting += len(out)
                if waiting >= SHARD_TOKENS:
                    yield flush()
                    waiting = 0
        if names:
            yield flush()

    source.mapInArrow(lean(encode), SHARDS).write.parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    shards = spark.read.schema(SHARDS).parquet(folder)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard(b.column(3)[i].as_py())
                raw, docs = b.column(2)[i].as_py(), len(shard.bounds) - 1
                ids, gone = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, bool, docs, 8 * docs)
                every = shard.all().astype("<u4")
                view, at = memoryview(every).cast("B"), (shard.bounds * 4).tolist()
                crc = [zlib.crc32(view[x:y]) for x, y in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0)[i].as_py(), docs), pa.int32()), pa.array(np.repeat(b.column(1)[i].as_py(), docs), pa.int32()), pa.array(ids, pa.int64(), mask=gone), pa.array(shard.bounds[:-1]), pa.array(np.diff(shard.bounds)), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"])

    found = shards.select("part", "seq", "ids", "payload").mapInArrow(lean(decode), "part int, seq int, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = shards.select("part", "seq", "tokens")
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("total"))  # one row per written partition
    before = parts.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    places = sizes.select("part", "seq", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("into")).join(before, "part")
    return found.join(places, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("into") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
