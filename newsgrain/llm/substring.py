"""Substring dedup: suffix automata of reference passages, documents streamed for matching statistics.

A window is ``WINDOW`` consecutive words of one document; a word goes if a
window that covers it has an earlier occurrence (smaller id, or the same
document at an earlier start).

Broadcasting automata of all reference text to all documents would cost the
square of the corpus, so an automaton is sent only where it can match:

1. Every window has anchors, its least word 6-grams by hash, which depend on
   the window's words alone.  Anchors that occur twice are found by a count;
   the first place of each is its owner.
2. The passages around a document's owned anchors are its reference shards, one
   per ``PIECE`` words, so an automaton's size has a bound.  Passages around
   other places of an anchor are streamed, with the owner's shard as target.
3. A join brings each stream together with its shard; the task builds the
   shard's suffix automaton once and runs the stream through it.  A word at
   which the matching statistic reaches ``WINDOW`` ends a repeated window.
   A shard with very many streams is split by adaptive skew handling, each
   part with its own copy of the automaton; so is a frequent anchor, as the
   owners are a table of their own when places are joined with them.
4. Windows that share an anchor but not all words with its owner are left; the
   same is done for them, with the first place of the whole window as owner.

Anchors and hashes only choose what is compared; the automata decide, on
64-bit word hashes.  No step has all rows of a key in one task: counts are
combined before the shuffle, and joins can be split.

Cases: null and empty texts have no words and lose none; a row with a null id
is returned unchanged and compared with nothing; rows that share an id count as
one document (no row loses words to another of its own place); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgrain.llm import kernel
from newsgrain.llm.common import cut, forget, lean

WINDOW = 20
ANCHOR = 6
#: Words of a document whose anchors share a reference shard.
PIECE = 8192
#: Symbols of the automata that a worker keeps, and bytes of words of a batch.
KEPT_SYMBOLS, HELD_BYTES = 60_000, 8 << 20
_I64 = np.int64


class Automaton:
    """Suffix automaton of a list of symbols, with the first end of every state."""

    def __init__(self, symbols: list[int]):
        nxt: list[dict[int, int]] = [{}]
        link, size, first = [-1], [0], [-1]
        last = 0
        for i, c in enumerate(symbols):
            cur = len(nxt)
            nxt.append({})
            size.append(size[last] + 1)
            first.append(i)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if size[p] + 1 == size[q]:
                    link[cur] = q
                else:
                    twin = len(nxt)
                    nxt.append(nxt[q].copy())
                    size.append(size[p] + 1)
                    first.append(first[q])
                    link.append(link[q])
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        self.nxt, self.link, self.size, self.first = nxt, link, size, first

    def first_ends(self, symbols: list[int], window: int) -> list[int]:
        """For each symbol: the first end in the reference of the window that ends there, or -1 if it is not in it."""
        nxt, link, size, first = self.nxt, self.link, self.size, self.first
        state = held = 0
        out = []
        for c in symbols:
            while state and c not in nxt[state]:
                state = link[state]
                held = size[state]
            to = nxt[state].get(c)
            if to is None:
                state = held = 0
                out.append(-1)
                continue
            state, held = to, held + 1
            if held >= window:
                while size[link[state]] >= window:
                    state = link[state]
                    held = size[state]
                out.append(first[state])
            else:
                out.append(-1)
        return out


def anchors_of(g: np.ndarray, bounds: np.ndarray, window: int = WINDOW, k: int = ANCHOR) -> np.ndarray:
    """Positions whose k-gram is the least of some window of its document (ties all count)."""
    span = window - k + 1
    n = len(g)
    if n < span:
        return np.zeros(0, _I64)
    low = _slide(g, span, np.minimum)
    starts = kernel.inside(bounds, window, len(low))
    low = np.where(starts, low, np.uint64(0))
    padded = np.concatenate([np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)])
    best = _slide(padded, span, np.maximum)[:n]
    return np.flatnonzero((best == g) & (best != 0))


def _slide(x: np.ndarray, span: int, op: np.ufunc) -> np.ndarray:
    """op over every run of ``span`` entries, by doubling."""
    have, y = 1, x
    while 2 * have <= span:
        y = op(y[:-have], y[have:])
        have *= 2
    return op(y[: len(x) - span + 1], y[span - have : span - have + len(x) - span + 1]) if have < span else y


def _anchors(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, offsets = kernel.text_buffers(b.column(1))
            for lo, hi in kernel.chunks(offsets):
                w = kernel.words(data, offsets[lo : hi + 1])
                g = kernel.grams(w.hashes(), ANCHOR)
                at = anchors_of(g, w.bounds)
                doc = np.searchsorted(w.bounds, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(g[at].view(_I64)), pa.array(ids[lo + doc]), pa.array((at - w.bounds[doc]).astype(np.int32))], names=["h", "doc", "pos"])

    return docs.filter("doc IS NOT NULL").mapInArrow(lean(run), "h bigint, doc bigint, pos int")


def _runs(lo: np.ndarray, hi: np.ndarray, *keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Maximal unions (from, to, first row) of ranges lo..hi (sorted by lo) that touch and share the keys."""
    if not len(lo):
        return
    change = lo[1:] > hi[:-1]
    for key in keys:
        change |= key[1:] != key[:-1]
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(lo)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(lo[a]), int(hi[a:b].max()), a


def _shard(run: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The key of a reference shard beside its document: run (-1 for the whole document) and piece."""
    return ((run + 1) << _I64(32)) | pos // PIECE


SPANS = "kind int, key_doc bigint, key_run bigint, doc bigint, starts array<int>, sizes array<int>, words binary"


class _Spans:
    """Collects rows of SPANS."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, kind: int, key_doc: int, key_run: int, doc: int, parts: list[tuple[int, int]], h: np.ndarray, base: int) -> None:
        """kind 0: a reference, 1: a stream; parts: word ranges of the document whose words h start at ``base``."""
        words = np.concatenate([h[a - base : b - base] for a, b in parts])
        self.bytes += words.nbytes
        self.rows.append((kind, key_doc, key_run, doc, [a for a, _ in parts], [b - a for a, b in parts], words.tobytes()))

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
        cols = zip(*self.rows, strict=True) if self.rows else [[]] * 7
        out = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "key_doc", "key_run", "doc", "starts", "sizes", "words"])
        self.rows, self.bytes = [], 0
        return out


def _split_hits(spans: _Spans, doc: int, run: int, pos: np.ndarray, own_doc: np.ndarray, own_pos: np.ndarray, own_run: np.ndarray, lo: np.ndarray, hi: np.ndarray, h: np.ndarray, base: int) -> None:
    """Rows for the places of one document (or run): owned ones as reference, others as streams."""
    same = (own_doc == doc) & (own_pos == pos)
    owned = same & (own_run == run)  # runs may overlap: a place that another of them owns is no stream either
    shard = _shard(own_run, own_pos)
    mine: dict[int, list[tuple[int, int]]] = {}
    for a, b, i in _runs(lo[owned], hi[owned], shard[owned]):
        mine.setdefault(int(shard[owned][i]), []).append((a, b))
    for key, parts in mine.items():
        spans.add(0, doc, key, doc, parts, h, base)
    od, key = own_doc[~same], shard[~same]
    for a, b, i in _runs(lo[~same], hi[~same], od, key):
        spans.add(1, int(od[i]), int(key[i]), doc, [(a, b)], h, base)


def _spans_of_documents(docs: DataFrame, hits: DataFrame) -> DataFrame:
    per = hits.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "own_doc", "own_pos"))).alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = _Spans()
        for b in batches:
            ids = b.column(0).to_pylist()
            data, offsets = kernel.text_buffers(b.column(1))
            lists, edges = b.column(2).flatten(), b.column(2).offsets.to_numpy()
            edges = edges - edges[0]
            pos, od, op = (lists.field(i).to_numpy().astype(_I64) for i in range(3))
            for lo, hi in kernel.chunks(offsets):
                w = kernel.words(data, offsets[lo : hi + 1])
                h = w.hashes().view(_I64)
                for i in range(hi - lo):
                    a, z = edges[lo + i], edges[lo + i + 1]
                    n, base = int(w.counts[i]), int(w.bounds[i])
                    p = pos[a:z]
                    first = np.clip(p - (WINDOW - ANCHOR), 0, max(n - WINDOW, 0))
                    last = np.clip(p + WINDOW, 0, n)
                    ok = last - first >= WINDOW
                    _split_hits(spans, ids[lo + i], -1, p[ok], od[a:z][ok], op[a:z][ok], np.full(int(ok.sum()), -1, _I64), first[ok], last[ok], h[base : base + n], 0)
                    if spans.bytes > HELD_BYTES:
                        yield spans.batch()
        yield spans.batch()

    return docs.join(per, "doc").select("doc", "text", "hits").mapInArrow(lean(run), SPANS)


FOUND = "kind int, doc bigint, lo int, hi int, words binary"


def _match(spans: DataFrame) -> DataFrame:
    """Streams through the automata of their references: removed word ranges (kind 0) and runs of unmatched windows (kind 1)."""
    refs = spans.filter("kind = 0").select("key_doc", "key_run", F.col("starts").alias("ref_starts"), F.col("sizes").alias("ref_sizes"), F.col("words").alias("ref_words"))
    streams = spans.filter("kind = 1").select("key_doc", "key_run", "doc", F.col("starts")[0].alias("start"), "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[tuple[int, int], tuple[Automaton, list[int]]] = OrderedDict()
        held = 0
        for b in batches:
            rows: list[tuple] = []
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            docs, starts = b.column(2).to_pylist(), b.column(3).to_pylist()
            for i, key in enumerate(keys):
                if key not in kept:
                    symbols, places = [], []
                    words = np.frombuffer(b.column(7)[i].as_py(), _I64).tolist()
                    at = 0
                    for s, n in zip(b.column(5)[i].as_py(), b.column(6)[i].as_py(), strict=True):
                        symbols += [*words[at : at + n], ("end", s)]
                        places += [*range(s, s + n), -1]
                        at += n
                    kept[key] = Automaton(symbols), places
                    held += len(symbols)
                    while held > KEPT_SYMBOLS and len(kept) > 1:
                        held -= len(kept.popitem(last=False)[1][1])
                automaton, places = kept[key]
                kept.move_to_end(key)
                raw = b.column(4)[i].as_py()
                h = np.frombuffer(raw, _I64)
                ends = np.array(automaton.first_ends(h.tolist(), WINDOW)[WINDOW - 1 :], _I64)
                hit = ends >= 0
                if key[0] == docs[i]:  # in its own document only an earlier start counts
                    first = np.array(places, _I64)[np.maximum(ends, 0)] - WINDOW + 1
                    hit &= first < starts[i] + np.arange(len(ends))
                change = np.flatnonzero(np.diff(hit.astype(np.int8))) + 1
                edges = [0, *change.tolist(), len(hit)]
                for x, y in zip(edges, edges[1:], strict=False):
                    if y > x:
                        span = (starts[i] + x, starts[i] + y - 1 + WINDOW)
                        rows.append((0, docs[i], *span, b"") if hit[x] else (1, docs[i], *span, raw[8 * x : 8 * (y - 1 + WINDOW)]))
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "doc", "lo", "hi", "words"])

    return streams.join(refs, ["key_doc", "key_run"]).mapInArrow(lean(run), FOUND)


def _windows(runs: DataFrame) -> DataFrame:
    """(g, doc, pos, run) of every window of the unmatched runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            doc, lo, words = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
            h = np.frombuffer(memoryview(words.buffers()[2])[int(at[0]) : int(at[-1])].tobytes(), np.uint64)
            bounds = (at - at[0]).astype(_I64) // 8
            for x, y in kernel.chunks(bounds, 1 << 18):
                own = bounds[x : y + 1] - bounds[x]
                g = kernel.grams(h[bounds[x] : bounds[y]], WINDOW)
                place = np.flatnonzero(kernel.inside(own, WINDOW, len(g)))
                row = np.searchsorted(own, place, "right") - 1
                start = lo[x:y][row]
                yield pa.RecordBatch.from_arrays([pa.array(g[place].view(_I64)), pa.array(doc[x:y][row]), pa.array((start + place - own[row]).astype(np.int32)), pa.array(start.astype(np.int32))], names=["g", "doc", "pos", "run"])

    return runs.select("doc", "lo", "words").mapInArrow(lean(run), "g bigint, doc bigint, pos int, run int")


def _spans_of_runs(runs: DataFrame, hits: DataFrame) -> DataFrame:
    per = hits.groupBy("doc", "run").agg(F.sort_array(F.collect_list(F.struct("pos", "own_doc", "own_pos", "own_run"))).alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = _Spans()
        for b in batches:
            docs, lo = b.column(0).to_pylist(), b.column(1).to_pylist()
            lists, edges = b.column(3).flatten(), b.column(3).offsets.to_numpy()
            edges = edges - edges[0]
            pos, od, op, orun = (lists.field(i).to_numpy().astype(_I64) for i in range(4))
            for i in range(b.num_rows):
                a, z = edges[i], edges[i + 1]
                h = np.frombuffer(b.column(2)[i].as_py(), _I64)
                _split_hits(spans, docs[i], lo[i], pos[a:z], od[a:z], op[a:z], orun[a:z], pos[a:z], pos[a:z] + WINDOW, h, lo[i])
                if spans.bytes > HELD_BYTES:
                    yield spans.batch()
        yield spans.batch()

    # runs of one start may end apart (streams to different owners); the longest holds the windows of all
    longest = runs.groupBy("doc", F.col("lo").alias("run")).agg(F.max_by("words", "hi").alias("words"))
    joined = longest.join(per, ["doc", "run"])
    return joined.select("doc", "run", "words", "hits").mapInArrow(lean(run), SPANS)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc, lo, hi): word ranges of documents (doc, text) that earlier windows repeat."""
    places = cut(_anchors(docs), "places")
    owners = cut(places.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "pos")).alias("own")).filter("n > 1"), "owners")
    hits = cut(places.join(owners, "h").select("doc", "pos", F.col("own.doc").alias("own_doc"), F.col("own.pos").alias("own_pos")), "hits")
    forget(places)
    forget(owners)
    spans = cut(_spans_of_documents(docs, hits), "spans")
    forget(hits)
    found = cut(_match(spans), "found")
    forget(spans)
    runs = found.filter("kind = 1").select("doc", "lo", "words", "hi")
    windows = _windows(runs)
    first = cut(windows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "pos", "run")).alias("own")).filter("n > 1"), "owners")
    again = windows.join(first, "g").select("doc", "pos", "run", F.col("own.doc").alias("own_doc"), F.col("own.pos").alias("own_pos"), F.col("own.run").alias("own_run"))
    again = cut(again.distinct(), "again")
    forget(first)
    rest = cut(_match(_spans_of_runs(runs, again)), "rest")
    forget(again)
    return found.filter("kind = 0").unionByName(rest.filter("kind = 0")).select("doc", "lo", "hi")


def _strip(docs: DataFrame, fields: str, keep: list[str], respace: bool) -> DataFrame:
    """Remove the ranges ``gone`` from each text; the text is column 0, the ranges column 1, the kept columns follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = kernel.text_buffers(b.column(0))
            gone, there = b.column(1).to_pylist(), b.column(0).is_valid().to_pylist()
            kept_text: list[str | None] = []
            total, removed = [], []
            for lo, hi in kernel.chunks(offsets):
                w = kernel.words(data, offsets[lo : hi + 1])
                raw = w.data.tobytes()
                for i in range(hi - lo):
                    a, z = int(w.bounds[i]), int(w.bounds[i + 1])
                    dead = np.zeros(z - a + 1, np.int32)
                    for r in gone[lo + i] or ():
                        dead[min(r["lo"], z - a)] += 1
                        dead[min(r["hi"], z - a)] -= 1
                    stay = np.flatnonzero(np.cumsum(dead[:-1]) == 0) + a
                    total.append(z - a)
                    removed.append(z - a - len(stay))
                    if not respace and len(stay) == z - a:
                        kept_text.append(raw[w.offsets[i] : w.offsets[i + 1]].decode() if there[lo + i] else None)
                        continue
                    s, e = w.starts[stay].tolist(), w.ends[stay].tolist()
                    kept_text.append(b" ".join([raw[x:y] for x, y in zip(s, e, strict=True)]).decode())
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept_text, pa.string())], names=[*keep, "n_words", "n_removed", "kept_text"])

    return docs.mapInArrow(lean(run), f"{fields}n_words bigint, n_removed bigint, kept_text string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), respace: bool = True) -> DataFrame:
    """(id, any columns to keep, n_words, n_removed, kept_text): kept words joined by one space; without ``respace`` a text that loses none stays as it is."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    ranges = repeated_ranges(plain)
    per = ranges.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("_gone")).withColumnRenamed("doc", "_doc")
    names = [id_col, *keep]
    source = docs.select(F.col(text_col).alias("_text"), *names)
    joined = source.join(per, F.col(id_col).cast("bigint") == F.col("_doc"), "left").select("_text", "_gone", *names)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema[1:])
    return _strip(joined, fields, names, respace)
