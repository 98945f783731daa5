"""N-best segmentation of whole texts over a SentencePiece vocabulary, and decoding.

A text, behind one space, is the path of highest total piece score through the
lattice of all pieces that match.  A character that no piece holds is spelt in
byte pieces at the score of ``UNKNOWN`` under the least.  For a unigram model
this is the library's own segmentation.  A BPE model's scores are merge ranks:
the sum of ranks is then a rule of its own, and its best path need not be the
library's merge order.

No piece of the vocabulary crosses from a word into white space, or from a
letter to a mark that ``Vocabulary.marks`` names (checked on loading), so the
lattice of a text is a chain of lattices, one per chunk ``spaces + word``:

* Chunks are found and hashed in numpy on the text buffer.  Forward Viterbi
  scores of all new chunks of a group are computed at once, an array step per
  position and piece length.  With the backward scores they also give, for each
  chunk, by how much its second-best path falls short.
* A text's N best paths can only differ from the best in the N - 1 chunks that
  lose least.  Only those are searched: A-star from the end of the chunk
  backward, with the forward scores as exact heuristic, so that paths come out
  in order of score.  A position is expanded N times at most, which is exact.
* The N best of the text are merged from the chunks' paths through a heap.

Ties: of equal paths in a chunk, the best is the one with the smaller last piece
id (then the one before, and so on), and the others follow in depth-first order;
of equal combinations, the one that changes earlier-ranked chunks less.

Chunks once solved are kept in a bounded table per Python worker.

Cases: null and empty texts have no pieces, one path of score 0; the sign U+2581
in a text counts as a space, as in the vocabulary; null ids and repeated rows are
carried along; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from newsgrain.llm import kernel
from newsgrain.llm.common import lean
from newsgrain.llm.tokens import gather, letters

N_BEST = 5
CACHE_CHUNKS = 900_000
UNKNOWN = 10.0
#: Longer chunks are solved one by one.
LONG = 64
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_INNER = re.compile("[^ ] |.\n|\n.", re.S)
_MARK = re.compile(f"[{_LATIN}]([!-/:-@[-`{{-~0-9])")
_SPACE = "▁"
_GRAM = np.uint64(0xD1342543DE82EF95 | 1)


class Vocabulary:
    """Pieces, scores and bytes of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int64)
        spelt, crossed = [b""] * n, set()
        self.pieces: dict[str, int] = {}
        self.score = np.zeros(n)
        for i in range(n):
            piece = sp.id_to_piece(i)
            self.score[i] = sp.get_score(i)
            if sp.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value], spelt[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = piece.replace(_SPACE, " ")
                if _INNER.search(text):
                    raise ValueError("a piece crosses a chunk border")
                crossed.update(_MARK.findall(text))
                self.pieces[text] = i
                spelt[i] = text.encode()
        scores = self.score[list(self.pieces.values())]
        self.unknown = float(scores[scores > -1e8].min()) - UNKNOWN
        self.longest = max(map(len, self.pieces))
        sizes = np.array([len(b) for b in spelt], np.int64)
        self.spelt, self.spelt_at, self.spelt_size = np.frombuffer(b"".join(spelt), np.uint8), np.cumsum(sizes) - sizes, sizes
        #: ASCII marks and digits that no piece holds behind a letter.
        self.marks = np.zeros(256, bool)
        self.marks[[c for c in range(33, 127) if not chr(c).isalpha() and chr(c) not in crossed]] = True
        self.table = kernel.Table(20)
        length = np.array([len(p) for p in self.pieces], np.uint64)
        self.table.add(np.array([self._hash(p) for p in self.pieces], np.uint64), length)
        self.table_ids = np.array([*self.pieces.values(), -1], np.int32)  # an entry of -1 finds the last
        self.table_score = np.append(self.score[self.table_ids[:-1]], -np.inf)

    @staticmethod
    def _code_hash(code: np.ndarray) -> np.ndarray:
        return kernel.mix(code.astype(np.uint64) + np.uint64(1))

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for x in Vocabulary._code_hash(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)).tolist():
            h = (h * int(_GRAM) + x) & (2**64 - 1)
        return int(kernel.mix(np.array([h], np.uint64))[0])

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, without the leading space."""
        raw = gather(self.spelt, self.spelt_at[ids], self.spelt_size[ids]).tobytes()
        return raw.decode("utf-8", "replace")[1:] if len(raw) else ""

    def lattice(self, text: str) -> list[list[tuple[int, float, int]]]:
        """Arcs by end position: (start, score, id); id -1 spells an unknown character."""
        ends: list[list[tuple[int, float, int]]] = [[] for _ in range(len(text) + 1)]
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + self.longest) + 1):
                p = self.pieces.get(text[i:j])
                if p is not None:
                    ends[j].append((i, float(self.score[p]), p))
            if text[i] not in self.pieces:
                ends[i + 1].append((i, self.unknown, -1))
        return ends

    def spell(self, text: str, path: tuple[tuple[int, int], ...]) -> list[int]:
        """Ids of a path of (start, id) with unknown characters in bytes."""
        out: list[int] = []
        for start, p in path:
            out += [p] if p >= 0 else self.byte_ids[list(text[start].encode("utf-8", "surrogatepass"))].tolist()
        return out

    def nbest(self, text: str, n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
        """The n best paths of one chunk: (score, path of (start, id)), by backward A-star."""
        ends = self.lattice(text)
        forward = [0.0] + [-np.inf] * len(text)
        for j in range(1, len(text) + 1):
            ends[j].sort(key=lambda arc: -arc[2])
            forward[j] = max((forward[i] + s for i, s, _ in ends[j]), default=-np.inf)
        arcs: list[tuple[int, int, int]] = []  # (start, id, the arc behind it)
        heap: list[tuple[float, int, int, float, int]] = [(-forward[-1], 0, len(text), 0.0, -1)]
        seen, out, turn = [0] * (len(text) + 1), [], 0
        while heap and len(out) < n:
            _, _, at, done, tail = heapq.heappop(heap)
            if at == 0:
                path = []
                while tail >= 0:
                    path.append(arcs[tail][:2])
                    tail = arcs[tail][2]
                out.append((done, tuple(path)))
                continue
            seen[at] += 1
            if seen[at] > n:  # n better ways lead from here already
                continue
            for i, s, p in ends[at]:  # the smallest id last, so that it is the first of equals
                turn -= 1
                arcs.append((i, p, tail))
                heapq.heappush(heap, (-(done + s + forward[i]), turn, i, done + s, len(arcs) - 1))
        return out

    def solve_long(self, text: str) -> tuple[list[int], float, float]:
        """(best ids, best score, shortfall of the second-best path) of one chunk."""
        ends = self.lattice(text)
        forward, arc = [0.0] + [-np.inf] * len(text), [(0, 0.0, 0)] * (len(text) + 1)
        for j in range(1, len(text) + 1):
            for i, s, p in ends[j]:
                if forward[i] + s > forward[j] or (forward[i] + s == forward[j] and p < arc[j][2]):
                    forward[j], arc[j] = forward[i] + s, (i, s, p)
        backward, path, j = [-np.inf] * len(text) + [0.0], [], len(text)
        while j:
            path.append((arc[j][0], arc[j][2]))
            j = arc[j][0]
        taken, short = set(path), np.inf
        for j in range(len(text), 0, -1):
            for i, s, p in ends[j]:
                backward[i] = max(backward[i], s + backward[j])
                if (i, p) not in taken:
                    short = min(short, forward[-1] - (forward[i] + s + backward[j]))
        return self.spell(text, tuple(path[::-1])), forward[-1], short

    def solve(self, chunks: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(best ids, best score, shortfall of the second-best path) of each chunk of at most ``LONG`` characters, all at once.

        Chunks stand side by side, the longest first, so the chunks that have a
        character at some position are the first ``rows`` of that position.
        """
        sizes = np.array([len(c) for c in chunks], np.int64)
        order = np.argsort(-sizes, kind="stable")
        width = int(sizes[order[0]])
        start = (np.cumsum(sizes) - sizes)[order]
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        hashed = self._code_hash(code)
        rows = np.searchsorted(-sizes[order], -np.arange(width), "left")
        value = [hashed[start[:m] + j] for j, m in enumerate(rows)]
        ended = [slice(int(rows[j + 1]) if j + 1 < width else 0, int(rows[j])) for j in range(width)]  # chunks whose last character is j
        none = len(self.table_ids) - 1
        forward = [np.full(m, -np.inf) for m in rows]
        best_id, best_len = [np.zeros(m, np.int32) for m in rows], [np.zeros(m, np.int8) for m in rows]
        arcs: list[list[np.ndarray]] = []
        for i in range(width):
            before = forward[i - 1] if i else np.zeros(rows[0])
            h, found = np.zeros(rows[i], np.uint64), []
            for n in range(1, min(self.longest, width - i) + 1):
                e = i + n - 1
                m = rows[e]
                h = h[:m] * _GRAM + value[e]
                entry = self.table.find(kernel.mix(h), np.full(m, n, np.uint64))
                entry[entry < 0] = none
                score, ids = self.table_score[entry], self.table_ids[entry]
                if n == 1:
                    score = np.where(entry == none, self.unknown, score)
                found.append(score)
                reach = before[:m] + score
                better = (reach > forward[e]) | ((reach == forward[e]) & (ids < best_id[e]) & (score > -np.inf))
                forward[e] = np.where(better, reach, forward[e])
                best_id[e][better], best_len[e][better] = ids[better], n
            arcs.append(found)
        best = np.concatenate([forward[j][ended[j]] for j in range(width - 1, -1, -1)])
        on = [np.zeros(m, bool) for m in rows]
        for j in range(width - 1, -1, -1):
            on[j][ended[j]] = True
            for n in np.unique(best_len[j][on[j]]).tolist():
                if j >= n:
                    at = np.flatnonzero(on[j] & (best_len[j] == n))
                    on[j - n][at] = True
        backward, short = [np.full(m, -np.inf) for m in rows], np.full(len(chunks), np.inf)
        for j in range(width):
            backward[j][ended[j]] = 0.0
        for i in range(width - 1, -1, -1):
            for n, score in enumerate(arcs[i], 1):
                e = i + n - 1
                m = rows[e]
                after = score + backward[e]
                if i:
                    np.maximum(backward[i - 1][:m], after, out=backward[i - 1][:m])
                through = (forward[i - 1][:m] if i else 0.0) + after
                loss = np.where(on[e] & (best_len[e] == n), np.inf, best[:m] - through)
                np.minimum(short[:m], loss, out=short[:m])
        row, place, ids = (np.concatenate(x) for x in zip(*((np.flatnonzero(on[j]), np.full(int(on[j].sum()), j), best_id[j][on[j]]) for j in range(width)), strict=True))
        in_order = np.lexsort((place, order[row]))
        row, place, ids = order[row][in_order], place[in_order], ids[in_order]
        cut = np.searchsorted(row, np.arange(len(chunks) + 1)).tolist()
        out = [ids[x:y] for x, y in zip(cut, cut[1:], strict=False)]
        for c in np.unique(row[ids < 0]).tolist():
            mine = row == c
            out[c] = np.array(self.spell(chunks[c], tuple(zip(place[mine].tolist(), ids[mine].tolist(), strict=True))), np.int32)
        back = np.empty(len(chunks))
        back[order] = best
        lost = np.empty(len(chunks))
        lost[order] = short
        return out, back, lost


class Segmenter:
    """Best and N best segmentations of texts."""

    def __init__(self, path: str, n_best: int = N_BEST):
        self.vocabulary = Vocabulary(path)
        self.n = n_best
        self._clear()

    def _clear(self) -> None:
        self.table = kernel.Table(21)
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.best, self.short = np.zeros(1 << 12), np.zeros(1 << 12)
        self.flat, self.used = np.zeros(1 << 14, np.int32), 0
        self.paths: dict[int, list[tuple[float, list[int]]]] = {}

    def _learn(self, chunks: list[str]) -> None:
        """Keep the solutions of chunks that are to be numbered next."""
        v = self.vocabulary
        ids: list = [None] * len(chunks)
        best, short = np.zeros(len(chunks)), np.zeros(len(chunks))
        usual = [i for i, c in enumerate(chunks) if len(c) <= LONG]
        if usual:
            some, best[usual], short[usual] = v.solve([chunks[i] for i in usual])
            for i, x in zip(usual, some, strict=True):
                ids[i] = x
        for i, c in enumerate(chunks):
            if len(c) > LONG:
                ids[i], best[i], short[i] = v.solve_long(c)
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        n, end, total = self.table.n, self.table.n + len(ids), int(length.sum())
        while end > len(self.start):
            self.start, self.length, self.best, self.short = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.best, self.short))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.concatenate(ids)
        self.start[n:end], self.length[n:end] = self.used + np.cumsum(length) - length, length
        self.best[n:end], self.short[n:end] = best, short
        self.used += total

    def _chunk_paths(self, entry: int, chunk: str) -> list[tuple[float, list[int]]]:
        """The chunk's N best, the kept best first."""
        found = self.paths.get(entry)
        if found is None:
            v, at = self.vocabulary, self.start[entry]
            top = self.flat[at : at + self.length[entry]].tolist()
            every = [(s, v.spell(chunk, p)) for s, p in v.nbest(chunk, self.n)]
            found = self.paths[entry] = [(float(self.best[entry]), top), *[x for x in every if x[1] != top][: self.n - 1]]
        return found

    def _borders(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the chunks: spaces and the word behind them, cut between a letter and a mark; a line end alone."""
        n = len(data)
        space, line = data == 32, data == 10
        begin = np.zeros(n + 1, bool)
        begin[1:n] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1] | (self.vocabulary.marks[data[1:]] & letters(data)[:-1])
        begin[offsets] = True
        starts = np.flatnonzero(begin[:n])
        return starts, np.append(starts[1:], n)

    def segment(self, texts: list[str | None] | pa.Array) -> Iterator[list[tuple[float, np.ndarray]]]:
        """For each text its N best (score, ids), best first."""
        column = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        spaced = pc.replace_substring(column, _SPACE, " ")
        data, offsets = kernel.text_buffers(pc.if_else(pc.equal(pc.binary_length(spaced), 0), spaced, pc.binary_join_element_wise(pa.scalar("", spaced.type), spaced, pa.scalar(" ", spaced.type))))
        if self.table.n > CACHE_CHUNKS:
            self._clear()
        starts, ends = self._borders(data, offsets)
        h, check = kernel.span_hashes(data, starts, ends), kernel.fold(data, starts, ends - starts)
        entry, raw = self.table.find(h, check), data.tobytes()
        new = np.flatnonzero(entry < 0)
        if len(new):
            _, first, back = np.unique(kernel.mix(h[new] ^ kernel.mix(check[new])), return_index=True, return_inverse=True)
            at = new[first]
            entry[new] = self.table.n + back
            self._learn([raw[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            self.table.add(h[at], check[at])
        length = self.length[entry].astype(np.int64)
        ids, bounds = gather(self.flat, self.start[entry], length), np.concatenate([[0], np.cumsum(length)])
        edges = np.searchsorted(starts, offsets).tolist()
        for x, y in zip(edges, edges[1:], strict=False):
            mine = entry[x:y]
            chunk = lambda w, x=x: (int(entry[x + w]), raw[starts[x + w] : ends[x + w]].decode())
            yield self._merge(chunk, ids[bounds[x] : bounds[y]], bounds[x : y + 1] - bounds[x], float(self.best[mine].sum()), self.short[mine])

    def _merge(self, chunk: Callable[[int], tuple[int, str]], ids: np.ndarray, bounds: np.ndarray, total: float, short: np.ndarray) -> list[tuple[float, np.ndarray]]:
        k = self.n - 1
        weak = np.argpartition(short, k)[: 4 * k] if len(short) > 4 * k else np.arange(len(short))
        if len(short) > 4 * k:  # of equal shortfalls the first chunks count
            bar = np.partition(short, k - 1)[k - 1]
            weak = np.concatenate([np.flatnonzero(short < bar), np.flatnonzero(short == bar)[:k]])
        weak = weak[np.lexsort((weak, short[weak]))][:k]
        weak = [int(w) for w in weak if np.isfinite(short[w])]
        options = [self._chunk_paths(*chunk(w)) for w in weak]
        heap: list[tuple[float, tuple[int, ...]]] = [(0.0, (0,) * len(weak))]
        seen, out = {heap[0][1]}, []
        while heap and len(out) < self.n:
            loss, choice = heapq.heappop(heap)
            parts, last = [], 0
            for w, c, o in sorted(zip(weak, choice, options, strict=True), key=lambda x: x[0]):
                if c:
                    parts += [ids[last : bounds[w]], np.array(o[c][1], np.int32)]
                    last = bounds[w + 1]
            out.append((total - loss, np.concatenate([*parts, ids[last:]])))
            for j, c in enumerate(choice):
                if c + 1 < len(options[j]):
                    nxt = (*choice[:j], c + 1, *choice[j + 1 :])
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(heap, (loss + options[j][c][0] - options[j][c + 1][0], nxt))
        return out


_SEGMENTERS: dict[tuple[str, int], Segmenter] = {}


def segment_documents(docs: DataFrame, model: str, n_best: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paths array<struct<score, ids>>, decoded) per row; decoded is the best path's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (model, n_best)
        s = _SEGMENTERS.get(key) or _SEGMENTERS.setdefault(key, Segmenter(model, n_best))
        for b in batches:
            for lo, hi in kernel.chunks(kernel.text_buffers(b.column(1))[1]):
                scores: list[np.ndarray] = []
                sizes, flat, decoded = [], [], []
                for paths in s.segment(b.column(1).slice(lo, hi - lo)):
                    scores.append(np.array([x for x, _ in paths]))
                    flat += [p for _, p in paths]
                    sizes.append(len(paths))
                    decoded.append(s.vocabulary.decode(paths[0][1]))
                inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, flat)]), pa.int32()), pa.array(np.concatenate(flat), pa.int32()))
                rows = pa.StructArray.from_arrays([pa.array(np.concatenate(scores)), inner], names=["score", "ids"])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), rows), pa.array(decoded, pa.string())], names=[id_col, "paths", "decoded"])

    source = docs.select(id_col, text_col)
    return source.mapInArrow(lean(run), f"`{id_col}` {source.schema[0].dataType.simpleString()}, paths array<struct<score:double,ids:array<int>>>, decoded string")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_pieces, n_paths, scores, ids_crc32, decoded_crc32): little-endian uint32 crcs of each path, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column(1)
            edges = paths.offsets.to_numpy()
            rows = paths.values
            inner = rows.field("ids")
            view, at = memoryview(np.ascontiguousarray(inner.values.to_numpy().astype("<u4"))).cast("B"), inner.offsets.to_numpy().astype(np.int64)
            crc = pa.array([zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(at.tolist(), at[1:].tolist(), strict=False)], pa.int64())
            first = np.diff(at)[edges[:-1]] if len(at) > 1 else np.zeros(0, np.int64)
            text = pa.array([zlib.crc32(t.encode()) for t in b.column(2).to_pylist()], pa.int64())
            lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), v) for v in (rows.field("score"), crc)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(first), pa.array(np.diff(edges).astype(np.int32)), *lists, text], names=[id_col, "n_pieces", "n_paths", "scores", "ids_crc32", "decoded_crc32"])

    kind = found.select(id_col).schema[0].dataType.simpleString()
    return found.mapInArrow(lean(run), f"`{id_col}` {kind}, n_pieces bigint, n_paths int, scores array<double>, ids_crc32 array<bigint>, decoded_crc32 bigint")
