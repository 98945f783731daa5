"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye.

The words of a batch of documents are numbered and their suffixes sorted by
doubling; the ranks of every doubling step stay, so that two places are compared
over any length, forwards or backwards, in one pass over the steps.  Sorted
suffixes with intervals of equal prefixes stand for the suffix tree: a node is
an interval, an edge to a child a narrower one.  Then, for all documents of the
batch at once:

1. The Lempel-Ziv blocks of each document: the longest earlier factor of every
   place, from the nearest smaller places on both sides of the sorted suffixes.
2. For each block, the squares whose centre lies in it and that cross its end or
   its start, found by extending from the border both ways for every period up
   to the lengths of the block and the next.  They cover the leftmost occurrence
   of every square.  Squares of a power are dropped: their root is found itself.
3. Walks along suffix links complete the vocabulary: from the last square of a
   stretch the link leads to the node of its words without the first; where that
   node has an edge with the word that was dropped, the next rotation occurs
   somewhere too, and the walk goes on from there.  A walk follows the text as
   long as the square repeats there, so it makes one step a stretch, not one a word.
4. All leaves under the nodes of the vocabulary are the occurrences of primitive
   squares; those of one period at consecutive places merge into runs.

A run is a maximal stretch with smallest period q; of these, those of ``power``
periods and ``least`` words are returned.

Cases: null, empty and blank texts have no words and no runs; ids play no part
and null or repeated ones are carried along, one result a row; a document of any
length is one unit of work and takes about 100 bytes a word and doubling step;
equal runs cannot arise, and runs come by start, then period; an empty table gives
an empty result; names of other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgrain.llm import kernel
from newsgrain.llm.common import lean

_I64 = np.int64


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class Suffixes:
    """Sorted suffixes of the word sequences ``symbols[bounds[d]:bounds[d+1]]``, each on its own.

    ``ranks[l][i]`` is the same for places that agree on 2**l words, and grows in the order of the suffixes.
    """

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray):
        n = self.n = len(symbols)
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.first, self.end = bounds[:-1][doc], bounds[1:][doc]
        _, word = np.unique(symbols, return_inverse=True)
        width = int(word.max(initial=0)) + 2
        follow = np.zeros(n, _I64)
        follow[:-1] = word[1:] + 1
        follow[self.end - 1 == np.arange(n)] = 0
        key = (doc * width + word) * width + follow
        self.sa = np.argsort(key, kind="stable")
        ordered = key[self.sa]
        self.ranks = [self._rank(ordered // width), self._rank(ordered)]
        while True:
            rank, step = self.ranks[-1], 1 << (len(self.ranks) - 1)
            at = rank[self.sa]
            same = at[1:] == at[:-1]
            shared = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
            if not len(shared):
                break
            place = self.sa[shared]
            key = rank[place].astype(_I64) * (n + 1) + self.value(len(self.ranks) - 1, place + step, place) + 1
            order = np.argsort(key, kind="stable")
            self.sa[shared] = place[order]
            key = key[order]
            new = np.insert(key[1:] != key[:-1], 0, True)
            out = rank.copy()
            out[place[order]] = shared[np.flatnonzero(new)[np.cumsum(new) - 1]]
            self.ranks.append(out)

    def _rank(self, ordered: np.ndarray) -> np.ndarray:
        new = np.insert(ordered[1:] != ordered[:-1], 0, True)[: self.n]
        out = np.full(self.n + 1, -1, np.int32)
        out[self.sa] = np.flatnonzero(new)[np.cumsum(new) - 1] if self.n else 0
        return out

    def value(self, level: int, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Rank of 2**level words at places of the documents that ``of`` lies in; past the end it is least."""
        return np.where(at < self.end[of], self.ranks[level][np.minimum(at, self.n)], -1).astype(_I64)

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b on are equal; a and b differ."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for level in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[level]
            move = (rank[a] == rank[b]).astype(_I64) << level
            a += move
            b += move
        return a - start

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words up to and with a < b, read backwards, are equal within the document of b."""
        a, b = a + 1, b + 1
        start, first = a.copy(), self.first[b - 1]
        for level in range(len(self.ranks) - 1, -1, -1):
            rank, step = self.ranks[level], 1 << level
            fits = a - step >= first
            move = (fits & (rank[np.where(fits, a - step, 0)] == rank[np.where(fits, b - step, 0)])).astype(_I64) << level
            a -= move
            b -= move
        return start - a

    def node(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of sorted suffixes that share ``depth`` words with the one at each place."""
        lo, hi = np.zeros(len(at), _I64), np.zeros(len(at), _I64)
        levels = np.minimum(np.floor(np.log2(depth)).astype(_I64), len(self.ranks) - 1)
        for level in np.unique(levels):
            of = np.flatnonzero(levels == level)
            row = self.ranks[level][self.sa]
            mine = self.ranks[level][at[of]]
            lo[of], hi[of] = np.searchsorted(row, mine, "left"), np.searchsorted(row, mine, "right")
            lo[of], hi[of] = self._narrow(lo[of], hi[of], depth[of] - (1 << int(level)), int(level), self.value(int(level), at[of] + depth[of] - (1 << int(level)), at[of]))
        return lo, hi

    def child(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of each interval whose suffixes have the word of place ``word`` after ``depth`` words."""
        return self._narrow(lo, hi, depth, 0, self.ranks[0][word].astype(_I64))

    def _narrow(self, lo: np.ndarray, hi: np.ndarray, skip: np.ndarray, level: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of each interval whose suffixes have rank ``wanted`` after ``skip`` words; there the ranks are in order."""
        ends = []
        for after in (False, True):
            a, b = lo.copy(), hi.copy()
            while (open_ := a < b).any():
                mid = np.where(open_, (a + b) >> 1, np.minimum(a, self.n - 1))
                place = self.sa[mid]
                have = self.value(level, place + skip, place)
                right = open_ & ((have <= wanted) if after else (have < wanted))
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            ends.append(a)
        return ends[0], ends[1]


def _blocks(s: Suffixes, bounds: np.ndarray) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks of every document."""
    step = np.ones(s.n, _I64)
    at = s.ranks[1][s.sa]
    same = at[1:] == at[:-1]
    place = s.sa[np.append(same, False) | np.insert(same, 0, False)]
    if len(place):  # elsewhere an earlier factor has one word at most
        before, after, stack = [], [-1] * len(place), [(-1, -1)]
        for r, p in enumerate(place.tolist()):
            while stack[-1][1] > p:
                after[stack.pop()[0]] = p
            before.append(stack[-1][1])
            stack.append((r, p))
        for near in (np.array(before), np.array(after)):
            of = np.flatnonzero(near >= 0)
            step[place[of]] = np.maximum(step[place[of]], s.ahead(place[of], near[of]))
    starts, steps = [], step.tolist()
    i = 0
    while i < s.n:
        starts.append(i)
        i += steps[i]
    return np.array(starts, _I64)


def _stretches(s: Suffixes, left: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, squares, period) of the maximal stretches of a period around pairs of equal words ``left`` and ``left + period``."""
    ahead = s.ahead(left, left + period)
    inner = left > s.first[left]
    behind = np.zeros(len(left), _I64)
    behind[inner] = s.behind(left[inner] - 1, left[inner] + period[inner] - 1)
    found = ahead + behind >= period
    return (left - behind)[found], (ahead + behind - period + 1)[found], period[found]


def _once(start: np.ndarray, squares: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(start):
        return start, squares, period
    order = np.lexsort((period, start))
    a, k = start[order], period[order]
    new = np.insert((a[1:] != a[:-1]) | (k[1:] != k[:-1]), 0, True)
    return a[new], squares[order][new], k[new]


def _primitive(s: Suffixes, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the root of the square at each start is no power: it has no period that a prime divides from its length."""
    out, rest = np.ones(len(start), bool), period.copy()
    prime = 2
    while (rest > 1).any():
        if prime * prime > int(rest.max()):
            primes = rest  # what is left are primes
        else:
            primes = np.where(rest % prime == 0, prime, 1)
        of = np.flatnonzero((primes > 1) & out)
        root = period[of] // primes[of]
        out[of] = s.ahead(start[of], start[of] + root) < 2 * period[of] - root
        if primes is rest:
            break
        while (hit := (rest % prime == 0) & (rest > 1)).any():
            rest = np.where(hit, rest // prime, rest)
        prime += 1 if prime == 2 else 2
    return out


def _covering(s: Suffixes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of squares that cover the leftmost occurrence of every square."""
    starts = _blocks(s, bounds)
    nexts = np.append(starts[1:], s.n)
    last = nexts == s.end[starts]
    sizes = nexts - starts
    word = s.ranks[0]
    # across the end of a block: the word after it equals one of the block
    of = np.repeat(np.flatnonzero(~last), sizes[~last])
    period = _ramp(sizes[~last]) + 1
    left = nexts[of] - period
    hit = word[left] == word[nexts[of]]
    lefts, periods = [left[hit]], [period[hit]]
    # across the start of a block, the centre still in it: words beyond it, up to the end of the next block
    reach = np.where(last, sizes, sizes + np.append(sizes[1:], 0))
    inner = np.flatnonzero(starts > s.first[starts])
    for part in np.array_split(inner, max(1, int(reach[inner].sum() >> 22))):
        of = np.repeat(part, reach[part])
        period = _ramp(reach[part]) + 1
        left = starts[of]
        fits = left + period < s.end[left]
        left, period = left[fits], period[fits]
        hit = (word[left] == word[left + period]) & (word[left - 1] == word[left + period - 1])
        lefts.append(left[hit])
        periods.append(period[hit])
    start, squares, period = _once(*_stretches(s, np.concatenate(lefts), np.concatenate(periods)))
    keep = _primitive(s, start, period)
    return start[keep], squares[keep], period[keep]


def _vocabulary(s: Suffixes, start: np.ndarray, squares: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches and those that walks along suffix links reach from them."""
    seen = set(zip(start.tolist(), period.tolist(), strict=True))
    found = [(start, squares, period)]
    while len(start):
        going = squares < period  # else all rotations are here
        at, k = (start + squares - 1)[going], period[going]
        if not len(at):
            break
        lo, hi = s.node(at + 1, 2 * k - 1)
        lo, hi = s.child(lo, hi, 2 * k - 1, at)
        there = lo < hi
        nxt = _once(*_stretches(s, s.sa[lo[there]], k[there]))
        new = np.array([(a, k) not in seen for a, k in zip(nxt[0].tolist(), nxt[2].tolist(), strict=True)], bool)
        start, squares, period = (x[new] for x in nxt)
        seen.update(zip(start.tolist(), period.tolist(), strict=True))
        found.append((start, squares, period))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def find_runs(symbols: np.ndarray, bounds: np.ndarray, power: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of ``power`` periods and ``least`` words, by start, then period; starts count over all documents."""
    none = np.zeros(0, _I64)
    if not len(symbols):
        return none, none, none
    s = Suffixes(symbols, bounds)
    start, squares, period = _vocabulary(s, *_covering(s, bounds))
    turns = np.minimum(squares, period)
    at, k = np.repeat(start, turns) + _ramp(turns), np.repeat(period, turns)
    if not len(at):
        return none, none, none
    lo, hi = s.node(at, 2 * k)
    _, once = np.unique(lo * (s.n + 1) + k, return_index=True)  # a node and a length are one square
    lo, hi, k = lo[once], hi[once], k[once]
    at, k = s.sa[np.repeat(lo, hi - lo) + _ramp(hi - lo)], np.repeat(k, hi - lo)
    order = np.lexsort((at, k))
    at, k = at[order], k[order]
    new = np.flatnonzero(np.insert((k[1:] != k[:-1]) | (at[1:] != at[:-1] + 1) | (s.first[at[1:]] != s.first[at[:-1]]), 0, True))
    start, period = at[new], k[new]
    length = np.diff(np.append(new, len(at))) - 1 + 2 * period
    keep = np.flatnonzero((length >= least) & (length >= power * period))
    keep = keep[np.lexsort((period[keep], start[keep]))]
    return start[keep], length[keep], period[keep]


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of spans, each followed by a space."""
    sizes = ends - starts + 1
    to = np.cumsum(sizes)
    out = data[np.minimum(np.repeat(starts - (to - sizes), sizes) + np.arange(to[-1] if len(to) else 0), len(data) - 1)]
    out[to - 1] = 0x20
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", power: int = 4, least: int = 6) -> DataFrame:
    """(id, n_words, runs, collapsed_text): all runs of each text, and its words without those that repeat one.

    A word goes if a run contains it after that run's first period; the rest is joined by one space.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def part(column: pa.Array) -> list[pa.Array]:
        data, offsets = kernel.text_buffers(column)
        w = kernel.words(data, offsets)
        start, length, period = find_runs(w.hashes(), w.bounds, power, least)
        step = np.zeros(len(w.starts) + 1, _I64)
        np.add.at(step, start + period, 1)
        np.add.at(step, start + length, -1)
        kept = np.cumsum(step[:-1]) == 0
        many = np.searchsorted(start, w.bounds)
        first = np.repeat(w.bounds[:-1], np.diff(many))
        rows = pa.StructArray.from_arrays([pa.array(start - first), pa.array(length), pa.array(period)], names=["start", "length", "period"])
        left = _gathered(w.data, w.starts[kept], w.ends[kept])
        ends = np.concatenate([[0], np.cumsum(w.ends[kept] - w.starts[kept] + 1)])[np.concatenate([[0], np.cumsum(kept)])[w.bounds]]
        if len(left):  # no space after a text's last word
            solid = np.ones(len(left), bool)
            solid[ends[1:][np.diff(ends) > 0] - 1] = False
            left, ends = left[solid], np.concatenate([[0], np.cumsum(solid)])[ends]
        texts = pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(ends.astype(_I64)), pa.py_buffer(left)])
        return [pa.array(w.counts.astype(_I64)), pa.ListArray.from_arrays(pa.array(many.astype(np.int32)), rows).cast(kind), texts.cast(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, offsets = kernel.text_buffers(b.column(1))
            for lo, hi in kernel.chunks(offsets):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *part(b.column(1).slice(lo, hi - lo))], names=["id", "n_words", "runs", "collapsed_text"])

    out = source.mapInArrow(lean(run), f"id {source.schema[0].dataType.simpleString()}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed_text string")
    return out.withColumnRenamed("id", id_col)
