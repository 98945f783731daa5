"""Whole texts to token ids with the ``tokenizers`` library, a chunk at a time.

The two public vocabularies split a text before any merge, and never across a
border between white space and a word, nor between a letter and an ASCII mark or
digit behind it.
So a text's ids are the concatenated ids of its chunks.  Chunks are found and
hashed in numpy on the UTF-8 buffer of an Arrow column; each distinct chunk is
encoded by the library once and then looked up in a hash table, which is
bounded (``CACHE_CHUNKS``) and emptied when full.  An entry is told by two 64-bit
numbers, of all its bytes and of its length and first bytes.

Ids are those of the tokenizer as its file is loaded: the string of an added
token in a text becomes that token's id.  Texts that hold one, and all texts of
a tokenizer of any other make, are given to the library whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from newsgrain.llm import kernel

CACHE_CHUNKS = 700_000
_SLOT_BITS = 21
#: Unicode white space beyond ASCII as UTF-8: the library's class, not that of Python's re.
_WIDE_SPACE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE_KEYS = {2: [b for b in _WIDE_SPACE if len(b) == 2], 3: [b for b in _WIDE_SPACE if len(b) == 3]}
_LEADS = np.zeros(256, bool)
_LEADS[[b[0] for b in _WIDE_SPACE]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_ASCII_MARK = np.zeros(256, bool)
_ASCII_MARK[33:127] = ~_ASCII_LETTER[33:127]
#: Second bytes of the letters from U+00C0 to U+00FF.
_LATIN_SECOND = np.zeros(256, bool)
_LATIN_SECOND[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next free letter from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


_LETTERS = _byte_letters()


def _spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space characters."""
    out = kernel.IS_SPACE[data]
    at = np.flatnonzero(_LEADS[data])
    for n, wide in _WIDE_KEYS.items():
        lead = at[at + n <= len(data)]
        if len(lead):
            key = sum(data[lead + i].astype(np.uint32) << np.uint32(8 * i) for i in range(n))
            lead = lead[np.isin(key, [int.from_bytes(b, "little") for b in wide])]
            for i in range(n):
                out[lead + i] = True
    return out


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters of Latin-1."""
    out = _ASCII_LETTER[data]
    first = np.flatnonzero(data[:-1] == 0xC3)
    first = first[_LATIN_SECOND[data[first + 1]]]
    out[first] = True
    out[first + 1] = True
    return out


def _borders(data: np.ndarray, offsets: np.ndarray, space: np.ndarray, letter: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the chunks; ``spaced`` tokenizers keep white space and join one space to the word behind it."""
    n = len(data)
    begin = np.zeros(n + 1, bool)
    begin[1:n] = (space[1:] != space[:-1]) | (_ASCII_MARK[data[1:]] & letter[:-1])
    begin[offsets] = True
    if spaced:
        word = np.flatnonzero(begin[1:n] & ~space[1:] & space[:-1]) + 1
        word = word[~_member(word, offsets, n)]
        begin[word[data[word - 1] == 0x20]] = False
        last = word - 1  # the first byte of the white space character before the word
        for _ in range(2):
            last = last - ((data[last] & 0xC0) == 0x80)
        begin[last] = True
    starts = np.flatnonzero(begin[:n])
    ends = np.append(starts[1:], n)
    if not spaced:
        kept = ~space[starts]
        starts, ends = starts[kept], ends[kept]
    return starts, ends


def _member(at: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    mark = np.zeros(n + 1, bool)
    mark[offsets] = True
    return mark[at]


class Encoder:
    """``encode(column)`` gives (ids, bounds): the ids of text i are ids[bounds[i]:bounds[i+1]]."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        conf = json.loads(self.tokenizer.to_str())
        self.kind = self._kind(conf)
        self.added = [x["content"].encode() for x in conf.get("added_tokens") or []]
        if self.kind and any(x.get("lstrip") or x.get("rstrip") or x.get("normalized") or not x["content"] for x in conf.get("added_tokens") or []):
            self.kind = None
        self._clear()

    @staticmethod
    def _kind(conf: dict) -> str | None:
        """How texts split, if this tokenizer's own splitting is known to respect it."""
        norm, pre = conf.get("normalizer"), conf.get("pre_tokenizer") or {}
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "spaced"
        steps = pre.get("pretokenizers") or []
        norms = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        if [x.get("type") for x in steps] == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"]:
            first = steps[0]
            if first.get("behavior") == "Removed" and first.get("invert") and first["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+"):
                return "words"
        return None

    def _clear(self) -> None:
        self.table = kernel.Table(_SLOT_BITS)
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.int32)
        self.used = 0

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks_ids(self, raw: list[bytes], plain: np.ndarray) -> list[list[int]]:
        """Ids of new chunks; a plain one, letters behind a space perhaps, needs the library's merges alone."""
        out: list = [None] * len(raw)
        fold, tokenize = self.kind == "words", self.tokenizer.model.tokenize
        for i in np.flatnonzero(plain).tolist():
            piece = raw[i]
            if fold:
                piece = piece.lower() if piece.isascii() else piece.decode().lower().encode()
            if not piece.isascii():
                spelt = piece.decode("latin-1").translate(_LETTERS)
            else:
                spelt = f"{_LETTERS[32]}{piece[1:].decode()}" if piece[0] == 32 else piece.decode()
            out[i] = [t.id for t in tokenize(spelt)]
        hard = np.flatnonzero(~plain).tolist()
        for i, ids in zip(hard, self._raw([raw[i].decode() for i in hard]) if hard else [], strict=True):
            out[i] = ids
        return out

    def _learn(self, raw: list[bytes], plain: np.ndarray) -> None:
        """Keep the ids of chunks that are to be numbered next."""
        ids = self._chunks_ids(raw, plain)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        n, end, total = self.table.n, self.table.n + len(ids), int(lengths.sum())
        while end > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
        self.length[n:end] = lengths
        self.start[n:end] = self.used + np.cumsum(lengths) - lengths
        self.used += total

    def _part(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        texts = lambda which: [data[offsets[i] : offsets[i + 1]].tobytes() for i in which]
        if self.kind is None:
            return self._joined([np.array(x, np.int32) for x in self._raw([t.decode() for t in texts(range(len(offsets) - 1))])])
        if self.table.n > CACHE_CHUNKS:
            self._clear()
        space, letter = _spaces(data), letters(data)
        starts, ends = _borders(data, offsets, space, letter, self.kind == "spaced")
        h = kernel.span_hashes(data, starts, ends, lower=self.kind == "words")
        # where cases are one entry the hash alone tells them
        check = kernel.fold(data, starts, ends - starts) if self.kind == "spaced" else (ends - starts).astype(np.uint64)
        entry = self.table.find(h, check)
        new = np.flatnonzero(entry < 0)
        if len(new):
            _, first, back = np.unique(kernel.mix(h[new] ^ kernel.mix(check[new])), return_index=True, return_inverse=True)
            at = new[first]
            odd = np.concatenate([[0], np.cumsum(~letter)])
            front = starts[at] + (data[starts[at]] == 0x20)
            plain = (odd[ends[at]] == odd[front]) & (ends[at] > front)
            raw = data.tobytes()
            entry[new] = self.table.n + back
            self._learn([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], plain)
            self.table.add(h[at], check[at])
        length = self.length[entry]
        bounds = np.concatenate([[0], np.cumsum(length)])
        ids, bounds = gather(self.flat, self.start[entry], length), bounds[np.searchsorted(starts, offsets)]
        marked = self._marked(data, offsets)
        if not len(marked):
            return ids, bounds
        parts = [ids[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]
        for i, x in zip(marked.tolist(), self._raw([t.decode() for t in texts(marked)]), strict=True):
            parts[i] = np.array(x, np.int32)
        return self._joined(parts)

    @staticmethod
    def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.cumsum([0, *map(len, parts)])

    def _marked(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The texts that hold an added token's string."""
        out = np.zeros(0, np.int64)
        for mark in self.added:
            at = np.flatnonzero(data[: max(0, len(data) - len(mark) + 1)] == mark[0])
            for i in range(1, len(mark)):
                if not len(at):
                    break
                at = at[data[at + i] == mark[i]]
            doc = np.searchsorted(offsets, at, "right") - 1
            out = np.union1d(out, doc[at + len(mark) <= offsets[doc + 1]]).astype(np.int64)
        return out

    def encode(self, column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(index of the first text, ids, bounds) for groups of texts of about ``size`` bytes; nulls count as empty."""
        data, offsets = kernel.text_buffers(column)
        for lo, hi in kernel.chunks(offsets, size):
            yield lo, *self._part(data, offsets[lo : hi + 1])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a file; kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of flat[starts[i] : starts[i] + lengths[i]]."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
