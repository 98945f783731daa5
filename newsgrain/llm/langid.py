"""Language identification, word first: known words score by per-language log frequency.

A word that no language knows is scored by its character n-grams instead:
the longest n (from ``MAX_GRAM`` down to 1) of which some language knows a gram
decides, by the mean log frequency of the known grams.

The tables come from a bounded sample of labelled texts (``SAMPLE_PER_LANGUAGE``
per language, drawn by hash); each language keeps its ``WORDS_KEPT`` most
frequent words and ``GRAMS_KEPT`` grams of each length, so the model has a fixed
size per language and is broadcast.

Every word of a text counts.  Words are found and hashed in numpy on the code
points of many texts at once.  Scored words are kept in a bounded hash table per
Python worker, which is emptied when full; nothing grows with the corpus.

Cases: null texts and texts without a letter are ``und`` with score 0; so is
everything where no language was learnt; null languages are no examples; ties
go to the first language in order; repeated rows are scored one by one; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgrain.llm import kernel
from newsgrain.llm.common import crc_of_id, cut, lean

SAMPLE_PER_LANGUAGE = 2000
#: Languages whose sizes go to all tasks; of more, texts and sizes are joined by language.
FEW_LANGUAGES = 10_000
WORDS_KEPT = 25_000
GRAMS_KEPT = 10_000
MAX_GRAM = 5
UNKNOWN = "und"
CACHE_WORDS = 300_000
LETTERS = re.compile(r"[^\W\d_]+")
#: Code points from here on are no letters; which of those before are letters as in LETTERS, and which alphabetic.
_TOP = 0x32400
_LETTER = np.array([c.isalnum() and not c.isdecimal() for c in map(chr, range(_TOP))] + [False])
_ALPHA = np.array([c.isalpha() for c in map(chr, range(_TOP))] + [False])
#: Characters that are scored together.
GROUP = 400_000


def word_list(text: str) -> list[str]:
    """The lower-cased runs of letters."""
    return LETTERS.findall(text.lower())


class Model:
    """Scores of words by language; built from (language, word, count) rows."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        by: dict[str, Counter] = defaultdict(Counter)
        for lang, word, n in rows:
            by[lang][word] += n
        self.languages = sorted(by)
        k = len(self.languages)
        self.words = self._table([by[x] for x in self.languages], WORDS_KEPT)
        self.grams: list[tuple[dict[str, int], np.ndarray]] = []
        for n in range(1, MAX_GRAM + 1):
            counts = []
            for x in self.languages:
                c: Counter = Counter()
                for word, times in by[x].items():
                    padded = f" {word} "
                    for i in range(len(padded) - n + 1):
                        c[padded[i : i + n]] += times
                counts.append(c)
            self.grams.append(self._table(counts, GRAMS_KEPT))
        self._table: kernel.Table | None = None
        self._rows = np.zeros((1024, k))

    @staticmethod
    def _table(counts: list[Counter], keep: int) -> tuple[dict[str, int], np.ndarray]:
        """What any language keeps, numbered, and its log frequencies (add one half) by language."""
        kept = sorted({w for c in counts for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:keep]})
        total = np.array([sum(c.values()) + 0.5 * len(kept) + 1 for c in counts])
        seen = np.array([[c[w] for w in kept] for c in counts], float).T.reshape(len(kept), len(counts))
        return {w: i for i, w in enumerate(kept)}, np.log((seen + 0.5) / total)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log frequencies of words by language: their own, else the mean of their longest known grams', else 0."""
        index, score = self.words
        out = np.zeros((len(words), len(self.languages)))
        at = np.array([index.get(w, -1) for w in words], np.int64)
        out[at >= 0] = score[at[at >= 0]]
        left = [(i, f" {words[i]} ") for i in np.flatnonzero(at < 0).tolist()]
        for n in range(MAX_GRAM, 0, -1):
            index, score = self.grams[n - 1]
            get, flat, who, sizes, rest = index.get, [], [], [], []
            for i, padded in left:
                found = [g for g in [get(padded[j : j + n]) for j in range(len(padded) - n + 1)] if g is not None]
                if found:
                    flat += found
                    who.append(i)
                    sizes.append(len(found))
                else:
                    rest.append((i, padded))
            if who:
                out[who] = np.add.reduceat(score[flat], np.cumsum(sizes) - sizes) / np.array(sizes)[:, None]
            left = rest
        return out

    def word_score(self, word: str) -> np.ndarray:
        return self.word_scores([word])[0]

    def _entries(self, text: str, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of scores of each word."""
        p, inv = kernel._powers(kernel._BASE, len(code) + 1)
        acc = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(kernel.mix(code.astype(np.uint64) + np.uint64(77)) * p[: len(code)], out=acc[1:])
        h = kernel.mix((acc[ends] - acc[starts]) * inv[starts] + (ends - starts).astype(np.uint64))
        check = kernel.mix(code[starts].astype(np.uint64) | (code[ends - 1].astype(np.uint64) << np.uint64(21)) | ((ends - starts).astype(np.uint64) << np.uint64(42)))
        if self._table is None or self._table.n > CACHE_WORDS:
            self._table = kernel.Table(20)
        entry = self._table.find(h, check)
        new = np.flatnonzero(entry < 0)
        if len(new):
            _, first, back = np.unique(h[new] ^ kernel.mix(check[new]), return_index=True, return_inverse=True)
            at, n = new[first], self._table.n
            while n + len(at) > len(self._rows):
                self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
            self._rows[n : n + len(at)] = self.word_scores([text[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            entry[new] = n + back
            self._table.add(h[at], check[at])
        return entry

    def _group(self, texts: list[str | None]) -> list[tuple[str, float]]:
        lowered = [(t or "").lower() for t in texts]
        text = "\n".join([*lowered, ""])
        code = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), _TOP)
        letter = np.concatenate([[False], _LETTER[code], [False]])
        starts, ends = np.flatnonzero(letter[1:] & ~letter[:-1]), np.flatnonzero(letter[:-1] & ~letter[1:])
        bounds = np.cumsum([0, *(len(t) + 1 for t in lowered)])
        alpha = np.add.reduceat(_ALPHA[code].astype(np.int64), bounds[:-1])
        doc, n, k = np.searchsorted(bounds, starts, "right") - 1, len(texts), len(self.languages)
        entry = self._entries(text, code, starts, ends) if len(starts) else np.zeros(0, np.int32)
        words = np.bincount(doc, minlength=n)
        mean = np.stack([np.bincount(doc, self._rows[entry, j], n) for j in range(k)], axis=1) / np.maximum(words, 1)[:, None]
        best = mean.argmax(axis=1)
        share = np.exp(mean - mean.max(axis=1, keepdims=True))
        score = share[np.arange(n), best] / share.sum(axis=1)
        return [(self.languages[b], float(s)) if a else (UNKNOWN, 0.0) for a, b, s in zip(alpha.tolist(), best.tolist(), score.tolist(), strict=True)]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """For each text the likeliest language and its share of the mean word likelihoods."""
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        out, lo, total = [], 0, 0
        for i, t in enumerate(texts):
            total += len(t or "")
            if total >= GROUP or i + 1 == len(texts):
                out += self._group(texts[lo : i + 1])
                lo, total = i + 1, 0
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from a hash-drawn sample of at most SAMPLE_PER_LANGUAGE texts of each language whose id's crc32 modulo 3 is not 1."""
    known = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_t"))
    known = known.filter(F.col("_lang").isNotNull() & (crc_of_id("_id") % 3 != 1))
    sizes = known.groupBy("_lang").agg((F.least(F.lit(1.0), 1.3 * SAMPLE_PER_LANGUAGE / F.count(F.lit(1))) * (1 << 30)).alias("_share"))
    draw = F.pmod(F.xxhash64(F.col("_id"), F.lit(11)), F.lit(1 << 30))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(draw, "_id", F.xxhash64("_t")))  # of a sample a little too large
    few = sizes.limit(FEW_LANGUAGES + 1).collect()
    if len(few) <= FEW_LANGUAGES:  # texts stay where they lie
        sizes = F.broadcast(docs.sparkSession.createDataFrame(few, sizes.schema))
    near = known.join(sizes, "_lang").filter(draw < F.col("_share"))
    drawn = near.withColumn("_place", place).filter(F.col("_place") <= SAMPLE_PER_LANGUAGE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by[lang].update(word_list(text or ""))
        for lang, c in by.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    counts = drawn.select("_lang", "_t").mapInArrow(lean(count), "lang string, word string, n bigint")
    counts = cut(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    # every language's most frequent words, by a threshold on the count: a histogram of counts is small
    histogram = counts.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("words")).collect()
    least: dict[str, int] = {}
    kept: Counter = Counter()
    for lang, n, words in sorted(((r["lang"], r["n"], r["words"]) for r in histogram), key=lambda r: (r[0], -r[1])):
        kept[lang] += words
        if kept[lang] <= WORDS_KEPT or lang not in least:
            least[lang] = n
    if not least:
        return Model([])
    floor = docs.sparkSession.createDataFrame(list(least.items()), "lang string, least bigint")
    got = counts.join(floor, "lang").filter("n >= least").toArrow()
    rows = zip(got.column("lang").to_pylist(), got.column("word").to_pylist(), got.column("n").to_pylist(), strict=True)
    return Model(sorted(rows))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            found = m.predict_all(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    return source.mapInArrow(lean(run), f"`{id_col}` {source.schema[0].dataType.simpleString()}, lang_pred string, score double")
