"""Quality rules as a short-circuit cascade.

Each rule reads some measures of a text and fails it or not.  On a bounded
sample the operator times every measure, then orders the rules one by one: next
comes the rule that rejects most of the texts still left per second of measures
not yet taken.  So cheap and selective rules come first, and a text that failed
is not measured further.  The verdict is the conjunction of all rules, so it
does not depend on the order found.

Measures are counted over whole texts; the sample only sets the order.  Measures
that the caller asks for are taken for every text, and the cascade reads them.

Cases: a null or empty text has no words and fails ``min_words``; a null id is
carried along; repeated rows are judged one by one; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgrain.llm import kernel
from newsgrain.llm.common import lean

#: Rows of the sample on which the rules' costs and selectivities are estimated.
SAMPLE_ROWS = 200
#: Texts of more bytes are judged like all others but not drawn for the estimate.
SAMPLE_BYTES = 1 << 16
REPEAT_WINDOW = 8
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_LEADS = (np.arange(256) & 0xC0) != 0x80


def n_words(w: kernel.Words) -> np.ndarray:
    return w.counts.astype(np.int64)


def word_chars(w: kernel.Words) -> np.ndarray:
    return w.sums((_LEADS & ~kernel.IS_SPACE)[w.data])


def n_symbols(w: kernel.Words) -> np.ndarray:
    return w.sums(_SYMBOLS[w.data])


def _lines(w: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the lines that hold a word."""
    newline = np.flatnonzero(w.data == 10)
    starts = np.unique(np.concatenate([w.offsets[:-1], newline + 1]))
    starts = starts[starts < len(w.data)]
    ends = np.append(starts[1:], len(w.data))
    ends = ends - ((ends > starts) & (w.data[np.maximum(ends - 1, 0)] == 10))
    held = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[held], ends[held]
    doc = np.searchsorted(w.offsets, starts, "right") - 1
    return doc, kernel.span_hashes(w.data, starts, ends)


def n_lines(w: kernel.Words) -> np.ndarray:
    return np.bincount(_lines(w)[0], minlength=len(w.counts)).astype(np.int64)


def n_dup_lines(w: kernel.Words) -> np.ndarray:
    doc, h = _lines(w)
    order = np.lexsort((h, doc))
    d, s = doc[order], h[order]
    again = np.zeros(len(d), bool)
    again[1:] = (d[1:] == d[:-1]) & (s[1:] == s[:-1])
    return np.bincount(d[again], minlength=len(w.counts)).astype(np.int64)


def n_repeat_words(w: kernel.Words, k: int = REPEAT_WINDOW) -> np.ndarray:
    g = kernel.grams(w.hashes(), k)
    at = np.flatnonzero(kernel.inside(w.bounds, k, len(g)))
    doc = kernel.document_of(w.bounds)
    key = kernel.mix(g[at] + kernel.mix(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    twin = np.zeros(len(s), bool)
    same = s[1:] == s[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    marks = np.zeros(len(w.starts), bool)
    marks[at[order[twin]]] = True
    return np.bincount(doc[kernel.cover(marks, k, len(w.starts))], minlength=len(w.counts)).astype(np.int64)


MEASURES: dict[str, Callable[[kernel.Words], np.ndarray]] = {
    f.__name__: f for f in (n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)
}


@dataclass(frozen=True)
class Rule:
    """``fails(measures)`` says which texts the rule rejects; ``reads`` names the measures it needs."""

    name: str
    reads: tuple[str, ...]
    fails: Callable[[dict[str, np.ndarray]], np.ndarray]


#: The first two are the base; the rest is the verdict of the method.
BASE_RULES = (
    Rule("min_words", ("n_words",), lambda m: m["n_words"] < 20),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
)
RULES = (
    *BASE_RULES,
    Rule("word_length", ("n_words", "word_chars"), lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 10 * m["n_symbols"] > 2 * m["n_words"]),
    Rule("dup_lines", ("n_lines", "n_dup_lines"), lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
)


def _subset(w: kernel.Words, keep: np.ndarray) -> kernel.Words:
    """The words of the documents that ``keep`` marks."""
    if keep.all():
        return w
    lengths = np.diff(w.offsets)
    data = w.data[np.repeat(keep, lengths)]
    return kernel.words(data, np.concatenate([[0], np.cumsum(lengths[keep])]))


def run_cascade(w: kernel.Words, rules: Sequence[Rule], known: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(kept, number of rules run) per document; only documents that passed so far are measured, for measures not known."""
    n = len(w.counts)
    kept, ran, alive = np.ones(n, bool), np.zeros(n, np.int32), np.arange(n)
    part, have = w, dict(known or {})
    for rule in rules:
        if not len(alive):
            break
        for name in rule.reads:
            if name not in have:
                have[name] = MEASURES[name](part)
        bad = rule.fails(have)
        ran[alive] += 1
        kept[alive[bad]] = False
        if bad.any():
            part = _subset(part, ~bad)
            have = {k: v[~bad] for k, v in have.items()}
            alive = alive[~bad]
    return kept, ran


def order_rules(texts: list[str | None], rules: Sequence[Rule] = RULES, known: Sequence[str] = ()) -> list[Rule]:
    """Rules by rejections of what is left per second of new measures on the given sample; ties keep the given order."""
    if not texts:
        return list(rules)
    w = kernel.words(*kernel.text_buffers(pa.array(texts, pa.string())))
    have, cost = {}, {}
    for name in dict.fromkeys(x for r in rules for x in r.reads):
        began = time.perf_counter()
        have[name] = MEASURES[name](w)
        cost[name] = time.perf_counter() - began
    bad = {r.name: r.fails(have) for r in rules}
    left, alive, taken, out = list(rules), np.ones(len(texts), bool), set(known), []
    while left:
        rate = lambda r: float((bad[r.name] & alive).sum()) / (sum(cost[x] for x in r.reads if x not in taken) + 1e-6)
        best = max(left, key=rate)
        left.remove(best)
        out.append(best)
        taken |= set(best.reads)
        alive &= ~bad[best.name]
    return out


def sample_texts(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[str | None]:
    """A bounded sample to estimate on: the distinct texts of at most SAMPLE_BYTES that come first by hash, whole."""
    text = F.col(text_col)
    drawn = docs.filter(F.octet_length(text) <= SAMPLE_BYTES).select(text.alias("t"), F.xxhash64(text).alias("h"))
    last = drawn.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return []
    found = drawn.filter(F.col("h") <= last).groupBy("h").agg(F.min("t").alias("t")).collect()  # ``rows`` texts
    return [r["t"] for r in sorted(found, key=lambda r: r["h"])]


def quality_cascade(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: Sequence[Rule] = RULES,
    measures: Sequence[str] = (),
) -> DataFrame:
    """One row per document: id, kept, rules_run, base_failed and any of MEASURES asked for.

    Without ``measures`` a text is measured only as far as the cascade needs.
    """
    names = list(measures)
    ordered = order_rules(sample_texts(docs, text_col), rules, names)
    base = all(x in names for r in BASE_RULES for x in r.reads)
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, kept boolean, rules_run int" + "".join(f", {m} bigint" for m in names)
    schema += ", base_failed boolean" if base else ""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernel.text_buffers(batch.column(1))
            out: list[list[np.ndarray]] = []
            for lo, hi in kernel.chunks(offsets):
                w = kernel.words(data, offsets[lo : hi + 1])
                have = {m: MEASURES[m](w) for m in names}
                failed = np.logical_or.reduce([r.fails(have) for r in BASE_RULES]) if base else None
                if base:  # what the base rejects is not judged further
                    kept, ran = ~failed, np.zeros(hi - lo, np.int32)
                    k, r = run_cascade(_subset(w, ~failed), [r for r in ordered if r not in BASE_RULES], {m: v[~failed] for m, v in have.items()})
                    ran[~failed] = r
                    kept[np.flatnonzero(~failed)[~k]] = False
                else:
                    kept, ran = run_cascade(w, ordered, have)
                out.append([kept, ran, *have.values(), *([failed] if base else [])])
            if out:
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols)], names=[id_col, "kept", "rules_run", *names, *(["base_failed"] if base else [])])

    return docs.select(id_col, text_col).mapInArrow(lean(judge), schema)


def reject(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that pass every rule."""
    ordered = order_rules(sample_texts(docs, text_col), rules)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = kernel.text_buffers(b.column(at))
            kept = [run_cascade(kernel.words(data, offsets[lo : hi + 1]), ordered)[0] for lo, hi in kernel.chunks(offsets)]
            yield b.filter(pa.array(np.concatenate(kept) if kept else [], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
