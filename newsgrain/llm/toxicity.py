"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams of ``SIZES`` of its
lower-cased words with their borders, hashed to ``2**BITS`` values.  From a
bounded sample of labelled texts the driver takes the log-count ratio of every
feature (Wang and Manning, 2012), keeps the ``FEATURES`` most telling ones, and
fits a logistic regression on presence times ratio.  The model is a table of
that fixed size, so it is broadcast whatever the corpus.

Scoring reads each text once, whole, in numpy; a text's score is the logistic
value of the sum of its distinct features' weights.

Cases: null and empty texts have no features and get the score of the
intercept; null labels are no examples; with no example of either class every
score is the share of toxic examples (0 without any); repeated rows are scored
one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgrain.llm import kernel
from newsgrain.llm.common import crc_of_id, cut, forget, lean

SIZES = (3, 4, 5, 6)
BITS = 20
#: Labelled texts of each class that the fit reads at most, drawn by hash.
SAMPLE_PER_CLASS = 2500
FEATURES = 30_000
#: Texts of a block of the fit; only one block's products are in memory at a time.
FIT_BLOCK = 500
THRESHOLD = 0.7
#: Tasks that count the sample's features; each sends one array of fixed size.
COUNTERS = 8
_FOLD = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 else i for i in range(0xD800)], np.uint32)
_FOLD[[9, 10, 11, 12, 13]] = 32


def ngrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For one n at a time: (text index, hashed feature) of every n-gram of the texts."""
    joined = [f" {t or ''} " for t in texts]
    code = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(code < len(_FOLD), _FOLD[np.minimum(code, len(_FOLD) - 1)], code)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in joined])
    p, inv = kernel._powers(kernel._BASE, len(code) + 1)
    acc = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(kernel.mix(code.astype(np.uint64) + np.uint64(77)) * p[: len(code)], out=acc[1:])
    for n in SIZES:
        m = len(code) - n + 1
        if m <= 0:
            continue
        ok = doc[n - 1 :] == doc[:m]
        h = kernel.mix((acc[n:] - acc[:-n]) * inv[:m] + np.uint64(n))
        yield doc[:m][ok], (h[ok] >> np.uint64(64 - BITS)).astype(np.int32)


def _groups(texts: list[str | None], size: int = 400_000, most: int = 128) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` characters and at most so many texts."""
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size or i + 1 - lo == most:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def features(text: str | None) -> np.ndarray:
    """The distinct features of one text."""
    parts = [f for _, f in ngrams([text])]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int32)


@dataclass
class Model:
    """weight: by feature, 0 where it is not used; bias: the intercept."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        used = np.flatnonzero(self.weight)
        place, weight, k = np.full(len(self.weight), -1, np.int32), self.weight[used].astype(np.float64), len(used)
        place[used] = np.arange(k)
        for lo, hi in _groups(texts) if k else ():
            held = np.zeros((hi - lo) * k, bool)  # which text holds which used feature
            for doc, f in ngrams(texts[lo:hi]):
                at = place[f]
                held[doc[at >= 0].astype(np.int64) * k + at[at >= 0]] = True
            at = np.flatnonzero(held)
            total[lo:hi] += np.bincount(at // k, weight[at % k], hi - lo)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def choose(pos: np.ndarray, neg: np.ndarray, n1: int, n0: int, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The most telling features and their log-count ratios, from the texts of each class that hold them."""
    ratio = np.log((pos + alpha) / (n1 + 2 * alpha)) - np.log((neg + alpha) / (n0 + 2 * alpha))
    spread = np.sqrt(1 / (pos + alpha) + 1 / (neg + alpha))
    telling = np.where(pos + neg >= 5, np.abs(ratio) / spread, 0)
    chosen = np.argsort(-telling, kind="stable")[:FEATURES]
    chosen = np.sort(chosen[telling[chosen] > 2])
    return chosen, ratio[chosen]


def fit(rows: list[np.ndarray], y: np.ndarray, chosen: np.ndarray, ratio: np.ndarray, prior: float, steps: int = 300, l2: float = 1e-4) -> Model:
    """Logistic regression by accelerated gradient steps; rows: each text's places in ``chosen``; prior: the true share of toxic texts."""
    weight = np.zeros(1 << BITS)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9))
        return Model(weight, float(np.log(share / (1 - share))))
    n, n1 = len(y), y.sum()
    blocks = []
    for lo in range(0, n, FIT_BLOCK):
        part = rows[lo : lo + FIT_BLOCK]
        blocks.append((slice(lo, lo + len(part)), np.repeat(np.arange(len(part), dtype=np.int16), [len(r) for r in part]), np.concatenate(part).astype(np.int32)))
    w, b = np.zeros(len(chosen)), 0.0
    per_doc = np.concatenate([np.bincount(doc, ratio[col] ** 2, at.stop - at.start) for at, doc, col in blocks])
    step = 4.0 / (per_doc.max() / 4 + per_doc.mean() + 1)
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        gw, gb, scaled = l2 * vw, 0.0, ratio * vw
        for at, doc, col in blocks:
            z = np.bincount(doc, scaled[col], at.stop - at.start) + vb
            err = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[at]) / n
            gw += ratio * np.bincount(col, err[doc], len(w))
            gb += err.sum()
        nw, nb = vw - step * gw, vb - step * gb
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    weight[chosen] = w * ratio
    prior = float(np.clip(prior, 1e-6, 1 - 1e-6))
    return Model(weight, float(b + np.log(prior / (1 - prior)) - np.log(n1 / (n - n1))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most SAMPLE_PER_CLASS labelled texts of each class whose id's crc32 modulo 3 is not 1.

    The sample's features stay in the shared folder; the driver gets their
    counts, two arrays of fixed size, and then each text's chosen features.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_y IN (0, 1)")
    known = known.filter(crc_of_id("_id") % 3 != 1).groupBy("_id").agg(F.max("_y").alias("_y"))
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    draw = F.pmod(F.xxhash64(F.col("_id"), F.lit(7)), F.lit(1 << 30))
    share = [min(1.0, 1.3 * SAMPLE_PER_CLASS / counts[y]) if counts.get(y) else 0.0 for y in (0, 1)]
    known = known.filter(draw < F.when(F.col("_y") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30))))
    place = F.row_number().over(Window.partitionBy("_y").orderBy(draw, "_id"))  # of a sample a little too large
    known = known.withColumn("_place", place).filter(F.col("_place") <= SAMPLE_PER_CLASS).drop("_place")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t.as_py()).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], names=["id", "y", "f"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros((2, 1 << BITS), np.int32), [0, 0]
        for b in batches:
            for y, f in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held[y][np.frombuffer(f.as_py(), np.int32)] += 1
                n[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([n[0]]), pa.array([n[1]]), pa.array([held.tobytes()], pa.binary())], names=["slot", "n0", "n1", "counts"])

    def merge(t: pa.Table) -> pa.Table:
        held = np.zeros(2 << BITS, np.int64)
        for x in t.column("counts"):
            held += np.frombuffer(x.as_py(), np.int32)
        return pa.table({"n0": [sum(t.column("n0").to_pylist())], "n1": [sum(t.column("n1").to_pylist())], "counts": pa.array([held.astype(np.int32).tobytes()], pa.binary())})

    id_type = known.schema["_id"].dataType.simpleString()
    drawn = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(known), "_id").select("_id", "_y", "_t")
    sample = cut(drawn.mapInArrow(lean(extract), f"id {id_type}, y int, f binary"), "features")
    sums = sample.select("y", "f").coalesce(COUNTERS).mapInArrow(lean(add_up), "slot bigint, n0 bigint, n1 bigint, counts binary").groupBy("slot").applyInArrow(merge, "n0 bigint, n1 bigint, counts binary").collect()
    chosen, ratio = np.zeros(0, np.int64), np.zeros(0)
    if sums and sums[0]["n0"] and sums[0]["n1"]:
        neg, pos = np.frombuffer(sums[0]["counts"], np.int32).reshape(2, -1)
        chosen, ratio = choose(pos, neg, sums[0]["n1"], sums[0]["n0"])
    del sums
    kept = docs.sparkSession.sparkContext.broadcast(chosen.astype(np.int32))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[kept.value] = np.arange(len(kept.value), dtype=np.int32)
        for b in batches:
            rows = [place[np.frombuffer(f.as_py(), np.int32)] for f in b.column(2)]
            places = [r[r >= 0].astype(np.uint16).tobytes() for r in rows]  # FEATURES are fewer than 2**16
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(places, pa.binary())], names=["id", "y", "f"])

    got = sample.mapInArrow(lean(pick), f"id {id_type}, y int, f binary").toArrow().sort_by("id")
    forget(sample)
    rows = [np.frombuffer(v.as_py(), np.uint16) for v in got.column("f")]
    return fit(rows, got.column("y").to_numpy().astype(float), chosen, ratio, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, any columns to keep, score, predicted) per row."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.bias))
    source = docs.select(id_col, *keep, text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shipped.value)
        for b in batches:
            s = m.scores(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*b.schema.names[:-1], "score", "predicted"])

    return source.mapInArrow(lean(run), f"{fields}, score double, predicted int")


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that are not predicted toxic."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.bias))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shipped.value)
        for b in batches:
            yield b.filter(pa.array(m.scores(b.column(at).to_pylist()) < THRESHOLD))

    return docs.mapInArrow(lean(run), docs.schema)
