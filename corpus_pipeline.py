"""The corpus pipeline: toxicity, quality rules, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) with the columns of ``documents`` and any
others, and all but the last return the same columns.

Cases, the same for all stages: a null or empty text is not toxic, fails the
quality rules, and has no shingles, no words and only an end id; a null id is
carried along, is no labelled example and no one's duplicate, and loses no words;
rows that repeat an id and text are judged one by one, and stay together, as one
document, where a stage compares documents; ties keep the smallest id; an empty
table gives an empty result; null values and names of other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgrain.llm import minhash, packing, quality, substring, toxicity
from newsgrain.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not call toxic."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality.reject(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group linked at 0.8 or more on five-word shingles."""
    gone = minhash.near_duplicates(docs, k=5, percent=80).filter("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words that an earlier 20-word window covers; untouched texts stay as they are, ``n_chars`` follows the text."""
    safe = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in safe.items()])
    rest = tuple(name for c, name in safe.items() if c not in ("doc_id", "text"))
    found = substring.remove_repeats(plain, safe["doc_id"], safe["text"], keep=rest, respace=False)
    after = {c: F.col(name) for c, name in safe.items()} | {"text": F.col("kept_text")}
    if "n_chars" in safe:
        kind = docs.schema["n_chars"].dataType
        after["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(kind)).otherwise(F.col(safe["n_chars"]))
    return found.select(*[after[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("best_fit_packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
