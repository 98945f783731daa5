"""Extraction diagnostics and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgrain.functions.text import flags


def flag_counts(df: DataFrame, fields: dict[str, tuple[str, ...]], keys: tuple[str, ...] = ("signature", "structure_group")) -> DataFrame:
    """Rows of the development sample and true flags per group."""
    cols = flags(fields)
    dev = df.filter("in_dev_sample").select(*keys, *[c.alias(n) for n, c in cols.items()])
    return dev.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_dev"), *[F.sum(n).alias(n) for n in cols])


def report(df: DataFrame, fields: dict[str, tuple[str, ...]], least_articles: int = 100, least_dev: int = 5) -> DataFrame:
    """D14 in percent of the sample, a row per flag, for signatures with enough articles and sampled ones."""
    counts = flag_counts(df, fields)
    articles = df.groupBy("signature").agg(F.count(F.lit(1)).alias("n_articles"))
    names = list(flags(fields))
    long = counts.unpivot(["signature", "structure_group", "n_dev"], names, "flag", "_v")
    kept = long.join(articles, "signature").filter((F.col("n_articles") >= least_articles) & (F.col("n_dev") >= least_dev))
    return kept.select("signature", "structure_group", "n_articles", "n_dev", "flag", (100.0 * F.col("_v") / F.col("n_dev")).alias("percent"))


def match_cube(df: DataFrame, group: str, which: str, matches: str) -> DataFrame:
    """Texts with 0, 1 and more matches at the four grouping levels (D17); a null selector only where it is not grouped."""
    m = F.col(matches)
    cube = df.cube(group, which).agg(F.grouping_id().cast("int").alias("level"), F.grouping(which).alias("_w"), F.count_if(m == 0).alias("none"), F.count_if(m == 1).alias("one"), F.count_if(m >= 2).alias("more"))
    return cube.filter((F.col("_w") == 1) | F.col(which).isNotNull()).drop("_w")


def column_filter(col: str, pattern: str | None = None, low: float | None = None, high: float | None = None) -> Column:
    """A report column's filter: case-insensitive regular expression, or a closed range (C17)."""
    c = F.lit(True)
    if pattern:
        c = c & F.col(col).cast("string").rlike(f"(?i){pattern}")
    if low is not None:
        c = c & (F.col(col) >= low)
    if high is not None:
        c = c & (F.col(col) <= high)
    return c
