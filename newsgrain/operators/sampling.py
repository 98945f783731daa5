"""Reproducible samples: hash order stands for random draws.

Ranks run over the rows that a count of hashes leaves (``ranges.lowest``) or
are cut by a literal number before the shuffle, so no group is sorted whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgrain.operators.ranges import lowest, quantiles


def hash_order(key: str, seed: int = 42) -> Column:
    """A reproducible random order that any SQL engine can repeat."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed)))


def stratified(df: DataFrame, key: str, stratum: str, n: int = 200, share: float = 0.5, seed: int = 42) -> DataFrame:
    """n rows: each stratum gets floor(n * share) // strata rows (1 at least) or all it has, the rest is drawn from what is left."""
    order = hash_order(key, seed)
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_rows"))
    strata = sizes.agg(F.count(F.lit(1)).alias("_k"))  # one row
    first = lowest(df, [stratum], order, key, F.greatest(F.floor(F.lit(int(n * share)) / F.col("_k")), F.lit(1)), sizes.drop("_rows").crossJoin(F.broadcast(strata)))
    more = df.orderBy(order, key).limit(n)  # what is left comes from the first n of all
    rest = more.join(first.select(key), key, "left_anti").select(*df.columns)
    both = first.withColumn("_rest", F.lit(0)).unionByName(rest.withColumn("_rest", F.lit(1)))
    return both.orderBy("_rest", order, key).limit(n).drop("_rest")


def top_groups(df: DataFrame, measure: str, key: str, cuts: Sequence[int]) -> DataFrame:
    """The rows ranked above the last cut, with the first cut each is above."""
    top = df.orderBy(F.desc(measure), key).limit(max(cuts))
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(measure), key)))
    group = F.coalesce(*[F.when(F.col("rank") <= c, F.lit(c)) for c in sorted(cuts)])
    return ranked.withColumn("top", group)


def top_per_group(df: DataFrame, group: str, measure: str, key: str, k: int) -> DataFrame:
    """The k greatest rows of each group."""
    w = Window.partitionBy(group).orderBy(F.desc(measure), key)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def undersample(df: DataFrame, group: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of each group as the smallest has."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
    least = sizes.agg(F.min("_rows").alias("_least"))  # one row
    return lowest(df, [group], hash_order(key, seed), key, F.col("_least"), sizes.drop("_rows").crossJoin(F.broadcast(least)))


def at_most(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Up to n rows of each group."""
    w = Window.partitionBy(group).orderBy(hash_order(key, seed), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def percent(df: DataFrame, group: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """A share of each group, rounded half up."""
    return lowest(df, [group], hash_order(key, seed), key, F.floor(F.col("_n") * share / 100 + 0.5))


def reservoir(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of all, in their own order."""
    return df.orderBy(hash_order(key, seed), key).limit(n).orderBy(key)


def sqrt_targets(sizes: DataFrame, domain: str, n: str, least: int = 2, per_domain: int = 200, per_group: int = 40) -> DataFrame:
    """Rows to draw per group: the least number and a share of the rest by square root of size (I4); a negative rate counts as 0."""
    w = Window.partitionBy(domain)
    floor_n = F.least(F.col(n), F.lit(least))
    rate = F.greatest((F.lit(per_domain) - F.sum(floor_n).over(w)) / F.sum(F.sqrt(n)).over(w), F.lit(0.0))
    return sizes.withColumn("target", F.least(floor_n + F.floor(F.sqrt(n) * rate), F.lit(per_group), F.col(n)).cast("bigint"))


def redraw(df: DataFrame, domain: str, group: str, key: str, seed: int = 42, **limits: int) -> DataFrame:
    """Rows of a new development sample by sqrt_targets; a null group is a stratum (I4)."""
    sizes = df.groupBy(domain, group).agg(F.count(F.lit(1)).alias("_n"))
    targets = sqrt_targets(sizes, domain, "_n", **limits).select(domain, group, "target")
    return lowest(df, [domain, group], hash_order(key, seed), key, F.col("target"), targets)


def bounded(df: DataFrame, bounds: DataFrame, domain: str, field: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Up to n rows per domain whose value lies within its (low, high]; a null high is open."""
    b = bounds.select(F.col(domain).alias("_d"), "low", "high")
    inside = df.join(b, (F.col(domain) == F.col("_d")) & (F.col(field) > F.col("low")) & (F.col("high").isNull() | (F.col(field) <= F.col("high")))).drop("_d")
    return at_most(inside, domain, key, n, seed)


def per_month(df: DataFrame, group: str, when: str, key: str, n: int, least: int = 30, seed: int = 42) -> DataFrame:
    """Up to n rows per group and month, for groups of at least so many rows."""
    enough = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(group)
    kept = df.join(enough, group, "left_semi").withColumn("month", F.date_format(when, "yyyy-MM"))
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy(group, "month").orderBy(hash_order(key, seed), key))).filter(F.col("_r") <= n).drop("_r")


def near_quantiles(df: DataFrame, field: str, key: str, points: Sequence[float], n: int, seed: int = 42) -> DataFrame:
    """For each point, n of the rows just above that quantile: the next 5 % in order, drawn by hash."""
    every = [*points, *(min(p + 0.05, 1.0) for p in points)]
    cuts = quantiles(df, [], F.col(field), every)  # one row
    spans = F.array(*[F.struct(F.lit(p).alias("point"), F.col(f"_q{i}").alias("low"), F.col(f"_q{i + len(points)}").alias("high")) for i, p in enumerate(points)])
    bounds = cuts.select(F.inline(spans))
    met = df.join(F.broadcast(bounds), (F.col(field) >= F.col("low")) & (F.col(field) <= F.col("high"))).drop("low", "high")
    return at_most(met, "point", key, n, seed)


def cell_examples(df: DataFrame, cell: Sequence[str], value: str, seed: int = 42) -> DataFrame:
    """A random example of each histogram cell in the pass that counts it."""
    return df.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.min_by(value, F.struct(hash_order(value, seed), F.col(value))).alias("example"))
