"""Frequencies, statistics, quantiles and histograms of share counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgrain.operators.ranges import quantiles, running, written


def frequencies(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows per key, most frequent first; null keys do not count."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), *keys)


def group_stats(df: DataFrame, keys: Sequence[str], field: str) -> DataFrame:
    """Count, mean, least and greatest value per group (D3)."""
    x = F.col(field)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("greatest"))


def domains(df: DataFrame, col: str) -> DataFrame:
    """The distinct domains, sorted."""
    return df.filter(F.col(col).contains(".")).select(col).distinct().orderBy(col)


def bin_summary(df: DataFrame, bin_col: str, field: str, example: str) -> DataFrame:
    """D3 by bin in order of the least value, with the smallest key of the bin as example."""
    stats = df.dropna(subset=[bin_col]).groupBy(bin_col)
    x = F.col(field)
    return stats.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("greatest"), F.min(example).alias("example")).orderBy("least")


def _covered(df: DataFrame, key: str, count: str) -> DataFrame:
    """Rows with the sum of all counts that come before theirs in falling order, and of all; by ranges, so keys of any number."""
    total = df.agg(F.sum(count).alias("_total"))  # one row
    return running(df, [], [F.desc(count), key], {"_before": F.col(count)}).crossJoin(F.broadcast(total))


def coverage(df: DataFrame, key: str, count: str, percent: float = 99.9) -> DataFrame:
    """Running share of the total by falling count, down to one row past the first that exceeds ``percent`` (F1).

    The input is one row per key, already aggregated.
    """
    rows = written(_covered(df, key, count).withColumn("covered", 100.0 * (F.col("_before") + F.col(count)) / F.col("_total")).drop("_before", "_total"))
    beyond = rows.filter(F.col("covered") > percent).orderBy(F.desc(count), key).limit(2)
    return rows.filter(F.col("covered") <= percent).unionByName(beyond)


def coverage_below(df: DataFrame, key: str, count: str, share: float = 0.95) -> DataFrame:
    """Rows by falling count while the running share stays within ``share`` (F2)."""
    covered = (F.col("_before") + F.col(count)) / F.col("_total")
    return _covered(df, key, count).withColumn("covered", covered).filter(F.col("covered") <= share).drop("_before", "_total")


def log_quantiles(df: DataFrame, field: str, points: Sequence[float], keys: Sequence[str] = (), min_count: float = 0) -> DataFrame:
    """exp of the exact quantiles of ln(field) over values above ``min_count`` (at least above 0), and their number."""
    x = F.col(field)
    kept = df.filter((x > 0) & (x >= min_count))
    q = quantiles(kept, keys, F.log(x), points)
    return q.select(*keys, F.col("_n").alias("n"), *[F.exp(f"_q{i}").alias(f"p{round(100 * p)}") for i, p in enumerate(points)])


def histogram2d(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Rows per key and pair of bins, both known."""
    return df.dropna(subset=[a, b]).groupBy(key, a, b).agg(F.count(F.lit(1)).alias("n"))


def marginal(hist: DataFrame, key: str, bin_col: str, min_samples: int, n: str = "n") -> DataFrame:
    """One bin's distribution from a 2-D histogram, for keys with enough rows above bin 0."""
    per = hist.groupBy(key, bin_col).agg(F.sum(n).alias(n))
    enough = per.withColumn("_m", F.sum(F.when(F.col(bin_col) > 0, F.col(n)).otherwise(0)).over(Window.partitionBy(key)))
    return enough.filter(F.col("_m") >= min_samples).drop("_m")


def heat(hist: DataFrame, a: str, b: str, n: str = "n") -> DataFrame:
    """ln(1 + n) per pair of bins from 1 on."""
    return hist.filter((F.col(a) >= 1) & (F.col(b) >= 1)).groupBy(a, b).agg(F.log1p(F.sum(n)).alias("heat"))


def gap_filled(hist: DataFrame, bin_col: str, bins: int, n: str = "n") -> DataFrame:
    """Every bin from 0 to ``bins``, with 0 where the histogram has none."""
    every = hist.sparkSession.range(bins + 1).select(F.col("id").cast("int").alias(bin_col))
    return every.join(hist, bin_col, "left").select(bin_col, F.coalesce(n, F.lit(0)).cast("bigint").alias(n))


def log_stats(df: DataFrame, field: str, keys: Sequence[str] = (), trim: float = 2) -> DataFrame:
    """Mean and population deviation of log10 counts, whole and above ``trim``, and the quartiles by rank."""
    x = F.log10(F.when(F.col(field) > 0, F.col(field)))
    kept = F.when(F.col(field) > trim, x)
    moments = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.avg(kept).alias("trimmed_mean"), F.stddev_pop(kept).alias("trimmed_sd")
    )
    ranks = quantiles(df, keys, x, (0.25, 0.5, 0.75), discrete=True)
    same = [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys] or F.lit(True)
    out = moments.join(ranks, same, "left")
    return out.select(*[F.col(f"_{k}").alias(k) for k in keys], "n", "mean", "sd", "trimmed_mean", "trimmed_sd", F.col("_q0").alias("q1"), F.col("_q1").alias("median"), F.col("_q2").alias("q3"))


#: Values are counted at this part of a decade before a density is taken of them; beyond so many bandwidths a kernel counts as nothing.
FINE, REACH = 1000, 8


def _boundary(p: float) -> tuple[float, float]:
    """(a, b) of the kernel (a + b z) phi(z) that a boundary p bandwidths below leaves unbiased: a Gaussian times a line (Jones, 1993)."""
    phi, whole = math.exp(-0.5 * p * p) / math.sqrt(2 * math.pi), 0.5 * (1 + math.erf(p / math.sqrt(2)))
    a0, a1, a2 = whole, -phi, whole - p * phi
    scale = a0 * a2 - a1 * a1
    return a2 / scale, -a1 / scale


def density(df: DataFrame, field: str, points: int = 1000) -> DataFrame:
    """(grid, density) of log10 counts above 0, corrected at the boundary 0, on a grid up to the greatest value.

    The bandwidth is Scott's, from the number and deviation of all values.  Values
    are counted at a thousandth of a decade first, so the join with the grid meets
    a bounded number of rows whatever the input.
    """
    spark = df.sparkSession
    x = df.filter(F.col(field) > 0).select(F.log10(field).alias("x"))
    n, deviation, most = x.agg(F.count("x"), F.stddev_samp("x"), F.max("x")).first()
    schema = "grid double, a double, b double"
    if not n or not deviation:
        return spark.createDataFrame([], "grid double, density double")
    h = deviation * n**-0.2
    grid = spark.createDataFrame([(most * i / (points - 1), *_boundary(most * i / (points - 1) / h)) for i in range(points)], schema)
    counts = x.groupBy((F.round(F.col("x") * FINE) / FINE).alias("x")).agg(F.count(F.lit(1)).alias("w"))
    z = (F.col("grid") - F.col("x")) / h
    met = counts.join(F.broadcast(grid), F.abs(F.col("x") - F.col("grid")) <= REACH * h)
    kernel = (F.col("a") + F.col("b") * z) * F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    found = met.groupBy("grid").agg((F.sum(F.col("w") * kernel) / (n * h)).alias("density"))
    return grid.select("grid").join(found, "grid", "left").select("grid", F.coalesce("density", F.lit(0.0)).alias("density"))


def extrema(curve: DataFrame, lookahead: int = 10) -> DataFrame:
    """(grid, density, kind): points above (``maximum``) or below (``minimum``) all of the ``lookahead`` points on either side (D13); equal ones to the left count, and the ends are none."""
    w = Window.orderBy("grid")  # the points of one curve
    before, after = w.rowsBetween(-lookahead, -1), w.rowsBetween(1, lookahead)
    y = F.col("density")
    full = (F.count(F.lit(1)).over(before) == lookahead) & (F.count(F.lit(1)).over(after) == lookahead)
    kind = F.when((y >= F.max(y).over(before)) & (y > F.max(y).over(after)), "maximum").when((y <= F.min(y).over(before)) & (y < F.min(y).over(after)), "minimum")
    return curve.withColumn("kind", F.when(full, kind)).filter("kind IS NOT NULL")


def kde_peaks(df: DataFrame, field: str, points: int = 101, bandwidth: float = 0.15) -> DataFrame:
    """Peaks of a Gaussian density of log10 counts on a fixed grid (D13): (grid, density).

    Values are counted at a thousandth of a decade first, so the join with the
    grid meets a bounded number of rows whatever the input.
    """
    spark = df.sparkSession
    x = df.filter(F.col(field) > 0).select((F.round(F.log10(field) * 1000) / 1000).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("w"))
    grid = spark.range(points).select((F.col("id") * (7.0 / (points - 1))).alias("grid"))
    near = x.join(F.broadcast(grid), F.abs(F.col("x") - F.col("grid")) <= 5 * bandwidth)
    dens = near.groupBy("grid").agg(F.sum(F.col("w") * F.exp(-0.5 * F.pow((F.col("x") - F.col("grid")) / bandwidth, 2))).alias("density"))
    w = Window.orderBy("grid")
    around = dens.withColumns({"_l": F.coalesce(F.lag("density").over(w), F.lit(0.0)), "_r": F.coalesce(F.lead("density").over(w), F.lit(0.0))})
    return around.filter((F.col("density") > F.col("_l")) & (F.col("density") >= F.col("_r"))).drop("_l", "_r")


def period(col: str, spec: str) -> Column:
    """Half-open range of a year ``YYYY`` or month ``YYYYMM`` (C4)."""
    year, month = int(spec[:4]), int(spec[4:6]) if len(spec) > 4 else None
    low = f"{year}-{month or 1:02d}-01"
    start = F.to_timestamp(F.lit(low))
    stop = F.add_months(F.lit(low).cast("date"), 1 if month else 12).cast("timestamp")
    return (F.col(col) >= start) & (F.col(col) < stop)


def close(a: str, b: str, days: int = 1) -> Column:
    """Whether two times lie less than ``days`` apart, either way."""
    x, y, d = F.col(a), F.col(b), F.expr(f"INTERVAL {days} DAYS")
    return ((x >= y) & (x < y + d)) | ((y >= x) & (y < x + d))


def funnel(df: DataFrame, keys: Sequence[str], status: str, sampled: str | None = None) -> DataFrame:
    """Rows, fetched, successful and sampled rows per group."""
    s = F.col(status)
    extra = [F.count_if(F.col(sampled)).alias("sampled")] if sampled else []
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(s).alias("fetched"), F.count_if(s.between(200, 299)).alias("succeeded"), *extra)


def normalised(df: DataFrame, key: str, field: str) -> DataFrame:
    """log10 counts centred and scaled within a group."""
    x = F.log10(F.when(F.col(field) > 0, F.col(field)))
    moments = df.groupBy(F.col(key).alias("_k")).agg(F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_sd"))
    joined = df.join(moments, F.col(key).eqNullSafe(F.col("_k")), "left")
    return joined.withColumn("normalised", F.when(F.col("_sd") > 0, (x - F.col("_mean")) / F.col("_sd"))).drop("_k", "_mean", "_sd")
