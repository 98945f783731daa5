"""Drill-down, histogram and statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgrain.functions import bins
from newsgrain.operators import stats
from newsgrain.plans.base import Book, table

BOOK = Book()
query, SQL = BOOK.query, BOOK.sql

EVENT_SHARES = "CAST(floor(value * 1000) AS BIGINT)"


def _shares(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("shares", F.floor(F.col("value") * 1000).cast("bigint"))


@query
def collection_domains(spark: SparkSession, sf: str) -> DataFrame:
    return stats.frequencies(table(spark, sf, "documents"), "source", "lang")


SQL["collection_domains"] = "SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2"


@query
def count_field(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").withColumn("selector", F.when(F.col("p_size") > 10, F.col("p_brand")))
    return stats.frequencies(parts, "selector")


SQL["count_field"] = "SELECT p_brand AS selector, count(*) AS n FROM part WHERE p_size > 10 AND p_brand IS NOT NULL GROUP BY 1"


@query
def distinct_domains(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/]*)", 1).alias("domain"))
    return stats.domains(pages, "domain")


SQL["distinct_domains"] = "SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS domain FROM pages WHERE contains(regexp_extract(url, '^[a-z]+://([^/]*)', 1), '.')"


@query
def collection_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as articles: totals binned by decade, with statistics and an example."""
    orders = table(spark, sf, "orders").withColumn("binned_shares", bins.bin_of(F.col("o_totalprice"), bins.COARSE))
    found = stats.bin_summary(orders, "binned_shares", "o_totalprice", "o_orderkey")
    return found.withColumn("mean", F.round("mean", 4))


SQL["collection_bins"] = """
SELECT CAST(len(list_filter([0,1,10,100,1000,10000,100000,1000000], lambda e: e < o_totalprice)) AS INTEGER) AS binned_shares,
  count(*) AS n, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS greatest, min(o_orderkey) AS example
FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1
"""


@query
def annotated_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = stats.group_stats(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice")
    return found.withColumn("mean", F.round("mean", 4))


SQL["annotated_stats"] = "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS greatest FROM orders GROUP BY 1"


@query
def coverage_cut(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("key", F.concat_ws("/", "source", "lang"))
    return stats.coverage(stats.frequencies(docs, "key"), "key", "n", 95.0).withColumn("covered", F.round("covered", 6))


SQL["coverage_cut"] = """
WITH f AS (SELECT source || '/' || lang AS key, count(*) AS n FROM documents GROUP BY 1),
c AS (SELECT key, n, 100.0 * sum(n) OVER (ORDER BY n DESC, key ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS covered FROM f),
p AS (SELECT *, coalesce(sum(CASE WHEN covered > 95.0 THEN 1 ELSE 0 END) OVER (ORDER BY n DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed FROM c)
SELECT key, n, round(covered, 6) AS covered FROM p WHERE passed <= 1
"""


@query
def coverage_share(spark: SparkSession, sf: str) -> DataFrame:
    counts = stats.frequencies(table(spark, sf, "documents").withColumn("key", F.concat_ws("/", "source", "lang")), "key")
    return stats.coverage_below(counts, "key", "n").withColumn("covered", F.round("covered", 6))


SQL["coverage_share"] = """
WITH f AS (SELECT source || '/' || lang AS key, count(*) AS n FROM documents GROUP BY 1),
c AS (SELECT key, n, sum(n) OVER (ORDER BY n DESC, key ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS covered FROM f)
SELECT key, n, round(covered, 6) AS covered FROM c WHERE covered <= 0.95
"""

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN NULL ELSE 404 END"


@query
def fetch_funnel(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumns({"status": F.expr(_STATUS), "dev": F.col("o_orderkey") % 7 == 0})
    return stats.funnel(orders, ["o_orderpriority"], "status", "dev")


SQL["fetch_funnel"] = f"""
SELECT o_orderpriority, count(*) AS n, count({_STATUS}) AS fetched,
  count(*) FILTER ({_STATUS} BETWEEN 200 AND 299) AS succeeded, count(*) FILTER (o_orderkey % 7 = 0) AS sampled
FROM orders GROUP BY 1
"""


@query
def share_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    found = stats.log_quantiles(_shares(spark, sf), "shares", [0.1, 0.5, 0.75, 0.9, 0.95, 0.99], ["event_type"], 3)
    return found.select("event_type", "n", *[F.round(c, 4).alias(c) for c in found.columns[2:]])


SQL["share_quantiles"] = f"""
SELECT event_type, count(*) AS n, {", ".join(f"round(exp(quantile_cont(ln({EVENT_SHARES}), {p / 100})), 4) AS p{p}" for p in (10, 50, 75, 90, 95, 99))}
FROM events WHERE {EVENT_SHARES} >= 3 GROUP BY 1
"""

_FINE = "[" + ",".join(map(str, bins.FINE)) + "]"


def _fine(x: str) -> str:
    return f"CAST(len(list_filter({_FINE}, lambda e: e < {x})) AS INTEGER)"


@query
def fine_histogram(spark: SparkSession, sf: str) -> DataFrame:
    binned = bins.with_bins(_shares(spark, sf), ["shares"], keep_null=False)
    hist = binned.groupBy(F.col("binned_shares").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    full = stats.gap_filled(hist, "bin", len(bins.FINE))
    return full.withColumns({"low": bins.bin_low(F.col("bin")).cast("bigint"), "high": bins.bin_high(F.col("bin")).cast("bigint"), "label": bins.bin_label(F.col("bin"))})


SQL["fine_histogram"] = f"""
WITH h AS (SELECT {_fine(EVENT_SHARES)} AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1),
r AS (SELECT CAST(i AS INTEGER) AS bin, CASE WHEN i = 0 THEN -1 ELSE {_FINE}[i] END AS low, {_FINE}[i + 1] AS high FROM range(69) r(i))
SELECT r.bin, coalesce(n, 0) AS n, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high,
  CASE WHEN high IN (0, 10, 100) OR (high = 1 AND r.bin = 1) THEN high || '' WHEN high IN (1000, 10000, 100000) THEN (high // 1000) || 'K' WHEN high = 1000000 THEN '1M' ELSE '' END AS label
FROM r LEFT JOIN h ON h.bin = r.bin
"""

_L2 = (_fine("CAST(floor(l_quantity) AS BIGINT)"), _fine("CAST(floor(l_extendedprice) AS BIGINT)"))


def _hist2d(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").withColumns({"fb": F.floor("l_quantity"), "tw": F.floor("l_extendedprice")})
    return stats.histogram2d(bins.with_bins(lines, ["fb", "tw"]), "l_returnflag", "binned_fb", "binned_tw")


@query
def hist2d(spark: SparkSession, sf: str) -> DataFrame:
    return _hist2d(spark, sf)


SQL["hist2d"] = f"SELECT l_returnflag, {_L2[0]} AS binned_fb, {_L2[1]} AS binned_tw, count(*) AS n FROM lineitem GROUP BY 1, 2, 3"


@query
def hist_marginal(spark: SparkSession, sf: str) -> DataFrame:
    return stats.marginal(_hist2d(spark, sf), "l_returnflag", "binned_fb", 2000)


SQL["hist_marginal"] = f"""
WITH m AS (SELECT l_returnflag, {_L2[0]} AS binned_fb, count(*) AS n FROM lineitem GROUP BY 1, 2),
t AS (SELECT *, sum(CASE WHEN binned_fb > 0 THEN n ELSE 0 END) OVER (PARTITION BY l_returnflag) AS m FROM m)
SELECT l_returnflag, binned_fb, n FROM t WHERE m >= 2000
"""


@query
def heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return stats.heat(_hist2d(spark, sf), "binned_fb", "binned_tw").withColumn("heat", F.round("heat", 6))


SQL["heatmap"] = f"SELECT binned_fb, binned_tw, round(ln(1 + count(*)), 6) AS heat FROM (SELECT {_L2[0]} AS binned_fb, {_L2[1]} AS binned_tw FROM lineitem) WHERE binned_fb >= 1 AND binned_tw >= 1 GROUP BY 1, 2"


@query
def log_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = stats.log_stats(_shares(spark, sf), "shares", ["event_type"])
    return found.select("event_type", "n", *[F.round(c, 6).alias(c) for c in found.columns[2:]])


SQL["log_stats"] = f"""
SELECT event_type, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd,
  round(avg(x) FILTER (s > 2), 6) AS trimmed_mean, round(stddev_pop(x) FILTER (s > 2), 6) AS trimmed_sd,
  round(quantile_disc(x, 0.25), 6) AS q1, round(quantile_disc(x, 0.5), 6) AS median, round(quantile_disc(x, 0.75), 6) AS q3
FROM (SELECT event_type, {EVENT_SHARES} AS s, CASE WHEN {EVENT_SHARES} > 0 THEN log10({EVENT_SHARES}) END AS x FROM events) GROUP BY 1
"""


@query
def kde_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return stats.kde_peaks(_shares(spark, sf), "shares").select(F.round("grid", 6).alias("grid"), F.round("density", 4).alias("density"))


SQL["kde_peaks"] = f"""
WITH x AS (SELECT round(log10({EVENT_SHARES}) * 1000) / 1000 AS x, count(*) AS w FROM events WHERE {EVENT_SHARES} > 0 GROUP BY 1),
d AS (SELECT g.i * (7.0::DOUBLE / 100) AS grid, sum(w * exp(-0.5 * pow((x - g.i * (7.0::DOUBLE / 100)) / 0.15, 2))) AS density FROM x, range(101) g(i) WHERE abs(x - g.i * (7.0::DOUBLE / 100)) <= 0.75 GROUP BY 1),
n AS (SELECT *, coalesce(lag(density) OVER (ORDER BY grid), 0) AS l, coalesce(lead(density) OVER (ORDER BY grid), 0) AS r FROM d)
SELECT round(grid, 6) AS grid, round(density, 4) AS density FROM n WHERE density > l AND density >= r
"""


@query
def share_density(spark: SparkSession, sf: str) -> DataFrame:
    """The density of the share counts at every point of its grid, and which points are maxima and minima."""
    from newsgrain.operators.ranges import written

    curve = written(stats.density(_shares(spark, sf), "shares"))
    marked = curve.join(stats.extrema(curve).select("grid", "kind"), "grid", "left")
    return marked.select(F.round("grid", 6).alias("grid"), F.round("density", 7).alias("density"), "kind")


SQL["share_density"] = f"""
WITH v AS (SELECT log10({EVENT_SHARES}) AS x FROM events WHERE {EVENT_SHARES} > 0),
s AS (SELECT count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h, max(x) AS m FROM v),
g AS (SELECT i, m * i / 999 AS grid, m * i / 999 / h AS p, h, n FROM s, range(1000) r(i)),
e AS (SELECT *, exp(-0.5 * p * p) / sqrt(2 * pi()) AS phi, CASE WHEN p > 8 THEN 1 ELSE 0.5 + exp(-0.5 * p * p) / sqrt(2 * pi()) * list_sum(list_transform(range(140), lambda k: pow(p, 2 * k + 1) / exp(lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)))) END AS a0 FROM g),
c AS (SELECT *, (a0 - p * phi) / (a0 * (a0 - p * phi) - phi * phi) AS a, phi / (a0 * (a0 - p * phi) - phi * phi) AS b FROM e),
x AS (SELECT round(x * 1000) / 1000 AS x, count(*) AS w FROM v GROUP BY 1),
d AS (SELECT c.i, c.grid, coalesce(sum(w * (a + b * (grid - x) / h) * exp(-0.5 * pow((grid - x) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 0) AS density FROM c LEFT JOIN x ON abs(x - grid) <= 8 * h GROUP BY 1, 2),
t AS (SELECT *, max(density) OVER l AS lx, min(density) OVER l AS ln, max(density) OVER r AS rx, min(density) OVER r AS rn FROM d WINDOW l AS (ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), r AS (ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))
SELECT round(grid, 6) AS grid, round(density, 7) AS density, CASE WHEN i < 10 OR i > 989 THEN NULL WHEN density >= lx AND density > rx THEN 'maximum' WHEN density <= ln AND density < rn THEN 'minimum' END AS kind FROM t
"""


@query
def period_filter(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").filter(stats.period("o_orderdate", "199512") | stats.period("o_orderdate", "1997"))
    return stats.frequencies(orders, "o_orderpriority")


SQL["period_filter"] = """
SELECT o_orderpriority, count(*) AS n FROM orders
WHERE (o_orderdate >= TIMESTAMP '1995-12-01' AND o_orderdate < TIMESTAMP '1996-01-01') OR (o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01') GROUP BY 1
"""


@query
def close_scrapes(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.filter(stats.close("l_shipdate", "o_orderdate", 7)).select("l_orderkey", "l_linenumber")


SQL["close_scrapes"] = """
SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE (l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 7 DAY) OR (o_orderdate >= l_shipdate AND o_orderdate < l_shipdate + INTERVAL 7 DAY)
"""


@query
def normalised_shares(spark: SparkSession, sf: str) -> DataFrame:
    return stats.normalised(_shares(spark, sf), "event_type", "shares").select("event_id", F.round("normalised", 6).alias("normalised"))


SQL["normalised_shares"] = f"""
WITH x AS (SELECT event_id, event_type, CASE WHEN {EVENT_SHARES} > 0 THEN log10({EVENT_SHARES}) END AS x FROM events)
SELECT event_id, round((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 6) AS normalised FROM x WINDOW w AS (PARTITION BY event_type)
"""
