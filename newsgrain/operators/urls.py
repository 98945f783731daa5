"""Frequencies, examples and co-occurrence of URL shapes and domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgrain.functions import url as U
from newsgrain.operators.ranges import written


def signature_months(df: DataFrame, url: str, when: str) -> DataFrame:
    """Rows per URL shape and month."""
    return df.groupBy(U.signature(F.col(url), "legacy").alias("signature"), F.date_format(when, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def grouped_examples(df: DataFrame, key: str, value: str, examples: int = 10) -> DataFrame:
    """Rows per key with up to ``examples`` values in hash order (D20); ranks are cut before rows of a key meet."""
    order = Window.partitionBy(key).orderBy(F.md5(F.col(value)), value)
    distinct = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    kept = distinct.select(key, value).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= examples)
    listed = kept.groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_list(value)).alias("examples"))
    totals = distinct.groupBy(key).agg(F.sum("_c").alias("n"))
    return totals.join(listed, F.col(key).eqNullSafe(F.col("_k"))).select(key, "n", "examples").orderBy(F.desc("n"), key)


def domain_pairs(df: DataFrame, domain: str, path: str, at_least: int) -> DataFrame:
    """Pairs of domains that share at least so many paths.

    The ``at_least`` - 1 paths of most domains are set apart: a pair that counts
    shares one of the others too, so only those are joined on the path, and a path
    of all domains makes no pairs.  The paths set apart are then counted for the
    pairs found, from each domain's list of them.
    """
    rows = written(df.select(F.col(domain).alias("d"), F.col(path).alias("p")).distinct())  # read four times
    most = rows.groupBy("p").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").orderBy(F.desc("c"), "p").limit(at_least - 1).select("p")
    rest = rows.join(most, "p", "left_anti")
    a, b = rest.alias("a"), rest.alias("b")
    met = a.join(b, (F.col("a.p") == F.col("b.p")) & (F.col("a.d") < F.col("b.d")))
    pairs = met.groupBy(F.col("a.d").alias("a"), F.col("b.d").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    common = rows.join(most, "p", "left_semi").groupBy("d").agg(F.collect_list("p").alias("ps"))  # at_least - 1 paths at most
    ca, cb = (common.select(F.col("d").alias(x), F.col("ps").alias(f"p{x}")) for x in "ab")
    every = pairs.join(ca, "a", "left").join(cb, "b", "left")
    n = F.col("n") + F.coalesce(F.size(F.array_intersect("pa", "pb")).cast("bigint"), F.lit(0))
    return every.select("a", "b", n.alias("n")).filter(F.col("n") >= at_least)


def substitutes(df: DataFrame, url: str, hosts: list[str]) -> DataFrame:
    """Each row with every substitute host in place of its own (E10); the hosts are a literal list."""
    hosts_col = F.explode(F.array(*[F.lit(h) for h in hosts]))
    return df.withColumn("host", hosts_col).withColumn("substitute", F.concat(F.lit("http://"), "host", F.lit("/"), U.without_host(F.col(url))))


def many_variants(df: DataFrame, key: str, variant: str, domain: str, at_least: int = 5, rows_limit: int = 1000, examples: int = 2) -> DataFrame:
    """Keys with many distinct variants, with the number of such keys in their domain and some examples."""
    distinct = df.select(key, variant, domain).distinct()
    sizes = distinct.groupBy(key, domain).agg(F.count(F.lit(1)).alias("n_variants")).filter(F.col("n_variants") >= at_least)
    totals = sizes.groupBy(F.col(domain).alias("_d")).agg(F.count(F.lit(1)).alias("n_domain"))
    shown = sizes.withColumn("_rank", F.row_number().over(Window.partitionBy(domain).orderBy(F.desc("n_variants"), key))).filter(F.col("_rank") <= rows_limit)
    first = distinct.join(shown.select(key, domain), [key, domain], "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy(key, domain).orderBy(variant))).filter(F.col("_r") <= examples)
    listed = first.groupBy(key, domain).agg(F.array_sort(F.collect_list(variant)).alias("examples"))
    return sizes.join(totals, F.col(domain) == F.col("_d")).drop("_d").join(listed, [key, domain], "left")


def equivalence(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, group): connected components of string pairs, named by their least member.

    Large-star and small-star steps (Kiveris et al., 2014) alternate until every
    node hangs on the least of its component, so long chains take few rounds; each
    round is written to the checkpoint folder, and only whether it is done reaches
    the driver.
    """
    links = written(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna())
    star = written(links.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    while not _flat(star):
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    nodes = links.select(F.col("x").alias("node")).unionByName(links.select(F.col("y").alias("node"))).distinct()
    return nodes.join(star.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("group"))


def _flat(star: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none."""
    degree = star.groupBy("u").agg(F.count(F.lit(1)).alias("c"))
    deeper = star.select(F.col("v").alias("u")).join(degree.select("u"), "u", "left_semi")
    return degree.filter("c > 1").select("u").unionByName(deeper).limit(1).count() == 0
