"""Readers of the feeds (A2-A20): explicit schemas, no inference; paths may be anything Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgrain.functions.text import strip


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.text(path).first()[0].rstrip("\r").split("|")


def article_report(spark: SparkSession, path: str) -> DataFrame:
    """``|`` separated with a header that must start with article_Id (A2)."""
    names = _header(spark, path)
    if names[0] != "article_Id":
        raise ValueError("the report's header does not start with article_Id")
    return spark.read.csv(path, sep="|", header=True, schema=", ".join(f"`{n}` string" for n in names), quote="")


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots; the last two columns must be the totals (A2)."""
    names = _header(spark, path)
    if names[-2:] != ["statistic_FbTotal", "statistic_Tweets"]:
        raise ValueError("the statistics' last columns are not the totals")
    df = spark.read.csv(path, sep="|", header=True, schema=", ".join(f"`{n}` string" for n in names), quote="")
    return df.withColumns({"statistic_Date": iso_time(F.col("statistic_Date")), **{c: F.col(c).try_cast("bigint") for c in names[-2:]}})


def iso_time(x: Column) -> Column:
    """ISO time as UTC, with or without fraction and zone; null for blank."""
    s = F.nullif(strip(x), F.lit(""))
    forms = ("yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in forms])


def letter_bool(x: Column) -> Column:
    """True for a first letter T or a number other than 0, false for anything else or blank (A3)."""
    return F.coalesce(F.lower(x).startswith("t") | (F.coalesce(x.try_cast("int"), F.lit(0)) != 0), F.lit(False))


def sites(spark: SparkSession, path: str) -> DataFrame:
    """The site table (A3); a feed address equal to the site's is dropped."""
    names = ("site_Id", "site_Name", "site_Url", "site_RssUrl", "site_lastFetch", "site_healthStart", "site_isHealthy", "site_active")
    df = spark.read.csv(path, sep="|", header=True, schema=", ".join(f"{n} string" for n in names), quote="")
    return df.select(
        F.col("site_Id").try_cast("int").alias("id"), F.col("site_Name").alias("name"), F.col("site_Url").alias("url"), F.nullif("site_RssUrl", "site_Url").alias("rss_url"),
        iso_time(F.col("site_lastFetch")).alias("last_fetch"), iso_time(F.col("site_healthStart")).alias("health_start"), letter_bool(F.col("site_isHealthy")).alias("is_healthy"), letter_bool(F.col("site_active")).alias("active"),
    )


def article_list(spark: SparkSession, path: str) -> DataFrame:
    """id, when, url of lines that hold ``|http``, without carriage returns and fragments (A4)."""
    line = F.substring_index(F.regexp_replace("value", "\r", ""), "#", 1)
    rows = spark.read.text(path).filter(F.col("value").contains("|http")).select(F.split(line, r"\|", 3).alias("p"))
    return rows.select(F.col("p")[0].try_cast("bigint").alias("id"), iso_time(F.col("p")[1]).alias("when"), F.col("p")[2].alias("url")).filter("id IS NOT NULL")


RECORD = "og_object struct<id:string,title:string,url:string,type:string,description:string,created_time:string,updated_time:string>, share struct<share_count:bigint>"


def graph_responses(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``{url: record, ...}`` (A5, A6): one row per record, the last of a url wins; bad lines and null records go."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", r'"title":"http[^"]*",', "").alias("value"))
    each = lines.select("file", "line", F.explode(F.from_json("value", "map<string,string>")).alias("url", "raw")).filter("raw IS NOT NULL")
    rows = each.select("url", "file", "line", F.from_json("raw", RECORD).alias("r")).filter("r IS NOT NULL")
    return rows.groupBy("url").agg(F.max_by("r", F.struct("file", "line")).alias("r")).select(F.col("url").alias("_id"), "r.*")


def selector_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated rules; blank signatures and ``/`` are skipped."""
    df = spark.read.csv(path, sep="\t", header=True, schema="signature string, headline string, dateline string, byline string, body_text string")
    return df.filter("trim(signature) NOT IN ('', '/')").select("signature", *[F.col(f).alias(f"{f}_selector") for f in df.columns[1:]])


def hop_logs(spark: SparkSession, path: str) -> DataFrame:
    """Hops of ``.stat`` files (A8): name, line, code, url, mime; lines of other than three fields go."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.stat)?$", 1).alias("name"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return raw.select("name", "line", F.split("value", "\t").alias("p")).filter(F.size("p") == 3).select("name", "line", F.col("p")[0].alias("code"), F.col("p")[1].alias("url"), F.col("p")[2].alias("mime"))


def usable(pages: DataFrame, hops: DataFrame) -> DataFrame:
    """Pages whose last hop was a 200, or that have no hops."""
    last = hops.groupBy("name").agg(F.max_by("code", "line").alias("_code"))
    return pages.join(last, "name", "left").filter("_code IS NULL OR _code = '200'").drop("_code")


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with their site folder and name."""
    df = spark.read.format("binaryFile").load(path)
    return df.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("site"), F.regexp_extract("path", r"([^/]+?)(?:\.html)?$", 1).alias("name"), "content")


def patterns(spark: SparkSession, path: str) -> DataFrame:
    """Selector patterns: the first six columns."""
    return spark.read.csv(path, header=False, schema="name string, domain string, body string, title string, author string, date string", enforceSchema=True)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines numbered from 0 within their file, which is read in splits.

    Ids rise along a split, so a line's number is its place in the split and the
    lines of the file's splits before it; only one row per split is ranked.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    splits = raw.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return raw.join(splits.withColumn("_base", before), ["_path", "_block"]).select("file", (F.col("_base") + F.col("_id") - F.col("_first")).cast("int").alias("line"), "value")


def id_lines(spark: SparkSession, path: str, resume: str | None = None) -> DataFrame:
    """(pos, value) of distinct lines without comments, after a marker perhaps."""
    raw = lines(spark, path).select(F.col("line").alias("pos"), "value")
    rows = raw.filter("value <> '' AND NOT startswith(value, '#')").groupBy("value").agg(F.min("pos").alias("pos"))
    if resume is not None:
        at = rows.filter(F.col("value") == resume).agg(F.max("pos").alias("_at"))
        rows = rows.crossJoin(F.broadcast(at)).filter("_at IS NULL OR pos >= _at").drop("_at")
    return rows.select("pos", "value").orderBy("pos")


def histogram_csv(spark: SparkSession, path: str) -> DataFrame:
    """The histogram file of B7."""
    return spark.read.csv(path, header=True, schema="domain string, fb int, tw int, n bigint")


def grouped_lines(spark: SparkSession, path: str) -> DataFrame:
    """(group, pos, value): lines numbered by blank-line separated group."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n\\s*\n")).alias("group", "block"))
    return raw.select("group", F.posexplode(F.split("block", "\n")).alias("pos", "value")).filter("value <> ''")


def ngram_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="id string, ngram string, freq bigint", quote="")


def tagger_vertical(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width tagger rows cut at 8, 13, 21 and 46."""
    raw = lines(spark, path).select(F.col("file").alias("doc"), "line", F.col("value").alias("v")).filter("trim(v) <> ''")
    cut = lambda a, n: F.trim(F.substring("v", a, n))
    return raw.select("doc", "line", cut(1, 8).alias("para"), cut(9, 5).alias("tid"), cut(14, 8).alias("pos"), cut(22, 25).alias("norm"), cut(47, 1000).alias("sem"))


def timeml(spark: SparkSession, path: str) -> DataFrame:
    """Whole XML files as text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc"), F.col("value").alias("text"))


def extracted_json(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(filename, field) of extracted JSON files."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_name").alias("filename"), F.get_json_object("value", f"$.{key}").alias(key))


def feed_guard(size: int, age_days: float) -> None:
    """Refuse a weekly file that is too old, small or large."""
    if age_days > 5 or not 100 < size < 300_000_000:
        raise ValueError(f"feed refused: {size} bytes, {age_days:.1f} days old")
