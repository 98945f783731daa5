"""Filters, limits and status writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgrain.operators import ingest, quality
from newsgrain.plans.base import Book, table

BOOK = Book()
query, SQL = BOOK.query, BOOK.sql


@query
def sharing_valid(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    valid = ingest.sharing_valid(F.when(k % 3 == 0, k % 5), F.when(k % 2 == 0, k % 7), F.when(k % 11 == 0, F.lit(1)))
    return o.filter(valid).select("o_orderkey")


SQL["sharing_valid"] = """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 END AS f, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 END AS l, CASE WHEN o_orderkey % 11 = 0 THEN 1 END AS t FROM orders)
SELECT o_orderkey FROM o WHERE f > 0 OR (l > 0 AND l >= f) OR t > 0
"""


@query
def url_affixes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").filter(ingest.url_affixes(F.col("url"), "https://", ".html")).select("page_id", "url")


SQL["url_affixes"] = "SELECT page_id, url FROM pages WHERE starts_with(url, 'https://') AND ends_with(url, '.html')"


@query
def blacklist_hits(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return ingest.blacklisted(pages, pages.filter("page_id % 7 = 0").unionByName(pages.filter("page_id = 7")), "url").select("page_id", "blacklisted")


SQL["blacklist_hits"] = "SELECT page_id, url IN (SELECT url FROM pages WHERE page_id % 7 = 0) AS blacklisted FROM pages"


@query
def text_selection(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return ingest.selected(d, "tion", "text", exclude=["src0", "src1"], domain="source", least={"n_chars": 300}, longterm_valid=("doc_id", "n_chars")).select("doc_id", "source")


SQL["text_selection"] = "SELECT doc_id, source FROM documents WHERE contains(text, 'tion') AND source NOT IN ('src0', 'src1') AND n_chars >= 300 AND n_chars >= doc_id"


@query
def report_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter(quality.column_filter("p_brand", "BRAND.*1") & quality.column_filter("p_size", low=5, high=20)).select("p_partkey", "p_name", "p_size")


SQL["report_filter"] = "SELECT p_partkey, p_name, p_size FROM part WHERE regexp_matches(p_brand, '(?i)BRAND.*1') AND p_size BETWEEN 5 AND 20"


@query
def length_limits(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 9 > 0, F.col("text")).alias("title"))
    return ingest.within_limits(d, {"title": 1000}).select("doc_id")


SQL["length_limits"] = "SELECT doc_id FROM documents WHERE doc_id % 9 = 0 OR length(text) < 1000"


@query
def status_write(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.lit(200).alias("fetch_status"))
    gone = table(spark, sf, "labels").filter("quality = 0").select("doc_id")
    changed, left = ingest.set_status(d, table(spark, sf, "labels"), gone, "doc_id", -3)
    return changed.join(left.select("doc_id", F.lit(True).alias("kept")), "doc_id", "left").select("doc_id", "fetch_status", F.coalesce("kept", F.lit(False)).alias("kept"))


SQL["status_write"] = "SELECT d.doc_id, CAST(CASE WHEN quality = 0 THEN -3 ELSE 200 END AS INTEGER) AS fetch_status, coalesce(quality = 1, false) AS kept FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


@query
def error_codes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("error #"), (F.col("event_id") % 25).cast("string")).alias("message"))
    return e.select("event_id", ingest.error_code(F.col("message")).alias("code"))


SQL["error_codes"] = "SELECT event_id, CAST(substr(CAST(event_id % 25 AS VARCHAR), 1, 1) AS INTEGER) AS code FROM events"
