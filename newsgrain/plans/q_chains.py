"""Redirect chains over the pages' addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgrain.operators import redirects, survey
from newsgrain.plans import q_ingest
from newsgrain.plans.base import Book, table

BOOK = Book()
query, SQL = BOOK.query, BOOK.sql

#: What stands in for the answers of servers: rings, lines and leaps between the pages, some with errors or long delays.
_TARGET = "CASE WHEN page_id // 10 % 3 = 0 THEN page_id // 10 * 10 + (page_id + 1) % 10 WHEN page_id // 10 % 3 = 1 THEN page_id + 1 ELSE (page_id * page_id + 1) % n END"
_STATUS = "CASE WHEN page_id % 37 = 36 THEN 404 ELSE 200 END"
_DELAY = "CASE WHEN page_id % 41 = 40 THEN 30 ELSE page_id % 21 END"


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    """(url, status, header, content): a Refresh header for pages of even number, a meta element for the others; one answer an address."""
    spark_sql = lambda text: F.expr(text.replace("//", "DIV"))
    pages = table(spark, sf, "pages")
    known = pages.select("page_id", "url")
    size = known.agg((F.max("page_id") + 1).alias("n"))  # one row
    dealt = known.groupBy("url").agg(F.min("page_id").alias("page_id")).crossJoin(F.broadcast(size)).withColumns({"target": spark_sql(_TARGET), "status": spark_sql(_STATUS), "delay": spark_sql(_DELAY)})
    short = F.when(F.split_part("link", F.lit(":"), F.lit(1)) == F.split_part("url", F.lit(":"), F.lit(1)), F.regexp_replace("link", "^[a-z]+:", "")).otherwise(F.col("link"))
    answers = dealt.join(known.select(F.col("page_id").alias("target"), F.col("url").alias("link")), "target", "left").withColumn("refresh", F.concat(F.col("delay").cast("string"), F.lit("; URL="), short))
    linked = answers.join(pages.select("page_id", "html"), "page_id")
    refresh = F.col("refresh")
    meta = F.concat(F.lit('<meta http-equiv="refresh" content="'), F.replace(refresh, F.lit("&"), F.lit("&amp;")), F.lit('">'), "html")
    even = F.col("page_id") % 2 == 0
    return linked.select("url", "page_id", "status", F.when(even, refresh).alias("header"), F.when(even | F.col("link").isNull(), F.col("html")).otherwise(meta).alias("content"))


@query
def redirect_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Every hop of every address, and why the walk ends."""
    known = redirects.steps(_responses(spark, sf), "url", "status", "header", "content")
    hops = redirects.chains(known.select("url", "next", "stop", "status", "delay"), known.select("url"))
    return hops.select("start", "hop", "url", "status", F.when(F.col("status") < 400, F.col("delay")).alias("delay"), "stop")


_WALK = f"""
RECURSIVE f AS (SELECT min(page_id) AS page_id, url FROM pages GROUP BY url),
r AS (SELECT page_id, url, {_TARGET} AS target, {_STATUS} AS status, {_DELAY} AS delay FROM f, (SELECT max(page_id) + 1 AS n FROM pages)),
s AS (SELECT r.*, p.url AS link, CASE WHEN status >= 400 THEN 'error' WHEN p.url IS NULL THEN 'end' WHEN delay > 20 THEN 'delay' END AS why FROM r LEFT JOIN pages p ON p.page_id = r.target),
walk AS (
  SELECT url AS start, 0 AS hop, url, [url] AS seen FROM s
  UNION ALL
  SELECT start, hop + 1, s.link, list_append(seen, s.link) FROM walk JOIN s USING (url) WHERE s.why IS NULL AND NOT list_contains(seen, s.link)),
ends AS (SELECT start, max(hop) AS last FROM walk GROUP BY 1),
hops AS (
  SELECT start, hop, url, CAST(status AS INTEGER) AS status, CAST(CASE WHEN status < 400 AND link IS NOT NULL THEN delay END AS INTEGER) AS delay, CASE WHEN hop = last THEN coalesce(why, 'loop') END AS stop
  FROM walk JOIN s USING (url) JOIN ends USING (start))"""
SQL["redirect_chains"] = f"WITH {_WALK} SELECT start, hop, url, status, delay, stop FROM hops"


@query
def redirect_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Where every address leads, after how many hops."""
    known = redirects.steps(_responses(spark, sf), "url", "status", "header", "content")
    return redirects.outcomes(redirects.chains(known.select("url", "next", "stop"), known.select("url")))


SQL["redirect_outcomes"] = f"WITH {_WALK} SELECT start, CAST(count(*) AS INTEGER) AS hops, max_by(url, hop) AS final, max_by(stop, hop) AS stop FROM hops GROUP BY 1"


@query
def survey_table(spark: SparkSession, sf: str) -> DataFrame:
    """Survey rows of all pages: a third end at a longer address, some name a canonical one, some have no hops, date or html."""
    i, u = F.col("page_id"), F.col("url")
    pages = table(spark, sf, "pages")
    longer = F.when(i % 3 == 0, F.concat(u, F.when(u.contains("?"), "&").otherwise("?"), F.lit("b=x y&a=~1"))).otherwise(u)
    old = F.regexp_replace("url", r"^https?://([^/]*)/", "http://www.$1/old/")
    hops = F.explode(F.array(F.struct(F.lit(0).alias("line"), F.lit("301").alias("code"), old.alias("url"), F.lit("-").alias("mime")), F.struct(F.lit(1).alias("line"), F.lit("200").alias("code"), F.when(i % 2 == 0, longer).otherwise(old).alias("url"), F.lit("text/html").alias("mime"))))
    logged = pages.filter(i % 11 != 0).select(i.alias("id"), hops.alias("h")).select("id", "h.*")
    link = F.concat(F.lit('<link rel="canonical" href="'), longer, F.lit('">'))
    bodies = pages.select(i.alias("id"), F.when(i % 13 != 0, F.concat(F.lit(" "), F.when((i % 2 == 1) & (i % 4 == 1), link).otherwise(""), "html")).alias("html"))
    dates = pages.filter(i % 5 != 0).select(i.alias("id"), F.date_format(F.date_add(F.lit("2014-01-01").cast("date"), i.cast("int") % 90), "yyyy-MM-dd").alias("date"))
    return survey.full_survey_rows(logged, bodies, dates)


_OLD = r"regexp_replace(url, '^https?://([^/]*)/', 'http://www.\1/old/')"
_LONGER = "CASE WHEN page_id % 3 = 0 THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'b=x y&a=~1' ELSE url END"


def _signed(url: str) -> str:
    """The legacy shape of an address in SQL."""
    shape = f"{q_ingest._DOMAIN} || {q_ingest._SHAPE} || '?' || {q_ingest._Q}"
    return f"(SELECT page_id, {shape} AS sig FROM (SELECT page_id, {url} AS url FROM pages))"


SQL["survey_table"] = f"""
WITH b AS (SELECT page_id, {_OLD} AS old, {_LONGER} AS longer, page_id % 11 <> 0 AS hop, page_id % 2 = 0 OR (page_id % 4 = 1 AND page_id % 13 <> 0) AS moved, page_id % 4 = 1 AND page_id % 13 <> 0 AS linked,
  CASE WHEN page_id % 13 <> 0 THEN length(regexp_replace(' ' || CASE WHEN page_id % 4 = 1 THEN '<link rel="canonical" href="' || {_LONGER} || '">' ELSE '' END || html, '(?s)<!--.*?-->', '', 'g')) - 1 END AS n FROM pages),
d AS ({q_ingest.SQL["url_diff"]}), os AS {_signed(_OLD)}, ls AS {_signed(_LONGER)},
h AS (SELECT b.*, regexp_extract(old, '^[a-z]+://[^/?#]*?([^./?#]+\\.[^./?#]+)(?:[/?#]|$)', 1) AS dom, CASE WHEN page_id % 2 = 0 THEN longer ELSE old END AS last FROM b)
SELECT h.page_id AS id, CASE WHEN h.page_id % 5 <> 0 THEN strftime(DATE '2014-01-01' + CAST(h.page_id % 90 AS INTEGER), '%Y-%m-%d') ELSE '-' END AS date,
  CASE WHEN hop THEN old ELSE '-' END AS start_url, CASE WHEN hop THEN dom ELSE '-' END AS start_domain, CASE WHEN hop THEN os.sig ELSE '-' END AS start_sig,
  CASE WHEN NOT hop THEN '-' WHEN moved THEN difference ELSE '<same>' END AS end_url, CASE WHEN hop OR linked THEN dom ELSE '-' END AS end_domain,
  CASE WHEN linked THEN ls.sig WHEN NOT hop THEN '-' WHEN moved THEN ls.sig ELSE os.sig END AS end_sig,
  CASE WHEN NOT hop THEN '-' WHEN length(last) - length(replace(last, '/', '')) <= 3 AND NOT contains(last, '?') THEN '200?' ELSE '200' END AS status, CASE WHEN hop THEN 'text/html' ELSE '-' END AS mime, coalesce(CAST(n AS VARCHAR), '-') AS length
FROM h LEFT JOIN d ON d.page_id = h.page_id JOIN os ON os.page_id = h.page_id JOIN ls ON ls.page_id = h.page_id
"""
