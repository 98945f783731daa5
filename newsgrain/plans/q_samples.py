"""Sampling, text and diagnostics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgrain.functions import html as H
from newsgrain.functions import text as X
from newsgrain.operators import quality, ranges, sampling
from newsgrain.plans.base import Book, table

BOOK = Book()
query, SQL = BOOK.query, BOOK.sql


def _md5(key: str) -> str:
    return f"md5({key} || ':42')"


@query
def topn_groups(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.top_groups(table(spark, sf, "orders"), "o_totalprice", "o_orderkey", [50, 200, 1000]).select("o_orderkey", "rank", "top")


SQL["topn_groups"] = """
SELECT o_orderkey, CAST(r AS INTEGER) AS rank, CASE WHEN r <= 50 THEN 50 WHEN r <= 200 THEN 200 ELSE 1000 END AS top
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 1000
"""


@query
def topk_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.top_per_group(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey", 5).select("o_orderpriority", "o_orderkey", "rank")


SQL["topk_per_group"] = "SELECT o_orderpriority, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 5"


@query
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang", 200)


SQL["stratified_sample"] = f"""
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_md5("doc_id")}, doc_id) AS r, (SELECT count(DISTINCT lang) FROM documents) AS k FROM documents)
SELECT doc_id, lang FROM r ORDER BY CASE WHEN r <= greatest(100 // k, 1) THEN 0 ELSE 1 END, {_md5("doc_id")}, doc_id LIMIT 200
"""


@query
def undersample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.undersample(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id")


_RANKED = f"SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_md5('doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents"
SQL["undersample"] = f"SELECT doc_id, lang FROM ({_RANKED}) WHERE r <= (SELECT min(c) FROM (SELECT count(*) AS c FROM documents GROUP BY lang))"


@query
def percent_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.percent(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 12.5)


SQL["percent_sample"] = f"SELECT doc_id, lang FROM ({_RANKED}) WHERE r <= floor(n * 12.5 / 100 + 0.5)"


@query
def reservoir_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.reservoir(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 150)


SQL["reservoir_sample"] = f"SELECT doc_id, lang FROM documents ORDER BY {_md5('doc_id')}, doc_id LIMIT 150"


@query
def sqrt_allocation(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return sampling.sqrt_targets(sizes, "source", "n", 2, 20, 8)


SQL["sqrt_allocation"] = """
WITH s AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2),
r AS (SELECT *, least(n, 2) AS f, greatest((20 - sum(least(n, 2)) OVER w) / sum(sqrt(n)) OVER w, 0.0) AS rate FROM s WINDOW w AS (PARTITION BY source))
SELECT source, lang, n, CAST(least(f + floor(sqrt(n) * rate), 8, n) AS BIGINT) AS target FROM r
"""


@query
def dev_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.redraw(table(spark, sf, "documents").select("doc_id", "source", "lang"), "source", "lang", "doc_id", least=2, per_domain=20, per_group=8)


SQL["dev_sample"] = f"""
WITH t AS ({SQL["sqrt_allocation"]}), r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY {_md5("doc_id")}, doc_id) AS r FROM documents)
SELECT doc_id, r.source, r.lang FROM r JOIN t ON t.source = r.source AND t.lang IS NOT DISTINCT FROM r.lang WHERE r <= target
"""


@query
def bounded_sample(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    bounds = ranges.quantiles(events, ["event_type"], F.col("value"), [0.5, 0.9]).select("event_type", F.col("_q0").alias("low"), F.col("_q1").alias("high"))
    return sampling.bounded(events, bounds, "event_type", "value", "event_id", 25).select("event_id", "event_type")


SQL["bounded_sample"] = f"""
WITH b AS (SELECT event_type, quantile_cont(value, 0.5) AS low, quantile_cont(value, 0.9) AS high FROM events GROUP BY 1)
SELECT event_id, e.event_type FROM events e JOIN b ON b.event_type = e.event_type AND value > low AND value <= high
QUALIFY row_number() OVER (PARTITION BY e.event_type ORDER BY {_md5("event_id")}, event_id) <= 25
"""


@query
def monthly_sample(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return sampling.per_month(orders, "o_orderpriority", "o_orderdate", "o_orderkey", 3).select("o_orderkey", "o_orderpriority", "month")


SQL["monthly_sample"] = f"""
WITH o AS (SELECT o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey, o_orderpriority, month FROM o WHERE n >= 30 QUALIFY row_number() OVER (PARTITION BY o_orderpriority, month ORDER BY {_md5("o_orderkey")}, o_orderkey) <= 3
"""


@query
def quantile_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.near_quantiles(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", [0.25, 0.75, 0.95], 10).select("point", "o_orderkey")


SQL["quantile_neighbours"] = f"""
WITH b AS (SELECT CAST(p AS DOUBLE) AS point, (SELECT quantile_cont(o_totalprice, 0.25) FROM orders) AS low, (SELECT quantile_cont(o_totalprice, 0.3) FROM orders) AS high FROM (SELECT 0.25 AS p)
  UNION ALL SELECT 0.75::DOUBLE, (SELECT quantile_cont(o_totalprice, 0.75) FROM orders), (SELECT quantile_cont(o_totalprice, 0.8) FROM orders)
  UNION ALL SELECT 0.95::DOUBLE, (SELECT quantile_cont(o_totalprice, 0.95) FROM orders), (SELECT max(o_totalprice) FROM orders))
SELECT point, o_orderkey FROM orders JOIN b ON o_totalprice BETWEEN low AND high QUALIFY row_number() OVER (PARTITION BY point ORDER BY {_md5("o_orderkey")}, o_orderkey) <= 10
"""


@query
def histogram_examples(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.cell_examples(table(spark, sf, "part"), ["p_brand", "p_size"], "p_partkey")


SQL["histogram_examples"] = f"SELECT p_brand, p_size, count(*) AS n, arg_min(p_partkey, {_md5('p_partkey')}) AS example FROM part GROUP BY 1, 2"


@query
def compress_html(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(H.compress(F.col("html"))).alias("digest"), F.length(H.compress(F.col("html"))).alias("chars"))


_COMPRESS = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\b.*?>|<style\b.*?</style\b.*?>|<iframe\b.*?</iframe\b.*?>', '', 'g'), '[ \t]*(\n)[ \t]*(\n?)[ \t\n\x0B\f\r]*', '\1\2', 'g'), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"""
SQL["compress_html"] = f"SELECT page_id, md5({_COMPRESS}) AS digest, CAST(length({_COMPRESS}) AS INTEGER) AS chars FROM pages"


@query
def html_word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.word_count(F.col("html")).alias("words"))


SQL["html_word_counts"] = r"SELECT page_id, CAST(len(list_filter(regexp_split_to_array(html, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS INTEGER) AS words FROM pages"


@query
def full_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    whole = X.full_text(F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("  "), "source", F.lit(" \n"))), F.when(F.col("doc_id") % 5 > 0, F.col("text")))
    return docs.select("doc_id", F.md5(whole).alias("digest"), F.length(whole).alias("chars"), X.first_paragraph(F.col("text")).alias("lead"))


_STRIP = r"regexp_replace({}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"
SQL["full_text"] = f"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN source ELSE '' END || chr(10) || chr(10) || CASE WHEN doc_id % 5 > 0 THEN {_STRIP.format("text")} ELSE '' END AS w, string_split({_STRIP.format("text")}, chr(10))[1] AS lead FROM documents)
SELECT doc_id, md5(w) AS digest, CAST(length(w) AS INTEGER) AS chars, lead FROM t
"""

#: Dates that the validator must accept, and others.
#: Forms in which the orders' dates are written, some of them no ISO date, some ambiguous, some with debris; SQL's and Spark's patterns.
_FORMS = (
    ("%Y-%m-%d", "yyyy-MM-dd"), ("%Y%m%d", "yyyyMMdd"), ("%Y-%m-%dT%H:%MZ", "yyyy-MM-dd'T'HH:mm'Z'"), ("%Y-%m-%dT%H.5Z", "yyyy-MM-dd'T'HH.'5Z'"), ("%Y-%m-%dT%H:%M:%S.123Z", "yyyy-MM-dd'T'HH:mm:ss.'123Z'"),
    ("%Y-%m-%dT%H%M+10", "yyyy-MM-dd'T'HHmm'+10'"), ("%Y%m%dT%H%M", "yyyyMMdd'T'HHmm"), ("%d %B %Y", "dd MMMM yyyy"), ("%B %d, %Y at %H:%M", "MMMM dd, yyyy 'at' HH:mm"), ("%m/%d/%Y", "MM/dd/yyyy"),
    ("%a, %d %b %Y %H:%M:%S +0200", "EEE, dd MMM yyyy HH:mm:ss '+0200'"), ("%Y-%m-%d yyyy-mm", "yyyy-MM-dd 'yyyy-mm'"), ("seen %Y-%m-%d", "'seen' yyyy-MM-dd"), ("%B %Y", "MMMM yyyy"), ("%d", "dd"),
)


def _written_dates(spark: SparkSession, sf: str) -> DataFrame:
    """The orders' dates as texts, with a time of day, in a form that the key tells; some are null."""
    i = F.pmod("o_orderkey", F.lit(len(_FORMS) + 1))
    when = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86_400)
    value = F.coalesce(*[F.when(i == k, F.date_format(when, form)) for k, (_, form) in enumerate(_FORMS)])
    return table(spark, sf, "orders").select("o_orderkey", value.alias("value"))


_WRITTEN = f"""
d AS (SELECT o_orderkey, o_orderkey % {len(_FORMS) + 1} AS i, date_trunc('day', CAST(o_orderdate AS TIMESTAMP)) + INTERVAL (o_orderkey % 86400) SECOND AS t FROM orders),
v AS (SELECT *, CASE {" ".join(f"WHEN i = {k} THEN strftime(t, '{form}')" for k, (form, _) in enumerate(_FORMS))} END AS value FROM d)"""


@query
def iso_dates(spark: SparkSession, sf: str) -> DataFrame:
    return _written_dates(spark, sf).select("o_orderkey", "value", X.is_iso(F.col("value")).alias("iso"))


SQL["iso_dates"] = f"WITH {_WRITTEN} SELECT o_orderkey, value, regexp_matches(value, '{X.ISO}') AS iso FROM v"


@query
def lenient_dates(spark: SparkSession, sf: str) -> DataFrame:
    """The times that are read back from those texts."""
    return _written_dates(spark, sf).select("o_orderkey", X.parse_date(F.col("value")).cast("timestamp_ntz").alias("time"))


SQL["lenient_dates"] = f"""WITH {_WRITTEN}
SELECT o_orderkey, CASE WHEN i IN (0, 1, 7, 9, 11) THEN date_trunc('day', t) WHEN i IN (2, 8) THEN date_trunc('minute', t) WHEN i = 4 THEN t + INTERVAL 123 MILLISECOND WHEN i = 10 THEN t - INTERVAL 2 HOUR END AS time FROM v"""

_FIELDS = {"headline": ("null", "markup", "newline", "loosepunc"), "dateline": ("null", "noniso"), "body_text": ("null", "markup", "emptyline", "loosepunc")}


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as extractions, with nulls and markup put in by a rule."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    return d.select(
        "doc_id", F.col("source").alias("signature"), F.col("lang").alias("structure_group"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("in_dev_sample"),
        F.when(i % 6 > 0, F.concat(F.when(i % 7 == 0, "<b>x</b> ").otherwise(""), F.substring("text", 1, 60))).alias("headline"),
        F.when(i % 5 > 0, F.when(i % 2 == 0, "2014-01-01").otherwise("1 May 2014")).alias("dateline"),
        F.when(i % 9 > 0, F.concat("text", F.when(i % 8 == 0, "\n\nend - x").otherwise(""))).alias("body_text"),
    )


_EXTRACTED = """e AS (SELECT d.doc_id, source AS signature, lang AS structure_group, coalesce(quality = 1, false) AS in_dev_sample,
  CASE WHEN d.doc_id % 6 > 0 THEN CASE WHEN d.doc_id % 7 = 0 THEN '<b>x</b> ' ELSE '' END || substr(text, 1, 60) END AS headline,
  CASE WHEN d.doc_id % 5 > 0 THEN CASE WHEN d.doc_id % 2 = 0 THEN '2014-01-01' ELSE '1 May 2014' END END AS dateline,
  CASE WHEN d.doc_id % 9 > 0 THEN text || CASE WHEN d.doc_id % 8 = 0 THEN chr(10) || chr(10) || 'end - x' ELSE '' END END AS body_text
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
_FLAG_SQL = {
    "null": "{f} IS NULL",
    "markup": "regexp_matches({f}, '(?s)<.+>')",
    "newline": "contains({f}, chr(10))",
    "emptyline": "contains({f}, chr(10) || chr(10))",
    "loosepunc": r"regexp_matches({f}, '[ \t\n\x0B\f\r][^\p{L}\p{N}_–—―-][ \t\n\x0B\f\r]')",
    "noniso": f"NOT regexp_matches({{f}}, '{X.ISO}')",
}
_FLAGS = ", ".join(f"coalesce(CAST({_FLAG_SQL[k].replace('{f}', f)} AS INTEGER), 0) AS {f}_has_{k}" for f, names in _FIELDS.items() for k in names)
_NAMES = [f"{f}_has_{k}" for f, names in _FIELDS.items() for k in names]


@query
def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    e = _extracted(spark, sf)
    letters = X.field_letters({"headline": "H", "dateline": "D", "body_text": "T"}).alias("fields")
    return e.select("doc_id", letters, *[c.alias(n) for n, c in X.flags(_FIELDS).items()])


SQL["diagnostics"] = f"WITH {_EXTRACTED} SELECT doc_id, CASE WHEN headline IS NULL THEN '' ELSE 'H' END || CASE WHEN dateline IS NULL THEN '' ELSE 'D' END || CASE WHEN body_text IS NULL THEN '' ELSE 'T' END AS fields, {_FLAGS} FROM e"


@query
def diagnostics_counts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.flag_counts(_extracted(spark, sf), _FIELDS)


SQL["diagnostics_counts"] = f"WITH {_EXTRACTED}, f AS (SELECT signature, structure_group, {_FLAGS} FROM e WHERE in_dev_sample) SELECT signature, structure_group, count(*) AS n_dev, {', '.join(f'CAST(sum({n}) AS BIGINT) AS {n}' for n in _NAMES)} FROM f GROUP BY 1, 2"


@query
def diagnostics_pct(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.report(_extracted(spark, sf), _FIELDS, least_articles=20, least_dev=5)
    return found.withColumn("percent", F.round("percent", 6))


SQL["diagnostics_pct"] = f"""
WITH {_EXTRACTED}, f AS (SELECT signature, structure_group, {_FLAGS} FROM e WHERE in_dev_sample),
c AS (SELECT signature, structure_group, count(*) AS n_dev, {", ".join(f"sum({n}) AS {n}" for n in _NAMES)} FROM f GROUP BY 1, 2),
a AS (SELECT signature, count(*) AS n_articles FROM e GROUP BY 1)
SELECT c.signature, structure_group, n_articles, n_dev, flag, round(100.0 * v / n_dev, 6) AS percent
FROM (UNPIVOT c ON {", ".join(_NAMES)} INTO NAME flag VALUE v) c JOIN a ON a.signature = c.signature WHERE n_articles >= 20 AND n_dev >= 5
"""


@query
def match_cube(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    matches = d.select(F.col("lang").alias("sgroup"), F.col("quality").cast("int").alias("which"), (F.col("doc_id") % 4).alias("matches"))
    return quality.match_cube(matches, "sgroup", "which", "matches")


SQL["match_cube"] = """
WITH m AS (SELECT lang AS sgroup, CAST(quality AS INTEGER) AS which, d.doc_id % 4 AS k FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT sgroup, which, CAST(grouping(sgroup, which) AS INTEGER) AS level, count(*) FILTER (k = 0) AS none, count(*) FILTER (k = 1) AS one, count(*) FILTER (k >= 2) AS more
FROM m GROUP BY GROUPING SETS ((), (sgroup), (which), (sgroup, which)) HAVING grouping(which) = 1 OR which IS NOT NULL
"""
