"""URL, as-of, merge and queue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgrain.functions import url as U
from newsgrain.operators import ingest, stats, urls
from newsgrain.plans.base import Book, table

BOOK = Book()
query, SQL = BOOK.query, BOOK.sql

_SLUG = r"[\w\s''\",$+()-]"
_TOKEN = rf"\.[a-zA-Z]{{1,30}}[0-9]{{0,2}}[a-zA-Z]{{0,4}}$|=[^;/]*|{_SLUG}*[a-zA-Z_]+{_SLUG}*|\b\d+(?:[,_.]+\d+)+\b|\b\d{{8}}[\d-]+\b|[0-9]+|."
_HOST, _PATH, _QUERY = ("regexp_extract(url, '^(?:([a-z]+):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?', %d)" % i for i in (2, 3, 4))
_SHAPE = rf"""array_to_string(list_transform(regexp_extract_all(regexp_replace({_PATH}, '=[^;/]*', '', 'g'), '{_TOKEN}'), lambda t:
  CASE WHEN regexp_matches(t, '^\.[a-zA-Z]{{1,30}}[0-9]{{0,2}}[a-zA-Z]{{0,4}}$') THEN t WHEN t[1] = '=' THEN ''
    WHEN regexp_full_match(t, '{_SLUG}*[a-zA-Z_]+{_SLUG}*') THEN 'a' WHEN regexp_full_match(t, '[0-9]+') THEN repeat('0', length(t))
    WHEN length(t) > 1 THEN 'ID' ELSE t END), '')"""
_DOMAIN = rf"regexp_replace({_HOST}, '^www\.', '')"
_Q = f"regexp_replace({_QUERY}, '=[^&]*', '', 'g')"


@query
def url_signature(spark: SparkSession, sf: str) -> DataFrame:
    s = U.signature_parts(F.col("url"))
    pages = table(spark, sf, "pages").select("page_id", "url", s.alias("s"), U.signature(F.col("url")).alias("signature"))
    return pages.select("page_id", F.col("s.domain").alias("domain"), F.col("s.path").alias("path"), F.col("s.query").alias("query"), "signature")


SQL["url_signature"] = f"SELECT page_id, {_DOMAIN} AS domain, {_SHAPE} AS path, {_Q} AS query, {_DOMAIN} || {_SHAPE} || '/' || {_Q} AS signature FROM pages"


@query
def url_sig_counts(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").withColumn("when", F.to_timestamp(F.lit("2014-01-01")) + F.make_dt_interval(F.col("page_id").cast("int")))
    return urls.signature_months(pages, "url", "when")


SQL["url_sig_counts"] = f"SELECT {_DOMAIN} || {_SHAPE} || '?' || {_Q} AS signature, strftime(TIMESTAMP '2014-01-01' + to_days(CAST(page_id AS INTEGER)), '%Y-%m') AS month, count(*) AS n FROM pages GROUP BY 1, 2"


@query
def url_examples(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").withColumn("shape", U.signature_parts(F.col("url"))["path"])
    return urls.grouped_examples(pages, "shape", "url").withColumn("examples", F.array_join("examples", " "))


SQL["url_examples"] = f"""
WITH u AS (SELECT {_SHAPE} AS shape, url, count(*) AS c FROM pages GROUP BY 1, 2),
r AS (SELECT shape, url, row_number() OVER (PARTITION BY shape ORDER BY md5(url), url) AS r, sum(c) OVER (PARTITION BY shape) AS n FROM u)
SELECT shape, CAST(max(n) AS BIGINT) AS n, array_to_string(list(url ORDER BY url), ' ') AS examples FROM r WHERE r <= 10 GROUP BY 1
"""


@query
def url_shape(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", U.slashes(u).alias("slashes"), U.has_query(u).alias("has_query"), U.without_host(u).alias("rest"))


SQL["url_shape"] = "SELECT page_id, CAST(length(url) - length(replace(url, '/', '')) AS INTEGER) AS slashes, contains(url, '?') AS has_query, regexp_extract(url, '^[^/]*/[^/]*/[^/]*/(.*)$', 1) AS rest FROM pages"


@query
def domain_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' nations as domains, parts as paths."""
    return _pairs(spark, sf)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    lines, sup = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    rows = lines.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat(F.lit("d"), "s_nationkey").alias("domain"), F.concat(F.lit("/p/"), "l_partkey").alias("path"))
    return urls.domain_pairs(rows, "domain", "path", 200)


SQL["domain_pairs"] = """
WITH r AS (SELECT DISTINCT 'd' || s_nationkey AS d, l_partkey AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT a.d AS a, b.d AS b, count(*) AS n FROM r a JOIN r b ON a.p = b.p AND a.d < b.d GROUP BY 1, 2 HAVING count(*) >= 200
"""


@query
def domain_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    return urls.equivalence(_pairs(spark, sf))


SQL["domain_equivalence"] = f"""
WITH RECURSIVE p AS ({SQL["domain_pairs"]}),
e AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p),
reach(x, y) AS (SELECT x, x FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y)
SELECT x AS node, min(y) AS "group" FROM reach GROUP BY 1
"""

_HOSTS = ["alpha.example", "beta.example", "gamma.example"]


@query
def cross_domain_paths(spark: SparkSession, sf: str) -> DataFrame:
    return urls.substitutes(table(spark, sf, "pages"), "url", _HOSTS).select("page_id", "host", "substitute")


SQL["cross_domain_paths"] = f"SELECT page_id, host, 'http://' || host || '/' || regexp_extract(url, '^[^/]*/[^/]*/[^/]*/(.*)$', 1) AS substitute FROM pages, (SELECT unnest({_HOSTS}) AS host)"


@query
def redirect_suspects(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_partkey", F.col("l_suppkey").cast("string").alias("variant"), "l_returnflag")
    return urls.many_variants(lines, "l_partkey", "variant", "l_returnflag", rows_limit=100).withColumn("examples", F.array_join("examples", " "))


SQL["redirect_suspects"] = """
WITH d AS (SELECT DISTINCT l_partkey, CAST(l_suppkey AS VARCHAR) AS variant, l_returnflag FROM lineitem),
p AS (SELECT l_partkey, l_returnflag, count(*) AS n_variants, list(variant ORDER BY variant)[1:2] AS e FROM d GROUP BY 1, 2 HAVING count(*) >= 5),
w AS (SELECT *, count(*) OVER (PARTITION BY l_returnflag) AS n_domain, row_number() OVER (PARTITION BY l_returnflag ORDER BY n_variants DESC, l_partkey) AS r FROM p)
SELECT l_partkey, l_returnflag, n_variants, n_domain, CASE WHEN r <= 100 THEN array_to_string(e, ' ') END AS examples FROM w
"""


#: Hosts end in one of these in turn; of each the number of labels under which a name is registered is known.
_ENDS = (("co.uk", 2), ("com.au", 2), ("de", 1), ("info", 1), ("gov.uk", 2), ("org", 1), ("co.de", 1), ("example", 0), ("localhost", 0))


@query
def registrable_domain(spark: SparkSession, sf: str) -> DataFrame:
    """Pages' hosts with their last two labels replaced, with user and port, in capitals."""
    ends = F.element_at(F.array(*[F.lit(e) for e, _ in _ENDS]), (F.col("page_id") % len(_ENDS) + 1).cast("int"))
    host = F.regexp_replace(U.part(F.col("url"), "host"), r"[^.]+\.[^.]+$", "")
    return table(spark, sf, "pages").select("page_id", U.registrable(F.concat(F.lit("http://u:p@"), F.upper(host), ends, F.lit(":80/x"))).alias("domain"))


SQL["registrable_domain"] = rf"""
WITH h AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '[^.]+\.[^.]+$', '') || [{", ".join(f"'{e}'" for e, _ in _ENDS)}][page_id % {len(_ENDS)} + 1] AS h, [{", ".join(str(k) for _, k in _ENDS)}][page_id % {len(_ENDS)} + 1] AS k FROM pages)
SELECT page_id, lower(array_to_string(string_split(h, '.')[-(k + 1):], '.')) AS domain FROM h
"""


@query
def url_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's address, a third of them with a longer query, against one on a www host and a folder down."""
    u = F.col("url")
    old = F.regexp_replace("url", r"^https?://([^/]*)/", "http://www.$1/old/")
    new = F.when(F.col("page_id") % 3 == 0, F.concat(u, F.when(u.contains("?"), "&").otherwise("?"), F.lit("b=x y&a=~1"))).otherwise(u)
    return table(spark, sf, "pages").select("page_id", U.url_difference(new, old).alias("difference"))


SQL["url_diff"] = r"""
WITH p AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'b=x y&a=~1' ELSE url END AS new FROM pages),
u AS (SELECT page_id, regexp_extract(new, '^([a-z]+)://', 1) AS s, regexp_extract(new, '^[a-z]+://([^/?#]*)', 1) AS h, string_split(regexp_extract(new, '^[a-z]+://[^/?#]*/([^?#]*)', 1), '/') AS m, regexp_extract(new, '^[^#?]*\?([^#]*)', 1) AS q, regexp_extract(url, '^[^#?]*\?([^#]*)', 1) AS w, regexp_extract(new, '#(.*)$', 1) AS f, regexp_extract(url, '#(.*)$', 1) AS g FROM p)
SELECT page_id, CASE WHEN s = 'http' THEN '<scheme>' ELSE s END || '://' || regexp_replace(h, '\.?[^.]+\.[^.]+$', '') || '.<domain+>/'
  || array_to_string(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = len(m) AND m[i] <> '' THEN '<basename>' ELSE '<dir' || (list_max(list_filter(range(1, len(m) + 1), lambda j: m[j] = m[i])) + 1) || '>' END), '/')
  || CASE WHEN q = '' THEN '' WHEN q = w THEN '?<query>' WHEN w <> '' THEN '?<query>&a%3D~1&b%3Dx%20y' ELSE '?' || q END || CASE WHEN f = '' THEN '' WHEN f = g THEN '#<fragment>' ELSE '#' || f END AS difference FROM u
"""


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "ts", F.floor(F.col("value") * 1000).cast("bigint").alias("fb"), F.col("event_id").alias("tw"))
    born = events.groupBy("user_id").agg(F.min("ts").alias("published"))
    return events.join(born, "user_id")


_ASOF = f"""
WITH b AS (SELECT user_id, min(ts) AS published FROM events GROUP BY 1),
s AS (SELECT e.user_id, ts, CAST(floor(value * 1000) AS BIGINT) AS fb, event_id AS tw, epoch_us(ts) - epoch_us(published) AS late FROM events e JOIN b ON b.user_id = e.user_id),
o AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}', {(v + ingest.SLACK) * 1_000_000})" for i, (k, v) in enumerate(ingest.OFFSETS.items()))}) t(i, "offset", lim)),
a AS (SELECT user_id, i, "offset", max({{'ts': ts, 'fb': fb, 'tw': tw}}) AS v FROM s JOIN o ON late <= lim GROUP BY 1, 2, 3)
"""


@query
def asof_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.asof_long(_snapshots(spark, sf), "user_id", "ts", "published", ["fb", "tw"])


SQL["asof_offsets"] = f'{_ASOF} SELECT user_id, "offset", v.fb AS fb, v.tw AS tw FROM a'


@query
def asof_json(spark: SparkSession, sf: str) -> DataFrame:
    wide = ingest.asof(_snapshots(spark, sf), "user_id", "ts", "published", ["fb", "tw"])
    return ingest.asof_json(wide, "user_id", ["fb", "tw"]).withColumn("fb_5d", ingest.parse_counts(F.col("statistic_json"), "5d"))


SQL["asof_json"] = f"""{_ASOF} SELECT user_id, '{{' || string_agg('"' || "offset" || '":"' || v.fb || ',' || v.tw || '"', ',' ORDER BY i) || '}}' AS statistic_json,
  max(v.fb) FILTER ("offset" = '5d') AS fb_5d FROM a GROUP BY 1"""


@query
def count_ffill(spark: SparkSession, sf: str) -> DataFrame:
    wide = ingest.asof(_snapshots(spark, sf), "user_id", "ts", "published", ["fb"])
    gaps = wide.select("user_id", *[F.when((F.col("user_id") + i) % 3 != 0, F.col(o)["fb"]).alias(f"fb_count_{o}") for i, o in enumerate(("initial", "2h", "1d", "5d"))], (F.col("user_id") % 2 * 100).alias("fb_count_longterm"))
    out = ingest.filled(gaps, "fb")
    return out.select("user_id", *[f"fb_{o}" for o in ("initial", "2h", "1d", "5d", "longterm")])


SQL["count_ffill"] = f"""{_ASOF}, w AS (SELECT user_id, {", ".join(f"CASE WHEN (user_id + {i}) % 3 <> 0 THEN max(v.fb) FILTER ({chr(34)}offset{chr(34)} = '{o}') END AS c{o}" for i, o in enumerate(("initial", "2h", "1d", "5d")))} FROM a GROUP BY 1)
SELECT user_id, coalesce(cinitial, 0) AS fb_initial, coalesce(c2h, cinitial, 0) AS fb_2h, coalesce(c1d, c2h, cinitial, 0) AS fb_1d, coalesce(c5d, c1d, c2h, cinitial, 0) AS fb_5d, nullif(user_id % 2 * 100, 0) AS fb_longterm FROM w"""


@query
def anti_ingest(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.unseen(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


SQL["anti_ingest"] = "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"


@query
def semi_has_download(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left_semi")


SQL["semi_has_download"] = "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"


@query
def inner_chain(spark: SparkSession, sf: str) -> DataFrame:
    orders, cust, nat = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    both = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
    return stats.frequencies(both, "n_name", "c_mktsegment")


SQL["inner_chain"] = "SELECT n_name, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"


@query
def left_chain(spark: SparkSession, sf: str) -> DataFrame:
    cust, orders, lines = table(spark, sf, "customer"), table(spark, sf, "orders"), table(spark, sf, "lineitem").filter("l_linenumber = 1")
    both = cust.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.groupBy("c_custkey").agg(F.count("o_orderkey").alias("articles"), F.count("l_orderkey").alias("spidered"))


SQL["left_chain"] = "SELECT c_custkey, count(o_orderkey) AS articles, count(l_orderkey) AS spidered FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 1) ON o_orderkey = l_orderkey GROUP BY 1"


@query
def cascade_lookup(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    look = [(table(spark, sf, "supplier"), "s_suppkey", "s_name"), (table(spark, sf, "customer"), "c_custkey", "c_name"), (table(spark, sf, "part"), "p_partkey", "p_name")]
    return ingest.cascade(keys, "key", look)


SQL["cascade_lookup"] = "SELECT o_orderkey AS key, coalesce(s_name, c_name, p_name) AS found FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey LEFT JOIN customer ON c_custkey = o_orderkey LEFT JOIN part ON p_partkey = o_orderkey"


@query
def update_from(spark: SparkSession, sf: str) -> DataFrame:
    have = table(spark, sf, "documents").select("doc_id", F.lit(0).alias("quality"))
    return ingest.updated(have, table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", ["quality"])


SQL["update_from"] = "SELECT d.doc_id, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


@query
def distinct_on(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.earliest(table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), "user_id", "event_type", ["event_id"]).drop("ts")


SQL["distinct_on"] = "SELECT DISTINCT ON (user_id) user_id, event_type, event_id FROM events ORDER BY user_id, event_type, event_id"


@query
def earliest_wins(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return ingest.upsert(events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1"), "user_id", "ts", ["event_id"])


SQL["earliest_wins"] = "SELECT DISTINCT ON (user_id) user_id, event_id, ts FROM events ORDER BY user_id, ts, event_id"


@query
def priority_score(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("created", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate") + F.expr("INTERVAL 15 YEARS")))
    score = ingest.priority(F.floor("o_totalprice").cast("bigint"), F.col("o_custkey"), F.col("created"), F.current_timestamp())
    return orders.select("o_orderkey", F.round(score, 6).alias("priority")).orderBy(F.desc_nulls_first("priority"), "o_orderkey")


SQL["priority_score"] = """
SELECT o_orderkey, round(log10(CAST(floor(o_totalprice) AS BIGINT) + 3 * o_custkey + 1) + CASE WHEN o_orderkey % 5 > 0 THEN log10(date_diff('day', DATE '2007-06-01', CAST(o_orderdate + INTERVAL 15 YEAR AS DATE))) END / 4, 6) AS priority
FROM orders
"""


@query
def extraction_priority(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").withColumn("modified", F.col("doc_id") % 10)
    stale = docs.withColumn("scraped", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 7)).filter(ingest.needs_extraction(F.col("scraped"), F.col("modified")))
    ordered = ingest.extraction_order(stale, "quality", "modified", "n_chars", "doc_id")
    return ordered.select("doc_id", "quality", "modified", "n_chars")


SQL["extraction_priority"] = """
SELECT d.doc_id, quality, d.doc_id % 10 AS modified, n_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE d.doc_id % 3 = 0 OR d.doc_id % 7 < d.doc_id % 10
"""


@query
def download_eligible(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("status", F.expr("CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'P' THEN 302 END"))
    return stats.frequencies(orders.filter(ingest.needs_download(F.col("status"))), "o_orderstatus")


SQL["download_eligible"] = "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1"

_STATE = "(CASE WHEN l_linenumber = 7 THEN 404 ELSE 200 END)"


@query
def download_states(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    state = ingest.download_state(
        F.when(F.col("l_linenumber") == 7, 404).otherwise(200),
        F.when(F.col("l_linenumber") == 6, F.lit("image/png")).otherwise(F.lit("Text/HTML; charset=utf-8")),
        (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1),
        F.col("l_linenumber") == 5,
    )
    found = lines.select(state.alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return found.withColumn("text", ingest.status_text(F.col("status")))


SQL["download_states"] = """
WITH s AS (SELECT CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN -200 WHEN l_linenumber = 7 THEN 404 WHEN l_linenumber = 6 THEN -111 WHEN l_linenumber = 5 THEN -2 ELSE 200 END AS status FROM lineitem)
SELECT CAST(status AS INTEGER) AS status, count(*) AS n, CASE status WHEN -200 THEN 'blacklisted' WHEN -111 THEN 'bad content type' WHEN -2 THEN 'empty content' ELSE 'HTTP ' || status END AS text FROM s GROUP BY status
"""


@query
def json_access(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.length(F.trim("props")).alias("chars"))


SQL["json_access"] = "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, CAST(length(trim(props)) AS INTEGER) AS chars FROM events"
