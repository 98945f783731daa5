"""Rule, structure and extraction queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgrain.functions import html as H
from newsgrain.operators import extract, rules, structure
from newsgrain.plans.base import Book, table

BOOK = Book()
query, SQL = BOOK.query, BOOK.sql

def _kind(n: int, shift: int) -> str:
    """A selector by part number: none, empty, own, or inherited in each of the ways."""
    return f"CASE (p_partkey + {shift}) % {n} WHEN 0 THEN NULL WHEN 1 THEN '<domain>((text))' || p_type WHEN 2 THEN '<default>' || p_type WHEN 3 THEN '<domain><default>' || p_type WHEN 4 THEN '' WHEN 5 THEN '<domain>' ELSE '.' || p_type END"


#: Parts as rules: brands are domains, and a brand's first part holds its defaults.
_PARTS = {
    "signature": "CASE WHEN p_partkey = min(p_partkey) OVER (PARTITION BY p_brand) THEN p_brand ELSE p_brand || '/' || p_partkey END",
    "base_domain": "p_brand",
    "modified_when": "CAST(p_size AS INT)",
    "headline": _kind(9, 0),
    "byline": _kind(7, 2),
    "dateline": _kind(8, 5),
    "body_text": _kind(11, 7),
}
_TABLE = f"r AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _PARTS.items())} FROM part)"


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(*[f"{e} AS {n}" if n in ("signature", "base_domain", "modified_when") else f"{e} AS {n}_selector" for n, e in _PARTS.items()])


@query
def rule_status(spark: SparkSession, sf: str) -> DataFrame:
    s = rules.status({"headline": "h", "dateline": "d", "byline": "b", "body_text": "t"})
    return _rules(spark, sf).select("signature", s.alias("status"), rules.is_domain_default().alias("is_default"), rules.inherits("<domain>").alias("has_domain_default"), rules.inherits("<default>").alias("has_default"), rules.specificity(F.col("headline_selector")).alias("headline_from"))


def _letter(f: str, x: str) -> str:
    return f"CASE WHEN {f} IS NULL THEN '' WHEN NOT starts_with({f}, '<domain>') AND NOT starts_with({f}, '<default>') THEN '{x.upper()}' WHEN regexp_replace({f}, '^(<domain>|<default>)+', '') <> '' THEN '{x}' ELSE '' END"


_ANY = " OR ".join("coalesce(starts_with({f}, '%s'), false)".replace("{f}", f) for f in ("headline", "dateline", "byline", "body_text"))
SQL["rule_status"] = f"""
WITH {_TABLE} SELECT signature, {_letter("headline", "h")} || {_letter("dateline", "d")} || {_letter("byline", "b")} || {_letter("body_text", "t")} AS status,
  signature = base_domain AS is_default, {_ANY.replace("%s", "<domain>")} AS has_domain_default, {_ANY.replace("%s", "<default>")} AS has_default,
  CASE WHEN starts_with(headline, '<domain><default>') OR starts_with(headline, '<default>') THEN 'global' WHEN starts_with(headline, '<domain>') THEN 'domain' WHEN headline IS NOT NULL THEN 'signature' END AS headline_from FROM r
"""


@query
def rule_effective(spark: SparkSession, sf: str) -> DataFrame:
    return rules.refreshed(_rules(spark, sf))


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _source(f: str) -> str:
    return f"CASE WHEN d.{f} IS NULL OR starts_with(d.{f}, '<default>') THEN '<default>' || {_text(rules.GLOBAL_RULES[f])} ELSE d.{f} END"


_NEW = {f: f"CASE WHEN r.signature = r.base_domain THEN {_source(f)} WHEN r.{f} IS NULL OR starts_with(r.{f}, '<domain>') THEN '<domain>' || {_source(f)} ELSE r.{f} END" for f in ("headline", "byline", "dateline", "body_text")}
SQL["rule_effective"] = f"""
WITH {_TABLE}, n AS (SELECT r.signature, r.base_domain, r.modified_when AS own, d.modified_when AS dom, {", ".join(f"{x} AS {f}_selector" for f, x in _NEW.items())},
  {" OR ".join(f"r.{f} IS DISTINCT FROM {x}" for f, x in _NEW.items())} AS changed FROM r LEFT JOIN r d ON d.signature = r.base_domain)
SELECT signature, base_domain, CASE WHEN changed THEN greatest(own, dom) ELSE own END AS modified_when, headline_selector, byline_selector, dateline_selector, body_text_selector FROM n
"""


@query
def prior_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules.popularity(table(spark, sf, "part"), "p_brand", "p_type", "p_partkey")


SQL["prior_rules"] = "SELECT p_brand, p_type, count(*) AS in_domain, min(p_partkey) AS example, CAST(sum(count(*)) OVER (PARTITION BY p_brand) AS BIGINT) AS overall FROM part WHERE p_brand IS NOT NULL GROUP BY 1, 2"


@query
def rule_agreement(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").withColumn("selector", F.when(F.col("p_size") % 3 > 0, F.concat(F.when(F.col("p_size") % 2 == 0, "<domain>").otherwise(""), "p_brand")))
    return rules.agreement(parts, "p_type", "p_name", "selector", "p_partkey")


SQL["rule_agreement"] = """
WITH p AS (SELECT *, CASE WHEN p_size % 3 > 0 THEN CASE WHEN p_size % 2 = 0 THEN '<domain>' ELSE '' END || p_brand END AS s FROM part)
SELECT p_type, count(*) AS n, count(DISTINCT coalesce(regexp_replace(s, '^(<domain>)?(<default>)?\\s*', ''), '')) AS selectors,
  count(DISTINCT coalesce(regexp_replace(s, '^(<domain>)?(<default>)?\\s*', ''), '')) = 1 AS agree,
  arg_max(p_name, p_partkey) FILTER (s IS NOT NULL) AS source FROM p GROUP BY 1
"""


@query
def minhash(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of the word pairs of benchmark texts."""
    b = table(spark, sf, "benchmark").withColumn("w", F.split("text", " "))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1))))
    return b.filter(F.size("w") > 1).select("item_id", F.array_join(structure.md5_sketch(pairs, 8), ",").alias("sketch"))


SQL["minhash"] = f"""
WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), p AS (SELECT item_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p FROM w WHERE len(w) > 1)
SELECT item_id, concat_ws(',', {", ".join(f"list_min(list_transform(p, lambda x: md5(x || ':{k}')))" for k in range(8))}) AS sketch FROM p
"""

_SIGNS = "list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER))"



@query
def hamming_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("domain"), F.format_string("%07d", "vec_id").alias("node"), structure.sign_bits(F.col("embedding")).alias("sketch"))
    return structure.close_pairs(e, "domain", "node", "sketch", 0.35).select("domain", "a", "b", F.round("distance", 6).alias("distance"))


_PAIRS = f"""
e AS (SELECT CAST(label AS VARCHAR) AS domain, printf('%07d', vec_id) AS node, {_SIGNS} AS s, vec_id % 5 + 1 AS w FROM embeddings),
p AS (SELECT a.domain, a.node AS a, b.node AS b, list_sum(list_transform(list_zip(a.s, b.s), lambda z: CAST(z[1] <> z[2] AS INTEGER))) / len(a.s) AS distance FROM e a JOIN e b ON a.domain = b.domain AND a.node < b.node)
"""
SQL["hamming_pairs"] = f"WITH {_PAIRS} SELECT domain, a, b, round(distance, 6) AS distance FROM p WHERE distance <= 0.35 + 1e-9"


_EQUAL_BITS = "CASE WHEN (vec_id * 7919 + k * 104729 + vec_id * k * 31) % 1009 < 90 THEN 1000 + (vec_id + k * k) % 89 ELSE (label * 31 + k * 7) % 97 END"


def _templates(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of few templates with some positions changed, as pages of a site have them."""
    places = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.when((F.col("vec_id") * 7919 + k * 104729 + F.col("vec_id") * k * 31) % 1009 < 90, 1000 + (F.col("vec_id") + k * k) % 89).otherwise((F.col("label") * 31 + k * 7) % 97))
    return table(spark, sf, "embeddings").select((F.col("vec_id") % 2).alias("domain"), "vec_id", places.alias("sketch"))


@query
def template_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """How many other sketches each is close to, where bands cannot tell the rows of a template apart."""
    rows = _templates(spark, sf)
    return structure.close_counts(rows, "domain", "vec_id", "sketch", 0.125)


SQL["template_pairs"] = f"""
WITH v AS (SELECT vec_id % 2 AS domain, vec_id, list_transform(range(40), lambda k: {_EQUAL_BITS}) AS s FROM embeddings),
p AS (SELECT a.vec_id, count(*) AS c FROM v a JOIN v b ON a.domain = b.domain AND a.vec_id <> b.vec_id WHERE list_sum(list_transform(list_zip(a.s, b.s), lambda z: CAST(z[1] <> z[2] AS INTEGER))) <= 5 GROUP BY 1)
SELECT domain, v.vec_id, coalesce(c, 0) AS close FROM v LEFT JOIN p ON p.vec_id = v.vec_id
"""


@query
def dbscan_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Sign sketches of the embeddings, with weights, clustered within their label."""
    e = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("domain"), F.format_string("%07d", "vec_id").alias("node"), structure.sign_bits(F.col("embedding")).alias("sketch"), (F.col("vec_id") % 5 + 1).alias("weight"))
    return structure.dbscan_near(e, "domain", "sketch", 0.35, min_samples=6)


SQL["dbscan_groups"] = f"""
WITH RECURSIVE {_PAIRS}, c AS (SELECT a, b FROM p WHERE distance <= 0.35 + 1e-9), y AS (SELECT a AS x, b AS y FROM c UNION ALL SELECT b, a FROM c),
n AS (SELECT node, w + coalesce((SELECT sum(f.w) FROM y JOIN e f ON f.node = y.y WHERE y.x = e.node), 0) >= 6 AS core FROM e),
k AS (SELECT x, y FROM y JOIN n a ON a.node = x AND a.core JOIN n b ON b.node = y AND b.core),
reach(x, y) AS (SELECT node, node FROM n WHERE core UNION SELECT r.x, k.y FROM reach r JOIN k ON k.x = r.y),
g AS (SELECT x, min(y) AS g FROM reach GROUP BY 1)
SELECT n.node, coalesce(g.g, (SELECT min(h.g) FROM y JOIN g h ON h.x = y.y WHERE y.x = n.node)) AS cluster, core FROM n LEFT JOIN g ON g.x = n.node
"""


@query
def cluster_quality(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 4).alias("domain"), F.when(F.col("label") > 1, F.col("label")).alias("cluster"), (F.col("vec_id") % 3 + 1).alias("weight"))
    return structure.cluster_quality(e, "domain", "cluster", "weight").select("domain", "clusters", F.round("inliers", 6).alias("inliers"), F.round("entropy", 6).alias("entropy"))


SQL["cluster_quality"] = """
WITH c AS (SELECT vec_id % 4 AS domain, CASE WHEN label > 1 THEN label END AS cluster, sum(vec_id % 3 + 1) AS w FROM embeddings GROUP BY 1, 2),
p AS (SELECT *, w / sum(w) OVER (PARTITION BY domain) AS p FROM c)
SELECT domain, count(cluster) AS clusters, round(100 * sum(CASE WHEN cluster IS NOT NULL THEN p ELSE 0 END), 6) AS inliers, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY 1
"""


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 4).alias("domain"), "vec_id", F.when((F.col("label") > 1) & (F.col("vec_id") % 4 < 3), F.col("label") % (F.col("vec_id") % 4 * 3 + 1)).alias("cluster"),
        (F.col("vec_id") % 3 + 1).alias("weight"), structure.sign_bits(F.col("embedding")).alias("sketch"),
    )


@query
def cluster_silhouette(spark: SparkSession, sf: str) -> DataFrame:
    """Of sign sketches of the embeddings, each once and by weight; domains of one cluster, of none, and of several."""
    rows = _labelled(spark, sf)
    once = structure.silhouette(rows, "domain", "vec_id", "cluster", "sketch")
    weighed = structure.silhouette(rows, "domain", "vec_id", "cluster", "sketch", "weight").withColumnRenamed("silhouette", "weighted")
    return once.join(weighed, "domain").select("domain", F.round("silhouette", 9).alias("silhouette"), F.round("weighted", 9).alias("weighted"))


SQL["cluster_silhouette"] = f"""
WITH r AS (SELECT vec_id % 4 AS d, vec_id AS x, CASE WHEN label > 1 AND vec_id % 4 < 3 THEN label % (vec_id % 4 * 3 + 1) END AS c, vec_id % 3 + 1 AS w, {_SIGNS} AS s FROM embeddings),
n AS (SELECT * FROM r WHERE c IS NOT NULL), z AS (SELECT d, c, sum(w) AS size, count(*) AS k FROM n GROUP BY 1, 2),
p AS (SELECT a.d, a.x, a.c AS own, a.w AS w, b.c AS c, sum(t) AS t, sum(t * v) AS tv FROM (
  SELECT a, b, a.d AS d, list_sum(list_transform(list_zip(a.s, b.s), lambda q: CAST(q[1] <> q[2] AS INTEGER))) / len(a.s) AS t, b.w AS v FROM n a JOIN n b ON a.d = b.d) GROUP BY 1, 2, 3, 4, 5),
m AS (SELECT p.d, x, own, w, max(CASE WHEN p.c = own AND k > 1 THEN t / (k - 1) END) AS i, min(CASE WHEN p.c <> own THEN t / k END) AS o,
  max(CASE WHEN p.c = own AND size > 1 THEN tv / (size - 1) END) AS iw, min(CASE WHEN p.c <> own THEN tv / size END) AS ow FROM p JOIN z ON z.d = p.d AND z.c = p.c GROUP BY 1, 2, 3, 4),
f AS (SELECT d, avg(coalesce((o - i) / greatest(o, i), 0)) AS s, sum(w * coalesce((ow - iw) / greatest(ow, iw), 0)) / sum(w) AS sw FROM m GROUP BY 1),
g AS (SELECT d, count(*) AS c FROM z GROUP BY 1)
SELECT e.d AS domain, CASE WHEN c >= 2 THEN round(s, 9) ELSE CAST('-inf' AS DOUBLE) END AS silhouette, CASE WHEN c >= 2 THEN round(sw, 9) ELSE CAST('-inf' AS DOUBLE) END AS weighted
FROM (SELECT DISTINCT d FROM r) e LEFT JOIN f ON f.d = e.d LEFT JOIN g ON g.d = e.d
"""


@query
def cluster_dump(spark: SparkSession, sf: str) -> DataFrame:
    """The figures of weighted clusters with cores, from a dump that is read back; a domain's sketches are those of a label."""
    from newsgrain.plans.q_streams import home

    at = home(spark, "clusters")
    e = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("domain"), F.format_string("%07d", "vec_id").alias("node"), structure.sign_bits(F.col("embedding")).alias("sketch"), (F.col("vec_id") % 5 + 1).alias("weight"))
    labels = structure.dbscan_near(e, "domain", "sketch", 0.35, min_samples=6)
    nodes = e.join(labels, "node")
    structure.write_clusters(nodes, structure.cluster_summary(nodes, "domain", "node", "cluster", "sketch", "weight", "core"), "domain", at)
    schema = "domain string, clusters bigint, inliers double, entropy double, cores bigint, sketches bigint, weight bigint, silhouette string"
    found = spark.read.schema(schema).json(f"{at}/summary")
    kept = spark.read.parquet(f"{at}/sketches").groupBy(F.col("domain").cast("string").alias("domain")).agg(F.count_if("core").alias("cores_kept"), F.count("cluster").alias("inside"))
    value = F.when(F.col("silhouette") == "-Infinity", float("-inf")).otherwise(F.col("silhouette").try_cast("double"))
    return found.join(kept, "domain").select("domain", "clusters", F.round("inliers", 6).alias("inliers"), F.round("entropy", 6).alias("entropy"), "cores", "sketches", "weight", F.round(value, 6).alias("silhouette"), "cores_kept", "inside")


SQL["cluster_dump"] = f"""
WITH RECURSIVE {_PAIRS}, c AS (SELECT a, b FROM p WHERE distance <= 0.35 + 1e-9), y AS (SELECT a AS x, b AS y FROM c UNION ALL SELECT b, a FROM c),
n AS (SELECT node, domain, w, s, w + coalesce((SELECT sum(f.w) FROM y JOIN e f ON f.node = y.y WHERE y.x = e.node), 0) >= 6 AS core FROM e),
k AS (SELECT x, y FROM y JOIN n a ON a.node = x AND a.core JOIN n b ON b.node = y AND b.core),
reach(x, y) AS (SELECT node, node FROM n WHERE core UNION SELECT r.x, k.y FROM reach r JOIN k ON k.x = r.y),
g AS (SELECT x, min(y) AS g FROM reach GROUP BY 1),
l AS (SELECT n.*, coalesce(g.g, (SELECT min(h.g) FROM y JOIN g h ON h.x = y.y WHERE y.x = n.node)) AS cluster FROM n LEFT JOIN g ON g.x = n.node),
z AS (SELECT domain, cluster, count(*) AS k, sum(w) AS w FROM l GROUP BY 1, 2), q AS (SELECT *, w / sum(w) OVER (PARTITION BY domain) AS f FROM z),
d AS (SELECT a.node, a.domain, a.cluster AS own, b.cluster AS c, sum(list_sum(list_transform(list_zip(a.s, b.s), lambda v: CAST(v[1] <> v[2] AS INTEGER))) / len(a.s)) AS t FROM l a JOIN l b ON a.domain = b.domain WHERE a.cluster IS NOT NULL AND b.cluster IS NOT NULL GROUP BY 1, 2, 3, 4),
m AS (SELECT node, d.domain, max(CASE WHEN c = own AND k > 1 THEN t / (k - 1) END) AS i, min(CASE WHEN c <> own THEN t / k END) AS o FROM d JOIN z ON z.domain = d.domain AND z.cluster = c GROUP BY 1, 2),
sil AS (SELECT domain, avg(coalesce((o - i) / greatest(o, i), 0)) AS s FROM m GROUP BY 1),
t AS (SELECT domain, count(*) FILTER (core) AS cores, count(*) AS sketches, CAST(sum(w) AS BIGINT) AS weight, count(cluster) AS inside FROM l GROUP BY 1),
u AS (SELECT domain, count(cluster) AS clusters, round(100 * sum(CASE WHEN cluster IS NOT NULL THEN f ELSE 0 END), 6) AS inliers, round(-sum(f * ln(f)), 6) AS entropy FROM q GROUP BY 1)
SELECT t.domain, clusters, inliers, entropy, cores, sketches, weight, CASE WHEN clusters >= 2 THEN round(s, 6) ELSE CAST('-inf' AS DOUBLE) END AS silhouette, cores AS cores_kept, inside FROM t JOIN u ON u.domain = t.domain LEFT JOIN sil ON sil.domain = t.domain
"""


@query
def cluster_relabel(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 4).alias("domain"), F.when(F.col("label") > 1, F.col("label")).alias("cluster"), (F.col("vec_id") % 3 + 1).alias("weight"))
    return structure.relabelled(e, "domain", "cluster", "weight")


SQL["cluster_relabel"] = """
WITH c AS (SELECT vec_id % 4 AS domain, label AS cluster, sum(vec_id % 3 + 1) AS w FROM embeddings WHERE label > 1 GROUP BY 1, 2)
SELECT domain, cluster, CAST(w AS BIGINT) AS cluster_weight, CAST(row_number() OVER (PARTITION BY domain ORDER BY w DESC, cluster) AS INTEGER) AS structure_group FROM c
"""


@query
def structure_groups(spark: SparkSession, sf: str) -> DataFrame:
    return structure.group_counts(table(spark, sf, "lineitem"), "l_returnflag", "l_linenumber", 100)


SQL["structure_groups"] = """
WITH c AS (SELECT l_returnflag, l_linenumber AS g, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 100),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, g) AS r FROM c)
SELECT l_returnflag, string_agg(CAST(g AS VARCHAR), ',' ORDER BY r) AS structure_groups FROM r WHERE r <= 5 GROUP BY 1
"""


@query
def distance_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("domain"), F.format_string("%07d", "vec_id").alias("node"), structure.sign_bits(F.col("embedding")).alias("sketch"))
    found = structure.distance_summary(structure.close_pairs(e, "domain", "node", "sketch", 0.35), "domain")
    return found.select("domain", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


SQL["distance_summary"] = f"WITH {_PAIRS} SELECT domain, round(min(distance), 6) AS least, round(median(distance), 6) AS median, round(max(distance), 6) AS greatest, round(avg(distance), 6) AS mean FROM p WHERE distance <= 0.35 + 1e-9 GROUP BY 1"


@query
def tag_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.explode(structure.tag_paths(F.col("html"))).alias("path"))


@query
def structure_sketch(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", structure.sketch(structure.tag_paths(F.col("html"))).alias("sketch"))
    return pages.select("page_id", F.array_join(F.col("sketch").cast("array<string>"), ",").alias("sketch"))


@query
def extract_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The global rules but for the body's, and the addresses of the links in the navigation."""
    programs = {f: rules.GLOBAL_RULES[f] for f in ("headline", "byline", "dateline")} | {"links": "nav a::attr(href)"}
    found = extract.evaluate(table(spark, sf, "pages"), "page_id", programs)
    return found.select("page_id", "name", F.md5("value").alias("digest"), "which", "matches")


SQL["extract_fields"] = r"""
WITH p AS (SELECT page_id, replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '&amp;', '&') AS h, regexp_extract_all(regexp_extract(html, '(?is)<nav\b.*?</nav>', 0), '(?is)<a\b[^>]*\bhref="([^"]*)"', 1) AS l,
  regexp_matches(html, '(?i)itemprop|rel="?author|class="[^"]*\b(byline|hnews)|date(Published|Created)') AS more FROM pages)
SELECT page_id, 'headline' AS name, md5(nullif(trim(h), '')) AS digest, CAST(1 AS INTEGER) AS which, CAST(1 AS INTEGER) AS matches FROM p
UNION ALL SELECT page_id, 'links', md5(nullif(replace(array_to_string(l, chr(10)), '&amp;', '&'), '')), CASE WHEN len(l) > 0 THEN 0 END, CAST(len(l) AS INTEGER) FROM p
UNION ALL SELECT page_id, n, CASE WHEN more THEN 'unexpected' END, NULL, 0 FROM p, (SELECT unnest(['byline', 'dateline']) AS n)
"""


@query
def extract_body(spark: SparkSession, sf: str) -> DataFrame:
    """The global rule of the body, down to the densest block of the page."""
    found = extract.evaluate(table(spark, sf, "pages"), "page_id", {"body_text": rules.GLOBAL_RULES["body_text"]})
    return found.select("page_id", F.md5("value").alias("digest"), "which", "matches")


@query
def selector_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return extract.selector_coverage(table(spark, sf, "pages").withColumn("html", F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", "(?i)</?article", "<div")).otherwise(F.col("html"))), "page_id", "((text))article p")


SQL["selector_coverage"] = r"""
WITH p AS (SELECT CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, '(?i)</?article', '<div', 'g') ELSE html END AS html FROM pages)
SELECT count(*) AS pages, 100 * avg(CAST(regexp_matches(html, '(?is)<article\b.*?<p\b') AS INTEGER)) AS percent FROM p
"""


@query
def canonical_url(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with heads made of their own addresses: a canonical link, an og:url, both or none, and a refresh."""
    pages = table(spark, sf, "pages")
    i, rest = F.col("page_id"), F.regexp_replace("url", r"\?.*$", "")
    link = F.when(i % 2 == 0, F.concat(F.lit('<link rel="canonical" href="'), rest, F.lit("?a=1&amp;b="), i, F.lit('">'))).otherwise("")
    social = F.when(i % 3 == 0, F.concat(F.lit('<meta property="og:url" content="'), rest, F.lit('#og">'))).otherwise("")
    refresh = F.when(i % 5 > 0, F.concat(F.lit('<meta http-equiv="refresh" content="'), i % 4, F.lit("; url="), F.when(i % 2 == 0, rest).otherwise("/x/"), i, F.lit('">'))).otherwise("")
    return pages.select("page_id", H.social_canonical(F.concat(link, social, "html"), F.col("url")).alias("canonical"), H.refresh_target(F.concat(refresh, "html")).alias("refresh"))


SQL["canonical_url"] = r"""
WITH p AS (SELECT page_id AS i, regexp_replace(url, '\?.*$', '') AS rest, html FROM pages),
t AS (SELECT i, CASE WHEN i % 2 = 0 THEN '<link rel="canonical" href="' || rest || '?a=1&amp;b=' || i || '">' ELSE '' END || CASE WHEN i % 3 = 0 THEN '<meta property="og:url" content="' || rest || '#og">' ELSE '' END || html AS h,
  CASE WHEN i % 5 > 0 THEN '<meta http-equiv="refresh" content="' || i % 4 || '; url=' || CASE WHEN i % 2 = 0 THEN rest ELSE '/x/' END || i || '">' ELSE '' END || html AS r FROM p)
SELECT i AS page_id, replace(coalesce(nullif(regexp_extract(h, '<meta[^>]*property=.og:url[^>]*content="([^"]*)', 1), ''), nullif(regexp_extract(h, '<link[^>]*rel=.canonical[^>]*href="([^"]*)', 1), '')), '&amp;', '&') AS canonical,
  nullif(regexp_extract(r, 'http-equiv="refresh" content="\d+; url=([^"]*)"', 1), '') AS refresh FROM t
"""
