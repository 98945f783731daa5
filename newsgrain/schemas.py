"""Table schemas of the article store; sources read with these, never by inference."""

from __future__ import annotations

from pyspark.sql import types as T

#: The rule fields, the share counts and the custom fetch states.
RULE_FIELDS = ("body_html", "body_text", "headline", "dateline", "byline", "media")
TEXT_FIELDS = ("headline", "dateline", "byline", "body_text")
OFFSETS = ("initial", "2h", "1d", "5d", "longterm")
COUNT_FIELDS = tuple(f"{kind}_count_{o}" for kind in ("fb", "tw") for o in OFFSETS)
CUSTOM_STATUS = {
    -111: "bad content type",
    -1: "too many redirects",
    -2: "empty content",
    -3: "effectively empty content",
    -10: "timeout",
    -503: "server repeatedly unavailable",
    -200: "blacklisted",
}


_TYPES = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
    "array<int>": T.ArrayType(T.IntegerType()),
    "array<long>": T.ArrayType(T.LongType()),
    "array<string>": T.ArrayType(T.StringType()),
}


def struct(text: str) -> T.StructType:
    """A flat schema from ``name type`` pairs; needs no session, unlike DDL parsing."""
    pairs = (x.split() for x in text.split(","))
    return T.StructType([T.StructField(name.strip("`"), _TYPES[kind]) for name, kind in pairs])


SIGNATURE = struct("id long, signature string, base_domain string, modified_when timestamp, structure_groups array<int>, " + ", ".join(f"{f}_selector string" for f in RULE_FIELDS))
BLACKLIST = struct("url string")
SITE = struct("id int, name string, url string, rss_url string, last_fetch timestamp, health_start timestamp, is_healthy boolean, active boolean")
ARTICLE = struct(
    "id long, rand double, url_signature_id long, url string, fb_updated timestamp, fb_type string, fb_has_title boolean, title string, description string, feed_site_id int, "
    + ", ".join(f"{c} long" for c in COUNT_FIELDS)
    + ", spider_when timestamp, fetch_status int, fb_created timestamp"
)
DOWNLOAD = struct(
    "article_id long, in_dev_sample boolean, html string, fetch_when timestamp, scrape_when timestamp, canonical_url string, user_agent_spoof string, "
    "structure_sketch array<long>, structure_group int, headline string, dateline string, byline string, body_text string, body_html string"
)
SPIDERED = struct("id long, url string, article_id long, url_signature_id long")
FEED_URL = struct("id long, spidered_id long, `when` timestamp, site_id int")
AGGREGATE = struct("name string, base_domain string, start date, stop date, " + ", ".join(f"{k}_count_{o}_{m} double" for k in ("fb", "tw") for o in ("5d", "longterm") for m in ("centre", "scale")))

TABLES = {
    "url_signature": SIGNATURE,
    "blacklisted_url": BLACKLIST,
    "site": SITE,
    "article": ARTICLE,
    "downloaded_article": DOWNLOAD,
    "spidered_url": SPIDERED,
    "feed_url": FEED_URL,
    "aggregate_statistic": AGGREGATE,
}
