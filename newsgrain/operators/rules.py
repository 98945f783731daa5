"""Extraction rules and their inheritance.

A rule table has ``signature``, ``base_domain``, ``modified_when`` and one
``{field}_selector`` per field.  The row whose signature is its base domain
holds the domain's defaults; inherited selectors start with ``<domain>`` or
``<default>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgrain.schemas import TEXT_FIELDS

DOMAIN, DEFAULT = "<domain>", "<default>"
#: What is extracted where no rule says otherwise.
GLOBAL_RULES = {
    "headline": '((text))[itemprop~="headline"]; ((text))h1; [property~="og:title"]::attr(content)',
    "body_text": '((text))[property~="articleBody"] > p;\n((text))[itemprop~="articleBody"] > p;\n((text))((readability.summary))p',
    "byline": "((text))[itemprop~=author];\n((text)).hnews .author .fn;\n((text))[rel=author];((text)).byline",
    "dateline": "[property~=datePublished]::attr(datetime); [property~=dateCreated]::attr(datetime); [itemprop~=datePublished]::attr(datetime); [itemprop~=dateCreated]::attr(datetime)",
}


def is_domain_default() -> Column:
    """The row holds a domain's defaults."""
    return F.col("signature") == F.col("base_domain")


def inherits(prefix: str, fields: Sequence[str] = TEXT_FIELDS) -> Column:
    """Any field's selector starts with the prefix."""
    out = F.lit(False)
    for f in fields:
        out = out | F.coalesce(F.col(f"{f}_selector").startswith(prefix), F.lit(False))
    return out


def bare(selector: Column) -> Column:
    """Without the inheritance prefixes."""
    return F.regexp_replace(selector, r"^(<domain>)?(<default>)?\s*", "")


def status(letters: dict[str, str]) -> Column:
    """A letter per field (C16): upper case for a rule of the signature itself, lower case for an inherited one that says something."""
    parts = []
    for f, x in letters.items():
        s = F.col(f"{f}_selector")
        own = s.isNotNull() & ~s.startswith(DOMAIN) & ~s.startswith(DEFAULT)
        parts.append(F.when(own, F.lit(x.upper())).when(s.isNotNull() & (F.regexp_replace(s, "^(<domain>|<default>)+", "") != ""), F.lit(x.lower())).otherwise(""))
    return F.concat(*parts)


def specificity(selector: Column) -> Column:
    """Where a rule comes from: signature, domain or global."""
    return F.when(selector.startswith(DOMAIN + DEFAULT) | selector.startswith(DEFAULT), "global").when(selector.startswith(DOMAIN), "domain").when(selector.isNotNull(), "signature")


def refreshed(rules: DataFrame, fields: Sequence[str] = TEXT_FIELDS, defaults: dict[str, str] | None = None) -> DataFrame:
    """Every inherited selector from its present source.

    Domain rows inherit the global rules where they are null or start with
    ``<default>``; other rows inherit their domain row where they are null or
    start with ``<domain>``.  A row whose rules change takes the later
    modification time.
    """
    defaults = defaults or GLOBAL_RULES
    domain = rules.filter(is_domain_default()).select(
        F.col("base_domain").alias("_d"),
        F.col("modified_when").alias("_when"),
        *[F.when(F.col(f"{f}_selector").isNull() | F.col(f"{f}_selector").startswith(DEFAULT), F.lit(DEFAULT + defaults[f])).otherwise(F.col(f"{f}_selector")).alias(f"_{f}") for f in fields],
    )
    both = rules.join(domain, F.col("base_domain") == F.col("_d"), "left")
    out, changed = {}, F.lit(False)
    for f in fields:
        s = F.col(f"{f}_selector")
        source = F.coalesce(F.col(f"_{f}"), F.lit(DEFAULT + defaults[f]))
        new = F.when(is_domain_default(), source).when(s.isNull() | s.startswith(DOMAIN), F.concat(F.lit(DOMAIN), source)).otherwise(s)
        out[f"{f}_selector"] = new
        changed = changed | ~s.eqNullSafe(new)
    out["modified_when"] = F.when(changed, F.greatest("modified_when", "_when")).otherwise(F.col("modified_when"))
    return both.withColumns(out).drop("_d", "_when", *[f"_{f}" for f in fields])


def set_selector(rules: DataFrame, changes: DataFrame, field: str, when: Column) -> DataFrame:
    """Apply (signature, selector) changes (M3): equal ones change nothing, ``<domain>`` on a domain row is refused, null clears.

    Selectors are compiled before, by ``extract.compiles``.
    """
    c = changes.select(F.col("signature").alias("_s"), F.col("selector").alias("_new"), F.lit(True).alias("_hit"))
    both = rules.join(c, F.col("signature") == F.col("_s"), "left")
    col = F.col(f"{field}_selector")
    legal = F.col("_hit") & ~(is_domain_default() & F.coalesce(F.col("_new").startswith(DOMAIN), F.lit(False)))
    apply = F.coalesce(legal, F.lit(False)) & ~col.eqNullSafe(F.col("_new"))
    return both.withColumns({f"{field}_selector": F.when(apply, F.col("_new")).otherwise(col), "modified_when": F.when(apply, when).otherwise(F.col("modified_when"))}).drop("_s", "_new", "_hit")


def get_or_create(rules: DataFrame, seen: DataFrame, when: Column, fields: Sequence[str] = TEXT_FIELDS) -> DataFrame:
    """The table with a row for each new (signature, base_domain) and for its domain, all rules inherited (M1)."""
    both = seen.select("signature", "base_domain").unionByName(seen.select(F.col("base_domain").alias("signature"), "base_domain")).distinct()
    new = both.join(rules.select("signature"), "signature", "left_anti").withColumn("modified_when", when)
    return refreshed(rules.unionByName(new, allowMissingColumns=True), fields)


def popularity(rules: DataFrame, selector: str, domain: str, key: str) -> DataFrame:
    """Per selector and domain: uses in all, uses in the domain, and an example key."""
    per = rules.dropna(subset=[selector]).groupBy(selector, domain).agg(F.count(F.lit(1)).alias("in_domain"), F.min(key).alias("example"))
    return per.withColumn("overall", F.sum("in_domain").over(Window.partitionBy(selector)))


def agreement(rules: DataFrame, affiliate: str, domain: str, selector: str, modified: str) -> DataFrame:
    """Per affiliate group: distinct selectors without prefix, whether all agree, and the newest domain with a rule of its own."""
    s = F.col(selector)
    own = s.isNotNull() & ~s.startswith(DEFAULT)
    return rules.groupBy(affiliate).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(F.coalesce(bare(s), F.lit(""))).alias("selectors"),
        (F.countDistinct(F.coalesce(bare(s), F.lit(""))) == 1).alias("agree"),
        F.max_by(domain, F.when(own, F.struct(F.col(modified), F.col(domain)))).alias("source"),
    )


def by_site(patterns: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(site, field, selectors): the sites' patterns in order."""
    long = patterns.unpivot(["name", "domain"], list(fields), "field", "selector").filter("selector <> ''")
    return long.groupBy("domain", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "selector"))), lambda x: x["selector"]).alias("selectors"))


def by_field(patterns: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, selectors): the distinct patterns of a field."""
    long = patterns.unpivot(["name"], list(fields), "field", "selector").filter("selector <> ''")
    return long.groupBy("field").agg(F.array_sort(F.collect_set("selector")).alias("selectors"))


def refresh_counts(before: DataFrame, after: DataFrame, fields: Sequence[str] = TEXT_FIELDS) -> DataFrame:
    """Per field, how many selectors a refresh changed."""
    a = before.select("signature", *[F.col(f"{f}_selector").alias(f"_{f}") for f in fields])
    return after.join(a, "signature").agg(*[F.count_if(~F.col(f"{f}_selector").eqNullSafe(F.col(f"_{f}"))).alias(f) for f in fields])
