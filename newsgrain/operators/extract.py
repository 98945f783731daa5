"""Extraction by selector programs over pages.

The tree of a page is built once per row in an Arrow-backed function that
receives the page and its rules and gives all fields; joins, staleness and
status stay native.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgrain.operators.ingest import needs_extraction
from newsgrain.schemas import TEXT_FIELDS, struct

_ONE = struct("value string, which int, matches int, error string")
EMPTY_STATUS = -3


@F.pandas_udf(T.MapType(T.StringType(), _ONE))
def _fields(html: pd.Series, rules: pd.Series) -> pd.Series:
    from newsgrain.functions.dom import extract, parse

    def one(page: str | None, programs: dict | None) -> dict | None:
        if not page or not programs:
            return None
        root = parse(page)
        out = {}
        for field, program in dict(programs).items():
            error = None
            try:
                got, which = extract(program, root)
            except ValueError as e:
                got, which, error = None, None, str(e)
            text = "\n".join(got) if got else None
            out[field] = {"value": text if text and text.strip() else None, "which": which, "matches": len(got or ()), "error": error}
        return out

    return pd.Series([one(h, r) for h, r in zip(html, rules, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(struct("kind string, attribute string, n int, values array<string>")))
def annotations(html: pd.Series) -> pd.Series:
    """Semantic annotation of a page."""
    from newsgrain.functions.dom import annotations as sniff
    from newsgrain.functions.dom import parse

    return html.map(lambda x: [dict(zip(("kind", "attribute", "n", "values"), a, strict=True)) for a in sniff(parse(x))] if x else [])


def fields(html: Column, rules: Column) -> Column:
    """Map from field to struct(value, which alternative, matches, error) for a map of selector programs (J1); error says why a program cannot run."""
    return _fields(html, rules)


def extract_pages(pages: DataFrame, rules: DataFrame, names: tuple[str, ...] = TEXT_FIELDS, force: bool = False) -> DataFrame:
    """Extract stale pages, or with ``force`` all, with their signature's rules.

    pages: key columns, ``signature``, ``html``, ``scrape_when``, ``title``.  Adds
    the fields, ``scrape_when`` of the rules, and ``fetch_status`` -3 where a page
    without title gives nothing at all.
    """
    programs = F.map_from_arrays(F.array(*[F.lit(f) for f in names]), F.array(*[F.col(f"{f}_selector") for f in names]))
    side = rules.select(F.col("signature").alias("_s"), F.col("modified_when").alias("_when"), programs.alias("_rules"))
    due = pages.join(side, F.col("signature") == F.col("_s")).filter(F.lit(force) | needs_extraction(F.col("scrape_when"), F.col("_when")))
    got = due.withColumn("_x", fields(F.col("html"), F.col("_rules")))
    out = got.withColumns({**{f: F.col("_x")[f]["value"] for f in names}, "scrape_when": F.col("_when")})
    nothing = F.col("title").isNull()
    for f in names:
        nothing = nothing & F.col(f).isNull()
    return out.withColumn("fetch_status", F.when(nothing, EMPTY_STATUS).otherwise(200)).drop("_s", "_when", "_rules", "_x", "html")


def evaluate(pages: DataFrame, key: str, selectors: dict[str, str]) -> DataFrame:
    """(key, selector name, value, which, matches, error) of literal selectors on a sample."""
    programs = F.create_map(*[F.lit(x) for kv in selectors.items() for x in kv])
    return pages.select(key, F.explode(fields(F.col("html"), programs)).alias("name", "found")).select(key, "name", "found.*")


def site_patterns(pages: DataFrame, patterns: DataFrame, fallback: dict[str, str]) -> DataFrame:
    """Older extraction by site (J11): the site's patterns of a field in order, else all patterns of the field, then the global one.

    pages: ``page_id``, ``domain``, ``html``; patterns: ``domain``, ``field``, ``selectors``.
    """
    every = patterns.groupBy("field").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("selectors")))).alias("all"))
    names = [r["field"] for r in every.select("field").sort("field").collect()]  # the fields of a catalogue, a handful
    wanted = pages.select("domain").distinct().withColumn("field", F.explode(F.array(*[F.lit(x) for x in names]))).join(every, "field")
    own = wanted.join(patterns, ["domain", "field"], "left")
    last = F.create_map(*[F.lit(x) for kv in fallback.items() for x in kv]) if fallback else F.lit(None).cast("map<string,string>")
    program = F.concat_ws(";", F.coalesce("selectors", "all"), F.array(F.try_element_at(last, F.col("field"))))
    rules = own.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("field", program.alias("p")))).alias("_rules"))
    got = pages.join(rules, "domain").select("page_id", "domain", F.explode(fields(F.col("html"), F.col("_rules"))).alias("field", "found"))
    return got.select("page_id", "domain", "field", "found.value", "found.which")


def coverage(found: DataFrame, site: str, field: str, value: str) -> DataFrame:
    """Extracted share and pages per site, a column per field."""
    pages = F.countDistinct("page_id").alias("pages")
    ratio = found.groupBy(site).pivot(field).agg(F.avg(F.col(value).isNotNull().cast("double")))
    return found.groupBy(site).agg(pages).join(ratio, site)


def selector_coverage(pages: DataFrame, key: str, selector: str) -> DataFrame:
    """Percent of pages on which one selector finds something."""
    got = evaluate(pages, key, {"s": selector})
    return got.agg(F.count(F.lit(1)).alias("pages"), (100 * F.avg((F.col("matches") > 0).cast("double"))).alias("percent"))
