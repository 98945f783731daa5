"""As-of rollup, loading, merging and queue decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgrain.schemas import CUSTOM_STATUS

#: Offsets of the snapshots in seconds, and how late a snapshot may be.
OFFSETS = {"initial": 0, "30m": 1800, "1h": 3600, "2h": 7200, "6h": 21_600, "1d": 86_400, "5d": 432_000}
SLACK = 300


def asof(snapshots: DataFrame, key: str, when: str, published: str, values: Sequence[str]) -> DataFrame:
    """The last snapshot within each offset (and SLACK) of publication, in one aggregate pass.

    One struct column per offset, null where no snapshot is early enough; of
    equal times the greater values win.
    """
    late = F.unix_micros(F.col(when).cast("timestamp")) - F.unix_micros(F.col(published).cast("timestamp"))
    last = F.struct(F.col(when).alias("ts"), *values)
    picks = [F.max(F.when(late <= (s + SLACK) * 1_000_000, last)).alias(name) for name, s in OFFSETS.items()]
    return snapshots.groupBy(key).agg(*picks)


def asof_long(snapshots: DataFrame, key: str, when: str, published: str, values: Sequence[str]) -> DataFrame:
    """asof as rows (key, offset, values); offsets without a snapshot are absent."""
    wide = asof(snapshots, key, when, published, values)
    pairs = F.explode(F.array(*[F.struct(F.lit(o).alias("offset"), F.col(o).alias("v")) for o in OFFSETS]))
    return wide.select(key, pairs.alias("_p")).filter("_p.v IS NOT NULL").select(key, F.col("_p.offset").alias("offset"), *[F.col(f"_p.v.{v}").alias(v) for v in values])


def asof_json(wide: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """asof as JSON text ``{"offset": "a,b"}`` in offset order."""
    entries = F.array(*[F.when(F.col(o).isNotNull(), F.struct(F.lit(o).alias("k"), F.concat_ws(",", *[F.col(o)[v].cast("string") for v in values]).alias("v"))) for o in OFFSETS])
    return wide.select(key, F.to_json(F.map_from_entries(F.array_compact(entries))).alias("statistic_json"))


def parse_counts(text: Column, offset: str) -> Column:
    """The first count of an offset in asof_json text."""
    return F.split_part(F.get_json_object(text, f"$['{offset}']"), F.lit(","), F.lit(1)).try_cast("bigint")


def filled(df: DataFrame, prefix: str) -> DataFrame:
    """Counts carried forward initial, 2h, 1d, 5d (0 at first); longterm only if not 0."""
    c = lambda o: F.col(f"{prefix}_count_{o}")
    zero = F.lit(0).cast("bigint")
    return df.withColumns(
        {
            f"{prefix}_initial": F.coalesce(c("initial"), zero),
            f"{prefix}_2h": F.coalesce(c("2h"), c("initial"), zero),
            f"{prefix}_1d": F.coalesce(c("1d"), c("2h"), c("initial"), zero),
            f"{prefix}_5d": F.coalesce(c("5d"), c("1d"), c("2h"), c("initial"), zero),
            f"{prefix}_longterm": F.nullif(c("longterm"), zero),
        }
    )


def unseen(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """New rows whose key is not known."""
    return new.join(known.select(key).distinct(), key, "left_anti")


def earliest(rows: DataFrame, key: str, when: str, tie: Sequence[str] = ()) -> DataFrame:
    """One row per key: the earliest, then by the tie columns."""
    w = Window.partitionBy(key).orderBy(F.col(when).asc_nulls_last(), *tie)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert(have: DataFrame, new: DataFrame, key: str, when: str, tie: Sequence[str] = ()) -> DataFrame:
    """Merge new rows into a table by key; the earliest row of a key stays."""
    return earliest(have.unionByName(new, allowMissingColumns=True), key, when, tie)


def cascade(rows: DataFrame, key: str, lookups: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """The first lookup (table, key, value) that knows the row's key gives ``found``."""
    out = rows
    for i, (t, k, v) in enumerate(lookups):
        side = t.groupBy(F.col(k).alias(key)).agg(F.min(v).alias(f"_f{i}"))
        out = out.join(side, key, "left")
    return out.withColumn("found", F.coalesce(*[F.col(f"_f{i}") for i in range(len(lookups))])).drop(*[f"_f{i}" for i in range(len(lookups))])


def updated(rows: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """rows with the non-null values of changes, matched by key."""
    side = changes.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns])
    out = rows.join(side, key, "left").withColumns({c: F.coalesce(f"_n_{c}", c) for c in columns})
    return out.drop(*[f"_n_{c}" for c in columns])


def needs_download(status: Column) -> Column:
    """Never fetched, or neither settled nor given up."""
    settled = status.isin(200, 204, 400, 401, 402, 403, 404, 410, 500, 503) | (status < 0)
    return status.isNull() | ~settled


def needs_extraction(scraped: Column, modified: Column) -> Column:
    """Never scraped, or before the rules changed."""
    return scraped.isNull() | (scraped < modified)


def priority(fb: Column, tw: Column, created: Column, now: Column, uniform: Column | None = None) -> Column:
    """Download priority (G4): more shares and later creation weigh more; null where the creation is unknown.

    Rows without a creation time come first in the reference order, so sort with ``desc_nulls_first``.
    """
    shares = F.log10(F.coalesce(fb, F.lit(0)) + 3 * F.coalesce(tw, F.lit(0)) + 1)
    days = F.datediff(created, F.lit("2007-06-01").cast("date"))
    weight = shares + F.when(days > 0, F.log10(days)) / 4
    return weight if uniform is None else uniform * weight


def extraction_order(df: DataFrame, sampled: str, modified: str, shares: str, key: str) -> DataFrame:
    """Sampled first, then oldest rules, then most shared, nulls of shares first."""
    return df.orderBy(F.col(sampled).desc_nulls_first(), F.col(modified).asc_nulls_last(), F.col(shares).desc_nulls_first(), key)


def download_state(status: Column, mime: Column, blacklisted: Column, empty: Column) -> Column:
    """The status that a fetch is stored with (M7, H11, E6): blacklist, then failures, refused content types (unknown ones pass) and emptiness."""
    bad = F.lower(F.trim(F.split_part(mime, F.lit(";"), F.lit(1)))).rlike("^(application/pdf$|image/|audio/|video/)")
    return (
        F.when(blacklisted, -200)
        .when(status != 200, status)
        .when(bad, -111)
        .when(empty, -2)
        .otherwise(status)
        .cast("int")
    )


def status_text(status: Column) -> Column:
    """``HTTP n`` or the name of a custom state."""
    names = F.create_map(*[F.lit(x) for kv in CUSTOM_STATUS.items() for x in kv])
    return F.when(status.isNull(), None).otherwise(F.coalesce(F.when(status < 0, F.try_element_at(names, status)), F.concat(F.lit("HTTP "), status.cast("string"))))


def within_limits(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Rows whose strings are shorter than the limits; null strings pass (M8)."""
    for c, n in limits.items():
        df = df.filter(F.col(c).isNull() | (F.length(c) < n))
    return df


def set_status(articles: DataFrame, downloads: DataFrame, gone: DataFrame, key: str, status: int) -> tuple[DataFrame, DataFrame]:
    """Articles with a new status where ``gone`` has their key, and the downloads left."""
    keys = gone.select(F.col(key).alias("_k")).distinct()
    changed = articles.join(keys, F.col(key) == F.col("_k"), "left").withColumn("fetch_status", F.when(F.col("_k").isNotNull(), status).otherwise(F.col("fetch_status"))).drop("_k")
    return changed, downloads.join(gone.select(key).distinct(), key, "left_anti")


def sharing_valid(fb5d: Column, longterm: Column, tw5d: Column) -> Column:
    """Counts that make sense for distributions."""
    return F.coalesce(fb5d > 0, F.lit(False)) | F.coalesce((longterm > 0) & (longterm >= fb5d), F.lit(False)) | F.coalesce(tw5d > 0, F.lit(False))


def url_affixes(url: Column, starts: str | None = None, ends: str | None = None) -> Column:
    """Prefix and suffix filter (C11)."""
    out = F.lit(True)
    if starts:
        out = out & url.startswith(starts)
    if ends:
        out = out & url.endswith(ends)
    return out


def blacklisted(pages: DataFrame, blacklist: DataFrame, url: str) -> DataFrame:
    """Add ``blacklisted`` by canonical address (E6); the join picks its side by size."""
    side = blacklist.select(F.col("url").alias("_u")).distinct().withColumn("_hit", F.lit(True))
    return pages.join(side, F.col(url) == F.col("_u"), "left").withColumn("blacklisted", F.coalesce("_hit", F.lit(False))).drop("_u", "_hit")


def selected(df: DataFrame, contains: str | None = None, text: str = "body_text", domains: Sequence[str] = (), exclude: Sequence[str] = (), domain: str = "base_domain", least: dict[str, float] | None = None, longterm_valid: tuple[str, str] | None = None) -> DataFrame:
    """Plain filters of an export (C6, C19): text, domain lists, least counts, long-term counts not below 5-day ones.

    A null domain is not excluded by an exclusion list.
    """
    if contains:
        df = df.filter(F.col(text).contains(contains))
    if domains:
        df = df.filter(F.col(domain).isin(*domains))
    if exclude:
        df = df.filter(~F.coalesce(F.col(domain).isin(*exclude), F.lit(False)))
    for c, n in (least or {}).items():
        df = df.filter(F.col(c) >= n)
    if longterm_valid:
        df = df.filter(F.col(longterm_valid[1]) >= F.col(longterm_valid[0]))
    return df


def error_code(message: Column) -> Column:
    """The one-digit code of an API error message (H42); null without one."""
    return F.regexp_extract(message, r"#?\b(?:code|error)\D{0,12}(\d)", 1).try_cast("int")
