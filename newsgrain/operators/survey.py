"""Survey and linguistic tools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgrain.operators.ranges import numbered


def quantised(when: Column, months: int) -> Column:
    """The first month of its period of so many months, ``yyyy-mm``."""
    return F.format_string("%04d-%02d", F.year(when), ((F.month(when) - 1) / months).cast("int") * months + 1)


def status_group(status: Column) -> Column:
    """ERR, HOME for a page that ended at a domain root (``200?``), else its hundred."""
    return F.when(status.endswith("?"), "HOME").when(status.rlike(r"^\d"), F.concat(F.substring(status, 1, 1), F.lit("xx"))).otherwise("ERR")


def status_binary(status: Column) -> Column:
    return F.when(status.rlike(r"^2\d\d$"), "OK").otherwise("BAD")


def status_char(status: Column) -> Column:
    """One character per status for the grid: ``#`` fine, ``x`` lost or at a root, ``!`` error, ``.`` for none."""
    lost = status.startswith("4") | status.startswith("5") | (status == "200?")
    return F.when(status.isNull(), ".").when(status == "200", "#").when(lost, "x").when(status.startswith("<"), "!").otherwise(F.substring(status, 1, 1))


def distribution(df: DataFrame, keys: Sequence[str], category: str, weights: DataFrame | None = None) -> DataFrame:
    """Share of each category per key, times the key's weight (D21); weights: (keys, weight)."""
    per = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("n"))
    out = per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    if weights is not None:
        out = out.join(weights, list(keys)).withColumn("share", F.col("share") * F.col("weight")).drop("weight")
    return out


def rolled_up(dist: DataFrame, keys: Sequence[str], category: str, categories: Sequence[str]) -> DataFrame:
    """Summed shares per key, a column per category, 0 where absent."""
    wide = dist.groupBy(*keys).pivot(category, list(categories)).agg(F.sum("share"))
    return wide.fillna(0.0, subset=list(categories))


def status_grid(df: DataFrame, group: str, month: str, status: str, months: Sequence[str]) -> DataFrame:
    """Per group a character per month: that of its most frequent status."""
    per = df.groupBy(group, month, status_char(F.col(status)).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    best = per.groupBy(group, month).agg(F.max(F.struct("n", "c"))["c"].alias("c"))
    wide = best.groupBy(group).pivot(month, list(months)).agg(F.first("c"))
    return wide.select(group, F.concat(*[F.coalesce(F.col(f"`{m}`"), F.lit(" ")) for m in months]).alias("grid"))


def pframes(ngrams: DataFrame, ngram: str, freq: str) -> DataFrame:
    """Frames of n-grams with one token open (D24): those with several variants, by falling number, numbered."""
    tokens = F.split(ngram, " ")
    frames = F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.array_join(F.transform(tokens, lambda t, j: F.when(j + 1 == i, F.lit("*")).otherwise(t)), " "))
    per = ngrams.select(F.col(ngram).alias("_g"), F.col(freq).alias("_f"), F.explode(frames).alias("frame")).groupBy("frame").agg(F.count(F.lit(1)).alias("variants"), F.sum("_f").alias("freq"))
    return numbered(per.filter("variants > 1"), [F.desc("variants"), F.col("frame")], "rank")


def ngrams(df: DataFrame, text: str, n: int) -> DataFrame:
    """(ngram, freq) of lower-cased words."""
    w = F.filter(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    grams = F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))
    return df.select(F.explode(grams).alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("freq"))


def timeml_events(df: DataFrame, text: str, key: str) -> DataFrame:
    """Attribute frequencies of EVENT tags with an example concordance: 5 words before, up to 6 after."""
    matches = F.regexp_extract_all(F.col(text), F.lit(r"(?s)((?:\S+\s+){0,5})<EVENT\b([^>]*)>(.*?)</EVENT>((?:\s*\S+){0,6})"), F.lit(0))
    found = df.select(key, F.explode(matches).alias("m"))
    parts = found.select(key, F.regexp_replace("m", "<[^>]*>", "").alias("line"), F.explode(F.regexp_extract_all(F.regexp_extract("m", r"<EVENT\b([^>]*)>", 1), F.lit(r'(\w+="[^"]*")'), F.lit(1))).alias("attribute"))
    return parts.groupBy("attribute").agg(F.count(F.lit(1)).alias("n"), F.min_by("line", F.md5(F.concat_ws(":", F.col(key).cast("string"), "line"))).alias("example"))


def tagged_xml(df: DataFrame, doc: str, order: str) -> DataFrame:
    """Tagger rows as ``<w>`` elements with sentence and token numbers; a row with word ``-`` starts a sentence."""
    from newsgrain.functions.text import xml_escape

    w = Window.partitionBy(doc).orderBy(order)
    brk = (F.col("norm") == "-").cast("int")
    out = df.withColumn("sentence", F.sum(brk).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = Window.partitionBy(doc, "sentence").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("token", F.sum(1 - brk).over(t)).filter("norm <> '-'")
    return out.withColumn("xml", F.concat(F.lit('<w id="'), F.col("sentence").cast("string"), F.lit("."), F.col("token").cast("string"), F.lit('" pos="'), xml_escape(F.col("pos")), F.lit('" sem="'), xml_escape(F.col("sem")), F.lit('">'), xml_escape(F.col("norm"), quotes=False), F.lit("</w>")))


def survey_rows(hops: DataFrame, pages: DataFrame, dates: DataFrame) -> DataFrame:
    """One row per survey page from its hop log (id, line, code, url, mime), its HTML length and its date."""
    from newsgrain.functions import url as U

    last = hops.groupBy("id").agg(F.min_by("url", "line").alias("start_url"), F.max_by(F.struct("code", "url", "mime"), "line").alias("end"))
    row = last.join(pages, "id", "left").join(dates, "id", "left")
    at_root = (U.slashes(F.col("end.url")) <= 3) & ~U.has_query(F.col("end.url"))
    status = F.when(F.col("end.code").startswith("2") & at_root, F.concat(F.col("end.code"), F.lit("?"))).otherwise(F.col("end.code"))
    return row.select("id", "date", "start_url", U.signature(F.col("start_url"), "legacy").alias("start_sig"), F.col("end.url").alias("end_url"), U.signature(F.col("end.url"), "legacy").alias("end_sig"), status.alias("status"), F.col("end.mime").alias("mime"), "length")


def full_survey_rows(hops: DataFrame, pages: DataFrame, dates: DataFrame) -> DataFrame:
    """One row per survey page with all its columns (A29): hops as in ``survey_rows``, (id, html), (id, date).

    The end is the page's canonical address, or that of its last hop; it is shown
    by what differs from the start, ``<same>`` where nothing does.  Domains are
    registrable ones.  What is not known is ``-``; ``length`` counts the html
    without comments, stripped.
    """
    from newsgrain.functions import html as H
    from newsgrain.functions import text as X
    from newsgrain.functions import url as U

    found = hops.groupBy("id").agg(F.min_by("url", "line").alias("start"), F.max_by(F.struct("code", "url", "mime"), "line").alias("end"))
    row = pages.select("id", "html").join(found, "id", "left").join(dates, "id", "left")
    row = row.select("id", "date", "start", F.col("end.code").alias("code"), F.col("end.url").alias("last"), F.col("end.mime").alias("mime"), X.strip(F.regexp_replace("html", r"(?s)<!--.*?-->", "")).alias("bare"))
    row = row.withColumn("final", F.coalesce(H.canonical(F.col("bare"), F.col("last")), "last"))
    same = F.col("final") == F.col("start")
    at_root = (U.slashes(F.col("last")) <= 3) & ~U.has_query(F.col("last"))
    shown = {
        "start_url": F.col("start"),
        "start_domain": U.registrable(F.col("start")),
        "start_sig": U.signature(F.col("start"), "legacy"),
        "end_url": F.when(same, "<same>").otherwise(U.url_difference(F.col("final"), F.col("start"))),
        "end_domain": U.registrable(F.col("final")),
        "end_sig": U.signature(F.col("final"), "legacy"),
        "status": F.when(F.col("code").startswith("2") & at_root, F.concat("code", F.lit("?"))).otherwise(F.col("code")),
        "mime": F.col("mime"),
        "length": F.length("bare").cast("string"),
    }
    return row.select("id", F.coalesce("date", F.lit("-")).alias("date"), *[F.coalesce(c, F.lit("-")).alias(k) for k, c in shown.items()])
