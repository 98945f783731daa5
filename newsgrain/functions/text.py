"""Texts, dates, flags and export formats."""

from __future__ import annotations

from collections.abc import Callable

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the reference strips it.
_S = r"[ \t\n\x0B\f\r]"
#: Fixed value: ISO 8601 dates with an optional time, fraction of any part, and zone.
ISO = (
    r"^[12][0-9]{3}-?[01][0-9]-?[0-3][0-9]"
    r"([T ]?[0-2][0-9]([.,][0-9]+|:?[0-5][0-9]([.,][0-9]+|:?[0-5][0-9]([.,][0-9]+)?)?)"
    r"(Z|[+-][01][0-9](:?[0-5][0-9])?)?)?$"
)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{_S}+|{_S}+$", "")


def full_text(headline: Column, body: Column) -> Column:
    """Both stripped, a blank line between (H23); a missing part is empty."""
    return F.concat(F.coalesce(strip(headline), F.lit("")), F.lit("\n\n"), F.coalesce(strip(body), F.lit("")))


def first_paragraph(body: Column) -> Column:
    return F.substring_index(strip(body), "\n", 1)


def word_count(x: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(x, rf"{_S}+"), lambda w: w != "")), F.lit(0))


def fragments(parts: Column) -> Column:
    """Stripped fragments joined by a space."""
    return F.array_join(F.transform(parts, strip), " ")


def is_iso(x: Column) -> Column:
    return x.rlike(ISO)


#: Names of months and days, and words that a date may hold besides them.
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
DAYS = "mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?"
FILLERS = "at|on|and|of|ad|st|nd|rd|th|t"
_CLOCK = r"(?i)(?:^|[\st,])(\d{1,2})(?::(\d{2}))(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*(am|pm|a\.m\.?|p\.m\.?)?"
_HOUR = r"(?i)(?:^|[\s,])(\d{1,2})\s*(am|pm|a\.m\.?|p\.m\.?)(?![a-z])"
_ZONE = r"(?i)^\s*(?:(z|utc|gmt)(?![a-z]))?\s*(?:([+-])(\d{1,2}):?(\d{2})?)?(?:\s*(?-i:\(?[A-Z]{3,5}\)?))?"


def _let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of values, each of which is computed once however often the body names it."""
    held = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.get(F.transform(F.array(held), body), F.lit(0))


def _lenient(x: Column) -> Column:
    """A time from tokens: a clock with its zone, then a month's name or three numbers by their sizes, and nothing else but fillers."""
    return _let(_clock_of, x=x, clock=F.regexp_extract(x, _CLOCK, 0), hour=F.regexp_extract(x, _HOUR, 0))


def _number(c: Column) -> Column:
    return F.coalesce(F.when(c != "", c).try_cast("int"), F.lit(0))


def _clock_of(s: Column) -> Column:
    """Find where the clock ends, and read its parts."""
    exact = s["clock"] != ""
    part = lambda i, j: F.when(exact, F.regexp_extract(s["clock"], _CLOCK, i)).otherwise(F.regexp_extract(s["hour"], _HOUR, j) if j else F.lit(""))
    found = F.when(exact, s["clock"]).otherwise(s["hour"])
    at = F.instr(s["x"], found)
    rest = F.when(found == "", F.lit("")).otherwise(F.substr(s["x"], at + F.length(found)))
    before = F.when(found == "", s["x"]).otherwise(F.substring(s["x"], F.lit(1), at - 1))
    return _let(_zone_of, rest=rest, before=before, h=_number(part(1, 1)), m=_number(part(2, 0)), sec=_number(part(3, 0)), half=F.lower(F.substring(part(5, 2), 1, 1)), micros=F.rpad(F.substring(part(4, 0), 1, 6), 6, "0").try_cast("int"))


def _zone_of(s: Column) -> Column:
    """Read the offset behind the clock; what is left holds the day."""
    h, half = s["h"], s["half"]
    hour = F.when(half == "", h).when((h < 1) | (h > 12), F.lit(99)).when((half == "p") & (h < 12), h + 12).when((half == "a") & (h == 12), 0).otherwise(h)
    seconds = _number(F.regexp_extract(s["rest"], _ZONE, 3)) * 3600 + _number(F.regexp_extract(s["rest"], _ZONE, 4)) * 60
    offset = F.when(F.regexp_extract(s["rest"], _ZONE, 2) == "-", -seconds).otherwise(seconds).cast("long")
    after = F.substr(s["rest"], F.length(F.regexp_extract(s["rest"], _ZONE, 0)) + 1)
    return _let(_day_of, text=F.lower(F.concat(s["before"], F.lit(" "), after)), hour=hour, m=s["m"], sec=s["sec"].cast("decimal(8,6)"), shift=s["micros"] - offset * 1_000_000)


_MONTH = rf"(?<![a-z])({MONTHS})(?![a-z])"


def _day_of(s: Column) -> Column:
    """Take names and fillers out; only numbers may be left."""
    bare = F.regexp_replace(F.regexp_replace(s["text"], _MONTH, " "), rf"(?<![a-z])({DAYS})(?![a-z])", " ")
    return _let(
        _date_of, debris=F.regexp_replace(F.regexp_replace(bare, rf"(?<![a-z])({FILLERS})(?![a-z])", " "), r"[\d\s.,;/'-]", ""), digits=F.regexp_extract_all(bare, F.lit(r"\d+"), F.lit(0)),
        name=F.regexp_extract(s["text"], _MONTH, 1), last=F.regexp_extract(s["text"], rf"\d[^\d]+\d.*?{_MONTH}", 1) != "", hour=s["hour"], m=s["m"], sec=s["sec"], shift=s["shift"],
    )


def _date_of(s: Column) -> Column:
    """Day, month and year by name or by size."""
    digits, named = s["digits"], s["name"] != ""
    text = lambda i: F.try_element_at(digits, F.lit(i))
    n = lambda i: text(i).try_cast("int")
    big = lambda i: (n(i) > 31) | (F.length(text(i)) > 2)
    run = (F.size(digits) == 1) & F.length(text(1)).isin(6, 8)
    wide = F.length(text(1)) == 8
    of_run = lambda a, b, c: F.substring(text(1), F.when(wide, a).otherwise(b), F.when(wide, c).otherwise(2))
    year_first = big(1) | (s["last"] & ~big(2))
    month = F.ceil(F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.substring(s["name"], 1, 3)) / 3).cast("int")
    y = F.when(named, F.when(F.size(digits) == 2, F.when(year_first, text(1)).otherwise(text(2)))).when(run, of_run(1, 1, 4)).when(F.size(digits) == 3, F.when(big(1), text(1)).otherwise(text(3)))
    mon = F.when(named, month).when(run, of_run(5, 3, 2).try_cast("int")).when(big(1) | (n(1) > 12), n(2)).otherwise(n(1))
    day = F.when(named, F.when(year_first, n(2)).otherwise(n(1))).when(run, of_run(7, 5, 2).try_cast("int")).when(big(1), n(3)).when(n(1) > 12, n(1)).otherwise(n(2))
    return _let(_time_of, y=y, mon=mon, day=day, debris=s["debris"], hour=s["hour"], m=s["m"], sec=s["sec"], shift=s["shift"])


def _time_of(s: Column) -> Column:
    year = s["y"].try_cast("int")
    full = F.when(F.length(s["y"]) <= 2, F.when(year < 69, year + 2000).otherwise(year + 1900)).otherwise(year)
    when = F.try_make_timestamp(full, s["mon"], s["day"], s["hour"], s["m"], s["sec"])
    return F.when(s["debris"] == "", F.timestamp_micros(F.unix_micros(when) + s["shift"]))


def parse_date(x: Column) -> Column:
    """A time from free text, cut at ``yyyy-`` debris; null where no known form fits.

    ISO forms first; else tokens: a clock (24 hours, or am and pm) with an offset
    from UTC, a month's name or its number, day and year.  Of three numbers the
    year is the one that can be no day, and where none is, the last; of day and
    month the month comes first unless it cannot be one; two digits of a year mean
    1969 to 2068.  Names of zones but UTC count as nothing.  A date that lacks its
    day, month or year, one that does not exist, and any other word give null.
    """
    cut = strip(F.regexp_replace(x, r"(?s)yyyy-.*$", ""))
    forms = ("yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mmX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd")
    return _let(lambda s: F.coalesce(*[F.try_to_timestamp(s["cut"], F.lit(f)) for f in forms], _lenient(s["cut"])), cut=cut)


#: Data quality flags by name: each gives the condition on a text field.
DIAGNOSTICS = {
    "null": lambda c: c.isNull(),
    "markup": lambda c: c.rlike(r"(?s)<.+>"),
    "newline": lambda c: c.contains("\n"),
    "emptyline": lambda c: c.contains("\n\n"),
    "loosepunc": lambda c: c.rlike(r"[ \t\n\x0B\f\r][^\p{L}\p{N}_–—―-][ \t\n\x0B\f\r]"),
    "noniso": lambda c: ~is_iso(c),
}


def flags(fields: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """``{field}_has_{flag}`` as 0 or 1 for the flags named per field; a null field raises only ``null`` (Q25: null is not true)."""
    return {f"{f}_has_{k}": F.coalesce(DIAGNOSTICS[k](F.col(f)).cast("int"), F.lit(0)) for f, names in fields.items() for k in names}


def field_letters(fields: dict[str, str]) -> Column:
    """The letters of the fields that are not null (C15): {'headline': 'H', ...}."""
    return F.concat(*[F.when(F.col(f).isNotNull(), F.lit(x)).otherwise("") for f, x in fields.items()])


def ascii_fold(s: str | None) -> str:
    if s is None:
        return ""
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()


def camelcase(s: str | None, words: int = 15) -> str:
    """ASCII, no punctuation, each of the first words capitalised and joined."""
    return "".join(re.sub(r"[^\w\s]|_", "", ascii_fold(s)).title().split()[:words])


@F.pandas_udf(T.StringType())
def _camel(x: pd.Series) -> pd.Series:
    return x.map(camelcase)


@F.pandas_udf(T.StringType())
def _fold(x: pd.Series) -> pd.Series:
    return x.map(ascii_fold)


def folded(x: Column) -> Column:
    """ASCII alone: letters lose their accents, other signs go; null stays null."""
    return F.when(x.isNotNull(), _fold(x))


def camel(x: Column) -> Column:
    return _camel(x)


def export_text(x: Column, ascii_only: bool = True) -> Column:
    """Text for export files: folded, CRLF line ends, a final one; empty for null."""
    folded = _fold(x) if ascii_only else F.coalesce(x, F.lit(""))
    return F.when(x.isNull(), F.lit("")).otherwise(F.concat(F.replace(folded, F.lit("\n"), F.lit("\r\n")), F.lit("\r\n")))


def basename(domain: Column, when: Column, author: Column, headline: Column, key: Column | None = None) -> Column:
    """``[id_]domain_yymmdd_author_headline`` (H26); dots go from the domain, a missing author is ``-``, a missing headline ``title missing``."""
    parts = [F.replace(domain, F.lit("."), F.lit("")), F.coalesce(F.date_format(when, "yyMMdd"), F.lit("000000")), F.when(author.isNull(), F.lit("-")).otherwise(camel(author)), camel(F.coalesce(headline, F.lit("title missing")))]
    return F.concat_ws("_", *([key.cast("string")] if key is not None else []), *parts)


def xml_escape(x: Column, quotes: bool = True) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if quotes else ())):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def shortcut(url: Column) -> Column:
    return F.concat(F.lit("[InternetShortcut]\nURL="), url)


def redirect_page(url: Column) -> Column:
    u = xml_escape(url)
    return F.concat(F.lit('<html><head><meta http-equiv="refresh" content="0; url='), u, F.lit('"></head><body><a href="'), u, F.lit('">'), u, F.lit("</a></body></html>"))
