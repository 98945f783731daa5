"""HTML transforms, native but for link resolution and decoding."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgrain.functions.text import strip, xml_escape
from newsgrain.functions.url import resolved


#: The tags and attributes in which canonical addresses are looked for.
OG_TAG = r"(?i)<meta\b[^>]*\bproperty=.og:url[^>]*"
OG_ATTRIBUTE = r"""(?i)\bcontent=(["']|)(h.+?)\1(?:[\s>]|$)"""
CANONICAL_TAG = r"(?i)<link\b[^>]*\brel=.canonical[^>]*"
CANONICAL_ATTRIBUTE = r"""(?i)\bhref=(["']|)(h.+?)\1(?:[\s>]|$)"""
SCRIPTS = r"(?is)<(script|style|iframe)\b.*?</\1\b.*?>"
BLANKS = r"[ \t]*(\n)[ \t]*(\n?)[ \t\n\x0B\f\r]*"


def compress(html: Column) -> Column:
    """Without script, style and iframe elements, runs of blank lines down to one, stripped; comments stay (H8)."""
    out = F.regexp_replace(html, SCRIPTS, "")
    out = F.regexp_replace(out, BLANKS, "$1$2")
    return strip(out)


def _attribute(html: Column, tag: str, attribute: str) -> Column:
    """The value that ``attribute`` finds in the first such tag, null without one."""
    value = F.regexp_extract(F.regexp_extract(html, tag, 0), attribute, 2)
    return F.when(value != "", value)


def canonical(html: Column, base: Column) -> Column:
    """The canonical link (H5), resolved; null without one."""
    return resolved(_attribute(html, CANONICAL_TAG, CANONICAL_ATTRIBUTE), base)


def social_canonical(html: Column, base: Column) -> Column:
    """The og:url of the page, else its canonical link (H6)."""
    og = _attribute(html, OG_TAG, OG_ATTRIBUTE)
    link = _attribute(html, CANONICAL_TAG, CANONICAL_ATTRIBUTE)
    return resolved(F.coalesce(og, link), base)


def with_base(html: Column, url: Column) -> Column:
    """Links resolve against ``url``: any base element is replaced by one at the start of the head (H9)."""
    own = F.regexp_extract(html, r"""(?i)<base[^>]*\bhref=["']?([^"'>\s]*)""", 1)
    target = F.when(own != "", resolved(own, url)).otherwise(url)
    bare = F.regexp_replace(html, r"(?i)<base\b[^>]*>", "")
    head = F.regexp_extract(bare, r"(?i)<head[^>]*>", 0)
    at = F.locate("\x00", F.regexp_replace(bare, r"(?i)<head[^>]*>", "\x00"))
    return F.when(head == "", bare).otherwise(F.concat(F.substring(bare, F.lit(1), at - 1), head, F.lit('<base href="'), xml_escape(target), F.lit('">'), F.substring(bare, at + F.length(head), F.length(bare))))


def refresh_target(html: Column) -> Column:
    """The address of a meta refresh (H22); null without one."""
    tag = F.regexp_extract(html, r"""(?is)<meta[^>]*?http-equiv=["']?refresh["']?[^>]*>""", 0)
    url = F.regexp_extract(tag, r"""(?is)content=["'][^>]+?url=([^>]*?)["']""", 1)
    return F.when(url != "", url)


def meta_fields(html: Column) -> Column:
    """Sorted array of struct(name, content) of the meta tags that have both, quoted; common entities resolved."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\s.*?>"), F.lit(0))

    def pair(t: Column) -> Column:
        name = F.regexp_extract(t, r"""(?i)\bname=(["'])(.*?)\1""", 2)
        content = F.regexp_extract(t, r"""(?i)\bcontent=(["'])(.*?)\1""", 2)
        for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            content = F.replace(content, F.lit(code), F.lit(sign))
        return F.struct(name.alias("name"), content.alias("content"), t.rlike(r"""(?i)\bname=["'].*\bcontent=["']|\bcontent=["'].*\bname=["']""").alias("both"))

    kept = F.filter(F.transform(tags, pair), lambda s: s["both"] & (s["name"] != ""))
    return F.array_sort(F.transform(kept, lambda s: F.struct(s["name"].alias("name"), s["content"].alias("content"))))


def debug_view(html: Column, assets: str) -> Column:
    """Without stylesheet links, with debug assets at the end."""
    bare = F.regexp_replace(html, r"(?is)<link\b[^>]*\bstylesheet\b[^>]*>", "")
    return F.regexp_replace(bare, r"(?i)</html>", assets.replace("$", r"\$") + "</html>")


def spaced_selector(selector: Column) -> Column:
    """A selector list with room around its separators."""
    return F.replace(F.replace(selector, F.lit(";"), F.lit(" ; ")), F.lit(","), F.lit(", "))


def decode_page(raw: bytes | None, content_type: str | None) -> str | None:
    """A page's text (H10): the charset of its http-equiv meta tag, else of the HTTP header, else UTF-8, else Windows-1252.

    Pages that claim ISO-8859 but hold UTF-8 quotation marks are UTF-8.
    """
    if raw is None:
        return None
    tag = re.search(rb'(?i)<meta[^>]*http-equiv="content-type"[^>]*>', raw)
    source = tag.group().decode("ascii", "replace") if tag and b";" in tag.group() else content_type or ""
    named = re.search(r"(?i)charset=[\"']?([\w-]+)", source)
    charset = named[1].lower() if named else None
    if charset and charset.startswith("iso") and b"\xe2\x80" in raw:
        return raw.decode("utf-8", "ignore")
    for c in (charset, "utf-8", "cp1252"):
        try:
            if c:
                return raw.decode(c)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("cp1252", "replace")


@F.pandas_udf(T.StringType())
def _decoded(raw: pd.Series, content_type: pd.Series) -> pd.Series:
    return pd.Series([decode_page(r, c) for r, c in zip(raw, content_type, strict=True)], dtype=object)


def decoded(raw: Column, content_type: Column) -> Column:
    """decode_page over binary columns."""
    return _decoded(raw, content_type)
