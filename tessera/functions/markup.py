"""Text, metadata and flags of HTML pages, as columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import PLATFORMS, US_STATES, US_WORDS


def ascii_bounds(pattern: str) -> str:
    """``pattern`` with \\b as the bound of a run of [A-Za-z0-9_], as its \\w; Java's own takes other letters for such a run before version 19."""
    return pattern.replace(r"\b", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))")


def stripped(html: Column) -> Column:
    """Without scripts, styles and comments."""
    s = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    s = F.regexp_replace(s, r"(?is)<style.*?</style>", " ")
    return F.regexp_replace(s, r"(?s)<!--.*?-->", " ")


def decoded(s: Column) -> Column:
    """Numeric entities as characters; control characters stay written out."""
    def put(acc: Column, written: Column, code: Column) -> Column:
        ok = (code >= 32) & ~code.between(127, 159) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(ok, F.replace(acc, written, char)).otherwise(acc)

    tens = F.array_distinct(F.regexp_extract_all(s, F.lit(r"&#(\d{1,7});"), 1))
    one = F.aggregate(tens, s, lambda acc, d: put(acc, F.concat(F.lit("&#"), d, F.lit(";")), d.cast("int")))
    hexes = F.array_distinct(F.regexp_extract_all(one, F.lit(r"&#[xX]([0-9a-fA-F]{1,6});"), 1))
    two = F.aggregate(hexes, one, lambda acc, h: put(put(acc, F.concat(F.lit("&#x"), h, F.lit(";")), F.conv(h, 16, 10).cast("int")), F.concat(F.lit("&#X"), h, F.lit(";")), F.conv(h, 16, 10).cast("int")))
    return F.when(s.contains("&#"), two).otherwise(s)


def visible(html: Column) -> Column:
    """The page's text with white space collapsed."""
    return text_of(stripped(html))


def text_of(clean: Column) -> Column:
    """The text of a page that is stripped() already."""
    s = F.regexp_replace(decoded(clean), "<[^>]+>", " ")
    s = F.replace(F.replace(s, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    s = F.replace(F.regexp_replace(s, "&#39;|&apos;", "'"), F.lit("&quot;"), F.lit('"'))
    return F.trim(F.regexp_replace(F.regexp_replace(s, "(?i)&[a-z]+;", " "), r"\s+", " "))


def attribute(tag: Column, attr: str) -> Column:
    return F.regexp_extract(tag, rf"(?i){attr}\s*=\s*[\"']([^\"']*)[\"']", 1)


def title(clean: Column) -> Column:
    return F.trim(F.regexp_extract(clean, r"(?is)<title[^>]*>(.{0,300}?)</title>", 1))


def meta(clean: Column, attr: str, value: str) -> Column:
    """Content of a meta tag; empty without one."""
    return attribute(F.regexp_extract(clean, rf"(?is)<meta[^>]+{attr}\s*=\s*[\"']{value}[\"'][^>]*>", 0), "content")


def generator(clean: Column) -> Column:
    return meta(clean, "name", "generator")


def platform(html: Column, clean: Column) -> Column:
    found = [F.when(html.rlike(f"(?i){pattern}"), name) for name, pattern in PLATFORMS]
    named = F.lower(F.regexp_extract(generator(clean), r"^([^\s\d]*)", 1))
    return F.coalesce(*found, F.when(named != "", named))


def found(s: Column, pattern: str, collapsed: bool = False) -> Column:
    """Whether an alternation of phrases matches in ``s``: each phrase by itself, a plain one without a pattern.

    ``collapsed``: white space in ``s`` is single spaces, so white space between words is a plain space.
    """
    phrases = re.findall(r"(?:\([^)]*\)|[^|(])+", pattern.replace(r"\s+", " ") if collapsed else pattern)
    plain = lambda p: not re.search(r"[\\()\[\]?*+.^$]", p.replace(r"\.", ""))
    return reduce(Column.__or__, [s.contains(p.replace(r"\.", ".")) if plain(p) else s.rlike(p) for p in sorted(phrases, key=plain, reverse=True)])


def us_hint(text: Column) -> Column:
    return text.rlike(ascii_bounds(rf"\b({US_STATES})\b[\s,]*\d{{5}}")) | text.rlike(ascii_bounds(rf"(?i)\b({US_WORDS})\b"))


def absolute(href: Column, page_url: Column) -> Column:
    """An anchor's http(s) URL; other schemes, and paths relative to the page's folder, give null."""
    origin = F.regexp_extract(page_url, r"^(https?://[^/?#]+)", 1)
    scheme = F.regexp_extract(page_url, r"^(https?:)", 1)
    return F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(origin, href))
