"""Normal forms of identifiers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import HANDLE_TAILS, LEGAL_SUFFIXES, MARKETPLACES, MULTI_PART_SUFFIXES, PRIVATE_HOSTS


def filled(c: Column) -> Column:
    """Null where empty."""
    return F.when(c != "", c)


def host(url: Column) -> Column:
    """Lower-case host of a URL or bare host, without user, port and leading www."""
    s = F.lower(F.trim(url))
    s = F.when(s.rlike(r"^[a-z][a-z0-9+.-]*://"), F.regexp_replace(s, r"^[a-z][a-z0-9+.-]*://", "")).otherwise(s)
    h = F.regexp_extract(s, r"^(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(filled(h), r"^www\.", "")


def domain(url: Column) -> Column:
    """Registrable domain: the last two labels, or three where the last two are a public suffix; null without a dot or with white space."""
    h = host(url)
    parts = F.split(h, r"\.")
    two = F.array_join(F.slice(parts, -2, 2), ".")
    three = F.array_join(F.slice(parts, -3, 3), ".")
    n = F.size(parts)
    return F.when(~h.rlike(r"\.") | h.rlike(r"\s"), None).when(n <= 2, h).when(two.isin(MULTI_PART_SUFFIXES), three).otherwise(two)


def norm_url(url: Column) -> Column:
    """https, lower host without www, no fragment, no tracking parameters, no trailing slashes; a bare host ends in one."""
    s = F.regexp_replace(F.trim(url), r"#.*$", "")
    ok = ~F.lower(s).rlike(r"^[a-z][a-z0-9+.-]*:") | F.lower(s).rlike(r"^https?://")
    rest = F.regexp_replace(s, r"^(?i)https?://[^/?#]*", "")
    rest = F.when(F.lower(s).rlike(r"^https?://"), rest).otherwise(F.regexp_replace(s, r"^[^/?#]*", ""))
    path = F.regexp_replace(F.regexp_replace(rest, r"\?.*$", ""), r"/+$", "")
    query = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(r"^(?i)(utm_|fbclid|gclid|mc_|ref|source|_ga)"))
    tail = F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")
    return F.when(ok & host(url).rlike(r"\."), F.concat(F.lit("https://"), host(url), F.when(path == "", "/").otherwise(path), tail))


def handle(value: Column, site: str) -> Column:
    """Handle from a profile URL of ``site``, an @name or a bare name; null for another site."""
    s = F.lower(F.trim(value))
    bare = ~s.contains("/") & ~s.contains(".")
    path = F.regexp_extract(s, r"^(?:https?://)?[^/]+/+@?([^/?#]+)", 1)
    return filled(F.when(bare, F.regexp_replace(s, "^@", "")).when(host(s).endswith(site), path))


def shop_handle(value: Column) -> Column:
    """Handle of a marketplace shop."""
    s = F.lower(F.trim(value))
    found = F.regexp_extract(s, r"etsy\.com/(?:[a-z-]+/)?shop/([a-z0-9_-]+)", 1)
    return filled(F.when(found != "", found).when(~s.contains("/") & ~s.contains("."), F.regexp_replace(s, "^@", "")))


def email(value: Column) -> Column:
    s = F.lower(F.trim(value))
    return F.when(s.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), s)


def name(value: Column) -> Column:
    """Lower-case words without apostrophes, signs and legal suffixes; null under 3 characters."""
    s = F.regexp_replace(F.lower(value), "['’`]", "")
    s = F.regexp_replace(F.regexp_replace(s, "&", " and "), r"[^a-z0-9\s]", " ")
    s = F.regexp_replace(s, rf"\b({'|'.join(LEGAL_SUFFIXES)})\b", " ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(F.length(s) >= 3, s)


def slugs(value: Column) -> Column:
    """Alphanumeric slug of 5 characters or more, and a variant without a trailing generic word."""
    full = F.regexp_replace(F.lower(value), "[^a-z0-9]", "")
    cut = F.regexp_replace(full, HANDLE_TAILS, "")
    return F.when(F.length(full) >= 5, F.when((cut != full) & (F.length(cut) >= 5), F.array(full, cut)).otherwise(F.array(full))).otherwise(F.array().cast("array<string>"))


def is_public(url: Column) -> Column:
    """Whether a URL or bare host names a public host: one with a dot that is no private range, local name or metadata service."""
    s = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    h = F.regexp_replace(F.regexp_extract(s, r"^(?:[^/?#@]*@)?(\[[^\]/?#]*\]?|[^/?#:]*)", 1), r"\.$", "")
    return F.coalesce(h.contains(".") & ~h.rlike("|".join(PRIVATE_HOSTS)), F.lit(False))


def is_marketplace(dom: Column) -> Column:
    return dom.isin(MARKETPLACES)
