"""Signals of pages: one projection over whole pages, and the joins that use it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import identity as ident
from tessera.functions import markup as mk
from tessera.functions.rules import CONTENT_FLAGS, HTML_FLAGS
from tessera.operators.merge import upsert_replace
from tessera.operators.patterns import held
from tessera.sources.stored import append_dated, merge_buckets

MOST_LINKS = 401
#: Rows of a configuration table that is checked against every row.
CONFIG_ROWS = 10_000


def config(rows: DataFrame, most: int = CONFIG_ROWS) -> DataFrame:
    """A broadcast of a configuration table; a table of more than ``most`` rows is an error, never cut."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"a configuration table has more than {most} rows")
    return F.broadcast(rows)


def page_scan(pages: DataFrame, most: int = 900_000) -> DataFrame:
    """Pages with markup, cut to ``most`` characters."""
    return pages.where(F.col("html").isNotNull() & F.col("html").rlike("<")).withColumn("html", F.substring("html", 1, most))


def public_pages(urls: DataFrame, column: str = "url") -> DataFrame:
    """Rows whose URL names a public host; what isn't one is never asked for."""
    return urls.where(ident.is_public(F.col(column)))


def extract_signals(pages: DataFrame) -> DataFrame:
    """Append the text, metadata and flags of each page (page_id, url, html)."""
    p = pages.withColumn("clean", mk.stripped(F.col("html"))).withColumn("text", mk.text_of(F.col("clean")))
    p = p.withColumns({"low_text": F.lower("text"), "low_clean": F.lower("clean")})
    clean, text, html = F.col("clean"), F.col("text"), F.col("html")
    prices = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\$\s?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)"), 1), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double")), lambda v: (v > 0) & (v < 100000))
    tags = F.regexp_extract_all(clean, F.lit(mk.ascii_bounds(r"(?i)(<img\b[^>]*>)")), 1)
    p = p.withColumns({"prices": F.array_sort(F.slice(prices, 1, 301)), "tags": tags})
    shown = lambda test: F.size(F.filter("tags", test)).cast("long")
    years = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(?:©|copyright)\s*(?:\d{4}\s*[-–]\s*)?(\d{4})"), 1), lambda y: y.cast("int")), lambda y: (y >= 2000) & (y <= 2100))
    return p.withColumns({
        "title": mk.title(clean), "meta_description": F.substring(mk.meta(clean, "name", "description"), 1, 400), "site_name": mk.meta(clean, "property", "og:site_name"),
        "platform": mk.platform(html, clean), "has_viewport": clean.rlike(r"(?i)<meta[^>]+name\s*=\s*[\"']viewport[\"']"),
        "text_len": F.length(text).cast("long"), "word_count": F.regexp_count(text, F.lit(r"\S+")).cast("long"), "text_sample": F.substring(text, 1, 3000),
        "price_count": F.size("prices").cast("long"), "price_median": F.get("prices", F.floor(F.size("prices") / 2).cast("int")), "price_max": F.array_max("prices"), "copyright_year": F.array_max(years),
        "add_to_cart_hits": F.regexp_count("low_clean", F.lit("add to cart|add to bag|buy now|shop now")).cast("long"),
        "has_cart": mk.found(F.col("low_clean"), "/cart|shopping-cart|cart-count|cart-drawer"),
        "generator": mk.generator(clean), "img_count": F.size("tags").cast("long"), "img_with_dims": shown(lambda t: t.rlike(r"(?i)width\s*=") & t.rlike(r"(?i)height\s*=")),
        "img_lazy": shown(lambda t: t.rlike(r"(?i)loading\s*=\s*[\"']lazy[\"']")), "img_srcset": shown(lambda t: t.rlike(r"(?i)srcset\s*=")),
        **{k: mk.found(F.col("low_text"), v, collapsed=True) for k, v in CONTENT_FLAGS.items()}, **{k: mk.found(F.col("low_clean"), v) for k, v in HTML_FLAGS.items()},
        "us_hint": mk.us_hint(text), "content_hash": content_hash("html"),
    }).withColumn("responsive_hint", F.col("has_viewport") & ((F.col("img_srcset") > 0) | html.rlike("(?i)@media"))).drop("low_text", "low_clean", "tags")


def content_hash(column: str):
    """First 32 hex digits of the SHA-256 of the page without comments and with white space collapsed."""
    s = F.regexp_replace(F.regexp_replace(F.col(column), r"(?s)<!--.*?-->", ""), r"\s+", " ")
    return F.substring(F.sha2(F.trim(s), 256), 1, 32)


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, page_url, pos, url, host, label) of each page's first anchors with an http(s) target."""
    a = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(F.regexp_extract_all(mk.stripped(F.col("html")), F.lit(mk.ascii_bounds(r"(?is)(<a\b[^>]*>.{0,200}?</a>)")), 1)).alias("pos", "a"))
    href = mk.attribute(F.regexp_extract("a", mk.ascii_bounds(r"(?is)^(<a\b[^>]*>)"), 1), "href")
    a = a.withColumn("url", mk.absolute(href, F.col("page_url"))).where("url is not null")
    a = a.withColumns({"host": ident.host(F.col("url")), "label": F.substring(mk.visible(F.col("a")), 1, 120)})
    w = Window.partitionBy("page_id").orderBy("pos")
    return a.withColumn("n", F.row_number().over(w)).where(F.col("n") <= MOST_LINKS).select("page_id", "page_url", "pos", "url", "host", "label")


def link_counts(links: DataFrame) -> DataFrame:
    """Product and collection links of each page."""
    n = lambda pattern, name: F.count_if(F.col("url").rlike(pattern)).alias(name)
    return links.groupBy("page_id").agg(n("(?i)/products?/", "product_links"), n("(?i)/collections?/|/shop/", "collection_links"))


def contact_links(links: DataFrame, most: int = 3) -> DataFrame:
    """Same-host links that probably lead to an address: by path, then label; the best of each path, ``most`` a page."""
    path, label = F.lower(F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)), F.lower("label")
    by_path = F.when(path.contains("/contact"), 50).when(path.contains("/about"), 30).when(path.rlike("/pages/(contact|about|our-story|stockists|wholesale)"), 40).when(path.rlike("/(info|support|help|faq|imprint|impressum|legal|team)"), 20).when(path.rlike("/(stockists|wholesale|trade|press)"), 18).otherwise(0)
    by_label = F.when(label.rlike(mk.ascii_bounds(r"\bcontact\b|get in touch|say hello|reach us|email us")), 25).when(label.rlike(mk.ascii_bounds(r"\babout\b|our story|the studio")), 12).otherwise(0)
    s = links.where(F.col("host") == ident.host(F.col("page_url"))).withColumns({"path": path, "score": by_path + by_label}).where("score > 0")
    best = s.groupBy("page_id", "path").agg(F.max(F.struct("score", (-F.col("pos")).alias("first"), "url")).alias("m"))
    w = Window.partitionBy("page_id").orderBy(F.desc("m.score"), F.desc("m.first"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("page_id", "rank", F.col("m.url").alias("url"), F.col("m.score").alias("score"))


def js_shell_pages(signals: DataFrame) -> DataFrame:
    """Thin pages that a script fills: few words and images, two scripts or more, a known root element."""
    root = F.col("html").rlike(r"(?i)id\s*=\s*[\"'](root|app|__next|__nuxt|___gatsby)[\"']")
    return signals.where((F.col("word_count") < 60) & (F.col("img_count") < 4) & (F.regexp_count("html", F.lit("(?i)<script")) >= 2) & root)


def append_snapshots(snapshots: DataFrame | None, signals: DataFrame, fetched_at, status: int = 200, render_mode: str = "static") -> DataFrame:
    """Snapshots with a row for each page of ``signals`` added: when and how it was read, what it held, its signals as JSON."""
    own = ("page_id", "url", "html", "clean", "text", "content_hash")
    found = F.to_json(F.struct(*[c for c in signals.columns if c not in own]))
    new = signals.select("page_id", "url", F.lit(fetched_at).alias("fetched_at"), F.lit(status).alias("status"), "content_hash", F.octet_length("html").cast("long").alias("bytes"), "text_sample", F.lit(render_mode).alias("render_mode"), found.alias("signals"))
    return new if snapshots is None else snapshots.unionByName(new)


def store_snapshots(path: str, current: str, signals: DataFrame, fetched_at, batch: int, most: int = 64) -> None:
    """Append a batch's snapshots to the table at ``path``, by date, and move the bucketed table ``current`` of each page's last one.

    A batch that runs again replaces its own snapshots, and leaves the last ones as they are.
    """
    new = append_snapshots(None, signals, fetched_at)
    append_dated(new, path, "fetched_at", batch)
    last = new.select("page_id", "content_hash", "fetched_at")
    merge_buckets(current, last, ["page_id"], lambda t, n: upsert_replace(t, n, ["page_id"], [F.col("fetched_at"), F.col("content_hash")]), most)


def touch_unchanged(entities: DataFrame, pages: DataFrame, snapshots: DataFrame, at) -> DataFrame:
    """Entities (key, last_evaluated) whose page (key, content_hash) holds what its latest snapshot held: only the time moves."""
    same = pages.select("key").join(changed_pages(pages, snapshots).select("key"), "key", "left_anti").distinct().withColumn("_same", F.lit(True))
    return entities.join(same, "key", "left").withColumn("last_evaluated", F.when(F.col("_same"), F.lit(at)).otherwise(F.col("last_evaluated"))).drop("_same")


def changed_pages(pages: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Pages (key, content_hash) whose hash differs from the key's latest snapshot (key, content_hash, fetched_at)."""
    last = snapshots.groupBy("key").agg(F.max(F.struct("fetched_at", "content_hash"))["content_hash"].alias("_old"))
    return pages.join(last, "key", "left").where(~F.col("content_hash").eqNullSafe(F.col("_old"))).drop("_old")


def guess_niche(texts: DataFrame, keywords: DataFrame, fallback: str, least: int = 2, many: bool = False) -> DataFrame:
    """Texts (id, text; ids are unique) by the niche with most keyword hits; phrases count twice, the first niche wins ties.

    keywords (niche, place, keyword) is a profile's configuration. A few hundred rows are checked against each text by a
    broadcast nested loop, of which more than CONFIG_ROWS rows are an error. ``many`` looks them up in an index of the texts'
    runs of characters instead, whatever their number.
    """
    t = texts.select("id", F.lower("text").alias("t"))
    if many:
        hit = held(t, keywords, text="t", pattern="keyword").join(keywords.where("keyword <> ''"), F.col("pattern") == F.col("keyword"))
    else:
        hit = t.join(config(keywords), F.col("t").contains(F.col("keyword")))
    n = hit.groupBy("id", "niche", "place").agg(F.sum(F.when(F.col("keyword").contains(" "), 2).otherwise(1)).alias("hits"))
    best = n.groupBy("id").agg(F.max(F.struct("hits", (-F.col("place")).alias("first"), "niche")).alias("m"))
    return t.select("id").join(best, "id", "left").select("id", F.when(F.col("m.hits") >= least, F.col("m.niche")).otherwise(fallback).alias("niche"))
