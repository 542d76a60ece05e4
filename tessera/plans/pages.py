"""Queries of page signals and identity columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import identity as ident
from tessera.functions import markup as mk
from tessera.functions.rules import CONTENT_FLAGS, HANDLE_TAILS, HTML_FLAGS, LEGAL_SUFFIXES, MULTI_PART_SUFFIXES, PLATFORMS, PRIVATE_HOSTS, US_STATES, US_WORDS
from tessera.operators import contact as ct
from tessera.operators import signals as sg

from .registry import register
from .standins import table


def quoted(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def pages(spark, sf):
    return table(spark, sf, "pages")


CLEAN = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"


def sql_visible(clean: str) -> str:
    s = f"replace(replace(regexp_replace({clean}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&')"
    s = f"replace(regexp_replace({s}, '&#39;|&apos;', '''', 'g'), '&quot;', '\"')"
    return f"trim(regexp_replace(regexp_replace({s}, '(?i)&[a-z]+;', ' ', 'g'), '\\s+', ' ', 'g'))"


SHELL = """FROM (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN '<div id="root"></div><script>a()</script>' || split_part(html, '<nav>', 1) ELSE html END AS html FROM pages))"""
PAGES = f"pg AS (SELECT page_id, url, html, {CLEAN} AS clean FROM pages), sg AS (SELECT *, {sql_visible('clean')} AS text FROM pg)"
HOST = "regexp_replace(nullif(regexp_extract(CASE WHEN regexp_matches(lower(trim({0})), '^[a-z][a-z0-9+.-]*://') THEN regexp_replace(lower(trim({0})), '^[a-z][a-z0-9+.-]*://', '') ELSE lower(trim({0})) END, '^(?:[^/?#@]*@)?([^/?#:]+)', 1), ''), '^www\\.', '')"


def sql_host(c: str) -> str:
    return HOST.format(c)


def sql_domain(c: str) -> str:
    h = sql_host(c)
    p = f"string_split({h}, '.')"
    return f"CASE WHEN NOT contains({h}, '.') OR regexp_matches({h}, '\\s') THEN NULL WHEN len({p}) <= 2 THEN {h} WHEN array_to_string({p}[-2:], '.') IN ({quoted(MULTI_PART_SUFFIXES)}) THEN array_to_string({p}[-3:], '.') ELSE array_to_string({p}[-2:], '.') END"


@register("a10_page_scan", "SELECT page_id, url, substr(html, 1, 900000) AS html FROM pages WHERE contains(html, '<')")
def a10(spark, sf):
    return sg.page_scan(pages(spark, sf)).select("page_id", "url", "html")


@register("b01_norm_domain", f"SELECT page_id, {sql_domain('url')} AS domain FROM pages")
def b01(spark, sf):
    return pages(spark, sf).select("page_id", ident.domain(F.col("url")).alias("domain"))


_REST = "CASE WHEN regexp_matches(lower({0}), '^https?://') THEN regexp_replace({0}, '^(?i)https?://[^/?#]*', '') ELSE regexp_replace({0}, '^[^/?#]*', '') END"
_NOHASH = "regexp_replace(trim(url), '#.*$', '')"


@register("b02_norm_url", f"""WITH s AS (SELECT page_id, url, {_NOHASH} AS s, {_REST.format(_NOHASH)} AS rest, {sql_host('url')} AS h FROM pages),
  q AS (SELECT *, regexp_replace(regexp_replace(rest, '\\?.*$', ''), '/+$', '') AS path, list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?i)(utm_|fbclid|gclid|mc_|ref|source|_ga)')) AS query FROM s)
  SELECT page_id, 'https://' || h || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS norm FROM q""")
def b02(spark, sf):
    return pages(spark, sf).select("page_id", ident.norm_url(F.col("url")).alias("norm"))


@register("b03_norm_handles", "SELECT c_custkey, lower(c_name) AS handle, lower(c_name) AS shop FROM customer")
def b03(spark, sf):
    c = table(spark, sf, "customer").withColumn("v", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("@"), F.col("c_name"))).otherwise(F.col("c_name")))
    return c.select("c_custkey", ident.handle(F.col("v"), "instagram.com").alias("handle"), ident.shop_handle(F.col("v")).alias("shop"))


@register("b04_norm_email", "SELECT doc_id, CASE WHEN regexp_matches(e, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN e END AS email FROM (SELECT doc_id, lower(trim(regexp_extract(text, '\\S+@\\S+'))) AS e FROM documents)")
def b04(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ident.email(F.regexp_extract("text", r"\S+@\S+", 0)).alias("email"))


def sql_name(c: str) -> str:
    s = f"regexp_replace(replace(regexp_replace(lower({c}), '[''’`]', '', 'g'), '&', ' and '), '[^a-z0-9\\s]', ' ', 'g')"
    s = f"trim(regexp_replace(regexp_replace({s}, '\\b({'|'.join(LEGAL_SUFFIXES)})\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({s}) >= 3 THEN {s} END"


_NAMES = "n AS (SELECT 'c' || c_custkey AS id, c_name || ' & Co.' AS v FROM customer UNION ALL SELECT 's' || s_suppkey, 'The ' || s_name || ', LLC' FROM supplier UNION ALL SELECT 'p' || p_partkey, p_name || ' Shop' FROM part)"


def names(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.concat("c_name", F.lit(" & Co.")).alias("v"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")), F.concat(F.lit("The "), F.col("s_name"), F.lit(", LLC")))
    return c.union(s).union(table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey")), F.concat("p_name", F.lit(" Shop"))))


@register("b05_norm_name", f"WITH {_NAMES} SELECT id, {sql_name('v')} AS name FROM n")
def b05(spark, sf):
    return names(spark, sf).select("id", ident.name(F.col("v")).alias("name"))


def sql_slugs(c: str) -> str:
    full = f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
    cut = f"regexp_replace({full}, '{HANDLE_TAILS}', '')"
    return f"CASE WHEN length({full}) >= 5 THEN CASE WHEN {cut} <> {full} AND length({cut}) >= 5 THEN [{full}, {cut}] ELSE [{full}] END ELSE [] END"


@register("b06_slug_variants", f"SELECT page_id, {sql_slugs('l')} AS slugs FROM (SELECT page_id, split_part({sql_host('url')}, '.', 1) || CASE WHEN page_id % 3 = 0 THEN '-shop' ELSE '' END AS l FROM pages)")
def b06(spark, sf):
    label = F.concat(F.split_part(ident.host(F.col("url")), F.lit("."), F.lit(1)), F.when(F.col("page_id") % 3 == 0, "-shop").otherwise(""))
    return pages(spark, sf).select("page_id", ident.slugs(label).alias("slugs"))


@register("b16_clean_title", f"WITH {PAGES}, t AS (SELECT page_id, trim(regexp_extract(clean, '(?is)<title[^>]*>(.{{0,300}}?)</title>', 1)) AS t FROM sg), f AS (SELECT *, trim(regexp_extract(t, '^(.*?)(?: [|–—·-] |$)', 1)) AS f FROM t) SELECT page_id, CASE WHEN length(f) BETWEEN 2 AND 80 THEN f ELSE substr(t, 1, 80) END AS name FROM f")
def b16(spark, sf):
    t = mk.title(mk.stripped(F.col("html")))
    first = F.trim(F.regexp_extract(t, "^(.*?)(?: [|–—·-] |$)", 1))
    return pages(spark, sf).select("page_id", F.when(F.length(first).between(2, 80), first).otherwise(F.substring(t, 1, 80)).alias("name"))


@register("c01_page_text", f"WITH {PAGES} SELECT page_id, text, length(text) AS text_len, len(regexp_extract_all(text, '\\S+')) AS word_count, substr(text, 1, 3000) AS text_sample FROM sg")
def c01(spark, sf):
    return sg.extract_signals(pages(spark, sf)).select("page_id", "text", "text_len", "word_count", "text_sample")


# every third page with a description, a generator and a style for small screens
_META = """CASE WHEN page_id % 3 = 0 THEN '<meta name="description" content="About ' || page_id || '"><meta name="generator" content="Hugo 0.1"><meta name="viewport" content="w"><style>@media print{}</style>' ELSE '' END || html"""


def sql_meta(name: str) -> str:
    return f"regexp_extract(regexp_extract(clean, '(?is)<meta[^>]+name\\s*=\\s*[\"'']{name}[\"''][^>]*>'), '(?i)content\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)"


VIEWPORT = "regexp_matches(clean, '(?i)<meta[^>]+name\\s*=\\s*[\"'']viewport[\"'']')"
TITLE = "trim(regexp_extract(clean, '(?is)<title[^>]*>(.{0,300}?)</title>', 1))"


@register("c02_page_meta", f"WITH {PAGES.replace('FROM pages)', f'FROM (SELECT page_id, url, {_META} AS html FROM pages))')} SELECT page_id, {TITLE} AS title, {VIEWPORT} AS has_viewport, substr({sql_meta('description')}, 1, 400) AS meta_description, {sql_meta('generator')} AS generator, {VIEWPORT} AND regexp_matches(html, '(?i)@media') AS responsive_hint FROM sg")
def c02(spark, sf):
    return sg.extract_signals(pages(spark, sf).withColumn("html", F.expr(_META))).select("page_id", "title", "has_viewport", "meta_description", "generator", "responsive_hint")


@register("c03_platform", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(h, '(?i){p}') THEN '{n}'" for n, p in PLATFORMS) + " END AS platform FROM (SELECT doc_id, text || ([' wp-content', ' cdn.shopify.com', ' ', ' wixstatic.com', ' carrd.co'])[CAST(doc_id % 5 + 1 AS INT)] AS h FROM documents)")
def c03(spark, sf):
    h = F.concat("text", F.element_at(F.array(*map(F.lit, [" wp-content", " cdn.shopify.com", " ", " wixstatic.com", " carrd.co"])), (F.col("doc_id") % 5 + 1).cast("int")))
    return table(spark, sf, "documents").select("doc_id", mk.platform(h, h).alias("platform"))


_ANCHORS = f"""an AS (SELECT page_id, url AS page_url, unnest(l) AS a, unnest(range(len(l))) AS pos FROM (SELECT page_id, url, regexp_extract_all(clean, '(?is)<a\\b[^>]*>.{{0,200}}?</a>') AS l FROM sg)),
  hr AS (SELECT *, regexp_extract(regexp_extract(a, '(?is)^(<a\\b[^>]*>)', 1), '(?i)href\\s*=\\s*["'']([^"'']*)["'']', 1) AS href FROM an),
  li AS (SELECT page_id, page_url, CAST(pos AS INT) AS pos, CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(page_url, '^(https?:)', 1) || href WHEN starts_with(href, '/') THEN regexp_extract(page_url, '^(https?://[^/?#]+)', 1) || href END AS url,
    substr({sql_visible(CLEAN.replace('html', 'a'))}, 1, 120) AS label FROM hr),
  ln AS (SELECT page_id, page_url, pos, url, {sql_host('url')} AS host, label FROM li WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 401)"""


@register("c04_page_links", f"WITH {PAGES}, {_ANCHORS} SELECT page_id, pos, url, host, label FROM ln")
def c04(spark, sf):
    return sg.page_links(pages(spark, sf)).select("page_id", "pos", "url", "host", "label")


@register("c06_prices", """WITH p AS (SELECT doc_id, list_sort(list_filter(list_transform(regexp_extract_all(text, '\\$\\s?(\\d{1,3}(?:,\\d{3})*(?:\\.\\d{2})?)', 1), lambda x: CAST(replace(x, ',', '') AS DOUBLE)), lambda v: v > 0 AND v < 100000)[:301]) AS p FROM (SELECT doc_id, text || ' $' || (doc_id % 90 + 1) || ' and $1,' || (doc_id % 900 + 100) || '.50' AS text FROM documents))
  SELECT doc_id, len(p) AS price_count, p[len(p) // 2 + 1] AS price_median, list_max(p) AS price_max FROM p""")
def c06(spark, sf):
    text = F.concat("text", F.lit(" $"), F.col("doc_id") % 90 + 1, F.lit(" and $1,"), F.col("doc_id") % 900 + 100, F.lit(".50"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), text.alias("html"))
    s = sg.extract_signals(d)
    return s.select(F.col("page_id").alias("doc_id"), "price_count", "price_median", "price_max")


# two of three pages with a shop behind them
SHOP = """html || CASE page_id % 3 WHEN 0 THEN '<a href="/products/a">a</a><a href="/collections/b/product/c">b</a><button>Add to cart</button> $1,180 or $40 <img src=a srcset=x width=1 height=2><a href="https://instagram.com/i">i</a> hello@mara.studio wp-content <meta name="viewport" content="w"> Wholesale'
  WHEN 1 THEN '<a href="/shop/x">x</a><a href="/cart">c</a>' || repeat('<img src=b loading="lazy">', 16) || ' ann@mara.studio Klaviyo © 2015 our studio' ELSE '' END"""
SHOP_PAGES = PAGES.replace("FROM pages)", f"FROM (SELECT page_id, url, {SHOP} AS html FROM pages))")
LINKS = "lk AS (SELECT page_id, count(*) FILTER (regexp_matches(url, '(?i)/products?/')) AS product_links, count(*) FILTER (regexp_matches(url, '(?i)/collections?/|/shop/')) AS collection_links, arg_min(url, pos) FILTER (ends_with(host, 'instagram.com')) AS instagram FROM ln GROUP BY 1)"
CARTS, CART = "len(regexp_extract_all(lower(clean), 'add to cart|add to bag|buy now|shop now'))", "regexp_matches(clean, '(?i)/cart|shopping-cart|cart-count|cart-drawer')"


def shop_pages(spark, sf):
    return pages(spark, sf).withColumn("html", F.expr(SHOP))


@register("c08_commerce_flags", f"WITH {SHOP_PAGES}, {_ANCHORS}, {LINKS} SELECT page_id, {CARTS} AS add_to_cart_hits, {CART} AS has_cart, coalesce(product_links, 0) AS product_links, coalesce(collection_links, 0) AS collection_links, {CART} OR {CARTS} > 0 OR coalesce(product_links, 0) > 0 AS is_ecommerce FROM sg LEFT JOIN lk USING (page_id)")
def c08(spark, sf):
    return ct.full_signals(shop_pages(spark, sf)).select("page_id", "add_to_cart_hits", "has_cart", "product_links", "collection_links", "is_ecommerce")


_FLAGS = ", ".join([f"regexp_matches(text, '(?i){v}') AS {k}" for k, v in CONTENT_FLAGS.items()] + [f"regexp_matches(clean, '(?i){v}') AS {k}" for k, v in HTML_FLAGS.items()])


@register("c09_content_flags", f"WITH {PAGES} SELECT page_id, {_FLAGS} FROM sg")
def c09(spark, sf):
    return sg.extract_signals(pages(spark, sf)).select("page_id", *CONTENT_FLAGS, *HTML_FLAGS)


@register("c17_us_hint", f"SELECT doc_id, regexp_matches(t, '\\b({US_STATES})\\b[\\s,]*\\d{{5}}') OR regexp_matches(t, '(?i)\\b({US_WORDS})\\b') AS us_hint FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Shop, Austin TX' WHEN 1 THEN 'PO Box, NY 10001' ELSE '' END || ' ' || source AS t FROM documents)")
def c17(spark, sf):
    t = F.concat(F.when(F.col("doc_id") % 4 == 0, "Shop, Austin TX").when(F.col("doc_id") % 4 == 1, "PO Box, NY 10001").otherwise(""), F.lit(" "), F.col("source"))
    return table(spark, sf, "documents").select("doc_id", mk.us_hint(t).alias("us_hint"))


@register("c18_contact_links", f"""WITH {PAGES}, {_ANCHORS}, sc AS (SELECT page_id, pos, url, lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)) AS path, lower(label) AS label FROM (SELECT page_id, page_url, pos, replace(replace(url, '/to', '/contact'), '/the', '/about') AS url, host, label FROM ln) x WHERE host = {sql_host('page_url')}),
  pt AS (SELECT *, CASE WHEN contains(path, '/contact') THEN 50 WHEN contains(path, '/about') THEN 30 WHEN regexp_matches(path, '/pages/(contact|about|our-story|stockists|wholesale)') THEN 40 WHEN regexp_matches(path, '/(info|support|help|faq|imprint|impressum|legal|team)') THEN 20 WHEN regexp_matches(path, '/(stockists|wholesale|trade|press)') THEN 18 ELSE 0 END
   + CASE WHEN regexp_matches(label, '\\bcontact\\b|get in touch|say hello|reach us|email us') THEN 25 WHEN regexp_matches(label, '\\babout\\b|our story|the studio') THEN 12 ELSE 0 END AS score FROM sc),
  b AS (SELECT page_id, path, arg_max(url, (score, -pos)) AS url, max(score) AS score, arg_max(pos, (score, -pos)) AS pos FROM pt WHERE score > 0 GROUP BY 1, 2)
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS INT) AS rank, url, score FROM b QUALIFY rank <= 3""")
def c18(spark, sf):
    links = sg.page_links(pages(spark, sf)).withColumn("url", F.replace(F.replace("url", F.lit("/to"), F.lit("/contact")), F.lit("/the"), F.lit("/about")))
    return sg.contact_links(links)


_KW = [("making", 0, "the"), ("making", 0, "of the"), ("food", 1, "der"), ("food", 1, "und"), ("care", 2, "la"), ("care", 2, "les"), ("care", 2, "de la")]


@register("c19_guess_niche", f"""WITH kw(niche, place, keyword) AS (VALUES {', '.join(map(str, _KW))}), h AS (SELECT doc_id, niche, place, sum(CASE WHEN contains(keyword, ' ') THEN 2 ELSE 1 END) AS hits FROM documents JOIN kw ON contains(lower(text), keyword) GROUP BY ALL),
  b AS (SELECT doc_id, max(hits) AS hits, arg_max(niche, (hits, -place)) AS niche FROM h GROUP BY 1) SELECT doc_id AS id, CASE WHEN hits >= 2 THEN b.niche ELSE 'other' END AS niche FROM documents LEFT JOIN b USING (doc_id)""")
def c19(spark, sf):
    kw = spark.createDataFrame(_KW, "niche string, place int, keyword string")
    return sg.guess_niche(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), kw, "other")


# every word of the benchmark is a keyword, looked for in the pages' titles and descriptions
_MANY = """kw AS (SELECT DISTINCT w AS keyword, length(w) % 5 AS place, 'niche ' || length(w) % 5 AS niche FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM benchmark) WHERE w <> '')"""


@register("c19_many_keywords", f"""WITH {PAGES}, {_MANY}, t AS (SELECT page_id AS id, lower({TITLE} || ' ' || url) AS t FROM sg), h AS (SELECT id, niche, place, count(*) AS hits FROM t JOIN kw ON contains(t, keyword) GROUP BY ALL),
  b AS (SELECT id, max(hits) AS hits, arg_max(niche, (hits, -place)) AS niche FROM h GROUP BY 1) SELECT id, CASE WHEN hits >= 2 THEN b.niche ELSE 'other' END AS niche FROM t LEFT JOIN b USING (id)""")
def c19_many(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("keyword")).where("keyword <> ''").distinct()
    place = F.length("keyword") % 5
    titles = pages(spark, sf).select(F.col("page_id").alias("id"), F.concat_ws(" ", mk.title(mk.stripped(F.col("html"))), "url").alias("text"))
    return sg.guess_niche(titles, words.select("keyword", place.alias("place"), F.concat(F.lit("niche "), place).alias("niche")), "other", many=True)


@register("c20_js_shell_pages", f"WITH {PAGES.replace('FROM pages)', SHELL)} SELECT page_id FROM sg WHERE len(regexp_extract_all(text, '\\S+')) < 60 AND len(regexp_extract_all(html, '(?i)<script')) >= 2 AND regexp_matches(html, '(?i)id\\s*=\\s*[\"''](root|app|__next|__nuxt|___gatsby)[\"'']')")
def c20(spark, sf):
    # every third page keeps only its head, before the root element of an application
    head = F.concat(F.lit('<div id="root"></div><script>a()</script>'), F.split_part("html", F.lit("<nav>"), F.lit(1)))
    p = pages(spark, sf).withColumn("html", F.when(F.col("page_id") % 3 == 0, head).otherwise(F.col("html")))
    return sg.js_shell_pages(sg.extract_signals(p)).select("page_id")


_HASH = "substr(sha256(trim(regexp_replace(regexp_replace({0}, '(?s)<!--.*?-->', '', 'g'), '\\s+', ' ', 'g'))), 1, 32)"


@register("c21_content_hash", f"SELECT page_id, {_HASH.format('html')} AS content_hash FROM pages")
def c21(spark, sf):
    return pages(spark, sf).select("page_id", sg.content_hash("html").alias("content_hash"))


@register("a15_snapshot_append", f"WITH {PAGES} SELECT page_id, url, TIMESTAMP '2024-01-31 00:00:00' AS fetched_at, 200 AS status, {_HASH.format('html')} AS content_hash, CAST(octet_length(encode(html)) AS BIGINT) AS bytes, substr(text, 1, 3000) AS text_sample, 'static' AS render_mode, {TITLE} AS title FROM sg UNION ALL SELECT page_id, url, TIMESTAMP '2024-01-30 00:00:00', 304, 'old', 0, '', 'static', NULL FROM pages WHERE page_id % 2 = 0")
def a15(spark, sf):
    p, at = pages(spark, sf), lambda d: F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz")
    old = p.where("page_id % 2 = 0").select("page_id", "url", at(30).alias("fetched_at"), F.lit(304).alias("status"), F.lit("old").alias("content_hash"), F.lit(0).cast("long").alias("bytes"), F.lit("").alias("text_sample"), F.lit("static").alias("render_mode"), F.lit(None).cast("string").alias("signals"))
    return sg.append_snapshots(old, sg.extract_signals(p), at(31)).withColumn("signals", F.get_json_object("signals", "$.title")).withColumnRenamed("signals", "title")


@register("f08_touch_unchanged", f"WITH p AS (SELECT page_id, {_HASH.format('html')} AS h FROM pages) SELECT page_id AS key, CASE WHEN page_id % 5 <> 0 AND page_id % 4 <> 0 THEN 20 ELSE 10 END AS last_evaluated FROM p")
def f08_touch(spark, sf):
    p = pages(spark, sf).select(F.col("page_id").alias("key"), sg.content_hash("html").alias("content_hash"))
    s = p.where("key % 5 <> 0").select("key", F.when(F.col("key") % 4 == 0, "other").otherwise(F.col("content_hash")).alias("content_hash"), F.lit(1).alias("fetched_at"))
    return sg.touch_unchanged(p.select("key", F.lit(10).alias("last_evaluated")), p, s, 20)


@register("f08_changed_pages", f"WITH p AS (SELECT page_id, url, {_HASH.format('html')} AS h FROM pages), s AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'other' ELSE h END AS old FROM p WHERE page_id % 5 <> 0) SELECT page_id AS key, h AS content_hash FROM p LEFT JOIN s USING (page_id) WHERE h IS DISTINCT FROM old")
def f08(spark, sf):
    p = pages(spark, sf).select(F.col("page_id").alias("key"), sg.content_hash("html").alias("content_hash"))
    s = p.where("key % 5 <> 0").select("key", F.when(F.col("key") % 4 == 0, "other").otherwise(F.col("content_hash")).alias("content_hash"), F.lit(1).alias("fetched_at"))
    return sg.changed_pages(p, s)


# hosts of each kind, and every other page's own URL
_HOSTS = ["http://10.0.0.7/x", "http://localhost/", "printer.lan", "http://nas.home/a", "http://x.internal./", "http://metadata.google.com/v1", "http://instance-data.ec2/", "http://[fe80::1.2]/", "http://[::1]:80/", "http://172.32.0.1/", "http://11.0.0.1:8080/", "intranet", "https://user@www.brand.co.uk/p"]
_URLS = f"CASE WHEN page_id % 2 = 0 THEN ([{quoted(_HOSTS)}])[CAST(page_id // 2 % {len(_HOSTS)} + 1 AS INT)] ELSE url END"
_PUBLIC = "regexp_replace(regexp_extract(regexp_replace(lower(trim(u)), '^[a-z][a-z0-9+.-]*://', ''), '^(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]?|[^/?#:]*)', 1), '\\.$', '')"


@register("f12_public_host_filter", f"SELECT page_id, u FROM (SELECT page_id, {_URLS} AS u FROM pages) WHERE contains({_PUBLIC}, '.') AND NOT regexp_matches({_PUBLIC}, '{'|'.join(PRIVATE_HOSTS)}')")
def f12(spark, sf):
    k = F.col("page_id")
    u = F.when(k % 2 == 0, F.element_at(F.array(*map(F.lit, _HOSTS)), (F.floor(k / 2) % len(_HOSTS) + 1).cast("int"))).otherwise(F.col("url"))
    return sg.public_pages(pages(spark, sf).select("page_id", u.alias("u")), "u")
