"""Queries of filters and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.rules import ADVANCED_STATES, CORPORATE_MARKERS, MARKETPLACES, PLATFORMS, US_STATES, US_WORDS, VAGUE_PRAISE, WEIGHTS
from tessera.operators import contact as ct
from tessera.operators import scoring as sc

from .pages import _ANCHORS as ANCHORS
from .pages import _FLAGS as FLAGS
from .pages import CART, CARTS, LINKS, SHOP_PAGES, TITLE, VIEWPORT, quoted, shop_pages, sql_domain, sql_meta
from .registry import register
from .standins import ENTITIES, entities, table

EXTRA = ["", " Annual report", " domain for sale", " coming soon", " £ 40", " in Toronto, Ontario, Canada", " SW1A 1AA", " Sevilla, España", " QUÉBEC", " SEVILLA, ESPAÑA"]
_DOCS = f"""d AS (SELECT doc_id, substr(text, 1, 3000) || ([{quoted(EXTRA)}])[CAST(doc_id % 10 + 1 AS INT)] AS text_sample, len(regexp_extract_all(text, '\\S+')) AS word_count, doc_id % 5 AS img_count, doc_id % 3 = 0 AS us_hint, CASE WHEN doc_id % 31 = 0 THEN 'etsy.com' END AS domain FROM documents)"""


def doc_signals(spark, sf):
    k = F.col("doc_id")
    extra = F.element_at(F.array(*map(F.lit, EXTRA)), (k % 10 + 1).cast("int"))
    return table(spark, sf, "documents").select(k, F.lit("").alias("title"), F.concat(F.substring("text", 1, 3000), extra).alias("text_sample"), F.regexp_count("text", F.lit(r"\S+")).alias("word_count"), (k % 5).alias("img_count"), (k % 3 == 0).alias("us_hint"), F.when(k % 31 == 0, "etsy.com").alias("domain"))


_HAY = "lower(' ' || text_sample)"
# (?i) is Unicode's in DuckDB
_FOREIGN = " ".join(f"WHEN regexp_matches(text_sample, '{p.replace('(?iu)', '(?i)')}') THEN 'non-us:{k}'" for k, p in sc.FOREIGN)


@register("f01_hard_filter", f"""WITH {_DOCS} SELECT doc_id, CASE {' '.join(f"WHEN contains({_HAY}, '{m}') THEN 'corporate:{m}'" for m in CORPORATE_MARKERS)} WHEN domain IN ({quoted(MARKETPLACES)}) THEN 'marketplace-only'
  WHEN word_count < 40 AND img_count < 3 THEN 'empty-page' WHEN regexp_matches({_HAY}, '{sc.PARKED}') THEN 'parked-domain' WHEN regexp_matches({_HAY}, '{sc.PLACEHOLDER}') AND word_count < 150 THEN 'placeholder-site' WHEN NOT us_hint THEN CASE {_FOREIGN} END END AS reject_reason FROM d""")
def f01(spark, sf):
    return sc.hard_filter(doc_signals(spark, sf)).select("doc_id", "reject_reason")


# page signals that follow from a customer's key
_SIG = {
    "platform": ("CASE k % 7 WHEN 0 THEN 'shopify' WHEN 1 THEN 'wix' WHEN 2 THEN 'carrd' WHEN 3 THEN 'wordpress' END"),
    "product_links": "k * 3 % 25", "add_to_cart_hits": "k % 11", "collection_links": "k % 6", "price_median": "CASE WHEN k % 4 <> 0 THEN k % 130 END", "price_max": "CASE WHEN k % 4 <> 0 THEN k * 5 % 400 END",
    "img_count": "k * 7 % 22", "img_srcset": "k % 9", "img_lazy": "k % 8", "img_with_dims": "k % 3", "word_count": "k * 13 % 500", "copyright_year": "CASE WHEN k % 5 <> 0 THEN 2015 + k % 12 END",
    "has_press": "k % 3 = 0", "has_wholesale": "k % 4 = 1", "has_team": "k % 5 = 2", "has_blog": "k % 2 = 0", "has_email_capture": "k % 3 = 1", "has_events": "k % 6 = 4", "has_booking": "k % 7 = 5", "has_cart": "k % 2 = 1",
    "is_ecommerce": "k % 3 <> 2", "has_viewport": "k % 4 <> 3", "manual_order_hint": "k % 9 = 8", "us_hint": "k % 2 = 0", "title": "CASE WHEN k % 10 = 0 THEN '' ELSE 'Title' END", "meta_description": "CASE WHEN k % 3 = 0 THEN '' ELSE 'About' END",
    "text_sample": "CASE WHEN k % 4 = 2 THEN 'a studio for workshops' ELSE 'plain text' END", "domain": "CASE WHEN k % 13 = 0 THEN 'etsy.com' WHEN k % 13 > 1 THEN 'd.com' END", "instagram": "CASE WHEN k % 3 = 0 THEN 'ig' END",
    "apps": "k % 4", "mails": "k % 3",
}
_SIGNALS = "s AS (SELECT k, " + ", ".join(f"{v} AS {n}" for n, v in _SIG.items()) + " FROM (SELECT c_custkey AS k FROM customer))"


def key_signals(spark, sf):
    s = table(spark, sf, "customer").selectExpr("c_custkey AS k").selectExpr("k", *[f"{v} AS {n}" for n, v in _SIG.items()])
    emails = F.when(F.col("mails") == 0, F.array(F.lit("ann@d.com"))).when(F.col("mails") == 1, F.array(F.lit("info@d.com"))).otherwise(F.array().cast("array<string>"))
    return s.withColumns({"paid_apps": F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), F.col("apps").cast("int")), "emails": emails})


def _sum(rules) -> str:
    return "least(100, " + " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for n, c in rules) + ")"


_MONEY = _sum([(8, "domain <> 'etsy.com'"), (14, "platform = 'shopify'"), (14, "product_links >= 8 OR add_to_cart_hits >= 8"), (16, "price_median >= 60"), (16, "price_max >= 250"), (10, "img_srcset >= 6 OR (img_count >= 15 AND img_lazy >= 5)"), (12, "has_press"), (12, "has_wholesale"), (10, "has_team"), (6, "has_blog"), (6, "has_email_capture"), (8, "apps > 0"), (8, "collection_links >= 4"), (6, "has_events")])
_WEB = _sum([(30, "NOT has_viewport"), (18, "2026 - copyright_year >= 3"), (28, "platform = 'carrd'"), (12, "platform = 'wix'"), (16, "img_count >= 12 AND img_lazy = 0 AND img_srcset = 0"), (8, "img_count >= 6 AND img_with_dims = 0"), (10, "word_count < 180 AND img_count > 6"), (6, "meta_description = ''")])
_SYS = _sum([(35, "manual_order_hint"), (25, "NOT has_booking AND contains(text_sample, 'studio')"), (20, "has_wholesale AND NOT has_cart"), (12, "is_ecommerce AND NOT has_email_capture"), (10, "has_events"), (10, "product_links >= 20 AND apps = 0")])
_PERS = _sum([(30, "word_count >= 250"), (15, "has_blog"), (10, "title <> ''"), (10, "meta_description <> ''"), (15, "collection_links >= 2"), (10, "has_press"), (10, "instagram IS NOT NULL")])
_FIT = _sum([(40, "true"), (20, "us_hint"), (10, "is_ecommerce"), (5, "has_team"), (10, "word_count >= 300")])
_PRE = "CAST(floor(" + " + ".join(f"coalesce({k}, 50) * CAST({w / 100} AS DOUBLE)" for k, w in WEIGHTS.items()) + " + CAST(0.5 AS DOUBLE)) AS BIGINT)"


@register("f02_rule_score", f"""WITH {_SIGNALS}, d AS (SELECT k, CAST({_FIT} AS INT) AS fit, CAST({_MONEY} AS INT) AS money, CAST(greatest({_WEB}, {_SYS}) AS INT) AS need, 50 AS creative, CASE mails WHEN 0 THEN 95 WHEN 1 THEN 70 ELSE CASE WHEN instagram IS NOT NULL THEN 35 ELSE 10 END END AS contactability,
  CAST({_PERS} AS INT) AS personalization, 50 AS conversion FROM s) SELECT *, {_PRE} AS prescore FROM d""")
def f02(spark, sf):
    return sc.rule_score(key_signals(spark, sf), 2026).select("k", *WEIGHTS, "prescore")


# the same sums over the signals of whole pages
_CHOICE = {"domain <> 'etsy.com'": f"domain NOT IN ({quoted(MARKETPLACES)})", "platform = 'shopify'": "platform IN ('shopify', 'bigcommerce', 'squarespace')", "platform = 'carrd'": "platform IN ('carrd', 'linktree')", "platform = 'wix'": "platform IN ('wix', 'bigcartel')", "contains(text_sample, 'studio')": "regexp_matches(text_sample, '(?i)studio|session|consult|workshop|class|appointment|commission')"}


def of_pages(total: str) -> str:
    for key_rule, page_rule in _CHOICE.items():
        total = total.replace(key_rule, page_rule)
    return total


_TAGS = "regexp_extract_all(clean, '(?i)<img\\b[^>]*>')"
_PRICES = "list_sort(list_filter(list_transform(regexp_extract_all(text, '\\$\\s?(\\d{1,3}(?:,\\d{3})*(?:\\.\\d{2})?)', 1), lambda x: CAST(replace(x, ',', '') AS DOUBLE)), lambda v: v > 0 AND v < 100000)[:301])"
_MADE = " ".join(f"WHEN regexp_matches(html, '(?i){p}') THEN '{n}'" for n, p in PLATFORMS)
_APPS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(html, '(?i){p}') THEN '{n}' END" for n, p in ct.PAID_APPS) + "], lambda x: x IS NOT NULL)"
_EMAILS = f"list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.]{{2,}}'), lambda e: lower(regexp_replace(e, '[.]+$', ''))), lambda e: regexp_matches(e, '(?i)\\.({'|'.join(ct.COUNTRY_TLDS + ct.OTHER_TLDS)})$') AND NOT regexp_matches(e, '{ct.JUNK_EMAIL}'))"
_WHOLE = f"""s AS (SELECT page_id, {sql_domain('url')} AS domain, CASE {_MADE} END AS platform, coalesce(product_links, 0) AS product_links, coalesce(collection_links, 0) AS collection_links, instagram, {CARTS} AS add_to_cart_hits, {CART} AS has_cart,
  {CART} OR {CARTS} > 0 OR coalesce(product_links, 0) > 0 AS is_ecommerce, {_PRICES} AS pr, pr[len(pr) // 2 + 1] AS price_median, list_max(pr) AS price_max, len({_TAGS}) AS img_count, len(list_filter({_TAGS}, lambda t: regexp_matches(t, '(?i)srcset\\s*='))) AS img_srcset,
  len(list_filter({_TAGS}, lambda t: regexp_matches(t, '(?i)loading\\s*=\\s*["'']lazy["'']'))) AS img_lazy, len(list_filter({_TAGS}, lambda t: regexp_matches(t, '(?i)width\\s*=') AND regexp_matches(t, '(?i)height\\s*='))) AS img_with_dims,
  len(regexp_extract_all(text, '\\S+')) AS word_count, list_max(list_filter(list_transform(regexp_extract_all(text, '(?i)(?:©|copyright)\\s*(?:\\d{{4}}\\s*[-–]\\s*)?(\\d{{4}})', 1), lambda y: CAST(y AS INT)), lambda y: y BETWEEN 2000 AND 2100)) AS copyright_year,
  {FLAGS}, {VIEWPORT} AS has_viewport, regexp_matches(text, '\\b({US_STATES})\\b[\\s,]*\\d{{5}}') OR regexp_matches(text, '(?i)\\b({US_WORDS})\\b') AS us_hint, {TITLE} AS title, substr({sql_meta('description')}, 1, 400) AS meta_description, substr(text, 1, 3000) AS text_sample,
  len({_APPS}) AS apps, {_EMAILS} AS em, CASE WHEN len(list_filter(em, lambda e: NOT regexp_matches(e, '{sc.GENERAL_INBOX}'))) > 0 THEN 0 WHEN len(em) > 0 THEN 1 ELSE 2 END AS mails FROM sg LEFT JOIN lk USING (page_id))"""


@register("f02_page_scores", f"""WITH {SHOP_PAGES}, {ANCHORS}, {LINKS}, {_WHOLE}, d AS (SELECT page_id, CAST({_FIT} AS INT) AS fit, CAST({of_pages(_MONEY)} AS INT) AS money, CAST(greatest({of_pages(_WEB)}, {of_pages(_SYS)}) AS INT) AS need, 50 AS creative, CASE mails WHEN 0 THEN 95 WHEN 1 THEN 70 ELSE CASE WHEN instagram IS NOT NULL THEN 35 ELSE 10 END END AS contactability,
  CAST({_PERS} AS INT) AS personalization, 50 AS conversion FROM s) SELECT *, {_PRE} AS prescore FROM d""")
def f02_pages(spark, sf):
    """Pages scored from end to end."""
    return sc.rule_score(ct.full_signals(shop_pages(spark, sf)), 2026).select("page_id", *WEIGHTS, "prescore")


_DIM = {k: f"c_custkey * {m} % 101" for k, m in zip(WEIGHTS, (7, 11, 13, 17, 19, 23, 29), strict=True)}
_DIMS = "dm AS (SELECT c_custkey AS entity_id, " + ", ".join(f"{v} AS {k}" for k, v in _DIM.items()) + " FROM customer)"


def dims(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey AS entity_id", *[f"{v} AS {k}" for k, v in _DIM.items()])


@register("f03_weighted_score", f"WITH {_DIMS} SELECT entity_id, {_PRE} AS score FROM dm")
def f03(spark, sf):
    return dims(spark, sf).select("entity_id", sc.weighted({k: F.col(k) for k in WEIGHTS}).alias("score"))


@register("f04_score_no_website", f"""WITH t AS (SELECT c_custkey AS k, c_custkey % 2 = 0 AS street, c_custkey % 3 = 0 AS hours, c_custkey % 5 = 0 AS ph, c_custkey % 7 = 0 AS craft, c_custkey % 3 = 1 AS ig, c_custkey % 4 = 0 AS mail, c_mktsegment = 'BUILDING' AS art FROM customer),
  d AS (SELECT k, CAST(least(100, 45 + CASE WHEN street THEN 20 ELSE 0 END + CASE WHEN craft THEN 15 ELSE 0 END + CASE WHEN ig THEN 10 ELSE 0 END) AS INT) AS fit,
  CAST(CASE WHEN street THEN 18 ELSE 0 END + CASE WHEN hours THEN 14 ELSE 0 END + CASE WHEN ph THEN 10 ELSE 0 END + CASE WHEN ig THEN 12 ELSE 0 END AS INT) AS money, CAST(82 + CASE WHEN ig THEN 8 ELSE 0 END AS INT) AS need, 50 AS creative,
  CASE WHEN mail THEN 80 WHEN ig AND ph THEN 45 WHEN ig THEN 35 WHEN ph THEN 25 ELSE 0 END AS contactability, CAST(15 + CASE WHEN ig THEN 20 ELSE 0 END + CASE WHEN craft THEN 15 ELSE 0 END AS INT) AS personalization, 50 AS conversion FROM t) SELECT *, {_PRE} AS prescore FROM d""")
def f04(spark, sf):
    k = F.col("c_custkey")
    tags = F.map_filter(F.create_map(F.lit("addr:street"), F.when(k % 2 == 0, "Main"), F.lit("addr:state"), F.when(k % 2 == 0, "OR"), F.lit("opening_hours"), F.when(k % 3 == 0, "24/7"), F.lit("phone"), F.when(k % 5 == 0, "1"), F.lit("craft"), F.when(k % 7 == 0, "potter")), lambda _, v: v.isNotNull())
    p = table(spark, sf, "customer").select(k.alias("k"), tags.alias("tags"), F.when(k % 3 == 1, "ig").alias("instagram"), F.lit(None).cast("string").alias("phone"), F.when(k % 4 == 0, "a@b.c").alias("email"), F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("niche"))
    return sc.score_no_website(p).select("k", *WEIGHTS, "prescore")


_EVAL = "ev AS (SELECT c_custkey AS entity_id, c_custkey * 31 % 101 AS fit_score, c_custkey * 37 % 101 AS creative_score, c_custkey * 41 % 101 AS need_score, c_custkey * 43 % 101 AS conversion_score, c_custkey % 6 <> 0 AS worth_contacting, CASE WHEN c_custkey % 12 = 0 THEN 'chain' END AS veto_reason FROM customer WHERE c_custkey % 4 <> 1)"


def evaluations(spark, sf):
    return table(spark, sf, "customer").where("c_custkey % 4 <> 1").selectExpr("c_custkey AS entity_id", "c_custkey * 31 % 101 AS fit_score", "c_custkey * 37 % 101 AS creative_score", "c_custkey * 41 % 101 AS need_score", "c_custkey * 43 % 101 AS conversion_score", "c_custkey % 6 <> 0 AS worth_contacting", "CASE WHEN c_custkey % 12 = 0 THEN 'chain' END AS veto_reason")


_FOLD = "fo AS (SELECT entity_id, coalesce(fit_score, fit) AS fit, coalesce(creative_score, creative) AS creative, money, greatest(need, coalesce(need_score, need)) AS need, contactability, personalization, coalesce(conversion_score, conversion) AS conversion, coalesce(NOT worth_contacting, false) AS vetoed, veto_reason FROM dm LEFT JOIN ev USING (entity_id))"
_BEST = "(SELECT string_agg(k || ' ' || n, ', ' ORDER BY n DESC, i) FROM (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {k}, {i})" for i, k in enumerate(WEIGHTS)) + ") x(k, n, i) ORDER BY n DESC, i LIMIT 3))"


@register("f05_final_score", f"WITH {_DIMS}, {_EVAL}, {_FOLD} SELECT entity_id, CASE WHEN vetoed THEN least({_PRE}, 35) ELSE {_PRE} END AS score, CASE WHEN vetoed THEN coalesce(veto_reason, 'vetoed') ELSE {_BEST} END AS reason, vetoed FROM fo")
def f05(spark, sf):
    return sc.final_score(dims(spark, sf), evaluations(spark, sf))


@register("f06_clean_evaluation", """WITH e AS (SELECT doc_id, lang AS niche, doc_id % 140 - 20 AS fit_score, 'the layout' || CASE WHEN doc_id % 3 = 0 THEN ' is slow' ELSE '' END AS claim, doc_id % 2 = 0 AS measured, lower(substr(text, 1, 60)) AS evidence, lower(CASE WHEN doc_id % 5 = 0 THEN 'unrelated' ELSE text END) AS text FROM documents),
  w AS (SELECT *, regexp_extract_all(evidence, '[a-z0-9]{5,}') AS ws FROM e), o AS (SELECT *, len(ws) < 3 OR len(list_filter(ws, lambda x: contains(text, x))) >= 0.4 * len(ws) AS ok FROM w)
  SELECT doc_id, CASE WHEN niche IN ('en', 'fr') THEN niche END AS niche, least(100, greatest(0, fit_score)) AS fit_score, CASE WHEN (NOT contains(claim, 'slow') OR measured) AND ok THEN claim END AS claim, NOT ok AS rejected FROM o""")
def f06(spark, sf):
    k = F.col("doc_id")
    e = table(spark, sf, "documents").select(k, F.col("lang").alias("niche"), (k % 140 - 20).alias("fit_score"), F.concat(F.lit("the layout"), F.when(k % 3 == 0, " is slow").otherwise("")).alias("claim"), (k % 2 == 0).alias("measured"), F.substring("text", 1, 60).alias("evidence"), F.when(k % 5 == 0, "unrelated").otherwise(F.col("text")).alias("text"))
    return sc.clean_evaluation(e, ["en", "fr"]).select("doc_id", "niche", "fit_score", "claim", "rejected")


@register("f07_evaluation_cache", "SELECT page_id AS entity_id, md5(html) AS content_hash, page_id % 3 = 0 AS hit FROM pages")
def f07(spark, sf):
    s = table(spark, sf, "pages").select(F.col("page_id").alias("entity_id"), F.md5("html").alias("content_hash"))
    return sc.evaluation_cache(s, s.where("entity_id % 3 = 0").union(s.where("entity_id % 3 = 1").select("entity_id", F.lit("old"))))


@register("f09_assign_state", f"WITH {ENTITIES} SELECT entity_id, CASE WHEN state IN ({quoted(ADVANCED_STATES)}) THEN state WHEN entity_id % 9 = 0 THEN 'REJECTED' WHEN score >= 68 THEN 'QUALIFIED' WHEN score >= 53 THEN 'NURTURE' ELSE 'NOT_NOW' END AS state FROM ents")
def f09(spark, sf):
    return sc.assign_state(entities(spark, sf).withColumn("vetoed", F.col("entity_id") % 9 == 0))


@register("f10_apply_scores", f"""WITH {ENTITIES} SELECT entity_id, CASE WHEN entity_id % 2 = 0 THEN entity_id % 100 ELSE score END AS score, CASE WHEN niche = 'BUILDING' THEN CASE WHEN entity_id % 2 = 0 THEN CASE WHEN entity_id % 3 = 0 THEN 'judged' ELSE 'guess' END END ELSE niche END AS niche,
  coalesce(email, CASE WHEN entity_id % 2 = 0 THEN 'found@x.com' END) AS email, CASE WHEN email IS NOT NULL THEN CASE WHEN entity_id % 4 = 1 THEN 'list' END WHEN entity_id % 2 = 0 THEN 'page' END AS contact_source, CASE WHEN entity_id % 2 = 0 THEN CASE WHEN entity_id % 4 = 0 THEN 'told' ELSE 'a | b' END END AS opportunity FROM ents""")
def f10(spark, sf):
    k = F.col("entity_id")
    e = entities(spark, sf).withColumns({"niche": F.when(F.col("niche") == "BUILDING", "").otherwise(F.col("niche")), "contact_source": F.when(F.col("email").isNotNull() & (k % 4 == 1), "list")})
    s = e.where(k % 2 == 0).select("entity_id", (k % 100).alias("new_score"), F.when(k % 3 != 0, "guess").alias("page_niche"), F.lit("judged").alias("evaluation_niche"), F.lit("found@x.com").alias("found_email"), F.lit("page").alias("found_source"), F.when(k % 4 == 0, "told").alias("opportunity"), F.array(F.lit("a"), F.lit("b")).alias("findings"))
    return sc.apply_scores(e, s)


@register("f11_evaluation_candidates", f"WITH {ENTITIES} SELECT profile_id, entity_id, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, entity_id) AS INT) AS turn FROM ents WHERE score >= 50 AND entity_id % 4 <> 0 QUALIFY turn <= 40 + 20 * profile_id")
def f11(spark, sf):
    e = entities(spark, sf).withColumns({"prescore": F.col("score"), "content_hash": F.md5(F.col("entity_id").cast("string"))})
    left = e.select("profile_id").distinct().withColumn("remaining", 40 + 20 * F.col("profile_id"))
    return sc.evaluation_candidates(e, e.where("entity_id % 4 = 0"), left, 50)


@register("f13_robots_filter", """WITH u AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) AS path FROM pages) SELECT url FROM u
  WHERE NOT (CASE WHEN starts_with(host, 'www.') THEN starts_with(path, '/en/') AND NOT regexp_matches(path, '^/en/1') ELSE starts_with(path, '/fr') OR regexp_matches(path, '^/.*page=') END)""")
def f13(spark, sf):
    u = table(spark, sf, "pages").select("url", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/?#]+([^#]*)", 1).alias("path"))
    www = F.col("host").startswith("www.")
    rule = F.when(www, F.array(*[F.struct(F.lit(a).alias("agent"), F.lit(b).alias("allow"), F.lit(c).alias("pattern")) for a, b, c in (("*", False, "/"), ("tessera", False, "/en/"), ("tessera", True, "/en/1"))]))
    rule = F.explode(rule.otherwise(F.array(*[F.struct(F.lit("*").alias("agent"), F.lit(b).alias("allow"), F.lit(c).alias("pattern")) for b, c in ((False, "/fr"), (False, "/*page="), (False, ""))])))
    rules = u.select("host").distinct().select("host", rule.alias("r")).select("host", "r.*")
    return sc.robots_filter(u, rules, "tessera")


# every other first sentence is replaced by stock praise
_PRAISE = ["strong brand identity", "brand personality and handmade products", "the ash-glazed vase collection", "mugs and 12 bowls in blue", "clay and Kiln glazes"]
_STOCK = f"CASE WHEN doc_id % 2 = 0 THEN ([{quoted(_PRAISE)}])[CAST(doc_id // 2 % 5 + 1 AS INT)] ELSE trim(split_part(text, '.', 1)) END"


@register("f14_specific_compliment", f"""SELECT doc_id, praise FROM (SELECT doc_id, {_STOCK} AS praise, regexp_replace({_STOCK}, '^\\s+|\\s+$', '', 'g') AS p FROM documents) WHERE length(p) BETWEEN 12 AND 200
  AND NOT regexp_matches(p, '(?i){VAGUE_PRAISE}') AND NOT (regexp_matches(p, '^[\\w\\s]+ and [\\w\\s]+$') AND NOT regexp_matches(p[2:], '[A-Z0-9"'']'))""")
def f14(spark, sf):
    k = F.col("doc_id")
    stock = F.element_at(F.array(*map(F.lit, _PRAISE)), (F.floor(k / 2) % 5 + 1).cast("int"))
    return sc.specific_compliment(table(spark, sf, "documents").select("doc_id", F.when(k % 2 == 0, stock).otherwise(F.trim(F.split_part("text", F.lit("."), F.lit(1)))).alias("praise")))
