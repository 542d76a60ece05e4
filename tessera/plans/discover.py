"""Queries of discovery."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tessera.functions.rules import FINAL_STATES, MARKETPLACES
from tessera.operators import discovery as ds
from tessera.operators import signals as sg

from .pages import PAGES, quoted, sql_domain
from .pages import _ANCHORS as ANCHORS
from .registry import register
from .standins import ENTITIES, entities, table

AS_OF = date(2001, 8, 1)


def elements(spark, sf):
    """Suppliers and customers as map elements."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("n"))
    c = table(spark, sf, "customer").select((F.col("c_custkey") + 100000).alias("id"), F.concat("c_mktsegment", F.lit(" "), F.col("c_custkey") % 50).alias("name"), F.col("c_nationkey").alias("n"))
    k = F.col("id")
    pairs = [("name", F.when(k % 11 == 0, F.concat("name", F.lit(" outlet"))).otherwise(F.translate("name", "#", " "))), ("brand", F.when(k % 7 == 0, F.lit("Big"))), ("operator", F.when(k % 13 == 0, F.lit("Op"))), ("website", F.when(k % 3 == 0, F.concat(F.lit("http://www.site"), k % 400, F.lit(".com/a")))), ("phone", F.when(k % 5 != 0, F.lit("1"))), ("addr:city", F.when(k % 2 == 0, F.lit("Salem"))), ("addr:state", F.when(k % 4 == 0, F.lit("OR"))), ("addr:street", F.concat(F.lit("S"), F.col("n"))), ("note", F.lit("x"))]
    tags = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(a).alias("k"), b.alias("v")) for a, b in pairs]), lambda p: p["v"].isNotNull()))
    return s.unionByName(c).select("id", tags.alias("tags"))


_EL = "el AS (SELECT id, CASE WHEN id % 11 = 0 THEN name || ' outlet' ELSE replace(name, '#', ' ') END AS name, id % 7 = 0 AS brand, id % 13 = 0 AS op, CASE WHEN id % 3 = 0 THEN 'site' || (id % 400) || '.com' END AS domain, id % 5 <> 0 AS phone, CASE WHEN id % 4 = 0 THEN 'Salem, OR' ELSE 'salem-or' END AS location_text, 'S' || n AS street FROM (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS n FROM supplier UNION ALL SELECT c_custkey + 100000, c_mktsegment || ' ' || (c_custkey % 50), c_nationkey FROM customer))"
_CHAIN = "(brand OR op OR regexp_matches(lower(name), '\\b(inc|llc|corp|corporation|franchise|outlet|superstore|warehouse)\\b') OR regexp_matches(lower(name), '#\\s?\\d+|\\bno\\.\\s?\\d+\\b'))"


@register("a01_place_candidates", f"""WITH {_EL}, k AS (SELECT *, coalesce(domain, lower(name) || '|' || lower(street)) AS key FROM el WHERE NOT {_CHAIN} AND (domain IS NOT NULL OR phone)), f AS (SELECT min(id) AS id FROM k GROUP BY key)
  SELECT id, domain, name AS display_name, CASE WHEN id % 3 = 0 THEN 'makers' WHEN id % 3 = 1 THEN 'food' ELSE 'other' END AS niche, location_text, 'osm:salem-or' AS discovery_source FROM k JOIN f USING (id)""")
def a01(spark, sf):
    e = elements(spark, sf)
    k = F.col("id")
    niches = e.select("id", F.when(k % 3 == 0, "makers").when(k % 3 == 1, "food").otherwise("other").alias("niche"))
    return ds.place_candidates(e, niches, "salem-or")


@register("a02_drop_chains", f"WITH {_EL} SELECT id FROM el WHERE NOT {_CHAIN}")
def a02(spark, sf):
    return ds.drop_chains(elements(spark, sf)).select("id")


@register("a03_place_niche", "SELECT p_partkey AS id, CASE p_type WHEN 'SMALL' THEN 'makers' WHEN 'LARGE' THEN 'makers' WHEN 'PROMO' THEN 'food' ELSE 'other' END AS niche FROM part")
def a03(spark, sf):
    e = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit("shop").alias("field"), F.col("p_type").alias("value"))
    claims = spark.createDataFrame([("shop", "SMALL", "makers", 0), ("shop", "LARGE", "makers", 0), ("shop", "LARGE", "food", 1), ("shop", "PROMO", "food", 1)], "field string, value string, niche string, place int")
    return ds.place_niche(e, claims, "other")


@register("a04_search_spec", "SELECT p_brand AS profile_id, CASE WHEN length(p_type) % 2 = 0 THEN 'shop' ELSE 'craft' END AS field, list_sort(list_distinct(flatten(list([p_type, 'all'])))) AS \"values\" FROM part GROUP BY 1, 2")
def a04(spark, sf):
    n = table(spark, sf, "part").select("p_brand", "p_type").distinct()
    field = F.when(F.length("p_type") % 2 == 0, "shop").otherwise("craft")
    fields = F.create_map(field, F.array(F.col("p_type"), F.lit("all")))
    p = n.groupBy(F.col("p_brand").alias("profile_id")).agg(F.map_from_entries(F.collect_list(F.struct("p_type", fields.alias("f")))).alias("niches"))
    return ds.search_spec(p)


@register("a05_keep_tags", f"WITH {_EL} SELECT id, CASE WHEN brand THEN 'Big' END AS brand, CASE WHEN phone THEN '1' END AS phone, CASE WHEN id % 2 = 0 THEN 'Salem' END AS city, street, repeat('o', 200) AS hours, '97301' AS postcode, CASE WHEN id % 3 = 1 THEN 'ig' || id END AS instagram, CAST(3 + brand::INT + phone::INT + (id % 2 = 0)::INT + (id % 4 = 0)::INT + (id % 3 = 1)::INT AS INT) AS n FROM el")
def a05(spark, sf):
    k = F.col("id")
    more = F.create_map(F.lit("opening_hours"), F.lit("o" * 250), F.lit("addr:postcode"), F.lit("97301"), F.lit("amenity"), F.lit("cafe"))
    e = elements(spark, sf).withColumn("tags", F.map_concat("tags", more, F.when(k % 3 == 1, F.create_map(F.lit("contact:instagram"), F.concat(F.lit("ig"), k))).otherwise(F.create_map().cast("map<string,string>"))))
    t = e.select("id", ds.keep_tags(F.col("tags")).alias("t"))
    got = {"brand": "brand", "phone": "phone", "city": "addr:city", "street": "addr:street", "hours": "opening_hours", "postcode": "addr:postcode", "instagram": "contact:instagram"}
    return t.select("id", *[F.element_at("t", v).alias(n) for n, v in got.items()], F.size("t").alias("n"))


def sql_plausible(d: str) -> str:
    return f"(split_part({d}, '.', -1) IN ({quoted(ds.TLDS)}) AND length(split_part({d}, '.', 1)) BETWEEN 5 AND 40 AND NOT regexp_matches(split_part({d}, '.', 1), '^\\d') AND NOT regexp_matches(split_part({d}, '.', 1), '\\d{{3,}}') AND NOT regexp_matches({d}, '(?i){'|'.join(ds.OTHER_TRADES + ds.OTHER_COUNTRIES)}'))"


# certificates: each page's host without its middle label, and its sub-domain form
_APEX = "split_part(split_part(regexp_replace(url, '^https?://', ''), '/', 1), '.', -3) || '.com'"


@register("a06_apex_domains", f"WITH n AS (SELECT DISTINCT {_APEX} AS domain FROM pages), kw(keyword) AS (VALUES ('thther'), ('therin'), ('spam-farm'), ('cheap-pills')) SELECT DISTINCT keyword, domain FROM n JOIN kw ON contains(domain, substr(keyword, 1, 6)) WHERE {sql_plausible('domain')}")
def a06(spark, sf):
    certs = table(spark, sf, "pages").select(F.expr(f"concat_ws('\n', {_APEX}, concat('www.', {_APEX}), concat('*.', {_APEX}))").alias("name_value"))
    return ds.apex_domains(certs, spark.createDataFrame([("thther",), ("therin",), ("spam-farm",), ("cheap-pills",)], "keyword string"))


@register("a07_plausible_domain", f"SELECT DISTINCT d FROM (SELECT {_APEX} AS d FROM pages) WHERE {sql_plausible('d')}")
def a07(spark, sf):
    return table(spark, sf, "pages").select(F.expr(_APEX).alias("d")).distinct().where(ds.plausible_domain(F.col("d")))


_LINE = "CASE page_id % 7 WHEN 0 THEN '# note' WHEN 1 THEN 'https://instagram.com/Shop' || page_id WHEN 2 THEN '@Maker' || page_id WHEN 3 THEN 'no site here' WHEN 4 THEN 'https://www.etsy.com/shop/S' || page_id ELSE url END"


@register("a08_seed_lines", f"""WITH l AS (SELECT page_id, {_LINE} AS s FROM pages) SELECT page_id, CASE page_id % 7 WHEN 1 THEN 'instagram' WHEN 2 THEN 'handle' WHEN 3 THEN 'rejected' WHEN 4 THEN 'etsy' ELSE 'site' END AS kind,
  CASE page_id % 7 WHEN 1 THEN 'shop' || page_id WHEN 2 THEN 'maker' || page_id WHEN 3 THEN s WHEN 4 THEN 's' || page_id ELSE {sql_domain('s')} END AS value FROM l WHERE page_id % 7 <> 0""")
def a08(spark, sf):
    return ds.seed_lines(table(spark, sf, "pages").select("page_id", F.expr(_LINE).alias("line"))).select("page_id", "kind", "value")


@register("a09_title_keywords", "SELECT DISTINCT keyword FROM (SELECT regexp_replace(lower(trim(regexp_replace(t, '\\s*\\([^)]*\\)\\s*$', ''))), '[^a-z0-9]', '', 'g') AS keyword, t FROM (SELECT p_name || CASE WHEN p_partkey % 2 = 0 THEN ' (art)' ELSE '' END AS t FROM part)) WHERE NOT regexp_matches(t, '(?i)history of|list of|gadget') AND lower(t) NOT IN ('red widget') AND length(keyword) BETWEEN 3 AND 22 AND keyword NOT IN ('bluebolt', 'smallring')")
def a09(spark, sf):
    t = table(spark, sf, "part").select(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " (art)").otherwise("")).alias("title"))
    return ds.title_keywords(t, "history of|list of|gadget", ["red widget"], ["bluebolt", "smallring"])


_OUT = "CASE pos % 4 WHEN 0 THEN 'https://' || split_part(page_url, '/', 3) || url_tail WHEN 1 THEN 'https://shop' || (page_id % 50) || '.com/' WHEN 2 THEN 'https://other' || (page_id % 20) || '.net/a/b' ELSE 'https://www.instagram.com/x' END"


@register("d01_peer_links", f"""WITH {PAGES}, {ANCHORS}, o AS (SELECT page_id, page_url, pos, {_OUT} AS url, CASE WHEN pos % 8 = 2 THEN 'our friends' ELSE label END AS label FROM (SELECT *, '/x' AS url_tail FROM ln)),
  d AS (SELECT *, {sql_domain('url')} AS domain, lower(label) AS lb, regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS path FROM o),
  s AS (SELECT *, 10 + CASE WHEN regexp_matches(lb, '{'|'.join(ds.PEER_HINTS)}') THEN 30 ELSE 0 END + CASE WHEN path = '' THEN 25 WHEN len(list_filter(string_split(path, '/'), lambda x: x <> '')) <= 1 THEN 10 ELSE -10 END
   + CASE WHEN lb <> '' AND length(lb) <= 40 AND NOT regexp_matches(lb, '\\b(home|shop|about|contact|privacy|terms|faq|cart|login|search|blog)\\b') THEN 8 ELSE 0 END AS priority FROM d WHERE domain <> {sql_domain('page_url')} AND domain NOT IN ({quoted(ds.SKIP_HOSTS + MARKETPLACES)})),
  b AS (SELECT page_id, domain, max(priority) AS priority, arg_max(lb, (priority, -pos)) AS lb FROM s WHERE priority >= 20 GROUP BY 1, 2)
  SELECT page_id, domain, 'https://' || domain AS url, CAST(priority AS INT) AS priority, 1 AS depth, CASE WHEN lb <> '' THEN 'link:"' || substr(lb, 1, 60) || '"' ELSE 'link' END AS reason FROM b""")
def d01(spark, sf):
    links = sg.page_links(table(spark, sf, "pages")).withColumn("url_tail", F.lit("/x"))
    links = links.withColumns({"url": F.expr(_OUT.replace("split_part(page_url, '/', 3)", "split_part(page_url, '/', 3)")), "label": F.when(F.col("pos") % 8 == 2, "our friends").otherwise(F.col("label"))})
    return ds.peer_links(links)


def frontier(spark, sf):
    """Orders as a frontier."""
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "F", "DONE").otherwise("ERROR")
    return o.select((F.col("o_custkey") % 2).alias("profile_id"), F.concat(F.lit("https://o"), F.col("o_orderkey")).alias("url"), F.concat(F.lit("d"), F.col("o_custkey") % 97, F.lit(".com")).alias("domain"), F.floor(F.col("o_totalprice") / 10000).alias("priority"), F.to_date("o_orderdate").alias("added_on"), status.alias("status"))


FRONT = "fr AS (SELECT o_custkey % 2 AS profile_id, 'https://o' || o_orderkey AS url, 'd' || (o_custkey % 97) || '.com' AS domain, CAST(floor(o_totalprice / 10000) AS BIGINT) AS priority, CAST(o_orderdate AS DATE) AS added_on, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'F' THEN 'DONE' ELSE 'ERROR' END AS status FROM orders)"


@register("d02_frontier_add", f"""WITH {ENTITIES}, {FRONT}, c AS (SELECT profile_id, 'd' || (CAST(replace(replace(domain, 'd', ''), '.com', '') AS INT) * 3 % 150) || '.com' AS domain, max(priority) AS priority FROM fr GROUP BY 1, 2) SELECT c.*, 'PENDING' AS status FROM c
  WHERE domain NOT IN (SELECT domain FROM ents WHERE evaluated_on IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM fr WHERE fr.profile_id = c.profile_id AND fr.domain = c.domain AND fr.added_on < DATE '1995-01-15')""")
def d02(spark, sf):
    f = frontier(spark, sf)
    n = F.regexp_extract("domain", r"\d+", 0).cast("int") * 3 % 150
    return ds.frontier_add(f.withColumn("domain", F.concat(F.lit("d"), n, F.lit(".com"))), entities(spark, sf), f.where("added_on < DATE'1995-01-15'"))


@register("d03_frontier_batch", f"WITH {FRONT} SELECT profile_id, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY priority DESC, added_on, url) AS INT) AS turn, url FROM fr WHERE status = 'PENDING' QUALIFY turn <= 90")
def d03(spark, sf):
    return ds.frontier_batch(frontier(spark, sf), 90)


@register("d04_frontier_mark", f"WITH {FRONT} SELECT url, CASE WHEN priority > 40 THEN 'DONE' ELSE status END AS status, CASE WHEN priority > 40 THEN added_on + 1 END AS processed_on FROM fr")
def d04(spark, sf):
    f = frontier(spark, sf)
    return ds.frontier_mark(f, f.where("priority > 40").select("url", F.lit("DONE").alias("status"), F.date_add("added_on", 1).alias("at"))).select("url", "status", "processed_on")


_FINAL = quoted(FINAL_STATES)


@register("d05_stale_entities", f"WITH {ENTITIES} SELECT entity_id, evaluated_on FROM ents WHERE (evaluated_on IS NULL OR evaluated_on < DATE '2001-08-01' - 30 OR (score BETWEEN 56 AND 67 AND evaluated_on < DATE '2001-08-01' - 10)) AND state NOT IN ({_FINAL}) ORDER BY evaluated_on ASC NULLS FIRST, entity_id LIMIT 100")
def d05(spark, sf):
    return ds.stale_entities(entities(spark, sf), AS_OF)


@register("d06_no_site_batch", f"WITH {ENTITIES} SELECT entity_id FROM ents WHERE has_website = false AND state NOT IN ({_FINAL}) AND (evaluated_on IS NULL OR evaluated_on < DATE '2001-08-01' - 30) ORDER BY evaluated_on ASC NULLS FIRST, entity_id LIMIT 40")
def d06(spark, sf):
    return ds.no_site_batch(entities(spark, sf), AS_OF)


@register("d07_batch_split", "(SELECT o_orderkey AS id, 'fresh' AS kind FROM orders ORDER BY id LIMIT 63) UNION ALL (SELECT c_custkey, 'stale' FROM customer ORDER BY 1 LIMIT 27)")
def d07(spark, sf):
    return ds.batch_split(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("turn")), table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("turn")), 90)


@register("d08_cross_metro_chains", "SELECT l_partkey AS domain, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 20")
def d08(spark, sf):
    return ds.cross_metro_chains(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("domain"), F.col("l_suppkey").alias("source")), 20)


@register("d08_reject_chains", f"WITH {ENTITIES}, st AS (SELECT l_suppkey % 2 AS profile_id, 'd' || (l_partkey % 97) || '.com' AS domain, l_suppkey % 50 AS source FROM lineitem), ch AS (SELECT profile_id, domain FROM st GROUP BY 1, 2 HAVING count(DISTINCT source) >= 20) SELECT entity_id, CASE WHEN hit THEN 'REJECTED' ELSE state END AS state, CASE WHEN hit THEN 'chain:multi-metro' END AS reject_reason FROM (SELECT e.*, ch.domain IS NOT NULL AND state NOT IN ('CONTACTED', 'REPLIED', 'CONVERSATION', 'CLIENT') AS hit FROM ents e LEFT JOIN ch USING (profile_id, domain))")
def d08_reject(spark, sf):
    st = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 2).alias("profile_id"), F.concat(F.lit("d"), F.col("l_partkey") % 97, F.lit(".com")).alias("domain"), (F.col("l_suppkey") % 50).alias("source"))
    return ds.reject_chains(entities(spark, sf).withColumn("reject_reason", F.lit(None).cast("string")), st, 20).select("entity_id", "state", "reject_reason")


@register("d09_metro_order", "SELECT s_nationkey, s_name, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS INT) AS turn FROM supplier")
def d09(spark, sf):
    return ds.round_robin(table(spark, sf, "supplier"), "s_nationkey", "s_name")


@register("d10_metros_for", """WITH rg AS (SELECT s_name AS slug, CASE WHEN s_suppkey % 5 = 0 THEN 'block' ELSE 'city' END AS kind, s_suppkey % 4 <> 3 AS active, s_suppkey % 3 <> 1 AS acknowledged, s_suppkey AS priority FROM supplier WHERE s_suppkey % 2 = 0),
  a AS (SELECT slug, -priority AS turn, 0 AS tier FROM rg WHERE kind = 'city' AND active AND acknowledged), b AS (SELECT s_name AS slug, s_suppkey AS turn, 1 AS tier FROM supplier WHERE s_name NOT IN (SELECT slug FROM a)) SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE slug NOT IN (SELECT slug FROM rg WHERE kind = 'block' AND active)""")
def d10(spark, sf):
    n, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    r = n.where(k % 2 == 0).select(F.col("s_name").alias("slug"), F.when(k % 5 == 0, "block").otherwise("city").alias("kind"), (k % 4 != 3).alias("active"), (k % 3 != 1).alias("acknowledged"), k.alias("priority"))
    return ds.metros_for(n.select(F.col("s_name").alias("slug"), k.alias("turn")), r)


@register("d11_metros_due", "WITH c AS (SELECT user_id AS n_nationkey, max(ts) AS last_run FROM events GROUP BY 1) SELECT n_nationkey, last_run FROM nation LEFT JOIN c USING (n_nationkey) WHERE last_run IS NULL OR last_run < TIMESTAMP '2024-01-30 20:00:00' ORDER BY last_run ASC NULLS FIRST, n_nationkey LIMIT 12")
def d11(spark, sf):
    cursor = table(spark, sf, "events").groupBy(F.col("user_id").cast("int").alias("n_nationkey")).agg(F.max("ts").alias("last_run"))
    return ds.due_first(table(spark, sf, "nation").select("n_nationkey", F.col("n_nationkey").alias("place")), cursor, "n_nationkey", F.lit("2024-01-30 20:00:00").cast("timestamp_ntz"), 12)


_BOX = "greatest(cos(radians(c_acctbal / 120)), 0.45)"


@register("d12_box_around", f"WITH b AS (SELECT c_custkey, c_acctbal / 120 AS lat, c_custkey % 180 AS lon, least(2.2, 1.0 / {_BOX}) * 0.075 AS wide FROM customer) SELECT c_custkey, floor((lat - CAST(0.075 AS DOUBLE)) * 10000 + 0.5) / 10000 AS south, floor((lon - wide) * 10000 + 0.5) / 10000 AS west, floor((lat + CAST(0.075 AS DOUBLE)) * 10000 + 0.5) / 10000 AS north, floor((lon + wide) * 10000 + 0.5) / 10000 AS east FROM b")
def d12(spark, sf):
    b = ds.box_around(F.col("c_acctbal") / 120, (F.col("c_custkey") % 180).cast("double"), 0.075)
    return table(spark, sf, "customer").select("c_custkey", b.alias("b")).select("c_custkey", "b.*")


@register("d13_places_in_boxes", "SELECT event_id AS id, n_name AS slug FROM events JOIN nation ON value BETWEEN n_nationkey * 7.5 AND n_nationkey * 7.5 + 12 AND user_id BETWEEN n_nationkey * 5 AND n_nationkey * 5 + 30")
def d13(spark, sf):
    p = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))
    k = F.col("n_nationkey")
    b = table(spark, sf, "nation").select(F.col("n_name").alias("slug"), (k * 7.5).alias("x0"), (k * 7.5 + 12).alias("x1"), (k * 5).cast("double").alias("y0"), (k * 5 + 30).cast("double").alias("y1"))
    return ds.places_in_boxes(p, b, 10.0)


@register("d14_keywords_due", "WITH t AS (SELECT p_name AS term, min(p_partkey) AS place FROM part GROUP BY 1), c AS (SELECT p_name AS term, max(ts) AS last_run FROM events JOIN part ON p_partkey = user_id WHERE user_id % 3 <> 0 GROUP BY 1) SELECT term, last_run FROM t LEFT JOIN c USING (term) ORDER BY last_run ASC NULLS FIRST, place LIMIT 40")
def d14(spark, sf):
    p = table(spark, sf, "part")
    terms = p.groupBy(F.col("p_name").alias("term")).agg(F.min("p_partkey").alias("place"))
    used = table(spark, sf, "events").where("user_id % 3 <> 0").join(p, F.col("p_partkey") == F.col("user_id")).groupBy(F.col("p_name").alias("term")).agg(F.max("ts").alias("last_run"))
    return ds.due_first(terms, used, "term", F.lit("2100-01-01").cast("timestamp_ntz"), 40)


@register("d15_slugify_places", "SELECT doc_id, substr(regexp_replace(regexp_replace(translate(lower(text), 'àáâäãåçèéêëìíîïñòóôöõùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 60) AS slug FROM documents")
def d15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ds.slug(F.col("text")).alias("slug"))


@register("d16_low_water", f"WITH {FRONT} SELECT profile_id, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'PENDING') >= 2500 AS healthy FROM fr GROUP BY 1")
def d16(spark, sf):
    return ds.low_water(frontier(spark, sf), 2500)


@register("d17_add_places", "SELECT regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || CASE WHEN s_suppkey % 3 <> 0 THEN '-ca' ELSE '' END AS slug, s_suppkey % 4 = 0 AND s_suppkey % 3 = 0 AS existing, s_suppkey % 3 = 0 AS acknowledged, CAST(greatest(-10, least(10, s_suppkey - 12)) AS BIGINT) AS priority FROM supplier")
def d17(spark, sf):
    n, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    p = n.select(F.col("s_name").alias("name"), F.when(k % 3 == 0, "us").otherwise("ca").alias("country"), (k % 80).cast("double").alias("lat"), (k % 180).cast("double").alias("lon"), (k - 12).alias("priority"))
    r = n.where(k % 4 == 0).select(ds.slug(F.col("s_name")).alias("slug"))
    return ds.add_places(p, r).drop("box")
