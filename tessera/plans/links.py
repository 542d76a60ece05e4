"""Queries of record linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import identity as ident
from tessera.functions import markup as mk
from tessera.functions.rules import MARKETPLACES
from tessera.operators import linkage as ln
from tessera.operators.graph import kept

from .pages import PAGES, quoted, sql_domain, sql_host, sql_name, sql_slugs
from .registry import register
from .standins import ENTITIES, OUTREACH, entities, outreach, table


def candidates(spark, sf):
    """Pages as candidates with a site; customers as candidates with a name alone."""
    none = F.lit(None).cast("string")
    k = F.col("page_id")
    p = table(spark, sf, "pages").select(k.alias("cand_id"), (k % 2).alias("profile_id"), F.col("url").alias("website"), F.when(k % 10 == 3, F.concat(F.lit("@shop"), k % 40)).alias("instagram"), none.alias("tiktok"), none.alias("etsy"), F.when(k % 10 == 5, F.concat(F.lit("me"), k % 60, F.lit("@mail.com"))).alias("contact_email"), none.alias("display_name"))
    c = table(spark, sf, "customer").select((F.col("c_custkey") + 1000000).alias("cand_id"), (F.col("c_custkey") % 2).alias("profile_id"), none, none, none, none, none, F.concat("c_mktsegment", F.lit(" Store "), (F.col("c_custkey") % 300).cast("string")))
    return p.union(c)


def all_candidates(spark, sf):
    """candidates() and suppliers, with a name alone too; ids below 0, which no page or customer has."""
    none = F.lit(None).cast("string")
    s = table(spark, sf, "supplier").select((-1 - F.col("s_suppkey")).alias("cand_id"), (F.col("s_suppkey") % 2).alias("profile_id"), none, none, none, none, none, "s_name")
    return candidates(spark, sf).union(s)


_CAND = """ca AS (SELECT page_id AS cand_id, page_id % 2 AS profile_id, url AS website, CASE WHEN page_id % 10 = 3 THEN 'shop' || (page_id % 40) END AS instagram, CASE WHEN page_id % 10 = 5 THEN 'me' || (page_id % 60) || '@mail.com' END AS email, NULL AS display_name FROM pages
  UNION ALL SELECT c_custkey + 1000000, c_custkey % 2, NULL, NULL, NULL, c_mktsegment || ' Store ' || (c_custkey % 300) FROM customer)"""
_KEYS = f"""cd AS (SELECT *, {sql_domain('website')} AS dom, {sql_name('display_name')} AS nm FROM ca), sk AS (SELECT cand_id, CASE WHEN dom NOT IN ({quoted(MARKETPLACES)}) THEN dom END AS domain, instagram, email, nm, dom FROM cd),
  ks AS (SELECT cand_id, 'strong' AS tier, 'domain' AS kind, 'domain:' || domain AS key FROM sk WHERE domain IS NOT NULL UNION ALL SELECT cand_id, 'strong', 'instagram', 'instagram:' || instagram FROM sk WHERE instagram IS NOT NULL
   UNION ALL SELECT cand_id, 'strong', 'email', 'email:' || email FROM sk WHERE email IS NOT NULL
   UNION SELECT cand_id, 'weak', 'slug', 'slug:' || unnest(list_distinct(list_concat(CASE WHEN dom IS NOT NULL THEN {sql_slugs("split_part(dom, '.', 1)")} ELSE [] END, CASE WHEN instagram IS NOT NULL THEN {sql_slugs('instagram')} ELSE [] END))) FROM sk
   UNION ALL SELECT cand_id, 'weak', 'name', 'name:' || nm FROM sk WHERE domain IS NULL AND instagram IS NULL AND email IS NULL AND nm IS NOT NULL)"""


@register("b07_identity_keys", f"WITH {_CAND}, {_KEYS} SELECT * FROM ks")
def b07(spark, sf):
    return ln.identity_keys(candidates(spark, sf))


@register("b08_key_lookup", f"WITH {_CAND}, {_KEYS}, kn AS (SELECT key, min(cand_id) AS entity_id FROM ks WHERE cand_id % 2 = 0 GROUP BY key) SELECT cand_id, tier, key, entity_id FROM ks JOIN kn USING (key) WHERE cand_id % 2 = 1")
def b08(spark, sf):
    keys = ln.identity_keys(candidates(spark, sf))
    known = keys.where("cand_id % 2 = 0").groupBy("key").agg(F.min("cand_id").alias("entity_id"))
    return ln.key_lookup(keys.where("cand_id % 2 = 1"), known)


def identified(found):
    dom = ident.domain(F.col("website"))
    return found.withColumns({"domain": dom, "instagram": ident.handle(F.col("instagram"), "instagram.com")})


@register("b09_weak_match_filter", f"""WITH {_CAND}, {_KEYS}, kn AS (SELECT key, min(cand_id) AS entity_id FROM ks WHERE cand_id % 2 = 0 GROUP BY key), m AS (SELECT cand_id, tier, key, entity_id FROM ks JOIN kn USING (key) WHERE cand_id % 2 = 1)
  SELECT m.* FROM m JOIN cd c ON c.cand_id = m.cand_id JOIN cd e ON e.cand_id = m.entity_id WHERE tier = 'strong' OR NOT (coalesce(c.dom <> e.dom, false) OR coalesce(c.instagram <> e.instagram, false))""")
def b09(spark, sf):
    c = identified(candidates(spark, sf))
    return ln.weak_match_filter(b08(spark, sf), c, c.withColumnRenamed("cand_id", "entity_id"))


@register("b10_key_groups", f"WITH d AS (SELECT page_id, {sql_domain('url')} AS dom FROM pages) SELECT page_id AS cand_id, min(page_id) OVER (PARTITION BY dom) AS component FROM d")
def b10(spark, sf):
    keys = table(spark, sf, "pages").select(F.col("page_id").alias("cand_id"), ident.domain(F.col("url")).alias("key"))
    return ln.key_groups(keys)


_STRONG = f"""{_CAND}, {_KEYS}, sp AS (SELECT cand_id, profile_id, key FROM ks JOIN ca USING (cand_id) WHERE tier = 'strong'), lo AS (SELECT profile_id, key, min(cand_id) AS low FROM sp GROUP BY ALL),
  eg AS (SELECT DISTINCT cand_id AS a, low AS b FROM sp JOIN lo USING (profile_id, key)), bo AS (SELECT a, b FROM eg UNION SELECT b, a FROM eg),
  re AS (SELECT cand_id, cand_id AS low FROM ca UNION SELECT bo.b, re.low FROM re JOIN bo ON bo.a = re.cand_id WHERE re.low < bo.b)"""


@register("b10_strong_groups", f"WITH RECURSIVE {_STRONG} SELECT cand_id, min(low) AS component FROM re GROUP BY 1")
def b10_strong(spark, sf):
    """The first step alone: groups by strong keys within a profile."""
    c = spread(candidates(spark, sf))
    groups = ln.profile_groups(c, kept(ln.identity_keys(c.drop("domain")), "keys"))
    return groups.select("cand_id", F.col("group").alias("component"))


def spread(found):
    """Candidates in as many tasks as there are cores: their keys take long to make, however small their files are."""
    return kept(identified(found).repartition("cand_id"), "candidates")


@register("b10_resolve_entities")
def b10_resolve(spark, sf):
    c = spread(all_candidates(spark, sf))
    return ln.resolve_entities(c, ln.identity_keys(c.drop("domain")))


@register("b11_merge_records", f"""WITH {ENTITIES}, m AS (SELECT *, entity_id % 300 AS component, CASE WHEN entity_id % 4 = 0 THEN '' ELSE display_name END AS nm FROM ents) SELECT component, arg_min(nm, entity_id) FILTER (nm <> '') AS nm, arg_min(email, entity_id) FILTER (email IS NOT NULL) AS email,
  min(contacted_on) AS contacted_on, max(evaluated_on) AS evaluated_on FROM m GROUP BY 1""")
def b11(spark, sf):
    k = F.col("entity_id")
    m = entities(spark, sf).withColumns({"component": k % 300, "nm": F.when(k % 4 == 0, "").otherwise(F.col("display_name"))})
    return ln.merge_records(m, ["nm", "email"], ["contacted_on"], ["evaluated_on"], [k])


_CH = f"{OUTREACH}, ch AS (SELECT outreach_id, entity_id, CASE status WHEN 'SKIPPED' THEN 'DRAFT' ELSE status END AS status, date_trunc('month', day)::DATE AS day FROM outr)"


@register("b12_repoint_children", f"""WITH {_CH}, mv AS (SELECT outreach_id, entity_id AS old, CASE WHEN entity_id % 3 = 1 THEN entity_id - 1 ELSE entity_id END AS entity_id, status, day FROM ch)
  SELECT outreach_id, entity_id, status, day FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, day, status ORDER BY old <> entity_id, outreach_id) AS n FROM mv) WHERE status <> 'DRAFT' OR n = 1""")
def b12(spark, sf):
    ch = outreach(spark, sf).select("outreach_id", "entity_id", F.when(F.col("status") == "SKIPPED", "DRAFT").otherwise(F.col("status")).alias("status"), F.trunc("day", "month").alias("day"))
    mapping = entities(spark, sf).where("entity_id % 3 = 1").select("entity_id", (F.col("entity_id") - 1).alias("winner"))
    return ln.repoint_children(ch, mapping, "outreach_id").select("outreach_id", "entity_id", "status", "day")


@register("b13_enrich_existing", f"WITH {ENTITIES} SELECT entity_id, coalesce(email, CASE WHEN entity_id % 2 = 0 THEN 'new@x.com' END) AS email, coalesce(has_website, CASE WHEN entity_id % 2 = 0 THEN true END) AS has_website FROM ents")
def b13(spark, sf):
    e = entities(spark, sf)
    c = e.where("entity_id % 2 = 0").select("entity_id", F.lit("new@x.com").alias("email"), F.lit(True).alias("has_website"))
    return ln.enrich_existing(e, c, ["email"]).select("entity_id", "email", "has_website")


@register("b14_ownership_filter", f"""WITH {ENTITIES}, mt AS (SELECT s_suppkey AS cand_id, s_nationkey % 2 AS profile_id, entity_id, e.profile_id AS owner, evaluated_on AS first_seen FROM supplier JOIN ents e ON e.entity_id // 15 = s_suppkey),
  o AS (SELECT cand_id, profile_id, arg_min((entity_id, owner), (coalesce(first_seen, DATE '0001-01-01'), entity_id)) AS m FROM mt GROUP BY ALL) SELECT cand_id, m[1] AS entity_id, m[2] <> profile_id AS "foreign", CASE WHEN m[2] <> profile_id THEN 'owned-by-another-profile' END AS reason FROM o""")
def b14(spark, sf):
    e = entities(spark, sf).withColumn("first_seen", F.coalesce("evaluated_on", F.lit("0001-01-01").cast("date")))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cand_id"), (F.col("s_nationkey") % 2).alias("profile_id"), (F.col("s_suppkey").cast("long")).alias("g"))
    m = s.join(e.select("entity_id", F.floor(F.col("entity_id") / 15).alias("g")), "g").drop("g")
    return ln.ownership(m, e)


@register("b15_preferred_name", f"""WITH {PAGES}, r AS (SELECT page_id, trim(regexp_extract(clean, '(?is)<title[^>]*>(.{{0,300}}?)</title>', 1)) AS site_name, CASE WHEN page_id % 2 = 0 THEN split_part(split_part({sql_host('url')}, '.', 1), '-', 1) ELSE 'Stored' END AS stored, regexp_replace({sql_host('url')}, '[^a-z0-9]', '', 'g') || right(regexp_replace(lower(regexp_extract(clean, '(?is)<title[^>]*>(.{{0,300}}?)</title>', 1)), '[^a-z0-9]', '', 'g'), CAST(page_id % 40 AS INT)) AS label FROM sg),
  f AS (SELECT *, regexp_replace(lower(site_name), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(stored), '[^a-z0-9]', '', 'g') AS b, list_filter(string_split(regexp_replace(lower(site_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 5) AS aw, list_filter(string_split(regexp_replace(lower(stored), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 5) AS bw FROM r),
  o AS (SELECT *, a <> '' AND (contains(label, a) OR contains(a, label) OR len(list_filter(aw, lambda w: contains(label, w))) > 0) AS oa, b <> '' AND (contains(label, b) OR contains(b, label) OR len(list_filter(bw, lambda w: contains(label, w))) > 0) AS ob FROM f)
  SELECT page_id, CASE WHEN oa AND NOT coalesce(ob, false) THEN site_name ELSE stored END AS name FROM o""")
def b15(spark, sf):
    h, t = ident.host(F.col("url")), mk.title(mk.stripped(F.col("html")))
    flat = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    stored = F.when(F.col("page_id") % 2 == 0, F.split_part(F.split_part(h, F.lit("."), F.lit(1)), F.lit("-"), F.lit(1))).otherwise("Stored")
    label = F.concat(F.regexp_replace(h, "[^a-z0-9]", ""), F.right(flat(t), (F.col("page_id") % 40).cast("int")))
    return ln.preferred_name(table(spark, sf, "pages").select("page_id", t.alias("site_name"), stored.alias("stored"), label.alias("domain"))).select("page_id", "name")
