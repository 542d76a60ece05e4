"""Queries of vocabulary, categories, lessons, corrections and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import learning as lr
from tessera.operators import merge

from .pages import quoted
from .registry import register
from .standins import ENTITIES, FEEDBACK, entities, feedback, table


@register("k01_mine_corpus", f"""WITH t AS (SELECT text, quality = 1 AS good FROM documents JOIN labels USING (doc_id)), n AS (SELECT count(*) FILTER (good) AS ng, greatest(1, count(*) FILTER (NOT good)) AS nb FROM t),
  w AS (SELECT good, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,18}}'))) AS keyword FROM t), c AS (SELECT keyword, count(*) FILTER (good) AS g, count(*) FILTER (NOT good) AS b FROM w WHERE keyword NOT IN ({quoted(lr.STOPWORDS)}) GROUP BY 1),
  s AS (SELECT keyword, g, b, CAST(g AS DOUBLE) / ng AS rate, (CAST(g AS DOUBLE) / ng) / (CAST(b AS DOUBLE) / nb + CAST(0.01 AS DOUBLE)) AS lift FROM c, n WHERE g >= 3 AND ng >= 5) SELECT * FROM s WHERE rate >= 0.05 AND lift >= 2.5 ORDER BY lift DESC, keyword LIMIT 40""")
def k01(spark, sf):
    t = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("text", (F.col("quality") == 1).alias("good"))
    return lr.mine_corpus(t)


_KW = "kw AS (SELECT p_name AS keyword, CASE min(p_partkey) % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'UNVALIDATED' ELSE 'DEAD' END AS status, count(*) AS runs, min(p_partkey) % 4 AS leads_found, min(p_size) AS domains_kept, CASE WHEN min(p_partkey) % 5 <> 0 THEN DATE '2024-01-01' + CAST(min(p_partkey) % 28 AS INT) END AS last_run FROM part GROUP BY 1)"


def keywords(spark, sf):
    k = F.min("p_partkey")
    status = F.when(k % 3 == 0, "ACTIVE").when(k % 3 == 1, "UNVALIDATED").otherwise("DEAD")
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("keyword")).agg(status.alias("status"), F.count(F.lit(1)).alias("runs"), (k % 4).alias("leads_found"), F.min("p_size").alias("domains_kept"), F.when(k % 5 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 28).cast("int"))).alias("last_run"))


@register("k02_store_keywords", f"WITH {_KW} SELECT keyword, status FROM kw UNION ALL SELECT DISTINCT 'new ' || p_type, 'UNVALIDATED' FROM part")
def k02(spark, sf):
    p = table(spark, sf, "part")
    new = p.select(F.concat(F.lit("new "), "p_type").alias("keyword")).union(p.select("p_name")).withColumn("status", F.lit("UNVALIDATED"))
    return merge.upsert_ignore(keywords(spark, sf).select("keyword", "status"), new, ["keyword"])


@register("k03_validate_keywords", f"WITH {_KW} SELECT keyword, CASE WHEN leads_found = 3 THEN status WHEN domains_kept % 3 = 0 THEN 'DEAD' ELSE 'ACTIVE' END AS status, CASE WHEN leads_found <> 3 THEN runs END AS certs_seen, CASE WHEN leads_found <> 3 THEN domains_kept % 3 END AS domains_kept FROM kw")
def k03(spark, sf):
    k = keywords(spark, sf)
    return lr.validate_keywords(k.select("keyword", "status"), k.where("leads_found <> 3").select("keyword", F.col("runs").alias("certs"), (F.col("domains_kept") % 3).alias("kept")))


@register("k04_demote_keywords", f"WITH {_KW} SELECT keyword, CASE WHEN status = 'ACTIVE' AND runs >= 6 AND leads_found = 0 THEN 'DEAD' ELSE status END AS status FROM kw")
def k04(spark, sf):
    return lr.demote_keywords(keywords(spark, sf)).select("keyword", "status")


@register("k05_active_keywords", f"WITH {_KW} SELECT keyword, last_run, domains_kept FROM kw WHERE status = 'ACTIVE' ORDER BY last_run ASC NULLS FIRST, domains_kept DESC, keyword LIMIT 20")
def k05(spark, sf):
    return lr.active_keywords(keywords(spark, sf), 20)


@register("k06_record_keyword_use", "SELECT l_partkey AS keyword, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS leads_found, CAST(max(l_shipdate) AS DATE) AS last_run, count(*) AS runs FROM lineitem GROUP BY 1")
def k06(spark, sf):
    u = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("keyword"), F.col("l_quantity").cast("long").alias("leads_found"), F.to_date("l_shipdate").alias("last_run"), "l_linenumber")
    old = u.where("l_linenumber = 1").drop("l_linenumber").withColumn("runs", F.lit(1).cast("long"))
    return merge.upsert_accumulate(old, u.where("l_linenumber <> 1").drop("l_linenumber"), ["keyword"], ["leads_found"], "last_run")


@register("k07_keyword_report", f"WITH {_KW} SELECT status, count(*) AS n FROM kw GROUP BY 1")
def k07(spark, sf):
    return keywords(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("k07_keyword_list", f"WITH {_KW} SELECT keyword, status, leads_found FROM kw ORDER BY status <> 'ACTIVE', leads_found DESC, domains_kept DESC, keyword LIMIT 50")
def k07_list(spark, sf):
    return lr.keyword_list(keywords(spark, sf), 50)


@register("k08_source_backoff", """WITH a AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events), r AS (SELECT user_id AS source, island, count(*) AS fails, max(ts) AS last FROM a WHERE event_type = 'error' GROUP BY 1, 2)
  SELECT source, max(fails) AS fails, max(last) + INTERVAL 90 MINUTE AS parked_until FROM r WHERE fails >= 3 GROUP BY 1""")
def k08(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("source"), F.col("ts").alias("at"), F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"))
    return lr.source_backoff(e, 3, 90)


_CATS = [(1, 0, ["der ", " und "]), (2, 1, [" the ", ""]), (3, 2, [" la ", " de "])]


@register("m01_classify_skips", "WITH p AS (SELECT doc_id, lower(text) AS t FROM documents WHERE doc_id % 3 <> 0 ORDER BY doc_id DESC LIMIT 30) SELECT doc_id AS feedback_id, CASE WHEN contains(t, 'der ') OR contains(t, ' und ') THEN 1 WHEN contains(t, ' the ') THEN 2 WHEN contains(t, ' la ') OR contains(t, ' de ') THEN 3 END AS category_id, 2 AS version FROM p")
def m01(spark, sf):
    k = F.col("doc_id")
    f = table(spark, sf, "documents").select(k.alias("feedback_id"), F.col("text").alias("reason"), F.when(k % 3 == 0, 2).when(k % 3 == 1, 1).alias("version"), k.alias("created_at"))
    return lr.classify_skips(f, spark.createDataFrame(_CATS, "category_id int, position int, keywords array<string>"), 2)


@register("m02_restamp", "SELECT event_id AS feedback_id, CASE WHEN NOT (user_id % 7 IN (5, 6)) THEN user_id % 7 END AS category_id, CASE WHEN NOT (user_id % 7 IN (5, 6)) THEN 3 END AS version FROM events")
def m02(spark, sf):
    f = table(spark, sf, "events").select(F.col("event_id").alias("feedback_id"), (F.col("user_id") % 7).alias("category_id"), F.lit(3).alias("version"))
    c = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("category_id"))
    return lr.restamp(f, c)


@register("m04_lesson_pending", f"WITH {ENTITIES}, {FEEDBACK} SELECT feedback_id, entity_id, display_name, CASE WHEN k % 4 = 0 THEN 'no' ELSE 'reason ' || k END AS reason FROM feed JOIN ents USING (entity_id) WHERE k % 4 <> 0 AND decision <> 'BOUNCED' AND feedback_id % 2 = 1 ORDER BY created_at, feedback_id LIMIT 25")
def m04(spark, sf):
    f = feedback(spark, sf).withColumns({"reason": F.when(F.col("k") % 4 == 0, "no").otherwise(F.concat(F.lit("reason "), F.col("k"))), "applied": F.col("feedback_id") % 2 == 0})
    return lr.lesson_pending(f, entities(spark, sf))


@register("m05_upsert_lessons", "WITH b AS (SELECT text AS lesson, CASE WHEN doc_id % 2 = 0 THEN 'AVOID' ELSE 'PREFER' END AS kind, CASE WHEN doc_id < 400 THEN 0 ELSE 1 END AS new FROM documents) SELECT arg_min(lesson, (new, lesson)) AS lesson, kind, CAST(sum(CASE new WHEN 0 THEN 2 ELSE 1 END) AS BIGINT) AS weight, CAST(sum(CASE new WHEN 0 THEN 5 ELSE 3 END) AS BIGINT) AS source_count FROM b GROUP BY substr(trim(regexp_replace(lower(lesson), '[^a-z0-9]+', ' ', 'g')), 1, 40), kind")
def m05(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("lesson"), F.when(F.col("doc_id") % 2 == 0, "AVOID").otherwise("PREFER").alias("kind"))
    return lr.upsert_lessons(d.where("doc_id < 400").withColumns({"weight": F.lit(2).cast("long"), "source_count": F.lit(5).cast("long")}), d.where("doc_id >= 400").withColumn("sources", F.lit(3).cast("long")))


@register("m06_active_lessons", "WITH l AS (SELECT CASE WHEN doc_id % 4 > 0 THEN source END AS niche, doc_id AS lesson_id, n_chars AS weight, doc_id % 10 AS updated FROM documents WHERE doc_id % 3 <> 1), e AS (SELECT * FROM l WHERE niche IS NOT NULL UNION ALL SELECT n.niche, lesson_id, weight, updated FROM l, (SELECT DISTINCT niche FROM l WHERE niche IS NOT NULL) n WHERE l.niche IS NULL) SELECT niche, CAST(row_number() OVER (PARTITION BY niche ORDER BY weight DESC, updated DESC, lesson_id) AS INT) AS rank, lesson_id, weight FROM e QUALIFY rank <= 12")
def m06(spark, sf):
    k = F.col("doc_id")
    return lr.active_lessons(table(spark, sf, "documents").select(k.alias("lesson_id"), F.when(k % 4 > 0, F.col("source")).alias("niche"), F.col("n_chars").alias("weight"), (k % 10).alias("updated"), (k % 3 != 1).alias("active")))


@register("m04_mark_applied", f"WITH {FEEDBACK} SELECT feedback_id, feedback_id % 2 = 0 OR k % 5 = 0 AS applied FROM feed")
def m04_mark(spark, sf):
    f = feedback(spark, sf).withColumn("applied", F.col("feedback_id") % 2 == 0)
    return lr.mark_applied(f, f.where("k % 5 = 0")).select("feedback_id", "applied")


@register("m07_rerank_clamp", f"WITH {ENTITIES}, r AS (SELECT user_id AS entity_id, CAST(floor(max(value)) AS BIGINT) - 50 AS revised FROM events GROUP BY 1) SELECT entity_id, least(100, greatest(15, revised)) AS score, 'seen' AS why FROM ents JOIN r USING (entity_id)")
def m07(spark, sf):
    r = table(spark, sf, "events").groupBy(F.col("user_id").alias("entity_id")).agg((F.floor(F.max("value")) - 50).alias("revised")).withColumn("why", F.lit("seen"))
    return lr.rerank_clamp(entities(spark, sf), r)


@register("m08_apply_corrections", """WITH p AS (SELECT doc_id AS proposal_id, ['opinion', 'name', 'niche', 'email'][CAST(doc_id % 4 + 1 AS INT)] AS field, lang, text AS note FROM documents),
  v AS (SELECT *, CASE field WHEN 'name' THEN CASE WHEN proposal_id % 8 = 1 THEN substr(note, 1, 40) ELSE 'Zebra Qqqq' END WHEN 'niche' THEN lang WHEN 'email' THEN CASE WHEN proposal_id % 3 = 0 THEN 'nobody' ELSE 'p' || (proposal_id % 50) || CASE WHEN proposal_id % 5 = 0 THEN '@y.com' ELSE '@x.com' END END ELSE '' END AS value FROM p),
  r AS (SELECT *, CASE WHEN field = 'opinion' THEN 'opinion' WHEN field = 'name' AND NOT list_has_any(regexp_extract_all(lower(value), '[a-z0-9]{4,}'), regexp_extract_all(lower(note), '[a-z0-9]{4,}')) THEN 'name-not-in-note' WHEN field = 'niche' AND value NOT IN ('en', 'fr') THEN 'unknown-niche'
   WHEN field = 'email' AND NOT regexp_matches(value, '^[^\\s@]+@[^\\s@]+\\.[a-z]{2,}$') THEN 'bad-email' WHEN field = 'email' AND value IN (SELECT 'p' || s_suppkey || '@x.com' FROM supplier) THEN 'suppressed' WHEN field = 'email' AND value LIKE '%@y.com' THEN 'undeliverable' END AS refused FROM v) SELECT proposal_id, field, refused, refused IS NULL AND field IN ('name', 'niche') AS reevaluate FROM r""")
def m08(spark, sf):
    k = F.col("doc_id")
    field = F.element_at(F.array(*map(F.lit, ["opinion", "name", "niche", "email"])), (k % 4 + 1).cast("int"))
    note = F.col("text")
    value = F.when(k % 4 == 1, F.when(k % 8 == 1, F.substring(note, 1, 40)).otherwise("Zebra Qqqq")).when(k % 4 == 2, F.col("lang")).when(k % 4 == 3, F.when(k % 3 == 0, "nobody").otherwise(F.concat(F.lit("p"), k % 50, F.when(k % 5 == 0, "@y.com").otherwise("@x.com")))).otherwise("")
    p = table(spark, sf, "documents").select(k.alias("proposal_id"), field.alias("field"), value.alias("value"), note.alias("note"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("p"), "s_suppkey", F.lit("@x.com")).alias("key"))
    return lr.apply_corrections(p, ["en", "fr"], s, spark.createDataFrame([("y.com",)], "mx_domain string"))


@register("m08_corrected", f"""WITH {ENTITIES}, a AS (SELECT event_id, user_id, event_type, CASE event_type WHEN 'click' THEN 'name' WHEN 'view' THEN 'niche' WHEN 'error' THEN 'email' END AS field FROM events), l AS (SELECT user_id AS entity_id, field, 'v' || max(event_id) AS value FROM a WHERE field IS NOT NULL AND event_id % 7 = 0 GROUP BY ALL),
  p AS (SELECT entity_id, max(value) FILTER (field = 'name') AS nm, max(value) FILTER (field = 'niche') AS ni, max(value) FILTER (field = 'email') AS em FROM l GROUP BY 1)
  SELECT entity_id, coalesce(nm, display_name) AS display_name, coalesce(ni, niche) AS niche, coalesce(em, email) AS email, CASE WHEN nm IS NULL AND ni IS NULL THEN evaluated_on END AS evaluated_on FROM ents LEFT JOIN p USING (entity_id)""")
def m08_corrected(spark, sf):
    t = F.col("event_type")
    a = table(spark, sf, "events").where("event_id % 7 = 0").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("proposal_id"), F.when(t == "click", "name").when(t == "view", "niche").when(t == "error", "email").alias("field"), F.concat(F.lit("v"), "event_id").alias("value"))
    return lr.corrected(entities(spark, sf), a.where("field is not null")).select("entity_id", "display_name", "niche", "email", "evaluated_on")


@register("m09_rename_in_history", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'THE subject' ELSE 'the subject' END AS subject, md5(CASE WHEN doc_id % 2 = 0 THEN replace(text, 'the', 'THE') ELSE text END) AS body FROM documents")
def m09(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("entity_id"), F.lit("the subject").alias("subject"), F.col("text").alias("body"))
    r = d.where("doc_id % 2 = 0").select("entity_id", F.lit("the").alias("old"), F.lit("THE").alias("new"))
    return lr.rename_in_history(d, r).select("doc_id", "subject", F.md5("body").alias("body"))


@register("m10_record_feedback", f"WITH {ENTITIES}, {FEEDBACK} SELECT feedback_id, entity_id, decision, score AS score_at_time, niche AS niche_at_time FROM feed LEFT JOIN ents USING (entity_id)")
def m10(spark, sf):
    return lr.record_feedback(feedback(spark, sf), entities(spark, sf))


@register("m27_upsert_categories", """WITH e AS (SELECT p_partkey % 2 AS profile_id, p_partkey AS ord, CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE p_brand || ' ' || p_type END AS name FROM part), s AS (SELECT *, regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM e),
  t AS (SELECT *, CASE WHEN length(name) < 2 THEN 'short-name' WHEN row_number() OVER (PARTITION BY profile_id, slug ORDER BY ord) > 1 THEN 'slug-clash' END AS refused FROM s)
  SELECT profile_id, ord AS "order", slug, refused, CASE WHEN refused IS NULL THEN 3 + CAST(sum(CASE WHEN refused IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id ORDER BY ord) AS BIGINT) END AS position, 2 AS words FROM t""")
def m27(spark, sf):
    k = F.col("p_partkey")
    e = table(spark, sf, "part").select((k % 2).alias("profile_id"), k.alias("order"), F.when(k % 9 == 0, "x").otherwise(F.concat_ws(" ", "p_brand", "p_type")).alias("name"), F.concat("p_name", F.lit(", Other ,,")).alias("keywords"))
    c = table(spark, sf, "region").select((F.col("r_regionkey") % 2).cast("long").alias("profile_id"), F.lower("r_name").alias("slug"), (F.col("r_regionkey") % 2 + 3 - F.col("r_regionkey") % 2).alias("position"))
    return lr.upsert_categories(e, c)


@register("p01_profile_footprint", f"WITH {ENTITIES} SELECT (SELECT count(*) FROM ents WHERE profile_id = 1) AS entities, (SELECT count(*) FROM orders WHERE o_custkey % 2 = 1) AS outreach, (SELECT count(*) FROM events WHERE user_id % 2 = 1) AS feedback")
def p01(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 2).alias("profile_id"))
    e = table(spark, sf, "events").select((F.col("user_id") % 2).alias("profile_id"))
    return lr.profile_footprint({"entities": entities(spark, sf), "outreach": o, "feedback": e}, 1)


@register("p02_purge_profile", f"WITH {ENTITIES} SELECT o_orderkey, o_custkey AS entity_id FROM orders WHERE o_custkey NOT IN (SELECT entity_id FROM ents WHERE profile_id = 1)")
def p02(spark, sf):
    return lr.purge_profile(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("entity_id")), entities(spark, sf), 1).select("o_orderkey", "entity_id")


@register("p02_released_keys", f"WITH {ENTITIES} SELECT 'email:' || email AS key, entity_id FROM ents WHERE email IS NOT NULL AND profile_id <> 1")
def p02_keys(spark, sf):
    e = entities(spark, sf)
    return lr.released_keys(e.where("email is not null").select(F.concat(F.lit("email:"), "email").alias("key"), "entity_id"), e, 1).select("key", "entity_id")


@register("p03_heir", "SELECT c_custkey AS profile_id, c_name AS slug FROM customer WHERE c_custkey % 2 = 1 AND c_custkey <> 1 ORDER BY c_nationkey = 2 DESC, c_custkey LIMIT 1")
def p03_heir(spark, sf):
    n = table(spark, sf, "customer").select(F.col("c_custkey").alias("profile_id"), F.col("c_name").alias("slug"), (F.col("c_custkey") % 2 == 1).alias("active"), (F.col("c_nationkey") == 2).alias("is_default"))
    return lr.heir(n, 1)


@register("p03_resolve_profile", "SELECT c_custkey AS profile_id, c_name AS slug FROM customer WHERE c_custkey % 2 = 1 ORDER BY CASE WHEN c_name = 'nobody' THEN 0 WHEN c_nationkey = 2 THEN 1 ELSE 2 END, c_custkey LIMIT 1")
def p03(spark, sf):
    n = table(spark, sf, "customer").select(F.col("c_custkey").alias("profile_id"), F.col("c_name").alias("slug"), (F.col("c_custkey") % 2 == 1).alias("active"), (F.col("c_nationkey") == 2).alias("is_default"))
    return lr.resolve_profile(n, "nobody")


@register("p04_profile_config_check", """WITH p AS (SELECT lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g')) AS slug, list_distinct(list_filter(list(lower(p_name)), lambda k: length(k) > 2)) AS kw, list_distinct(list_filter(list(CASE WHEN p_brand LIKE '%1' THEN 'promo' ELSE lower(p_type) END), lambda t: t <> 'promo')) AS tg, list_distinct(list(lower(p_type))) AS sd, p_brand LIKE '%11' AS bare FROM part GROUP BY p_brand)
  SELECT slug, CAST(least(60, len(kw)) AS INT) AS keywords, CAST(len(tg) AS INT) AS tags, CAST(CASE WHEN bare THEN 0 ELSE len(sd) END AS INT) AS seeds, CASE WHEN len(kw) < 5 THEN 'few-keywords' WHEN len(tg) = 0 AND bare THEN 'no-tags' END AS problem FROM p""")
def p04(spark, sf):
    t = F.when((F.col("p_type") == "PROMO") | F.col("p_brand").endswith("1"), "Not A Tag").otherwise(F.lower("p_type"))
    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("slug")).agg(F.collect_set("p_name").alias("keywords"), F.collect_set(t).alias("tags"), F.collect_set("p_type").alias("seeds"))
    return lr.profile_config_check(p.withColumn("seeds", F.when(F.col("slug").endswith("11"), F.array().cast("array<string>")).otherwise(F.col("seeds"))))


@register("m27_raised_versions", f"WITH {ENTITIES} SELECT entity_id % 40 AS profile_id, CAST(count(*) AS BIGINT) + CAST(entity_id % 40 % 3 = 1 AS INT) AS version FROM ents GROUP BY entity_id % 40")
def m27_versions(spark, sf):
    k = F.col("entity_id") % 40
    p = entities(spark, sf).groupBy(k.alias("profile_id")).agg(F.count(F.lit(1)).alias("version"))
    o = p.select("profile_id", F.when(F.col("profile_id") % 3 != 1, "slug-clash").alias("refused"))
    return lr.raised_versions(p, o.unionByName(o))


_STARTERS = ["Wrong Fit", "Too Big", "No Contact", "Already Great"]


@register("m27_starter_categories", f"""WITH {ENTITIES}, c AS (SELECT DISTINCT entity_id % 40 AS profile_id, lower(niche) AS slug, CAST(1 AS BIGINT) AS position FROM ents WHERE entity_id % 40 % 3 = 0)
  SELECT * FROM c UNION ALL SELECT profile_id, slug, position FROM (SELECT DISTINCT entity_id % 40 AS profile_id FROM ents WHERE entity_id % 40 % 3 <> 0), (VALUES {', '.join(f"('{n.lower().replace(' ', '-')}', CAST({i} AS BIGINT))" for i, n in enumerate(_STARTERS))}) v(slug, position)""")
def m27_starters(spark, sf):
    e = entities(spark, sf).withColumn("profile_id", F.col("entity_id") % 40)
    c = e.where("profile_id % 3 = 0").select("profile_id", F.lower("niche").alias("slug"), F.lit(1).cast("long").alias("position")).distinct()
    return lr.starter_categories(e, c, _STARTERS)


@register("p05_isolation_check", f"WITH {ENTITIES} SELECT 'orders' AS \"table\", o_orderkey AS id, o_custkey AS entity_id FROM orders JOIN ents ON o_custkey = entity_id WHERE o_custkey % 2 <> profile_id UNION ALL SELECT 'events', event_id, user_id FROM events JOIN ents ON user_id = entity_id WHERE user_id % 3 <> profile_id")
def p05(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity_id"), (F.col("o_custkey") % 2).alias("profile_id"))
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("entity_id"), (F.col("user_id") % 3).alias("profile_id"))
    return lr.isolation_check({"orders": o, "events": e}, entities(spark, sf))
