"""Queries of the queue and merge operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tessera.operators import merge, queue
from tessera.functions.rules import QUEUE_STATES

from .registry import register
from .standins import BUDGET, ENTITIES, FEEDBACK, OUTREACH, budget, entities, feedback, outreach, table

NOW, DAY = date(2024, 1, 31), date(2001, 7, 20)
COOL = 10


def suppressions(spark, sf):
    k = F.col("s_suppkey")
    domain = F.concat(F.lit("domain:d"), (k * 5 % 97).cast("string"), F.lit(".com"))
    email = F.concat(F.lit("c"), k.cast("string"), F.lit("@d"), (k % 97).cast("string"), F.lit(".com"))
    return table(spark, sf, "supplier").select(F.when(k < 12, domain).otherwise(email).alias("key"))


def mx_cache(spark, sf):
    return feedback(spark, sf).select(F.concat(F.lit("d"), (F.col("entity_id") % 97).cast("string"), F.lit(".com")).alias("mx_domain"), F.col("day").alias("checked_on"), (F.col("k") % 2 == 0).alias("live"))


SUPP = "supp AS (SELECT DISTINCT CASE WHEN s_suppkey < 12 THEN 'domain:d' || (s_suppkey * 5 % 97) || '.com' ELSE 'c' || s_suppkey || '@d' || (s_suppkey % 97) || '.com' END AS key FROM supplier)"
MX = "mx AS (SELECT 'd' || (entity_id % 97) || '.com' AS mx_domain, max_by((k % 2 = 0), (day, (k % 2 = 0))) AS live, max(day) AS checked_on FROM feed GROUP BY 1)"
VERDICT = """CASE WHEN NOT coalesce(regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$'), false) THEN 'malformed'
  WHEN live AND DATE '2024-01-31' - checked_on <= 30 THEN 'live' WHEN NOT live AND DATE '2024-01-31' - checked_on <= 7 THEN 'dead' ELSE 'lookup' END"""
_OPEN = ", ".join(f"'{s}'" for s in QUEUE_STATES)
CAND = f"""cand AS (SELECT *, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, evaluated_on DESC NULLS LAST, entity_id) AS INT) AS place FROM ents
  WHERE score >= 35 AND state IN ({_OPEN}) AND contacted_on IS NULL AND NOT EXISTS (SELECT 1 FROM feed f WHERE f.entity_id = ents.entity_id AND decision IN ('SKIPPED', 'BLOCKED') AND day > DATE '2024-01-31' - {COOL}) QUALIFY place <= 120)"""
JUDGE = f"""judg AS (SELECT c.*, EXISTS (SELECT 1 FROM supp WHERE key = 'domain:' || domain OR key = email) AS suppressed, {VERDICT} AS verdict FROM cand c LEFT JOIN mx ON mx_domain = split_part(email, '@', -1)),
  reas AS (SELECT *, CASE WHEN suppressed THEN 'suppressed' WHEN email IS NULL THEN 'no-email' WHEN verdict IN ('dead', 'malformed') THEN 'undeliverable' END AS drop_reason FROM judg)"""
BASE = f"WITH {ENTITIES}, {FEEDBACK}, {SUPP}, {MX}, {CAND}, {JUDGE}"


def candidates(spark, sf):
    return queue.queue_candidates(entities(spark, sf), feedback(spark, sf), NOW, cooldown=COOL)


@register("q01_queue_candidates", f"{BASE} SELECT profile_id, place, entity_id, score FROM cand")
def q01(spark, sf):
    return candidates(spark, sf).select("profile_id", "place", "entity_id", "score")


@register("q02_suppression_filter", f"{BASE} SELECT entity_id, domain, email FROM reas WHERE NOT suppressed")
def q02(spark, sf):
    return queue.suppressed(candidates(spark, sf), suppressions(spark, sf)).where("not suppressed").select("entity_id", "domain", "email")


@register("q03_build_queue", f"""{BASE} SELECT profile_id, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY place) AS INT) AS rank, entity_id, display_name, score, score < 68 AS below_bar
  FROM reas WHERE drop_reason IS NULL QUALIFY rank <= 30""")
def q03(spark, sf):
    return queue.build_queue(candidates(spark, sf), suppressions(spark, sf), mx_cache(spark, sf), NOW)


@register("q03_queue_stats", f"{BASE} SELECT profile_id, coalesce(drop_reason, 'kept') AS reason, count(*) AS n FROM reas GROUP BY 1, 2")
def q03_stats(spark, sf):
    return queue.queue_stats(candidates(spark, sf), suppressions(spark, sf), mx_cache(spark, sf), NOW)


# skipped rows of a day stand for its earlier drafts
_DRAFTS = "dr AS (SELECT outreach_id, entity_id, CASE status WHEN 'SKIPPED' THEN 'DRAFT' ELSE status END AS status, day, priority AS subject, CAST(price AS VARCHAR) AS body, CAST(outreach_id % 30 AS INT) AS rank FROM outr)"


@register("q04_rewrite_drafts", f"""WITH {ENTITIES}, {OUTREACH}, {_DRAFTS}, kept AS (SELECT * FROM dr WHERE NOT (day = DATE '2001-07-20' AND status = 'DRAFT')),
  new AS (SELECT entity_id, display_name, score FROM ents WHERE score >= 90 AND entity_id NOT IN (SELECT entity_id FROM kept WHERE day = DATE '2001-07-20'))
  SELECT outreach_id, entity_id, status, day, subject, rank, md5(body) AS body FROM kept UNION ALL SELECT NULL, entity_id, 'DRAFT', DATE '2001-07-20', 'About ' || display_name, score, md5('Body ' || entity_id) FROM new""")
def q04(spark, sf):
    k = F.col("outreach_id")
    o = outreach(spark, sf).select("outreach_id", "entity_id", F.when(F.col("status") == "SKIPPED", "DRAFT").otherwise(F.col("status")).alias("status"), "day", F.col("priority").alias("subject"), F.col("price").cast("string").alias("body"), (k % 30).cast("int").alias("rank"))
    q = entities(spark, sf).where("score >= 90").select("entity_id", F.concat(F.lit("About "), "display_name").alias("subject"), F.concat(F.lit("Body "), "entity_id").alias("body"), F.col("score").alias("rank"))
    return queue.rewrite_drafts(o, q, DAY).withColumn("body", F.md5("body"))


@register("q05_deliverable", f"WITH {ENTITIES}, {FEEDBACK}, {MX} SELECT entity_id, {VERDICT} AS verdict FROM ents LEFT JOIN mx ON mx_domain = split_part(email, '@', -1)")
def q05(spark, sf):
    return queue.deliverable(entities(spark, sf), mx_cache(spark, sf), NOW).select("entity_id", "verdict")


_DNS = """dns AS (SELECT 'd' || user_id || '.com' AS domain, CASE WHEN event_type = 'error' AND user_id % 7 = 0 THEN 3 WHEN event_type = 'error' AND user_id % 7 = 1 THEN 2 ELSE 0 END AS status,
  CASE WHEN event_type = 'click' AND user_id % 7 <> 2 AND user_id % 7 < 5 THEN 15 WHEN event_type = 'view' AND user_id % 7 = 2 THEN 1 WHEN event_type = 'signup' AND user_id % 7 = 5 THEN 28 ELSE 5 END AS answer_type FROM events)"""


@register("q06_mx_verdict", f"""WITH {_DNS}, a AS (SELECT domain, max(status) AS worst, count(*) FILTER (status = 0 AND answer_type = 15) AS mx, count(*) FILTER (status = 0 AND answer_type = 1) AS a, count(*) FILTER (status = 0 AND answer_type = 28) AS aaaa FROM dns GROUP BY 1)
  SELECT domain, CASE WHEN worst = 3 THEN 'nxdomain' WHEN worst <> 0 THEN 'dns-status-' || worst WHEN mx > 0 THEN 'mx:' || mx WHEN a > 0 THEN 'implicit-mx:a' WHEN aaaa > 0 THEN 'implicit-mx:aaaa' ELSE 'no-mx-no-address' END AS detail,
  worst = 0 AND mx + a + aaaa > 0 AS live FROM a""")
def q06(spark, sf):
    e, u, t = table(spark, sf, "events"), F.col("user_id") % 7, F.col("event_type")
    status = F.when((t == "error") & (u == 0), 3).when((t == "error") & (u == 1), 2).otherwise(0)
    answer = F.when((t == "click") & (u != 2) & (u < 5), 15).when((t == "view") & (u == 2), 1).when((t == "signup") & (u == 5), 28).otherwise(5)
    return queue.mx_verdict(e.select(F.concat(F.lit("d"), F.col("user_id").cast("string"), F.lit(".com")).alias("domain"), status.alias("status"), answer.alias("answer_type")))


@register("q07_queue_view", f"WITH {ENTITIES}, {OUTREACH} SELECT outreach_id, entity_id, display_name, location, score, status FROM outr JOIN ents USING (entity_id) WHERE day = DATE '2001-07-20'")
def q07(spark, sf):
    return queue.queue_view(outreach(spark, sf), entities(spark, sf), DAY)


_WHY = "'reason ' || repeat('x', 190) || k"
_LAST = f"last AS (SELECT entity_id, decision, {_WHY} AS reason, created_at FROM feed {{0}}" + " QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, feedback_id DESC) = 1)"


@register("q08_apply_decisions", f"""WITH {ENTITIES}, {FEEDBACK}, {_LAST.format("WHERE decision IN ('SENT', 'SKIPPED', 'BLOCKED')")} SELECT entity_id,
  CASE WHEN decision = 'SENT' THEN 'CONTACTED' WHEN decision = 'SKIPPED' AND state = 'OUTREACH_READY' THEN 'NURTURE' WHEN decision = 'BLOCKED' THEN 'DO_NOT_CONTACT' ELSE state END AS state,
  CASE WHEN decision = 'SENT' THEN coalesce(contacted_on, CAST(created_at AS DATE)) ELSE contacted_on END AS contacted_on, CASE WHEN decision = 'SENT' THEN CAST(created_at AS DATE) ELSE contacted_on END AS last_contacted_on,
  CASE WHEN decision = 'SKIPPED' AND state = 'OUTREACH_READY' THEN substr(reason, 1, 200) END AS skip_reason FROM ents LEFT JOIN last USING (entity_id)""")
def q08(spark, sf):
    return queue.apply_decisions(reasoned(spark, sf), entities(spark, sf))


def reasoned(spark, sf):
    return feedback(spark, sf).withColumn("reason", F.concat(F.lit("reason " + 190 * "x"), "k"))


@register("q08_decided_outreach", f"""WITH {OUTREACH}, {FEEDBACK}, d AS (SELECT feedback_id % 5000 AS outreach_id, arg_max(decision, (created_at, feedback_id)) AS decision, max(created_at) AS seen FROM feed WHERE decision IN ('SENT', 'SKIPPED') GROUP BY 1)
  SELECT outreach_id, entity_id, coalesce(decision, status) AS status, CASE WHEN decision = 'SENT' THEN seen END AS sent_at FROM outr LEFT JOIN d USING (outreach_id)""")
def q08_outreach(spark, sf):
    d = reasoned(spark, sf).withColumn("outreach_id", F.col("feedback_id") % 5000)
    return queue.decided_outreach(outreach(spark, sf).select("outreach_id", "entity_id", "status"), d.drop("entity_id"))


_BOUNCES = "bo AS (SELECT feedback_id % 5000 AS outreach_id, 'user ' || repeat('y', 195) || k AS note, created_at AS seen FROM feed WHERE decision = 'BOUNCED')"


def bounces(spark, sf):
    f = feedback(spark, sf).where("decision = 'BOUNCED'")
    return f.select((F.col("feedback_id") % 5000).alias("outreach_id"), F.concat(F.lit("user " + 195 * "y"), "k").alias("note"), F.col("created_at").alias("at"))


@register("q09_bounced_outreach", f"""WITH {OUTREACH}, {FEEDBACK}, {_BOUNCES}, b AS (SELECT outreach_id, max(seen) AS seen, arg_max(note, (seen, note)) AS note FROM bo GROUP BY 1)
  SELECT outreach_id, CASE WHEN seen IS NULL THEN status ELSE 'BOUNCED' END AS status, seen AS bounced_at, substr('bounced: ' || note, 1, 300) AS send_error FROM outr LEFT JOIN b USING (outreach_id)""")
def q09_outreach(spark, sf):
    return queue.bounced_outreach(outreach(spark, sf).select("outreach_id", "status"), bounces(spark, sf))


@register("q09_bounce_suppressions", f"""WITH {ENTITIES}, {OUTREACH}, {FEEDBACK}, {SUPP}, {_BOUNCES}, n AS (SELECT email AS key, substr('bounced: ' || arg_max(note, (seen, note)), 1, 200) AS reason FROM bo JOIN outr USING (outreach_id) JOIN ents USING (entity_id) WHERE email IS NOT NULL GROUP BY 1)
  SELECT key, 'asked' AS reason FROM supp WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT * FROM n""")
def q09_suppressions(spark, sf):
    s = suppressions(spark, sf).distinct().withColumn("reason", F.lit("asked"))
    return queue.bounce_suppressions(s, bounces(spark, sf), outreach(spark, sf), entities(spark, sf))


@register("q04_surfaced", f"WITH {ENTITIES} SELECT entity_id, CASE WHEN hit THEN 'OUTREACH_READY' ELSE state END AS state, times_surfaced + CASE WHEN hit THEN 1 ELSE 0 END AS times_surfaced FROM (SELECT *, score >= 60 AND state IN ('QUALIFIED', 'SHORTLISTED', 'NURTURE') AS hit FROM ents)")
def q04_surfaced(spark, sf):
    e = entities(spark, sf)
    return queue.surfaced(e, e.where("score >= 60")).select("entity_id", "state", "times_surfaced")


@register("q08_block_suppressions", f"WITH {ENTITIES}, {FEEDBACK}, {SUPP}, {_LAST.format('')} SELECT key FROM supp UNION SELECT email FROM last JOIN ents USING (entity_id) WHERE decision = 'BLOCKED' AND email IS NOT NULL")
def q08_block(spark, sf):
    return queue.block_suppressions(reasoned(spark, sf), entities(spark, sf), suppressions(spark, sf))


@register("q09_apply_bounces", f"""WITH {ENTITIES}, {OUTREACH}, o AS (SELECT entity_id, count(*) FILTER (status = 'BOUNCED') AS b, count(*) FILTER (status = 'SENT') AS s FROM outr GROUP BY 1)
  SELECT entity_id, CASE WHEN NOT coalesce(b, 0) > 0 THEN email END AS email, CASE WHEN coalesce(b, 0) > 0 THEN 'NURTURE' ELSE state END AS state, CASE WHEN NOT (coalesce(b, 0) > 0 AND s = 0) THEN contacted_on END AS contacted_on FROM ents LEFT JOIN o USING (entity_id)""")
def q09(spark, sf):
    return queue.apply_bounces(outreach(spark, sf), entities(spark, sf))


_REVIVE = f"""{OUTREACH}, o AS (SELECT *, entity_id % 2 AS profile_id, outreach_id % 40 AS rank FROM outr), today AS (SELECT * FROM o WHERE day = DATE '2001-07-20'), r AS (SELECT outreach_id, entity_id, profile_id,
  CASE WHEN status = 'SENT' THEN 'already-sent' WHEN entity_id IN (SELECT entity_id FROM today) THEN 'already-queued' END AS refused FROM o WHERE outreach_id % 3 <> 0),
  s AS (SELECT *, coalesce(refused, CASE WHEN row_number() OVER (PARTITION BY refused, entity_id ORDER BY outreach_id) > 1 THEN 'already-queued' END) AS again FROM r), t AS (SELECT profile_id, max(rank) AS top FROM today GROUP BY 1),
  v AS (SELECT outreach_id, entity_id, profile_id, again AS refused, CASE WHEN again IS NULL THEN row_number() OVER (PARTITION BY again, profile_id ORDER BY outreach_id) + coalesce(top, 0) END AS rank FROM s LEFT JOIN t USING (profile_id))"""


def ranked_outreach(spark, sf):
    return outreach(spark, sf).withColumns({"profile_id": F.col("entity_id") % 2, "rank": F.col("outreach_id") % 40})


def revivals(spark, sf):
    o = ranked_outreach(spark, sf)
    return queue.revive(o.where("outreach_id % 3 <> 0").select("outreach_id"), o, DAY)


@register("q10_revive", f"WITH {_REVIVE} SELECT * FROM v")
def q10(spark, sf):
    return revivals(spark, sf)


@register("q10_revived_rows", f"WITH {_REVIVE} SELECT outreach_id, CASE WHEN v.rank IS NULL THEN status ELSE 'DRAFT' END AS status, CASE WHEN v.rank IS NULL THEN day ELSE DATE '2001-07-20' END AS day, coalesce(v.rank, o.rank) AS rank FROM o LEFT JOIN v USING (outreach_id)")
def q10_rows(spark, sf):
    return queue.revived_rows(ranked_outreach(spark, sf), revivals(spark, sf), DAY).select("outreach_id", "status", "day", "rank")


@register("q10_revived_entities", f"WITH {ENTITIES}, {_REVIVE} SELECT entity_id, CASE WHEN state = 'NURTURE' AND entity_id IN (SELECT entity_id FROM v WHERE refused IS NULL) THEN 'OUTREACH_READY' ELSE state END AS state FROM ents")
def q10_entities(spark, sf):
    return queue.revived_entities(entities(spark, sf), revivals(spark, sf)).select("entity_id", "state")


@register("q11_response_status", f"""WITH {ENTITIES}, ev AS (SELECT user_id AS entity_id, CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN 'REPLIED' WHEN 'error' THEN 'NO_REPLY' WHEN 'view' THEN 'GHOSTED' END AS response FROM events GROUP BY 1)
  SELECT entity_id, CASE WHEN response = 'REPLIED' AND state = 'CONTACTED' THEN 'REPLIED' WHEN (response IS NULL OR response <> 'REPLIED') AND state = 'REPLIED' THEN 'CONTACTED' ELSE state END AS state, response AS response_status FROM ents JOIN ev USING (entity_id)""")
def q11(spark, sf):
    last = table(spark, sf, "events").groupBy(F.col("user_id").alias("entity_id")).agg(F.max(F.struct("ts", "event_id", "event_type"))["event_type"].alias("t"))
    response = F.when(F.col("t") == "purchase", "REPLIED").when(F.col("t") == "error", "NO_REPLY").when(F.col("t") == "view", "GHOSTED")
    return queue.response_status(last.select("entity_id", response.alias("response")), entities(spark, sf))


@register("q12_ghost_sweep", f"""WITH {ENTITIES}, {OUTREACH}, l AS (SELECT entity_id, max(day) AS last_contact FROM outr GROUP BY 1) SELECT entity_id,
  CASE WHEN state = 'CONTACTED' AND response_status IS NULL AND last_contact < DATE '2001-08-01' - 30 THEN 'GHOSTED' ELSE response_status END AS response_status FROM ents LEFT JOIN l USING (entity_id)""")
def q12(spark, sf):
    last = outreach(spark, sf).groupBy("entity_id").agg(F.max("day").alias("last_contact"))
    return queue.ghost_sweep(entities(spark, sf), last, date(2001, 8, 1))


@register("q13_daily_cap", f"""WITH {OUTREACH}, q AS (SELECT outreach_id, CAST(row_number() OVER (ORDER BY outreach_id) AS INT) AS turn FROM outr WHERE day = DATE '2001-07-20' AND status = 'SKIPPED')
  SELECT outreach_id, turn FROM q WHERE turn <= 30 - (SELECT count(*) FROM outr WHERE day = DATE '2001-07-20' AND status = 'SENT')""")
def q13(spark, sf):
    o = outreach(spark, sf)
    return queue.daily_cap(o, o.where((F.col("day") == F.lit(DAY)) & (F.col("status") == "SKIPPED")), DAY, 30)


@register("q14_budget_remaining", f"""WITH {BUDGET}, lim AS (SELECT DISTINCT profile_id, metric, CASE metric WHEN 'A' THEN 200 WHEN 'N' THEN 300 ELSE 20 END AS most FROM budg),
  u AS (SELECT profile_id, metric, CAST(sum(units) AS BIGINT) AS used FROM budg WHERE day = DATE '2000-03-03' GROUP BY ALL) SELECT profile_id, metric, greatest(0, most - coalesce(used, 0)) AS remaining FROM lim LEFT JOIN u USING (profile_id, metric)""")
def q14(spark, sf):
    b = budget(spark, sf)
    limits = b.select("profile_id", "metric").distinct().withColumn("most", F.when(F.col("metric") == "A", 200).when(F.col("metric") == "N", 300).otherwise(20))
    return queue.budget_remaining(b, limits, date(2000, 3, 3))


_MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+"


@register("q15_set_email", f"""WITH {FEEDBACK}, {MX}, {SUPP}, r AS (SELECT doc_id AS request_id, CASE WHEN doc_id % 3 = 0 THEN lower(trim(regexp_extract(text, '{_MAIL}'))) WHEN doc_id % 3 = 1 THEN 'c' || (doc_id % 200) || '@d' || (doc_id % 200 % 97) || '.com' ELSE 'nobody' END AS email FROM documents)
  SELECT request_id, email, CASE WHEN {VERDICT} = 'malformed' THEN 'malformed' WHEN EXISTS (SELECT 1 FROM supp WHERE key = 'domain:' || split_part(email, '@', -1) OR key = email) THEN 'suppressed' WHEN {VERDICT} = 'dead' THEN 'undeliverable' END AS refused
  FROM r LEFT JOIN mx ON mx_domain = split_part(email, '@', -1)""")
def q15(spark, sf):
    k = F.col("doc_id")
    mail = F.when(k % 3 == 0, F.regexp_extract("text", _MAIL, 0)).when(k % 3 == 1, F.concat(F.lit("c"), (k % 200).cast("string"), F.lit("@d"), (k % 200 % 97).cast("string"), F.lit(".com"))).otherwise("nobody")
    r = table(spark, sf, "documents").select(k.alias("request_id"), mail.alias("email"))
    return queue.set_email(r, suppressions(spark, sf), mx_cache(spark, sf), NOW)


@register("a11_upsert_ignore", "WITH t AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0) SELECT * FROM t UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey NOT IN (SELECT k FROM t)")
def a11(spark, sf):
    o = table(spark, sf, "orders")
    t = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return merge.upsert_ignore(t, o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + 1).alias("v")), ["k"])


@register("a12_upsert_replace", "SELECT o_custkey AS k, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS v, max(CAST(o_orderdate AS DATE)) AS written FROM orders GROUP BY 1")
def a12(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"), F.to_date("o_orderdate").alias("written"), F.col("o_orderkey").alias("id"))
    return merge.upsert_replace(o.where("id % 2 = 0"), o.where("id % 2 = 1"), ["k"], [F.col("written"), F.col("id")]).select("k", "v", "written")


@register("a13_upsert_accumulate", f"WITH {BUDGET} SELECT source, CAST(sum(units) AS BIGINT) AS units, max(day) AS last_run, CAST(sum(CASE WHEN metric = 'A' THEN 0 ELSE 1 END) AS BIGINT) AS runs FROM budg GROUP BY 1")
def a13(spark, sf):
    b = budget(spark, sf).select("source", F.col("units").cast("long").alias("units"), F.col("day").alias("last_run"), "metric")
    old = b.where("metric = 'A'").withColumn("runs", F.lit(0).cast("long")).drop("metric")
    return merge.upsert_accumulate(old, b.where("metric <> 'A'").drop("metric"), ["source"], ["units"], "last_run")


@register("a14_run_log", "SELECT user_id AS run_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS steps, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1 ORDER BY started_at DESC, run_id DESC LIMIT 8")
def a14(spark, sf):
    runs = table(spark, sf, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("steps"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return merge.latest_runs(runs)
