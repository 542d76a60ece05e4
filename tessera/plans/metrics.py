"""Queries of the metrics operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tessera.operators import metrics as m
from tessera.operators.metrics import NESTED

from .registry import register
from .standins import BUDGET, ENTITIES, FEEDBACK, OUTREACH, budget, entities, feedback, folder, outreach, table

AS_OF = date(2001, 7, 31)
YEAR, ALL, MONTH = m.window_bounds("year", AS_OF), m.window_bounds("all", AS_OF), m.window_bounds("month", AS_OF)
IN_YEAR, IN_ALL, IN_MONTH = "day >= DATE '2001-01-01' AND day < DATE '2001-08-01'", "day < DATE '2001-08-01'", "day >= DATE '2001-07-01' AND day < DATE '2001-08-01'"


@register("m12_outcomes", f"""WITH {ENTITIES}, {OUTREACH} SELECT profile_id, count(*) FILTER (response_status = 'REPLIED') AS replied, count(*) FILTER (response_status = 'NO_REPLY') AS no_reply,
  count(*) FILTER (response_status = 'GHOSTED') AS ghosted, count(*) FILTER (response_status IS NULL) AS awaiting, count(*) AS sent FROM outr JOIN ents USING (entity_id) WHERE status = 'SENT' AND {IN_YEAR} GROUP BY profile_id""")
def m12(spark, sf):
    return m.outcomes(outreach(spark, sf), entities(spark, sf), YEAR)


VOLUME = "count(*) FILTER (status = 'SENT') AS sent, count(*) FILTER (status = 'BOUNCED') AS bounced FROM outr WHERE status IN ('SENT', 'BOUNCED')"


@register("m13_send_volume", f"WITH {OUTREACH} SELECT CAST(date_trunc('month', day) AS DATE) AS bucket, {VOLUME} AND {IN_ALL} GROUP BY 1")
def m13(spark, sf):
    return m.send_volume(outreach(spark, sf), ALL)


@register("m13_send_volume_days", f"WITH {OUTREACH} SELECT CAST(date_trunc('day', day) AS DATE) AS bucket, {VOLUME} AND {IN_MONTH} GROUP BY 1")
def m13_days(spark, sf):
    return m.send_volume(outreach(spark, sf), MONTH)


_STEPS = ["discovered", *NESTED]
_COUNT = ", ".join(["count(*) AS discovered", *[f"count(*) FILTER (state IN ({', '.join(repr(s) for s in v)})) AS {k}" for k, v in NESTED.items()]])
_ROWS = " UNION ALL ".join(f"SELECT {i} AS step, '{x}' AS name, {x} AS n, {f'CAST({x} AS DOUBLE) / nullif({_STEPS[i - 1]}, 0)' if i else 'NULL'} AS share FROM c" for i, x in enumerate(_STEPS))


@register("m14_funnel", f"WITH {ENTITIES}, c AS (SELECT {_COUNT} FROM ents) {_ROWS}")
def m14(spark, sf):
    return m.funnel(entities(spark, sf))


REPLY = "count(*) AS sent, count(*) FILTER (response_status = 'REPLIED') AS replied, count(*) FILTER (response_status = 'REPLIED') / CAST(count(*) AS DOUBLE) AS rate FROM outr JOIN ents USING (entity_id) WHERE status = 'SENT'"


@register("m15_reply_by_niche", f"WITH {ENTITIES}, {OUTREACH} SELECT niche, {REPLY} AND {IN_ALL} GROUP BY niche ORDER BY sent DESC, niche LIMIT 8")
def m15(spark, sf):
    return m.reply_by_niche(outreach(spark, sf), entities(spark, sf), ALL)


@register("m16_reply_by_score_band", f"""WITH {ENTITIES}, {OUTREACH} SELECT CASE WHEN score >= 85 THEN 0 WHEN score >= 75 THEN 1 WHEN score >= 68 THEN 2 WHEN score >= 50 THEN 3 ELSE 4 END AS place,
  CASE WHEN score >= 85 THEN '85+' WHEN score >= 75 THEN '75-84' WHEN score >= 68 THEN '68-74' WHEN score >= 50 THEN '50-67' ELSE 'under 50' END AS band, {REPLY} AND {IN_ALL} GROUP BY 1, 2""")
def m16(spark, sf):
    return m.reply_by_score_band(outreach(spark, sf), entities(spark, sf), ALL)


@register("m17_spend", f"WITH {BUDGET} SELECT metric, CAST(sum(units) AS BIGINT) AS units FROM budg WHERE {IN_ALL} GROUP BY metric")
def m17(spark, sf):
    return m.spend(budget(spark, sf), ALL)


# places with a state, sources with one, and neither
_PLACE = "CASE entity_id % 4 WHEN 0 THEN location || ', ' || substr(upper(region), 1, 2) WHEN 1 THEN '' WHEN 2 THEN location END"
_SOURCE = "CASE WHEN entity_id % 3 = 0 THEN 'osm:' || lower(location) || '-or' WHEN entity_id % 3 = 1 THEN 'seed' END"


@register("m18_places_rollup", f"""WITH {ENTITIES}, q AS (SELECT coalesce({_PLACE}, '') AS loc, coalesce({_SOURCE}, '') AS src FROM ents), x AS (SELECT CASE WHEN regexp_matches(loc, ', ..$') THEN right(loc, 2) WHEN regexp_matches(src, '^osm:.*-..$') THEN upper(right(src, 2)) ELSE 'Unknown' END AS region, CASE WHEN loc <> '' THEN loc ELSE replace(src, 'osm:', '') END AS location FROM q),
  r AS (SELECT region, location, count(*) AS n FROM x GROUP BY ROLLUP (region, location)),
  t AS (SELECT region, n AS total FROM r WHERE location IS NULL AND region IS NOT NULL ORDER BY n DESC, region LIMIT 8),
  p AS (SELECT r.region, total, location, n, CAST(row_number() OVER (PARTITION BY r.region ORDER BY n DESC, location) AS INT) AS rank FROM r JOIN t USING (region) WHERE location IS NOT NULL) SELECT * FROM p WHERE rank <= 12""")
def m18(spark, sf):
    e = entities(spark, sf)
    return m.places_rollup(e.select(F.expr(_PLACE).alias("location"), F.expr(_SOURCE).alias("source")))


@register("m19_headline_rates", f"""WITH {ENTITIES}, {OUTREACH}, {BUDGET}, a AS (SELECT count(*) AS sent, count(*) FILTER (response_status = 'REPLIED') AS replied FROM outr JOIN ents USING (entity_id) WHERE status = 'SENT' AND {IN_ALL}),
  b AS (SELECT count(*) AS bounced FROM outr WHERE status = 'BOUNCED' AND {IN_ALL}), c AS (SELECT CAST(sum(units) AS BIGINT) AS units FROM budg WHERE {IN_ALL})
  SELECT CAST(replied AS DOUBLE) / nullif(sent, 0) AS reply_rate, CAST(bounced AS DOUBLE) / nullif(sent + bounced, 0) AS bounce_rate, CAST(units AS DOUBLE) / nullif(replied, 0) AS units_per_reply FROM a, b, c""")
def m19(spark, sf):
    o, e = outreach(spark, sf), entities(spark, sf)
    return m.headline_rates(m.outcomes(o, e, ALL), m.send_volume(o, ALL), m.spend(budget(spark, sf), ALL))


@register("m20_status_counts", f"WITH {ENTITIES} SELECT state, count(*) AS n FROM ents GROUP BY state")
def m20(spark, sf):
    return m.status_counts(entities(spark, sf), "state")


@register("m20_totals", f"WITH {ENTITIES} SELECT count(*) AS entities, count(DISTINCT domain) AS domains FROM ents")
def m20_totals(spark, sf):
    return entities(spark, sf).agg(F.count(F.lit(1)).alias("entities"), F.countDistinct("domain").alias("domains"))


@register("m21_rail_counts", f"""WITH {ENTITIES}, {OUTREACH}, a AS (SELECT count(*) FILTER (day = DATE '2001-07-30' AND status = 'DRAFT') AS to_do, count(*) FILTER (day = DATE '2001-07-30' AND status = 'SENT') AS sent_today,
  count(*) FILTER (status = 'SENT') AS sent, count(*) FILTER (status = 'SKIPPED') AS skipped, count(*) FILTER (status = 'BOUNCED') AS bounced FROM outr),
  b AS (SELECT count(*) FILTER (contacted_on IS NOT NULL) AS contacted FROM ents) SELECT * FROM a, b""")
def m21(spark, sf):
    return m.rail_counts(outreach(spark, sf), entities(spark, sf), date(2001, 7, 30))


@register("m22_history_page", f"""WITH {ENTITIES}, {OUTREACH}, {FEEDBACK}, r AS (SELECT outreach_id, entity_id, display_name, day FROM outr JOIN ents USING (entity_id)
  WHERE status = 'SENT' AND day BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND (display_name ILIKE '%CUSTOMER%7%' OR location ILIKE '%CUSTOMER%7%' OR priority ILIKE '%CUSTOMER%7%')),
  s AS (SELECT * FROM r ORDER BY day DESC, outreach_id DESC LIMIT 20 OFFSET 20),
  f AS (SELECT feedback_id // 2 AS outreach_id, decision, 'reason ' || k AS reason FROM feed QUALIFY row_number() OVER (PARTITION BY feedback_id // 2 ORDER BY created_at DESC, feedback_id DESC) = 1)
  SELECT s.*, decision, reason, (SELECT count(*) FROM r) AS total FROM s LEFT JOIN f USING (outreach_id)""")
def m22(spark, sf):
    said = reasoned(spark, sf).withColumn("outreach_id", F.floor(F.col("feedback_id") / 2))
    return m.history_page(outreach(spark, sf).withColumn("subject", F.col("priority")), entities(spark, sf), said, "SENT", "customer%7", date(1996, 1, 1), date(2000, 12, 31), page=1)


def reasoned(spark, sf):
    return feedback(spark, sf).withColumn("reason", F.concat(F.lit("reason "), "k"))


@register("m23_recent_notes", f"""WITH {ENTITIES}, {FEEDBACK} SELECT feedback_id, display_name, decision, 'reason ' || k AS reason FROM feed JOIN ents USING (entity_id) WHERE k % 3 = 0 ORDER BY created_at DESC, feedback_id DESC LIMIT 4""")
def m23(spark, sf):
    f = reasoned(spark, sf).withColumn("reason", F.when(F.col("k") % 3 == 0, F.col("reason")))
    return m.recent_notes(f, entities(spark, sf))


@register("m23_top_lessons", "SELECT doc_id % 5 AS profile_id, CAST(row_number() OVER (PARTITION BY doc_id % 5 ORDER BY n_chars DESC, doc_id) AS INT) AS rank, doc_id AS lesson_id, lang AS kind, n_chars AS weight FROM documents WHERE doc_id % 3 <> 1 QUALIFY rank <= 6")
def m23_lessons(spark, sf):
    k = F.col("doc_id")
    return m.top_lessons(table(spark, sf, "documents").select((k % 5).alias("profile_id"), k.alias("lesson_id"), F.col("lang").alias("kind"), F.col("n_chars").alias("weight"), (k % 3 != 1).alias("active")))


@register("m11_metric_window", f"""WITH {OUTREACH}, w(period, first, last, bucket) AS (VALUES ('today', DATE '2001-07-31', DATE '2001-08-01', 'hour'), ('month', DATE '2001-07-01', DATE '2001-08-01', 'day'), ('year', DATE '2001-01-01', DATE '2001-08-01', 'month'), ('all', NULL, DATE '2001-08-01', 'month'), ('day', DATE '2001-06-15', DATE '2001-06-16', 'hour'))
  SELECT w.*, (SELECT count(*) FROM outr WHERE day < last AND (first IS NULL OR day >= first)) AS n FROM w""")
def m11(spark, sf):
    return m.metric_windows(outreach(spark, sf), AS_OF, date(2001, 6, 15))


@register("m24_distinct_places", f"WITH {ENTITIES} SELECT DISTINCT location FROM ents WHERE location IS NOT NULL AND location <> '' ORDER BY location LIMIT 200")
def m24(spark, sf):
    return m.distinct_places(entities(spark, sf))


@register("m25_bookings_by_day", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1")
def m25(spark, sf):
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    b = e.select(F.col("event_id").alias("id"), F.when(kind == "signup", F.col("ts")).alias("start_a"), F.when(kind == "purchase", F.col("ts")).alias("start_b"))
    return m.bookings_by_day(b)


@register("m25_booking_rows", "SELECT CAST(ts AS DATE) AS day, event_id AS id, ts AS start, CASE WHEN user_id % 3 > 0 THEN 'n' || user_id END AS name, CASE WHEN user_id % 3 > 1 THEN 'n' || user_id || '@x.com' END AS email FROM events WHERE event_type <> 'click'")
def m25_rows(spark, sf):
    e, u, kind = table(spark, sf, "events"), F.col("user_id"), F.col("event_type")
    who = F.array(F.struct(F.concat(F.lit("n"), u).alias("name"), F.when(u % 3 > 1, F.concat(F.lit("N"), u, F.lit("@X.com"))).otherwise("").alias("email")))
    b = e.select(F.col("event_id").alias("id"), F.when(kind == "signup", F.col("ts")).alias("start_a"), F.when(~kind.isin("signup", "click"), F.col("ts")).alias("start_b"), F.when(u % 3 > 0, who).alias("attendees"))
    return m.booking_rows(b.withColumn("attendees", F.coalesce("attendees", F.array().cast("array<struct<name:string,email:string>>"))))


@register("m26_entity_profile", f"""WITH {ENTITIES}, {OUTREACH}, r AS (SELECT entity_id, outreach_id, row_number() OVER (PARTITION BY entity_id ORDER BY day DESC, outreach_id DESC) AS rank FROM outr),
  l AS (SELECT entity_id, list(outreach_id ORDER BY rank) AS latest FROM r WHERE rank <= 10 GROUP BY entity_id) SELECT entity_id, display_name, latest, list_sort(list_filter(['domain:' || domain, 'email:' || email], lambda x: x IS NOT NULL)) AS keys FROM ents LEFT JOIN l USING (entity_id)""")
def m26(spark, sf):
    e = entities(spark, sf)
    keys = e.select("entity_id", F.explode(F.array_compact(F.array(F.concat(F.lit("domain:"), "domain"), F.concat(F.lit("email:"), "email")))).alias("key"))
    return m.entity_profile(e, outreach(spark, sf), keys)


_CATS = """n AS (SELECT coalesce({0}, 'Not yet sorted') AS label, count(*) AS n FROM {1} GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS rank, count(*) OVER () AS labels FROM n)
  SELECT CASE WHEN labels > 5 AND rank >= 5 THEN 'Other' ELSE label END AS label, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1"""


@register("m03_category_counts", "WITH f AS (SELECT nullif(p_brand, 'Brand#1') AS b FROM part), " + _CATS.format("b", "f"))
def m03(spark, sf):
    p = table(spark, sf, "part").select(F.nullif("p_brand", F.lit("Brand#1")).alias("b"), F.lit(AS_OF).alias("day"))
    return m.category_counts(p, "b", ALL)


@register("m03_event_counts", f"WITH {FEEDBACK}, f AS (SELECT decision FROM feed WHERE day >= DATE '2024-01-05' AND day < DATE '2024-01-20'), " + _CATS.format("decision", "f"))
def m03_events(spark, sf):
    return m.category_counts(feedback(spark, sf), "decision", (date(2024, 1, 5), date(2024, 1, 20), "day"))


def stored_days(spark, sf):
    """Summaries of all days, those of one month written again after the others."""
    o, e, path = outreach(spark, sf), entities(spark, sf), folder(spark, "daily")
    days = m.daily(o, e)
    m.store_daily(path, days)
    m.store_daily(path, days.where(m.within(F.col("day"), MONTH)))
    return spark.read.parquet(path)


@register("m12_daily_outcomes", f"""WITH {ENTITIES}, {OUTREACH} SELECT profile_id, count(*) FILTER (response_status = 'REPLIED') AS replied, count(*) FILTER (response_status = 'NO_REPLY') AS no_reply,
  count(*) FILTER (response_status = 'GHOSTED') AS ghosted, count(*) FILTER (response_status IS NULL) AS awaiting, count(*) AS sent FROM outr JOIN ents USING (entity_id) WHERE status = 'SENT' AND {IN_YEAR} GROUP BY profile_id""")
def m12_daily(spark, sf):
    return m.daily_outcomes(stored_days(spark, sf), YEAR)


@register("m13_daily_volume", f"WITH {OUTREACH} SELECT CAST(date_trunc('month', day) AS DATE) AS bucket, {VOLUME} AND {IN_ALL} GROUP BY 1")
def m13_daily(spark, sf):
    return m.daily_volume(stored_days(spark, sf), ALL)


@register("m16_daily_bands", f"""WITH {ENTITIES}, {OUTREACH} SELECT CASE WHEN score >= 85 THEN 0 WHEN score >= 75 THEN 1 WHEN score >= 68 THEN 2 WHEN score >= 50 THEN 3 ELSE 4 END AS place,
  CASE WHEN score >= 85 THEN '85+' WHEN score >= 75 THEN '75-84' WHEN score >= 68 THEN '68-74' WHEN score >= 50 THEN '50-67' ELSE 'under 50' END AS band, {REPLY} AND {IN_ALL} GROUP BY 1, 2""")
def m16_daily(spark, sf):
    return m.daily_replies(stored_days(spark, sf), ALL, ["place", "band"])


# sketches of 2^12 registers err by less than 2 %; 6 % is three times that
@register("m20_daily_reach", f"WITH {ENTITIES}, {OUTREACH} SELECT profile_id, count(DISTINCT entity_id) AS entities, true AS near FROM outr JOIN ents USING (entity_id) WHERE status = 'SENT' AND {IN_ALL} GROUP BY profile_id")
def m20_reach(spark, sf):
    exact = outreach(spark, sf).where((F.col("status") == "SENT") & m.within(F.col("day"), ALL)).join(entities(spark, sf), "entity_id").groupBy("profile_id").agg(F.count_distinct("entity_id").alias("entities"))
    near = F.abs(F.col("reached") - F.col("entities")) <= F.greatest(F.lit(1), F.col("entities") * 0.06)
    return m.daily_reach(stored_days(spark, sf), ALL).join(exact, "profile_id").select("profile_id", "entities", near.alias("near"))
