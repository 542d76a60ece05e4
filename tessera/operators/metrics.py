"""Windowed metrics over outreach, entities, budgets and decisions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.stored import overwrite_partitions

NESTED = {
    "evaluated": ["EVALUATED", "QUALIFIED", "SHORTLISTED", "OUTREACH_READY", "CONTACTED", "REPLIED", "CONVERSATION", "CLIENT", "NURTURE", "NOT_NOW", "REJECTED"],
    "qualified": ["QUALIFIED", "SHORTLISTED", "OUTREACH_READY", "CONTACTED", "REPLIED", "CONVERSATION", "CLIENT"],
    "contacted": ["CONTACTED", "REPLIED", "CONVERSATION", "CLIENT"],
    "replied": ["REPLIED", "CONVERSATION", "CLIENT"],
    "client": ["CLIENT"],
}
BANDS = [(85, "85+"), (75, "75-84"), (68, "68-74"), (50, "50-67")]


def window_bounds(period: str, as_of: date, day: date | None = None) -> tuple[date | None, date, str]:
    """Half-open bounds of a period and its bucket: one named day, today, this month, this year, or everything."""
    tomorrow = as_of + timedelta(days=1)
    if day is not None:
        return day, day + timedelta(days=1), "hour"
    if period == "today":
        return as_of, tomorrow, "hour"
    if period == "month":
        return as_of.replace(day=1), tomorrow, "day"
    if period == "year":
        return as_of.replace(month=1, day=1), tomorrow, "month"
    return None, tomorrow, "month"


def within(day: Column, bounds: tuple) -> Column:
    first, last, _ = bounds
    ok = day < F.lit(last)
    return ok & (day >= F.lit(first)) if first is not None else ok


def outcomes(outreach: DataFrame, entities: DataFrame, bounds: tuple) -> DataFrame:
    """Sent rows of the window by the response of their entity, per profile."""
    sent = outreach.where((F.col("status") == "SENT") & within(F.col("day"), bounds))
    r = F.col("response_status")
    return sent.join(entities, "entity_id").groupBy("profile_id").agg(
        F.count_if(r == "REPLIED").alias("replied"), F.count_if(r == "NO_REPLY").alias("no_reply"), F.count_if(r == "GHOSTED").alias("ghosted"), F.count_if(r.isNull()).alias("awaiting"), F.count(F.lit(1)).alias("sent")
    )


def send_volume(outreach: DataFrame, bounds: tuple) -> DataFrame:
    """Sent and bounced rows in tumbling buckets."""
    bucket = F.date_trunc(bounds[2], F.col("day")).cast("date").alias("bucket")
    return outreach.where(within(F.col("day"), bounds) & F.col("status").isin("SENT", "BOUNCED")).groupBy(bucket).agg(F.count_if(F.col("status") == "SENT").alias("sent"), F.count_if(F.col("status") == "BOUNCED").alias("bounced"))


def funnel(entities: DataFrame) -> DataFrame:
    """Nested steps and each one's share of the step before."""
    one = entities.agg(F.count(F.lit(1)).alias("discovered"), *[F.count_if(F.col("state").isin(v)).alias(k) for k, v in NESTED.items()])
    names = ["discovered", *NESTED]
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(x).alias("name"), F.col(x).alias("n"), (F.col(names[i - 1]) if i else F.lit(None).cast("long")).alias("before")) for i, x in enumerate(names)]))
    return one.select(pairs.alias("s")).select("s.step", "s.name", "s.n", F.try_divide("s.n", "s.before").alias("share"))


def reply_by(outreach: DataFrame, entities: DataFrame, bounds: tuple, key: Column, name: str) -> DataFrame:
    sent = outreach.where((F.col("status") == "SENT") & within(F.col("day"), bounds)).join(entities, "entity_id")
    return sent.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("sent"), F.count_if(F.col("response_status") == "REPLIED").alias("replied")).withColumn("rate", F.try_divide("replied", "sent"))


def reply_by_niche(outreach: DataFrame, entities: DataFrame, bounds: tuple, top: int = 8) -> DataFrame:
    """The ``top`` niches by sent rows."""
    return reply_by(outreach, entities, bounds, F.col("niche"), "niche").orderBy(F.desc("sent"), "niche").limit(top)


def band_of(score: Column) -> tuple[Column, Column]:
    """A score's band and its place."""
    band, place = F.lit("under 50"), F.lit(len(BANDS))
    for i, (low, name) in reversed(list(enumerate(BANDS))):
        band, place = F.when(score >= low, name).otherwise(band), F.when(score >= low, i).otherwise(place)
    return band, place


def reply_by_score_band(outreach: DataFrame, entities: DataFrame, bounds: tuple) -> DataFrame:
    """Fixed bands, best first; ``place`` is the order."""
    band, place = band_of(F.col("score"))
    return reply_by(outreach, entities, bounds, F.struct(place.alias("place"), band.alias("band")), "b").select("b.place", "b.band", "sent", "replied", "rate")


def spend(budget: DataFrame, bounds: tuple) -> DataFrame:
    return budget.where(within(F.col("day"), bounds)).groupBy("metric").agg(F.sum("units").alias("units"))


def daily(outreach: DataFrame, entities: DataFrame) -> DataFrame:
    """Summaries from which the metrics of any window are merged: rows of each profile, day, status, niche, band and response.

    ``who`` is a sketch of the entities, for distinct counts over many days. Rows of unknown entities have no profile.
    """
    band, place = band_of(F.col("score"))
    e = entities.select("entity_id", "profile_id", "niche", "score", "response_status")
    rows = outreach.select("entity_id", "status", "day").join(e, "entity_id", "left").withColumns({"band": band, "place": place})
    return rows.groupBy("profile_id", "day", "status", "niche", "place", "band", "response_status").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col("entity_id").cast("long")).alias("who"))


def store_daily(path: str, summaries: DataFrame) -> None:
    """Write the months that ``summaries`` has, each whole; other months of the table stay as they are."""
    months = summaries.withColumn("month", F.date_format("day", "yyyy-MM"))
    overwrite_partitions(months.repartition("month"), path, ["month"])


def in_months(days: DataFrame, bounds: tuple) -> DataFrame:
    """Rows of the window, found by their month first, so that other folders aren't read."""
    first, last, _ = bounds
    d = days.where(F.col("month") <= last.strftime("%Y-%m"))
    d = d.where(F.col("month") >= first.strftime("%Y-%m")) if first is not None else d
    return d.where(within(F.col("day"), bounds))


def daily_outcomes(days: DataFrame, bounds: tuple) -> DataFrame:
    """outcomes() from summaries."""
    sent = in_months(days, bounds).where("status = 'SENT' and profile_id is not null")
    n, r = F.col("n"), F.col("response_status")
    some = lambda c: F.sum(F.when(c, n).otherwise(0))
    return sent.groupBy("profile_id").agg(some(r == "REPLIED").alias("replied"), some(r == "NO_REPLY").alias("no_reply"), some(r == "GHOSTED").alias("ghosted"), some(r.isNull()).alias("awaiting"), F.sum(n).alias("sent"))


def daily_volume(days: DataFrame, bounds: tuple) -> DataFrame:
    """send_volume() from summaries."""
    bucket = F.date_trunc(bounds[2], F.col("day")).cast("date").alias("bucket")
    some = lambda s: F.sum(F.when(F.col("status") == s, F.col("n")).otherwise(0))
    return in_months(days, bounds).where("status in ('SENT', 'BOUNCED')").groupBy(bucket).agg(some("SENT").alias("sent"), some("BOUNCED").alias("bounced"))


def daily_replies(days: DataFrame, bounds: tuple, by: list[str]) -> DataFrame:
    """Sent rows, replies and their rate by columns of the summaries."""
    sent = in_months(days, bounds).where("status = 'SENT' and profile_id is not null")
    return sent.groupBy(*by).agg(F.sum("n").alias("sent"), F.sum(F.when(F.col("response_status") == "REPLIED", F.col("n")).otherwise(0)).alias("replied")).withColumn("rate", F.try_divide("replied", "sent"))


def daily_reach(days: DataFrame, bounds: tuple) -> DataFrame:
    """About how many distinct entities each profile wrote to in the window: sketches of single days, united."""
    sent = in_months(days, bounds).where("status = 'SENT' and profile_id is not null")
    return sent.groupBy("profile_id").agg(F.hll_sketch_estimate(F.hll_union_agg("who")).alias("reached"))


def places_rollup(entities: DataFrame, states: int = 8, cities: int = 12) -> DataFrame:
    """Entities (location, source) by state and place with state totals: the largest states, and the largest places of each.

    The state is that of "City, ST", else the end of a source "osm:city-st", else Unknown; the place the location, else the
    source's.
    """
    loc, source = F.coalesce("location", F.lit("")), F.coalesce("source", F.lit(""))
    state = F.when(loc.rlike(r", ..$"), F.substring(loc, -2, 2)).when(source.rlike(r"^osm:.*-..$"), F.upper(F.substring(source, -2, 2))).otherwise("Unknown")
    at = entities.select(state.alias("region"), F.when(loc != "", loc).otherwise(F.replace(source, F.lit("osm:"), F.lit(""))).alias("location"))
    r = at.rollup("region", "location").agg(F.count(F.lit(1)).alias("n")).where("region is not null")
    totals = r.where("location is null").select("region", F.col("n").alias("total")).orderBy(F.desc("total"), "region").limit(states)
    w = Window.partitionBy("region").orderBy(F.desc("n"), "location")
    places = r.where("location is not null").join(totals, "region").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cities)
    return places.select("region", "total", "location", "n", "rank")


def headline_rates(out: DataFrame, volume: DataFrame, used: DataFrame) -> DataFrame:
    """Reply rate, bounce rate and units per reply; null where there is nothing to divide by."""
    a = out.agg(F.coalesce(F.sum("replied"), F.lit(0)).alias("replied"), F.coalesce(F.sum("sent"), F.lit(0)).alias("sent"))
    b = volume.agg(F.coalesce(F.sum("bounced"), F.lit(0)).alias("bounced"))
    c = used.agg(F.coalesce(F.sum("units"), F.lit(0)).alias("units"))
    # three frames of one row each
    return a.crossJoin(b).crossJoin(c).select(F.try_divide("replied", "sent").alias("reply_rate"), F.try_divide(F.col("bounced"), F.col("sent") + F.col("bounced")).alias("bounce_rate"), F.try_divide("units", "replied").alias("units_per_reply"))


def status_counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def rail_counts(outreach: DataFrame, entities: DataFrame, day: date) -> DataFrame:
    d, s = F.col("day") == F.lit(day), F.col("status")
    a = outreach.agg(F.count_if(d & (s == "DRAFT")).alias("to_do"), F.count_if(d & (s == "SENT")).alias("sent_today"), F.count_if(s == "SENT").alias("sent"), F.count_if(s == "SKIPPED").alias("skipped"), F.count_if(s == "BOUNCED").alias("bounced"))
    return a.crossJoin(entities.agg(F.count_if(F.col("contacted_on").isNotNull()).alias("contacted")))


def history_page(outreach: DataFrame, entities: DataFrame, feedback: DataFrame, status: str, search: str, first: date, last: date, page: int = 0, size: int = 20) -> DataFrame:
    """One page of a status' rows, newest first, with the total and the last decision and reason on each row itself.

    feedback (outreach_id, created_at, feedback_id, decision, reason) is read for the page's rows alone.
    """
    hit = F.col("display_name").ilike(f"%{search}%") | F.col("location").ilike(f"%{search}%") | F.col("subject").ilike(f"%{search}%")
    some = outreach.where((F.col("status") == status) & F.col("day").between(F.lit(first), F.lit(last))).select("outreach_id", "entity_id", "day", "subject")
    rows = some.join(entities.select("entity_id", "display_name", "location"), "entity_id").where(hit)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    shown = rows.select("outreach_id", "entity_id", "display_name", "day").orderBy(F.desc("day"), F.desc("outreach_id")).offset(page * size).limit(size)
    # at most ``size`` rows
    said = feedback.join(F.broadcast(shown.select("outreach_id")), "outreach_id", "left_semi")
    latest = said.groupBy("outreach_id").agg(F.max(F.struct("created_at", "feedback_id", "decision", "reason")).alias("f")).select("outreach_id", "f.decision", "f.reason")
    return shown.join(latest, "outreach_id", "left").crossJoin(total)


def distinct_places(entities: DataFrame, most: int = 200) -> DataFrame:
    return entities.where("location is not null and location <> ''").select("location").distinct().orderBy("location").limit(most)


def recent_notes(feedback: DataFrame, entities: DataFrame, most: int = 4) -> DataFrame:
    """The latest decisions with a reason, and the entity's name."""
    top = feedback.where("reason is not null").join(entities.select("entity_id", "display_name"), "entity_id")
    return top.orderBy(F.desc("created_at"), F.desc("feedback_id")).limit(most).select("feedback_id", "display_name", "decision", "reason")


def top_lessons(lessons: DataFrame, most: int = 6) -> DataFrame:
    """The weightiest active lessons of each profile."""
    w = Window.partitionBy("profile_id").orderBy(F.desc("weight"), "lesson_id")
    return lessons.where("active").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("profile_id", "rank", "lesson_id", "kind", "weight")


def metric_windows(rows: DataFrame, as_of: date, day: date) -> DataFrame:
    """Rows (day) in each period's window, in one pass."""
    bounds = {p: window_bounds(p, as_of) for p in ("today", "month", "year", "all")} | {"day": window_bounds("day", as_of, day)}
    one = rows.agg(*[F.count_if(within(F.col("day"), b)).alias(p) for p, b in bounds.items()])
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.lit(b[0]).alias("first"), F.lit(b[1]).alias("last"), F.lit(b[2]).alias("bucket"), F.col(p).alias("n")) for p, b in bounds.items()]))
    return one.select(each.alias("w")).select("w.*")


def bookings_by_day(bookings: DataFrame) -> DataFrame:
    """Bookings (start_a or start_b, id) by day; those without a start go."""
    b = bookings.withColumn("day", F.to_date(F.coalesce("start_a", "start_b"))).where("day is not null")
    return b.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def booking_rows(bookings: DataFrame) -> DataFrame:
    """Bookings (id, start_a or start_b, attendees: name and email) with the first attendee, by start; those without one go."""
    start, who = F.coalesce("start_a", "start_b"), F.get("attendees", F.lit(0))
    b = bookings.withColumns({"start": start, "name": who["name"], "email": F.nullif(F.lower(who["email"]), F.lit(""))}).where("start is not null")
    return b.select(F.to_date("start").alias("day"), "id", "start", "name", "email")


def entity_profile(entities: DataFrame, snapshots: DataFrame, keys: DataFrame | None = None, most: int = 10) -> DataFrame:
    """Each entity with its latest snapshots, newest first, and its identity keys (entity_id, key) in order."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("day"), F.desc("outreach_id"))
    last = snapshots.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    nested = last.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "outreach_id"))), lambda s: s["outreach_id"]).alias("latest"))
    out = entities.select("entity_id", "display_name").join(nested, "entity_id", "left")
    return out if keys is None else out.join(keys.groupBy("entity_id").agg(F.array_sort(F.collect_set("key")).alias("keys")), "entity_id", "left")


def category_counts(rows: DataFrame, label: str, bounds: tuple, most: int = 5) -> DataFrame:
    """Rows of a window by label; beyond ``most`` labels, the first ones and "Other". Counts add up to the rows."""
    n = rows.where(within(F.col("day"), bounds)).groupBy(F.coalesce(F.col(label), F.lit("Not yet sorted")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    # one row per label
    r = n.withColumns({"rank": F.row_number().over(Window.orderBy(F.desc("n"), "label")), "labels": F.count(F.lit(1)).over(Window.partitionBy())})
    name = F.when((F.col("labels") > most) & (F.col("rank") >= most), "Other").otherwise(F.col("label"))
    return r.groupBy(name.alias("label")).agg(F.sum("n").alias("n"))
