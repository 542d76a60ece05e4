"""The daily review queue and what reviewers' decisions, bounces and replies do to it, as table transitions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.rules import COOLDOWN_DAYS, GHOST_DAYS, MX_DEAD_DAYS, MX_LIVE_DAYS, QUALIFY_BAR, QUEUE_FLOOR, QUEUE_MAX, QUEUE_STATES

EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def queue_candidates(entities: DataFrame, feedback: DataFrame, as_of: date, most: int = QUEUE_MAX, cooldown: int = COOLDOWN_DAYS) -> DataFrame:
    """Entities worth a look, 4 * ``most`` per profile: enough score, open state, never contacted, not turned down lately."""
    turned = feedback.where(F.col("decision").isin("SKIPPED", "BLOCKED") & (F.col("day") > F.date_sub(F.lit(as_of), cooldown)))
    open_ = entities.where((F.col("score") >= QUEUE_FLOOR) & F.col("state").isin(QUEUE_STATES) & F.col("contacted_on").isNull())
    w = Window.partitionBy("profile_id").orderBy(F.desc("score"), F.col("evaluated_on").desc_nulls_last(), "entity_id")
    return open_.join(turned.select("entity_id"), "entity_id", "left_anti").withColumn("place", F.row_number().over(w)).where(F.col("place") <= 4 * most)


def suppressed(entities: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Append ``suppressed``: the domain or the address is on the list (column ``key``)."""
    keys = suppressions.select("key").distinct()
    d = keys.select(F.col("key").alias("_dk"))
    e = keys.select(F.col("key").alias("_ek"))
    both = entities.join(d, F.concat(F.lit("domain:"), F.col("domain")) == F.col("_dk"), "left").join(e, F.col("email") == F.col("_ek"), "left")
    return both.withColumn("suppressed", F.col("_dk").isNotNull() | F.col("_ek").isNotNull()).drop("_dk", "_ek")


def deliverable(entities: DataFrame, mx_cache: DataFrame, as_of: date) -> DataFrame:
    """Append ``verdict``: live, dead, lookup (unknown or stale, which counts as deliverable) or malformed."""
    latest = mx_cache.groupBy("mx_domain").agg(F.max(F.struct("checked_on", "live")).alias("m"))
    fresh = F.datediff(F.lit(as_of), F.col("m.checked_on")) <= F.when(F.col("m.live"), MX_LIVE_DAYS).otherwise(MX_DEAD_DAYS)
    j = entities.join(latest, F.substring_index("email", "@", -1) == F.col("mx_domain"), "left")
    verdict = F.when(~F.coalesce(F.col("email").rlike(EMAIL), F.lit(False)), "malformed").when(fresh & F.col("m.live"), "live").when(fresh, "dead").otherwise("lookup")
    return j.withColumn("verdict", verdict).drop("m", "mx_domain")


def mx_verdict(answers: DataFrame) -> DataFrame:
    """Answers (domain, status, answer_type) to one verdict per domain."""
    a = answers.groupBy("domain").agg(
        F.max("status").alias("worst"), F.count_if((F.col("status") == 0) & (F.col("answer_type") == 15)).alias("mx"),
        F.count_if((F.col("status") == 0) & (F.col("answer_type") == 1)).alias("a"), F.count_if((F.col("status") == 0) & (F.col("answer_type") == 28)).alias("aaaa"),
    )
    v = F.when(F.col("worst") == 3, "nxdomain").when(F.col("worst") != 0, F.concat(F.lit("dns-status-"), F.col("worst"))).when(F.col("mx") > 0, F.concat(F.lit("mx:"), F.col("mx")))
    v = v.when(F.col("a") > 0, "implicit-mx:a").when(F.col("aaaa") > 0, "implicit-mx:aaaa").otherwise("no-mx-no-address")
    return a.select("domain", v.alias("detail"), ((F.col("worst") == 0) & (F.col("mx") + F.col("a") + F.col("aaaa") > 0)).alias("live"))


def judged_queue(candidates: DataFrame, suppressions: DataFrame, mx_cache: DataFrame, as_of: date) -> DataFrame:
    """Append ``drop_reason``, the first that applies; null: the entity may be queued."""
    j = deliverable(suppressed(candidates, suppressions), mx_cache, as_of)
    reason = F.when(F.col("suppressed"), "suppressed").when(F.col("email").isNull(), "no-email").when(F.col("verdict").isin("dead", "malformed"), "undeliverable")
    return j.withColumn("drop_reason", reason)


def build_queue(candidates: DataFrame, suppressions: DataFrame, mx_cache: DataFrame, as_of: date, most: int = QUEUE_MAX) -> DataFrame:
    """The first ``most`` candidates of each profile that no reason drops, ranked; limits come before the reasons."""
    w = Window.partitionBy("profile_id").orderBy("place")
    kept = judged_queue(candidates, suppressions, mx_cache, as_of).where("drop_reason is null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return kept.select("profile_id", "rank", "entity_id", "display_name", "score", (F.col("score") < QUALIFY_BAR).alias("below_bar"))


def queue_stats(candidates: DataFrame, suppressions: DataFrame, mx_cache: DataFrame, as_of: date) -> DataFrame:
    reason = F.coalesce("drop_reason", F.lit("kept")).alias("reason")
    return judged_queue(candidates, suppressions, mx_cache, as_of).groupBy("profile_id", reason).agg(F.count(F.lit(1)).alias("n"))


def rewrite_drafts(outreach: DataFrame, queue: DataFrame, day: date) -> DataFrame:
    """The day's drafts replaced by the queue's; other rows stay, and an entity with one that day gets no draft.

    Rows keep all columns of ``outreach``. A draft takes those that the queue has (rank, subject, body and so on), the day,
    and its status; others are null.
    """
    kept = outreach.where(~((F.col("day") == F.lit(day)) & (F.col("status") == "DRAFT")))
    there = kept.where(F.col("day") == F.lit(day)).select("entity_id")
    own = {"status": F.lit("DRAFT"), "day": F.lit(day), **{c: F.col(c) for c in queue.columns if c not in ("status", "day")}}
    none = F.lit(None)
    new = queue.join(there, "entity_id", "left_anti").select(*[own.get(f.name, none).cast(f.dataType).alias(f.name) for f in outreach.schema])
    return kept.unionByName(new)


def surfaced(entities: DataFrame, queue: DataFrame) -> DataFrame:
    """Entities after a queue was built: queued ones that wait for it are ready and were shown once more."""
    q = queue.select("entity_id").distinct().withColumn("_q", F.lit(True))
    j, hit = entities.join(q, "entity_id", "left"), F.col("_q") & F.col("state").isin("QUALIFIED", "SHORTLISTED", "NURTURE")
    return j.withColumns({"times_surfaced": F.when(hit, F.col("times_surfaced") + 1).otherwise(F.col("times_surfaced")), "state": F.when(hit, "OUTREACH_READY").otherwise(F.col("state"))}).drop("_q")


def bounced_outreach(outreach: DataFrame, bounces: DataFrame) -> DataFrame:
    """Rows with the last bounce (outreach_id, note, at) of each: its time and its cut note."""
    last = bounces.groupBy("outreach_id").agg(F.max(F.struct("at", "note")).alias("_b"))
    hit = F.col("_b").isNotNull()
    return outreach.join(last, "outreach_id", "left").withColumns({"status": F.when(hit, "BOUNCED").otherwise(F.col("status")), "bounced_at": F.col("_b.at"), "send_error": F.when(hit, F.substring(F.concat(F.lit("bounced: "), "_b.note"), 1, 300))}).drop("_b")


def bounce_suppressions(suppressions: DataFrame, bounces: DataFrame, outreach: DataFrame, entities: DataFrame) -> DataFrame:
    """The list (key, reason) with the dead addresses of bounced entities, which replace what stood there."""
    dead = bounces.join(outreach.select("outreach_id", "entity_id"), "outreach_id").join(entities.where("email is not null").select("entity_id", "email"), "entity_id")
    new = dead.groupBy(F.col("email").alias("key")).agg(F.max(F.struct("at", "note"))["note"].alias("note"))
    new = new.select("key", F.substring(F.concat(F.lit("bounced: "), "note"), 1, 200).alias("reason"))
    return suppressions.join(new, "key", "left_anti").select("key", "reason").unionByName(new)


def queue_view(outreach: DataFrame, entities: DataFrame, day: date) -> DataFrame:
    return outreach.where(F.col("day") == F.lit(day)).join(entities, "entity_id").select("outreach_id", "entity_id", "display_name", "location", "score", "status").orderBy("outreach_id")


def last_decision(events: DataFrame, by: str = "entity_id") -> DataFrame:
    return events.groupBy(by).agg(F.max(F.struct("created_at", "feedback_id", "decision", "reason")).alias("e")).select(by, "e.decision", "e.reason", "e.created_at")


def apply_decisions(events: DataFrame, entities: DataFrame) -> DataFrame:
    """States after each entity's last decision. Skips only move entities that were ready, and keep why; blocks end contact."""
    j = entities.join(last_decision(events.where(F.col("decision").isin("SENT", "SKIPPED", "BLOCKED"))), "entity_id", "left")
    d, sent = F.col("decision"), F.to_date("created_at")
    skipped = (d == "SKIPPED") & (F.col("state") == "OUTREACH_READY")
    state = F.when(d == "SENT", "CONTACTED").when(skipped, "NURTURE").when(d == "BLOCKED", "DO_NOT_CONTACT").otherwise(F.col("state"))
    contacted = F.when(d == "SENT", F.coalesce("contacted_on", sent)).otherwise(F.col("contacted_on"))
    return j.select("entity_id", state.alias("state"), contacted.alias("contacted_on"), F.when(d == "SENT", sent).otherwise(F.col("contacted_on")).alias("last_contacted_on"), F.when(skipped, F.substring("reason", 1, 200)).alias("skip_reason"))


def decided_outreach(outreach: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows after the last decision (outreach_id, decision, reason, created_at, feedback_id) on each: sent with its time, or skipped."""
    j = outreach.join(last_decision(decisions.where(F.col("decision").isin("SENT", "SKIPPED")), "outreach_id"), "outreach_id", "left")
    return j.withColumns({"status": F.coalesce("decision", "status"), "sent_at": F.when(F.col("decision") == "SENT", F.col("created_at"))}).drop("decision", "reason", "created_at")


def block_suppressions(events: DataFrame, entities: DataFrame, suppressions: DataFrame) -> DataFrame:
    """The list with the addresses of blocked entities added."""
    blocked = last_decision(events).where("decision = 'BLOCKED'").join(entities, "entity_id").where("email is not null")
    return suppressions.select("key").union(blocked.select("email")).distinct()


def apply_bounces(outreach: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities with a bounce lose their address and go back to nurture; contact times go unless another send stands."""
    o = outreach.groupBy("entity_id").agg(F.count_if(F.col("status") == "BOUNCED").alias("bounces"), F.count_if(F.col("status") == "SENT").alias("sends"))
    j = entities.join(o, "entity_id", "left")
    hit = F.coalesce("bounces", F.lit(0)) > 0
    return j.select("entity_id", F.when(~hit, F.col("email")).alias("email"), F.when(hit, "NURTURE").otherwise(F.col("state")).alias("state"), F.when(~(hit & (F.col("sends") == 0)), F.col("contacted_on")).alias("contacted_on"))


def revive(requests: DataFrame, outreach: DataFrame, day: date) -> DataFrame:
    """What becomes of requests (outreach_id) to bring skipped or bounced rows (outreach: profile_id, rank and others) back to ``day``.

    Sent rows and second rows of an entity are refused; the others get the ranks after the day's last one of their profile.
    """
    today = outreach.where(F.col("day") == F.lit(day))
    top = today.groupBy("profile_id").agg(F.max("rank").alias("top"))
    j = requests.join(outreach, "outreach_id").join(today.select(F.col("entity_id").alias("_e")).distinct(), F.col("entity_id") == F.col("_e"), "left")
    j = j.withColumn("refused", F.when(F.col("status") == "SENT", "already-sent").when(F.col("_e").isNotNull(), "already-queued"))
    turn = F.row_number().over(Window.partitionBy("refused", "entity_id").orderBy("outreach_id"))
    j = j.withColumn("refused", F.coalesce("refused", F.when(turn > 1, F.lit("already-queued"))))
    # refused rows have no rank, so they are spread by their entity
    fine = F.col("refused").isNull()
    place = F.row_number().over(Window.partitionBy(F.when(fine, F.col("profile_id")), F.when(~fine, F.col("entity_id"))).orderBy("outreach_id"))
    return j.withColumn("place", place).join(top, "profile_id", "left").select("outreach_id", "entity_id", "profile_id", "refused", F.when(fine, F.col("place") + F.coalesce("top", F.lit(0))).alias("rank"))


def revived_rows(outreach: DataFrame, outcome: DataFrame, day: date) -> DataFrame:
    """All rows, those that revive() accepts as drafts of the day."""
    new = outcome.where("refused is null").select("outreach_id", F.col("rank").alias("_rank"))
    j, hit = outreach.join(new, "outreach_id", "left"), F.col("_rank").isNotNull()
    return j.withColumns({"status": F.when(hit, "DRAFT").otherwise(F.col("status")), "day": F.when(hit, F.lit(day)).otherwise(F.col("day")), "rank": F.coalesce("_rank", "rank")}).drop("_rank")


def revived_entities(entities: DataFrame, outcome: DataFrame) -> DataFrame:
    """Entities of revived rows are ready again."""
    back = outcome.where("refused is null").select("entity_id").distinct().withColumn("_back", F.lit(True))
    ready = F.col("_back") & (F.col("state") == "NURTURE")
    return entities.join(back, "entity_id", "left").withColumn("state", F.when(ready, "OUTREACH_READY").otherwise(F.col("state"))).drop("_back")


def response_status(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Reviewer-set reply status (event column ``response``, null: cleared); later states are never touched."""
    j = entities.drop("response_status").join(events, "entity_id")
    s, r = F.col("state"), F.col("response")
    state = F.when((r == "REPLIED") & (s == "CONTACTED"), "REPLIED").when((r.isNull() | (r != "REPLIED")) & (s == "REPLIED"), "CONTACTED").otherwise(s)
    return j.select("entity_id", state.alias("state"), r.alias("response_status"))


def ghost_sweep(entities: DataFrame, last_contact: DataFrame, as_of: date, days: int = GHOST_DAYS) -> DataFrame:
    j = entities.join(last_contact, "entity_id", "left")
    gone = (F.col("state") == "CONTACTED") & F.col("response_status").isNull() & (F.col("last_contact") < F.date_sub(F.lit(as_of), days))
    return j.select("entity_id", F.when(gone, "GHOSTED").otherwise(F.col("response_status")).alias("response_status"))


def daily_cap(outreach: DataFrame, queued: DataFrame, day: date, cap: int) -> DataFrame:
    """Which queued rows still fit under the day's cap on sends, over all profiles together."""
    sent = outreach.where((F.col("day") == F.lit(day)) & (F.col("status") == "SENT")).agg(F.count(F.lit(1)).alias("sent"))
    # no more than cap rows can fit
    first = queued.orderBy("outreach_id").limit(cap).withColumn("turn", F.row_number().over(Window.orderBy("outreach_id")))
    return first.crossJoin(sent).where(F.col("turn") <= F.lit(cap) - F.col("sent")).select("outreach_id", "turn")


def budget_remaining(budget: DataFrame, limits: DataFrame, day: date) -> DataFrame:
    """limits: profile_id, metric, most. What is left of each on ``day``, never below 0."""
    used = budget.where(F.col("day") == F.lit(day)).groupBy("profile_id", "metric").agg(F.sum("units").alias("used"))
    return limits.join(used, ["profile_id", "metric"], "left").select("profile_id", "metric", F.greatest(F.lit(0), F.col("most") - F.coalesce("used", F.lit(0))).alias("remaining"))


def set_email(requests: DataFrame, suppressions: DataFrame, mx_cache: DataFrame, as_of: date) -> DataFrame:
    """Corrected addresses (request_id, email): the reason of a refusal, or null."""
    r = requests.withColumn("email", F.lower(F.trim("email"))).withColumn("domain", F.substring_index("email", "@", -1))
    j = deliverable(suppressed(r, suppressions), mx_cache, as_of)
    reason = F.when(F.col("verdict") == "malformed", "malformed").when(F.col("suppressed"), "suppressed").when(F.col("verdict") == "dead", "undeliverable")
    return j.select("request_id", "email", reason.alias("refused"))


