"""Vocabulary mining, categories, lessons, corrections and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.graph import kept
from tessera.operators.patterns import held
from tessera.sources.stored import merge_buckets, remove

# Fixed values.
STOPWORDS = "the and for you our with your from that this all are was were has have will can not but they she her his out now new get see how why who what when where about more most some any each other than then them ours shop store home page cart checkout menu search sign login account order orders shipping returns policy privacy terms contact email address phone hours open closed sale off free products product collection collections view add price prices usd size sizes color colors black white blue green small large one two three click here read".split()


def mine_corpus(texts: DataFrame, most: int = 40, least_texts: int = 5, least: int = 3, rate: float = 0.05, lift: float = 2.5) -> DataFrame:
    """Terms far more frequent in good texts (text, good) than in bad ones, by the number of texts that hold them."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,18})"), 1))
    n = texts.agg(F.count_if(F.col("good")).alias("n_good"), F.greatest(F.lit(1), F.count_if(~F.col("good"))).alias("n_bad"))
    t = texts.select("good", F.explode(words).alias("keyword")).where(~F.col("keyword").isin(STOPWORDS)).groupBy("keyword").agg(F.count_if(F.col("good")).alias("g"), F.count_if(~F.col("good")).alias("b"))
    good = F.col("g") / F.col("n_good")
    t = t.where(F.col("g") >= least).crossJoin(n).where(F.col("n_good") >= least_texts).withColumns({"rate": good, "lift": good / (F.col("b") / F.col("n_bad") + 0.01)})
    return t.where((F.col("rate") >= rate) & (F.col("lift") >= lift)).orderBy(F.desc("lift"), "keyword").limit(most).select("keyword", "g", "b", "rate", "lift")


def validate_keywords(keywords: DataFrame, yields: DataFrame) -> DataFrame:
    """Status by yield (keyword, certs, kept): none kept is DEAD, some ACTIVE; keywords that were not looked up stay."""
    j = keywords.join(yields, "keyword", "left")
    status = F.when(F.col("kept").isNull(), F.col("status")).when(F.col("kept") == 0, "DEAD").otherwise("ACTIVE")
    return j.select("keyword", status.alias("status"), F.col("certs").alias("certs_seen"), F.col("kept").alias("domains_kept"))


def demote_keywords(keywords: DataFrame, runs: int = 6) -> DataFrame:
    dead = (F.col("status") == "ACTIVE") & (F.col("runs") >= runs) & (F.col("leads_found") == 0)
    return keywords.withColumn("status", F.when(dead, "DEAD").otherwise(F.col("status")))


def active_keywords(keywords: DataFrame, most: int) -> DataFrame:
    return keywords.where("status = 'ACTIVE'").orderBy(F.col("last_run").asc_nulls_first(), F.desc("domains_kept"), "keyword").limit(most).select("keyword", "last_run", "domains_kept")


def keyword_list(keywords: DataFrame, most: int = 400) -> DataFrame:
    first = F.when(F.col("status") == "ACTIVE", 0).otherwise(1)
    return keywords.orderBy(first, F.desc("leads_found"), F.desc("domains_kept"), "keyword").limit(most).select("keyword", "status", "leads_found")


def source_backoff(attempts: DataFrame, fails: int, minutes: int) -> DataFrame:
    """Sources (source, at, id, ok) parked after ``fails`` failures in a row: islands between successes."""
    w = Window.partitionBy("source").orderBy("at", "id")
    a = attempts.withColumn("island", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(w))
    runs = a.where(~F.col("ok")).groupBy("source", "island").agg(F.count(F.lit(1)).alias("fails"), F.max("at").alias("last"))
    return runs.where(F.col("fails") >= fails).groupBy("source").agg(F.max("fails").alias("fails"), (F.max("last") + F.make_dt_interval(mins=F.lit(minutes))).alias("parked_until"))


def classify_skips(feedback: DataFrame, categories: DataFrame, version: int, most: int = 30) -> DataFrame:
    """The newest pending reasons (feedback_id, reason, version, created_at) with the first category whose keyword they hold; all are stamped."""
    pending = feedback.where(F.col("version").isNull() | (F.col("version") < version)).orderBy(F.desc("created_at"), F.desc("feedback_id")).limit(most)
    words = categories.select("category_id", "position", F.explode("keywords").alias("word")).where("word <> ''").withColumn("word", F.lower("word"))
    hit = held(pending.select("feedback_id", F.lower("reason").alias("reason")), words, "feedback_id", "reason", "word").withColumnRenamed("id", "feedback_id").join(words, F.col("pattern") == F.col("word"))
    first = hit.groupBy("feedback_id").agg(F.min(F.struct("position", "category_id"))["category_id"].alias("category_id"))
    return pending.select("feedback_id").join(first, "feedback_id", "left").withColumn("version", F.lit(version))


def restamp(feedback: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows of deleted categories lose them and their stamp, so that they are sorted anew."""
    ids = categories.select(F.col("category_id").alias("_c")).distinct()
    j = feedback.join(ids, F.col("category_id") == F.col("_c"), "left")
    gone = F.col("category_id").isNotNull() & F.col("_c").isNull()
    return j.select("feedback_id", F.when(~gone, F.col("category_id")).alias("category_id"), F.when(~gone, F.col("version")).alias("version"))


def lesson_pending(feedback: DataFrame, entities: DataFrame, most: int = 25, least: int = 3) -> DataFrame:
    """Unapplied feedback with a reason, oldest first; nothing if there is too little."""
    p = feedback.where((F.length("reason") > 3) & ~F.col("decision").isin("BOUNCED", "CORRECTED") & ~F.col("applied")).join(entities.select("entity_id", "display_name"), "entity_id")
    b = p.orderBy("created_at", "feedback_id").limit(most)
    return b.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy())).where(F.col("n") >= least).select("feedback_id", "entity_id", "display_name", "reason")


def mark_applied(feedback: DataFrame, learned: DataFrame) -> DataFrame:
    """Feedback with the rows that lessons were drawn from (feedback_id) marked."""
    done = learned.select("feedback_id").distinct().withColumn("_done", F.lit(True))
    return feedback.join(done, "feedback_id", "left").withColumn("applied", F.coalesce("_done", "applied")).drop("_done")


def lesson_key(c: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), 1, 40)


def upsert_lessons(lessons: DataFrame, proposed: DataFrame) -> DataFrame:
    """Lessons (lesson, kind, weight, source_count) with proposals (lesson, kind, sources) counted in: those that begin alike are one, and gain weight and sources."""
    both = lessons.select("lesson", "kind", "weight", "source_count", F.lit(0).alias("new")).unionByName(proposed.select("lesson", "kind", F.lit(1).cast("long").alias("weight"), F.col("sources").alias("source_count"), F.lit(1).alias("new")))
    g = both.groupBy(lesson_key(F.col("lesson")).alias("key"), "kind").agg(F.min(F.struct("new", "lesson"))["lesson"].alias("lesson"), F.sum("weight").alias("weight"), F.sum("source_count").alias("source_count"))
    return g.select("lesson", "kind", "weight", "source_count")


def active_lessons(lessons: DataFrame, most: int = 12) -> DataFrame:
    """The weightiest lessons of each niche; those without one count for every niche."""
    w = Window.partitionBy("niche").orderBy(F.desc("weight"), F.desc("updated"), "lesson_id")
    live = lessons.where("active")
    # no niche can show more of the common ones than ``most``
    common = live.where("niche is null").orderBy(F.desc("weight"), F.desc("updated"), "lesson_id").limit(most).drop("niche")
    niches = live.where("niche is not null").select("niche").distinct()
    every = live.where("niche is not null").unionByName(niches.join(F.broadcast(common), F.lit(True)))
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("niche", "rank", "lesson_id", "weight")


def rerank_clamp(entities: DataFrame, revised: DataFrame, low: int = 15, high: int = 100) -> DataFrame:
    j = entities.join(revised, "entity_id")
    return j.select("entity_id", F.least(F.lit(high), F.greatest(F.lit(low), F.col("revised"))).alias("score"), "why")


def apply_corrections(proposals: DataFrame, niches: list[str], suppressions: DataFrame, dead: DataFrame) -> DataFrame:
    """Proposed fixes (proposal_id, field, value, note): accepted ones, and why others are refused. ``dead``: mail domains (mx_domain) without a server."""
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]{4,})"), 1)
    s = suppressions.select(F.col("key").alias("_k")).distinct()
    d = dead.select(F.col("mx_domain").alias("_d")).distinct()
    j = proposals.join(s, F.col("value") == F.col("_k"), "left").join(d, F.substring_index("value", "@", -1) == F.col("_d"), "left")
    f, v = F.col("field"), F.col("value")
    refused = F.when(f == "opinion", "opinion").when((f == "name") & ~F.arrays_overlap(tokens(v), tokens(F.col("note"))), "name-not-in-note").when((f == "niche") & ~v.isin(niches), "unknown-niche")
    refused = refused.when((f == "email") & ~v.rlike(r"^[^\s@]+@[^\s@]+\.[a-z]{2,}$"), "bad-email").when((f == "email") & F.col("_k").isNotNull(), "suppressed").when((f == "email") & F.col("_d").isNotNull(), "undeliverable")
    return j.select("proposal_id", "field", refused.alias("refused"), (refused.isNull() & f.isin("name", "niche")).alias("reevaluate"))


def corrected(entities: DataFrame, accepted: DataFrame) -> DataFrame:
    """Entities with the last accepted fix (entity_id, proposal_id, field, value) of each field; a new name or niche has them judged again."""
    of = lambda k: F.max(F.when(F.col("field") == k, F.struct("proposal_id", "value")))["value"].alias(f"_{k}")
    j = entities.join(accepted.groupBy("entity_id").agg(*map(of, ("name", "niche", "email"))), "entity_id", "left")
    again = F.col("_name").isNotNull() | F.col("_niche").isNotNull()
    new = {"display_name": F.coalesce("_name", "display_name"), "niche": F.coalesce("_niche", "niche"), "email": F.coalesce("_email", "email"), "evaluated_on": F.when(~again, F.col("evaluated_on"))}
    return j.withColumns(new).drop("_name", "_niche", "_email")


def rename_in_history(outreach: DataFrame, renames: DataFrame) -> DataFrame:
    """Subjects and bodies (entity_id, subject, body) with an entity's old name replaced."""
    j, named = outreach.join(renames, "entity_id", "left"), F.col("old").isNotNull() & (F.col("old") != "")
    return j.withColumns({c: F.when(named, F.replace(c, F.col("old"), F.col("new"))).otherwise(F.col(c)) for c in ("subject", "body")}).drop("old", "new")


def record_feedback(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Decisions with the score and niche that the entity had."""
    return events.join(entities.select("entity_id", F.col("score").alias("score_at_time"), F.col("niche").alias("niche_at_time")), "entity_id", "left").select("feedback_id", "entity_id", "decision", "score_at_time", "niche_at_time")


def upsert_categories(edits: DataFrame, categories: DataFrame) -> DataFrame:
    """Edited categories (profile_id, name, keywords, order): cleaned; new slugs go behind the last position, and clashes within a batch are refused."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim("name")), "[^a-z0-9]+", "-"), "^-|-$", "")
    words = F.filter(F.transform(F.split("keywords", ","), lambda k: F.substring(F.lower(F.trim(k)), 1, 40)), lambda k: k != "")
    e = edits.withColumns({"slug": slug, "words": words})
    top = categories.groupBy("profile_id").agg(F.max("position").alias("top"))
    old = categories.select("profile_id", "slug", F.col("position").alias("old"))
    turn = F.row_number().over(Window.partitionBy("profile_id", "slug").orderBy("order"))
    j = e.withColumn("turn", turn).join(old, ["profile_id", "slug"], "left").join(top, "profile_id", "left")
    refused = F.when(F.length(F.trim("name")) < 2, "short-name").when(F.col("turn") > 1, "slug-clash")
    fresh = F.when(refused.isNull() & F.col("old").isNull(), F.lit(1)).otherwise(0)
    rank = F.sum(fresh).over(Window.partitionBy("profile_id").orderBy("order"))
    return j.select("profile_id", "order", "slug", refused.alias("refused"), F.when(refused.isNull(), F.coalesce("old", F.coalesce("top", F.lit(0)) + rank)).cast("long").alias("position"), F.size("words").alias("words"))


def raised_versions(profiles: DataFrame, outcome: DataFrame) -> DataFrame:
    """Profiles (profile_id, version) whose categories changed get the next version, so that reasons are sorted anew."""
    hit = outcome.where("refused is null").select("profile_id").distinct().withColumn("_hit", F.lit(1))
    return profiles.join(hit, "profile_id", "left").withColumn("version", F.col("version") + F.coalesce("_hit", F.lit(0))).drop("_hit")


def starter_categories(profiles: DataFrame, categories: DataFrame, starters: list[str]) -> DataFrame:
    """Categories with ``starters`` (names) for each profile that has none."""
    slug = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    none = profiles.select("profile_id").distinct().join(categories.select("profile_id"), "profile_id", "left_anti")
    new = none.select("profile_id", F.posexplode(F.array(*map(F.lit, starters))).alias("position", "name"))
    return categories.select("profile_id", "slug", "position").unionByName(new.select("profile_id", slug(F.col("name")).alias("slug"), F.col("position").cast("long")))


def profile_footprint(tables: dict[str, DataFrame], profile: int) -> DataFrame:
    """Rows of a profile in each table, as one row."""
    out = None
    for name, t in tables.items():
        one = t.where(F.col("profile_id") == profile).agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def purge_profile(rows: DataFrame, entities: DataFrame, profile: int) -> DataFrame:
    """Rows (entity_id) without those of a profile's entities."""
    return rows.join(entities.where(F.col("profile_id") == profile).select("entity_id"), "entity_id", "left_anti")


def released_keys(keys: DataFrame, entities: DataFrame, profile: int) -> DataFrame:
    """Identity keys (key, entity_id) without those of a profile's entities, so that other profiles may take them."""
    return purge_profile(keys, entities, profile)


#: Tables that a profile's deletion empties: those of its entities' children by entity, then those by profile, and in this order.
CHILDREN = ["entity_keys", "snapshots", "evaluations"]
SCOPED = ["feedback", "outreach", "entities", "crawl_frontier", "keywords", "source_cursor", "budget", "lessons", "runs", "skip_categories", "regions"]


def delete_profile(spark: SparkSession, root: str, profile: int, name: str, buckets: int) -> tuple[str | None, dict[str, int]]:
    """Delete a profile from the tables below ``root``: (why not, rows that it had in each table).

    CHILDREN lie in buckets of entity_id (sources.stored), of which only those with the profile's entities are written
    again; SCOPED and ``profiles`` lie in folders by profile, one of which goes. Nothing is deleted if the name is not the
    profile's, or it is the only one. Each step may run again, and the profile itself goes last, so a deletion that breaks off
    is done again from the start. Identity keys go with their entities, so other profiles may take them. Where no
    active default is left, heir() says who follows.
    """
    at = lambda t: spark.read.parquet(f"{root}/{t}")
    profiles = at("profiles")
    mine = profiles.where(F.col("profile_id") == profile).select("name").first()
    if mine is None or mine["name"] != name.strip():
        return "no such profile" if mine is None else "the name differs", {}
    if profiles.where(F.col("profile_id") != profile).isEmpty():
        return "the only profile", {}
    own = kept(at("entities").where(F.col("profile_id") == profile).select("entity_id"), "purged")
    had = {t: at(t).join(own, "entity_id", "left_semi").count() for t in CHILDREN}
    had |= {t: at(t).where(F.col("profile_id") == profile).count() for t in SCOPED}
    for t in CHILDREN:
        merge_buckets(f"{root}/{t}", own, ["entity_id"], lambda rows, ids: rows.join(ids, "entity_id", "left_anti"), buckets)
    for t in [*SCOPED, "profiles"]:
        remove(spark, f"{root}/{t}/profile_id={profile}")
    return None, had


def heir(profiles: DataFrame, gone: int) -> DataFrame:
    """The profile that takes over when ``gone`` is deleted: the first other active one, the default first; none is an empty table."""
    return profiles.where(F.col("active") & (F.col("profile_id") != gone)).orderBy(F.desc("is_default"), "profile_id").limit(1).select("profile_id", "slug")


def resolve_profile(profiles: DataFrame, slug: str) -> DataFrame:
    """The active profile of a slug, else the default, else the first."""
    return profiles.where("active").orderBy(F.when(F.col("slug") == slug, 0).when(F.col("is_default"), 1).otherwise(2), "profile_id").limit(1).select("profile_id", "slug")


def profile_config_check(proposals: DataFrame) -> DataFrame:
    """Generated categories (slug, keywords, tags, seeds): cleaned, with the problems that stand against them. A tag or a seed term is enough."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("slug"), "[^a-z0-9]+", "_"), "^_|_$", "")
    words = F.slice(F.array_distinct(F.filter(F.transform("keywords", lambda k: F.lower(F.trim(k))), lambda k: F.length(k) > 2)), 1, 60)
    tags = F.slice(F.array_distinct(F.filter("tags", lambda t: t.rlike("^[a-z_]+$"))), 1, 24)
    seeds = F.array_distinct(F.filter(F.transform("seeds", lambda t: F.lower(F.trim(t))), lambda t: F.length(t) > 2))
    p = proposals.withColumns({"slug": slug, "keywords": words, "tags": tags, "seeds": seeds})
    return p.withColumn("problem", F.when(F.col("slug") == "", "no-slug").when(F.size("keywords") < 5, "few-keywords").when((F.size("tags") == 0) & (F.size("seeds") == 0), "no-tags")).select("slug", F.size("keywords").alias("keywords"), F.size("tags").alias("tags"), F.size("seeds").alias("seeds"), "problem")


def isolation_check(tables: dict[str, DataFrame], entities: DataFrame) -> DataFrame:
    """Rows (id, entity_id, profile_id) whose profile is not their entity's."""
    owner = entities.select("entity_id", F.col("profile_id").alias("owner"))
    out = None
    for name, t in tables.items():
        bad = t.join(owner, "entity_id").where(F.col("profile_id") != F.col("owner")).select(F.lit(name).alias("table"), "id", "entity_id")
        out = bad if out is None else out.unionByName(bad)
    return out
