"""Features that follow arrivals, as Structured Streaming: notices, candidates, page changes, spend and silence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import linkage
from tessera.operators.graph import kept
from tessera.sources.stored import bucket_of, merge_buckets, read_buckets, write_buckets

ADDRESS = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"


def match_notices(notices: DataFrame, sent: DataFrame) -> DataFrame:
    """Notices (message_id, subject, summary, to_address, sender) with the sent row that their first known address names.

    sent: email, outreach_id, entity_id. Unmatched notices stay, without a row. One row per message.
    """
    text = F.concat_ws(" ", "subject", "summary", "to_address", "sender")
    a = notices.select("message_id", F.posexplode_outer(F.regexp_extract_all(text, F.lit(ADDRESS), 1)).alias("pos", "email"))
    hit = a.withColumn("email", F.lower("email")).join(sent, "email", "left")
    return hit.groupBy("message_id").agg(F.min(F.when(F.col("outreach_id").isNotNull(), F.struct("pos", "outreach_id", "entity_id"))).alias("m")).select("message_id", F.col("m.outreach_id").alias("outreach_id"), F.col("m.entity_id").alias("entity_id"))


def bounce_stream(notices: DataFrame, sent: Callable[[], DataFrame], path: str, delay: str = "7 days"):
    """Write matched notices to ``path``, a folder for each batch: a batch that runs again replaces its own.

    A message that comes again within ``delay`` is known by state; nothing that was written is read again.
    """
    once = notices.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["message_id"])

    def batch(df: DataFrame, number: int) -> None:
        match_notices(df.dropDuplicates(["message_id"]), sent()).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return once.writeStream.foreachBatch(batch)


#: What the candidate stream keeps of each candidate. links: its keys, weak ones under their profile.
SEEN = "cand_id long, profile_id string, first_seen timestamp, domain string, instagram string, tiktok string, etsy string, keys array<struct<tier:string,key:string>>, links array<string>, batch long"
OWNED = "cand_id long, entity_id long, foreign boolean, batch long"


def with_links(candidates: DataFrame, keys: DataFrame) -> DataFrame:
    """Candidates (cand_id, profile_id, the identifiers and maybe first_seen) in the form of SEEN, one row for each id."""
    own = keys.groupBy("cand_id").agg(F.collect_set(F.struct("tier", "key")).alias("keys"))
    seen = F.col("first_seen").cast("timestamp") if "first_seen" in candidates.columns else F.lit(None).cast("timestamp")
    profile = F.coalesce(F.col("profile_id").cast("string"), F.lit(""))
    c = candidates.select("cand_id", profile.alias("profile_id"), seen.alias("first_seen"), *linkage.IDENTITY).dropDuplicates(["cand_id"]).join(own, "cand_id", "left")
    c = c.withColumn("keys", F.coalesce("keys", F.array().cast("array<struct<tier:string,key:string>>")))
    return c.withColumn("links", F.transform("keys", lambda k: F.when(k["tier"] == "strong", k["key"]).otherwise(F.concat_ws("|", "profile_id", k["key"]))))


def reached(new: DataFrame, old: DataFrame) -> DataFrame:
    """``new`` and the rows of ``old`` that it meets by links, through each other too."""
    rows, links = new, kept(new.select(F.explode("links").alias("link")).distinct(), "links")
    out, seen = new, links
    while True:
        hit = old.select("cand_id", F.explode("links").alias("link")).join(links, "link").select("cand_id").distinct()
        rows = kept(old.join(hit, "cand_id", "left_semi").join(out.select("cand_id"), "cand_id", "left_anti"), "rows")
        if rows.isEmpty():
            return out
        out = kept(out.unionByName(rows), "reached")
        links = kept(rows.select(F.explode("links").alias("link")).distinct().join(seen, "link", "left_anti"), "links")
        seen = kept(seen.unionByName(links), "seen")


def resolve_batch(new: DataFrame, old: DataFrame, owned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a batch changes: (cand_id, entity_id, foreign) of new candidates and of old ones whose entity is another now,
    and (entity_id, winner) of entities that are no more.

    Strong groups and refused weak links may change with each arrival, so all that the batch reaches is resolved again, by
    the rule of resolve_entities: what stands in the end is the same in whatever batches candidates came.
    """
    rows = reached(new, old)
    keys = rows.select("cand_id", F.explode("keys").alias("k")).select("cand_id", "k.tier", "k.key")
    now = linkage.resolve_entities(rows, keys).withColumnRenamed("component", "entity_id")
    before = latest(owned.join(rows.select("cand_id"), "cand_id", "left_semi")).select("cand_id", F.col("entity_id").alias("was"), F.col("foreign").alias("was_foreign"))
    both = kept(now.join(before, "cand_id", "left").where(~(F.col("entity_id").eqNullSafe(F.col("was")) & F.col("foreign").eqNullSafe(F.col("was_foreign")))), "changed")
    return both.select("cand_id", "entity_id", "foreign"), both.where("was = cand_id and entity_id <> was").select(F.col("was").alias("entity_id"), F.col("entity_id").alias("winner"))


def latest(owned: DataFrame) -> DataFrame:
    """The last entity of each candidate."""
    return owned.groupBy("cand_id").agg(F.max_by(F.struct("entity_id", "foreign"), "batch").alias("o")).select("cand_id", "o.entity_id", "o.foreign")


def candidate_stream(candidates: DataFrame, keys_of: Callable[[DataFrame], DataFrame], path: str):
    """Resolve candidates (cand_id, profile_id, identifiers, and what ``keys_of`` needs) as they arrive.

    Folders below ``path``, each with one folder for a batch, which it replaces if it runs again: ``seen`` (SEEN),
    ``owned`` (OWNED, only what changed), ``moved`` (entity_id, winner). A cand_id that was seen before is left out.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        earlier = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}").where(F.col("batch") < number)
        old, owned = earlier("seen", SEEN).drop("batch"), earlier("owned", OWNED)
        # a batch may be one file, and keys take long to make
        df = kept(df.repartition("cand_id"), "arrived")
        new = kept(with_links(df, keys_of(df)).join(old.select("cand_id"), "cand_id", "left_anti"), "new")
        changed, moved = resolve_batch(new, old, owned)
        for name, rows in (("seen", new), ("owned", changed), ("moved", moved)):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    spark = candidates.sparkSession
    for name, schema in (("seen", SEEN), ("owned", OWNED)):
        columns = [c for c in spark.createDataFrame([], schema).columns if c != "batch"]
        spark.createDataFrame([], schema).select(*columns).write.mode("ignore").parquet(f"{path}/{name}/batch=-1")
    return candidates.writeStream.foreachBatch(batch)


def candidate_owners(spark: SparkSession, path: str) -> DataFrame:
    """(cand_id, entity_id, foreign) as a candidate stream has left them."""
    return latest(spark.read.schema(OWNED).parquet(f"{path}/owned"))


LAST_SEEN = "url string, content_hash string, fetched_at timestamp, batch long, old_hash string, old_at timestamp"


def changes_of(new: DataFrame, last: DataFrame, number: int, days: int) -> tuple[DataFrame, DataFrame]:
    """Pages of a batch (url, content_hash, fetched_at) whose content differs from the one before, and the last seen after it.

    ``last`` (LAST_SEEN) also holds what a URL had before the batch that wrote its row, so a batch that runs again sees what it
    saw at first. A URL that was not seen for ``days`` before a page is unknown.
    """
    again = F.col("batch") == number
    before = last.select("url", F.when(again, F.col("old_hash")).otherwise(F.col("content_hash")).alias("before_hash"), F.when(again, F.col("old_at")).otherwise(F.col("fetched_at")).alias("before_at"))
    w = Window.partitionBy("url").orderBy("fetched_at", "content_hash")
    rows = new.join(before, "url", "left").withColumns({"n": F.row_number().over(w), "p_hash": F.lag("content_hash").over(w), "p_at": F.lag("fetched_at").over(w)})
    known = F.when(F.col("n") == 1, F.struct(F.col("before_hash").alias("hash"), F.col("before_at").alias("at"))).otherwise(F.struct(F.col("p_hash").alias("hash"), F.col("p_at").alias("at")))
    kept_on = known["at"] >= F.col("fetched_at") - F.make_dt_interval(days=F.lit(days))
    changed = rows.where(~(F.coalesce(kept_on, F.lit(False)) & F.col("content_hash").eqNullSafe(known["hash"]))).select("url", "content_hash", "fetched_at")
    top = new.groupBy("url").agg(F.max(F.struct("fetched_at", "content_hash")).alias("t")).select("url", F.col("t.content_hash").alias("content_hash"), F.col("t.fetched_at").alias("fetched_at"))
    now = top.join(before, "url", "left").select("url", "content_hash", "fetched_at", F.lit(number).cast("long").alias("batch"), F.col("before_hash").alias("old_hash"), F.col("before_at").alias("old_at"))
    return changed, now


def change_stream(pages: DataFrame, out: str, state: str, days: int = 400, buckets: int = 64):
    """Write pages (url, content_hash, fetched_at) whose content differs from the last seen of their URL to ``out``, a folder for each batch.

    The last seen hashes are a table in buckets of URLs, of which a batch reads and writes those that it touches. There a
    URL that was not seen for ``days`` is dropped, so the state holds what is still read.
    """
    spark = pages.sparkSession
    if not state_there(spark, state):
        write_buckets(spark.createDataFrame([(None,) * 6], LAST_SEEN), state, ["url"], buckets)

    def batch(df: DataFrame, number: int) -> None:
        new = kept(df.select("url", "content_hash", "fetched_at").where("url is not null"), "pages")
        if new.isEmpty():
            new.write.mode("overwrite").parquet(f"{out}/batch={number}")
            return
        touched = [r[0] for r in new.select(bucket_of(["url"], buckets).alias("b")).distinct().collect()]
        last = read_buckets(spark, state, f"{LAST_SEEN}, bucket int").where(F.col("bucket").isin(touched)).drop("bucket")
        changed, now = changes_of(new, last, number, days)
        changed.write.mode("overwrite").parquet(f"{out}/batch={number}")
        oldest = new.agg(F.max("fetched_at")).first()[0]

        def merged(target: DataFrame, rows: DataFrame) -> DataFrame:
            left = target.where((F.col("fetched_at") >= F.lit(oldest) - F.make_dt_interval(days=F.lit(days))) | F.col("url").isNull())
            return left.join(rows.select("url"), "url", "left_anti").select(*rows.columns).unionByName(rows)

        merge_buckets(state, kept(now, "last_seen"), ["url"], merged, buckets)

    return pages.writeStream.foreachBatch(batch)


def state_there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def spend_stream(units: DataFrame, delay: str = "2 days") -> DataFrame:
    """Units (profile_id, metric, units, at) per profile, metric and day; late rows count until the watermark passes the day."""
    w = units.withWatermark("at", delay).groupBy(F.window("at", "1 day").alias("w"), "profile_id", "metric").agg(F.sum("units").alias("units"))
    return w.select("profile_id", "metric", F.to_date("w.start").alias("day"), "units")


def ghost_timer(events: DataFrame, days: int = 30, delay: str = "1 hour") -> DataFrame:
    """Entities (entity_id, kind: contact or reply, at) that stay silent for ``days`` after a contact, once the watermark is past it.

    A session of an entity ends ``days`` after its last event, and a reply is no silence. So an entity that is contacted
    again after that time was silent before, in whatever batches its events came.
    """
    e = events.select("entity_id", F.struct("at", "kind").alias("said"), F.timestamp_millis(F.unix_millis("at")).alias("at")).withWatermark("at", delay)
    # hours, since days follow the session's time zone
    last = e.groupBy("entity_id", F.session_window("at", f"{24 * days} hours").alias("w")).agg(F.max("said").alias("said"))
    return last.where("said.kind = 'contact'").select("entity_id", F.col("w.end").alias("ghosted_at"))


def ghosts_in_batch(events: DataFrame, days: int, now) -> DataFrame:
    """What ghost_timer gives once time has passed ``now``: the last event is a contact, and it is long ago."""
    last = events.groupBy("entity_id").agg(F.max(F.struct("at", "kind")).alias("e"))
    due = F.col("e.at") + F.make_dt_interval(days=F.lit(days))
    return last.where((F.col("e.kind") == "contact") & (due <= now)).select("entity_id", due.alias("ghosted_at"))


def run_available(query, checkpoint: str, spark: SparkSession) -> None:
    """Run a stream over what is there, then stop."""
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
