"""Batch twins of the streaming features, and the streams themselves run over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import linkage
from tessera.operators.graph import kept
from tessera.streaming import arrivals as ar

from .links import all_candidates, spread
from .registry import register
from .standins import BUDGET, budget, folder, table


def notices(spark, sf):
    """Conversation turns as notices; every fifth names a sent row's address."""
    c = table(spark, sf, "conversations")
    k = F.col("conv_id") * 7 + F.col("turn")
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.lit("Undelivered").alias("subject"), F.when(k % 5 == 0, F.concat(F.lit("to nobody@else.org and C"), k % 1500, F.lit("@shop.com"))).otherwise(F.substring("text", 1, 40)).alias("summary"),
        F.lit("me@here.org").alias("to_address"), F.lit("daemon").alias("sender"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(k % 600).cast("int"))).alias("received_at"),
    )


def sent_rows(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.min("o_orderkey").alias("outreach_id"))
    return o.select(F.concat(F.lit("c"), "entity_id", F.lit("@shop.com")).alias("email"), "outreach_id", "entity_id")


_NOTICE = """WITH k AS (SELECT conv_id || '-' || turn AS message_id, (conv_id * 7 + turn) AS k FROM conversations), s AS (SELECT o_custkey AS entity_id, min(o_orderkey) AS outreach_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
  SELECT DISTINCT message_id, outreach_id, entity_id FROM k LEFT JOIN s ON k % 5 = 0 AND entity_id = k % 1500"""


@register("w01_bounce_batch", _NOTICE)
def w01(spark, sf):
    return ar.match_notices(notices(spark, sf).dropDuplicates(["message_id"]), sent_rows(spark, sf))


def staged(df, name: str, files: int = 1000):
    """``df`` as files that a stream can read, at most so many at a time."""
    d = kept(df, name)
    path = d.inputFiles()[0].rpartition("/")[0]
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def stateful(spark) -> None:
    """State on disk: there is a row for each entity, more than a heap should hold."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@register("w01_bounce_stream", _NOTICE)
def w01_stream(spark, sf):
    path = folder(spark, "bounces")
    n = notices(spark, sf)
    ar.run_available(ar.bounce_stream(staged(n.unionByName(n), "notices"), lambda: sent_rows(spark, sf), path), folder(spark, "state"), spark)
    return spark.read.parquet(path).drop("batch")


# no SQL: the same as b10_resolve_entities, in three batches
@register("w02_candidate_stream")
def w02(spark, sf):
    path = folder(spark, "candidates")
    c = spread(all_candidates(spark, sf)).withColumn("profile_id", F.col("profile_id").cast("string"))
    keys_of = lambda d: linkage.identity_keys(d.drop("domain"))
    ar.run_available(ar.candidate_stream(staged(c.repartition(3, "cand_id"), "candidates", 1), keys_of, path), folder(spark, "state"), spark)
    return ar.candidate_owners(spark, path)


@register("w04_spend_batch", f"WITH {BUDGET} SELECT profile_id, metric, day, CAST(sum(units) AS BIGINT) AS units FROM budg GROUP BY ALL")
def w04(spark, sf):
    return budget(spark, sf).groupBy("profile_id", "metric", "day").agg(F.sum("units").alias("units"))


@register("w04_spend_stream", f"WITH {BUDGET} SELECT profile_id, metric, day, CAST(sum(units) AS BIGINT) AS units FROM budg WHERE day < (SELECT max(day) FROM budg) - 2 GROUP BY ALL")
def w04_stream(spark, sf):
    b = budget(spark, sf).select("profile_id", "metric", "units", F.col("day").cast("timestamp").alias("at"))
    path = folder(spark, "spend")
    out = ar.spend_stream(staged(b, "units"))
    ar.run_available(out.writeStream.outputMode("append").format("parquet").option("path", path), folder(spark, "state"), spark)
    return spark.read.schema(out.schema).parquet(path)


# a user's events of one day of the month are an entity, so that most are silent long before the last event
_CONTACT = "e AS (SELECT user_id * 100 + day(ts) AS entity_id, ts AS seen, CASE WHEN event_type = 'purchase' THEN 'reply' ELSE 'contact' END AS kind FROM events)"


def contacts(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "reply").otherwise("contact")
    return table(spark, sf, "events").select((F.col("user_id").cast("long") * 100 + F.dayofmonth("ts")).alias("entity_id"), F.col("ts").alias("at"), kind.alias("kind"))


@register("w05_ghosts_batch", f"WITH {_CONTACT}, l AS (SELECT entity_id, max(seen) AS seen, arg_max(kind, (seen, kind)) AS kind FROM e GROUP BY 1) SELECT entity_id, seen + INTERVAL 2 DAY AS ghosted_at FROM l WHERE kind = 'contact' AND seen + INTERVAL 2 DAY <= TIMESTAMP '2024-02-02 00:00:00'")
def w05(spark, sf):
    return ar.ghosts_in_batch(contacts(spark, sf), 2, F.lit("2024-02-02 00:00:00").cast("timestamp_ntz"))


# events as fetches of pages whose content is the kind of event
@register("w03_change_stream", "SELECT url, content_hash, fetched_at FROM (SELECT 'u' || user_id AS url, event_type AS content_hash, ts AS fetched_at, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS before FROM events) WHERE content_hash IS DISTINCT FROM before")
def w03_stream(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("url"), F.col("event_type").alias("content_hash"), F.col("ts").cast("timestamp").alias("fetched_at"))
    path = folder(spark, "changes")
    ar.run_available(ar.change_stream(staged(e, "fetches"), path, folder(spark, "last_seen"), buckets=8), folder(spark, "state"), spark)
    return spark.read.parquet(path).select("url", "content_hash", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"))


# the watermark ends an hour before the last event
@register("w05_ghost_stream", f"WITH {_CONTACT}, l AS (SELECT entity_id, max(seen) AS seen, arg_max(kind, (seen, kind)) AS kind FROM e GROUP BY 1) SELECT entity_id, date_trunc('millisecond', seen) + INTERVAL 2 DAY AS ghosted_at FROM l WHERE kind = 'contact' AND date_trunc('millisecond', seen) + INTERVAL 2 DAY <= (SELECT max(seen) FROM e) - INTERVAL 1 HOUR")
def w05_stream(spark, sf):
    stateful(spark)
    e = contacts(spark, sf).withColumn("at", F.col("at").cast("timestamp"))
    path = folder(spark, "ghosts")
    out = ar.ghost_timer(staged(e, "contacts"), 2)
    ar.run_available(out.writeStream.outputMode("append").format("parquet").option("path", path), folder(spark, "state"), spark)
    # those that are still silent
    last = e.groupBy("entity_id").agg(F.max("at").alias("last"))
    ghosts = spark.read.schema(out.schema).parquet(path).join(last, "entity_id").where("last < ghosted_at")
    return ghosts.select("entity_id", F.col("ghosted_at").cast("timestamp_ntz").alias("ghosted_at"))
