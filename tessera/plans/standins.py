"""Stand-ins for the domain's tables, derived from the star-schema tables: in Spark here, and the same in SQL below."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.rules import STATES
from tessera.operators.graph import shared_folder
from tessera.sources.tables import table


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/stored/{name}-{uuid.uuid4().hex}"


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """customer with its nation and region; both are small, fixed tables."""
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    state = F.element_at(F.array(*map(F.lit, STATES)), (k % 13 + 1).cast("int"))
    day = lambda start, off: F.date_sub(F.lit(start).cast("date"), off.cast("int"))
    # a join's size is taken for the product of its tables', so customer would be the one to be sent
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("entity_id"),
        F.col("c_name").alias("display_name"),
        F.col("c_mktsegment").alias("niche"),
        (k * 37 % 101).alias("score"),
        state.alias("state"),
        (F.col("c_nationkey") % 2).alias("profile_id"),
        F.col("n_name").alias("location"),
        F.col("r_name").alias("region"),
        F.when(k % 17 != 0, day("2001-08-01", k * 7 % 200)).alias("evaluated_on"),
        F.when(k % 13 >= 5, day("2001-08-01", k * 11 % 90)).alias("contacted_on"),
        F.when(k % 13 == 6, "REPLIED").when(k % 13 == 5, F.when(k % 26 == 5, "NO_REPLY")).alias("response_status"),
        F.concat(F.lit("d"), (k % 97).cast("string"), F.lit(".com")).alias("domain"),
        F.when(k % 5 != 0, F.concat(F.lit("c"), k.cast("string"), F.lit("@d"), (k % 97).cast("string"), F.lit(".com"))).alias("email"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("has_website"),
        (k % 4).alias("times_surfaced"),
    )


def outreach(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "SENT").when(F.col("o_orderstatus") == "O", "SKIPPED").otherwise("BOUNCED")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("outreach_id"), F.col("o_custkey").alias("entity_id"), status.alias("status"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    decision = F.when(kind == "click", "SKIPPED").when(kind == "error", "BLOCKED").when(kind == "view", "SENT").when(kind == "signup", "NOTE").otherwise("BOUNCED")
    return table(spark, sf, "events").select(F.col("event_id").alias("feedback_id"), F.col("user_id").alias("entity_id"), decision.alias("decision"), F.to_date("ts").alias("day"), F.col("ts").alias("created_at"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("value"))


def budget(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select((F.col("l_suppkey") % 2).alias("profile_id"), F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("metric"), F.col("l_quantity").cast("int").alias("units"), F.col("l_suppkey").alias("source"))


_STATES = ", ".join(f"'{s}'" for s in STATES)
ENTITIES = f"""ents AS (SELECT c_custkey AS entity_id, c_name AS display_name, c_mktsegment AS niche, c_custkey * 37 % 101 AS score,
  ([{_STATES}])[CAST(c_custkey % 13 + 1 AS INT)] AS state, c_nationkey % 2 AS profile_id, n_name AS location, r_name AS region,
  CASE WHEN c_custkey % 17 <> 0 THEN DATE '2001-08-01' - CAST(c_custkey * 7 % 200 AS INT) END AS evaluated_on,
  CASE WHEN c_custkey % 13 >= 5 THEN DATE '2001-08-01' - CAST(c_custkey * 11 % 90 AS INT) END AS contacted_on,
  CASE WHEN c_custkey % 13 = 6 THEN 'REPLIED' WHEN c_custkey % 13 = 5 THEN CASE WHEN c_custkey % 26 = 5 THEN 'NO_REPLY' END END AS response_status,
  'd' || (c_custkey % 97) || '.com' AS domain, CASE WHEN c_custkey % 5 <> 0 THEN 'c' || c_custkey || '@d' || (c_custkey % 97) || '.com' END AS email,
  CASE WHEN c_custkey % 3 = 0 THEN true WHEN c_custkey % 3 = 1 THEN false END AS has_website, c_custkey % 4 AS times_surfaced
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
OUTREACH = """outr AS (SELECT o_orderkey AS outreach_id, o_custkey AS entity_id, CASE o_orderstatus WHEN 'F' THEN 'SENT' WHEN 'O' THEN 'SKIPPED' ELSE 'BOUNCED' END AS status,
  CAST(o_orderdate AS DATE) AS day, o_totalprice AS price, o_orderpriority AS priority FROM orders)"""
FEEDBACK = """feed AS (SELECT event_id AS feedback_id, user_id AS entity_id,
  CASE event_type WHEN 'click' THEN 'SKIPPED' WHEN 'error' THEN 'BLOCKED' WHEN 'view' THEN 'SENT' WHEN 'signup' THEN 'NOTE' ELSE 'BOUNCED' END AS decision,
  CAST(ts AS DATE) AS day, ts AS created_at, CAST(json_extract_string(props, '$.k') AS INT) AS k, value FROM events)"""
BUDGET = "budg AS (SELECT l_suppkey % 2 AS profile_id, CAST(l_shipdate AS DATE) AS day, l_returnflag AS metric, CAST(l_quantity AS INT) AS units, l_suppkey AS source FROM lineitem)"
