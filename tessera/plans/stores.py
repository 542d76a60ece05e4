"""Queries of tables that are stored: snapshots, merges by bucket, a profile's deletion, and feeds read from files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import discovery as ds
from tessera.operators import learning as lr
from tessera.operators import merge
from tessera.operators import signals as sg
from tessera.sources import feeds
from tessera.sources.stored import merge_buckets, read_buckets, write_buckets, write_profiles

from .discover import _CHAIN, _EL, _LINE, elements, sql_domain
from .pages import _HASH, PAGES, TITLE
from .registry import register
from .standins import BUDGET, ENTITIES, FEEDBACK, OUTREACH, budget, entities, feedback, folder, outreach, table

_BUCKETS = 8


@register("a15_snapshot_store", f"""WITH {PAGES}, s AS (SELECT page_id, {_HASH.format('html')} AS content_hash, {TITLE} AS title FROM sg), t AS (SELECT unnest([30, 31]) AS d)
  SELECT page_id, DATE '2024-01-01' + CAST(d - 1 AS INT) AS "on", content_hash, title, d = 31 OR page_id % 2 = 0 AS is_last FROM s, t WHERE d = 30 OR page_id % 2 = 1""")
def a15_store(spark, sf):
    """Two days' batches, the second of odd pages and run twice; of each page the last snapshot by the bucketed table."""
    p, path, current = table(spark, sf, "pages"), folder(spark, "snapshots"), folder(spark, "current")
    write_buckets(p.where("false").select("page_id", F.lit("").alias("content_hash"), F.lit(None).cast("timestamp_ntz").alias("fetched_at")).unionByName(p.select("page_id", F.lit("none").alias("content_hash"), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz").alias("fetched_at"))), current, ["page_id"], _BUCKETS)
    signals = sg.extract_signals(p)
    at = lambda d: F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz")
    sg.store_snapshots(path, current, signals, at(30), 0, _BUCKETS)
    for _ in range(2):
        sg.store_snapshots(path, current, signals.where("page_id % 2 = 1"), at(31), 1, _BUCKETS)
    last = read_buckets(spark, current).select("page_id", "fetched_at", F.lit(True).alias("is_last"))
    s = spark.read.parquet(path).join(last, ["page_id", "fetched_at"], "left")
    return s.select("page_id", "on", "content_hash", F.get_json_object("signals", "$.title").alias("title"), F.coalesce("is_last", F.lit(False)).alias("is_last"))


@register("a11_merge_buckets", "WITH t AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0) SELECT * FROM t UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey NOT IN (SELECT k FROM t)")
def a11_buckets(spark, sf):
    o, path = table(spark, sf, "orders"), folder(spark, "ignore")
    write_buckets(o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")), path, ["k"], _BUCKETS)
    new = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + 1).alias("v"))
    merge_buckets(path, new, ["k"], lambda t, n: merge.upsert_ignore(t, n, ["k"]), _BUCKETS)
    return read_buckets(spark, path).select("k", "v")


@register("a12_merge_buckets", "SELECT o_custkey AS k, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS v, max(CAST(o_orderdate AS DATE)) AS written FROM orders GROUP BY 1")
def a12_buckets(spark, sf):
    """Orders arrive in three batches."""
    path = folder(spark, "replace")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"), F.to_date("o_orderdate").alias("written"), F.col("o_orderkey").alias("id"))
    by = [F.col("written"), F.col("id")]
    write_buckets(merge.upsert_replace(o.where("false"), o.where("id % 3 = 0"), ["k"], by), path, ["k"], _BUCKETS)
    for i in (2, 1):
        merge_buckets(path, o.where(f"id % 3 = {i}"), ["k"], lambda t, n: merge.upsert_replace(t, n, ["k"], by), _BUCKETS)
    return read_buckets(spark, path).select("k", "v", "written")


@register("a13_merge_buckets", f"WITH {BUDGET} SELECT source, CAST(sum(units) AS BIGINT) AS units, max(day) AS last_run, CAST(sum(CASE WHEN metric = 'A' THEN 0 ELSE 1 END) AS BIGINT) AS runs FROM budg GROUP BY 1")
def a13_buckets(spark, sf):
    b, path = budget(spark, sf).select("source", F.col("units").cast("long").alias("units"), F.col("day").alias("last_run"), "metric"), folder(spark, "accumulate")
    write_buckets(b.where("metric = 'A'").withColumn("runs", F.lit(0).cast("long")).drop("metric"), path, ["source"], _BUCKETS)
    merge_buckets(path, b.where("metric <> 'A'").drop("metric"), ["source"], lambda t, n: merge.upsert_accumulate(t, n, ["source"], ["units"], "last_run"), _BUCKETS)
    return read_buckets(spark, path).select("source", "units", "last_run", "runs")


def profile_tables(spark, sf):
    """A table of each kind that a profile owns rows in, by entity or by profile."""
    e = entities(spark, sf).select("entity_id", "profile_id", "niche", "email")
    # neither side is small, however well its file is compressed
    owner = e.select("entity_id", "profile_id").hint("merge")
    o = outreach(spark, sf).join(owner, "entity_id")
    f = feedback(spark, sf).join(owner, "entity_id")
    part = table(spark, sf, "part").withColumn("profile_id", F.col("p_partkey") % 3)
    two = lambda c: part.select("profile_id", c)
    return {
        "entity_keys": e.where("email is not null").select(F.concat(F.lit("email:"), "email").alias("key"), "entity_id"), "snapshots": feedback(spark, sf).select("feedback_id", "entity_id"), "evaluations": outreach(spark, sf).select("outreach_id", "entity_id"),
        "feedback": f.select("feedback_id", "entity_id", "profile_id"), "outreach": o.select("outreach_id", "entity_id", "profile_id"), "entities": e,
        "crawl_frontier": two("p_name"), "keywords": two("p_type"), "source_cursor": two("p_brand"), "budget": budget(spark, sf), "lessons": two("p_size"), "runs": two("p_partkey"), "skip_categories": two("p_retailprice"),
        "regions": table(spark, sf, "region").select((F.col("r_regionkey") % 3).alias("profile_id"), "r_name"), "profiles": spark.range(3).select(F.col("id").alias("profile_id"), F.concat(F.lit("profile "), "id").alias("name")),
    }


_PART = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, count(*) FILTER (p_partkey % 3 = 1) AS had FROM part" for t in ("crawl_frontier", "keywords", "source_cursor", "lessons", "runs", "skip_categories"))


@register("p02_delete_profile", f"""WITH {ENTITIES}, {OUTREACH}, {FEEDBACK}, {BUDGET}, o AS (SELECT profile_id FROM outr JOIN ents USING (entity_id)), f AS (SELECT profile_id FROM feed JOIN ents USING (entity_id)), c AS (
  SELECT 'entity_keys' AS name, count(*) AS n, count(*) FILTER (profile_id = 1) AS had FROM ents WHERE email IS NOT NULL UNION ALL SELECT 'snapshots', (SELECT count(*) FROM feed), (SELECT count(*) FROM f WHERE profile_id = 1) UNION ALL SELECT 'evaluations', (SELECT count(*) FROM outr), (SELECT count(*) FROM o WHERE profile_id = 1)
  UNION ALL SELECT 'feedback', count(*), count(*) FILTER (profile_id = 1) FROM f UNION ALL SELECT 'outreach', count(*), count(*) FILTER (profile_id = 1) FROM o UNION ALL SELECT 'entities', count(*), count(*) FILTER (profile_id = 1) FROM ents UNION ALL {_PART}
  UNION ALL SELECT 'budget', count(*), count(*) FILTER (profile_id = 1) FROM budg UNION ALL SELECT 'regions', count(*), count(*) FILTER (r_regionkey % 3 = 1) FROM region UNION ALL SELECT 'profiles', 3, 1)
  SELECT name, had, n - had AS n_left FROM c""")
def p02_delete(spark, sf):
    """Rows that profile 1 had in each of its tables, and what is left in them after its deletion."""
    root = folder(spark, "profiles")
    for name, rows in profile_tables(spark, sf).items():
        if name in lr.CHILDREN:
            write_buckets(rows, f"{root}/{name}", ["entity_id"], _BUCKETS)
        else:
            write_profiles(rows, f"{root}/{name}")
    refused, had = lr.delete_profile(spark, root, 1, "profile 1", _BUCKETS)
    assert refused is None, refused
    out = None
    for name, n in {**had, "profiles": 1}.items():
        one = spark.read.parquet(f"{root}/{name}").agg(F.count(F.lit(1)).alias("n_left")).select(F.lit(name).alias("name"), F.lit(n).cast("long").alias("had"), "n_left")
        out = one if out is None else out.unionByName(one)
    return out


@register("a01_element_feed", f"""WITH {_EL}, k AS (SELECT *, coalesce(domain, lower(name) || '|' || lower(street)) AS key FROM el WHERE id % 10 <> 3 AND NOT {_CHAIN} AND (domain IS NOT NULL OR phone)), f AS (SELECT min(id) AS id FROM k GROUP BY key)
  SELECT 'kept' AS kind, id, domain, name AS display_name, CAST(NULL AS VARCHAR) AS reason FROM k JOIN f USING (id) UNION ALL SELECT 'rejected', NULL, NULL, NULL, CASE WHEN id % 20 = 3 THEN 'not readable' ELSE 'no id' END FROM el WHERE id % 10 = 3""")
def a01_feed(spark, sf):
    """Elements written as JSON, a tenth of the lines broken or without an id."""
    e, path = elements(spark, sf), folder(spark, "elements")
    line = F.to_json(F.struct("id", "tags"))
    broken = F.when(F.col("id") % 20 == 3, F.substring(line, 1, 9)).when(F.col("id") % 20 == 13, F.to_json(F.struct("tags"))).otherwise(line)
    e.select(broken.alias("value")).write.text(path)
    got, rejected = feeds.elements(spark, path)
    niches = got.select("id", F.lit("makers").alias("niche"))
    kept = ds.place_candidates(got, niches, "salem-or").select(F.lit("kept").alias("kind"), "id", "domain", "display_name", F.lit(None).cast("string").alias("reason"))
    none = F.lit(None)
    return kept.unionByName(rejected.select(F.lit("rejected").alias("kind"), none.cast("long").alias("id"), none.cast("string").alias("domain"), none.cast("string").alias("display_name"), "reason"))


@register("a08_seed_file", f"""WITH l AS (SELECT page_id, {_LINE} AS s FROM pages) SELECT CASE page_id % 7 WHEN 1 THEN 'instagram' WHEN 2 THEN 'handle' WHEN 3 THEN 'rejected' WHEN 4 THEN 'etsy' ELSE 'site' END AS kind,
  CASE page_id % 7 WHEN 1 THEN 'shop' || page_id WHEN 2 THEN 'maker' || page_id WHEN 3 THEN s WHEN 4 THEN 's' || page_id ELSE {sql_domain('s')} END AS value FROM l WHERE page_id % 7 <> 0""")
def a08_file(spark, sf):
    path = folder(spark, "seeds")
    table(spark, sf, "pages").select(F.expr(_LINE).alias("value")).write.text(path)
    return ds.seed_lines(feeds.lines(spark, path)).select("kind", "value")


@register("d13_boxes_of_all_sizes", "WITH b AS (SELECT s_suppkey AS slug, s_suppkey % 90 AS x0, s_suppkey % 70 AS y0, CAST(power(3, s_suppkey % 6) AS DOUBLE) AS w FROM supplier) SELECT event_id AS id, slug FROM events JOIN b ON value BETWEEN x0 AND x0 + w AND user_id BETWEEN y0 AND y0 + w / 2")
def d13_sizes(spark, sf):
    p = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))
    k, w = F.col("s_suppkey"), F.pow(F.lit(3.0), F.col("s_suppkey") % 6)
    b = table(spark, sf, "supplier").select(k.alias("slug"), (k % 90).cast("double").alias("x0"), (k % 90 + w).alias("x1"), (k % 70).cast("double").alias("y0"), (k % 70 + w / 2).alias("y1"))
    return ds.places_in_boxes(p, b, 1.0)
