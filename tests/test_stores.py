"""Stored tables: what a merge, a second run, a deletion or an expiry leaves alone, and what it removes."""

from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import discovery, learning, merge, patterns
from tessera.operators import signals as sg
from tessera.sources import feeds
from tessera.sources.stored import append_dated, merge_buckets, read_buckets, write_buckets, write_profiles
from tessera.streaming import arrivals as ar


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    write_buckets(spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(1).alias("at")), path, ["k"], 16)
    before = files(path)
    new = spark.createDataFrame([(7, "new", 2), (7, "older", 0), (1000, "new", 2)], "k long, v string, at int")
    replace = lambda t, n: merge.upsert_replace(t, n, ["k"], [F.col("at")])
    touched = merge_buckets(path, new, ["k"], replace, 16)
    assert len(touched) <= 2
    assert {f for f in before if not any(f.startswith(f"bucket={b}/") for b in touched)} == {f for f in files(path) if not any(f.startswith(f"bucket={b}/") for b in touched)}
    once = sorted(map(tuple, read_buckets(spark, path).select("k", "v", "at").collect()))
    assert len(once) == 201 and (7, "new", 2) in once and (1000, "new", 2) in once
    merge_buckets(path, new, ["k"], replace, 16)
    assert sorted(map(tuple, read_buckets(spark, path).select("k", "v", "at").collect())) == once
    gone = merge_buckets(path, new.select("k").distinct(), ["k"], lambda t, n: t.join(n, "k", "left_anti"), 16)
    assert read_buckets(spark, path).count() == 199 and gone == touched


def test_a_batch_again_replaces_itself(spark, tmp_path):
    path = f"{tmp_path}/s"
    day = lambda d, n: spark.range(n).select("id", F.lit(datetime(2024, 1, d)).alias("at"))
    append_dated(day(1, 3), path, "at", 0)
    first = files(path)
    append_dated(day(2, 2), path, "at", 1)
    append_dated(day(2, 2), path, "at", 1)
    d = spark.read.parquet(path)
    assert d.count() == 5 and first <= files(path)
    plan = d.where("on = date'2024-01-02'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(on" in plan


def test_snapshots_feed_the_change_check(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://a.com/", "<p>one</p>"), (2, "https://b.com/", "<p>two</p>")], "page_id long, url string, html string")
    empty = spark.createDataFrame([(0, "none", datetime(2000, 1, 1))], "page_id long, content_hash string, fetched_at timestamp")
    write_buckets(empty, f"{tmp_path}/current", ["page_id"], 4)
    for _ in range(2):
        sg.store_snapshots(f"{tmp_path}/all", f"{tmp_path}/current", sg.extract_signals(pages), datetime(2024, 1, 1), 0, 4)
    assert spark.read.parquet(f"{tmp_path}/all").count() == 2
    last = read_buckets(spark, f"{tmp_path}/current").select(F.col("page_id").alias("key"), "content_hash", "fetched_at")
    again = pages.withColumn("html", F.when(F.col("page_id") == 2, "<p>three</p>").otherwise(F.col("html"))).select(F.col("page_id").alias("key"), sg.content_hash("html").alias("content_hash"))
    assert [r["key"] for r in sg.changed_pages(again, last).collect()] == [2]


def test_a_large_profile_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(0, 40000, 1, 8).select("id", F.lit(1).alias("profile_id"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32k")
    try:
        write_profiles(rows, f"{tmp_path}/p")
        write_buckets(rows, f"{tmp_path}/b", ["profile_id"], 4)
        merge_buckets(f"{tmp_path}/b", rows.withColumn("id", F.col("id") + 40000), ["profile_id"], DataFrame.unionByName, 4)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(files(f"{tmp_path}/p")) > 2 and len(files(f"{tmp_path}/b")) > 2
    assert spark.read.parquet(f"{tmp_path}/p").distinct().count() == 40000 and read_buckets(spark, f"{tmp_path}/b").distinct().count() == 80000


def test_a_profile_goes_whole(spark, tmp_path):
    root = str(tmp_path)
    own = spark.createDataFrame([(i, i % 3) for i in range(30)], "entity_id long, profile_id long")
    for t in learning.CHILDREN:
        write_buckets(own.select(F.concat(F.lit(f"{t}:"), "entity_id").alias("key"), "entity_id"), f"{root}/{t}", ["entity_id"], 4)
    for t in learning.SCOPED:
        write_profiles(own, f"{root}/{t}")
    write_profiles(spark.createDataFrame([(p, f"P{p}") for p in range(3)], "profile_id long, name string"), f"{root}/profiles")
    assert learning.delete_profile(spark, root, 1, "P2", 4) == ("the name differs", {})
    assert learning.delete_profile(spark, root, 9, "P2", 4)[0] == "no such profile"
    refused, had = learning.delete_profile(spark, root, 1, " P1 ", 4)
    assert refused is None and had == dict.fromkeys([*learning.CHILDREN, *learning.SCOPED], 10)
    for t in [*learning.CHILDREN, *learning.SCOPED]:
        assert {r["entity_id"] % 3 for r in spark.read.parquet(f"{root}/{t}").collect()} == {0, 2}
    assert {r["name"] for r in spark.read.parquet(f"{root}/profiles").collect()} == {"P0", "P2"}
    learning.delete_profile(spark, root, 0, "P0", 4)
    assert learning.delete_profile(spark, root, 2, "P2", 4) == ("the only profile", {})


def test_old_urls_are_forgotten(spark):
    at = datetime(2024, 1, 1)
    rows = lambda *r: spark.createDataFrame([(u, h, at + timedelta(days=d)) for u, h, d in r], "url string, content_hash string, fetched_at timestamp")
    last = rows(("a", "1", 0), ("b", "1", 9)).withColumns({"batch": F.lit(0).cast("long"), "old_hash": F.lit(None).cast("string"), "old_at": F.lit(None).cast("timestamp")})
    new = rows(("a", "1", 12), ("b", "1", 12), ("c", "1", 1), ("c", "1", 2), ("c", "1", 30))
    changed, now = ar.changes_of(new, last, 1, 10)
    assert sorted((r["url"], (r["fetched_at"] - at).days) for r in changed.collect()) == [("a", 12), ("c", 1), ("c", 30)]
    # the same batch again sees what it saw at first
    again, _ = ar.changes_of(new, now, 1, 10)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, changed.collect()))


def test_state_of_an_old_url_is_gone(spark, tmp_path):
    schema = "url string, content_hash string, fetched_at timestamp"
    for i, (url, day) in enumerate([("a", 1), ("b", 20)]):
        spark.createDataFrame([(url, "1", datetime(2024, 1, day))], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        s = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        ar.run_available(ar.change_stream(s, f"{tmp_path}/out", f"{tmp_path}/last", 10, 1), f"{tmp_path}/c", spark)
    assert [r["url"] for r in read_buckets(spark, f"{tmp_path}/last").where("url is not null").collect()] == ["b"]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_boxes_cover_few_cells(spark):
    import random

    r = random.Random(1)
    boxes = [(i, x := r.uniform(-50, 50), x + r.choice([0, 0.3, 2, 17, 900]), y := r.uniform(-50, 50), y + r.choice([0, 1, 40])) for i in range(60)]
    points = [(i, r.uniform(-60, 60), r.uniform(-60, 60)) for i in range(300)]
    p = spark.createDataFrame(points, "id long, x double, y double")
    b = spark.createDataFrame(boxes, "slug long, x0 double, x1 double, y0 double, y1 double")
    got = {(q["id"], q["slug"]) for q in discovery.places_in_boxes(p, b, 0.5).collect()}
    assert got == {(i, s) for i, x, y in points for s, x0, x1, y0, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1}


def test_feeds_reject_lines_and_go_on(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"id": 1, "tags": {"name": "A"}}\n{"id": 2\n{"tags": {}}\n{"id": "x", "tags": {}}\n{"id": 3, "tags": {"name": "C"}, "extra": 1}\n')
    got, rejected = feeds.elements(spark, f"{tmp_path}/e.json")
    assert {r["id"] for r in got.collect()} == {1, 3}
    assert sorted(r["reason"] for r in rejected.collect()) == ["no id", "not readable", "not readable"]
    (tmp_path / "c.json").write_text('{"name_value": "a.com\\nwww.a.com"}\nnull?\n')
    certs, bad = feeds.certificates(spark, f"{tmp_path}/c.json")
    assert certs.count() == 1 and bad.count() == 1


def test_patterns_are_held_as_written(spark):
    import random

    r = random.Random(2)
    texts = [(i, "".join(r.choice("ab é\n") for _ in range(r.randrange(0, 30)))) for i in range(60)] + [(60, None), (61, "")]
    pats = ["", "a", "ab", "é a", "abab", "ab ab", "a\nb", "abaab", "aaaaaaaa", "b é", "ab é\na"]
    t, p = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(x,) for x in pats + ["ab"]], "pattern string")
    want = {(i, x) for i, text in texts for x in pats if x and x in (text or "")}
    for few in (True, False):
        got = [tuple(q) for q in patterns.held(t, p, few=few).collect()]
        assert len(got) == len(set(got)) and set(got) == want
