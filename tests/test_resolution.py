"""Entity resolution under constraints against a plain version, and as a stream in any split."""

import itertools
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import identity as ident
from tessera.functions.rules import MARKETPLACES
from tessera.operators import linkage

KINDS = linkage.IDENTITY
FIELDS = "cand_id long, profile_id string, display_name string, website string, instagram string, tiktok string, etsy string, contact_email string, first_seen timestamp"


def frame(spark, rows):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    c = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], FIELDS)
    return c.withColumns({"domain": ident.domain(F.col("website")), "instagram": ident.handle(F.col("instagram"), "instagram.com"), "tiktok": ident.handle(F.col("tiktok"), "tiktok.com"), "etsy": ident.shop_handle(F.col("etsy"))})


def resolved(c):
    return {r["cand_id"]: (r["component"], r["foreign"]) for r in linkage.resolve_entities(c, linkage.identity_keys(c)).collect()}


def doors(*rows):
    return [{"cand_id": i + 1, "profile_id": "p"} | r for i, r in enumerate(rows)]


def test_one_identifier_has_one_value(spark):
    """A handle at two slugs never brings two domains together, whatever the order of rows."""
    rows = doors({"website": "moonstudio.com"}, {"instagram": "@moonstudio", "tiktok": "@sunbakery"}, {"website": "sunbakery.net"})
    for some in (rows, rows[::-1]):
        got = resolved(frame(spark, some))
        assert got == {1: (1, False), 2: (1, False), 3: (3, False)}


def test_profiles_and_foreign_owners(spark):
    rows = [
        {"cand_id": 1, "profile_id": "p", "website": "a-b-c.com", "first_seen": datetime(2024, 1, 1)}, {"cand_id": 2, "profile_id": "q", "website": "a-b-c.com", "contact_email": "me@x.com", "first_seen": datetime(2024, 1, 2)},
        {"cand_id": 3, "profile_id": "p", "contact_email": "me@x.com", "first_seen": datetime(2024, 1, 3)}, {"cand_id": 4, "profile_id": "q", "website": "moonstudio.com"}, {"cand_id": 5, "profile_id": "p", "instagram": "@moonstudio"},
    ]
    # 2 is foreign and so owns no address: 3 stays on its own
    assert resolved(frame(spark, rows)) == {1: (1, False), 2: (1, True), 3: (3, False), 4: (4, False), 5: (5, False)}


def test_place_is_no_conflict(spark):
    place = sorted(MARKETPLACES)[0]
    rows = doors({"website": f"https://{place}/x", "instagram": "@moonstudio"}, {"website": f"https://{place}/y", "tiktok": "@moonstudio"}, {"website": "moonstudio.com"})
    assert resolved(frame(spark, rows)) == {1: (1, False), 2: (1, False), 3: (3, False)}


def plain(rows, keys, coin, patience):
    """The same by pairs: groups by strong keys in a profile, then rounds of names; values themselves are compared."""
    age = lambda i: (rows[i].get("first_seen") or datetime.max, i)
    group = {i: i for i in rows}
    strong = {i: {k for t, k in keys[i] if t == "strong"} for i in rows}

    def merge(a, b):
        a, b = sorted((group[a], group[b]), key=age)
        for i in group:
            if group[i] == b:
                group[i] = a

    for a, b in itertools.combinations(rows, 2):
        if rows[a]["profile_id"] == rows[b]["profile_id"] and strong[a] & strong[b]:
            merge(a, b)

    def values(g):
        return [{rows[i][k] for i in rows if group[i] == g and rows[i][k]} for k in KINDS]

    def fits(g, h):
        for k, (x, y) in enumerate(zip(values(g), values(h), strict=True)):
            if x and y and not (k == 0 and x == y and len(x) == 1 and next(iter(x)) in MARKETPLACES):
                return False
        return True

    for turn in itertools.count():
        have = sorted(set(group.values()), key=age)
        weak = {g: {k for i in rows if group[i] == g for t, k in keys[i] if t == "weak"} for g in have}
        names = {}
        for g in have:
            older = [h for h in have if age(h) < age(g) and rows[h]["profile_id"] == rows[g]["profile_id"] and weak[h] & weak[g] and fits(g, h)]
            if older:
                names[g] = min(older, key=age)
        if not names:
            break
        stay = {g for g in names if turn >= patience and g in names.values() and not coin[g, turn] & 1}
        movers = {g: h for g, h in names.items() if g not in stay}
        movers = {g: h for g, h in movers.items() if h not in movers}
        joins = []
        for h in set(movers.values()):
            mine = sorted((g for g in movers if movers[g] == h), key=age)
            given = [next((values(g)[k] for g in mine if values(g)[k]), None) for k in range(len(KINDS))]
            first = [next((g for g in mine if values(g)[k]), None) for k in range(len(KINDS))]
            joins += [(g, h) for g in mine if all(not v or first[k] == g or (k == 0 and v == given[k] and next(iter(v)) in MARKETPLACES and len(v) == 1) for k, v in enumerate(values(g)))]
        for g, h in joins:
            merge(g, h)
    return group


def many(seed, n=60):
    r = random.Random(seed)
    stems = ["moonstudio", "sunbakery", "cutebrand", "riverclay", "oakandash"]
    out = []
    for i in range(n):
        s = r.choice(stems)
        row = {"cand_id": i, "profile_id": r.choice("pppq"), "first_seen": r.choice([None, datetime(2024, 1, r.randrange(1, 28))])}
        if r.random() < 0.4:
            row["website"] = r.choice([f"{s}.{r.choice(['com', 'net', 'org'])}", f"https://{sorted(MARKETPLACES)[i % 2]}/{s}"])
        for k in ("instagram", "tiktok", "etsy"):
            if r.random() < 0.35:
                row[k] = r.choice(stems) + r.choice(["", "co", "shop", "hq"])
        if r.random() < 0.1:
            row["contact_email"] = f"{r.choice('abcdefghij')}@mail.com"
        if r.random() < 0.3:
            row["display_name"] = s
        out.append(row)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_resolution_against_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(linkage, "PATIENCE", 6 if seed else 0)
    c = frame(spark, many(seed)).cache()
    keys = {}
    for k in linkage.identity_keys(c).collect():
        keys.setdefault(k["cand_id"], []).append((k["tier"], k["key"]))
    rows = {r["cand_id"]: r.asDict() for r in c.collect()}
    coin = {(r["g"], r["t"]): r["h"] for r in spark.range(60).select(F.col("id").alias("g"), F.explode(F.expr("sequence(0, 20)")).alias("t")).select("g", "t", F.xxhash64("g", "t").alias("h")).collect()}
    want = plain(rows, {i: keys.get(i, []) for i in rows}, coin, linkage.PATIENCE)
    got = resolved(c.repartition(3))
    assert {i: g for i, (g, foreign) in got.items() if not foreign} == {i: want[i] for i, (_, foreign) in got.items() if not foreign}
    # a foreign candidate shares a strong key with an older group of another profile
    for i, (g, foreign) in got.items():
        if foreign:
            assert rows[g]["profile_id"] != rows[i]["profile_id"]
    assert len(set(want.values())) < len(want)


def streamed(spark, c, path, splits):
    from tessera.streaming import arrivals as ar

    for i, part in enumerate(splits):
        part.coalesce(1).write.parquet(f"{path}/in/{i}")
    s = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    keys_of = lambda d: linkage.identity_keys(d.drop("domain"))
    for _ in range(2):
        ar.run_available(ar.candidate_stream(s, keys_of, f"{path}/out"), f"{path}/state", spark)
    return {r["cand_id"]: (r["entity_id"], r["foreign"]) for r in ar.candidate_owners(spark, f"{path}/out").collect()}


def test_stream_gives_the_batch_result(spark, tmp_path):
    """Later batches bring what refuses an earlier weak link, and what joins two known entities."""
    c = frame(spark, many(7, 30)).cache()
    got = streamed(spark, c, tmp_path, [c.where("cand_id % 3 <> 0"), c.where("cand_id % 3 = 0")])
    assert got == resolved(c)


def test_stream_says_who_moved(spark, tmp_path):
    rows = doors({"website": "moonstudio.com"}, {"instagram": "@riverclay"}, {"website": "moonstudio.com", "instagram": "@riverclay"}, {"profile_id": "q", "website": "moonstudio.com"})
    c = frame(spark, rows)
    got = streamed(spark, c, tmp_path, [c.where("cand_id < 3"), c.where("cand_id >= 3")])
    assert got == {1: (1, False), 2: (1, False), 3: (1, False), 4: (1, True)}
    assert [(r["entity_id"], r["winner"]) for r in spark.read.parquet(f"{tmp_path}/out/moved").collect()] == [(2, 1)]


def test_keys_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(key):
        made.add(1)
        return key

    c = spark.createDataFrame([(i, "p", f"d{i // 2}.com") for i in range(8)], "cand_id long, profile_id string, domain string").withColumns({k: F.lit(None).cast("string") for k in ("instagram", "tiktok", "etsy")})
    key = F.udf(counted).asNondeterministic()(F.concat(F.lit("domain:"), "domain"))
    got = linkage.resolve_entities(c, c.select("cand_id", F.lit("strong").alias("tier"), key.alias("key"))).collect()
    assert {(r["cand_id"], r["component"]) for r in got} == {(i, i // 2 * 2) for i in range(8)} and made.value == 8


def test_a_batch_of_one_file_makes_its_keys_in_several_tasks(spark, tmp_path):
    from tessera.streaming import arrivals as ar

    c = spark.createDataFrame([(i, "p", f"d{i // 2}.com") for i in range(40)], "cand_id long, profile_id string, domain string").withColumns({k: F.lit(None).cast("string") for k in ("instagram", "tiktok", "etsy")})
    c.coalesce(1).write.parquet(f"{tmp_path}/in")
    files = []

    def keys_of(d):
        files.append(len(d.inputFiles()))
        return d.select("cand_id", F.lit("strong").alias("tier"), F.concat(F.lit("domain:"), "domain").alias("key"))

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ar.run_available(ar.candidate_stream(spark.readStream.schema(c.schema).parquet(f"{tmp_path}/in"), keys_of, f"{tmp_path}/out"), f"{tmp_path}/state", spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["cand_id"]: r["entity_id"] for r in ar.candidate_owners(spark, f"{tmp_path}/out").collect()} == {i: i // 2 * 2 for i in range(40)} and min(files) > 1


@pytest.mark.parametrize("name", ["b10_resolve_entities", "w02_candidate_stream"])
def test_suppliers_are_candidates(spark, tmp_path, name):
    """Pages, customers and suppliers are all resolved, and suppliers of one name and profile are one."""
    from tessera.plans import registry

    spark.createDataFrame([(0, "https://moonstudio.com/a"), (2, "https://moonstudio.com/b")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(4, "BUILDING")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "Sun Bakery"), (1, "Sun Bakery"), (2, "sun bakery, inc"), (3, "Building Store 4"), (4, "Building Store 4")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = [tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()]
    # the customer and supplier 4 are of one profile
    assert sorted(got) == [(-5, -5, False), (-4, -4, False), (-3, -3, False), (-2, -2, False), (-1, -3, False), (0, 0, False), (2, 0, False), (1000004, -5, False)]
