"""Operators on small hand-made rows: values that the rules name, and what must hold whatever the rows."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import identity as ident
from tessera.functions import markup as mk
from tessera.functions import rules
from tessera.operators import contact, discovery, graph, learning, linkage, merge, metrics, scoring
from tessera.operators import signals as sg
from tessera.streaming import arrivals as ar


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in rows.select("i", f(F.col("v"))).orderBy("i").collect()]


def test_domains_and_urls(spark):
    urls = ["https://www.CuteBrand.com/shop?x=1", "http://shop.cutebrand.com", "https://shop.brand.co.uk", "not a domain", None, ""]
    assert column(spark, urls, ident.domain) == ["cutebrand.com", "cutebrand.com", "brand.co.uk", None, None, None]
    urls = ["http://WWW.Brand.com/shop/?utm_source=ig&fbclid=xyz#top", "brand.com", "javascript:alert(1)", "https://a.com/x?ref=1&q=2"]
    assert column(spark, urls, ident.norm_url) == ["https://brand.com/shop", "https://brand.com/", None, "https://a.com/x?q=2"]


def test_handles_names_slugs(spark):
    assert column(spark, ["https://www.etsy.com/uk/shop/CuteBrandCo", "@CuteBrandCo"], ident.shop_handle) == ["cutebrandco", "cutebrandco"]
    assert column(spark, ["https://instagram.com/@Me/p", "https://tiktok.com/@me", "@Me", "me"], lambda c: ident.handle(c, "instagram.com")) == ["me", None, "me", "me"]
    assert column(spark, ["Cute Brand Co., LLC", "Moon & Stars Studio", "X"], ident.name) == ["cute brand", "moon and stars", None]
    assert column(spark, ["cute-brand", "cutebrandco", "ab"], ident.slugs) == [["cutebrand"], ["cutebrandco", "cutebrand"], []]


def candidates(spark, rows):
    names = "cand_id profile_id display_name website instagram tiktok etsy contact_email".split()
    full = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(full, "cand_id long, profile_id string, display_name string, website string, instagram string, tiktok string, etsy string, contact_email string")


def resolved(spark, rows):
    c = candidates(spark, rows)
    keyed = c.withColumns({"domain": ident.domain(F.col("website")), "instagram": ident.handle(F.col("instagram"), "instagram.com"), "tiktok": ident.handle(F.col("tiktok"), "tiktok.com"), "etsy": ident.shop_handle(F.col("etsy"))})
    return {r["cand_id"]: r["component"] for r in linkage.resolve_entities(keyed, linkage.identity_keys(c)).collect()}


def test_linkage(spark):
    keys = linkage.identity_keys(candidates(spark, [{"cand_id": 1, "display_name": "Cute", "website": "cute-brand.com", "instagram": "@cutebrandco", "tiktok": "@cutebrandco", "etsy": "cutebrandco"}]))
    assert {r["kind"] for r in keys.collect()} == {"domain", "instagram", "tiktok", "etsy", "slug"}
    doors = [{"cand_id": 1, "profile_id": "p", "website": "cute-brand.com"}, {"cand_id": 2, "profile_id": "p", "instagram": "@cutebrandco"}, {"cand_id": 3, "profile_id": "p", "tiktok": "@cutebrandco"}, {"cand_id": 4, "profile_id": "p", "etsy": "https://etsy.com/shop/cutebrandco"}]
    # the two handles agree on their full slug and meet the site on the shorter one
    assert set(resolved(spark, doors[:2]).values()) == {1}
    apart = [{"cand_id": 1, "profile_id": "p", "website": "moonstudio.com"}, {"cand_id": 2, "profile_id": "p", "website": "moonbakery.com"}, {"cand_id": 3, "profile_id": "q", "website": "moonstudio.net"}, {"cand_id": 4, "profile_id": "p", "website": "www.moonstudio.com/x"}]
    got = resolved(spark, apart)
    assert got[1] == got[4] == 1 and got[2] == 2 and got[3] == 3


def test_components_and_merges(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(links).collect()}
    assert set(got.values()) == {1, 100} and len(got) == 42
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    n = spark.createDataFrame([(2, "c", 1), (3, "d", 2), (3, "e", 3)], "k int, v string, at int")
    once = merge.upsert_replace(t, n, ["k"], [F.col("at")])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "c", 1), (3, "e", 3)]
    assert sorted(map(tuple, merge.upsert_replace(once, n, ["k"], [F.col("at")]).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, merge.upsert_ignore(t, n, ["k"], [F.col("at")]).collect())) == [(1, "a", 1), (2, "b", 1), (3, "d", 2)]


def test_drafts_of_merged_records(spark):
    ch = spark.createDataFrame([(1, "w", "DRAFT", 5), (2, "l", "DRAFT", 5), (3, "l", "SENT", 5)], "outreach_id int, entity_id string, status string, day int")
    got = linkage.repoint_children(ch, spark.createDataFrame([("l", "w")], "entity_id string, winner string"), "outreach_id").collect()
    assert {(r["outreach_id"], r["entity_id"]) for r in got} == {(1, "w"), (3, "w")}


PAGE = """<html><head><title>Mara Studio | ceramics</title><meta name="viewport" content="w"><meta name="description" content="Pots"><script>x@y.com</script></head><body>
<!-- hidden@z.com --><p>Our story: hand made. As seen in Vogue. Wholesale. Sign up for the newsletter &#97;t $1,180.00 or $20.</p><a href="/collections/a">A</a><a href="/contact">Contact us</a>
<a href="https://instagram.com/mara">ig</a><img src=a width=1 height=1><script src="//cdn.shopify.com/x"></script>klaviyo<footer>hello@mara.studio Portland, OR 97201 © 2019-2026</footer></body></html>"""


def test_page_signals(spark):
    p = spark.createDataFrame([(1, "https://mara.studio/", PAGE)], "page_id long, url string, html string")
    s = sg.extract_signals(p).first()
    assert s["title"] == "Mara Studio | ceramics" and s["platform"] == "shopify" and s["has_viewport"] and s["us_hint"] and s["copyright_year"] == 2026
    assert s["price_max"] == 1180.0 and s["price_median"] == 1180.0 and s["price_count"] == 2 and s["has_wholesale"] and s["has_press"] and s["has_team"] and s["has_email_capture"] and "at $1,180" in s["text"] and s["meta_description"] == "Pots"
    assert contact.page_emails(p).first()["emails"] == ["hello@mara.studio"]
    links = sg.page_links(p)
    assert sg.contact_links(links).first()["url"] == "https://mara.studio/contact"
    assert contact.social_links(links).first()["instagram"] == "https://instagram.com/mara"
    assert contact.image_stats(p).first()["img_with_dims"] == 1 and column(spark, [PAGE], contact.paid_apps) == [["klaviyo"]]


def test_addresses(spark):
    xor = "42" + "".join(f"{ord(c) ^ 0x42:02x}" for c in "hi@b.co")
    assert column(spark, [f'<a data-cfemail="{xor}">'], contact.xor_emails) == [["hi@b.co"]]
    texts = ["hello (at) brand (dot) com", "hi at brand dot com", "email me at hello dot com", "creativity.com", "our latest collection at studio.com"]
    assert column(spark, texts, contact.written_emails) == [["hello@brand.com"], ["hi@brand.com"], [], [], []]
    lists = spark.createDataFrame([(1, ["checkout@x.com", "hello@x.com", "info@x.com"]), (2, ["info@x.com", "mara@x.com"]), (3, ["hr@x.com"]), (4, [])], "i int, e array<string>")
    assert [r[1] for r in lists.select("i", contact.pick_email(F.col("e"))).orderBy("i").collect()] == ["hello@x.com", "mara@x.com", None, None]
    assert column(spark, ["me@x.duties", "me@x.com", "a@b.png", "noreply@x.com"], contact.usable_email) == [False, True, False, False]


def test_entities_and_numeric_entities(spark):
    assert column(spark, ["&#105;&#x6e;fo &#7; &#128512;"], mk.decoded) == ["info &#7; 😀"]


def test_chains_and_places(spark):
    tags = [{"name": "A", "website": "https://www.kensartisan.com"}, {"name": "B", "brand": "Big"}, {"name": "A2", "website": "kensartisan.com/x"}, {"name": "Art"}, {"name": "Shop #12", "phone": "1"}, {"name": "Own", "phone": "1", "operator": "Own"}]
    e = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "id long, tags map<string,string>")
    assert {r["id"] for r in discovery.drop_chains(e).collect()} == {0, 2, 3, 5}
    n = e.select("id", F.lit("food").alias("niche"))
    assert {r["id"] for r in discovery.place_candidates(e, n, "portland-or").collect()} == {0, 5}


def test_apex_domains(spark):
    certs = spark.createDataFrame([("emiliaceramics.com\nwww.emiliaceramics.com",), ("*.asburyceramics.com\nasburyceramics.com",), ("ceramicsengineering.com",), ("other.com",)], "name_value string")
    got = discovery.apex_domains(certs, spark.createDataFrame([("ceramics",)], "keyword string")).collect()
    assert {r["domain"] for r in got} == {"emiliaceramics.com", "asburyceramics.com"}


def test_robots(spark):
    rules = spark.createDataFrame([("h", "*", False, "/"), ("h", "me", False, "/a"), ("h", "me", True, "/a/b"), ("h", "me", False, "/*.pdf$"), ("h", "me", False, "")], "host string, agent string, allow boolean, pattern string")
    urls = spark.createDataFrame([("u1", "h", "/x"), ("u2", "h", "/a/c"), ("u3", "h", "/a/b/c"), ("u4", "h", "/q.pdf"), ("u5", "other", "/a")], "url string, host string, path string")
    assert {r["url"] for r in scoring.robots_filter(urls, rules, "me").collect()} == {"u1", "u3", "u5"}


def test_robots_keep_each_row_of_a_url(spark):
    rules = spark.createDataFrame([("h", "*", False, "/a")], "host string, agent string, allow boolean, pattern string")
    urls = spark.createDataFrame([("u1", "h", "/x"), ("u1", "h", "/x"), ("u2", "h", "/a"), ("u2", "h", "/a")], "url string, host string, path string")
    assert [r["url"] for r in scoring.robots_filter(urls, rules, "me").collect()] == ["u1", "u1"]


def test_word_bounds_are_ascii(spark):
    """As in SQL: a letter with a mark ends a run of word characters."""
    d = spark.createDataFrame([("denverö",), ("ödenver",), ("denvers",), ("äTX 78701",), ("xTX 78701",)], "t string")
    assert [r[0] for r in d.select(mk.us_hint(F.col("t"))).collect()] == [True, True, False, True, False]
    s = spark.createDataFrame([("für öEURö da", 500), ("für öEURx da", 500)], "text_sample string, word_count int").withColumns({"title": F.lit(""), "img_count": F.lit(9), "domain": F.lit("a.de"), "us_hint": F.lit(False)})
    assert [r["reject_reason"] for r in scoring.hard_filter(s).collect()] == ["non-us:currency", None]


def test_scores(spark):
    dims = dict.fromkeys(scoring.WEIGHTS, 60) | {"entity_id": "e"}
    scored = spark.createDataFrame([dims])
    ev = lambda **k: spark.createDataFrame([{"entity_id": "e", "fit_score": None, "creative_score": None, "need_score": None, "conversion_score": None, "worth_contacting": True, "veto_reason": None} | k], "entity_id string, fit_score int, creative_score int, need_score int, conversion_score int, worth_contacting boolean, veto_reason string")
    assert scoring.final_score(scored, ev(need_score=10)).first()["score"] == 60
    assert scoring.final_score(scored, ev(need_score=99)).first()["score"] == 66
    veto = scoring.final_score(scored, ev(worth_contacting=False, veto_reason="chain")).first()
    assert (veto["score"], veto["reason"], veto["vetoed"]) == (35, "chain", True)


def test_category_counts_and_windows(spark):
    rows = [(f"c{i}", date(2026, 9, 5)) for i in range(6) for _ in range(6 - i)]
    d = spark.createDataFrame(rows, "c string, day date")
    got = {r["label"]: r["n"] for r in metrics.category_counts(d, "c", (date(2026, 9, 1), date(2026, 10, 1), "day")).collect()}
    assert got == {"c0": 6, "c1": 5, "c2": 4, "c3": 3, "Other": 3} and sum(got.values()) == 21
    assert metrics.window_bounds("month", date(2026, 9, 8)) == (date(2026, 9, 1), date(2026, 9, 9), "day")
    assert metrics.window_bounds("year", date(2026, 9, 8), date(2026, 8, 30)) == (date(2026, 8, 30), date(2026, 8, 31), "hour")


def test_classify_skips_and_isolation(spark):
    f = spark.createDataFrame([(1, "it is Already Great", None, 1), (2, "nothing", 1, 2), (3, "done", 2, 3)], "feedback_id int, reason string, version int, created_at int")
    c = spark.createDataFrame([(7, 0, ["already great", "", ""]), (8, 1, [""])], "category_id int, position int, keywords array<string>")
    assert {(r["feedback_id"], r["category_id"]) for r in learning.classify_skips(f, c, 2).collect()} == {(1, 7), (2, None)}


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda d, h=0: datetime(2024, 1, d, h)
    pages = spark.createDataFrame([("a", "1", at(1)), ("a", "1", at(2)), ("a", "2", at(3)), ("b", "1", at(1)), ("a", "1", at(4))], "url string, content_hash string, fetched_at timestamp")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages")
    s = spark.readStream.schema(pages.schema).parquet(f"{tmp_path}/pages")
    ar.run_available(ar.change_stream(s, f"{tmp_path}/changes", f"{tmp_path}/last", buckets=4), f"{tmp_path}/c1", spark)
    got = spark.read.parquet(f"{tmp_path}/changes")
    assert sorted((r["url"], r["content_hash"]) for r in got.collect()) == [("a", "1"), ("a", "1"), ("a", "2"), ("b", "1")]


def test_bounces_and_candidates_by_batch(spark, tmp_path):
    at = datetime(2024, 1, 1)
    n = spark.createDataFrame([("m1", "", "to a@x.com", "", "", at), ("m1", "", "to a@x.com", "", "", at), ("m2", "", "none", "", "", at)], "message_id string, subject string, summary string, to_address string, sender string, received_at timestamp")
    sent = spark.createDataFrame([("a@x.com", 7, 1)], "email string, outreach_id long, entity_id long")
    n.coalesce(1).write.parquet(f"{tmp_path}/n/a")
    s = spark.readStream.schema(n.schema).parquet(f"{tmp_path}/n/*")
    for _ in range(2):
        ar.run_available(ar.bounce_stream(s, lambda: sent, f"{tmp_path}/out"), f"{tmp_path}/c", spark)
        n.write.parquet(f"{tmp_path}/n/b", mode="ignore")
    assert sorted((r["message_id"], r["outreach_id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("m1", 7), ("m2", None)]


def test_oldest_names_the_group(spark):
    c = spark.createDataFrame([(1, "p", "a.com", datetime(2024, 1, 5)), (2, "p", "a.com", datetime(2024, 1, 2)), (3, "p", "b.com", None)], "cand_id long, profile_id string, domain string, first_seen timestamp")
    c = c.withColumns({k: F.lit(None).cast("string") for k in ("instagram", "tiktok", "etsy")})
    keys = c.select("cand_id", F.lit("strong").alias("tier"), F.lit("domain").alias("kind"), F.concat(F.lit("domain:"), "domain").alias("key"))
    assert {(r["cand_id"], r["component"], r["foreign"]) for r in linkage.resolve_entities(c, keys).collect()} == {(1, 2, False), (2, 2, False), (3, 3, False)}


def test_private_hosts_and_praise(spark):
    bad = ["localhost", "127.0.0.1", "0.0.0.0", "10.1.2.3", "192.168.1.1", "172.16.0.1", "172.31.255.254", "169.254.169.254", "metadata.google.internal", "instance-data", "db.internal", "printer.local", "::1", "[::1]", "router", "http://nas.lan./x", "tv.home", None, ""]
    good = ["example.com", "www.brand.co.uk", "shop.mothandmoon.studio", "172.32.0.1", "11.0.0.1", "https://u@a.com:8080/p?q=localhost"]
    assert column(spark, bad, ident.is_public) == [False] * len(bad) and column(spark, good, ident.is_public) == [True] * len(good)
    praise = spark.createDataFrame([(p,) for p in ("aesthetic personality and unique products", "strong brand identity", "brand personality and handmade products", "the ash-glazed vase collection", "that you name each mug after a customer", "short")], "praise string")
    assert [r[0] for r in scoring.specific_compliment(praise).collect()] == ["the ash-glazed vase collection", "that you name each mug after a customer"]


def test_configuration_is_never_cut(spark):
    with pytest.raises(ValueError, match="more than 3 rows"):
        sg.config(spark.range(4), 3)
    assert sg.config(spark.range(3), 3).count() == 3


def test_ghosts_in_batch(spark):
    at = lambda d: datetime(2024, 1, d)
    e = spark.createDataFrame([(1, "contact", at(1)), (2, "contact", at(1)), (2, "reply", at(2)), (3, "contact", at(9))], "entity_id long, kind string, at timestamp")
    assert [r["entity_id"] for r in ar.ghosts_in_batch(e, 5, F.lit(at(10))).collect()] == [1]


def test_ghost_stream_runs_in_the_jvm_and_sees_each_silence(spark, tmp_path):
    at = lambda d: datetime(2024, 1, d)
    rows = [(1, "contact", at(1)), (1, "contact", at(20)), (2, "contact", at(1)), (2, "reply", at(2)), (3, "contact", at(1)), (3, "contact", at(3)), (4, "contact", at(28)), (5, "reply", at(30))]
    e = spark.createDataFrame(rows, "entity_id long, kind string, at timestamp")
    found = []
    for n, batches in enumerate(([e], [e.where("at < '2024-01-10'"), e.where("at >= '2024-01-10'")])):
        path, ghosts = f"{tmp_path}/{n}", []
        for b in batches:
            b.write.mode("append").parquet(f"{path}/in")
            out = ar.ghost_timer(spark.readStream.schema(e.schema).parquet(f"{path}/in"), 5)
            ar.run_available(out.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out"), f"{path}/state", spark)
        assert "Pandas" not in out._jdf.queryExecution().analyzed().toString()
        found.append(sorted((r["entity_id"], r["ghosted_at"].day) for r in spark.read.schema(out.schema).parquet(f"{path}/out").collect()))
    assert found == [[(1, 6), (1, 25), (3, 8)]] * 2


def test_phrases_are_found_as_their_pattern_says(spark):
    patterns = [*rules.CONTENT_FLAGS.values(), *rules.HTML_FLAGS.values(), scoring.PARKED, scoring.PLACEHOLDER]
    texts = ["", "where to buy", "whereto buy", "a pop-up", "popup", "pop up", "fairexcom", "faire.com", "dm us to order", "dm you to order", "order via instagram", "squareup.com/appointments", "book now", "bookan", "schedule an call", "/news", "parked free courtesy", "parked courtesy", "domain for sale", "domain is for sale", "under construction", "the cut", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in patterns:
        for collapsed in (False, True):
            assert d.where(~mk.found(F.col("t"), p, collapsed).eqNullSafe(F.col("t").rlike(p))).count() == 0
    wide = spark.createDataFrame([("book \t an",)], "t string")
    assert wide.where(mk.found(F.col("t"), rules.HTML_FLAGS["has_booking"])).count() == 1
