"""Queries of addresses, links, images and drafts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import contact as ct
from tessera.operators import signals as sg

from .pages import _ANCHORS as ANCHORS
from .pages import CLEAN, PAGES, quoted, sql_host, sql_visible
from .registry import register
from .standins import ENTITIES, entities, table

_PLAIN = "list_transform(regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.]{2,}'), lambda e: lower(regexp_replace(e, '[.]+$', '')))"
_TLDS = "|".join(ct.COUNTRY_TLDS + ct.OTHER_TLDS)
_USABLE = f"length(e) <= 100 AND regexp_matches(e, '(?i)^[^\\s@]+@[^\\s@]+\\.[a-z]{{2,}}$') AND regexp_matches(e, '(?i)\\.({_TLDS})$') AND NOT regexp_matches(e, '{ct.JUNK_EMAIL}')"
_MAILS = "d AS (SELECT doc_id, text || ' ' || ([{0}])[CAST(doc_id % 8 + 1 AS INT)] AS text FROM documents)"
EXTRA = ["", "hello@mara.studio ann.lee@mara.studio", "jobs@x.com info@x.com", "press@y.co Shop@y.co", "noreply@z.com", "a1@q.net sales@q.net", "x@y.zzzz b@c.de.", "logo@2x.png"]
_D = _MAILS.format(quoted(EXTRA))


def docs(spark, sf):
    k = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", "text", F.element_at(F.array(*map(F.lit, EXTRA)), (k % 8 + 1).cast("int"))).alias("text"))


@register("c11_plain_emails", f"WITH {_D} SELECT doc_id, {_PLAIN} AS emails FROM d")
def c11(spark, sf):
    return docs(spark, sf).select("doc_id", ct.plain_emails(F.col("text")).alias("emails"))


@register("c14_usable_email", f"WITH {_D}, x AS (SELECT doc_id, unnest({_PLAIN}) AS e FROM d) SELECT DISTINCT doc_id, e FROM x WHERE {_USABLE}")
def c14(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(ct.plain_emails(F.col("text"))).alias("e")).distinct().where(ct.usable_email(F.col("e")))


_RANK = "CASE " + " ".join(f"WHEN regexp_matches(e, '(?i)^{g}@') THEN {1 + i}" for i, g in enumerate(ct.GENERAL_INBOX)) + f" ELSE {1 + len(ct.GENERAL_INBOX)} END"


@register("c15_pick_email", f"""WITH {_D}, x AS (SELECT doc_id, {_PLAIN} AS l FROM d), u AS (SELECT doc_id, unnest(l) AS e, unnest(range(len(l))) AS i FROM x), r AS (SELECT *, {_RANK} AS r FROM u WHERE NOT regexp_matches(e, '{ct.WRONG_DEPARTMENT}') AND NOT regexp_matches(e, '{ct.AUTOMATED}')),
  p AS (SELECT doc_id, arg_min(e, (CASE WHEN r = {1 + len(ct.GENERAL_INBOX)} AND NOT regexp_matches(e, '[0-9]') AND NOT regexp_matches(e, '(?i)^(all|everyone|everybody)@') THEN 0 ELSE r END, length(e), i)) AS email FROM r GROUP BY 1) SELECT doc_id, email FROM d LEFT JOIN p USING (doc_id)""")
def c15(spark, sf):
    return docs(spark, sf).select("doc_id", ct.pick_email(ct.plain_emails(F.col("text"))).alias("email"))


_SOC = "CASE page_id % 4 WHEN 0 THEN '<a href=\"https://www.instagram.com/i' || page_id || '\">i</a><a href=\"https://instagram.com/second\">j</a>' WHEN 1 THEN '<a href=\"https://etsy.com/shop/e\">e</a>' ELSE '' END"


def sql_pages(html: str) -> str:
    """The pages' text and anchors with something put to their html, in the same words in Spark and in SQL."""
    return PAGES.replace("FROM pages)", f"FROM (SELECT page_id, url, {html} AS html FROM pages))")


_NETWORK = ", ".join(f"arg_min(url, pos) FILTER (ends_with(host, '{n}.com')) AS {n}" for n in ct.NETWORKS)


@register("c05_social_links", f"WITH {sql_pages(_SOC + ' || html')}, {ANCHORS} SELECT page_id, {_NETWORK} FROM ln WHERE regexp_matches(host, '({'|'.join(ct.NETWORKS)})\\.com$') GROUP BY 1")
def c05(spark, sf):
    p = table(spark, sf, "pages").withColumn("html", F.concat(F.expr(_SOC), "html"))
    return ct.social_links(sg.page_links(p))


_IMG = """html || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '<img src=a width=1 height=2>' WHEN 2 THEN '<img src=b loading="lazy"><img srcset="x">' ELSE '<IMG src=c LOADING="lazy"><script><img width=1></script>' END"""


def sql_shown(*tests: str) -> str:
    every = " AND ".join(f"regexp_matches(t, '{t}')" for t in tests)
    return f"CAST(len(list_filter(regexp_extract_all(clean, '(?i)<img\\b[^>]*>'), lambda t: {every})) AS INT)"


_LAZY = "(?i)loading\\s*=\\s*[\"'']lazy[\"'']"


@register("c07_image_stats", f"WITH {sql_pages(_IMG)} SELECT page_id, {sql_shown('.')} AS img_count, {sql_shown('(?i)width[ ]*=', '(?i)height[ ]*=')} AS img_with_dims, {sql_shown(_LAZY)} AS img_lazy, {sql_shown('(?i)srcset[ ]*=')} AS img_srcset FROM sg")
def c07(spark, sf):
    return ct.image_stats(table(spark, sf, "pages").withColumn("html", F.expr(_IMG)))


# markers of single applications at different places, and words that only look like one
_MARK = ["klaviyo", "Yotpo", "judge.me", "gorgias", "recharge-cdn", "loox.io", "okendo", "attentivemobile", "postscript.io", "rebuyengine"]
_APP = f"CASE WHEN page_id % 3 = 0 THEN ([{quoted(_MARK)}])[CAST(page_id // 3 % {len(_MARK)} + 1 AS INT)] || html WHEN page_id % 3 = 1 THEN html || 'judge.me and judgexme Klaviyo' ELSE html END"
_APPS = ", ".join(f"CASE WHEN regexp_matches(h, '(?i){p}') THEN '{n}' END" for n, p in ct.PAID_APPS)


@register("c10_paid_apps", f"SELECT page_id, list_filter([{_APPS}], lambda x: x IS NOT NULL) AS apps FROM (SELECT page_id, {_APP} AS h FROM pages)")
def c10(spark, sf):
    k = F.col("page_id")
    mark = F.element_at(F.array(*map(F.lit, _MARK)), (F.floor(k / 3) % len(_MARK) + 1).cast("int"))
    html = F.when(k % 3 == 0, F.concat(mark, "html")).when(k % 3 == 1, F.concat("html", F.lit("judge.me and judgexme Klaviyo"))).otherwise(F.col("html"))
    return table(spark, sf, "pages").select("page_id", ct.paid_apps(html).alias("apps"))


@register("c12_xor_emails", "SELECT event_id, ['me' || user_id || '@shop.com'] AS emails FROM events")
def c12(spark, sf):
    plain = F.concat(F.lit("me"), "user_id", F.lit("@shop.com"))
    hexed = F.array_join(F.transform(F.sequence(F.lit(1), F.length(plain)), lambda i: F.lpad(F.lower(F.hex(F.ascii(F.substring(plain, i, F.lit(1))).bitwiseXOR(F.lit(42)))), 2, "0")), "")
    html = F.concat(F.lit('<a data-cfemail="2a'), hexed, F.lit('">x</a>'))
    return table(spark, sf, "events").select("event_id", ct.xor_emails(html).alias("emails"))


# whole texts with a sentence behind them that hides an address, or only seems to
_SAID = "CASE doc_id % 4 WHEN 0 THEN ' write me' || doc_id || ' (at) shop (dot) com please' WHEN 1 THEN ' you' || doc_id || ' at shop dot co' WHEN 2 THEN ' email me at hello dot com' ELSE ' our latest collection at studio.com, bell' || chr(1) || 'shop.com' END"


def sql_written(text: str) -> str:
    """Addresses that a text spells out: separators as single characters, bracketed ones first, then those with a bare "at"."""
    said = f"translate({text}, chr(1) || chr(2) || chr(3), '   ')"
    for pattern, mark in ct.SPELLED:
        said = f"regexp_replace({said}, '{pattern}', chr({ord(mark)}), 'g')"
    found = f"regexp_extract_all({said}, '{ct.WRITTEN}', 1)"
    bare = f"list_filter({found}, lambda s: contains(s, chr(3)) AND lower(split_part(s, chr(3), 1)) NOT IN ({quoted(ct.SENTENCE_WORDS)}))"
    return f"list_transform(list_concat(list_filter({found}, lambda s: contains(s, chr(1))), {bare}), lambda s: lower(regexp_replace(translate(s, chr(1) || chr(2) || chr(3), '@.@'), '\\s*\\.\\s*', '.', 'g')))"


def sql_harvest(html: str, clean: str, text: str) -> str:
    """Addresses of a page or a part of it: mail links, plain ones, hidden ones, spelled ones."""
    byte = lambda at: f"CAST('0x' || substr(h, {at}, 2) AS INT)"
    blobs = f"regexp_extract_all({html}, '(?i)(?:data-cfemail=[\"'']|/cdn-cgi/l/email-protection#)([0-9a-f]{{8,}})', 1)"
    hidden = f"list_filter(list_transform({blobs}, lambda h: lower(array_to_string(list_transform(range(3, length(h), 2), lambda i: chr(xor({byte('i')}, {byte('1')}))), ''))), lambda e: regexp_matches(e, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$'))"
    mail = f"list_transform(regexp_extract_all({clean}, '(?i)mailto:([^\"''?\\s>]+)', 1), lambda e: lower(e))"
    plain = _PLAIN.replace("regexp_extract_all(text,", f"regexp_extract_all({text},")
    return f"list_concat({mail}, {plain}, {hidden}, {sql_written(text)})"


@register("c13_written_emails", f"SELECT doc_id, list_filter(e, lambda x, i: list_position(e, x) = i) AS emails FROM (SELECT doc_id, {sql_written('text || ' + _SAID)} AS e FROM documents)")
def c13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ct.written_emails(F.concat("text", F.expr(_SAID.replace("chr(1)", "char(1)")))).alias("emails"))


@register("c16_copyright_year", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CAST(2010 + page_id % 15 AS INT) END AS copyright_year FROM pages")
def c16(spark, sf):
    t = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<p>© 1999 - "), 2010 + F.col("page_id") % 15, F.lit(" copyright 1998</p>"))).otherwise("<p>© 1997</p>")
    return sg.extract_signals(table(spark, sf, "pages").withColumn("html", F.concat("html", t))).select("page_id", "copyright_year")


# a footer, a mail link, a hidden and a spelled address behind three of four pages
_BEHIND = """html || CASE page_id % 4 WHEN 0 THEN '<p>ann@mara.studio</p><footer>hello@mara.studio</footer><a href="mailto:Ann@mara.studio?x=1">mail</a>' WHEN 1 THEN '<p>press (at) mara (dot) studio</p>' WHEN 2 THEN '<a data-cfemail="2a4243684804494547">x</a><FOOTER>no end, b@c.com' ELSE '' END"""
_FOOT = "array_to_string(regexp_extract_all(html, '(?is)(<footer\\b.*?</footer\\s*>)', 1), chr(10))"


def sql_usable(found: str, most: int) -> str:
    return f"list_filter(list_filter({found}, lambda e, i: list_position({found}, e) = i), lambda e: {_USABLE})[:{most}]"


@register("c11_page_emails", f"""WITH {sql_pages(_BEHIND)}, ft AS (SELECT *, CASE WHEN {_FOOT} <> '' THEN {_FOOT} ELSE substr(html, CAST(floor(length(html) * 0.75) AS INT) + 1) END AS foot FROM sg), fc AS (SELECT *, {CLEAN.replace('html', 'foot')} AS foot_clean FROM ft), fv AS (SELECT *, {sql_visible('foot_clean')} AS foot_text FROM fc),
  hv AS (SELECT page_id, {sql_harvest('foot', 'foot_clean', 'foot_text')} AS low, {sql_harvest('html', 'clean', 'text')} AS every FROM fv), al AS (SELECT *, list_concat(low, every) AS both_lists FROM hv) SELECT page_id, {sql_usable('both_lists', 12)} AS emails, {sql_usable('low', 6)} AS footer_emails FROM al""")
def c11_pages(spark, sf):
    return ct.page_emails(table(spark, sf, "pages").withColumn("html", F.expr(_BEHIND)))


_CHASE = f"""fp AS (SELECT page_id, page_url, pos, replace(url, '/to', '/contact') AS url, host, label FROM ln), sc AS (SELECT page_id, pos, url, lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)) AS path, lower(label) AS label FROM fp WHERE host = {sql_host('page_url')}),
  pt AS (SELECT *, CASE WHEN contains(path, '/contact') THEN 50 WHEN contains(path, '/about') THEN 30 WHEN regexp_matches(path, '/pages/(contact|about|our-story|stockists|wholesale)') THEN 40 WHEN regexp_matches(path, '/(info|support|help|faq|imprint|impressum|legal|team)') THEN 20 WHEN regexp_matches(path, '/(stockists|wholesale|trade|press)') THEN 18 ELSE 0 END
   + CASE WHEN regexp_matches(label, '\\bcontact\\b|get in touch|say hello|reach us|email us') THEN 25 WHEN regexp_matches(label, '\\babout\\b|our story|the studio') THEN 12 ELSE 0 END AS score FROM sc),
  b AS (SELECT page_id, path, arg_max(url, (score, -pos)) AS url, max(score) AS score, arg_max(pos, (score, -pos)) AS pos FROM pt WHERE score > 0 GROUP BY 1, 2), r AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank, url FROM b), w AS (SELECT * FROM r WHERE rank <= 2 AND page_id % 2 = 1)"""


@register("c22_contact_chase", f"""WITH {PAGES}, {ANCHORS}, {_CHASE}, f AS (SELECT page_id, min(rank) AS n, arg_min(url, rank) AS url FROM w WHERE length(url) % 2 = 0 GROUP BY 1)
  SELECT page_id, CASE WHEN n IS NULL THEN [] ELSE ['foot@' || md5(f.url) || '.com', 'page@' || md5(f.url) || '.com'] END || CASE WHEN page_id % 2 = 0 THEN ['home@x.com'] ELSE ['jobs@x.com'] END AS emails FROM pages LEFT JOIN f USING (page_id)""")
def c22(spark, sf):
    p = table(spark, sf, "pages")
    home = p.select("page_id", F.array(F.when(F.col("page_id") % 2 == 0, "home@x.com").otherwise("jobs@x.com")).alias("emails"))
    links = sg.page_links(p).withColumn("url", F.replace("url", F.lit("/to"), F.lit("/contact")))
    work = ct.contact_chase(home, sg.contact_links(links))
    # what the contact pages hold: nothing on every other one
    at = lambda name: F.concat(F.lit(f"{name}@"), F.md5("url"), F.lit(".com"))
    none = F.array().cast("array<string>")
    read = work.select("url").distinct().select("url", *[F.when(F.length("url") % 2 == 0, F.array(*v)).otherwise(none).alias(n) for n, v in (("footer_emails", [at("foot")]), ("emails", [at("foot"), at("page")]))])
    return ct.chased_emails(work, read, home)


_FIND = [r[1] for r in ct.UPSIDES]


def sql_rows(rows) -> str:
    text = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


# two findings in one clause, one of which is first among the upsides and the remedies
_CLAUSE = f"CASE WHEN entity_id % 16 = 15 THEN NULL WHEN entity_id % 16 = 14 THEN 'A shop window' ELSE ([{quoted(_FIND)}])[CAST(entity_id % 14 + 1 AS INT)] || CASE WHEN entity_id % 3 = 0 THEN ' and ' || ([{quoted(_FIND)}])[CAST(entity_id % 5 + 1 AS INT)] ELSE '' END END"
_FIRST = "SELECT entity_id, arg_min(wording, place) AS {0} FROM {1} JOIN {2} ON contains(lower({3}), finding) GROUP BY 1"


@register("q16_draft_table", f"""WITH {ENTITIES}, up(place, finding, wording) AS (VALUES {sql_rows(ct.UPSIDES)}), rm(place, finding, wording) AS (VALUES {sql_rows(ct.REMEDIES)}), cn(place, finding, wording) AS (VALUES {sql_rows(ct.CONSEQUENCES)}),
  o AS (SELECT entity_id, display_name, {_CLAUSE} AS clause FROM ents), u AS ({_FIRST.format('upside', 'o', 'up', 'clause')}), r AS ({_FIRST.format('remedy', 'o', 'rm', 'clause')}), p AS (SELECT entity_id, display_name, coalesce(upside, clause) AS upside, remedy FROM o LEFT JOIN u USING (entity_id) LEFT JOIN r USING (entity_id) WHERE clause IS NOT NULL),
  c AS ({_FIRST.format('consequence', 'p', 'cn', 'upside')}) SELECT entity_id, 'A thought about ' || display_name AS subject, upside, coalesce(remedy, '{ct.PLAIN_REMEDY}') AS remedy, coalesce(consequence, '{ct.PLAIN_CONSEQUENCE}') AS consequence FROM p LEFT JOIN c USING (entity_id)""")
def q16(spark, sf):
    k = F.col("entity_id")
    at = lambda n: F.element_at(F.array(*map(F.lit, _FIND)), (k % n + 1).cast("int"))
    clause = F.when(k % 16 == 14, "A shop window").otherwise(F.concat(at(14), F.when(k % 3 == 0, F.concat(F.lit(" and "), at(5))).otherwise("")))
    e = entities(spark, sf).withColumn("opportunity", F.when(k % 16 < 15, F.concat(F.lit("System opportunity: "), clause, F.when(k % 2 == 0, ".").otherwise(" | more"))))
    rules = [spark.createDataFrame(r, "place int, finding string, wording string") for r in (ct.UPSIDES, ct.REMEDIES, ct.CONSEQUENCES)]
    return ct.draft_table(e, *rules)


@register("q16_no_site_drafts", f"WITH {ENTITIES} SELECT entity_id, 'A home on the web for ' || display_name AS subject, 'a place of its own that people can find' AS upside, 'one page with hours, place and pictures' AS remedy, 'people find others first' AS consequence FROM ents WHERE has_website = false AND email IS NOT NULL AND entity_id % 4 <> 0")
def q16_no_site(spark, sf):
    e = entities(spark, sf)
    return ct.no_site_drafts(e.withColumn("display_name", F.when(F.col("entity_id") % 4 == 0, " ").otherwise(F.col("display_name"))))


@register("q17_display_names", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] END AS name FROM part")
def q17(spark, sf):
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("\n"), "p_name")).when(k % 3 == 1, F.translate("p_name", " ", "-")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(1)))
    return table(spark, sf, "part").select("p_partkey", ct.display_name(raw).alias("name"))


@register("q18_body_check", "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN trim(regexp_replace(split_part(text, chr(10), 1), '[ \\t]+$', '')) || chr(10) || chr(10) || 'unsubscribe: 1 Main St' ELSE trim(regexp_replace(split_part(text, chr(10), 1), '[ \\t]+$', '')) || chr(10) || chr(10) || 'Say unsubscribe.' || chr(10) || '1 Main St' END) AS body, doc_id % 2 = 0 AS was_complete FROM documents")
def q18(spark, sf):
    b = F.concat(F.split_part("text", F.lit("\n"), F.lit(1)), F.when(F.col("doc_id") % 2 == 0, "  \r\n\n\n\nunsubscribe: 1 Main St").otherwise(" \r\n"))
    return ct.body_check(table(spark, sf, "documents").select("doc_id", b.alias("body")), "1 Main St", "Say unsubscribe.").select("doc_id", F.md5("body").alias("body"), "was_complete")
