"""Discovery: places, domains and titles as candidates, the link frontier, sweeps and rotation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import identity as ident
from tessera.functions import markup as mk
from tessera.functions.rules import FINAL_STATES, MARKETPLACES, QUALIFY_BAR

# Fixed values.
SKIP_HOSTS = ["google.com", "gstatic.com", "googletagmanager.com", "google-analytics.com", "fonts.googleapis.com", "fonts.gstatic.com", "cloudflare.com", "jsdelivr.net", "cdnjs.cloudflare.com", "unpkg.com", "shopify.com", "cdn.shopify.com", "squarespace.com", "wix.com", "wordpress.org", "w3.org", "schema.org", "apple.com", "microsoft.com", "adobe.com", "stripe.com", "paypal.com", "klaviyo.com", "mailchimp.com", "shopifycdn.com", "wp.com", "gravatar.com"]
PEER_HINTS = ["stockist", "stockists", "retailers", "where to buy", "shop the collection", "brands we love", "friends", "collaborators", "collaboration", "collab", "featured", "as seen", "press", "partners", "makers", "artists we", "sister brand", "our friends", "shop small", "directory", "wholesale"]
CHAIN_NAME, CHAIN_NUMBER = r"\b(inc|llc|corp|corporation|franchise|outlet|superstore|warehouse)\b", r"#\s?\d+|\bno\.\s?\d+\b"
TLDS = ["com", "co", "shop", "studio", "store", "art", "design", "us", "net", "club", "boutique"]
OTHER_TRADES = ["tile", "sanitary", "refractor", "abrasive", "insulation", "porcelainware", "bearing", "granite", "marble", "flooring", "plumbing", "hvac", "roofing", "concrete", "masonry", "kitchenbath", "countertop", "industrial", "technical", "advanced", "solutions", "systems", "engineering", "supplies", "equipment", "corporation", "holdings", "international", "globalgroup", "manufacturing", "distributor", "wholesaleinc", "hospital", "clinic", "dental", "insurance", "realty", "mortgage", "lawfirm", "attorney", "bankof", "university", "college"]
OTHER_COUNTRIES = ["saudi", "emirates", "dubai", "qatar", "kuwait", "india", "indian", "pakistan", "bangla", "nigeria", "kenya", "malaysia", "indonesia", "vietnam", "thai", "philippine", "brasil", "brazil", "mexico", "espana", "deutschland", "france", "italia", "nippon", "korea", "shanghai", "beijing", "guangzhou", "shenzhen", "australia", "canada", "newzealand"]
KEPT_TAGS = ["shop", "craft", "cuisine", "opening_hours", "phone", "addr:street", "addr:city", "addr:state", "addr:postcode", "contact:instagram", "description", "wheelchair", "payment:credit_cards", "air_conditioning", "second_hand", "organic", "brand"]


def tag(key: str) -> Column:
    return F.coalesce(F.element_at("tags", key), F.lit(""))


def is_chain() -> Column:
    """Whether an element's tags (map ``tags``) mark or name a chain."""
    name = F.lower(tag("name"))
    marked = F.greatest(*[tag(k) for k in ("brand:wikidata", "brand:wikipedia", "wikidata", "wikipedia")]) != ""
    brand = (tag("brand") != "") & (tag("name") != "") & (tag("brand") != tag("name"))
    return marked | brand | ((tag("operator") != "") & (tag("operator") != tag("name"))) | name.rlike(mk.ascii_bounds(CHAIN_NAME)) | name.rlike(mk.ascii_bounds(CHAIN_NUMBER))


def drop_chains(elements: DataFrame) -> DataFrame:
    return elements.where(~is_chain())


def keep_tags(c: Column, keys: list[str] = KEPT_TAGS, most: int = 200) -> Column:
    """Known tags alone, with values cut."""
    return F.transform_values(F.map_filter(c, lambda k, v: k.isin(keys)), lambda k, v: F.substring(v, 1, most))


def place_niche(elements: DataFrame, claims: DataFrame, fallback: str) -> DataFrame:
    """Elements (id, field, value) by the first niche (claims: field, value, niche, place) that claims the value."""
    hit = elements.join(claims, ["field", "value"])
    first = hit.groupBy("id").agg(F.min(F.struct("place", "niche"))["niche"].alias("niche"))
    return elements.select("id").distinct().join(first, "id", "left").select("id", F.coalesce("niche", F.lit(fallback)).alias("niche"))


def place_candidates(elements: DataFrame, niches: DataFrame, metro: str, exclude: str | None = None) -> DataFrame:
    """Elements (id, tags) to candidates: one per domain, or per name and street for those without a site but with a way to reach them."""
    e = drop_chains(elements)
    if exclude:
        e = e.where(~F.lower(tag("name")).rlike(exclude))
    site = ident.domain(tag("website"))
    contact = (tag("contact:instagram") != "") | (tag("phone") != "")
    e = e.withColumn("domain", site).where(F.col("domain").isNotNull() | ((tag("name") != "") & contact))
    place = F.when((tag("addr:city") != "") & (tag("addr:state") != ""), F.concat_ws(", ", tag("addr:city"), tag("addr:state"))).otherwise(metro)
    key = F.coalesce("domain", F.concat_ws("|", F.lower(tag("name")), F.lower(tag("addr:street"))))
    first = e.withColumn("key", key).groupBy("key").agg(F.min("id").alias("id"))
    out = e.join(first, "id").join(niches, "id", "left")
    return out.select("id", "domain", tag("name").alias("display_name"), "niche", place.alias("location_text"), F.lit(f"osm:{metro}").alias("discovery_source"))


def search_spec(profiles: DataFrame) -> DataFrame:
    """Profiles (profile_id, niches: map of slug to map of field to values) to the distinct values asked for per field."""
    n = profiles.select("profile_id", F.explode("niches").alias("niche", "fields")).select("profile_id", F.explode("fields").alias("field", "values"))
    return n.groupBy("profile_id", "field").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))).alias("values"))


def plausible_domain(dom: Column) -> Column:
    name, last = F.split_part(dom, F.lit("."), F.lit(1)), F.split_part(dom, F.lit("."), F.lit(-1))
    words = "|".join(OTHER_TRADES + OTHER_COUNTRIES)
    return last.isin(TLDS) & F.length(name).between(5, 40) & ~name.rlike(r"^\d") & ~name.rlike(r"\d{3,}") & ~dom.rlike(f"(?i){words}")


def apex_domains(certs: DataFrame, keywords: DataFrame) -> DataFrame:
    """(keyword, domain): plain two-label names of certificates (name_value, one a line) that hold a keyword's first 6 characters.

    A name's runs of 1 to 6 characters are joined with the keywords' beginnings, so work grows with the names alone.
    """
    n = certs.select(F.explode(F.split("name_value", "\n")).alias("n")).select(F.lower(F.trim("n")).alias("domain")).where("domain <> '' and instr(domain, '*') = 0 and instr(domain, ' ') = 0")
    n = n.where((F.size(F.split("domain", r"\.")) == 2) & plausible_domain(F.col("domain"))).distinct()
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(6), F.length("domain"))), lambda k: F.transform(F.sequence(F.lit(1), F.length("domain") - k + 1), lambda i: F.substring(F.col("domain"), i, k))))
    r = n.select("domain", F.explode(F.array_distinct(runs)).alias("run"))
    return r.join(keywords.select("keyword", F.substring("keyword", 1, 6).alias("run")).distinct(), "run").select("keyword", "domain").distinct()


def seed_lines(lines: DataFrame) -> DataFrame:
    """Lines (line) with ``kind`` instagram, tiktok, etsy, handle, site or rejected, and the ``value``; comments and blanks go."""
    s = F.trim("line")
    dom = ident.domain(s)
    site = dom.isNotNull() & ~dom.isin(MARKETPLACES) & ~s.rlike(r"\s")
    kind = F.when(s.contains("instagram.com/"), "instagram").when(s.contains("tiktok.com/"), "tiktok").when(s.contains("etsy.com/"), "etsy").when(s.startswith("@") & (F.length(s) > 1), "handle").when(site, "site").otherwise("rejected")
    value = F.when(kind == "instagram", ident.handle(s, "instagram.com")).when(kind == "tiktok", ident.handle(s, "tiktok.com")).when(kind == "etsy", ident.shop_handle(s)).when(kind == "handle", F.lower(F.substring(s, 2, 200))).when(kind == "site", dom).otherwise(F.substring(s, 1, 120))
    return lines.withColumns({"kind": kind, "value": value}).where((s != "") & ~s.startswith("#"))


def title_keywords(titles: DataFrame, noise: str, people: list[str], stop: list[str]) -> DataFrame:
    """Distinct domain-shaped keywords of titles (title)."""
    base = F.trim(F.regexp_replace("title", r"\s*\([^)]*\)\s*$", ""))
    t = titles.where(~F.col("title").rlike(f"(?i){noise}") & ~F.lower(F.trim("title")).isin(people)).withColumn("base", base).where("base <> '' and instr(base, ':') = 0")
    token = F.regexp_replace(F.lower("base"), "[^a-z0-9]", "")
    return t.select(token.alias("keyword")).where(F.length("keyword").between(3, 22) & ~F.col("keyword").isin(stop) & ~F.col("keyword").rlike("^[0-9]")).distinct()


def peer_links(links: DataFrame, depth: int = 0, most: int = 25, least: int = 20) -> DataFrame:
    """Outbound links (page_id, page_url, url, label, pos) that may lead to peers: the best of each domain, ``most`` a page."""
    dom, label = ident.domain(F.col("url")), F.lower("label")
    path = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1), "/+$", "")
    segments = F.size(F.filter(F.split(path, "/"), lambda x: x != ""))
    hint = F.lit(False)
    for h in PEER_HINTS:
        hint = hint | label.contains(h)
    plain = (label != "") & (F.length(label) <= 40) & ~label.rlike(mk.ascii_bounds(r"\b(home|shop|about|contact|privacy|terms|faq|cart|login|search|blog)\b"))
    score = F.lit(10) + F.when(hint, 30).otherwise(0) + F.when(segments == 0, 25).when(segments <= 1, 10).otherwise(-10) + F.when(plain, 8).otherwise(0)
    p = links.withColumns({"domain": dom, "priority": score}).where(F.col("domain").isNotNull() & (F.col("domain") != ident.domain(F.col("page_url"))) & ~F.col("domain").isin(SKIP_HOSTS + MARKETPLACES))
    p = p.where(~F.col("url").rlike(r"(?i)\.(pdf|zip|jpe?g|png|gif|svg|mp4|css|js)(\?|$)") & (F.col("priority") >= least))
    best = p.groupBy("page_id", "domain").agg(F.max(F.struct("priority", (-F.col("pos")).alias("first"), "label")).alias("m"))
    w = Window.partitionBy("page_id").orderBy(F.desc("m.priority"), F.desc("m.first"))
    reason = F.when(F.col("m.label") != "", F.concat(F.lit('link:"'), F.substring(F.lower("m.label"), 1, 60), F.lit('"'))).otherwise("link")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("page_id", "domain", F.concat(F.lit("https://"), F.col("domain")).alias("url"), F.col("m.priority").alias("priority"), F.lit(depth + 1).alias("depth"), reason.alias("reason"))


def frontier_add(candidates: DataFrame, entities: DataFrame, frontier: DataFrame) -> DataFrame:
    """New PENDING rows (profile_id, domain, priority): the best candidate of a domain, unless any profile evaluated it or this one queued it."""
    best = candidates.groupBy("profile_id", "domain").agg(F.max("priority").alias("priority"))
    known = entities.where("evaluated_on is not null").select("domain").distinct()
    return best.join(known, "domain", "left_anti").join(frontier.select("profile_id", "domain"), ["profile_id", "domain"], "left_anti").withColumn("status", F.lit("PENDING"))


def frontier_batch(frontier: DataFrame, most: int) -> DataFrame:
    """Each profile's pending rows by priority, then age."""
    w = Window.partitionBy("profile_id").orderBy(F.desc("priority"), "added_on", "url")
    return frontier.where("status = 'PENDING'").withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= most).select("profile_id", "turn", "url")


def frontier_mark(frontier: DataFrame, results: DataFrame) -> DataFrame:
    r = results.select("url", F.col("status").alias("_s"), F.col("at").alias("_at"))
    return frontier.join(r, "url", "left").withColumns({"status": F.coalesce("_s", "status"), "processed_on": F.col("_at")}).drop("_s", "_at")


def stale_entities(entities: DataFrame, as_of: date, days: int = 30, most: int = 100, bar: int = QUALIFY_BAR) -> DataFrame:
    """Due a re-check, oldest first: never evaluated, long ago, or near the bar and a third as long ago."""
    at, s = F.col("evaluated_on"), F.col("score")
    due = at.isNull() | (at < F.date_sub(F.lit(as_of), days)) | (s.between(bar - 12, bar - 1) & (at < F.date_sub(F.lit(as_of), days // 3)))
    return entities.where(due & ~F.col("state").isin(FINAL_STATES)).orderBy(at.asc_nulls_first(), "entity_id").limit(most).select("entity_id", "evaluated_on")


def no_site_batch(entities: DataFrame, as_of: date, days: int = 30, most: int = 40) -> DataFrame:
    at = F.col("evaluated_on")
    due = (F.col("has_website") == F.lit(False)) & ~F.col("state").isin(FINAL_STATES) & (at.isNull() | (at < F.date_sub(F.lit(as_of), days)))
    return entities.where(due).orderBy(at.asc_nulls_first(), "entity_id").limit(most).select("entity_id")


def batch_split(fresh: DataFrame, stale: DataFrame, room: int) -> DataFrame:
    """70 % of the room, rounded up, for fresh rows (id, turn), the rest for stale ones (id, turn)."""
    n = -(-room * 7 // 10)
    return fresh.orderBy("turn").limit(n).select("id", F.lit("fresh").alias("kind")).unionByName(stale.orderBy("turn").limit(room - n).select("id", F.lit("stale").alias("kind")))


def reject_chains(entities: DataFrame, sightings: DataFrame, least: int = 3) -> DataFrame:
    """Entities (profile_id, domain, state, reject_reason) with the chains of their profile rejected; those in contact are spared.

    ``sightings``: profile_id, domain, source. A domain under ``least`` or more sources of a profile is a chain there.
    """
    chains = sightings.where("domain is not null").groupBy("profile_id", "domain").agg(F.count_distinct("source").alias("_n")).where(F.col("_n") >= least)
    j = entities.join(chains, ["profile_id", "domain"], "left")
    hit = F.col("_n").isNotNull() & ~F.col("state").isin("CONTACTED", "REPLIED", "CONVERSATION", "CLIENT")
    return j.withColumns({"reject_reason": F.when(hit, "chain:multi-metro").otherwise(F.col("reject_reason")), "state": F.when(hit, "REJECTED").otherwise(F.col("state"))}).drop("_n")


def cross_metro_chains(sightings: DataFrame, least: int = 3) -> DataFrame:
    """Domains seen under ``least`` or more sources."""
    return sightings.groupBy("domain").agg(F.count_distinct("source").alias("sources")).where(F.col("sources") >= least)


def round_robin(boxes: DataFrame, group: str, name: str) -> DataFrame:
    """The first box of every group, then the second, and so on."""
    w = Window.partitionBy(group).orderBy(name)
    return boxes.withColumn("turn", F.row_number().over(w)).select(group, name, "turn").orderBy("turn", group)


def metros_for(base: DataFrame, regions: DataFrame) -> DataFrame:
    """Base boxes (slug, turn) with regions (slug, kind, active, acknowledged, priority): added ones first, blocked ones gone."""
    added = regions.where("kind = 'city' and active and acknowledged").select("slug", (-F.col("priority")).alias("turn"), F.lit(0).alias("tier"))
    blocked = regions.where("kind = 'block' and active").select("slug")
    rest = base.join(added.select("slug"), "slug", "left_anti").select("slug", "turn", F.lit(1).alias("tier"))
    return added.unionByName(rest).join(blocked, "slug", "left_anti").orderBy("tier", "turn", "slug")


def due_first(items: DataFrame, cursor: DataFrame, key: str, before: Column, most: int) -> DataFrame:
    """Items (key, place) not run since ``before``, least recently run first."""
    j = items.join(cursor, key, "left").where(F.col("last_run").isNull() | (F.col("last_run") < before))
    return j.orderBy(F.col("last_run").asc_nulls_first(), "place").limit(most).select(key, "last_run")


def box_around(lat: Column, lon: Column, radius: float) -> Column:
    """South, west, north, east; longitudes are stretched with latitude, up to 2.2 times."""
    wide = F.least(F.lit(2.2), 1.0 / F.greatest(F.cos(F.radians(lat)), F.lit(0.45))) * radius
    near = lambda c: F.floor(c * 10000 + 0.5) / 10000
    return F.struct(near(lat - radius).alias("south"), near(lon - wide).alias("west"), near(lat + radius).alias("north"), near(lon + wide).alias("east"))


def places_in_boxes(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """Points (id, x, y) in boxes (slug, x0, x1, y0, y1): joined on the cells of a hierarchy of grids, then compared.

    A grid's cells are twice as wide as those of the one below; ``cell`` is the smallest width. A box goes to the first
    grid whose cells are no narrower than it, so it covers four cells at most, however wide it is. A point goes to its cell
    in each grid that has a box: as many rows as boxes differ in powers of two, not in their number.
    """
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    b = boxes.where("x1 >= x0 and y1 >= y0").withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(cell)) / cell) - 1e-9)).cast("int"))
    at = lambda c: F.floor(F.col(c) / (F.pow(F.lit(2.0), F.col("level")) * cell)).cast("long")
    b = b.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1"))))
    # one row
    levels = b.agg(F.collect_set("level").alias("levels"))
    p = points.crossJoin(F.broadcast(levels)).withColumn("level", F.explode("levels")).drop("levels").withColumns({"cx": at("x"), "cy": at("y")})
    return p.join(b, ["level", "cx", "cy"]).where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))).select("id", "slug")


def slug(c: Column, most: int = 60) -> Column:
    """Lower case without accents, other characters as single hyphens."""
    plain = F.translate(F.lower(c), "àáâäãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-|-$", ""), 1, most)


def low_water(frontier: DataFrame, mark: int) -> DataFrame:
    n = frontier.groupBy("profile_id").agg(F.count_if(F.col("status") == "PENDING").alias("pending"))
    return n.withColumn("healthy", F.col("pending") >= mark)


def add_places(places: DataFrame, regions: DataFrame, radius: float = 0.075) -> DataFrame:
    """Geocoded places (name, country, lat, lon, priority) as regions; existing slugs are reported, places abroad wait for acknowledgement."""
    p = places.withColumn("slug", F.concat_ws("-", slug(F.col("name")), F.when(F.col("country") != "us", F.col("country"))))
    old = regions.select(F.col("slug").alias("_s"))
    p = p.join(old, F.col("slug") == F.col("_s"), "left")
    return p.select("slug", F.col("_s").isNotNull().alias("existing"), (F.col("country") == "us").alias("acknowledged"), F.greatest(F.lit(-10), F.least(F.lit(10), F.col("priority"))).alias("priority"), box_around(F.col("lat"), F.col("lon"), radius).alias("box"))
