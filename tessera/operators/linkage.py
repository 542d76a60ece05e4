"""Record linkage: keys of candidates, matches against known records, groups, merges and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import identity as ident
from tessera.operators.graph import components, kept

IDENTITY = ["domain", "instagram", "tiktok", "etsy"]
#: The domain's bit in a mask of IDENTITY.
DOMAIN = 1
#: Rounds in which weak links are taken strictly by age.
PATIENCE = 6


def identity_keys(candidates: DataFrame) -> DataFrame:
    """(cand_id, tier, kind, key) of candidates (website, instagram, tiktok, etsy, contact_email, display_name).

    Exact identifiers are strong. Slugs of them are weak, and so is the name of a candidate without strong keys.
    """
    dom = ident.domain(F.col("website"))
    c = candidates.select("cand_id", F.when(~ident.is_marketplace(dom), dom).alias("domain"), dom.alias("any_domain"), ident.handle(F.col("instagram"), "instagram.com").alias("instagram"), ident.handle(F.col("tiktok"), "tiktok.com").alias("tiktok"), ident.shop_handle(F.col("etsy")).alias("etsy"), ident.email(F.col("contact_email")).alias("email"), ident.name(F.col("display_name")).alias("name"))
    kinds = ["domain", "instagram", "tiktok", "etsy", "email"]
    strong = [F.when(F.col(k).isNotNull(), F.struct(F.lit("strong").alias("tier"), F.lit(k).alias("kind"), F.concat(F.lit(f"{k}:"), F.col(k)).alias("key"))) for k in kinds]
    sources = [F.split_part("any_domain", F.lit("."), F.lit(1)), F.col("instagram"), F.col("tiktok"), F.col("etsy")]
    slugs = F.array_distinct(F.flatten(F.array(*[F.coalesce(ident.slugs(s), F.array().cast("array<string>")) for s in sources])))
    weak = F.transform(slugs, lambda s: F.struct(F.lit("weak").alias("tier"), F.lit("slug").alias("kind"), F.concat(F.lit("slug:"), s).alias("key")))
    named = F.when(F.coalesce(*kinds).isNull() & F.col("name").isNotNull(), F.struct(F.lit("weak").alias("tier"), F.lit("name").alias("kind"), F.concat(F.lit("name:"), F.col("name")).alias("key")))
    return c.select("cand_id", F.explode(F.array_compact(F.concat(F.array(*strong), weak, F.array(named)))).alias("k")).select("cand_id", "k.tier", "k.kind", "k.key")


def key_lookup(keys: DataFrame, known: DataFrame) -> DataFrame:
    """Matches of keys against known keys (key, entity_id)."""
    return keys.join(known, "key").select("cand_id", "tier", "key", "entity_id")


def weak_match_filter(matches: DataFrame, candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Strong matches, and weak ones where no identifier that both sides have differs."""
    left = candidates.select("cand_id", *[F.col(k).alias(f"c_{k}") for k in IDENTITY])
    right = entities.select("entity_id", *[F.col(k).alias(f"e_{k}") for k in IDENTITY])
    differ = F.lit(False)
    for k in IDENTITY:
        differ = differ | F.coalesce(F.col(f"c_{k}") != F.col(f"e_{k}"), F.lit(False))
    return matches.join(left, "cand_id").join(right, "entity_id").where((F.col("tier") == "strong") | ~differ).select("cand_id", "tier", "key", "entity_id")


def key_groups(keys: DataFrame) -> DataFrame:
    """(cand_id, component) of candidates that share keys: each key's members hang on its smallest one, so a key with many members makes no pairs."""
    low = keys.groupBy("key").agg(F.min("cand_id").alias("b"))
    links = keys.join(low, "key").select(F.col("cand_id").alias("a"), "b")
    groups = components(links)
    return keys.select("cand_id").distinct().join(groups, F.col("cand_id") == F.col("node"), "left").select("cand_id", F.coalesce("component", "cand_id").alias("component"))


def profile_groups(candidates: DataFrame, keys: DataFrame) -> DataFrame:
    """(group, profile_id, seen, mask, place, cand_id): candidates with the group that strong keys give them within their profile.

    A group is named by its oldest member (first_seen where there is such a column, then cand_id). ``mask`` says which
    identifiers of IDENTITY the group has. Groups of one profile never share an identifier's value, since each is a strong
    key, but for the domain of a marketplace: ``place``, where it is the group's only domain.
    """
    seen = F.coalesce("first_seen", F.lit("9999-12-31").cast("timestamp")) if "first_seen" in candidates.columns else F.lit("9999-12-31").cast("timestamp")
    has = sum((F.when(F.col(k).isNotNull(), 1 << i).otherwise(0) for i, k in enumerate(IDENTITY)), F.lit(0))
    who = candidates.select("cand_id", F.coalesce(F.col("profile_id").cast("string"), F.lit("")).alias("profile_id"), seen.alias("own_seen"), has.alias("has"), "domain")
    own = keys.where("tier = 'strong'").join(who, "cand_id").select("cand_id", F.concat_ws("|", "profile_id", "key").alias("key"))
    named = who.join(key_groups(own), "cand_id", "left").withColumn("component", F.coalesce("component", "cand_id"))
    low = F.min("domain")
    first = named.groupBy("component").agg(F.min(F.struct("own_seen", "cand_id")).alias("first"), F.bit_or("has").alias("mask"), F.when((low == F.max("domain")) & ident.is_marketplace(low), low).alias("place"))
    return named.join(first, "component").select(F.col("first.cand_id").alias("group"), "profile_id", F.col("first.own_seen").alias("seen"), "mask", "place", "cand_id")


def oldest_fitting(groups: DataFrame, held: DataFrame) -> DataFrame:
    """(group, hub, mask, place, seen): for each group the oldest older one that has a weak key of it and no other value of an identifier.

    A key's groups are known by the oldest of each mask and place, of which there are at most so many as the marketplaces
    give, so a key that many groups have makes no pairs.
    """
    at = held.join(groups, "group")
    tops = at.groupBy("profile_id", "key", "mask", "place").agg(F.min(F.struct("seen", "group")).alias("age"))
    tops = tops.groupBy("profile_id", "key").agg(F.collect_list(F.struct("age", "mask", "place")).alias("tops"))

    def fits(t):
        both = t["mask"].bitwiseAND(F.col("mask"))
        return ((both == 0) | ((both == DOMAIN) & F.coalesce(t["place"] == F.col("place"), F.lit(False)))) & (t["age"] < F.struct("seen", "group"))

    choice = at.join(tops, ["profile_id", "key"]).select("group", "mask", "place", "seen", F.array_min(F.transform(F.filter("tops", fits), lambda t: t["age"])).alias("hub"))
    return choice.where("hub is not null").groupBy("group", "mask", "place", "seen").agg(F.min("hub")["group"].alias("hub"))


def accepted(names: DataFrame, turn: int) -> DataFrame:
    """(group, hub) of the groups that join their hub in this round.

    Groups join hubs that join no other one themselves, so the oldest come first. Where chains of names last longer than
    PATIENCE rounds, a hash of group and round decides which hubs stay, so further rounds grow with a chain's logarithm.
    Of the groups that bring a hub an identifier the oldest gives it, and a group joins if it gives all that it brings or
    brings the same: the oldest group at a hub always joins.
    """
    bits = [1 << i for i in range(len(IDENTITY))]
    movers = names.withColumn("age", F.struct("seen", "group"))
    if turn >= PATIENCE:
        stay = names.join(names.select(F.col("hub").alias("group")).distinct(), "group", "left_semi").where(F.xxhash64("group", F.lit(turn)).bitwiseAND(F.lit(1)) == 0)
        movers = movers.join(stay.select("group"), "group", "left_anti")
    movers = movers.join(movers.select(F.col("group").alias("hub")), "hub", "left_anti")
    claims = movers.groupBy("hub").agg(*[F.min(F.when(F.col("mask").bitwiseAND(F.lit(b)) > 0, F.struct("age", "place"))).alias(f"first_{b}") for b in bits])
    mine = F.lit(True)
    for b in bits:
        same = F.col(f"first_{b}.age") == F.col("age")
        if b == DOMAIN:
            same = same | F.coalesce(F.col(f"first_{b}.place") == F.col("place"), F.lit(False))
        mine = mine & ((F.col("mask").bitwiseAND(F.lit(b)) == 0) | same)
    return movers.join(claims, "hub").where(mine).select("group", "hub")


def foreign_groups(groups: DataFrame, strong: DataFrame) -> DataFrame:
    """(group, owner): groups that share a strong key (group, key) with an older group of another profile, and that one.

    A foreign group owns no key, so a third group may own what it shares with the foreign one alone.
    """
    held = strong.join(groups, "group")
    several = held.groupBy("key").agg(F.min("profile_id").alias("low"), F.max("profile_id").alias("high")).where("low <> high").select("key")
    left, out = kept(held.join(several, "key").select("key", "group", "profile_id", F.struct("seen", "group", "profile_id").alias("age")), "contested"), None
    while True:
        first = left.groupBy("key").agg(F.min("age").alias("first"))
        owner = left.join(first, "key").groupBy("group", "profile_id").agg(F.min("first").alias("owner"))
        # an owner is sure only where no older group of another profile shares a key with it
        sure = owner.where(F.col("owner.profile_id") == F.col("profile_id")).select(F.col("group").alias("sure"))
        gone = owner.where(F.col("owner.profile_id") != F.col("profile_id")).join(sure, F.col("owner.group") == F.col("sure"), "left_semi")
        gone = kept(gone.select("group", F.col("owner.group").alias("owner")), "foreign")
        if gone.isEmpty():
            return out if out is not None else gone
        out = gone if out is None else out.unionByName(gone)
        left = kept(left.join(gone.select("group"), "group", "left_anti"), "contested")


def resolve_entities(candidates: DataFrame, keys: DataFrame) -> DataFrame:
    """(cand_id, component, foreign): candidates that are one business.

    candidates: cand_id, profile_id, the identifiers of IDENTITY and maybe first_seen. Strong keys join whatever shares
    them, within a profile. Weak keys then join groups as long as no identifier gets two values in a group: round after round each
    group names the oldest older one that it may join, until none can name one. What comes out hangs on ages and ids, not
    on the order of rows. A component is named by its oldest member. Groups of different profiles are never merged: a group
    that shares a strong key with an older group of another profile is ``foreign``, and its component is the owner's.
    """
    # read many times below, and dear to make
    keys = kept(keys.select("cand_id", "tier", "key"), "keys")
    members = kept(profile_groups(candidates, keys), "members")
    groups = kept(members.select("group", "profile_id", "seen", "mask", "place").distinct(), "groups")
    weak = keys.where("tier = 'weak'").join(members.select("cand_id", "group", "profile_id"), "cand_id").select("group", "profile_id", "key").distinct()
    shared = weak.groupBy("profile_id", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    every, held, now, turn = groups, kept(weak.join(shared, ["profile_id", "key"]).select("group", "key"), "held"), None, 0
    while True:
        names = kept(oldest_fitting(groups, held), "names")
        if names.isEmpty():
            break
        step, turn = kept(accepted(names, turn), "accepted"), turn + 1
        top = lambda d, step=step: d.join(step, "group", "left").withColumn("group", F.coalesce("hub", "group")).drop("hub")
        # a hub is older than all that join it
        groups = kept(top(groups).groupBy("group", "profile_id").agg(F.min("seen").alias("seen"), F.bit_or("mask").alias("mask"), F.min("place").alias("place")), "groups")
        held = kept(top(held).distinct(), "held")
        now = kept(top(every.select("group", F.col("group").alias("was")) if now is None else now), "now")
    if now is not None:
        members = kept(members.join(now.select(F.col("was").alias("old"), F.col("group").alias("top")), F.col("group") == F.col("old")).select(F.col("top").alias("group"), "cand_id"), "members")
    strong = keys.where("tier = 'strong'").join(members.select("cand_id", "group"), "cand_id").select("group", "key").distinct()
    foreign = foreign_groups(groups, strong)
    return members.select("cand_id", "group").join(foreign, "group", "left").select("cand_id", F.coalesce("owner", "group").alias("component"), F.col("owner").isNotNull().alias("foreign"))


def merge_records(members: DataFrame, fields: list[str], first: list[str], last: list[str], order: list[Column]) -> DataFrame:
    """One record per component: each field's first filled value in ``order``, earliest and latest times."""
    filled = [F.min(F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.struct(*order, F.col(f).alias("v")))).getField("v").alias(f) for f in fields]
    return members.groupBy("component").agg(*filled, *[F.min(c).alias(c) for c in first], *[F.max(c).alias(c) for c in last])


def repoint_children(children: DataFrame, mapping: DataFrame, order: str) -> DataFrame:
    """Children (entity_id, status, day) moved to winners (entity_id, winner); of drafts of one entity and day one stays."""
    moved = children.join(mapping, "entity_id", "left").withColumn("old", F.col("entity_id")).withColumn("entity_id", F.coalesce("winner", "entity_id")).drop("winner")
    # the winner's own draft goes before the loser's
    w = Window.partitionBy("entity_id", "day", "status").orderBy(F.col("old") != F.col("entity_id"), order)
    return moved.withColumn("n", F.row_number().over(w)).where((F.col("status") != "DRAFT") | (F.col("n") == 1)).drop("n", "old")


def enrich_existing(entities: DataFrame, candidates: DataFrame, fields: list[str]) -> DataFrame:
    """Blanks filled from candidates of the same entity_id; nothing is overwritten."""
    new = candidates.select("entity_id", *[F.col(f).alias(f"_{f}") for f in fields], F.col("has_website").alias("_w"))
    j = entities.join(new, "entity_id", "left")
    fill = {f: F.coalesce(F.when(F.col(f) != "", F.col(f)), F.col(f"_{f}")) for f in fields}
    return j.withColumns(fill).withColumn("has_website", F.coalesce("has_website", "_w")).select(*entities.columns)


def ownership(matches: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidates (cand_id, profile_id, entity_id matched) with the owner of their oldest match, and whether it is foreign."""
    j = matches.join(entities.select("entity_id", F.col("profile_id").alias("owner"), "first_seen"), "entity_id")
    oldest = j.groupBy("cand_id", "profile_id").agg(F.min(F.struct("first_seen", "entity_id", "owner")).alias("m"))
    foreign = F.col("m.owner") != F.col("profile_id")
    return oldest.select("cand_id", F.col("m.entity_id").alias("entity_id"), foreign.alias("foreign"), F.when(foreign, "owned-by-another-profile").alias("reason"))


def overlaps(name: Column, label: Column) -> Column:
    """Either contains the other, or a word of 5 characters or more of the name lies in the label."""
    flat = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    words = F.filter(F.split(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "), " "), lambda w: (F.length(w) >= 5) & label.contains(w))
    return (flat != "") & (label.contains(flat) | flat.contains(label) | (F.size(words) > 0))


def preferred_name(rows: DataFrame) -> DataFrame:
    """rows: stored, site_name, domain. The site's name counts only where it fits the domain and the stored one doesn't."""
    label = F.regexp_replace(F.lower(F.split_part("domain", F.lit("."), F.lit(1))), "[^a-z0-9]", "")
    better = overlaps(F.col("site_name"), label) & ~F.coalesce(overlaps(F.col("stored"), label), F.lit(False))
    return rows.withColumn("name", F.when(better, F.col("site_name")).otherwise(F.col("stored")))
