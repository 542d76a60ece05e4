"""Filters, rule scores and states, as projections and joins over whole tables.

Rules are rows of (points, condition, finding); a score is the bounded sum of the points whose condition holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.markup import ascii_bounds, found
from tessera.functions.rules import ADVANCED_STATES, CORPORATE_MARKERS, MARKETPLACES, QUALIFY_BAR, VAGUE_PRAISE, WEIGHTS

# Evidence of a place abroad, in the order in which it is looked for.
PLACES_ABROAD = ["united kingdom", "england", "scotland", "ireland", "deutschland", "germany", "france", "españa", "spain", "italia", "nederland", "australia", "new zealand", "canada", "ontario", "québec", "quebec", "british columbia", "saudi arabia", "united arab emirates", "dubai", "abu dhabi", "mumbai", "delhi", "bangalore", "singapore", "malaysia", "philippines", "jakarta", "bangkok", "shanghai", "shenzhen", "tokyo", "seoul"]
FOREIGN = [
    ("currency", r"(?:£\s?\d|€\s?\d|₹\s?\d|¥\s?\d|\bAED\b|\bSAR\b|\bINR\b|\bGBP\b|\bEUR\b|\bCAD\b|\bAUD\b)"),
    ("address", rf"(?iu)\b(?:{'|'.join(PLACES_ABROAD)})\b"),
    ("uk-postcode", r"\b[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b"),
]
PARKED, PLACEHOLDER = "domain (is )?for sale|buy this domain|parked (free )?courtesy", "coming soon|under construction|opening soon"
GENERAL_INBOX = r"^(info|hello|contact|support|sales|admin|orders|help)@"


def bounded(c: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), c))


def points(rules: list[tuple[int, Column, str]]) -> tuple[Column, Column]:
    """Bounded sum of the points of the rules that hold (null: does not hold), and their findings in order."""
    hold = [(n, F.coalesce(c, F.lit(False)), s) for n, c, s in rules]
    total = sum((F.when(c, n).otherwise(0) for n, c, _ in hold), F.lit(0))
    return bounded(total), F.array_compact(F.array(*[F.when(c, s) for _, c, s in hold]))


def hard_filter(signals: DataFrame) -> DataFrame:
    """Append ``reject_reason``, the first reason against a page, or null."""
    # a column of its own, so that it is made once for all markers
    signals, hay, columns = signals.withColumn("_hay", F.lower(F.concat_ws(" ", "title", "text_sample"))), F.col("_hay"), signals.columns
    words, images = F.coalesce("word_count", F.lit(0)), F.coalesce("img_count", F.lit(0))
    corporate = F.coalesce(*[F.when(hay.contains(m), f"corporate:{m}") for m in CORPORATE_MARKERS])
    # plain words are looked for before the pattern that wants them whole
    named = F.lit(False)
    for place in PLACES_ABROAD:
        named = named | hay.contains(place)
    guarded = {"address": lambda p: F.when(named, F.col("text_sample").rlike(p))}
    foreign = F.coalesce(*[F.when(guarded.get(k, F.col("text_sample").rlike)(ascii_bounds(p)), f"non-us:{k}") for k, p in FOREIGN])
    reason = F.coalesce(
        F.when(F.col("text_sample").isNull(), "no-signals"), corporate, F.when(F.col("domain").isin(MARKETPLACES), "marketplace-only"),
        F.when((words < 40) & (images < 3), "empty-page"), F.when(found(hay, PARKED), "parked-domain"),
        F.when(found(hay, PLACEHOLDER) & (words < 150), "placeholder-site"), F.when(~F.coalesce("us_hint", F.lit(False)), foreign),
    )
    return signals.withColumn("reject_reason", reason).select(*columns, "reject_reason")


def weighted(dims: dict[str, Column]) -> Column:
    """Weighted sum in the weights' order, in doubles, half up; a missing dimension counts 50."""
    total = F.lit(0.0)
    for k, w in WEIGHTS.items():
        total = total + F.coalesce(dims[k].cast("double"), F.lit(50.0)) * F.lit(w / 100)
    return F.floor(total + 0.5)


def rule_score(signals: DataFrame, year: int) -> DataFrame:
    """Append the seven dimensions, the findings and the prescore of pages."""
    c = F.col
    premium = "premium_pricing"
    money, power = points([
        (8, c("domain").isNotNull() & ~c("domain").isin(MARKETPLACES), "custom_domain"), (14, c("platform").isin("shopify", "bigcommerce", "squarespace"), "ecommerce_platform"),
        (14, (c("product_links") >= 8) | (c("add_to_cart_hits") >= 8), "many_products"), (16, c("price_median") >= 60, premium), (16, c("price_max") >= 250, premium),
        (10, (c("img_srcset") >= 6) | ((c("img_count") >= 15) & (c("img_lazy") >= 5)), "professional_photography"), (12, c("has_press"), "press_or_features"), (12, c("has_wholesale"), "stockists_or_wholesale"),
        (10, c("has_team"), "team_page"), (6, c("has_blog"), "active_blog_or_journal"), (6, c("has_email_capture"), "email_capture"), (8, F.size("paid_apps") > 0, "paid_apps_installed"),
        (8, c("collection_links") >= 4, "multiple_collections"), (6, c("has_events"), "events_or_popups"),
    ])
    website, problems = points([
        (30, ~c("has_viewport"), "no mobile viewport"), (18, F.lit(year) - c("copyright_year") >= 3, "old copyright year"), (28, c("platform").isin("carrd", "linktree"), "single-page link site"),
        (12, c("platform").isin("wix", "bigcartel"), "limited template"), (16, (c("img_count") >= 12) & (c("img_lazy") == 0) & (c("img_srcset") == 0), "slow images"),
        (8, (c("img_count") >= 6) & (c("img_with_dims") == 0), "layout shifts"), (10, (c("word_count") < 180) & (c("img_count") > 6), "almost no copy"), (6, F.coalesce("meta_description", F.lit("")) == "", "no meta description"),
    ])
    sells = F.coalesce(c("text_sample"), F.lit("")).rlike("(?i)studio|session|consult|workshop|class|appointment|commission")
    system, systems = points([
        (35, c("manual_order_hint"), "manual orders"), (25, ~c("has_booking") & sells, "no booking flow"), (20, c("has_wholesale") & ~c("has_cart"), "no ordering portal"),
        (12, c("is_ecommerce") & ~c("has_email_capture"), "no email capture"), (10, c("has_events"), "events by hand"), (10, (c("product_links") >= 20) & (F.size("paid_apps") <= 0), "no retention tooling"),
    ])
    emails = F.coalesce("emails", F.array().cast("array<string>"))
    contact = F.when(F.exists(emails, lambda e: ~e.rlike(GENERAL_INBOX)), 95).when(F.size(emails) > 0, 70).when(c("instagram").isNotNull(), 35).otherwise(10)
    personal, _ = points([(30, c("word_count") >= 250, ""), (15, c("has_blog"), ""), (10, c("title") != "", ""), (10, c("meta_description") != "", ""), (15, c("collection_links") >= 2, ""), (10, c("has_press"), ""), (10, c("instagram").isNotNull(), "")])
    fit, _ = points([(40, F.lit(True), ""), (20, c("us_hint"), ""), (10, c("is_ecommerce"), ""), (5, c("has_team"), ""), (10, c("word_count") >= 300, "")])
    dims = {"fit": fit, "money": money, "need": F.greatest(website, system), "creative": F.lit(50), "contactability": contact, "personalization": personal, "conversion": F.lit(50)}
    return signals.withColumns({**dims, "prescore": weighted(dims), "power_signals": power, "website_problems": problems, "system_opportunities": systems})


def score_no_website(places: DataFrame) -> DataFrame:
    """Dimensions and prescore of businesses without a site, from their place tags."""
    c, tag = F.col, lambda k: F.coalesce(F.element_at(F.col("tags"), k), F.lit("")) != ""
    ig, phone = c("instagram").isNotNull(), tag("phone") | c("phone").isNotNull()
    money, power = points([
        (18, tag("addr:street"), "physical_location"), (14, tag("opening_hours"), "regular_trading_hours"), (10, phone, "published_phone_line"), (8, tag("payment:credit_cards"), "card_payments"),
        (6, tag("description"), "describes_itself"), (6, tag("wheelchair"), "fitted_out_premises"), (12, ig, "active_social_presence"), (6, tag("brand"), "established_identity"),
    ])
    need, _ = points([(82, F.lit(True), ""), (8, ig, "")])
    system, _ = points([(30, F.lit(True), ""), (15, c("niche").isin("artist_portfolio", "creative_studio"), "")])
    contact = F.when(c("email").isNotNull(), 80).when(ig & phone, 45).when(ig, 35).when(phone, 25).otherwise(0)
    personal, _ = points([(15, c("display_name").isNotNull(), ""), (25, tag("description"), ""), (20, ig, ""), (15, tag("shop") | tag("craft"), "")])
    fit, _ = points([(45, F.lit(True), ""), (20, tag("addr:state"), ""), (15, tag("craft"), ""), (10, ig, "")])
    dims = {"fit": fit, "money": money, "need": F.greatest(need, system), "creative": F.lit(50), "contactability": contact, "personalization": personal, "conversion": F.lit(50)}
    return places.withColumns({**dims, "prescore": weighted(dims), "power_signals": power})


def final_score(scored: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Fold evaluations (entity_id, fit_score, creative_score, need_score, conversion_score, worth_contacting, veto_reason) in.

    Need is only raised; a veto caps the score at 35 and gives the reason, else the three best dimensions do.
    """
    j = scored.join(evaluations, "entity_id", "left")
    dims = {k: F.col(k) for k in WEIGHTS}
    dims |= {"fit": F.coalesce("fit_score", "fit"), "creative": F.coalesce("creative_score", "creative"), "conversion": F.coalesce("conversion_score", "conversion"), "need": F.greatest(F.col("need"), F.coalesce("need_score", "need"))}
    vetoed = F.coalesce(F.col("worth_contacting") == F.lit(False), F.lit(False))
    ranked = F.array_sort(F.array(*[F.struct((-dims[k]).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(WEIGHTS)]))
    best = F.array_join(F.transform(F.slice(ranked, 1, 3), lambda s: F.concat(s["k"], F.lit(" "), -s["n"])), ", ")
    total = weighted(dims)
    return j.select("entity_id", F.when(vetoed, F.least(total, F.lit(35))).otherwise(total).alias("score"), F.when(vetoed, F.coalesce("veto_reason", F.lit("vetoed"))).otherwise(best).alias("reason"), vetoed.alias("vetoed"))


def assign_state(scored: DataFrame, bar: int = QUALIFY_BAR) -> DataFrame:
    """entity_id, state: by score and veto; advanced states stay."""
    s = F.col("score")
    new = F.when(F.col("vetoed"), "REJECTED").when(s >= bar, "QUALIFIED").when(s >= bar - 15, "NURTURE").otherwise("NOT_NOW")
    return scored.select("entity_id", F.when(F.col("state").isin(ADVANCED_STATES), F.col("state")).otherwise(new).alias("state"))


def apply_scores(entities: DataFrame, scored: DataFrame) -> DataFrame:
    """Entities with scores written back.

    An address and where it is from only if there is none; the niche as stored, else guessed from the page, else the
    evaluation's; findings joined by a bar where the evaluation tells no opportunity.
    """
    j = entities.join(scored, "entity_id", "left")
    return j.select("entity_id", F.coalesce("new_score", "score").alias("score"), F.coalesce(F.when(F.col("niche") != "", F.col("niche")), "page_niche", "evaluation_niche").alias("niche"), F.coalesce("email", "found_email").alias("email"), F.coalesce("contact_source", F.when(F.col("email").isNull(), F.col("found_source"))).alias("contact_source"), F.coalesce("opportunity", F.array_join("findings", " | ")).alias("opportunity"))


def evaluation_candidates(scored: DataFrame, evaluations: DataFrame, remaining: DataFrame, bar: int) -> DataFrame:
    """Scored entities above ``bar`` without an evaluation of their content, the best of each profile within its budget."""
    open_ = scored.where(F.col("prescore") >= bar).join(evaluations.select("entity_id", "content_hash"), ["entity_id", "content_hash"], "left_anti")
    w = Window.partitionBy("profile_id").orderBy(F.desc("prescore"), "entity_id")
    return open_.withColumn("turn", F.row_number().over(w)).join(remaining, "profile_id").where(F.col("turn") <= F.col("remaining")).select("profile_id", "entity_id", "turn")


def evaluation_cache(snapshots: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Append ``hit``: an evaluation of this content exists."""
    e = evaluations.select("entity_id", "content_hash").distinct().withColumn("_e", F.lit(True))
    return snapshots.join(e, ["entity_id", "content_hash"], "left").withColumn("hit", F.coalesce("_e", F.lit(False))).drop("_e")


def clean_evaluation(evaluations: DataFrame, niches: list[str]) -> DataFrame:
    """Stored judgements (niche, fit_score, claim, evidence, text) with unknown niches, odd numbers and unsupported claims removed.

    Evidence stands when at least 40 % of its words over 4 letters are in the text; fewer than 3 such words always stand.
    """
    words = F.regexp_extract_all(F.lower("evidence"), F.lit("([a-z0-9]{5,})"), 1)
    found = F.filter(words, lambda w: F.lower("text").contains(w))
    ok = (F.size(words) < 3) | (F.size(found) >= 0.4 * F.size(words))
    measured = ~F.lower("claim").rlike("slow|speed|fast|mobile") | F.col("measured")
    return evaluations.withColumns({"niche": F.when(F.col("niche").isin(niches), F.col("niche")), "fit_score": bounded(F.col("fit_score")), "claim": F.when(measured & ok, F.substring("claim", 1, 300)), "rejected": ~ok})


def specific_compliment(praise: DataFrame, column: str = "praise") -> DataFrame:
    """Praise of 12 to 200 characters that names something.

    Refused are words of worth about a brand, style or products in general, and plain words joined by "and" without a
    capital, a digit or a quotation mark after the first character.
    """
    p = F.regexp_replace(column, r"^\s+|\s+$", "")
    joined = p.rlike(r"^[\w\s]+ and [\w\s]+$") & ~F.substring(p, 2, 200).rlike(r"[A-Z0-9\"']")
    return praise.where(F.length(p).between(12, 200) & ~p.rlike(ascii_bounds(f"(?i){VAGUE_PRAISE}")) & ~joined)


def robots_filter(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """URLs (url, host, path) that rules (host, agent, allow, pattern) let ``agent`` read; each row of a URL that comes several times.

    The agent's own group counts instead of the one for all; the longest pattern wins, and allow wins a tie.
    """
    own = rules.where((F.col("agent").isin(agent, "*")) & (F.col("pattern") != ""))
    first = own.groupBy("host").agg(F.max(F.col("agent") == agent).alias("has_own"))
    mine = own.join(first, "host").where((F.col("agent") == agent) == F.col("has_own"))
    escaped = F.regexp_replace(F.regexp_replace("pattern", r"([.+?^{}()|\[\]\\])", r"\\$1"), r"\*", ".*")
    mine = mine.select("host", "pattern", "allow", F.concat(F.lit("^"), escaped).alias("rx"))
    hit = urls.select("url", "host", "path").distinct().join(mine, "host", "left").withColumn("ok", F.rlike("path", F.col("rx")))
    best = hit.groupBy("url").agg(F.max(F.when(F.col("ok"), F.struct(F.length("pattern").alias("n"), "allow"))).alias("b"))
    allowed = best.where(F.coalesce(F.col("b.allow"), F.lit(True))).select("url")
    return urls.select("url").join(allowed, "url", "left_semi")


