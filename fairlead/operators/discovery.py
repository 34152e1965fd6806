"""Source discovery, scoring, selection and activation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead.functions import text as T
from fairlead.functions import urls as U
from fairlead.functions.scoring import clamp
from fairlead.rules import fact_rules as fr

MAX_CANDIDATES = 20
STRONG_CONFIDENCE = 0.55


def excluded_domains(sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """Domains already known from the catalog or from reviewed candidates."""
    known = sources.select(U.extract_domain("url").alias("domain"))
    seen = candidates.filter(F.col("status").isin("approved", "rejected", "pending_review")).select(F.lower("domain").alias("domain"))
    return known.unionByName(seen).filter(F.coalesce("domain", F.lit("")) != "").distinct()


def domain_score(domain: Column, snippet: Column, title: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, snippet))
    score = (F.when(U.is_institutional(domain), 0.35).otherwise(0.0)
             + F.when(T.any_contains(domain, [".edu", ".gov", ".org"]), 0.1).otherwise(0.0)
             - F.when(U.is_non_primary(domain), 0.25).otherwise(0.0)
             + F.least(F.lit(0.3), F.size(T.phrases_in(text, fr.LISTING_TERMS)) * 0.05)
             + F.when(T.any_contains(text, ["listing", "database", "search"]), 0.1).otherwise(0.0))
    return clamp(score)


def candidate_domains(hits: DataFrame, excluded: DataFrame, top: int = MAX_CANDIDATES) -> DataFrame:
    """First hit of each new domain, best address, pre-rank score, best scores first.

    Input (pos, url, title, snippet). The first hit is a combining aggregate.
    """
    d = hits.withColumn("domain", U.extract_domain("url")).filter(F.coalesce("domain", F.lit("")) != "").join(excluded, "domain", "left_anti")
    first = d.groupBy("domain").agg(F.min(F.struct("pos", "url", "title", "snippet")).alias("h"))
    scored = first.select("domain", F.col("h.pos").alias("pos"), U.best_url_for_domain(F.col("h.url")).alias("discovered_url"), F.substring("h.title", 1, 500).alias("title"),
                          F.substring("h.snippet", 1, 2000).alias("snippet"),
                          domain_score(F.col("domain"), F.col("h.snippet"), F.col("h.title")).alias("pre_rank_score"))
    return scored.orderBy(F.desc("pre_rank_score"), "pos").limit(top)


def anchors(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))


def links_within(tag: str, css_class: str) -> str:
    """A pattern for an element of this tag and class with a link before the tag closes."""
    wanted = rf"""[^>]*\bclass\s*=\s*["']([^"']*\s)?{css_class}(\s[^"']*)?["']""" if css_class else ""
    closing = r"\1" if tag.startswith("(") else tag
    return rf"(?s)<{tag}\b{wanted}[^>]*>((?!</{closing}\s*>).)*?<a\b[^>]*href"


def page_structure(pages: DataFrame) -> DataFrame:
    """Feed links, same-host listing links, pagination and category hints of each page (page_id, url, html)."""
    tags = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda t: F.struct(
        t.alias("tag"), F.regexp_extract(t, r"""(?is)\bhref\s*=\s*["']([^"']*)["']""", 1).alias("href")))
    feeds = F.filter(tags, lambda t: (t["href"] != "") & (t["tag"].rlike(r"(?i)application/(rss|atom)") | t["href"].endswith("/feed")))
    hrefs = F.transform(feeds, lambda t: t["href"])
    links = F.filter(anchors(F.col("html")), lambda h: ~h.startswith("#") & ~h.startswith("mailto:"))
    staged = pages.withColumns({"_feeds": hrefs, "_links": links, "_host": U.url_parts("url")["netloc"]})
    full = F.transform("_links", lambda h: U.absolute_url(h, F.col("url")))
    wanted = F.filter(full, lambda u: T.let(F.struct(U.url_parts(u)["netloc"].alias("h"), U.url_parts(u)["path"].alias("p")), lambda x: (
        (x["h"] == F.col("_host")) & (x["p"].rlike(fr.LISTING_PATH) | x["p"].rlike(fr.DATE_PATH)))))
    low = F.lower(F.col("html"))
    staged = staged.withColumn("_wanted", wanted)
    return staged.select(
        "page_id", (F.size("_feeds") > 0).alias("has_rss_feed"), F.transform("_feeds", lambda h: U.absolute_url(h, F.col("url"))).alias("rss_urls"),
        F.size("_wanted").alias("listing_link_count"), F.slice("_wanted", 1, 8).alias("sample_listing_urls"),
        (F.contains(low, F.lit("next page")) | F.contains(low, F.lit("pagination")) | low.rlike(links_within("nav", "")) | low.rlike(links_within(r"(\w+)", "page-numbers"))).alias("has_pagination"),
        (low.rlike(links_within("ul", "categories")) | low.rlike(links_within(r"(\w+)", "category")) | low.rlike(links_within("nav", "menu"))).alias("has_category_nav"),
        F.when(F.size("_wanted") >= 5, "article h2 a, h2.entry-title a, .post-title a, main a").alias("suggested_link_selector"))


def recurring_structure() -> Column:
    n = F.col("listing_link_count")
    return (F.col("has_rss_feed") & (F.size("rss_urls") > 0)) | (n >= 5) | ((n >= 3) & (F.col("has_pagination") | F.col("has_category_nav")))


def candidate_evaluation(structures: DataFrame) -> DataFrame:
    """Rule verdict of a landed candidate page; input adds url and snippet to page_structure, page NULL when fetching failed."""
    failed = F.col("listing_link_count").isNull()
    recurring = F.coalesce(recurring_structure(), F.lit(False))
    kind = F.when(failed, "unclear").when(F.coalesce("has_rss_feed", F.lit(False)), "rss").when(recurring, "html_listing").otherwise("unclear")
    config = F.when(failed, "{}").when(F.coalesce("has_rss_feed", F.lit(False)), F.to_json(F.struct(F.lit(1).alias("version"), F.struct(
        F.lit("rss").alias("kind"), F.slice("rss_urls", 1, 3).alias("feed_urls"), F.lit(50).alias("max_entries"), F.lit("link").alias("dedupe_by")).alias("discover")))).otherwise(
        F.to_json(F.struct(F.lit(1).alias("version"), F.struct(
            F.lit("html").alias("kind"), F.array("url").alias("entry_urls"), F.coalesce("suggested_link_selector", F.lit("article h2 a, main a")).alias("link_selector"),
            F.lit(50).alias("max_entries")).alias("discover"))))
    return structures.select(
        "*", F.when(recurring, "recurring_source").otherwise("unclear").alias("verdict"),
        F.when(failed, 0.15).when(recurring, 0.4).otherwise(0.25).alias("confidence"), kind.alias("structure_type"), config.alias("parser_config"),
        F.when(failed, "fetch_failed").otherwise("heuristic_fallback").alias("evidence_summary"))


def downgrade_unsupported(evaluations: DataFrame) -> DataFrame:
    """A recurring verdict without recurring structure falls to unclear with at most 0.45."""
    bad = (F.col("verdict") == "recurring_source") & ~F.coalesce(recurring_structure(), F.lit(False))
    return evaluations.withColumns({
        "confidence": F.when(bad, F.least("confidence", F.lit(0.45))).otherwise(F.col("confidence")),
        "evidence_summary": F.when(bad, F.concat("evidence_summary", F.lit("; downgraded_no_structure"))).otherwise(F.col("evidence_summary")),
        "verdict": F.when(bad, "unclear").otherwise(F.col("verdict")),
    })


def strong_recurring(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("run_id").agg(F.count_if((F.col("verdict") == "recurring_source") & (F.col("confidence") >= STRONG_CONFIDENCE)).alias("strong"))


def candidate_order() -> list[Column]:
    place = F.when(F.col("verdict") == "recurring_source", 0).when(F.col("verdict") == "unclear", 1).when(F.col("verdict") == "one_off_page", 2).otherwise(9)
    return [place, F.desc("confidence"), F.col("domain")]


def registry_slug(name: Column, domain: Column) -> Column:
    raw = F.lower(F.coalesce(F.nullif(name, F.lit("")), domain))
    slug = F.substring(F.regexp_replace(F.regexp_replace(raw, "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 48)
    return F.when(slug == "", "discovered_source").otherwise(slug)


def promote_candidates(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """New registry entries of approvable candidates whose id is not taken yet; first per id."""
    open_ = candidates.filter(~F.col("status").isin("approved", "rejected")).withColumn("registry_id", registry_slug(F.col("name"), F.col("domain")))
    fresh = open_.join(registry.select("registry_id"), "registry_id", "left_anti")
    one = fresh.groupBy("registry_id").agg(F.min(F.struct("candidate_id", "name", "url", "source_type")).alias("c"))
    return one.select("registry_id", F.col("c.name").alias("name"), F.col("c.url").alias("url"), F.col("c.source_type").alias("source_type"), F.array(F.lit("global")).alias("regions"),
                      F.array(F.lit("scholarship")).alias("tags"), F.array(F.lit("Mixed")).alias("degree_levels"), F.lit("medium").alias("funding_signal"),
                      F.substring("c.name", 1, 32).alias("chip_label"), F.lit("proposed").alias("confidence"))


def score_sources(users: DataFrame, registry: DataFrame, stats: DataFrame, chips: dict[str, str], priority_source: str = "") -> DataFrame:
    """Score and reasons per user and catalog source.

    Users meet sources through the degree they ask for: each source is listed once per degree it accepts
    (or under each of the five degrees when it names none), so the join is an equi-join on the degree.
    """
    known = registry.filter(F.col("source_type").isin("rss", "html")).join(stats, "registry_id", "left")
    limited = known.filter(F.size("degree_levels") > 0).withColumn("target_degree", F.explode(F.array_distinct("degree_levels")))
    anyone = known.filter(F.size("degree_levels") == 0).withColumn("target_degree", F.explode(T.str_array(fr.TARGET_DEGREES)))
    pairs = users.join(limited.unionByName(anyone), "target_degree")
    chip_map = T.literal(chips, "map<string,string>")
    picked = F.exists("search_sources", lambda c: F.coalesce(F.try_element_at(chip_map, c) == F.col("registry_id"), F.lit(False)))
    labelled = F.array_contains("search_sources", F.col("chip_label"))
    region = F.get(F.filter("target_regions", lambda r: F.array_contains("regions", r) | F.array_contains("regions", "global")), F.lit(0))
    tags = F.transform("tags", F.lower)
    intl = F.col("developing") & F.array_contains("tags", "international")
    germany = F.array_contains("target_regions", "Germany") & (F.col("registry_id") == priority_source)

    def focus(degree: str, *wanted: str) -> Column:
        return (F.col("target_degree") == degree) & F.exists(tags, lambda t: t.isin(*wanted))

    focuses = [(focus("Fellowship", "fellowship"), 8, "fellowship_focus"), (focus("MSc", "scholarship"), 5, "scholarship_focus"),
               (focus("PhD", "phd", "doctoral"), 5, "phd_focus"), (focus("Internship", "internship"), 5, "internship_focus")]

    def points(cond: Column, n: int) -> Column:
        return F.when(cond, n).otherwise(0)

    score = (points(picked, 15) + points(labelled, 15) + points(region.isNotNull(), 5) + points(intl, 5) + points(germany, 10)
             + points(F.col("funding_signal") == "high", 3) + F.coalesce("bonus", F.lit(0)))
    for cond, n, _ in focuses:
        score = score + points(cond, n)
    reasons = F.array_distinct(F.array_compact(F.array(
        F.when(picked | labelled, "user chip"), F.concat(F.lit("region:"), region), F.when(intl, "international_scholarships"), F.when(germany, "germany_priority"),
        F.col("bonus_reason"), *[F.when(c, r) for c, _, r in focuses])))
    return pairs.select("user_id", F.col("registry_id").alias("source"), score.cast("bigint").alias("score"), reasons.alias("reasons"))


def select_sources(scored: DataFrame, n: int = 4) -> DataFrame:
    """Best n sources per user with priority and reason."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("score"), "source"))
    top = scored.withColumn("priority", place).filter(F.col("priority") <= n)
    return top.select("user_id", "source", "priority", F.lit(True).alias("enabled"), F.array_contains("reasons", "user chip").alias("user_selected"),
                      F.when(F.size("reasons") > 0, F.array_join("reasons", ", ")).otherwise("default").alias("selection_reason"))


def activate_sources(selection: DataFrame, sources: DataFrame, catalog: DataFrame) -> DataFrame:
    """Source table after an activation: (registry_id, url, name, is_active, change).

    An entry (registry_id, url, name, optionally is_active) changes the row that has its id, else the row that has its
    url, else it is added. What it changes takes its id, url, name and activity. Other rows whose id or url is selected
    stay as they are. Of the rest, those of the catalog (registry_id) and those without an id are switched off.
    """
    active = F.min("is_active") if "is_active" in selection.columns else F.lit(True)
    wanted = selection.groupBy("registry_id").agg(F.min("url").alias("url"), F.min("name").alias("name"), active.alias("is_active"))
    by_id = wanted.join(sources.select("id", "registry_id"), "registry_id").select("id", F.struct("registry_id", "url", "name", "is_active").alias("e"))
    lone = wanted.join(sources.select("registry_id"), "registry_id", "left_anti")
    by_url = lone.join(sources.select("id", "url"), "url").select("id", F.struct("registry_id", "url", "name", "is_active").alias("e"))
    hit = by_id.unionByName(by_url).groupBy("id").agg(F.min("e").alias("e"))
    listed = catalog.select("registry_id").distinct().withColumn("listed", F.lit(True))
    chosen = wanted.select("url").distinct().withColumn("chosen", F.lit(True))
    ids = wanted.select("registry_id", F.lit(True).alias("same_id"))
    rows = sources.join(hit, "id", "left").join(listed, "registry_id", "left").join(chosen, "url", "left").join(ids, "registry_id", "left")
    off = F.col("chosen").isNull() & F.col("same_id").isNull() & (F.col("listed").isNotNull() | F.col("registry_id").isNull())
    changed = F.when(F.col("e").isNotNull(), "updated").when(off & F.col("is_active"), "deactivated").otherwise("unchanged")
    old = rows.select(F.coalesce("e.registry_id", "registry_id").alias("registry_id"), F.coalesce("e.url", "url").alias("url"), F.coalesce("e.name", "name").alias("name"),
                      F.when(F.col("e").isNotNull(), F.col("e.is_active")).when(off, False).otherwise(F.col("is_active")).alias("is_active"), changed.alias("change"))
    new = lone.join(sources.select("url"), "url", "left_anti")
    return old.unionByName(new.select("registry_id", "url", "name", "is_active", F.lit("added").alias("change")))


def profile_ingest_sources(selection: DataFrame, sources: DataFrame) -> DataFrame:
    """Active sources a user selected, by registry id or by url: two equi-joins instead of one OR."""
    live = sources.filter("is_active").select("id", "registry_id", "url")
    by_id = selection.select("user_id", "registry_id").join(live, "registry_id").select("user_id", "id")
    by_url = selection.select("user_id", "url").join(live, "url").select("user_id", "id")
    return by_id.unionByName(by_url).distinct()


def source_url(urls: Column) -> Column:
    """The address of a registry entry that names one, or a list of which the first counts."""
    return F.coalesce(F.get(urls, F.lit(0)), F.lit(""))


def due_sources(sources: DataFrame, as_of: Column) -> DataFrame:
    return sources.filter(F.col("is_active") & (F.col("next_fetch_at").isNull() | (F.col("next_fetch_at") <= as_of)))


def next_fetch(finished_at: Column, interval_minutes: Column) -> Column:
    minutes = F.coalesce(F.nullif(interval_minutes, F.lit(0)), F.lit(360))
    return finished_at + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))


def resolve_source_config(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """Missing fields from the registry entry; a source with neither feeds nor strategies reads its own address as a feed.

    parser_config is a map of text; own keys win over registry keys.
    """
    reg = registry.select("registry_id", *[F.col(c).alias("r_" + c) for c in ("adapter_id", "fetch_mode", "authority", "parser_config")])
    j = sources.join(reg, "registry_id", "left")
    no_map = F.create_map().cast("map<string,string>")
    own, base = F.coalesce("parser_config", no_map), F.coalesce("r_parser_config", no_map)

    def has_feed(m: Column) -> Column:
        return F.map_contains_key(m, "feed_urls") | F.map_contains_key(m, "strategies")

    merged = F.when(~has_feed(own) & has_feed(base), F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)).otherwise(own)
    fallback = F.map_concat(F.map_filter(merged, lambda k, v: ~k.isin("kind", "feed_urls", "max_entries")), F.create_map(
        F.lit("kind"), F.coalesce(F.try_element_at(merged, F.lit("kind")), F.lit("rss")), F.lit("feed_urls"), F.col("url"),
        F.lit("max_entries"), F.coalesce(F.try_element_at(merged, F.lit("max_entries")), F.lit("50"))))
    return j.select(
        "registry_id", "url", F.coalesce(F.nullif("adapter_id", F.lit("")), "r_adapter_id").alias("adapter_id"), F.coalesce(F.nullif("fetch_mode", F.lit("")), "r_fetch_mode").alias("fetch_mode"),
        F.coalesce("authority", "r_authority").alias("authority"), F.when(has_feed(merged) | (F.coalesce("url", F.lit("")) == ""), merged).otherwise(fallback).alias("parser_config"))


def validate_registry(registry: DataFrame) -> DataFrame:
    """One row per broken rule of a catalog entry (registry_id, name, url, source_type, adapter_id, parser_config map)."""
    kind = F.try_element_at("parser_config", F.lit("kind"))
    rules = F.array_compact(F.array(
        F.when(F.coalesce("name", F.lit("")) == "", "missing name"), F.when(F.coalesce("url", F.lit("")) == "", "missing url"),
        F.when(F.coalesce("source_type", F.lit("")) == "", "missing type"),
        F.when((F.col("source_type") == "rss") & ~F.coalesce("url", F.lit("")).startswith("http"), "invalid rss url"),
        F.when(F.coalesce("adapter_id", F.lit("")) == "", "missing adapter_id"), F.when(kind.isNull(), "parser_config.discover missing"),
        F.when(~F.map_contains_key("parser_config", "extract"), "parser_config.extract missing"),
        F.when((kind == "hybrid") & ~F.map_contains_key("parser_config", "strategies"), "hybrid discover requires strategies[]"),
        F.when(~kind.isin("hybrid", "rss", "html", "html_paginated", "wp_json", "sitemap"), F.concat(F.lit("unknown discover.kind "), kind))))
    return registry.select("registry_id", F.explode(rules).alias("error"))
