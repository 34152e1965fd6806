"""Verification, domain trust, claim comparison and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions import dates as D
from fairlead.functions import text as T
from fairlead.functions import urls as U
from fairlead.functions.scoring import clamp
from fairlead.functions.similarity import partial_ratio_udf
from fairlead.operators.facts import extract_structured_page
from fairlead.rules import fact_rules as fr


def page_looks_stale(text: Column) -> Column:
    """Nearly empty, or a closing phrase among the first 4000 characters."""
    return (F.length(F.trim(F.coalesce(text, F.lit("")))) < 80) | F.substring(text, 1, 4000).rlike(fr.STALE_PAGE)


def eligible_for_verification(listings: DataFrame) -> DataFrame:
    return listings.filter(F.col("gate_verdict").isin("admit", "investigate"))


def pending_verification(listings: DataFrame, as_of: Column, hours: int = 48, limit: int = 25) -> DataFrame:
    """Newest unverified rows of the last hours; the cut comes before the verdict test."""
    recent = listings.filter((F.col("verification_status") == "unverified") & F.col("gate_verdict").isNotNull()
                             & (F.col("created_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours))))
    return eligible_for_verification(recent.orderBy(F.desc("created_at"), "listing_id").limit(limit))


def backlog_verification(listings: DataFrame, limit: int = 25, include_aggregator_only: bool = False) -> DataFrame:
    """Oldest rows still to verify; the cut comes before the verdict test."""
    wanted = ["unverified"] + (["aggregator_only"] if include_aggregator_only else [])
    rows = listings.filter(F.col("verification_status").isin(wanted) & F.col("duplicate_of").isNull())
    return eligible_for_verification(rows.orderBy("created_at", "listing_id").limit(limit))


def domain_trust(domains: DataFrame, as_of: Column) -> DataFrame:
    """Trust and flags from (domain, registered_at, page_text)."""
    years = D.floor_days(as_of, F.col("registered_at")) / 365.25
    inst = U.is_institutional(F.col("domain"))
    scams = T.phrases_in(F.lower(F.coalesce("page_text", F.lit(""))), fr.SCAM_PHRASES)
    old, young = F.coalesce(years >= 5, F.lit(False)), F.coalesce(years < 1, F.lit(False))
    staged = domains.withColumn("_scams", scams)
    hit = F.size("_scams") > 0
    score = 0.5 + F.when(inst, 0.25).otherwise(0.0) + F.when(old, 0.15).when(young, -0.25).otherwise(0.0) - F.when(hit, 0.4).otherwise(0.0)
    flags = F.concat(F.array_compact(F.array(F.when(inst, "institutional_tld"), F.when(old, "domain_age_5y+"), F.when(young, "domain_age_under_1y"))),
                     F.transform(F.slice("_scams", 1, 3), lambda s: F.concat(F.lit("scam:"), s)))
    return staged.select("domain", F.round(clamp(score), 3).alias("trust_score"), flags.alias("flags"))


def prescreen(claims: DataFrame) -> DataFrame:
    """Trust score, action and flags of listing claims.

    Input: listing_id, url, title, summary plus joined domain_trust, domain_flags, org_confidence, admit_rate, runs.
    """
    domain = U.extract_domain("url")
    staged = claims.withColumns({
        "listing_domain": domain,
        "_scams": T.phrases_in(F.lower(F.concat_ws(" ", "title", F.coalesce("summary", F.lit("")), "url")), fr.SCAM_PHRASES)})
    has = F.col("listing_domain").isNotNull()
    inst, allow = has & U.is_institutional(F.col("listing_domain")), has & F.col("org_confidence").isNotNull()
    base = 0.5 + F.when(inst, 0.2).otherwise(0.0) + F.when(allow, 0.15).otherwise(0.0)
    blended = F.when(F.col("domain_trust").isNotNull(), 0.4 * base + 0.6 * F.col("domain_trust")).otherwise(base)
    scam = F.size("_scams") > 0
    good = F.coalesce(F.col("admit_rate") >= 0.25, F.lit(False))
    poor = F.coalesce((F.col("admit_rate") < 0.08) & (F.col("runs") >= 3), F.lit(False))
    known = F.coalesce(F.col("org_confidence") >= 0.7, F.lit(False))
    score = clamp(blended - F.when(scam, 0.35).otherwise(0.0) + F.when(good, 0.15).when(poor, -0.2).otherwise(0.0) + F.when(known, 0.1).otherwise(0.0))
    flags = F.concat(F.coalesce("domain_flags", T.no_strings()),
                     F.array_compact(F.array(F.when(inst, "institutional_listing_domain"), F.when(allow, "allowlisted_domain"))),
                     F.transform(F.slice("_scams", 1, 3), lambda s: F.concat(F.lit("scam_phrase:"), s)),
                     F.array_compact(F.array(F.when(good, "source_high_admit_rate"), F.when(poor, "source_low_admit_rate"), F.when(known, "cached_org_domain"))))
    out = staged.withColumn("_score", score)
    action = F.when((F.col("_score") <= 0.25) | scam, "stop").when((F.col("_score") >= 0.72) & U.is_institutional(F.coalesce("listing_domain", F.lit(""))), "light_tier2").otherwise("continue")
    return out.withColumns({"action": action, "flags": flags, "prescreen_trust": F.round("_score", 3)}).drop("_score", "_scams")


def pick_canonical_domain(hits: DataFrame, excluded: DataFrame) -> DataFrame:
    """Best hit per organisation from (org, pos, url, title, content): institutional first, then by name, then official wording."""
    d = hits.withColumn("domain", U.extract_domain("url")).filter(F.col("domain").isNotNull() & ~U.is_non_primary(F.col("domain")))
    d = d.join(excluded.select("domain"), "domain", "left_anti")
    token = F.split_part(F.trim(F.lower("org")), F.lit(" "), F.lit(1))
    title, content = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("content", F.lit("")))
    named = token != ""
    rank = (F.when(U.is_institutional(F.col("domain")), 0).when(named & F.contains(F.col("domain"), token), 1).when(named & F.contains(title, token), 2)
            .when(F.contains(title, F.lit("official")) | F.contains(F.substring(content, 1, 200), F.lit("official")), 3).otherwise(4))
    best = d.withColumn("rank", rank).groupBy("org").agg(F.min(F.struct("rank", "pos", "domain", "url")).alias("b"))
    return best.select("org", F.col("b.domain").alias("domain"), F.col("b.url").alias("url"), F.col("b.rank").alias("rank"))


def primary_fields(pages: DataFrame) -> DataFrame:
    """Deadline, funding and eligibility wording of landed primary pages (listing_id, html, fallback_title, fallback_summary)."""
    x = extract_structured_page(pages.withColumnRenamed("listing_id", "page_id"))
    funded = F.contains(F.lower("summary"), F.lit("fund"))
    funding = F.when(funded, F.trim(F.concat_ws(" ", F.coalesce("funding_type", F.lit("")), F.substring("summary", 1, 300)))).otherwise(F.col("funding_type"))
    return x.select(F.col("page_id").alias("listing_id"), F.col("deadline").alias("p_deadline"), funding.alias("p_funding"),
                    F.nullif(F.substring(F.array_join("requirements", " "), 1, 800), F.lit("")).alias("p_eligibility"), F.col("institution").alias("p_institution"))


def text_similarity(a: Column, b: Column) -> Column:
    """1.0 as soon as one word is shared, else the best partial match of the sorted words."""
    def words(c: Column) -> Column:
        return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")))

    shared = F.arrays_overlap(words(a), words(b))
    no_a, no_b = F.coalesce(a, F.lit("")) == "", F.coalesce(b, F.lit("")) == ""
    residual = partial_ratio_udf(F.when(~shared, F.array_join(words(a), " ")), F.when(~shared, F.array_join(words(b), " "))) / 100.0
    return F.when(no_a & no_b, 1.0).when(no_a | no_b, 0.0).when(shared, 1.0).otherwise(residual)


FIELD = "struct<field:string,match:boolean,similarity:double,note:string,comparable:boolean>"


def compare_claims(rows: DataFrame, eligibility: bool = True) -> DataFrame:
    """Field comparison of listing claims with primary fields in one row.

    Input: deadline, funding_type, title, summary and p_deadline, p_funding, p_eligibility. Without
    eligibility only the two objective fields are compared and everything stays on the JVM.
    """
    due = D.deadline_compare(F.col("deadline"), F.col("p_deadline"))
    ours = T.funding_category(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in ("funding_type", "title", "summary")]))
    staged = rows.withColumns({"_due": due, "_ours": ours, "_theirs": T.funding_category(F.col("p_funding")),
                               "_elig": F.substring(F.coalesce("summary", F.lit("")), 1, 600)})
    both_due = F.col("deadline").isNotNull() & F.col("p_deadline").isNotNull()
    both_fund = F.col("_ours").isNotNull() & F.col("_theirs").isNotNull()
    fund_match = ~both_fund | (F.col("_ours") == F.col("_theirs"))
    fields = [
        F.struct(F.lit("deadline").alias("field"), F.col("_due.match").alias("match"), F.col("_due.similarity").alias("similarity"), F.col("_due.note").alias("note"), both_due.alias("comparable")),
        F.struct(F.lit("funding").alias("field"), F.coalesce(fund_match, F.lit(True)).alias("match"), F.when(F.coalesce(fund_match, F.lit(True)), 1.0).otherwise(0.0).alias("similarity"),
                 F.concat(F.coalesce("_ours", F.lit("unknown")), F.lit("_vs_"), F.coalesce("_theirs", F.lit("unknown"))).alias("note"), both_fund.alias("comparable")),
    ]
    if eligibility:
        staged = staged.withColumn("_sim", text_similarity(F.col("_elig"), F.col("p_eligibility")))
        both = (F.trim("_elig") != "") & (F.trim(F.coalesce("p_eligibility", F.lit(""))) != "")
        fields.append(F.struct(F.lit("eligibility").alias("field"), (F.col("_sim") >= 0.45).alias("match"), F.col("_sim").alias("similarity"), F.lit(None).cast("string").alias("note"), both.alias("comparable")))
    out = staged.withColumn("fields", F.array(*fields).cast(f"array<{FIELD}>"))
    bad = F.transform(F.filter("fields", lambda f: f["comparable"] & ~f["match"]), lambda f: F.when(
        f["field"] == "deadline", F.concat(F.lit("deadline_mismatch:"), f["note"])).otherwise(F.concat(f["field"], F.lit("_mismatch"))))
    usable = F.filter("fields", lambda f: f["comparable"])
    out = out.withColumns({"discrepancies": bad, "all_match": (F.size(usable) > 0) & F.forall(usable, lambda f: f["match"])})
    return out.withColumn("partial_match", ~F.col("all_match") & F.exists(usable, lambda f: f["similarity"] >= 0.4)).drop("_due", "_ours", "_theirs", "_elig", "_sim")


def material_conflict() -> Column:
    return F.exists("discrepancies", lambda d: d.startswith("deadline_mismatch")) | (F.size("discrepancies") >= 2)


def confirms_listing() -> Column:
    objective = F.filter("fields", lambda f: f["field"].isin("deadline", "funding") & f["comparable"])
    return ~material_conflict() & (F.size(objective) > 0) & F.forall(objective, lambda f: f["match"])


def verification_status(compared: DataFrame) -> DataFrame:
    """Status and trust of prescreened, compared rows (adds primary_url, org); rows settled before are left out."""
    todo = compared.filter(~F.coalesce(F.col("verification_status").isin("primary_confirmed", "stale"), F.lit(False)))
    domain = U.extract_domain("primary_url")
    strong = F.coalesce(U.is_institutional(domain) | U.domain_matches_org(domain, F.col("org")), F.lit(False))
    usable = F.col("p_deadline").isNotNull() | F.col("p_funding").isNotNull() | F.col("p_eligibility").isNotNull()
    trust = F.col("prescreen_trust")
    live = (F.col("action") != "stop") & usable & strong
    status = F.when(live & confirms_listing(), "primary_confirmed").when(live & material_conflict(), "stale").otherwise("aggregator_only")
    out = todo.withColumns({"strong_primary": strong, "new_status": status})
    new_trust = (F.when(F.col("new_status") == "primary_confirmed", F.least(F.lit(1.0), trust + 0.25))
                 .when(F.col("new_status") == "stale", trust * F.when(F.col("partial_match"), 0.85).otherwise(0.7)).otherwise(trust))
    return out.withColumn("new_trust", F.round(new_trust, 3))


def staleness_candidates(listings: DataFrame, as_of: Column, limit: int | None = 20, unseen_days: int = 14, recrawl_days: int = 30) -> DataFrame:
    def older(c: str, days: int) -> Column:
        return F.col(c).isNull() | (F.col(c) < as_of - F.make_dt_interval(F.lit(days)))

    rows = listings.filter(F.col("duplicate_of").isNull() & (F.col("verification_status").isNull() | (F.col("verification_status") != "stale"))
                           & (F.col("deadline").isNull() | (F.col("deadline") >= as_of)) & (older("last_seen_at", unseen_days) | older("verified_at", recrawl_days)))
    return rows.orderBy(F.asc_nulls_first("last_seen_at"), "listing_id").limit(limit) if limit else rows


def staleness_decision(listings: DataFrame, pages: DataFrame) -> DataFrame:
    """Reason and new status per listing from its landed page; a page row with NULL html could not be fetched."""
    landed = listings.select("listing_id", "title", "summary", "deadline", "verification_status").join(pages.select("listing_id", "html"), "listing_id", "left")
    fields = primary_fields(landed.select("listing_id", F.coalesce("html", F.lit("")).alias("html"), F.coalesce("title", F.lit("")).alias("fallback_title"), F.coalesce("summary", F.lit("")).alias("fallback_summary")))
    j = landed.join(fields.select("listing_id", "p_deadline"), "listing_id")
    due = D.deadline_compare(F.col("deadline"), F.col("p_deadline"))
    reason = (F.when(F.col("html").isNull(), "fetch_failed").when(page_looks_stale(F.col("html")), "stale_phrase")
              .when(F.col("deadline").isNotNull() & F.col("p_deadline").isNotNull() & ~due["match"], "deadline_mismatch").otherwise("ok"))
    out = j.withColumn("reason", reason)
    return out.withColumn("new_status", F.when(F.col("reason") != "ok", "stale").when(F.col("verification_status") == "stale", "unverified").otherwise(F.col("verification_status")))
