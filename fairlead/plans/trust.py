"""Verification and staleness queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.bindings import AS_OF, Bindings
from fairlead.functions import dates as D
from fairlead.functions import text as T
from fairlead.functions import urls as U
from fairlead.operators import metrics as M
from fairlead.operators import trust as V
from fairlead.plans.registry import query


def now():
    return F.lit(AS_OF).cast("timestamp")


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


@query("v01_eligible_for_verification")
def v01(b: Bindings):
    return V.eligible_for_verification(b.listings).select("listing_id", "gate_verdict")


@query("v02_pending_verification")
def v02(b: Bindings):
    return V.pending_verification(b.listings, now(), hours=240, limit=60).select("listing_id")


@query("v02_backlog_verification")
def v02b(b: Bindings):
    return V.backlog_verification(b.listings, 60, True).select("listing_id")


def domains(b: Bindings) -> DataFrame:
    h = b.page_hits.groupBy(U.bare_host(F.col("host")).alias("h")).agg(F.min("page_id").alias("k"))
    d = F.when(F.col("k") % 4 == 0, F.concat("h", F.lit(".ac.uk"))).otherwise(F.col("h"))
    return h.select(d.alias("domain"), F.when(F.col("k") % 3 != 0, now() - F.make_dt_interval((F.col("k") * 37 % 4000).cast("int"))).alias("registered_at"),
                    F.when(F.col("k") % 5 == 0, "Pay to apply by wire transfer").alias("page_text"))


@query("v04_domain_trust")
def v04(b: Bindings):
    return V.domain_trust(domains(b), now()).select("domain", F.round(F.col("trust_score") + 1e-9, 3).alias("trust_score"), T.joined(F.col("flags")).alias("flags"))


def claims(b: Bindings) -> DataFrame:
    """Listing claims with the dimension values that prescreening joins in."""
    k = F.col("listing_id")
    stats = M.outcome_stats(b.runs).select("source_id", F.round((F.col("source_id") % 9) / 25.0, 4).alias("admit_rate"), "runs")
    url = F.when(k % 6 == 0, F.concat(F.lit("https://apply.uni"), (k % 40).cast("string"), F.lit(".ac.uk/call"))).otherwise(F.col("url"))
    title = F.when(k % 17 == 0, F.concat("title", F.lit(" wire transfer"))).otherwise(F.col("title"))
    return b.listings.withColumns({"url": url, "title": title}).join(stats, "source_id", "left").withColumns({
        "domain_trust": F.when(k % 4 != 0, (k % 11) / 10.0), "domain_flags": F.when(k % 4 == 1, T.str_array(["domain_age_5y+"])),
        "org_confidence": F.when(k % 5 == 0, (k % 10) / 10.0)})


@query("v03_prescreen")
def v03(b: Bindings):
    return V.prescreen(claims(b)).select("listing_id", F.round(F.col("prescreen_trust") + 1e-9, 3).alias("trust"), "action", T.joined(F.col("flags")).alias("flags"))


@query("v05_pick_canonical_domain")
def v05(b: Bindings):
    url = F.when(F.col("page_id") % 7 == 0, "https://www.reddit.com/r/x").when(F.col("page_id") % 7 == 1, F.concat(F.lit("https://institute"), F.col("page_id").cast("string"), F.lit(".org/"))).otherwise(F.col("url"))
    hits = b.page_hits.select("org", F.col("page_id").alias("pos"), url.alias("url"), "title", F.when(F.col("page_id") % 3 == 0, "The official site").alias("content"))
    excluded = b.page_hits.filter("page_id % 11 = 0").select(U.bare_host(F.col("host")).alias("domain")).distinct()
    return V.pick_canonical_domain(hits, excluded).select("org", "domain", "url", F.col("rank").cast("bigint").alias("rank"))


def primary_pages(b: Bindings) -> DataFrame:
    """Landed primary page per listing: its document with an injected deadline, funding and requirement line."""
    k = F.col("listing_id")
    shift = F.col("deadline") + F.make_dt_interval((k % 15).cast("int"))
    line = F.concat(F.lit("<html><h1>Call</h1><p>"), F.when(k % 4 != 0, F.concat(F.lit("Deadline: "), F.date_format(shift, "d MMMM yyyy"), F.lit("</p><p>"))).otherwise(""),
                    F.when(k % 3 == 0, "Fully funded by the fund. ").when(k % 3 == 1, "Self-funded, no fund. ").otherwise(""), F.when(k % 5 == 0, "Transcript and portfolio. ").otherwise(""))
    html = F.concat(F.coalesce(line, F.lit("<html><p>")), F.coalesce("summary", F.lit("")), F.when(k % 13 == 0, "</p>Applications closed.</html>").otherwise("</p></html>"))
    return b.listings.select("listing_id", F.when(k % 19 != 0, html).alias("html"), F.concat(F.lit("https://institute"), (k % 40).cast("string"), F.lit(".org/call")).alias("primary_url"))


def fields(b: Bindings) -> DataFrame:
    p = primary_pages(b).filter(F.col("html").isNotNull())
    return V.primary_fields(p.select("listing_id", "html", F.lit("").alias("fallback_title"), F.lit("").alias("fallback_summary")))


@query("v13_primary_fields")
def v13(b: Bindings):
    return fields(b).select("listing_id", day("p_deadline").alias("p_deadline"), F.md5("p_funding").alias("funding_md5"), "p_eligibility")


@query("v06_deadline_compare")
def v06(b: Bindings):
    other = F.col("deadline") + F.make_dt_interval(((F.col("listing_id") * 7) % 90 - 45).cast("int"), F.lit(13))
    c = D.deadline_compare(F.col("deadline"), F.when(F.col("listing_id") % 6 != 1, other))
    return b.listings.select("listing_id", c["match"].alias("match"), F.round(c["similarity"] + 1e-9, 4).alias("similarity"), c["note"].alias("note"))


@query("v07_text_similarity")
def v07(b: Bindings):
    a = b.documents.select("doc_id", F.col("text").alias("a"), F.when(F.col("doc_id") % 2 == 0, "Transcript Portfolio Cv").otherwise(F.split_part("text", F.lit("."), F.lit(1))).alias("c"))
    return a.select("doc_id", F.round(V.text_similarity(F.col("a"), F.col("c")), 4).alias("similarity"))


def compared(b: Bindings, eligibility: bool) -> DataFrame:
    return V.compare_claims(b.listings.join(fields(b), "listing_id"), eligibility)


@query("v08_compare_claims")
def v08(b: Bindings):
    return compared(b, False).select("listing_id", T.joined(F.transform("fields", lambda f: F.concat_ws(":", f["field"], f["match"].cast("string"), f["note"], f["comparable"].cast("string")))).alias("fields"),
                                     T.joined(F.col("discrepancies")).alias("discrepancies"), "all_match", "partial_match")


@query("v09_confirms_listing")
def v09(b: Bindings):
    return compared(b, False).select("listing_id", V.confirms_listing().alias("confirms"), V.material_conflict().alias("conflict"))


def verified(b: Bindings, eligibility: bool) -> DataFrame:
    pre = V.prescreen(claims(b)).select("listing_id", "prescreen_trust", "action")
    urls = primary_pages(b).select("listing_id", "primary_url")
    rows = compared(b, eligibility).join(pre, "listing_id").join(urls, "listing_id")
    org = F.when(F.col("listing_id") % 2 == 0, U.guess_org_name(F.col("title"), F.col("institution"))).otherwise("Another Body")
    return V.verification_status(rows.withColumn("org", org))


@query("v10_verification_status")
def v10(b: Bindings):
    return verified(b, False).select("listing_id", "strong_primary", "new_status", F.round(F.col("new_trust") + 1e-9, 3).alias("new_trust"))


@query("v10_verification_with_eligibility")
def v10e(b: Bindings):
    return verified(b, True).groupBy("new_status").agg(F.count("*").alias("n"))


@query("v11_staleness_candidates")
def v11(b: Bindings):
    return V.staleness_candidates(b.listings, now(), 50).select("listing_id")


@query("v12_staleness_decision")
def v12(b: Bindings):
    return V.staleness_decision(b.listings, primary_pages(b)).select("listing_id", "reason", "new_status")
