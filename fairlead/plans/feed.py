"""Feed and read queries: single-user pages for one user, batch forms for all users."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.bindings import AS_OF, Bindings
from fairlead.functions import text as T
from fairlead.operators import feed as P
from fairlead.operators import ranking as R
from fairlead.plans.ranking import interaction_scores
from fairlead.plans.registry import query

USER = 7
RULES = {"reject": ["PhD only", "unpaid"], "require_funding": "full_only"}


def now():
    return F.lit(AS_OF).cast("timestamp")


@query("f01_list_opportunities")
def f01(b: Bindings):
    r = P.list_opportunities(b.listings, b.feedback, USER, now(), bucket="matches", sort="fit", limit=50, rules=RULES)
    return r.select("listing_id", "status", "fit_percent", "rank_position", "trust_state", "urgency_label")


@query("f02_bucket_filter")
def f02(b: Bindings):
    rows = P.selected(b.listings, b.feedback, USER, now())
    out = None
    for name in ("matches", "closing_soon", "saved", "applied", "dismissed"):
        part = P.bucket_filter(rows, name, now()).select(F.lit(name).alias("bucket"), "listing_id", "status")
        out = part if out is None else out.unionByName(part)
    return out


@query("f03_eligibility_pushdown")
def f03(b: Bindings):
    return P.eligibility_pushdown(b.listings, now(), RULES["reject"], "full_only").select("listing_id", "funding_type")


@query("f04_search_filter")
def f04(b: Bindings):
    return P.search_filter(b.listings, "Stipend").select("listing_id")


@query("f05_feed_order")
def f05(b: Bindings):
    """Place of every visible row of the user in the deadline-sorted tab."""
    rows = P.bucket_filter(P.selected(b.listings, b.feedback, USER, now()), "matches", now())
    top = P.page(rows, P.feed_order("matches", "deadline"), limit=100)
    return top.select("listing_id", "rank_position", F.date_format("deadline", "yyyy-MM-dd").alias("deadline"))


@query("f06_passes_eligibility")
def f06(b: Bindings):
    return P.passes_eligibility(b.listings, RULES["reject"], "full_only").select("listing_id")


@query("f07_page_info")
def f07(b: Bindings):
    rows = P.bucket_filter(P.selected(b.listings, b.feedback, USER, now()), "closing_soon", now())
    return P.page_info(rows, limit=20, offset=40)


@query("f07_keyset_page")
def f07k(b: Bindings):
    """The third page of the user's matches: two cursors further on."""
    rows = P.bucket_filter(P.selected(b.listings, b.feedback, USER, now()), "matches", now())
    after = None
    for _ in range(2):
        last = P.page_after(rows, "matches", "fit", after, 7).agg(F.max_by("cursor", P.page_key("matches", "fit"))).first()[0]
        after = last or after
    return P.page_after(rows, "matches", "fit", after, 7).select("listing_id", "rank_position")


@query("f08_unknown_deadline_count")
def f08(b: Bindings):
    return P.unknown_deadline_count(b.listings, b.feedback, USER, now(), rules=RULES)


def all_feeds(b: Bindings):
    """Rows of every user on visible listings the user has reacted to."""
    return P.visible_listings(b.listings).join(b.feedback.withColumnRenamed("created_at", "row_created_at"), "listing_id")


@query("f09_grouped_feed")
def f09(b: Bindings):
    return P.grouped_feed(all_feeds(b), now()).select("user_id", "listing_id", "section")


@query("f10_feed_summary")
def f10(b: Bindings):
    return P.feed_summary(P.grouped_feed(all_feeds(b), now()), b.requirements, now())


@query("f11_dashboard")
def f11(b: Bindings):
    notes = b.status_events.filter(F.col("status") == "new").select("user_id", "event_id", "happened_at")
    return P.dashboard(P.grouped_feed(all_feeds(b), now()), b.learning, notes).select(
        "user_id", "part", "item_id", F.col("place").cast("bigint").alias("place"))


@query("f12_weekly_focus")
def f12(b: Bindings):
    return P.weekly_focus(b.feedback, b.listings, b.requirements, b.learning, now())


@query("f13_daily_digest")
def f13(b: Bindings):
    return P.daily_digest(b.feedback, b.listings, now()).select("user_id", "n", F.md5("body").alias("body_md5"))


@query("f14_deadline_reminders")
def f14(b: Bindings):
    return P.deadline_reminders(b.feedback, b.listings, now())


@query("f15_opportunity_detail")
def f15(b: Bindings):
    r = P.opportunity_detail(b.listings, b.feedback, b.profiles, USER, 217, now())
    return r.select("listing_id", "title", "status", "trust_label", "days_until_deadline", "deadline_bucket")


@query("f18_card_reasons")
def f18(b: Bindings):
    r = P.card_reasons(R.fit_reasons(interaction_scores(b)))
    return r.groupBy("line").agg(F.count("*").alias("n"))


@query("d09_exclude_demo")
def d09(b: Bindings):
    return P.exclude_demo(b.listings).select("listing_id", "url_hash")


@query("j01_listings_left_user_rows")
def j01(b: Bindings):
    return P.with_user(b.listings, b.feedback, USER).select("listing_id", "status")


@query("j02_user_rows_listings")
def j02(b: Bindings):
    return b.feedback.join(b.listings, "listing_id").select("user_id", "listing_id", "status", "opportunity_type")


@query("j03_requirements_of_users")
def j03(b: Bindings):
    owners = b.feedback.select("user_id").distinct()
    return b.requirements.join(owners, "user_id", "left_semi").groupBy("user_id").agg(F.count_if(~F.col("is_completed")).alias("open_tasks"))


@query("j06_listings_without_feedback")
def j06(b: Bindings):
    return b.listings.join(b.feedback, "listing_id", "left_anti").select("listing_id")


@query("j08_in_list_fetch")
def j08(b: Bindings):
    wanted = b.feedback.filter(F.col("status") == "applied").select("listing_id")
    return b.listings.join(wanted, "listing_id", "left_semi").select("listing_id", T.joined(F.col("tags")).alias("tags"))
