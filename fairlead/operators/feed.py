"""Read queries of the product: feeds, summaries, digests, reminders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead.functions import dates as D
from fairlead.functions import scoring as S
from fairlead.rules import fact_rules as fr

CLOSING_SOON_DAYS = 14


def response_view(rows: DataFrame, as_of: Column) -> DataFrame:
    """Presentation columns of listing rows joined with a user's row (fit_score, hide_percent, fit_explanation)."""
    days = D.days_until(F.col("deadline"), as_of)
    hidden = F.coalesce("hide_percent", F.lit(False))
    state = S.trust_state(F.col("verification_status"))
    out = rows.withColumns({"days_until_deadline": days, "trust_state": state})
    return out.withColumns({
        "fit_percent": F.when(~hidden, F.round(F.col("fit_score") * 100).cast("bigint")),
        "shown_score": F.when(~hidden, F.col("fit_score")),
        "fit_explanation": F.when(hidden, fr.NEUTRAL_REASON).otherwise(F.col("fit_explanation")),
        "trust_label": S.lookup(F.col("trust_state"), fr.TRUST_LABELS),
        "trust_hint": S.lookup(F.col("trust_state"), fr.TRUST_HINTS),
        "urgency_label": D.urgency_label(F.col("days_until_deadline")),
        "deadline_bucket": D.deadline_bucket(F.col("days_until_deadline")),
    })


def exclude_demo(listings: DataFrame) -> DataFrame:
    return listings.filter(~F.startswith("url_hash", F.lit("demo-")))


def visible_listings(listings: DataFrame) -> DataFrame:
    return exclude_demo(listings).filter(
        F.col("duplicate_of").isNull() & (F.col("verification_status").isNull() | (F.col("verification_status") != "stale")))


def with_user(listings: DataFrame, feedback: DataFrame, user_id) -> DataFrame:
    """Left join with the rows of one user; the user test is part of the join, not a filter after it."""
    mine = feedback.filter(F.col("user_id") == user_id).withColumnRenamed("created_at", "row_created_at")
    return listings.join(mine, "listing_id", "left")


def eligibility_pushdown(rows: DataFrame, as_of: Column, reject: Sequence[str], require_funding: str | None) -> DataFrame:
    """SQL-style filter: a NULL summary fails every phrase test, and phrases act as patterns."""
    out = rows.filter(F.col("deadline").isNull() | (F.col("deadline") >= as_of))
    for phrase in reject:
        if phrase:
            out = out.filter(~(F.col("title").ilike(f"%{phrase}%") | F.col("summary").ilike(f"%{phrase}%")))
    if require_funding == "full_only":
        out = out.filter(F.col("funding_type").isNull() | ~F.col("funding_type").isin("self", "partial"))
    return out


def passes_eligibility(rows: DataFrame, reject: Sequence[str], require_funding: str | None) -> DataFrame:
    """NULL-safe read-time filter over title, summary and institution with plain substrings."""
    text = F.lower(F.concat_ws(" ", F.col("title"), F.coalesce("summary", F.lit("")), F.coalesce("institution", F.lit(""))))
    bad = F.lit(False)
    for phrase in reject:
        if phrase:
            bad = bad | F.contains(text, F.lit(phrase.lower()))
    out = rows.filter(~bad)
    if require_funding == "full_only":
        out = out.filter(~F.coalesce(F.col("funding_type").isin("partial", "self"), F.lit(False)))
    return out


def search_filter(rows: DataFrame, term: str) -> DataFrame:
    search = F.substring(F.lower(F.concat("title", F.lit(" "), F.coalesce("summary", F.lit("")))), 1, 8000)
    return rows.filter(F.col("title").ilike(f"%{term}%") | F.col("summary").ilike(f"%{term}%") | search.ilike(f"%{term.lower()}%"))


HIDDEN = ("archived", "dismissed")


def bucket_filter(rows: DataFrame, bucket: str, as_of: Column) -> DataFrame:
    """Rows of one tab; listings the user never touched (status NULL) count as visible."""
    st = F.col("status")
    visible = st.isNull() | ~st.isin(*HIDDEN)
    if bucket == "saved":
        return rows.filter(st == "saved")
    if bucket == "applied":
        return rows.filter(st.isin("applied", "in_progress"))
    if bucket == "dismissed":
        return rows.filter(st.isin("dismissed", "archived"))
    if bucket == "closing_soon":
        return rows.filter(F.col("deadline").isNotNull() & (F.col("deadline") <= as_of + F.make_dt_interval(F.lit(CLOSING_SOON_DAYS))) & visible)
    if bucket == "matches":
        return rows.filter(visible)
    raise ValueError(f"unknown bucket {bucket!r}")


def trust_tiebreak() -> Column:
    return F.when(F.col("verification_status") == "primary_confirmed", 0).when(F.col("verification_status") == "aggregator_only", 1).otherwise(2)


def feed_order(bucket: str, sort: str) -> list[Column]:
    """Order keys; the listing id settles what the rest leaves open."""
    newest, last = F.col("created_at").desc(), F.col("listing_id").asc()
    if bucket == "closing_soon":
        return [F.col("deadline").asc(), newest, last]
    rank = F.col("rank_position").asc_nulls_last()
    if sort == "deadline":
        return [F.col("deadline").asc_nulls_last(), rank, trust_tiebreak().asc(), newest, last]
    return [rank, F.col("fit_score").desc_nulls_last(), trust_tiebreak().asc(), newest, last]


def selected(listings: DataFrame, feedback: DataFrame, user_id, as_of: Column, *, rules: dict | None = None, verified_only: bool = False,
             search: str | None = None, opportunity_type: str | None = None, funding_type: str | None = None) -> DataFrame:
    rows = with_user(visible_listings(listings), feedback, user_id)
    if verified_only:
        rows = rows.filter(F.col("verification_status") == "primary_confirmed")
    if search:
        rows = search_filter(rows, search)
    if opportunity_type:
        rows = rows.filter(F.col("opportunity_type") == opportunity_type)
    if funding_type:
        rows = rows.filter(F.col("funding_type") == funding_type)
    if rules:
        rows = eligibility_pushdown(rows, as_of, rules.get("reject") or [], rules.get("require_funding"))
    return rows


def page(rows: DataFrame, order: list[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """One page with its place; a sort with a limit is a per-task top-k merged on the driver side of the plan."""
    size = max(1, min(limit, 100))
    return rows.orderBy(*order).offset(offset).limit(size)


def _forward(c: Column | str) -> Column:
    """Ascending with nulls last, as a struct that compares so."""
    c = F.col(c) if isinstance(c, str) else c
    return F.struct(c.isNull().alias("none"), c.alias("value"))


def page_key(bucket: str, sort: str) -> Column:
    """One value per row that ascends in the order of feed_order: what a cursor remembers."""
    newest, last = _forward(-F.unix_micros("created_at")).alias("newest"), F.col("listing_id").alias("id")
    if bucket == "closing_soon":
        return F.struct(F.unix_micros("deadline").alias("first"), newest, last)
    rank, trust = _forward("rank_position"), trust_tiebreak().alias("trust")
    if sort == "deadline":
        return F.struct(_forward(F.unix_micros("deadline")).alias("first"), rank.alias("rank"), trust, newest, last)
    return F.struct(rank.alias("first"), _forward(-F.col("fit_score").cast("double")).alias("fit"), trust, newest, last)


def page_after(rows: DataFrame, bucket: str, sort: str, after: str | None = None, limit: int = 20) -> DataFrame:
    """The page behind a cursor (`cursor` of the last row of the page before; none for the first page), each row with its
    own. What comes before is filtered away instead of sorted and skipped; on the rank or deadline that leads the order
    there is a plain filter besides, which reaches the source."""
    keyed = rows.withColumn("_key", page_key(bucket, sort))
    if after is not None:
        there = F.from_json(F.lit(after), keyed.schema["_key"].dataType)
        keyed = keyed.filter(F.col("_key") > there)
        if bucket == "closing_soon":
            keyed = keyed.filter(F.col("deadline") >= F.timestamp_micros(there["first"]))
        else:
            lead = F.col("deadline") if sort == "deadline" else F.col("rank_position")
            least = F.timestamp_micros(there["first"]["value"]) if sort == "deadline" else there["first"]["value"]
            keyed = keyed.filter(lead.isNull() | (lead >= least) | least.isNull())
    size = max(1, min(limit, 100))
    return keyed.orderBy("_key").limit(size).withColumn("cursor", F.to_json("_key", {"ignoreNullFields": "false"})).drop("_key")


def page_info(rows: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    size = max(1, min(limit, 100))
    total = F.count("*")
    shown = F.greatest(F.lit(0), F.least(F.lit(size), total - offset))
    return rows.agg(total.alias("total"), shown.cast("bigint").alias("shown"),
                    F.when(offset + shown < total, (offset + shown).cast("string")).alias("next_cursor"))


def list_opportunities(listings: DataFrame, feedback: DataFrame, user_id, as_of: Column, *, bucket: str = "matches", sort: str = "fit",
                       limit: int = 20, cursor: int = 0, **filters) -> DataFrame:
    rows = bucket_filter(selected(listings, feedback, user_id, as_of, **filters), bucket, as_of)
    return response_view(page(rows, feed_order(bucket, sort), limit, cursor), as_of)


def unknown_deadline_count(listings: DataFrame, feedback: DataFrame, user_id, as_of: Column, **filters) -> DataFrame:
    rows = selected(listings, feedback, user_id, as_of, **filters)
    return rows.agg(F.count_if(F.col("deadline").isNull() & (F.col("status").isNull() | ~F.col("status").isin(*HIDDEN))).alias("unknown_deadlines"))


def grouped_feed(rows: DataFrame, as_of: Column) -> DataFrame:
    """Live rows with their section (scholarships, fellowships, other)."""
    live = rows.filter(F.col("deadline").isNull() | (F.col("deadline") >= as_of))
    return live.withColumn("section", F.when(F.col("opportunity_type") == "scholarship", "scholarships")
                           .when(F.col("opportunity_type") == "fellowship", "fellowships").otherwise("other"))


def last_tuesday(as_of: Column) -> Column:
    """The most recent Tuesday at the same time of day (today when it is one)."""
    return as_of - F.make_dt_interval((F.weekday(as_of) + 6) % 7)


def prep_due(requirements: DataFrame, until: Column) -> DataFrame:
    return requirements.filter(~F.col("is_completed") & (F.col("due_date") <= until)).groupBy("user_id").agg(F.count("*").alias("prep_due"))


def feed_summary(feed: DataFrame, requirements: DataFrame, as_of: Column) -> DataFrame:
    """Per user: rows new since Tuesday, deadlines within a week, open preparation tasks."""
    week = as_of + F.make_dt_interval(F.lit(7))
    seen = feed.groupBy("user_id").agg(F.count_if(F.col("created_at") >= last_tuesday(as_of)).alias("new_since"),
                                       F.count_if(F.col("deadline") <= week).alias("deadlines_this_week"))
    return seen.join(prep_due(requirements, week), "user_id", "left").withColumn("prep_due", F.coalesce("prep_due", F.lit(0)))


def top_per_user(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First n rows per user; the rank filter is applied per task before the shuffle as well."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(*order))).filter(F.col("place") <= n)


def dashboard(feed: DataFrame, learning: DataFrame, notifications: DataFrame) -> DataFrame:
    """(user_id, part, item_id, place): first 20 new cards, all in progress, learning items, last 20 notifications."""
    order = [F.col("fit_score").desc_nulls_last(), trust_tiebreak().asc(), F.col("created_at").desc(), F.col("listing_id")]
    fresh = top_per_user(feed.filter(F.col("status").isNull() | (F.col("status") == "new")), order, 20)
    notes = top_per_user(notifications, [F.col("happened_at").desc(), F.col("event_id").desc()], 20)
    none = F.lit(None).cast("int")
    return (fresh.select("user_id", F.lit("updated").alias("part"), F.col("listing_id").alias("item_id"), "place")
            .unionByName(feed.filter(F.col("status") == "in_progress").select("user_id", F.lit("in_progress").alias("part"), F.col("listing_id").alias("item_id"), none.alias("place")))
            .unionByName(learning.select("user_id", F.lit("upskilling").alias("part"), "item_id", none.alias("place")))
            .unionByName(notes.select("user_id", F.lit("notification").alias("part"), F.col("event_id").alias("item_id"), "place")))


def weekly_focus(feedback: DataFrame, listings: DataFrame, requirements: DataFrame, learning: DataFrame, as_of: Column) -> DataFrame:
    """Counts of deadlines (past ones included), due tasks and open learning per user, and the sentence made of them."""
    week = as_of + F.make_dt_interval(F.lit(7))
    due = (feedback.filter(F.col("status").isin("in_progress", "applied")).select("user_id", "listing_id")
           .join(listings.filter(F.col("deadline") <= week).select("listing_id"), "listing_id").groupBy("user_id").agg(F.count("*").alias("deadlines")))
    study = learning.filter(F.col("status") != "completed").groupBy("user_id").agg(F.count("*").alias("learning"))
    users = feedback.select("user_id").distinct()
    all_ = users.join(due, "user_id", "left").join(prep_due(requirements, week), "user_id", "left").join(study, "user_id", "left").na.fill(0)
    parts = F.array_compact(F.array(
        F.when(F.col("deadlines") > 0, F.concat(F.col("deadlines").cast("string"), F.lit(" deadline(s) this week"))),
        F.when(F.col("prep_due") > 0, F.concat(F.col("prep_due").cast("string"), F.lit(" prep task(s) due"))),
        F.when(F.col("learning") > 0, F.concat(F.col("learning").cast("string"), F.lit(" learning item(s) in progress")))))
    return all_.withColumn("focus_summary", F.when(F.size(parts) > 0, F.array_join(parts, " · ")).otherwise("No urgent items this week"))


def daily_digest(feedback: DataFrame, listings: DataFrame, as_of: Column) -> DataFrame:
    """Message per user: up to ten new strong or moderate matches of the last day, best first."""
    fresh = feedback.filter((F.col("status") == "new") & (F.col("created_at") >= as_of - F.make_dt_interval(F.lit(1)))
                            & F.col("fit_level").isin("strong", "moderate"))
    top = top_per_user(fresh, [F.col("fit_score").desc(), F.col("listing_id")], 10)
    lines = top.join(listings.select("listing_id", "title"), "listing_id").withColumn(
        "line", F.concat(F.lit("- "), "title", F.lit(" ("), F.coalesce("fit_explanation", F.lit("Relevant match")), F.lit(")")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda s: s["line"]), "\n")
    return lines.groupBy("user_id").agg(
        F.concat(F.lit("New career opportunities matched to your profile:\n\n"), body).alias("body"), F.count("*").alias("n"))


def deadline_reminders(feedback: DataFrame, listings: DataFrame, as_of: Column) -> DataFrame:
    """One message per active row whose deadline is 7, 3 or 1 days away."""
    days = D.days_until(F.col("deadline"), as_of)
    due = listings.select("listing_id", "title", days.alias("days")).filter(F.col("days").isin(7, 3, 1))
    active = feedback.filter(F.col("status").isin("saved", "applied", "in_progress")).select("user_id", "listing_id")
    return active.join(due, "listing_id").select(
        "user_id", "listing_id", "days", F.concat(F.lit("Deadline reminder: "), "title").alias("title"),
        F.concat(F.col("title"), F.lit(" deadline is in "), F.col("days").cast("string"), F.lit(" day(s).")).alias("body"))


def opportunity_detail(listings: DataFrame, feedback: DataFrame, profiles: DataFrame, user_id, listing_id, as_of: Column) -> DataFrame:
    """One listing for one user; nothing for demo rows or users without a profile."""
    has_profile = profiles.filter(F.col("user_id") == user_id).select(F.lit(listing_id).cast("bigint").alias("listing_id"))
    row = exclude_demo(listings).filter(F.col("listing_id") == listing_id).join(has_profile, "listing_id", "left_semi")
    return response_view(with_user(row, feedback, user_id), as_of)


def card_reasons(rows: DataFrame) -> DataFrame:
    """One line per reason with a sign for its direction."""
    mark = {"positive": "+", "negative": "-", "neutral": "."}
    lines = rows.select("user_id", "listing_id", F.posexplode("reasons").alias("pos", "r"))
    return lines.select("user_id", "listing_id", "pos", F.concat(
        F.coalesce(S.lookup(F.col("r.direction"), mark), F.lit("?")), F.lit(" "), F.col("r.label")).alias("line"))
