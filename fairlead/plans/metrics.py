"""Metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.bindings import Bindings
from fairlead.operators import gate as G
from fairlead.operators import metrics as M
from fairlead.plans.gate import LANE_COLUMNS, decisions
from fairlead.plans.registry import query


def r4(c, n: int = 4):
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, n)


@query("m01_source_health")
def m01(b: Bindings):
    return M.source_health(b.sources, b.listings, b.runs).select(
        "id", "name", "is_active", "opportunity_count", F.date_format("last_fetched_at", "yyyy-MM-dd").alias("last_fetched"),
        F.date_format("next_fetch_at", "yyyy-MM-dd").alias("next_fetch"), "last_error")


@query("m02_run_stats")
def m02(b: Bindings):
    lanes = G.triage(decisions(b).select(*LANE_COLUMNS)).withColumns({
        "run_id": F.col("source_id"), "created": (F.col("lane") == "admitted") & (F.col("listing_id") % 2 == 0),
        "updated": (F.col("lane") == "admitted") & (F.col("listing_id") % 2 == 1), "error": (F.col("lane") == "investigate") & (F.col("listing_id") % 5 == 0)})
    return M.run_stats(lanes)


@query("m03_run_status")
def m03(b: Bindings):
    return b.runs.select("run_id", M.run_status(F.col("discovered"), F.col("errors"), F.col("created"), F.col("updated")).alias("outcome"))


@query("m04_outcome_stats")
def m04(b: Bindings):
    s = M.outcome_stats(b.runs)
    return s.select("source_id", "runs", "discovered_total", "admitted_total", "rejected_total", "created_total", "updated_total",
                    r4("admit_rate").alias("admit_rate"), r4("persist_rate").alias("persist_rate"), F.col("last.run_id").alias("last_run_id"))


def _thin(b: Bindings):
    """Outcome rates spread over the whole range by source."""
    return M.outcome_stats(b.runs).withColumn("admit_rate", F.round((F.col("source_id") % 9) / 18.0 + 0.001, 4))


@query("m05_outcome_bonus")
def m05(b: Bindings):
    return M.outcome_bonus(_thin(b)).select("source_id", F.col("bonus").cast("bigint").alias("bonus"), "bonus_reason")


@query("m06_effective_authority")
def m06(b: Bindings):
    s = b.sources.join(_thin(b).withColumnRenamed("source_id", "id"), "id", "left")
    return s.select("id", r4(M.effective_authority(F.col("authority"), F.when(F.col("id") % 4 != 1, F.col("admit_rate"))), 3).alias("authority"))


@query("m07_failure_streaks")
def m07(b: Bindings):
    return M.failure_streaks(b.runs)


def _rows(b: Bindings):
    return b.feedback.join(b.listings.select("listing_id", "deadline"), "listing_id")


@query("m08_score_summary")
def m08(b: Bindings):
    return M.score_summary(_rows(b)).withColumn("mean_score", r4("mean_score"))


@query("m08_score_histogram")
def m08h(b: Bindings):
    return M.score_histogram(_rows(b)).select("bin", r4("starts_at").alias("starts_at"), "n")


@query("m09_verification_counts")
def m09(b: Bindings):
    return M.verification_counts(b.listings)


@query("m10_stage_durations")
def m10(b: Bindings):
    return M.stage_durations(b.trace).select("run_id", "stage", "duration_ms")


@query("s16_write_rejections")
def s16(b: Bindings):
    return M.rejections(decisions(b)).select("listing_id", "stage", "reason", F.md5("title").alias("title_md5"), F.md5("snippet").alias("snippet_md5"))


@query("m11_rejection_breakdown")
def m11(b: Bindings):
    d = G.with_verdict(decisions(b), "reject").select(F.when(F.col("source_id") % 2 == 0, "discover").otherwise("post_extract").alias("stage"), "reason")
    return M.rejection_breakdown(d)


@query("m12_source_quality_report")
def m12(b: Bindings):
    rows = b.listings.select("source_id", (F.col("title") != "").alias("parsed"), F.col("duplicate_of").isNotNull().alias("duplicate"),
                             F.coalesce(F.col("verification_status") == "stale", F.lit(False)).alias("stale"),
                             F.coalesce(F.col("verification_status") == "primary_confirmed", F.lit(False)).alias("official"), F.col("deadline").isNotNull().alias("dated"))
    r = M.source_quality_report(rows)
    return r.select("source_id", *[r4(c).alias(c) for c in r.columns if c != "source_id"])


@query("v14_confirmed_totals")
def v14(b: Bindings):
    return M.confirmed_totals(b.listings)


@query("f16_verification_overview")
def f16(b: Bindings):
    return M.verification_overview(b.sources, b.listings, b.runs)


@query("f17_recent_runs")
def f17(b: Bindings):
    return M.recent(b.runs, [F.col("finished_at").desc(), F.col("run_id").desc()], 20).select("run_id", "source_id", "status")


@query("j04_sources_with_counts")
def j04(b: Bindings):
    return M.source_health(b.sources, b.listings.filter(F.col("duplicate_of").isNull()), b.runs).select("id", "opportunity_count")
