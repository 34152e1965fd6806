"""Operational analytics over runs, sources, decisions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.operators.gate import with_verdict

DEACTIVATE_AT = 5


def source_health(sources: DataFrame, listings: DataFrame, runs: DataFrame) -> DataFrame:
    """Listing count (0 when none), last and next fetch per source."""
    counts = listings.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("opportunity_count"))
    fetched = runs.groupBy(F.col("source_id").alias("id")).agg(F.max("finished_at").alias("last_fetched_at"))
    return (sources.select("id", "name", "is_active", "next_fetch_at", "last_error").join(counts, "id", "left").join(fetched, "id", "left")
            .withColumn("opportunity_count", F.coalesce("opportunity_count", F.lit(0))))


def run_stats(decisions: DataFrame) -> DataFrame:
    """Run counters from per-item decisions (run_id, lane, created, updated, error)."""
    def n(cond: Column) -> Column:
        return F.count_if(cond)

    lane = F.col("lane")
    return decisions.groupBy("run_id").agg(
        F.count("*").alias("discovered"), n(lane == "admitted").alias("admitted"), n(lane == "investigate").alias("investigated"),
        n(lane == "rejected").alias("rejected_at_discover"), n(lane == "rejected_after_detail").alias("rejected_after_detail"),
        n(lane == "deferred").alias("deferred"), n(F.col("created")).alias("created"), n(F.col("updated")).alias("updated"),
        n(F.col("error")).alias("errors"))


def run_status(discovered: Column, errors: Column, created: Column, updated: Column) -> Column:
    return (F.when(discovered == 0, "partial").when((errors > 0) & (created == 0) & (updated == 0), "failed")
            .when(errors > 0, "partial").otherwise("completed"))


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4))


def outcome_stats(runs: DataFrame) -> DataFrame:
    """Totals, rates and the last run per source; every aggregate combines before the shuffle."""
    total = [F.sum(c).alias(f"{c}_total") for c in ("discovered", "admitted", "rejected", "created", "updated")]
    last = F.max(F.struct("finished_at", "run_id", "discovered", "admitted")).alias("last")
    out = runs.groupBy("source_id").agg(F.count("*").alias("runs"), *total, last)
    return out.withColumns({
        "admit_rate": rate(F.col("admitted_total"), F.col("discovered_total")),
        "persist_rate": rate(F.col("created_total") + F.col("updated_total"), F.col("discovered_total")),
    })


def outcome_bonus(stats: DataFrame) -> DataFrame:
    r = F.col("admit_rate")
    label = F.when(r >= 0.35, "high_admit_rate:").when(r >= 0.20, "moderate_admit_rate:").when((r < 0.08) & (F.col("runs") >= 3), "low_admit_rate:")
    return stats.withColumns({
        "bonus": F.when(r >= 0.35, 8).when(r >= 0.20, 4).when((r < 0.08) & (F.col("runs") >= 3), -6).otherwise(0),
        "bonus_reason": F.concat(label, F.format_string("%.2f", r)),
    })


def effective_authority(authority: Column, admit_rate: Column) -> Column:
    blended = 0.6 * authority + 0.4 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), admit_rate * 2.5))
    return F.when(admit_rate.isNull(), authority).otherwise(F.round(blended, 3))


def failure_streaks(runs: DataFrame) -> DataFrame:
    """Failed runs since the last completed one, per source: two combining aggregates, no ordered window."""
    clean = runs.filter(F.col("status") == "completed").groupBy("source_id").agg(F.max(F.struct("finished_at", "run_id")).alias("clean"))
    failed = runs.filter(F.col("status") == "failed").select("source_id", F.struct("finished_at", "run_id").alias("at"))
    since = failed.join(clean, "source_id", "left").filter(F.col("clean").isNull() | (F.col("at") > F.col("clean")))
    streak = since.groupBy("source_id").agg(F.count("*").alias("consecutive_failures"))
    out = runs.select("source_id").distinct().join(streak, "source_id", "left").withColumn(
        "consecutive_failures", F.coalesce("consecutive_failures", F.lit(0)))
    return out.withColumn("deactivate", F.col("consecutive_failures") >= DEACTIVATE_AT)


def score_summary(rows: DataFrame) -> DataFrame:
    """One row: range, mean, levels, missing components, degraded similarity, hard fails, no deadline."""
    s = F.col("fit_score")
    return rows.agg(
        F.count("*").alias("rows"), F.count(s).alias("scored"), F.min(s).alias("min_score"), F.max(s).alias("max_score"), F.avg(s).alias("mean_score"),
        *[F.count_if(F.col("fit_level") == lv).alias(lv) for lv in ("strong", "moderate", "weak")],
        F.count_if(~F.col("has_semantic")).alias("semantic_missing"), F.count_if(~F.col("has_urgency")).alias("urgency_missing"),
        F.count_if(F.col("hard_failed")).alias("hard_failed"), F.count_if(F.col("deadline").isNull()).alias("no_deadline"))


def score_histogram(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins between the extremes, which are scalar subqueries."""
    s = rows.filter(F.col("fit_score").isNotNull()).select("fit_score")
    lo, hi = s.agg(F.min("fit_score")).scalar(), s.agg(F.max("fit_score")).scalar()
    counted = s.groupBy("fit_score").agg(F.count("*").alias("n")).withColumns({"lo": lo, "step": (hi - lo) / bins})
    idx = F.when(F.col("step") <= 0, 0).otherwise(F.least(F.floor((F.col("fit_score") - F.col("lo")) / F.col("step")), F.lit(bins - 1)))
    return counted.groupBy(idx.cast("bigint").alias("bin"), "lo", "step").agg(F.sum("n").alias("n")).select(
        "bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("starts_at"), "n")


def verification_counts(listings: DataFrame) -> DataFrame:
    return listings.filter(F.col("duplicate_of").isNull()).groupBy(F.coalesce("verification_status", F.lit("unverified")).alias("status")).agg(F.count("*").alias("n"))


def verification_overview(sources: DataFrame, listings: DataFrame, runs: DataFrame) -> DataFrame:
    """Metric/value rows of the overview page."""
    src = sources.agg(F.count("*").alias("total_sources"), F.count_if("is_active").alias("active_sources"),
                      F.count_if(F.col("last_error").isNotNull()).alias("sources_with_errors"))
    counts = src.unpivot([], ["total_sources", "active_sources", "sources_with_errors"], "metric", "value")
    total = listings.agg(F.lit("total_opportunities").alias("metric"), F.count("*").alias("value"))
    status = verification_counts(listings).select(F.concat(F.lit("status:"), "status").alias("metric"), F.col("n").alias("value"))
    last = runs.agg(F.lit("last_run_epoch").alias("metric"), F.unix_seconds(F.max("finished_at")).alias("value"))
    return counts.unionByName(total).unionByName(status).unionByName(last)


def stage_durations(trace: DataFrame) -> DataFrame:
    """First start to last end per run and stage."""
    start = F.min(F.when(F.col("event_name") == "stage_start", F.col("happened_at")))
    end = F.max(F.when(F.col("event_name") == "stage_end", F.col("happened_at")))
    out = trace.groupBy("run_id", "stage").agg(start.alias("started"), end.alias("ended"))
    return out.withColumn("duration_ms", F.when(F.col("ended") >= F.col("started"), F.unix_millis("ended") - F.unix_millis("started")))


def rejection_breakdown(rejections: DataFrame) -> DataFrame:
    """Counts per stage and reason kind with subtotals."""
    kind = F.split_part("reason", F.lit(":"), F.lit(1))
    return rejections.select("stage", kind.alias("kind")).rollup("stage", "kind").agg(F.count("*").alias("n"))


def source_quality_report(rows: DataFrame) -> DataFrame:
    """Share of rows per source that parsed, are duplicates, stale, official or dated."""
    flags = ("parsed", "duplicate", "stale", "official", "dated")
    return rows.groupBy("source_id").agg(*[F.avg(F.col(f).cast("double")).alias(f + "_rate") for f in flags])


def confirmed_totals(listings: DataFrame) -> DataFrame:
    return listings.groupBy("source_id").agg(F.count_if(F.col("verification_status") == "primary_confirmed").alias("primary_confirmed_total"))


def rejections(decisions: DataFrame, stage: str = "discover") -> DataFrame:
    """Reject log rows with the widths of the log table."""
    return with_verdict(decisions, "reject").select(
        "source_id", "listing_id", F.lit("relevance").alias("stage"), F.substring(F.concat(F.lit(stage + ":"), "reason"), 1, 255).alias("reason"), "url",
        F.substring("title", 1, 500).alias("title"), F.substring(F.coalesce("summary", F.lit("")), 1, 500).alias("snippet"))


def recent(rows: DataFrame, order: list[Column], limit: int = 20) -> DataFrame:
    return rows.orderBy(*order).limit(limit)


