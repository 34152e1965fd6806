"""Oracles of the metric queries."""

from __future__ import annotations

from fairlead.bindings import with_views
from fairlead.oracle.gate import ALL, _LANES, gq
from fairlead.plans.registry import oracle


def mq(name: str, views: str, sql: str) -> None:
    oracle(name, with_views(views, sql))


mq("m01_source_health", "sources listings runs", """SELECT s.id, s.name, s.is_active, coalesce(c.n, 0) AS opportunity_count, strftime(r.t, '%Y-%m-%d') AS last_fetched,
 strftime(s.next_fetch_at, '%Y-%m-%d') AS next_fetch, s.last_error FROM sources s LEFT JOIN (SELECT source_id, count(*) AS n FROM listings GROUP BY 1) c ON c.source_id = s.id
 LEFT JOIN (SELECT source_id, max(finished_at) AS t FROM runs GROUP BY 1) r ON r.source_id = s.id""")
gq("m02_run_stats", """SELECT source_id AS run_id, count(*) AS discovered, count(*) FILTER (lane = 'admitted') AS admitted, count(*) FILTER (lane = 'investigate') AS investigated,
 count(*) FILTER (lane = 'rejected') AS rejected_at_discover, 0::BIGINT AS rejected_after_detail, count(*) FILTER (lane = 'deferred') AS deferred,
 count(*) FILTER (lane = 'admitted' AND listing_id % 2 = 0) AS created, count(*) FILTER (lane = 'admitted' AND listing_id % 2 = 1) AS updated,
 count(*) FILTER (lane = 'investigate' AND listing_id % 5 = 0) AS errors FROM lanes GROUP BY source_id""", _LANES.replace("{budget}", "40").replace("{items}", ALL))
mq("m03_run_status", "runs", """SELECT run_id, CASE WHEN discovered = 0 THEN 'partial' WHEN errors > 0 AND created + updated = 0 THEN 'failed' WHEN errors > 0 THEN 'partial' ELSE 'completed' END AS outcome FROM runs""")
TOT = """SELECT source_id, count(*) AS runs, CAST(sum(discovered) AS BIGINT) AS discovered_total, CAST(sum(admitted) AS BIGINT) AS admitted_total, CAST(sum(rejected) AS BIGINT) AS rejected_total,
 CAST(sum(created) AS BIGINT) AS created_total, CAST(sum(updated) AS BIGINT) AS updated_total, arg_max(run_id, row(finished_at, run_id)) AS last_run_id FROM runs GROUP BY source_id"""
mq("m04_outcome_stats", "runs", f"""SELECT * EXCLUDE (last_run_id), round(round(admitted_total::DOUBLE / discovered_total, 4) + 1e-9, 4) AS admit_rate,
 round(round((created_total + updated_total)::DOUBLE / discovered_total, 4) + 1e-9, 4) AS persist_rate, last_run_id FROM ({TOT})""")
THIN = "SELECT DISTINCT source_id, round((source_id % 9) / 18.0::DOUBLE + 0.001, 4) AS r FROM runs"
mq("m05_outcome_bonus", "runs", f"""SELECT source_id, CAST(CASE WHEN r >= 0.35 THEN 8 WHEN r >= 0.2 THEN 4 WHEN r < 0.08 THEN -6 ELSE 0 END AS BIGINT) AS bonus,
 CASE WHEN r >= 0.35 THEN 'high_admit_rate:' WHEN r >= 0.2 THEN 'moderate_admit_rate:' WHEN r < 0.08 THEN 'low_admit_rate:' END || printf('%.2f', r) AS bonus_reason FROM ({THIN})""")
mq("m06_effective_authority", "sources runs", f"""SELECT s.id, round(CASE WHEN t.r IS NULL OR s.id % 4 = 1 THEN s.authority ELSE 0.6 * s.authority + 0.4 * least(1.0, t.r * 2.5) END + 1e-9, 3) AS authority
 FROM sources s LEFT JOIN ({THIN}) t ON t.source_id = s.id""")
mq("m07_failure_streaks", "runs", """, o AS (SELECT *, max(CASE WHEN status = 'completed' THEN row(finished_at, run_id) END) OVER (PARTITION BY source_id) AS c FROM runs)
SELECT source_id, count(*) FILTER (status = 'failed' AND (c IS NULL OR row(finished_at, run_id) > c)) AS consecutive_failures,
 count(*) FILTER (status = 'failed' AND (c IS NULL OR row(finished_at, run_id) > c)) >= 5 AS deactivate FROM o GROUP BY source_id""")
mq("m08_score_summary", "feedback listings", """SELECT count(*) AS rows, count(fit_score) AS scored, min(fit_score) AS min_score, max(fit_score) AS max_score, round(avg(fit_score) + 1e-9, 4) AS mean_score,
 count(*) FILTER (fit_level = 'strong') AS strong, count(*) FILTER (fit_level = 'moderate') AS moderate, count(*) FILTER (fit_level = 'weak') AS weak,
 count(*) FILTER (NOT has_semantic) AS semantic_missing, count(*) FILTER (NOT has_urgency) AS urgency_missing, count(*) FILTER (hard_failed) AS hard_failed,
 count(*) FILTER (deadline IS NULL) AS no_deadline FROM feedback JOIN listings USING (listing_id)""")
mq("m08_score_histogram", "feedback", """, r AS (SELECT min(fit_score) AS lo, max(fit_score) AS hi FROM feedback),
b AS (SELECT least(CAST(floor((fit_score - lo) / ((hi - lo) / 10)) AS BIGINT), 9) AS bin, lo, (hi - lo) / 10 AS step FROM feedback, r)
SELECT bin, round(lo + bin * step + 1e-9, 4) AS starts_at, count(*) AS n FROM b GROUP BY bin, lo, step""")
mq("m09_verification_counts", "listings", "SELECT coalesce(verification_status, 'unverified') AS status, count(*) AS n FROM listings WHERE duplicate_of IS NULL GROUP BY 1")
mq("m10_stage_durations", "trace", """, g AS (SELECT run_id, stage, min(happened_at) FILTER (event_name = 'stage_start') AS s, max(happened_at) FILTER (event_name = 'stage_end') AS e FROM trace GROUP BY ALL)
SELECT run_id, stage, CASE WHEN e >= s THEN epoch_us(e) // 1000 - epoch_us(s) // 1000 END AS duration_ms FROM g""")
gq("s16_write_rejections", """SELECT listing_id, 'relevance' AS stage, substr('discover:' || reason, 1, 255) AS reason, md5(substr(title, 1, 500)) AS title_md5,
 md5(substr(coalesce(summary, ''), 1, 500)) AS snippet_md5 FROM gate WHERE verdict = 'reject'""")
gq("m11_rejection_breakdown", """, r AS (SELECT CASE WHEN source_id % 2 = 0 THEN 'discover' ELSE 'post_extract' END AS stage, split_part(reason, ':', 1) AS kind FROM gate WHERE verdict = 'reject')
SELECT stage, kind, count(*) AS n FROM r GROUP BY ROLLUP(stage, kind)""")
mq("m12_source_quality_report", "listings", """SELECT source_id, round(avg((title <> '')::INT) + 1e-9, 4) AS parsed_rate, round(avg((duplicate_of IS NOT NULL)::INT) + 1e-9, 4) AS duplicate_rate,
 round(avg(coalesce(verification_status = 'stale', false)::INT) + 1e-9, 4) AS stale_rate, round(avg(coalesce(verification_status = 'primary_confirmed', false)::INT) + 1e-9, 4) AS official_rate,
 round(avg((deadline IS NOT NULL)::INT) + 1e-9, 4) AS dated_rate FROM listings GROUP BY source_id""")
mq("v14_confirmed_totals", "listings", "SELECT source_id, count(*) FILTER (verification_status = 'primary_confirmed') AS primary_confirmed_total FROM listings GROUP BY source_id")
mq("f16_verification_overview", "sources listings runs", """SELECT 'total_sources' AS metric, count(*) AS value FROM sources UNION ALL SELECT 'active_sources', count(*) FROM sources WHERE is_active
 UNION ALL SELECT 'sources_with_errors', count(*) FROM sources WHERE last_error IS NOT NULL UNION ALL SELECT 'total_opportunities', count(*) FROM listings
 UNION ALL SELECT 'status:' || coalesce(verification_status, 'unverified'), count(*) FROM listings WHERE duplicate_of IS NULL GROUP BY 1
 UNION ALL SELECT 'last_run_epoch', CAST(floor(epoch(max(finished_at))) AS BIGINT) FROM runs""")
mq("f17_recent_runs", "runs", "SELECT run_id, source_id, status FROM runs ORDER BY finished_at DESC, run_id DESC LIMIT 20")
mq("j04_sources_with_counts", "sources listings", """SELECT s.id, coalesce(c.n, 0) AS opportunity_count FROM sources s LEFT JOIN (SELECT source_id, count(*) AS n FROM listings
 WHERE duplicate_of IS NULL GROUP BY 1) c ON c.source_id = s.id""")
