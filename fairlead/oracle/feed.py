"""Oracles of the feed queries."""

from __future__ import annotations

from fairlead.bindings import with_views
from fairlead.oracle.helpers import AS_OF_SQL, days_until
from fairlead.oracle.ranking import PAIRS, REASONS, VIEWS, scores
from fairlead.oracle.text import STATE, bucket, table_case, urgency_text
from fairlead.plans.registry import oracle
from fairlead.rules import fact_rules as fr

USER = 7
VISIBLE = "duplicate_of IS NULL AND NOT starts_with(url_hash, 'demo-') AND (verification_status IS NULL OR verification_status <> 'stale')"
PUSH = (f"(deadline IS NULL OR deadline >= {AS_OF_SQL}) AND NOT (title ILIKE '%PhD only%' OR summary ILIKE '%PhD only%') AND NOT (title ILIKE '%unpaid%' OR summary ILIKE '%unpaid%') "
        "AND (funding_type IS NULL OR funding_type NOT IN ('self', 'partial'))")
SEEN = "(status IS NULL OR status NOT IN ('archived', 'dismissed'))"
TIE = "CASE verification_status WHEN 'primary_confirmed' THEN 0 WHEN 'aggregator_only' THEN 1 ELSE 2 END"
ROWS = f""", rows_ AS (SELECT l.*, f.status, f.fit_score, f.rank_position, f.hide_percent, f.fit_explanation FROM listings l LEFT JOIN feedback f
  ON f.listing_id = l.listing_id AND f.user_id = {USER} WHERE {VISIBLE})"""
D = days_until("deadline")


def fq(name: str, sql: str, views: str = "listings feedback") -> None:
    oracle(name, with_views(views, sql))


fq("f01_list_opportunities", ROWS + f"""
SELECT listing_id, status, CASE WHEN NOT coalesce(hide_percent, false) THEN CAST(round(fit_score * 100) AS BIGINT) END AS fit_percent, rank_position, {STATE} AS trust_state, {urgency_text(D)} AS urgency_label
FROM rows_ WHERE {PUSH} AND {SEEN} ORDER BY rank_position NULLS LAST, fit_score DESC NULLS LAST, {TIE}, created_at DESC, listing_id LIMIT 50""")
fq("f02_bucket_filter", ROWS + f"""
SELECT 'matches' AS bucket, listing_id, status FROM rows_ WHERE {SEEN}
UNION ALL SELECT 'closing_soon', listing_id, status FROM rows_ WHERE {SEEN} AND deadline <= {AS_OF_SQL} + INTERVAL 14 DAY
UNION ALL SELECT 'saved', listing_id, status FROM rows_ WHERE status = 'saved'
UNION ALL SELECT 'applied', listing_id, status FROM rows_ WHERE status IN ('applied', 'in_progress')
UNION ALL SELECT 'dismissed', listing_id, status FROM rows_ WHERE status IN ('dismissed', 'archived')""")
fq("f03_eligibility_pushdown", f"SELECT listing_id, funding_type FROM listings WHERE {PUSH}", "listings")
fq("f04_search_filter", """SELECT listing_id FROM listings WHERE title ILIKE '%Stipend%' OR summary ILIKE '%Stipend%'
  OR substr(lower(title || ' ' || coalesce(summary, '')), 1, 8000) ILIKE '%stipend%'""", "listings")
fq("f05_feed_order", ROWS + f"""
SELECT listing_id, rank_position, strftime(deadline, '%Y-%m-%d') AS deadline FROM rows_ WHERE {SEEN} ORDER BY rows_.deadline NULLS LAST, rank_position NULLS LAST, {TIE}, created_at DESC, listing_id LIMIT 100""")
fq("f06_passes_eligibility", """SELECT listing_id FROM listings WHERE NOT contains(lower(concat_ws(' ', title, coalesce(summary, ''), coalesce(institution, ''))), 'phd only')
  AND NOT contains(lower(concat_ws(' ', title, coalesce(summary, ''), coalesce(institution, ''))), 'unpaid') AND coalesce(funding_type, '') NOT IN ('partial', 'self')""", "listings")
fq("f07_page_info", ROWS + f""", t AS (SELECT count(*) AS total FROM rows_ WHERE {SEEN} AND deadline <= {AS_OF_SQL} + INTERVAL 14 DAY)
SELECT total, greatest(0, least(20, total - 40)) AS shown, CASE WHEN 40 + greatest(0, least(20, total - 40)) < total THEN CAST(40 + greatest(0, least(20, total - 40)) AS VARCHAR) END AS next_cursor FROM t""")
fq("f07_keyset_page", ROWS + f"""
SELECT listing_id, rank_position FROM rows_ WHERE {SEEN} ORDER BY rank_position NULLS LAST, fit_score DESC NULLS LAST, {TIE}, created_at DESC, listing_id LIMIT 7 OFFSET 14""")
fq("f08_unknown_deadline_count", ROWS + f" SELECT count(*) AS unknown_deadlines FROM rows_ WHERE {PUSH} AND {SEEN} AND deadline IS NULL")
FEED = f""", feed AS (SELECT l.*, f.user_id, f.status, f.fit_score FROM listings l JOIN feedback f USING (listing_id) WHERE {VISIBLE} AND (deadline IS NULL OR deadline >= {AS_OF_SQL}))"""
fq("f09_grouped_feed", FEED + " SELECT user_id, listing_id, CASE opportunity_type WHEN 'scholarship' THEN 'scholarships' WHEN 'fellowship' THEN 'fellowships' ELSE 'other' END AS section FROM feed")
PREP = f"SELECT user_id, count(*) AS prep_due FROM requirements WHERE NOT is_completed AND due_date <= {AS_OF_SQL} + INTERVAL 7 DAY GROUP BY user_id"
fq("f10_feed_summary", FEED + f""", p AS ({PREP}), s AS (SELECT user_id, count(*) FILTER (created_at >= TIMESTAMP '2026-06-30 00:00:00') AS new_since,
  count(*) FILTER (deadline <= {AS_OF_SQL} + INTERVAL 7 DAY) AS deadlines_this_week FROM feed GROUP BY user_id)
SELECT user_id, new_since, deadlines_this_week, coalesce(prep_due, 0) AS prep_due FROM s LEFT JOIN p USING (user_id)""", "listings feedback requirements")
fq("f11_dashboard", FEED + f"""
SELECT user_id, 'updated' AS part, listing_id AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY fit_score DESC NULLS LAST, {TIE}, created_at DESC, listing_id) AS place FROM feed
  WHERE status IS NULL OR status = 'new' QUALIFY place <= 20
UNION ALL SELECT user_id, 'in_progress', listing_id, NULL FROM feed WHERE status = 'in_progress'
UNION ALL SELECT user_id, 'upskilling', item_id, NULL FROM learning
UNION ALL SELECT user_id, 'notification', event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY happened_at DESC, event_id DESC) AS rn FROM status_events WHERE status = 'new') WHERE rn <= 20""",
   "listings feedback learning status_events")
fq("f12_weekly_focus", f""", d AS (SELECT user_id, count(*) AS deadlines FROM feedback JOIN listings USING (listing_id) WHERE status IN ('in_progress', 'applied') AND deadline <= {AS_OF_SQL} + INTERVAL 7 DAY GROUP BY user_id),
p AS ({PREP}), l AS (SELECT user_id, count(*) AS learning FROM learning WHERE status <> 'completed' GROUP BY user_id),
a AS (SELECT user_id, coalesce(deadlines, 0) AS deadlines, coalesce(prep_due, 0) AS prep_due, coalesce(l.learning, 0) AS learning FROM (SELECT DISTINCT user_id FROM feedback) u LEFT JOIN d USING (user_id) LEFT JOIN p USING (user_id) LEFT JOIN l USING (user_id))
SELECT *, CASE WHEN deadlines + prep_due + learning = 0 THEN 'No urgent items this week' ELSE concat_ws(' · ', CASE WHEN deadlines > 0 THEN deadlines || ' deadline(s) this week' END,
  CASE WHEN prep_due > 0 THEN prep_due || ' prep task(s) due' END, CASE WHEN learning > 0 THEN learning || ' learning item(s) in progress' END) END AS focus_summary FROM a""",
   "listings feedback requirements learning")
fq("f13_daily_digest", f""", t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fit_score DESC, listing_id) AS rn FROM feedback WHERE status = 'new' AND created_at >= {AS_OF_SQL} - INTERVAL 1 DAY AND fit_level IN ('strong', 'moderate'))
SELECT user_id, count(*) AS n, md5('New career opportunities matched to your profile:' || chr(10) || chr(10) || string_agg('- ' || title || ' (' || coalesce(fit_explanation, 'Relevant match') || ')', chr(10) ORDER BY rn)) AS body_md5
FROM t JOIN listings USING (listing_id) WHERE rn <= 10 GROUP BY user_id""")
fq("f14_deadline_reminders", f"""SELECT user_id, listing_id, {D} AS days, 'Deadline reminder: ' || title AS title, title || ' deadline is in ' || {D} || ' day(s).' AS body
FROM feedback JOIN listings USING (listing_id) WHERE status IN ('saved', 'applied', 'in_progress') AND {D} IN (7, 3, 1)""")
fq("f15_opportunity_detail", f"""SELECT l.listing_id, title, f.status, {table_case(STATE, fr.TRUST_LABELS)} AS trust_label, {D} AS days_until_deadline, {bucket(D)} AS deadline_bucket
FROM listings l LEFT JOIN feedback f ON f.listing_id = l.listing_id AND f.user_id = {USER} WHERE l.listing_id = 217 AND NOT starts_with(url_hash, 'demo-')
 AND EXISTS (SELECT 1 FROM profiles WHERE user_id = {USER})""", "listings feedback profiles")
oracle("f18_card_reasons", with_views(VIEWS, scores(PAIRS) + REASONS + """, x AS (SELECT unnest(rs) AS r FROM rr)
SELECT CASE r.dir WHEN 'positive' THEN '+ ' WHEN 'negative' THEN '- ' ELSE '. ' END || r.label AS line, count(*) AS n FROM x GROUP BY ALL"""))
fq("d09_exclude_demo", "SELECT listing_id, url_hash FROM listings WHERE url_hash NOT LIKE 'demo-%'", "listings")
fq("j01_listings_left_user_rows", f"SELECT l.listing_id, f.status FROM listings l LEFT JOIN feedback f ON f.listing_id = l.listing_id AND f.user_id = {USER}")
fq("j02_user_rows_listings", "SELECT user_id, listing_id, status, opportunity_type FROM feedback JOIN listings USING (listing_id)")
fq("j03_requirements_of_users", "SELECT user_id, count(*) FILTER (NOT is_completed) AS open_tasks FROM requirements WHERE user_id IN (SELECT user_id FROM feedback) GROUP BY user_id", "requirements feedback")
fq("j06_listings_without_feedback", "SELECT listing_id FROM listings WHERE listing_id NOT IN (SELECT listing_id FROM feedback)")
fq("j08_in_list_fetch", "SELECT listing_id, array_to_string(tags, '|') AS tags FROM listings WHERE listing_id IN (SELECT listing_id FROM feedback WHERE status = 'applied')")
