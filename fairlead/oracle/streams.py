"""Oracles of the streaming queries: the batch result over the whole table."""

from __future__ import annotations

from fairlead.bindings import with_views
from fairlead.oracle.gate import gq
from fairlead.oracle.resolve import resolve_sql
from fairlead.plans.registry import ORACLES, oracle


def tq(name: str, sql: str, views: str = "status_events") -> None:
    oracle(name, with_views(views, sql))


gq("t01_stream_listings", "SELECT listing_id, verdict, reason FROM gate QUALIFY row_number() OVER (PARTITION BY url ORDER BY listing_id) = 1")
gq("t01_stream_ingest", f"""SELECT k.item_id AS listing_id, k.source_id, k.title, CASE WHEN w.action = 'shadow_new' THEN w.other END AS duplicate_of, coalesce(u.content_hash, k.content_hash) AS content_hash, coalesce(u.n, 0) AS n_updates
FROM told w JOIN ba k USING (item_id) LEFT JOIN (SELECT other AS item_id, count(*) AS n, arg_max(k.content_hash, k.source_id * 1099511627776 + k.pos) AS content_hash FROM told t JOIN ba k USING (item_id) WHERE action = 'update_new' GROUP BY other) u
  ON u.item_id = k.item_id WHERE w.action <> 'update_new'""", f""", ba AS (SELECT l.listing_id AS item_id, l.source_id, l.listing_id AS pos, l.title, l.institution, l.url_hash, l.content_hash FROM gate g JOIN listings l USING (listing_id) WHERE g.verdict = 'admit'),
none AS (SELECT CAST(NULL AS BIGINT) AS item_id, CAST(NULL AS BIGINT) AS fuzzy_id, CAST(NULL AS BIGINT) AS fuzzy_source, CAST(NULL AS DOUBLE) AS ratio), {resolve_sql('ba', 'none').replace('LEFT JOIN listings l ON l.url_hash = k.url_hash', 'LEFT JOIN (SELECT * FROM listings LIMIT 0) l ON l.url_hash = k.url_hash')}""")
tq("t02_stream_affinity", """, w AS (SELECT user_id, listing_id, CASE status WHEN 'saved' THEN 0.6 WHEN 'in_progress' THEN 1.0 WHEN 'applied' THEN 1.0 ELSE 0 END::DOUBLE AS wp,
  CASE WHEN status = 'dismissed' THEN CASE WHEN dismiss_reason IS NOT NULL THEN 0.85 ELSE 0.5 END ELSE 0 END::DOUBLE AS wn FROM status_events),
k AS (SELECT listing_id, 'tag' AS kind, unnest(tags) AS key FROM listings UNION ALL SELECT listing_id, 'inst', lower(institution) FROM listings WHERE institution IS NOT NULL)
SELECT user_id, kind, key, round(sum(wp), 4) AS pos, round(sum(wn), 4) AS neg FROM w JOIN k USING (listing_id) WHERE wp > 0 OR wn > 0 GROUP BY ALL""", "status_events listings")
tq("t03_stream_status_history", """, e AS (SELECT *, listing_id % 3 AS l FROM status_events WHERE NOT (status = 'dismissed' AND dismiss_reason IS NULL)),
f AS (SELECT *, lag(status) OVER (PARTITION BY user_id, l ORDER BY happened_at, event_id) AS prev FROM e), k AS (SELECT * FROM f WHERE prev IS NULL OR prev <> status OR dismiss_reason IS NOT NULL)
SELECT user_id, l AS listing_id, event_id, prev AS from_status, status AS to_status, dismiss_reason FROM k QUALIFY row_number() OVER (PARTITION BY user_id, l ORDER BY happened_at DESC, event_id DESC) <= 50""")
tq("t03_stream_whole_history", """, e AS (SELECT *, listing_id AS l FROM status_events WHERE NOT (status = 'dismissed' AND dismiss_reason IS NULL)),
f AS (SELECT *, lag(status) OVER (PARTITION BY user_id, l ORDER BY happened_at, event_id) AS prev FROM e), k AS (SELECT * FROM f WHERE prev IS NULL OR prev <> status OR dismiss_reason IS NOT NULL)
SELECT user_id, l AS listing_id, event_id, prev AS from_status, status AS to_status, dismiss_reason FROM k QUALIFY row_number() OVER (PARTITION BY user_id, l ORDER BY happened_at DESC, event_id DESC) <= 50""")
tq("t03_status_rejects", "SELECT event_id, 'dismiss_reason is required when status is dismissed' AS error FROM status_events WHERE status = 'dismissed' AND dismiss_reason IS NULL")
tq("t04_stream_rerank_requests", """, a AS (SELECT *, CASE WHEN happened_at - lag(happened_at) OVER (PARTITION BY user_id ORDER BY happened_at) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS brk FROM status_events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY happened_at ROWS UNBOUNDED PRECEDING) AS sid FROM a), g AS (SELECT user_id, sid, min(happened_at) AS st, max(happened_at) + INTERVAL 2 HOUR AS en, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, epoch_us(st) AS started_us, n AS changes FROM g""")
ORACLES["t05_stream_source_health"] = ORACLES["m07_failure_streaks"]
tq("t06_stream_pending_queue", """, q AS (SELECT * FROM listings WHERE listing_id % 6 <> 0 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY listing_id) <= 30) SELECT source_id, url FROM q""", "listings")
tq("t07_stream_run_metrics", """ SELECT user_id % 20 AS source_id, status AS verdict, CAST(floor(epoch(happened_at) / 3600) * 3600 AS BIGINT) AS window_start, count(*) AS n FROM status_events GROUP BY ALL""")
tq("t07_stream_daily_metrics", """, h AS (SELECT user_id % 20 AS s, status AS v, CAST(floor(epoch(happened_at) / 3600) AS BIGINT) AS h FROM status_events),
w AS (SELECT s, v, h - unnest(generate_series(0, 23)) AS w FROM h), c AS (SELECT s, v, w, count(*) AS n FROM w GROUP BY ALL)
SELECT s AS source_id, v AS verdict, count(*) AS windows, max(n) AS busiest FROM c GROUP BY ALL""")
tq("t08_stream_raw_documents", "SELECT DISTINCT 'page' || (source_id % 5) AS url_hash, content_hash FROM listings", "listings")
ORACLES["t07_counts_and_late_rows"] = ORACLES["t07_stream_run_metrics"]
