"""Oracles of the parser queries: what the payloads were made from."""

from __future__ import annotations

from fairlead.bindings import BASE_TABLES, with_views
from fairlead.oracle.facts import visible
from fairlead.plans.registry import oracle


def pq(name: str, sql: str, views: str = "page_hits") -> None:
    oracle(name, with_views(views, sql))


pq("s02_parse_rss_items", "SELECT batch_no AS source_id, page_id % 50 AS pos, url, md5(trim(title)) AS title_md5, 'Mon, 01 Jun 2026' AS published, org AS summary FROM page_hits WHERE page_id % 50 < 40")
pq("s03_parse_sitemap_locs", "SELECT DISTINCT source_id, url FROM (SELECT batch_no AS source_id, url FROM page_hits QUALIFY row_number() OVER (PARTITION BY batch_no ORDER BY page_id % 2, page_id) <= 30)")
pq("s02_parse_rss_all", "SELECT batch_no AS source_id, page_id % 50 AS pos, url, md5(trim(title)) AS title_md5, 'Mon, 01 Jun 2026' AS published, org AS summary FROM page_hits")
pq("s02_parse_feed_kinds", """SELECT batch_no AS source_id, page_id % 50 AS pos, url, md5(trim(title)) AS title_md5, CASE batch_no % 3 WHEN 0 THEN '2026-06-01T00:00:00Z' WHEN 1 THEN '2026-06-02' ELSE 'Mon, 01 Jun 2026' END AS published, org AS summary FROM page_hits""")
oracle("s07_parse_heading_links", """SELECT page_id AS source_id, k * 65536 AS pos, 'https://list.org/' || (CASE k WHEN 0 THEN 'e/' ELSE 'f/' END) || page_id AS url, CASE k WHEN 0 THEN 'Entry one' ELSE 'Entry two' END AS title FROM pages, (VALUES (0::BIGINT), (1::BIGINT)) v(k)""")
pq("s03_parse_sitemap_all", "SELECT DISTINCT batch_no AS source_id, url FROM page_hits")
pq("s09_parse_markdown_all", "SELECT batch_no AS source_id, page_id % 50 AS pos, CASE WHEN page_id % 5 = 0 THEN 'https://maps.org/rel/' || page_id ELSE split_part(url, '#', 1) END AS url FROM page_hits")
pq("s04_parse_wp_json_items", "SELECT batch_no AS source_id, page_id % 50 AS pos, url, md5(title) AS title_md5, '2026-06-01' AS published, org AS summary FROM page_hits WHERE page_id % 3 = 1")
pq("s05_parse_custom_api_items", """SELECT batch_no AS source_id, page_id % 50 AS pos, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'https://posts.org/cat/post-' || page_id || '/' ELSE 'https://base.org/pic-' || page_id || '/' END AS url, org AS title,
 concat_ws(' · ', CASE WHEN page_id % 2 = 0 THEN 'Region: Africa' END, CASE WHEN page_id % 4 <> 3 THEN 'Deadline: ' || strftime(make_timestamp(CAST((1780000000 + page_id * 86400) * 1000000 AS BIGINT)), '%Y-%m-%d') END, CASE WHEN page_id % 5 <> 0 THEN 'Grants' END) AS summary FROM page_hits""")
pq("s06_parse_search_api_items", """SELECT batch_no AS source_id, page_id % 50 AS pos, 'https://find.org/award-' || page_id AS url, org AS title, CASE WHEN page_id % 2 = 0 THEN '2026-01-01' ELSE '2026-09-09' END AS published,
 CASE WHEN page_id % 3 = 0 THEN 'blurb' ELSE 'self' END AS summary FROM page_hits WHERE page_id % 4 <> 0""")
oracle("s07_parse_html_links", rf"""WITH t AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a\s*>') AS tags FROM pages),
u AS (SELECT page_id, url, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS pos FROM t),
h AS (SELECT *, regexp_extract(tag, '(?is)\bhref\s*=\s*["'']([^"'']*)["'']', 1) AS href, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin FROM u),
a AS (SELECT page_id AS source_id, pos, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN split_part(url, ':', 1) || ':' || href WHEN starts_with(href, '/') THEN origin || href
  WHEN starts_with(href, '?') THEN regexp_extract(url, '^([^?#]*)', 1) || href ELSE regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '[^/]*$', '') || href END AS url, {visible('tag')} AS title FROM h WHERE href <> '')
SELECT source_id, CAST(pos AS BIGINT) AS pos, url, title FROM a WHERE starts_with(url, 'http') QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY pos) <= 80""")
oracle("s08_parse_id_links", """WITH t AS (SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1))) AS ids FROM pages)
SELECT page_id AS source_id, CAST(generate_subscripts(ids, 1) - 1 AS BIGINT) AS pos, 'https://x.org/d/' || unnest(ids) AS url FROM t""")
pq("s09_parse_markdown_links", "SELECT batch_no AS source_id, page_id % 50 AS pos, CASE WHEN page_id % 5 = 0 THEN 'https://maps.org/rel/' || page_id ELSE split_part(url, '#', 1) END AS url FROM page_hits WHERE page_id % 50 < 45")
pq("s10_first_successful_strategy", "SELECT batch_no AS source_id, CASE WHEN batch_no % 2 = 0 THEN 'rss' ELSE 'wp_json' END AS strategy, url FROM page_hits WHERE NOT regexp_matches(url, '(?i)/fr/')")
pq("s10_strategy_report", """, k AS (SELECT batch_no, page_id, url, regexp_matches(url, '(?i)/fr/') AS drop_ FROM page_hits),
n AS (SELECT batch_no, count(*) AS a, count(*) FILTER (NOT drop_) AS f, array_to_string((list(url ORDER BY page_id) FILTER (NOT drop_))[1:3], '|') AS s FROM k GROUP BY 1)
SELECT batch_no AS source_id, 'wp_json' AS strategy, a AS item_count, f AS filtered_count, s AS samples, true AS ok, CAST(NULL AS VARCHAR) AS error FROM n
UNION ALL SELECT batch_no, 'rss', a, CASE WHEN batch_no % 2 = 0 THEN f ELSE 0 END, CASE WHEN batch_no % 2 = 0 THEN s ELSE '' END, batch_no % 2 = 0, CASE WHEN batch_no % 2 = 1 THEN 'no items after filters' END FROM n""")
pq("s11_apply_link_filters", """SELECT page_id, url FROM page_hits WHERE (contains(url, '/en/') OR contains(url, '/de/')) AND NOT ends_with(url, '#top') AND NOT contains(url, 'utm_') AND regexp_matches(org, '[13579]$')""")
pq("s12_dedupe_items", """SELECT page_id % 7 AS source_id, page_id AS pos, url FROM page_hits WHERE page_id % 9 <> 8 QUALIFY row_number() OVER (PARTITION BY page_id % 7, lower(url) ORDER BY page_id) = 1""")
_e = r"replace(regexp_replace({x}, '([\;,])', '\\\1', 'g'), chr(10), '\n')"


def esc(x: str) -> str:
    return _e.replace("{x}", x)


pq("s19_calendar_export", f"""SELECT listing_id, md5(array_to_string(['BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//Fairlead//EN', 'BEGIN:VEVENT', 'SUMMARY:' || {esc('title')}, 'DTSTART;VALUE=DATE:' || strftime(deadline, '%Y%m%d'),
 'DTEND;VALUE=DATE:' || strftime(deadline + INTERVAL 1 DAY, '%Y%m%d'), 'DTSTAMP:20260630T000000Z', 'UID:' || sha256(CAST(listing_id AS VARCHAR)) || '@fairlead', 'DESCRIPTION:Application deadline\\n' || {esc('url')}, 'URL:' || url,
 'BEGIN:VALARM', 'ACTION:DISPLAY', 'DESCRIPTION:Deadline reminder: ' || {esc('title')}, 'TRIGGER:-P1D', 'END:VALARM', 'END:VEVENT', 'END:VCALENDAR'], chr(13) || chr(10)) || chr(13) || chr(10)) AS ics_md5,
 '&dates=' || strftime(deadline, '%Y%m%d') || '/' || strftime(deadline + INTERVAL 1 DAY, '%Y%m%d') || '&details=' || replace(url_encode(url), '%2F', '/') AS tail FROM listings WHERE deadline IS NOT NULL""", "listings")
pq("u01_parser_registry", r"""SELECT 'rss' AS strategy, count(*) AS n FROM page_hits UNION ALL SELECT 'wp_json', count(*) FROM page_hits UNION ALL SELECT 'sitemap', count(*) FROM page_hits
 UNION ALL SELECT 'html', CAST(sum(len(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*["''][^"'']+["''][^>]*>.*?</a\s*>'))) AS BIGINT) FROM page_hits""")
oracle("s01_load_tables", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in BASE_TABLES))
