"""Oracles of the source discovery and selection queries."""

from __future__ import annotations

from fairlead.bindings import with_views
from fairlead.oracle.helpers import AS_OF_SQL, any_c, host, lst, q
from fairlead.oracle.metrics import THIN
from fairlead.oracle.text import best_url, institutional, non_primary
from fairlead.plans.registry import oracle
from fairlead.rules import fact_rules as fr

BH = r"regexp_replace(lower(host), '^www\.', '')"
REVIEWED = f"""rv0 AS (SELECT {BH} AS domain, min(page_id) AS k FROM page_hits GROUP BY 1),
rv AS (SELECT domain, k AS candidate_id, CASE k % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'new' ELSE 'draft' END AS status, CASE WHEN k % 5 = 0 THEN '' ELSE 'Source ' || (k % 60) END AS name,
 'https://' || domain || '/' AS url, CASE k % 3 WHEN 0 THEN 'recurring_source' WHEN 1 THEN 'unclear' ELSE 'one_off_page' END AS verdict, (k * 7 % 100) / 100.0::DOUBLE AS confidence, k % 6 AS run_id FROM rv0)"""
EXC = f"""ex AS (SELECT {host('url')} AS domain FROM sources UNION SELECT domain FROM rv WHERE status IN ('approved', 'rejected'))"""
HITS = "hi AS (SELECT page_id AS pos, url, title, 'Search our scholarship database, ' || CASE WHEN page_id % 3 = 0 THEN 'phd funding' ELSE 'news' END AS snippet FROM page_hits)"


def dscore(d: str, snip: str, title: str) -> str:
    t = f"lower(concat_ws(' ', {title}, {snip}))"
    return (f"greatest(0.0, least(1.0, CASE WHEN {institutional(d)} THEN 0.35 ELSE 0 END::DOUBLE + CASE WHEN {any_c(d, ['.edu', '.gov', '.org'])} THEN 0.1 ELSE 0 END - CASE WHEN {non_primary(d)} THEN 0.25 ELSE 0 END"
            f" + least(0.3::DOUBLE, 0.05::DOUBLE * len(list_filter({lst(fr.LISTING_TERMS)}, lambda x: contains({t}, x)))) + CASE WHEN {any_c(t, ['listing', 'database', 'search'])} THEN 0.1 ELSE 0 END))")


def dq(name: str, sql: str, views: str = "page_hits sources") -> None:
    oracle(name, with_views(views, ", " + sql))


dq("c01_excluded_domains", f"{REVIEWED}, {EXC} SELECT domain FROM ex")
dq("c02_candidate_domains", f"""{REVIEWED}, {EXC}, {HITS}, h AS (SELECT *, {host('url')} AS domain FROM hi),
f AS (SELECT * FROM h WHERE domain NOT IN (SELECT domain FROM ex) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY pos) = 1),
s AS (SELECT *, {dscore('domain', 'snippet', 'title')} AS sc FROM f)
SELECT domain, {best_url('url')} AS discovered_url, md5(substr(title, 1, 500)) AS title_md5, round(sc + 1e-9, 4) AS score FROM s ORDER BY sc DESC, pos LIMIT 20""")
dq("c03_domain_score", f"""{HITS}, h AS (SELECT *, CASE pos % 5 WHEN 0 THEN {host('url')} || '.ac.uk' WHEN 1 THEN 'reddit.com' ELSE {host('url')} END AS d FROM hi)
SELECT pos, round({dscore('d', 'snippet', 'title')} + 1e-9, 4) AS score FROM h""")
STRUCT = rf"""st AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, CASE page_id % 4 WHEN 0 THEN '<link rel="alternate" type="application/rss+xml" href="/feed"><a href="/scholarship/1">x</a>'
 WHEN 1 THEN '<a href="/grant/1">a</a><a href="grant/2">b</a><a href="/2026/x">c</a><a href="#top">t</a><a href="https://other.org/grant/9">o</a><div class="x category"><p><a href="#c">c</a></p></div><nav>none</nav>'
 WHEN 2 THEN '<a href="/funding/1">a</a><a href="/funding/2">a</a><a href="/funding/3">a</a><a href="/funding/4">a</a><a href="/funding/5">a</a><a href="mailto:a@b.c">m</a>' ELSE '' END || html AS html FROM pages),
an AS (SELECT *, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1) AS hrefs FROM st),
ln AS (SELECT page_id, url, origin, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS i FROM an),
ab AS (SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN split_part(url, ':', 1) || ':' || href WHEN starts_with(href, '/') THEN origin || href
  WHEN starts_with(href, '?') THEN regexp_extract(url, '^([^?#]*)', 1) || href ELSE regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '[^/]*$', '') || href END AS full_url FROM ln WHERE NOT starts_with(href, '#') AND NOT starts_with(href, 'mailto:')),
wn AS (SELECT *, regexp_extract(full_url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM ab WHERE starts_with(full_url || '/', origin || '/') OR starts_with(full_url, origin || '?')),
w2 AS (SELECT page_id, count(*) AS n, arg_min(full_url, i) AS first_link FROM wn WHERE regexp_matches(p, {q(fr.LISTING_PATH)}) OR regexp_matches(p, {q(fr.DATE_PATH)}) GROUP BY page_id),
ps AS (SELECT a.page_id, a.url, a.page_id % 4 = 0 AS feed, coalesce(n, 0) AS links, first_link, contains(lower(html), 'next page') OR contains(lower(html), 'pagination') OR len(list_filter(string_split(lower(html), '<nav'), lambda x, i: i > 1 AND contains(split_part(x, '</nav', 1), '<a '))) > 0 AS pag,
  a.page_id % 4 = 1 AS nav, origin FROM an a LEFT JOIN w2 USING (page_id)),
rc AS (SELECT *, feed OR links >= 5 OR (links >= 3 AND (pag OR nav)) AS rec FROM ps)"""
dq("c04_page_structure", STRUCT + " SELECT page_id, feed AS has_rss_feed, CAST(links AS BIGINT) AS links, first_link, CASE WHEN feed THEN origin || '/feed' END AS feed, pag AS has_pagination, links >= 5 AS selector FROM ps")
dq("c05_recurring_structure", STRUCT + " SELECT page_id, rec AS recurring FROM rc")
dq("c06_candidate_evaluation", STRUCT + """, e AS (SELECT page_id, page_id % 10 = 9 AS failed, feed, rec, CASE WHEN page_id % 8 = 3 THEN true ELSE page_id % 10 <> 9 AND rec END AS claimed, page_id % 10 <> 9 AND rec AS real_ FROM rc),
x AS (SELECT *, CASE WHEN failed THEN 0.15 WHEN rec THEN 0.4 ELSE 0.25 END::DOUBLE AS c, CASE WHEN failed THEN 'fetch_failed' ELSE 'heuristic_fallback' END AS ev FROM e)
SELECT page_id, CASE WHEN claimed AND real_ THEN 'recurring_source' ELSE 'unclear' END AS verdict, CASE WHEN claimed AND NOT real_ THEN least(c, 0.45) ELSE c END AS confidence,
 CASE WHEN failed THEN 'unclear' WHEN feed THEN 'rss' WHEN rec THEN 'html_listing' ELSE 'unclear' END AS structure_type, ev || CASE WHEN claimed AND NOT real_ THEN '; downgraded_no_structure' ELSE '' END AS evidence_summary,
 CASE WHEN failed THEN NULL WHEN feed THEN 'rss' ELSE 'html' END AS kind FROM x""")
dq("c07_strong_recurring", f"{REVIEWED} SELECT run_id, count(*) FILTER (verdict = 'recurring_source' AND confidence >= 0.55) AS strong FROM rv GROUP BY run_id")
dq("c08_order_candidates", f"{REVIEWED} SELECT domain, verdict FROM rv ORDER BY CASE verdict WHEN 'recurring_source' THEN 0 WHEN 'unclear' THEN 1 ELSE 2 END, confidence DESC, domain")


def slug(x: str) -> str:
    return f"substr(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48)"


dq("c09_promote_candidates", f"""{REVIEWED}, o AS (SELECT *, {slug("coalesce(nullif(name, ''), domain)")} AS rid FROM rv WHERE status NOT IN ('approved', 'rejected')),
f AS (SELECT * FROM o WHERE rid NOT IN (SELECT {slug('name')} FROM sources) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY candidate_id) = 1)
SELECT rid AS registry_id, name, url, substr(name, 1, 32) AS chip_label, 'proposed' AS confidence FROM f""")

SCORED = f"""us AS (SELECT user_id, ['MSc', 'PhD', 'Fellowship', 'Internship'][user_id % 4 + 1] AS td, target_regions, CASE user_id % 3 WHEN 0 THEN ['Chip 1', 'LinkedIn'] WHEN 1 THEN ['Web 4'] ELSE [] END AS chips, user_id % 2 = 0 AS developing FROM profiles),
bo AS (SELECT 'src' || source_id AS registry_id, CASE WHEN r >= 0.35 THEN 8 WHEN r >= 0.2 THEN 4 WHEN r < 0.08 THEN -6 ELSE 0 END AS bonus,
  CASE WHEN r >= 0.35 THEN 'high_admit_rate:' WHEN r >= 0.2 THEN 'moderate_admit_rate:' WHEN r < 0.08 THEN 'low_admit_rate:' END || printf('%.2f', r) AS br FROM ({THIN})),
pp AS (SELECT u.*, s.*, b.bonus, b.br, ((s.registry_id = 'src1' AND list_contains(chips, 'Chip 1')) OR (s.registry_id = 'src4' AND list_contains(chips, 'Web 4'))) AS picked, list_contains(chips, s.chip_label) AS lab,
  list_filter(target_regions, lambda r: list_contains(s.regions, r) OR list_contains(s.regions, 'global'))[1] AS reg, developing AND list_contains(tags, 'international') AS intl,
  list_contains(target_regions, 'Germany') AND s.registry_id = 'src8' AS ger, CASE WHEN td = 'Fellowship' AND list_contains(tags, 'fellowship') THEN 'fellowship_focus' WHEN td = 'MSc' AND list_contains(tags, 'scholarship') THEN 'scholarship_focus'
  WHEN td = 'PhD' AND list_contains(tags, 'phd') THEN 'phd_focus' WHEN td = 'Internship' AND list_contains(tags, 'internship') THEN 'internship_focus' END AS focus
  FROM us u, sources s LEFT JOIN bo b ON b.registry_id = s.registry_id WHERE s.source_type IN ('rss', 'html') AND (len(degree_levels) = 0 OR list_contains(degree_levels, td))),
ss AS (SELECT user_id, registry_id AS source, CAST(CASE WHEN picked THEN 15 ELSE 0 END + CASE WHEN lab THEN 15 ELSE 0 END + CASE WHEN reg IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN intl THEN 5 ELSE 0 END + CASE WHEN ger THEN 10 ELSE 0 END
   + CASE WHEN funding_signal = 'high' THEN 3 ELSE 0 END + coalesce(bonus, 0) + CASE WHEN focus = 'fellowship_focus' THEN 8 WHEN focus IS NOT NULL THEN 5 ELSE 0 END AS BIGINT) AS score,
   array_to_string(list_filter([CASE WHEN picked OR lab THEN 'user chip' END, 'region:' || reg, CASE WHEN intl THEN 'international_scholarships' END, CASE WHEN ger THEN 'germany_priority' END, br, focus], lambda x: x IS NOT NULL), '|') AS reasons FROM pp),
top AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, source) AS priority FROM ss QUALIFY priority <= 4)"""
V = "profiles sources runs"
dq("c10_score_sources", SCORED + " SELECT user_id, source, score, reasons FROM ss", V)
dq("c11_select_sources", SCORED + " SELECT user_id, source, priority, contains(reasons, 'user chip') AS user_selected, CASE WHEN reasons = '' THEN 'default' ELSE replace(reasons, '|', ', ') END AS selection_reason FROM top", V)
SEL = SCORED + """, sel AS (SELECT user_id, source AS registry_id, url, name FROM top JOIN sources s ON s.registry_id = source UNION ALL SELECT user_id, 'extra1', 'https://extra.org/feed/', 'Extra' FROM profiles WHERE user_id % 9 = 0
 UNION ALL SELECT user_id, 'moved', 'https://www.site19.org/feed/', 'Moved' FROM profiles WHERE user_id % 9 = 1)"""
dq("c12_activate_sources", SEL + """, st AS (SELECT * REPLACE (CASE WHEN id % 5 <> 4 THEN registry_id END AS registry_id) FROM sources), ca AS (SELECT registry_id FROM sources WHERE id % 3 <> 2),
en AS (SELECT registry_id, min(url) AS url, min(name) AS name FROM sel GROUP BY 1),
mt AS (SELECT e.*, coalesce(a.id, b.id) AS target FROM en e LEFT JOIN st a ON a.registry_id = e.registry_id LEFT JOIN st b ON a.id IS NULL AND b.url = e.url),
hi AS (SELECT target, min(registry_id) AS registry_id, arg_min(url, registry_id) AS url, arg_min(name, registry_id) AS name FROM mt WHERE target IS NOT NULL GROUP BY 1),
o AS (SELECT s.*, h.target IS NOT NULL AS hit, h.registry_id AS n_id, h.url AS n_url, h.name AS n_name, NOT coalesce(s.registry_id IN (SELECT registry_id FROM en), false) AND s.url NOT IN (SELECT url FROM en)
  AND (s.registry_id IS NULL OR s.registry_id IN (SELECT registry_id FROM ca)) AS off_ FROM st s LEFT JOIN hi h ON h.target = s.id)
SELECT coalesce(n_id, registry_id) AS registry_id, coalesce(n_url, url) AS url, coalesce(n_name, name) AS name, CASE WHEN hit THEN true WHEN off_ THEN false ELSE is_active END AS is_active,
  CASE WHEN hit THEN 'updated' WHEN off_ AND is_active THEN 'deactivated' ELSE 'unchanged' END AS change FROM o
UNION ALL SELECT registry_id, url, name, true, 'added' FROM mt WHERE target IS NULL""", V)
ING = "SELECT DISTINCT user_id, id FROM sel JOIN sources s ON s.registry_id = sel.registry_id OR s.url = sel.url WHERE s.is_active"
dq("c13_profile_ingest_sources", SEL + " " + ING, V)
dq("j07_semi_selected_sources", SEL + f" SELECT DISTINCT id FROM ({ING})", V)
oracle("b07_compile_ingestion_sources", with_views(V, ", " + SCORED + """ SELECT user_id, source, name, url, source_type, CASE WHEN reasons = '' THEN 'default' ELSE replace(reasons, '|', ', ') END AS selection_reason
 FROM top JOIN sources s ON s.registry_id = source WHERE priority % 3 <> 0"""))
oracle("c14_due_sources", with_views("sources", f"SELECT id, strftime({AS_OF_SQL} + to_minutes(fetch_interval_minutes), '%Y-%m-%d %H:%M') AS next_after FROM sources WHERE is_active AND (next_fetch_at IS NULL OR next_fetch_at <= {AS_OF_SQL})"))
oracle("s14_resolve_source_config", with_views("sources", """, r AS (SELECT *, CASE WHEN id % 3 <> 0 THEN 'adapter' || id END AS ra FROM sources)
SELECT registry_id, CASE WHEN id % 2 = 0 THEN 'own' ELSE ra END AS adapter_id, 'http' AS fetch_mode, CASE WHEN id % 2 = 1 THEN authority ELSE 0.9::DOUBLE END AS authority,
 CASE WHEN id % 4 = 0 THEN 'extract={}|feed_urls=' || url || '|kind=rss' ELSE 'feed_urls=' || url || '|kind=rss|max_entries=50' END || CASE WHEN id % 3 = 0 THEN '|note=mine' ELSE '' END AS config FROM r"""))
oracle("s17_normalize_source_url", with_views("sources", "SELECT id, url FROM sources"))
oracle("s18_validate_registry", with_views("sources", """, r AS (SELECT *, CASE WHEN id % 5 = 4 THEN 'ftp://x' ELSE url END AS u FROM sources), e AS (SELECT registry_id, unnest([CASE WHEN id % 7 = 3 THEN 'missing name' END,
 CASE WHEN source_type = 'rss' AND NOT starts_with(u, 'http') THEN 'invalid rss url' END, CASE WHEN id % 3 = 0 THEN 'missing adapter_id' END, CASE WHEN id % 4 = 3 THEN 'parser_config.discover missing' END,
 CASE WHEN id % 4 IN (2, 3) THEN 'parser_config.extract missing' END, CASE WHEN id % 4 = 1 THEN 'hybrid discover requires strategies[]' END, CASE WHEN id % 4 = 2 THEN 'unknown discover.kind gopher' END]) AS error FROM r)
SELECT registry_id, error FROM e WHERE error IS NOT NULL"""))
oracle("j10_registry_lookup", with_views("listings sources", "SELECT listing_id, name, authority FROM listings l LEFT JOIN sources s ON s.id = l.source_id"))
