"""Oracles of the verification and staleness queries."""

from __future__ import annotations

from fairlead.bindings import with_views
from fairlead.oracle.facts import cue_date, requirements, visible
from fairlead.oracle.helpers import AS_OF_SQL, day, floor_days, host, ladder, lst
from fairlead.oracle.metrics import THIN
from fairlead.oracle.text import institutional, matches_org, non_primary, org_name, stale_page
from fairlead.plans.registry import oracle
from fairlead.rules import fact_rules as fr


def vq(name: str, sql: str, views: str = "listings") -> None:
    oracle(name, with_views(views, sql))


vq("v01_eligible_for_verification", "SELECT listing_id, gate_verdict FROM listings WHERE gate_verdict IN ('admit', 'investigate')")
vq("v02_pending_verification", f""", t AS (SELECT * FROM listings WHERE verification_status = 'unverified' AND gate_verdict IS NOT NULL AND created_at >= {AS_OF_SQL} - INTERVAL 240 HOUR ORDER BY created_at DESC, listing_id LIMIT 60)
SELECT listing_id FROM t WHERE gate_verdict IN ('admit', 'investigate')""")
vq("v02_backlog_verification", """, t AS (SELECT * FROM listings WHERE verification_status IN ('unverified', 'aggregator_only') AND duplicate_of IS NULL ORDER BY created_at, listing_id LIMIT 60)
SELECT listing_id FROM t WHERE gate_verdict IN ('admit', 'investigate')""")
BH = r"regexp_replace(lower(host), '^www\.', '')"
vq("v04_domain_trust", f""", h AS (SELECT {BH} AS h, min(page_id) AS k FROM page_hits GROUP BY 1),
d AS (SELECT CASE WHEN k % 4 = 0 THEN h || '.ac.uk' ELSE h END AS domain, CASE WHEN k % 3 <> 0 THEN (k * 37 % 4000) / 365.25::DOUBLE END AS years, k % 5 = 0 AS scam FROM h),
s AS (SELECT *, 0.5::DOUBLE + CASE WHEN {institutional('domain')} THEN 0.25 ELSE 0 END + CASE WHEN years >= 5 THEN 0.15 WHEN years < 1 THEN -0.25 ELSE 0 END - CASE WHEN scam THEN 0.4 ELSE 0 END AS t FROM d)
SELECT domain, round(greatest(0.0, least(1.0, t)) + 1e-9, 3) AS trust_score, array_to_string(list_filter([CASE WHEN {institutional('domain')} THEN 'institutional_tld' END, CASE WHEN years >= 5 THEN 'domain_age_5y+' END,
 CASE WHEN years < 1 THEN 'domain_age_under_1y' END, CASE WHEN scam THEN 'scam:pay to apply|scam:wire transfer' END], lambda x: x IS NOT NULL), '|') AS flags FROM s""", "page_hits")
PRE = f""", cl AS (SELECT l.* EXCLUDE (url, title), CASE WHEN listing_id % 6 = 0 THEN 'https://apply.uni' || (listing_id % 40) || '.ac.uk/call' ELSE url END AS url,
  CASE WHEN listing_id % 17 = 0 THEN title || ' wire transfer' ELSE title END AS title, round((l.source_id % 9) / 25.0::DOUBLE, 4) AS rate, t.source_id IS NOT NULL AS has_runs,
  CASE WHEN listing_id % 4 <> 0 THEN (listing_id % 11) / 10.0::DOUBLE END AS dt, CASE WHEN listing_id % 5 = 0 THEN (listing_id % 10) / 10.0::DOUBLE END AS oc FROM listings l LEFT JOIN ({THIN}) t ON t.source_id = l.source_id),
c2 AS (SELECT *, {host('url')} AS dom, list_filter({lst(fr.SCAM_PHRASES)}, lambda p: contains(lower(title || ' ' || coalesce(summary, '') || ' ' || url), p)) AS scams FROM cl),
c3 AS (SELECT *, 0.5::DOUBLE + CASE WHEN {institutional('dom')} THEN 0.2 ELSE 0 END + CASE WHEN oc IS NOT NULL THEN 0.15 ELSE 0 END AS base FROM c2),
c4 AS (SELECT *, greatest(0.0, least(1.0, CASE WHEN dt IS NOT NULL THEN 0.4::DOUBLE * base + 0.6::DOUBLE * dt ELSE base END - CASE WHEN len(scams) > 0 THEN 0.35 ELSE 0 END + CASE WHEN has_runs AND rate >= 0.25 THEN 0.15 WHEN has_runs AND rate < 0.08 THEN -0.2 ELSE 0 END
  + CASE WHEN oc >= 0.7 THEN 0.1 ELSE 0 END)) AS sc FROM c3),
pre AS (SELECT listing_id, round(sc, 3) AS pt, CASE WHEN sc <= 0.25 OR len(scams) > 0 THEN 'stop' WHEN sc >= 0.72 AND {institutional('dom')} THEN 'light_tier2' ELSE 'continue' END AS action,
  array_to_string(list_filter([CASE WHEN listing_id % 4 = 1 THEN 'domain_age_5y+' END, CASE WHEN {institutional('dom')} THEN 'institutional_listing_domain' END, CASE WHEN oc IS NOT NULL THEN 'allowlisted_domain' END,
   nullif(array_to_string(list_transform(scams[1:3], lambda s: 'scam_phrase:' || s), '|'), ''), CASE WHEN has_runs AND rate >= 0.25 THEN 'source_high_admit_rate' WHEN has_runs AND rate < 0.08 THEN 'source_low_admit_rate' END,
   CASE WHEN oc >= 0.7 THEN 'cached_org_domain' END], lambda x: x IS NOT NULL), '|') AS flags FROM c4)"""
vq("v03_prescreen", PRE + " SELECT listing_id, round(pt + 1e-9, 3) AS trust, action, flags FROM pre", "listings runs")
vq("v05_pick_canonical_domain", f""", h AS (SELECT org, page_id, CASE page_id % 7 WHEN 0 THEN 'https://www.reddit.com/r/x' WHEN 1 THEN 'https://institute' || page_id || '.org/' ELSE url END AS u, title, page_id % 3 = 0 AS off FROM page_hits),
x AS (SELECT *, {host('u')} AS d FROM h), e AS (SELECT DISTINCT {BH} AS d FROM page_hits WHERE page_id % 11 = 0),
r AS (SELECT *, CASE WHEN {institutional('d')} THEN 0 WHEN contains(d, 'institute') THEN 1 WHEN contains(lower(title), 'institute') THEN 2 WHEN contains(lower(title), 'official') OR off THEN 3 ELSE 4 END AS rank FROM x
  WHERE NOT {non_primary('d')} AND d NOT IN (SELECT d FROM e))
SELECT org, d AS domain, u AS url, CAST(rank AS BIGINT) AS rank FROM r QUALIFY row_number() OVER (PARTITION BY org ORDER BY rank, page_id) = 1""", "page_hits")


def compare(a: str, b: str) -> tuple[str, str, str]:
    g = f"abs({floor_days(a, b)})"
    i = f"CAST({g} AS BIGINT)"
    return (f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN true WHEN {a} IS NULL OR {b} IS NULL THEN false ELSE {g} <= 7 END",
            f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 1.0 WHEN {a} IS NULL OR {b} IS NULL THEN 0.0 WHEN {g} <= 7 THEN 1.0 - ({g} / 7.0::DOUBLE) * 0.3 ELSE greatest(0.0, 1.0 - {g} / 60.0::DOUBLE) END",
            f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 'both_missing' WHEN {a} IS NULL OR {b} IS NULL THEN 'one_missing' WHEN {g} <= 7 THEN 'within_' || {i} || '_days' ELSE 'delta_' || {i} || '_days' END")


_m, _s, _n = compare("deadline", "o")
vq("v06_deadline_compare", f""", x AS (SELECT listing_id, deadline, CASE WHEN listing_id % 6 <> 1 THEN deadline + to_days(CAST((listing_id * 7) % 90 - 45 AS INT)) + INTERVAL 13 HOUR END AS o FROM listings)
SELECT listing_id, {_m} AS match, round(CAST({_s} AS DOUBLE) + 1e-9, 4) AS similarity, {_n} AS note FROM x""")
PAGES = f""", pp AS (SELECT listing_id, CASE WHEN listing_id % 19 <> 0 THEN CASE WHEN deadline IS NULL AND listing_id % 4 <> 0 THEN '<html><p>' ELSE '<html><h1>Call</h1><p>' || CASE WHEN listing_id % 4 <> 0 THEN 'Deadline: ' || strftime(deadline + to_days(CAST(listing_id % 15 AS INT)), '%-d %B %Y') || '</p><p>' ELSE '' END
  || CASE listing_id % 3 WHEN 0 THEN 'Fully funded by the fund. ' WHEN 1 THEN 'Self-funded, no fund. ' ELSE '' END || CASE WHEN listing_id % 5 = 0 THEN 'Transcript and portfolio. ' ELSE '' END END
  || coalesce(summary, '') || CASE WHEN listing_id % 13 = 0 THEN '</p>Applications closed.</html>' ELSE '</p></html>' END END AS html FROM listings)"""
_h1 = r"trim(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1))"
FIELDS = PAGES + f""", pt AS (SELECT listing_id, html, {_h1} AS t, substr({visible('html')}, 1, 8000) AS c, {cue_date('html', fr.PAGE_DEADLINE_CUES)} AS pd FROM pp WHERE html IS NOT NULL),
pf0 AS (SELECT *, t || chr(10) || c AS txt, substr(c, 1, 4000) AS s FROM pt), pf1 AS (SELECT *, {ladder('lower(txt)', [('full', fr.EXTRACT_FULL), ('partial', fr.EXTRACT_PARTIAL), ('self', fr.EXTRACT_SELF)])} AS ft FROM pf0),
pf AS (SELECT listing_id, pd, CASE WHEN contains(lower(s), 'fund') THEN trim(concat_ws(' ', coalesce(ft, ''), substr(s, 1, 300))) ELSE ft END AS pfund, nullif(substr(replace({requirements('lower(txt)')}, '|', ' '), 1, 800), '') AS pe FROM pf1)"""
vq("v13_primary_fields", FIELDS + f" SELECT listing_id, {day('pd')} AS p_deadline, md5(pfund) AS funding_md5, pe AS p_eligibility FROM pf")
_m, _s, _n = compare("deadline", "pd")
CMP = FIELDS + f""", cm0 AS (SELECT l.*, pd, pfund, pe, {_m} AS dm, {_s} AS ds, {_n} AS dn, deadline IS NOT NULL AND pd IS NOT NULL AS dc, {ladder("lower(concat_ws(' ', funding_type, nullif(title, ''), summary))", fr.VERIFY_FUNDING)} AS fo, {ladder('lower(pfund)', fr.VERIFY_FUNDING)} AS ftheirs FROM listings l JOIN pf USING (listing_id)),
cm1 AS (SELECT *, fo IS NOT NULL AND ftheirs IS NOT NULL AS fc, NOT (fo IS NOT NULL AND ftheirs IS NOT NULL) OR fo = ftheirs AS fm FROM cm0),
cm AS (SELECT *, list_filter([CASE WHEN dc AND NOT dm THEN 'deadline_mismatch:' || dn END, CASE WHEN fc AND NOT fm THEN 'funding_mismatch' END], lambda x: x IS NOT NULL) AS dis, (dc OR fc) AND (NOT dc OR dm) AND (NOT fc OR fm) AS allm FROM cm1),
cz AS (SELECT *, NOT allm AND ((dc AND ds >= 0.4) OR (fc AND fm)) AS part, (dc AND NOT dm) OR len(dis) >= 2 AS conflict FROM cm),
cy AS (SELECT *, NOT conflict AND (dc OR fc) AND (NOT dc OR dm) AND (NOT fc OR fm) AS confirms FROM cz)"""
vq("v08_compare_claims", CMP + """ SELECT listing_id, concat_ws(':', 'deadline', dm::VARCHAR, dn, dc::VARCHAR) || '|' || concat_ws(':', 'funding', fm::VARCHAR, coalesce(fo, 'unknown') || '_vs_' || coalesce(ftheirs, 'unknown'), fc::VARCHAR) AS fields,
 array_to_string(dis, '|') AS discrepancies, allm AS all_match, part AS partial_match FROM cy""")
vq("v09_confirms_listing", CMP + " SELECT listing_id, confirms, conflict FROM cy")
_org = f"CASE WHEN listing_id % 2 = 0 THEN {org_name()} ELSE 'Another Body' END"
_dom = "('institute' || (listing_id % 40) || '.org')"
vq("v10_verification_status", CMP + PRE + f""", v AS (SELECT cy.*, pre.pt, pre.action, ({institutional(_dom)} OR {matches_org(_dom, '(' + _org + ')')}) AS strong FROM cy JOIN pre USING (listing_id) WHERE coalesce(verification_status, '') NOT IN ('primary_confirmed', 'stale')),
w AS (SELECT *, CASE WHEN action <> 'stop' AND strong AND (pd IS NOT NULL OR pfund IS NOT NULL OR pe IS NOT NULL) THEN CASE WHEN confirms THEN 'primary_confirmed' WHEN conflict THEN 'stale' ELSE 'aggregator_only' END ELSE 'aggregator_only' END AS st FROM v)
SELECT listing_id, strong AS strong_primary, st AS new_status, round(round(CASE st WHEN 'primary_confirmed' THEN least(1.0, pt + 0.25) WHEN 'stale' THEN pt * CASE WHEN part THEN 0.85 ELSE 0.7 END ELSE pt END, 3) + 1e-9, 3) AS new_trust FROM w""", "listings runs")
vq("v11_staleness_candidates", f"""SELECT listing_id FROM listings WHERE duplicate_of IS NULL AND (verification_status IS NULL OR verification_status <> 'stale') AND (deadline IS NULL OR deadline >= {AS_OF_SQL})
 AND (last_seen_at IS NULL OR last_seen_at < {AS_OF_SQL} - INTERVAL 14 DAY OR verified_at IS NULL OR verified_at < {AS_OF_SQL} - INTERVAL 30 DAY) ORDER BY last_seen_at NULLS FIRST, listing_id LIMIT 50""")
vq("v12_staleness_decision", PAGES + f""", x AS (SELECT l.listing_id, l.deadline, l.verification_status, html, {cue_date('html', fr.PAGE_DEADLINE_CUES)} AS pd FROM listings l JOIN pp USING (listing_id)),
y AS (SELECT *, CASE WHEN html IS NULL THEN 'fetch_failed' WHEN {stale_page('html')} THEN 'stale_phrase' WHEN deadline IS NOT NULL AND pd IS NOT NULL AND NOT ({_m}) THEN 'deadline_mismatch' ELSE 'ok' END AS reason FROM x)
SELECT listing_id, reason, CASE WHEN reason <> 'ok' THEN 'stale' WHEN verification_status = 'stale' THEN 'unverified' ELSE verification_status END AS new_status FROM y""")
