"""Oracles of the fact and extraction queries."""

from __future__ import annotations

from fairlead.bindings import with_views
from fairlead.oracle.helpers import any_c, day, ladder, multi, parse_date, q
from fairlead.oracle.text import _labels, _strip, _title_case, derive, funding_facts
from fairlead.plans.registry import oracle
from fairlead.rules import fact_rules as fr


def visible(x: str) -> str:
    return rf"trim(regexp_replace({_strip.replace('(html,', f'({x},')}, '\s+', ' ', 'g'))"


def requirements(low: str) -> str:
    return ("array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains({low}, {q(k)}) THEN {q(_title_case[k])} END" for k in fr.REQUIREMENT_KEYWORDS)
            + "], lambda x: x IS NOT NULL), '|')")


def common(title: str, summary: str, text: str) -> str:
    low = f"lower({text})"
    return (ladder(f"lower({title} || ' ' || {summary})", fr.TYPE_KEYWORDS.items(), "'other'") + " AS opportunity_type, "
            + requirements(low) + " AS requirements, "
            + ladder(low, [("full", fr.EXTRACT_FULL), ("partial", fr.EXTRACT_PARTIAL), ("self", fr.EXTRACT_SELF)]) + " AS funding_type, "
            + f"array_to_string({multi(low, _labels, 9)}, '|') AS degree_levels")


def cue_date(text: str, cues) -> str:
    return "coalesce(" + ", ".join(parse_date(f"regexp_extract({text}, {q(c)}, 1)") for c in cues) + ")"


oracle("p14_extract_from_feed_item", with_views("listings", f"""
, raw AS (SELECT listing_id AS item_id, title, '<p>' || summary || '</p>' AS html FROM listings),
t AS (SELECT item_id, title, CASE WHEN html IS NULL THEN '' ELSE {visible('html')} END AS summary FROM raw),
x AS (SELECT *, title || chr(10) || summary AS txt FROM t)
SELECT item_id, CASE WHEN title = '' THEN 'Untitled' ELSE title END AS title, md5(substr(summary, 1, 4000)) AS summary_md5,
 {day(cue_date('txt', fr.DEADLINE_CUES))} AS deadline, {common('title', 'summary', 'txt')},
 CASE WHEN summary <> '' THEN 'medium' ELSE 'low' END AS confidence FROM x"""))

LANDED = """SELECT page_id, CASE page_id % 5
 WHEN 0 THEN printf('<script type="application/ld+json">{"name":"Grant %d","description":"Fully funded doctoral grant","endDate":"2026-10-05","provider":{"name":"Org %d"}}</script>', page_id, page_id % 7) || html
 WHEN 1 THEN printf('<meta property="og:title" content="Open call %d"><meta property="og:description" content="Partial funding for master students">', page_id) || html
 WHEN 2 THEN printf('<p>Deadline: %d October 2026</p>', page_id % 27 + 1) || html ELSE html END AS html, '' AS fallback_title,
 CASE WHEN page_id % 2 = 0 THEN 'A stipend is paid' ELSE '' END AS fallback_summary FROM pages"""
_h1 = r"regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1)"
STRUCTURED = f"""ld AS ({LANDED}),
s AS (SELECT *, CASE page_id % 5 WHEN 0 THEN 'Grant ' || page_id WHEN 1 THEN 'Open call ' || page_id END AS s_title,
 CASE page_id % 5 WHEN 0 THEN 'Fully funded doctoral grant' WHEN 1 THEN 'Partial funding for master students' END AS s_summary,
 CASE page_id % 5 WHEN 0 THEN 'Org ' || (page_id % 7) END AS institution, CASE page_id % 5 WHEN 0 THEN TIMESTAMP '2026-10-05' END AS s_deadline,
 nullif(CASE WHEN contains({_h1}, '<') THEN {visible(_h1)} ELSE trim({_h1}) END, '') AS h1, {cue_date('html', fr.PAGE_DEADLINE_CUES)} AS h_deadline FROM ld),
n AS (SELECT *, coalesce(s_title, h1, '') AS title, coalesce(s_summary, nullif(fallback_summary, ''), substr({visible('html')}, 1, 8000)) AS content FROM s),
x AS (SELECT *, title || chr(10) || content AS txt, coalesce(s_deadline, h_deadline) AS deadline, CASE WHEN s_summary IS NOT NULL THEN 'structured'
 WHEN fallback_summary <> '' THEN 'feed' ELSE 'heuristic' END AS summary_from, CASE WHEN s_title IS NOT NULL THEN 'structured' ELSE 'adapter' END AS title_from,
 CASE WHEN content = '' THEN 'low' ELSE 'medium' END AS confidence FROM n)"""
oracle("p15_extract_structured_page", f"""WITH {STRUCTURED}
SELECT page_id, md5(substr(CASE WHEN title = '' THEN 'Untitled' ELSE title END, 1, 500)) AS title_md5, md5(substr(content, 1, 4000)) AS summary_md5, institution,
 {day('deadline')} AS deadline, {common('title', 'content', 'txt')}, confidence, title_from, summary_from,
 CASE WHEN s_deadline IS NULL AND h_deadline IS NOT NULL THEN 'heuristic' END AS deadline_from FROM x""")

_kept = (r"list_filter(list_transform(string_split(body, chr(10)), lambda l: trim(l)), lambda l: l <> '')")
MARKDOWN = f"""md AS (SELECT doc_id AS page_id, doc_id % 4 <> 0 AS framed, text || chr(10) || 'Masters fellowship, transcript needed.' AS framed_body, text AS bare,
  'Call ' || doc_id AS head, 'Org ' || (doc_id % 9) AS org, make_timestamp(2027, 5, doc_id % 28 + 1, 0, 0, 0.0) AS due,
  CASE WHEN doc_id % 8 = 0 THEN 'Short summary' ELSE '' END AS fallback_summary FROM documents),
m AS (SELECT *, CASE WHEN framed THEN head ELSE 'Fallback title' END AS title, CASE WHEN framed THEN substr(array_to_string({_kept.replace('body', 'framed_body')}, ' '), 1, 4000)
  ELSE fallback_summary END AS summary, {cue_date('bare', fr.PAGE_DEADLINE_CUES)} AS page_due FROM md),
y AS (SELECT *, title || chr(10) || summary AS txt, CASE WHEN framed THEN 'high' WHEN summary = '' THEN 'low' ELSE 'medium' END AS confidence,
  CASE WHEN framed THEN 'adapter' WHEN summary <> '' THEN 'feed' ELSE 'heuristic' END AS summary_from, CASE WHEN framed THEN 'adapter' END AS title_from FROM m)"""
oracle("p16_extract_from_markdown_page", f"""WITH {MARKDOWN}
SELECT page_id, md5(title) AS title_md5, md5(summary) AS summary_md5, CASE WHEN framed THEN org END AS institution,
 {day('CASE WHEN framed THEN due ELSE page_due END')} AS deadline, {common('title', 'summary', 'txt')}, confidence, title_from, summary_from,
 CASE WHEN framed THEN 'adapter' WHEN page_due IS NOT NULL THEN 'heuristic' END AS deadline_from FROM y""")
oracle("p17_extract_detail", f"""WITH {STRUCTURED}, {MARKDOWN}
SELECT summary_from, title_from, confidence, count(*) AS n FROM (SELECT summary_from, title_from, confidence FROM x UNION ALL
 SELECT summary_from, title_from, confidence FROM y) GROUP BY ALL""")
oracle("p17_should_fetch_detail", with_views("sources", "SELECT id, id % 3 <> 0 AND id % 4 <> 1 AS fetch FROM sources"))


def facts_sql(src: str = "listings") -> str:
    """CTE body deriving f_* columns from a listing relation."""
    txt = "concat_ws(' ', coalesce(title, ''), coalesce(summary, ''), array_to_string(requirements, ' '), coalesce(institution, ''), '')"
    d, n = derive("txt")
    k, e, a = funding_facts("low")
    fm = multi("lower(coalesce(title, ''))", fr.FORMAT_NEEDLES, 2)

    def union(stored: str, derived: str) -> str:
        return f"list_concat({stored}, list_filter({derived}, lambda x: NOT list_contains({stored}, x)))"

    return f"""
 SELECT *, coalesce(deadline, {d}) AS f_deadline, CASE WHEN deadline IS NULL THEN {n} END AS f_note,
  CASE WHEN deadline IS NOT NULL THEN 'column' WHEN {d} IS NOT NULL THEN 'text' ELSE 'none' END AS f_source,
  CASE WHEN funding_type IS NOT NULL THEN funding_type ELSE {k} END AS f_funding,
  CASE WHEN funding_type IS NOT NULL THEN 'listed funding type' ELSE {e} END AS f_evidence, {a} AS f_amount,
  {union("list_transform(degree_levels, lambda x: lower(x))", multi('low', fr.DEGREE_NEEDLES, 4))} AS f_degrees,
  {union('countries', multi('low', fr.REGION_NEEDLES, 4))} AS f_regions,
  {union('tags', multi('low', fr.THEME_NEEDLES, 5))} AS f_themes,
  CASE WHEN len({fm}) > 0 THEN {fm} ELSE {multi('low', fr.FORMAT_NEEDLES, 2)} END AS f_formats,
  CASE WHEN {any_c('low', fr.REMOTE_PHRASES)} THEN true WHEN {any_c('low', fr.ONSITE_PHRASES)} THEN false END AS f_remote,
  length(regexp_replace(txt, '^\\s+|\\s+$', '', 'g')) AS f_text_length
 FROM (SELECT *, {txt} AS txt, lower({txt}) AS low FROM {src})"""


oracle("p21_derive_facts", with_views("listings", f""", f AS ({facts_sql()})
SELECT listing_id, {day('f_deadline')} AS deadline, f_note AS note, f_source AS source, f_funding AS funding, f_evidence AS evidence, f_amount AS amount,
 array_to_string(f_degrees, '|') AS degrees, array_to_string(f_regions, '|') AS regions, array_to_string(f_themes, '|') AS themes,
 array_to_string(f_formats, '|') AS formats, f_remote AS remote, CAST(f_text_length AS BIGINT) AS text_length FROM f"""))

oracle("p22_backfill_facts", with_views("listings", f""", f AS ({facts_sql()})
SELECT listing_id, {day('f_deadline')} AS deadline, coalesce(funding_type, f_funding) AS funding_type,
 array_to_string(CASE WHEN len(degree_levels) = 0 THEN f_degrees ELSE degree_levels END, '|') AS degree_levels,
 array_to_string(CASE WHEN len(countries) = 0 THEN f_regions ELSE countries END, '|') AS countries, array_to_string(tags, '|') AS tags,
 array_to_string(list_filter([CASE WHEN deadline IS NULL AND f_deadline IS NOT NULL THEN 'deadline' END, CASE WHEN funding_type IS NULL AND f_funding IS NOT NULL THEN 'funding_type' END,
  CASE WHEN len(degree_levels) = 0 AND len(f_degrees) > 0 THEN 'degree_levels' END, CASE WHEN len(countries) = 0 AND len(f_regions) > 0 THEN 'countries' END], lambda x: x IS NOT NULL), '|') AS written
FROM f"""))
