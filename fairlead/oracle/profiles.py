"""Oracles of the profile document queries."""

from __future__ import annotations

from fairlead.bindings import with_views
from fairlead.oracle.helpers import any_c, lst, norm, q
from fairlead.plans.registry import oracle
from fairlead.rules import fact_rules as fr
from fairlead.rules import gate_rules as gr


def pick(*vals) -> str:
    return "(CASE user_id % " + str(len(vals)) + " " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else q(v)}" for i, v in enumerate(vals)) + " END)"


def split(x: str, seps: str = "[,;\\n]") -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({x}, ''), '{seps}'), lambda x: trim(x)), lambda x: x <> '')"


def words(*vals) -> str:
    return f"list_filter(string_split({pick(*vals)}, ','), lambda x: x <> '')"


def table(key: str, t: dict, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else lst(v)}" for k, v in t.items()) + f" ELSE {default} END"


FORMS = f"""
, fo AS (SELECT user_id, name AS full_name, coalesce({pick(None, 'KE', 'DE')}, nationality) AS nat, {pick('linkedin.com/in/a', 'https://linkedin.com/in/b', '')} AS li, {pick('', 'github.com/x')} AS gh,
 {pick('MSc', 'PhD', 'Fellowship', 'Mixed', 'Diploma')} AS target_degree, {words('research_aligned,coursework', 'research_aligned', 'coursework', '', 'no_preference')} AS styles,
 {pick('Fall 2027', 'Spring 2026', 'custom')} AS term, {pick('Fall 2029', 'winter')} AS cterm, {words('partial_ok', 'full_only,partial_ok', '', 'self_fund_possible')} AS freq,
 CASE WHEN user_id % 3 = 0 THEN list_concat(['Germany', 'UK'], target_regions) ELSE target_regions END AS regions, {split(pick('Kenya, Ghana;Chile', '', 'Japan'))} AS countries,
 target_universities AS unis, research_interests AS fields, {pick('Graph learning', None)} AS one_liner, {words('bootcamp,other', 'unpaid_internships', '', 'online_only,non_stem')} AS codes,
 {pick('no unpaid internships please', None, '')} AS other_goal, CASE WHEN user_id % 11 = 0 THEN 'open' ELSE discovery_mode END AS mode, user_id % 4 <> 1 AS reloc, other_languages AS langs,
 {pick('BSc / BE', 'MSc', 'PhD', 'Diploma / HND')} AS deg, {pick('Other', 'Physics')} AS fos, {pick('Ocean science', None, 'Law')} AS fos2, {pick(None, None, '2024-05')} AS gdate, {pick('June', 'Smarch', '')} AS gmonth,
 2020 + user_id % 5 AS gyear, {pick('3.6', 'n/a', None)} AS gpa, {pick('IELTS', 'TOEFL', '')} AS etest, {pick('7.5', 'x')} AS escore, {pick('P1, P2; P3', 'Solo', '')} AS flag, {pick('Ada; Bob' + chr(10) + 'Cy', '')} AS conn,
 {words('Chip 1,LinkedIn', 'Chip 2', 'LinkedIn,Fairs')} AS chips FROM profiles),
pf AS (SELECT *, CASE WHEN len(styles) = 0 OR list_contains(styles, 'no_preference') OR (list_contains(styles, 'research_aligned') AND list_contains(styles, 'coursework')) THEN 'no_preference' ELSE styles[1] END AS style,
 CASE WHEN term = 'custom' AND cterm IS NOT NULL THEN cterm ELSE term END AS intake, CASE WHEN list_contains(freq, 'full_only') THEN 'full_only' WHEN list_contains(freq, 'partial_ok') THEN 'partial_ok' WHEN list_contains(freq, 'self_fund_possible') THEN 'self_fund_possible' ELSE 'full_only' END AS funding,
 list_concat(list_transform(list_filter(codes, lambda c: c <> 'other'), lambda c: {table('c', fr.ANTI_GOAL_LABELS, 'c')}), CASE WHEN coalesce(other_goal, '') <> '' THEN [other_goal] ELSE [] END) AS goals,
 {split('flag', '[,;]')}[1:2] AS projs, {split('conn')} AS conns, etest <> '' AS tested, TRY_CAST(escore AS DOUBLE) AS score, user_id % 4 <> 3 AS has_x, user_id % 2 = 0 AS rich FROM fo),
doc AS (SELECT *, CASE WHEN NOT has_x THEN '' WHEN rich THEN 'Research Fellow ' || user_id || '@Lab:4:true|Barista@Unknown organization:0:false' ELSE 'Tutor@Unknown organization:0:false|Clerk@Unknown organization:0:false' END AS exps,
 CASE WHEN has_x AND rich THEN ['Proj'] ELSE projs END AS projs2, CASE WHEN has_x AND rich THEN ['ocean', 'robots'] ELSE flatten(list_transform(projs, lambda p: fields[1:4])) END AS ptags,
 CASE WHEN NOT has_x THEN [] WHEN rich THEN ['python', 'sql', 'git'] ELSE ['excel', 'word'] END AS skills2, CASE WHEN has_x AND rich THEN ['Zed'] ELSE conns END AS conns2,
 CASE WHEN NOT has_x THEN [] WHEN rich THEN ['alpha', 'beta', 'gamma'] ELSE ['k1','k2','k3','k4','k5','k6','k7','k8','k9','k10'] END AS kws, CASE WHEN has_x AND rich THEN 'Lead a lab' END AS direction FROM pf)"""


def bq(name: str, sql: str, views: str = "profiles") -> None:
    oracle(name, with_views(views, FORMS + "\n" + sql))


def url(x: str) -> str:
    return f"CASE WHEN {x} <> '' AND NOT regexp_matches({x}, '^https?://') THEN 'https://' || {x} ELSE {x} END"


def j(x: str) -> str:
    return f"array_to_string({x}, '|')"


bq("b01_prefill", f"""SELECT user_id, nat AS nationality, {url('li')} AS linkedin_url, nullif({url('gh')}, '') AS github_url, style AS program_style, intake, funding AS funding_requirement, {j('countries')} AS countries,
 {j('unis')} AS universities, {j('goals')} AS anti_goals, mode AS discovery_mode, CASE deg WHEN 'BSc / BE' THEN 'BSc' WHEN 'Diploma / HND' THEN 'Diploma' ELSE deg END AS degree,
 CASE WHEN fos = 'Other' AND fos2 IS NOT NULL THEN fos2 ELSE fos END AS field, coalesce(gdate, CASE WHEN gmonth <> '' THEN gyear || '-' || CASE gmonth WHEN 'June' THEN '06' ELSE '01' END END) AS graduated,
 TRY_CAST(gpa AS DOUBLE) AS gpa, CASE WHEN tested THEN score END AS english, {j('projs')} AS projects, {j('conns')} AS connections,
 {j("list_filter(chips, lambda c: NOT starts_with(c, 'Chip '))")} AS manual_channels FROM pf""")
_rev = lst(fr.PREFILL_REVIEW)
bq("b02_merge_profile", f"""SELECT user_id, exps AS experiences, CASE WHEN has_x AND rich THEN 'ACM' END AS venue, CASE WHEN has_x AND rich THEN 'x' || user_id END AS doi, CASE WHEN has_x AND rich THEN '2021' END AS pub_year,
 {j('projs2')} AS projects, {j('skills2')} AS skills, CASE WHEN has_x AND rich THEN 'Prize A|Prize B:2020' ELSE '' END AS awards, {j('conns2')} AS connections, {j('kws')} AS keywords, direction,
 CASE WHEN NOT has_x THEN 'high' WHEN rich THEN 'high' ELSE 'medium' END AS confidence, {j(_rev)} || CASE WHEN has_x AND rich THEN '|awards' ELSE '' END AS review FROM doc""")
bq("b03_validate_profiles", f"""SELECT user_id, {j("list_filter([CASE WHEN target_degree = 'Diploma' THEN 'preferences.target_degree: unknown value' END, CASE WHEN len(kws) BETWEEN 1 AND 9 THEN 'search_keywords: at least 10 terms' END], lambda x: x IS NOT NULL)")} AS errors FROM doc""")


def uniq(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


_deg = table("target_degree", fr.DEGREE_SYNONYMS, "[lower(target_degree)]")
_must = f"list_concat({_deg}, {lst(fr.MUST_MATCH_FUNDING)})[1:15]"
_unis = "(CASE WHEN mode = 'target_list' THEN unis ELSE [] END)"
_drops = "[" + ", ".join(f"CASE WHEN g = {q(lab)} OR contains(lower(g), {q(c.replace('_', ' '))}) THEN {lst(fr.ANTI_GOAL_DROPS[c])} ELSE [] END" for c, lab in fr.ANTI_GOAL_LABELS.items()) + "]"
CFG = f""", c0 AS (SELECT *, {_must} AS must, list_transform(flatten([fields, kws, ptags, {_unis}]), lambda x: lower(x)) AS pm,
  list_concat(flatten(list_transform(regions, lambda r: {table('r', fr.REGION_ALIASES, '[r]')})), countries) AS rm, {_unis} AS im,
  list_concat(flatten(flatten(list_transform(goals, lambda g: {_drops}))), {lst(fr.ALWAYS_DROP)}) AS hd FROM doc),
cfg AS (SELECT user_id, funding, target_degree, must, {uniq('pm')}[1:30] AS pm, {uniq('rm')} AS rm, {uniq('im')} AS im, {uniq('hd')}[1:12] AS hd FROM c0)"""
bq("b04_compile_filter_config", CFG + f""" SELECT user_id, {j('must')} AS must_match_any, {j('pm')} AS profile_match_any, {j('rm')} AS region_match_any, {j('im')} AS institution_match_any, {j('hd')} AS hard_drop_any, funding AS funding_requirement FROM cfg""")
bq("b05_compile_eligibility_rules", f""", e AS (SELECT *, list_concat(list_concat({lst(fr.BOOST_PHRASES)}, flatten(list_transform(langs, lambda l: [l, l || ' language']))), CASE WHEN NOT reloc THEN regions[1:3] ELSE [] END) AS bo,
  nullif(regexp_extract(intake, '(20\\d{{2}})', 1), '') AS yr FROM doc)
SELECT user_id, {table('funding', fr.FUNDING_RULE, 'NULL')} AS require_funding, {j(uniq('bo'))} AS boost, yr || CASE WHEN contains(lower(intake), 'fall') THEN '-09' ELSE '-01' END AS target_intake,
 CASE WHEN etest = 'IELTS' THEN score END AS min_english_ielts, nat AS nationality FROM e""")
bq("b06_compile_ranking_config", f"""SELECT user_id, mode AS discovery_mode, CASE WHEN mode = 'target_list' THEN 0.35 ELSE 0.2 END::DOUBLE AS university_match_weight, reloc AS open_to_relocation,
 {j("list_filter(chips, lambda c: NOT starts_with(c, 'Chip '))")} AS manual_channels FROM doc""")
bq("b08_profile_fields", f"""SELECT user_id, full_name AS name, coalesce(direction, one_liner, '') AS long_term_goals, {j('fields')} AS interests, {j('skills2')} AS skills, target_degree AS degree_level, mode AS discovery_mode FROM doc""")
oracle("b09_profile_readiness", with_views("profiles feedback", """SELECT user_id, user_id IN (SELECT user_id FROM feedback) AS has_form_answers, user_id % 4 <> 3 AS has_structured_profile, user_id % 5 <> 0 AS has_compiled_artifacts FROM profiles"""))
oracle("b10_purge_user", with_views("profiles feedback requirements", """, g AS (SELECT user_id FROM profiles WHERE user_id % 10 = 0)
SELECT 'feedback' AS table_name, count(*) AS rows FROM feedback WHERE user_id NOT IN (SELECT user_id FROM g) UNION ALL SELECT 'profiles', count(*) FROM profiles WHERE user_id NOT IN (SELECT user_id FROM g)
UNION ALL SELECT 'requirements', count(*) FROM requirements WHERE user_id NOT IN (SELECT user_id FROM g)"""))

_hint = any_c(norm("t"), gr.DEGREE_HINTS)
bq("g18_profile_terms", CFG + f""", d AS (SELECT user_id, list_concat(pm, im) AS di, rm, list_concat([target_degree], list_filter(must, lambda t: {_hint})) AS de, hd, list_filter(must, lambda t: NOT {_hint}) AS ex FROM cfg)
SELECT user_id, {j(uniq('di'))} AS disciplines, {j(uniq('rm'))} AS regions, {j(uniq('de'))} AS degrees, {j('hd')} AS hard_drop, {j(uniq('ex'))} AS extra_type_terms FROM d""")
bq("g19_merge_envelopes", CFG + """ SELECT DISTINCT key, term FROM (SELECT 'must_match_any' AS key, unnest(must) AS term FROM cfg UNION ALL SELECT 'profile_match_any', unnest(pm) FROM cfg UNION ALL SELECT 'region_match_any', unnest(rm) FROM cfg
 UNION ALL SELECT 'institution_match_any', unnest(im) FROM cfg) UNION ALL SELECT 'hard_drop_any', term FROM (SELECT DISTINCT user_id, lower(unnest(hd)) AS term FROM cfg) GROUP BY term HAVING count(*) = (SELECT count(*) FROM cfg)""")
