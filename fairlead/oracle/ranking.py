"""Oracles of the ranking queries."""

from __future__ import annotations

from fairlead.bindings import with_views
from fairlead.oracle.facts import facts_sql
from fairlead.oracle.helpers import AS_OF_SQL, days_until, floor_days, lst, q
from fairlead.oracle.text import STATE, bucket, degree, level, table_case, urgency, urgency_text
from fairlead.plans.registry import oracle
from fairlead.rules import fact_rules as fr

COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def dot(a: str, b: str) -> str:
    return COS.replace("{a}", a).replace("{b}", b)


COSINE = f"{dot('uv.embedding', 'lv.embedding')} / (sqrt({dot('uv.embedding', 'uv.embedding')}) * sqrt({dot('lv.embedding', 'lv.embedding')}))"
oracle("r01_cosine", with_views("feedback vectors", f"""SELECT f.user_id, f.listing_id, round(coalesce({COSINE}, 0), 4) AS cosine
FROM feedback f LEFT JOIN vectors uv ON uv.vec_id = f.user_id LEFT JOIN vectors lv ON lv.vec_id = f.listing_id"""))
oracle("r02_calibrate", with_views("feedback", """SELECT user_id, listing_id, round(greatest(0.0, least(1.0, CASE listing_id % 4
 WHEN 2 THEN (fit_score - 0.5::DOUBLE) / (0.88::DOUBLE - 0.5::DOUBLE) WHEN 3 THEN (fit_score - 0.42::DOUBLE) / (0.75::DOUBLE - 0.42::DOUBLE) ELSE (fit_score - 0.15::DOUBLE) / (0.55::DOUBLE - 0.15::DOUBLE) END)), 4) AS calibrated FROM feedback"""))

TOK = f"list_filter(regexp_extract_all(lower({{x}}), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({lst(fr.STOPWORDS)}, w))"
SIDES = f"""
, lf0 AS ({facts_sql()}),
lf1 AS (SELECT *, f_deadline AS due, coalesce(funding_type, f_funding, '') AS fund,
  lower(concat_ws(' ', coalesce(title, ''), coalesce(summary, ''), coalesce(institution, ''), array_to_string(requirements, ' '))) AS combined,
  lower(concat_ws(' ', coalesce(title, ''), coalesce(summary, ''))) AS body_low,
  list_transform(list_concat(CASE WHEN len(countries) = 0 THEN f_regions ELSE countries END, f_regions), lambda x: lower(x)) AS region_sources FROM lf0),
side AS (SELECT *, list_sort(list_distinct(list_filter(list_concat(list_transform(list_concat(degree_levels, f_degrees), lambda x: {degree('x')}),
   [CASE WHEN regexp_matches(combined, '\\bphd\\s+only\\b') THEN 'phd' END, CASE WHEN regexp_matches(combined, '\\bundergraduate\\s+only\\b') THEN 'undergraduate' END]),
   lambda x: x IS NOT NULL))) AS degs FROM lf1),
ltok AS (SELECT listing_id, token, count(*) AS n FROM (SELECT listing_id, unnest({TOK.replace('{x}', "coalesce(title, '') || '. ' || coalesce(summary, '')")}) AS token FROM listings) GROUP BY ALL),
us AS (SELECT *, {degree('degree_level')} AS target, CASE WHEN discovery_mode = 'target_list' THEN 0.35::DOUBLE ELSE 0.2::DOUBLE END AS uw,
  list_distinct({TOK.replace('{x}', "concat_ws(' ', long_term_goals, array_to_string(research_interests, ' '), array_to_string(skills, ' '), array_to_string(target_universities, ' '))")}) AS toks FROM profiles),
utok AS (SELECT user_id, len(toks) AS np, unnest(toks) AS token FROM us),
lex AS (SELECT user_id, listing_id, ln(1 + 0.5 / (0.5 + 1.0::DOUBLE / any_value(np))) * sum(2.2 * n / (n + 1.2)) AS s FROM utok JOIN ltok USING (token) GROUP BY ALL),
tagw AS (SELECT user_id, listing_id, CASE status WHEN 'saved' THEN 0.6 WHEN 'in_progress' THEN 1.0 WHEN 'applied' THEN 1.0 ELSE 0 END::DOUBLE AS wp,
  CASE WHEN status = 'archived' THEN 0.5 WHEN status = 'dismissed' THEN CASE WHEN dismiss_reason IS NOT NULL THEN 0.85 ELSE 0.5 END ELSE 0 END::DOUBLE AS wn FROM feedback),
keys AS (SELECT listing_id, 'tag' AS kind, unnest(tags) AS key FROM listings UNION ALL SELECT listing_id, 'inst', lower(institution) FROM listings WHERE institution IS NOT NULL),
aff AS (SELECT user_id, kind, key, sum(wp) AS pos, sum(wn) AS neg FROM tagw JOIN keys USING (listing_id) WHERE wp > 0 OR wn > 0 GROUP BY ALL),
gain AS (SELECT kind, user_id, key, CASE kind WHEN 'tag' THEN least(0.08, 0.04 * pos) - least(0.06, 0.03 * neg) ELSE least(0.1, 0.05 * pos) - least(0.08, 0.04 * neg) END AS g FROM aff)"""


def scores(pairs: str) -> str:
    """CTEs ending in ``sc``; pairs: (user_id, listing_id, status)."""
    def hit(list_: str, text: str = "combined") -> str:
        return f"list_filter({list_}, lambda p: contains({text}, lower(p)))"

    return SIDES + f"""
, pr AS ({pairs}),
pg AS (SELECT pr.user_id, pr.listing_id, sum(g) AS g FROM pr JOIN keys USING (listing_id) JOIN gain ON gain.user_id = pr.user_id AND gain.kind = keys.kind AND gain.key = keys.key GROUP BY ALL),
j AS (SELECT pr.*, s.* EXCLUDE (listing_id), us.* EXCLUDE (user_id), coalesce(pg.g, 0) AS g, coalesce(lex.s, 0) AS lexs,
  CASE WHEN uv.embedding IS NOT NULL AND lv.embedding IS NOT NULL THEN {COSINE} END AS cos,
  greatest(0.0, least(1.0, CASE status WHEN 'saved' THEN 0.72 WHEN 'in_progress' THEN 0.88 WHEN 'applied' THEN 0.92 WHEN 'archived' THEN 0.25 WHEN 'dismissed' THEN 0.15 ELSE 0.5 END::DOUBLE + coalesce(pg.g, 0))) AS affinity
 FROM pr JOIN side s USING (listing_id) JOIN us USING (user_id) LEFT JOIN pg USING (user_id, listing_id) LEFT JOIN lex USING (user_id, listing_id)
 LEFT JOIN vectors uv ON uv.vec_id = pr.user_id LEFT JOIN vectors lv ON lv.vec_id = pr.listing_id),
e AS (SELECT *, coalesce(cos, lexs / (lexs + 4.0)) AS sem_raw, CASE WHEN cos IS NOT NULL THEN greatest(0.0, least(1.0, (cos - 0.15::DOUBLE) / (0.55::DOUBLE - 0.15::DOUBLE))) ELSE lexs / (lexs + 4.0) END AS sem,
  {hit('reject_phrases')} AS rej, {hit('research_interests')}[1:3] AS ints, list_filter({hit('skills')}, lambda s: length(s) > 3)[1:3] AS sk, {hit('target_universities')}[1] AS uni,
  list_filter(target_regions, lambda r: contains(combined, lower(r)) OR len(list_filter(region_sources, lambda c: contains(c, lower(r)))) > 0) AS regs,
  {hit('other_languages')}[1] AS lang, {hit('boost_phrases')} AS boost, list_contains(f_regions, 'Global') AS worldwide_ok, coalesce(require_funding, 'full_only') = 'full_only' AS strict,
  len(degs) > 0 AS has_deg, list_contains(degs, target) AS dm, degs = ['phd'] AS phd_only, {days_until('due')} AS days, {floor_days('due', AS_OF_SQL)} AS fdays FROM j),
e2 AS (SELECT *, has_deg AND NOT dm AND phd_only AND target IN ('master', 'undergraduate') AS dfail, has_deg AND NOT dm AND NOT (phd_only AND target IN ('master', 'undergraduate')) AS dpart FROM e),
e3 AS (SELECT *, round(greatest(0.0, least(1.0, 0.35::DOUBLE + CASE WHEN has_deg AND dm THEN 0.12 ELSE 0 END - CASE WHEN dpart THEN 0.12 ELSE 0 END - CASE WHEN strict AND fund = 'partial' THEN 0.18 ELSE 0 END
   + CASE WHEN strict AND fund = 'full' THEN 0.15 ELSE 0 END + CASE WHEN strict AND fund IN ('stipend', 'award') THEN 0.1 ELSE 0 END + CASE WHEN len(ints) > 0 THEN 0.15::DOUBLE * 0.85 ELSE 0 END
   + CASE WHEN len(sk) > 0 THEN 0.08 ELSE 0 END + CASE WHEN uni IS NOT NULL THEN uw * 0.85 ELSE 0 END + CASE WHEN len(regs) > 0 THEN 0.1::DOUBLE * 0.85 ELSE 0 END
   + CASE WHEN len(regs) = 0 AND worldwide_ok THEN 0.05 ELSE 0 END + CASE WHEN lang IS NOT NULL THEN 0.08::DOUBLE * 0.85 ELSE 0 END + len(boost) * 0.05::DOUBLE)), 4) AS elig,
  len(rej) > 0 OR dfail OR (strict AND fund = 'self') AS hard, {urgency('days')} AS urg FROM e2),
sc AS (SELECT *, (0.45::DOUBLE * sem + 0.3::DOUBLE * elig + CASE WHEN due IS NOT NULL THEN 0.15::DOUBLE * urg ELSE 0 END + 0.1::DOUBLE * affinity)
   / (0.45::DOUBLE + 0.3::DOUBLE + CASE WHEN due IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END + 0.1::DOUBLE) AS composite FROM e3)"""


PAIRS = "SELECT user_id, listing_id, status FROM feedback"
VIEWS = "listings profiles feedback vectors"


def rq(name: str, select: str, pairs: str = PAIRS) -> None:
    oracle(name, with_views(VIEWS, scores(pairs) + "\n" + select))


rq("r03_lexical_similarity", "SELECT user_id, listing_id, round(lexs / (lexs + 4.0), 4) AS lexical FROM j")
rq("r04_semantic_score", "SELECT user_id, listing_id, round(sem, 4) AS score, round(sem_raw, 4) AS raw, CASE WHEN cos IS NOT NULL THEN 'cosine' ELSE 'lexical' END AS method, true AS available FROM sc")

_dn = table_case("target", fr.DEGREE_NAMES)
_amt = "CASE WHEN f_amount IS NOT NULL THEN ' (' || f_amount || ')' ELSE '' END"
# (condition, code, label, direction, weight) in rule order; phrase rules are added around them.
_RULES = [
    ("NOT has_deg", "degree_unknown", "'Listing does not state a required degree level'", "neutral", "0"),
    ("dfail AND target = 'master'", "degree_mismatch", "'PhD-only listing for MSc applicant'", "negative", "0"),
    ("dfail AND target = 'undergraduate'", "degree_mismatch", "'Doctoral-only listing'", "negative", "0"),
    ("dpart", "degree_partial", "'Degree level may not align with listing'", "negative", "0.12"),
    ("has_deg AND dm", "degree_match", f"'Open to ' || {_dn} || ' applicants'", "positive", "uw"),
    ("fund = ''", "funding_unknown", "'Listing does not publish funding details'", "neutral", "0"),
    ("strict AND fund = 'partial'", "funding_partial", "'Partial funding only. You require full funding'", "negative", "0.18"),
    ("strict AND fund = 'self'", "funding_self", "'Self-funded. You require full funding'", "negative", "0"),
    ("strict AND fund = 'full'", "funding_full", f"'Fully funded' || {_amt}", "positive", "0.15"),
    ("strict AND fund IN ('stipend', 'award')", "funding_stipend", f"'Paid opportunity' || {_amt}", "positive", "0.1"),
    ("len(ints) > 0", "interest_match", "'Matches your ' || array_to_string(ints, ', ') || ' focus'", "positive", "0.15"),
    ("len(sk) > 0", "skill_match", "'Uses your skills: ' || array_to_string(sk, ', ')", "positive", "0.1"),
    ("uni IS NOT NULL", "university_match", "'Aligns with ' || uni", "positive", "uw"),
    ("len(regs) > 0", "region_match", "'Located in your target region: ' || array_to_string(regs[1:2], ', ')", "positive", "0.1"),
    ("len(regs) = 0 AND worldwide_ok", "region_global", "'Open to applicants worldwide'", "positive", "0.06"),
    ("lang IS NOT NULL", "language_match", "'Language requirement met: ' || lang", "positive", "0.08"),
]


def _struct(code, label, direction, weight, source="eligibility"):
    return f"{{'code': {q(code)}, 'label': {label}, 'dir': {q(direction)}, 'w': ({weight})::DOUBLE, 'src': {q(source)}}}"


def _rules(rules, source="eligibility"):
    return "[" + ", ".join(f"CASE WHEN {c} THEN {_struct(k, lab, d, w, source)} END" for c, k, lab, d, w in rules) + "]"


_EL = (f"list_filter(flatten([list_transform(rej, lambda p: {_struct('reject_phrase', chr(39) + 'Contains exclusion phrase: ' + chr(39) + ' || p', 'negative', '0')}), {_rules(_RULES)}, "
       f"list_transform(boost, lambda p: {_struct('boost_phrase', chr(39) + 'Profile boost: ' + chr(39) + ' || p', 'positive', '0.05')})]), lambda x: x IS NOT NULL)")
rq("r05_evaluate_eligibility", f"""SELECT user_id, listing_id, elig AS elig_score, hard AS hard_failed, array_to_string(list_transform(el, lambda x: x.code), '|') AS codes,
 array_to_string(list_transform(el, lambda x: x.label), '|') AS labels FROM (SELECT *, {_EL} AS el FROM sc)""")
oracle("r06_opportunity_degrees", with_views(VIEWS, SIDES + "\nSELECT listing_id, array_to_string(degs, '|') AS degrees FROM side"))
oracle("r07_affinity_profile", with_views(VIEWS, SIDES + "\nSELECT user_id, kind, key, round(pos, 4) AS pos, round(neg, 4) AS neg FROM aff"))
rq("r08_affinity_score", "SELECT user_id, listing_id, round(affinity + 1e-9, 4) AS affinity FROM sc")
oracle("r05_large_vocabulary", """WITH d AS (SELECT doc_id, lower(text) AS t, string_split(lower(text), ' ') AS w FROM documents),
p AS (SELECT unnest(list_transform(range(0, 6), lambda k: concat_ws(' ', w[k * 7 + 1], w[k * 7 + 2]))) AS p, unnest(range(0, 6)) AS k FROM d),
v AS (SELECT DISTINCT CASE WHEN k % 2 = 0 THEN p ELSE substr(p, 2, 200) END AS term FROM p), u AS (SELECT term FROM v WHERE trim(term) <> ''),
h AS (SELECT doc_id, count(*) AS n, md5(string_agg(term, '|' ORDER BY term)) AS m FROM d JOIN u ON contains(t, term) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_hits, coalesce(m, md5('')) AS hits_md5 FROM d LEFT JOIN h USING (doc_id)""")
oracle("r05_shared_word", """WITH d AS (SELECT doc_id, 'university of town' || (doc_id % 5000) AS term, lower(concat('university of town', doc_id % 5000, ' ', text)) AS t FROM documents), v AS (SELECT DISTINCT term FROM d)
SELECT doc_id, string_agg(v.term, '|' ORDER BY v.term) AS hits FROM d JOIN v ON contains(t, v.term) GROUP BY doc_id""")
oracle("r09_composite", with_views("feedback", """SELECT user_id, listing_id, round((CASE WHEN has_semantic THEN 0.45::DOUBLE * semantic ELSE 0 END + 0.3::DOUBLE * eligibility
  + CASE WHEN has_urgency THEN 0.15::DOUBLE * urgency ELSE 0 END + CASE WHEN NOT hide_percent THEN 0.1::DOUBLE * fit_score ELSE 0 END)
  / (CASE WHEN has_semantic THEN 0.45::DOUBLE ELSE 0 END + 0.3::DOUBLE + CASE WHEN has_urgency THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN NOT hide_percent THEN 0.1::DOUBLE ELSE 0 END) + 1e-9, 4) AS composite,
  concat_ws('|', CASE WHEN has_semantic THEN 'semantic=0.45' END, 'eligibility=0.3', CASE WHEN has_urgency THEN 'urgency=0.15' END, CASE WHEN NOT hide_percent THEN 'affinity=0.1' END) AS weights FROM feedback"""))

_EVID = ("list_filter(list_concat(research_interests, list_concat(target_universities, skills)), lambda t: length(t) >= 3 AND contains(body_low, lower(t)) "
         f"AND NOT list_contains({lst(fr.STOPWORDS)}, lower(t)))[1:4]")
_SUF = "CASE WHEN len(ev) > 0 THEN ': ' || array_to_string(ev[1:3], ', ') ELSE '' END"
_CTX = [
    ("sem >= 0.55", "semantic_strong", f"'Strong topical overlap with your profile' || {_SUF}", "positive", "round(sem, 4)", "semantic"),
    ("sem < 0.55 AND sem >= 0.30", "semantic_moderate", f"'Related to your stated interests' || {_SUF}", "positive", "round(sem, 4)", "semantic"),
    ("sem < 0.30 AND sem > 0 AND len(ev) > 0", "semantic_partial", f"'Partial keyword overlap' || {_SUF}", "neutral", "round(sem, 4)", "semantic"),
    ("sem < 0.30 AND sem > 0 AND len(ev) = 0", "semantic_weak", "'None of your profile keywords appear in this listing'", "negative", "round(sem, 4)", "semantic"),
    ("len(f_formats) > 0", "format", "'Listed as ' || CASE WHEN regexp_matches(f_formats[1], '^[aeiou]') THEN 'an ' ELSE 'a ' END || f_formats[1]", "neutral", "0", "listing"),
    ("len(f_themes) > 0 AND len(ints) = 0", "theme", "'Focus areas: ' || array_to_string(f_themes[1:3], ', ')", "neutral", "0", "listing"),
    ("coalesce(f_remote, false)", "remote", "'Can be done remotely'", "positive", "0.05", "listing"),
    ("verification_status = 'primary_confirmed'", "verified", "'Confirmed against the official source page'", "positive", "0.1", "verification"),
    ("affinity >= 0.75", "affinity_positive", "'Similar to opportunities you saved or started'", "positive", "round(affinity, 4)", "affinity"),
    ("affinity <= 0.35", "affinity_negative", "'Similar to opportunities you archived'", "negative", "round(affinity, 4)", "affinity"),
    ("due IS NOT NULL AND fdays <= 14", "urgency", "'Deadline in ' || CAST(fdays AS BIGINT) || CASE WHEN fdays = 1 THEN ' day' ELSE ' days' END", "positive", "CASE WHEN fdays <= 7 THEN 1.0 ELSE 0.7 END", "urgency"),
    ("due IS NOT NULL AND fdays > 14 AND fdays <= 60", "deadline_known", "'Applications close in ' || CAST(fdays AS BIGINT) || ' days'", "neutral", "0.3", "urgency"),
    ("due IS NULL AND coalesce(f_note = 'rolling', false)", "deadline_rolling", "'Rolling deadline. Apply any time'", "neutral", "0", "urgency"),
    ("due IS NULL AND NOT coalesce(f_note = 'rolling', false)", "deadline_missing", "'No deadline published. Ranked without urgency'", "negative", "0", "urgency"),
    ("cos IS NULL", "semantic_keyword_only", "'Keyword matching used. Semantic model not configured'", "neutral", "0", "system"),
]
_ctx = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {_struct(k, lab, d, w, s)} END" for c, k, lab, d, w, s in _CTX) + "], lambda x: x IS NOT NULL)"
REASONS = f"""
, r0 AS (SELECT *, {_EL} AS el, {_EVID} AS ev FROM sc),
r1 AS (SELECT *, list_concat(list_filter(el, lambda x: NOT (strict AND fund = 'full' AND x.code = 'boost_phrase' AND contains(lower(x.label), 'fund'))), {_ctx}) AS rs FROM r0),
r2 AS (SELECT user_id, listing_id, unnest(rs) AS r, generate_subscripts(rs, 1) AS i FROM r1),
r3 AS (SELECT *, row_number() OVER (PARTITION BY user_id, listing_id ORDER BY CASE r.dir WHEN 'positive' THEN 0 WHEN 'negative' THEN 1 ELSE 2 END, -r.w, i) AS pos FROM r2),
r4 AS (SELECT user_id, listing_id, list(r ORDER BY pos) AS rs FROM r3 GROUP BY ALL),
r5 AS (SELECT *, list_transform(list_filter(rs, lambda x: x.dir = 'positive')[1:2], lambda x: x.label) AS p, list_transform(list_filter(rs, lambda x: x.dir = 'neutral')[1:2], lambda x: x.label) AS n,
  list_transform(list_filter(rs, lambda x: x.code IN ('urgency', 'deadline_rolling'))[1:1], lambda x: x.label) AS u FROM r4),
r6 AS (SELECT *, CASE WHEN len(p) > 0 THEN p ELSE n END AS base FROM r5),
rr AS (SELECT *, list_concat(base, list_filter(u, lambda x: NOT list_contains(base, x))) AS parts FROM r6)"""
rq("r10_fit_reasons", REASONS + f"""
SELECT user_id, listing_id, array_to_string(list_transform(rs, lambda x: x.code), '|') AS codes, CASE WHEN len(parts) > 0 THEN array_to_string(parts, '; ') ELSE {q(fr.NEUTRAL_REASON)} END AS fit_explanation,
 len(parts) = 0 OR len(list_filter(rs, lambda x: x.src <> 'system')) = 0 AS hide_percent, array_to_string(ev, '|') AS evidence FROM rr JOIN r0 USING (user_id, listing_id)""")
rq("r11_score_breakdown", """SELECT user_id, listing_id, round(sem, 4) AS semantic, CASE WHEN cos IS NOT NULL THEN 'cosine' ELSE 'lexical' END AS semantic_method, elig AS eligibility,
 CASE WHEN due IS NOT NULL THEN round(urg, 4) ELSE 0.0::DOUBLE END AS urgency, round(affinity, 4) AS affinity, round(composite + 1e-9, 4) AS composite, hard AS hard_eligibility_failed,
 CASE WHEN due IS NOT NULL THEN 'semantic|eligibility|urgency|affinity' ELSE 'semantic|eligibility|affinity' END AS components,
 CASE WHEN due IS NOT NULL THEN 'semantic=0.45|eligibility=0.3|urgency=0.15|affinity=0.1' ELSE 'semantic=0.45|eligibility=0.3|affinity=0.1' END AS weights FROM sc""")
LIVE = f"""duplicate_of IS NULL AND NOT starts_with(url_hash, 'demo-') AND (deadline IS NULL OR deadline >= {AS_OF_SQL}) AND (verification_status IS NULL OR verification_status <> 'stale')"""
ALL_PAIRS = f"""SELECT p.user_id, l.listing_id, f.status FROM (SELECT user_id FROM profiles) p, (SELECT listing_id FROM listings WHERE {LIVE}) l
 LEFT JOIN feedback f ON f.user_id = p.user_id AND f.listing_id = l.listing_id"""
RANKED = f"""SELECT user_id, listing_id, row_number() OVER (PARTITION BY user_id ORDER BY round(composite, 6) DESC, listing_id) AS rank_position, round(composite + 1e-9, 3) AS fit_score,
 {level('composite', 'hard')} AS fit_level FROM sc"""
rq("r12_rank_for_users", RANKED, ALL_PAIRS)
EXPIRED = f"""SELECT user_id, listing_id, 0.0::DOUBLE AS fit_score, 'weak' AS fit_level, 'deadline has passed' AS fit_explanation, CAST(NULL AS BIGINT) AS rank_position
 FROM profiles, listings WHERE duplicate_of IS NULL AND deadline < {AS_OF_SQL}"""
oracle("r13_expired_rows", with_views("listings profiles", EXPIRED))
oracle("r14_recompute_affinity", with_views(VIEWS, scores("SELECT user_id, listing_id, status FROM feedback WHERE status IN ('saved', 'dismissed')") + f"""
, x AS (SELECT f.*, sc.affinity AS na, (CASE WHEN f.has_semantic THEN 0.45::DOUBLE * f.semantic ELSE 0 END + 0.3::DOUBLE * f.eligibility + CASE WHEN f.has_urgency THEN 0.15::DOUBLE * f.urgency ELSE 0 END + 0.1::DOUBLE * sc.affinity)
  / (CASE WHEN f.has_semantic THEN 0.45::DOUBLE ELSE 0 END + 0.3::DOUBLE + CASE WHEN f.has_urgency THEN 0.15::DOUBLE ELSE 0 END + 0.1::DOUBLE) AS c FROM feedback f JOIN sc USING (user_id, listing_id))
SELECT user_id, listing_id, round(na + 1e-9, 4) AS affinity, round(c + 1e-9, 4) AS composite, {level('c', 'hard_failed')} AS new_level FROM x"""))
_D = days_until("deadline")
oracle("r15_response_view", with_views("listings feedback", f"""SELECT user_id, listing_id, CASE WHEN NOT hide_percent THEN CAST(round(fit_score * 100) AS BIGINT) END AS fit_percent,
 CASE WHEN hide_percent THEN {q(fr.NEUTRAL_REASON)} ELSE fit_explanation END AS fit_explanation, {STATE} AS trust_state, {table_case(STATE, fr.TRUST_LABELS)} AS trust_label,
 {_D} AS days_until_deadline, {urgency_text(_D)} AS urgency_label, {bucket(_D)} AS deadline_bucket FROM feedback JOIN listings USING (listing_id)"""))
rq("r16_rerank_all", f""", rk AS ({RANKED}), ex AS ({EXPIRED})
SELECT user_id, fit_level, count(*) AS n, count(rank_position) AS ranked, max(rank_position) AS last_rank FROM
 (SELECT user_id, fit_level, rank_position FROM rk UNION ALL SELECT user_id, fit_level, rank_position FROM ex) GROUP BY ALL""", ALL_PAIRS)
