"""Oracles of the scalar-function queries."""

from __future__ import annotations

from fairlead.bindings import with_views
from fairlead.functions.text import normalize_py
from fairlead.oracle.helpers import (
    AS_OF_SQL, any_c, day, days_until, first_hit, host, ladder, lst, multi, norm, parse_date, pat, path, q,
)
from fairlead.plans.registry import oracle
from fairlead.rules import fact_rules as fr
from fairlead.rules import gate_rules as gr

BODY = "concat_ws(' ', title, summary)"
LOW = f"lower({BODY})"

oracle("p01_canonicalize_url", rf"""
WITH u AS (SELECT page_id, url, string_split(regexp_extract(url, '\?([^#]*)', 1), '&') AS pairs FROM pages),
kv AS (SELECT page_id, unnest(pairs) AS pair, generate_subscripts(pairs, 1) AS i FROM u),
kept AS (SELECT page_id, i, split_part(pair, '=', 1) AS k, regexp_extract(pair, '=(.*)$', 1) AS v FROM kv),
firsts AS (SELECT page_id, i, k, v FROM kept WHERE v <> '' AND k NOT IN ('utm_source', 'ref')
  QUALIFY row_number() OVER (PARTITION BY page_id, k ORDER BY i) = 1),
qs AS (SELECT page_id, string_agg(k || '=' || v, '&' ORDER BY i) AS qs FROM firsts GROUP BY page_id)
SELECT u.page_id, lower(split_part(url, ':', 1)) || '://' || {host('url')}
  || CASE WHEN rtrim({path('url')}, '/') = '' THEN '/' ELSE rtrim({path('url')}, '/') END
  || CASE WHEN qs IS NULL THEN '' ELSE '?' || qs END AS canonical
FROM u LEFT JOIN qs ON qs.page_id = u.page_id""")

oracle("p02_hashes", "SELECT page_id, sha256(lower(trim(url))) AS url_hash, sha256(html) AS content_hash FROM pages")
oracle("p03_domains", f"SELECT page_id, {host('url')} AS domain FROM pages")
oracle("p04_normalize_text", f"SELECT doc_id, md5({norm('text')}) AS norm_md5 FROM documents")

_terms = gr.FUNDING_LEXICON + gr.APPLICATION_LEXICON
_values = ", ".join(f"({i}, {q(t)}, {q(normalize_py(t).split(' ')[0])}, {q(pat(t))})" for i, t in enumerate(_terms))
oracle("p05_find_terms", with_views("listings", f"""
, t(i, term, word, pat) AS (VALUES {_values}),
n AS (SELECT listing_id, {norm(BODY)} AS txt FROM listings),
h AS (SELECT listing_id, i, term FROM n JOIN t ON contains(txt, word) AND regexp_matches(txt, pat)
  QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY i) <= 8)
SELECT n.listing_id, coalesce(string_agg(term, '|' ORDER BY i), '') AS terms
FROM n LEFT JOIN h ON h.listing_id = n.listing_id GROUP BY n.listing_id"""))

oracle("p06_find_amounts", with_views("listings", f"""
, m AS (SELECT listing_id, regexp_extract_all({BODY}, {q(gr.AMOUNT_PATTERN)}) AS found FROM listings),
u AS (SELECT listing_id, trim(unnest(found)) AS v, generate_subscripts(found, 1) AS i FROM m),
d AS (SELECT listing_id, v, min(i) AS i FROM u GROUP BY listing_id, v
  QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY min(i)) <= 3)
SELECT m.listing_id, coalesce(string_agg(v, '|' ORDER BY d.i), '') AS amounts
FROM m LEFT JOIN d ON d.listing_id = m.listing_id GROUP BY m.listing_id"""))

_edges = ", ".join(f"({q(k)}, {q(v)})" for k, vs in gr.SYNONYMS.items() for v in vs)
oracle("p07_expand_terms", with_views("profiles", f"""
, e(a, b) AS (VALUES {_edges}),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e)
SELECT * FROM (WITH RECURSIVE reach(a, b) AS (
    SELECT a, b FROM b UNION SELECT r.a, b.b FROM reach r JOIN b ON b.a = r.b),
  seeds AS (SELECT user_id, unnest(research_interests) AS term, generate_subscripts(research_interests, 1) AS i FROM profiles),
  grown AS (SELECT user_id, i, 0 AS j, '' AS srt, term FROM seeds
    UNION ALL SELECT user_id, i, 1, b, b FROM seeds JOIN reach ON a = {norm('term')} AND b <> a),
  firsts AS (SELECT * FROM grown QUALIFY row_number() OVER (PARTITION BY user_id, {norm('term')} ORDER BY i, j, srt) = 1)
  SELECT user_id, string_agg(term, '|' ORDER BY i, j, srt) AS terms FROM firsts GROUP BY user_id)"""))

_strip = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'),
  '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"""
for _a, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
    _strip = f"replace({_strip}, {q(_a)}, {q(_c)})"
VISIBLE = rf"trim(regexp_replace({_strip}, '\s+', ' ', 'g'))"
oracle("p08_strip_html", f"SELECT page_id, md5({VISIBLE}) AS text_md5 FROM pages")


def one(name: str, expr: str, view: str = "listings", key: str = "listing_id") -> None:
    oracle(name, with_views(view, f"SELECT {key}, {expr} FROM {view}"))


one("p09_classify_type", ladder("lower(concat(title, ' ', coalesce(summary, '')))", fr.TYPE_KEYWORDS.items(), "'other'") + " AS kind")
one("p10_parse_deadline", day("coalesce(" + ", ".join(
    parse_date(f"regexp_extract({BODY}, {q(c)}, 1)") for c in fr.DEADLINE_CUES) + ")") + " AS deadline")
_title_case = {"cv": "Cv"} | {k: k.title() for k in fr.REQUIREMENT_KEYWORDS}
one("p11_extract_requirements", "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN contains({LOW}, {q(k)}) THEN {q(_title_case[k])} END" for k in fr.REQUIREMENT_KEYWORDS)
    + "], lambda x: x IS NOT NULL), '|') AS requirements")
one("p12_detect_funding_extract", ladder(LOW, [("full", fr.EXTRACT_FULL), ("partial", fr.EXTRACT_PARTIAL), ("self", fr.EXTRACT_SELF)]) + " AS funding")
_labels: dict[str, list[str]] = {}
for _k, _v in fr.DEGREE_LABELS:
    _labels.setdefault(_v, []).append(_k)
one("p13_detect_degrees", f"array_to_string({multi(LOW, _labels, 9)}, '|') AS degrees")


def derive(text: str) -> tuple[str, str]:
    line = f"trim(regexp_extract({text}, {q(fr.DEADLINE_LINE)}, 1))"
    roll = f"({line} <> '' AND {any_c(f'lower({line})', fr.ROLLING_HINTS)})"
    unk = f"({line} <> '' AND {any_c(f'lower({line})', fr.UNKNOWN_HINTS)})"
    tries = []
    for src in (line, f"regexp_extract({text}, {q(fr.ISO_DATE)})", f"regexp_extract({text}, {q(fr.INLINE_DATE)})"):
        d = parse_date(src)
        tries.append(f"CASE WHEN year({d}) BETWEEN 2020 AND 2035 THEN {d} END")
    dated = "coalesce(" + ", ".join(tries) + ")"
    deadline = f"CASE WHEN {roll} OR {unk} THEN NULL ELSE {dated} END"
    note = (f"CASE WHEN {roll} THEN 'rolling' WHEN {unk} THEN 'unspecified' WHEN {dated} IS NOT NULL THEN NULL "
            f"WHEN {any_c(f'lower({text})', fr.ROLLING_HINTS)} THEN 'rolling' END")
    return deadline, note


_d, _n = derive(BODY)
one("p18_derive_deadline", f"{day(_d)} AS deadline, {_n} AS note")


def funding_facts(low: str) -> tuple[str, str, str]:
    amount = f"nullif(trim(regexp_extract({low}, {q(fr.MONEY)})), '')"
    groups = [("full", fr.FULL_FUNDING_PHRASES), ("self", fr.SELF_FUNDING_PHRASES),
              ("partial", fr.PARTIAL_FUNDING_PHRASES), ("stipend", fr.STIPEND_PHRASES)]
    kind = "CASE " + " ".join(f"WHEN {any_c(low, p)} THEN {q(k)}" for k, p in groups) + f" WHEN {amount} IS NOT NULL THEN 'award' END"
    evidence = "coalesce(" + ", ".join(first_hit(low, p) for _, p in groups) + f", 'award of ' || {amount})"
    return kind, evidence, amount


_k, _e, _a = funding_facts(LOW)
one("p19_detect_funding_facts", f"{_k} AS funding, {_e} AS evidence, {_a} AS amount")
one("p20_detect_multi", ", ".join(f"array_to_string({multi(LOW, t, n)}, '|') AS {c}" for t, n, c in (
    (fr.DEGREE_NEEDLES, 4, "degrees"), (fr.REGION_NEEDLES, 4, "regions"), (fr.THEME_NEEDLES, 5, "themes"),
    (fr.FORMAT_NEEDLES, 2, "formats"))))
one("p23_days_until", days_until("(deadline + to_hours(CAST(listing_id % 24 AS INT)))") + " AS days")


def bucket(d: str) -> str:
    return (f"CASE WHEN {d} IS NULL THEN 'unknown' WHEN {d} < 0 THEN 'overdue' WHEN {d} = 0 THEN 'today' WHEN {d} <= 3 THEN "
            f"'within_3_days' WHEN {d} <= 7 THEN 'within_7_days' WHEN {d} <= 30 THEN 'within_30_days' ELSE 'later' END")


def urgency_text(d: str) -> str:
    return (f"CASE WHEN {d} IS NULL THEN NULL WHEN {d} < 0 THEN 'Expired' WHEN {d} = 0 THEN 'Due today' WHEN {d} = 1 THEN '1 day left' "
            f"WHEN {d} <= 30 THEN {d} || ' days left' ELSE ({d} // 7) || CASE WHEN {d} // 7 = 1 THEN ' week left' ELSE ' weeks left' END END")


def urgency(d: str) -> str:
    return (f"CAST(CASE WHEN {d} IS NULL OR {d} < 0 THEN 0 WHEN {d} <= 7 THEN 1 WHEN {d} <= 14 THEN 0.8 WHEN {d} <= 30 THEN 0.6 "
            f"ELSE 0.3 END AS DOUBLE)")


def level(score: str, hard: str) -> str:
    return (f"CASE WHEN {hard} THEN CASE WHEN {score} >= 0.42 THEN 'moderate' ELSE 'weak' END WHEN {score} >= 0.62 THEN 'strong' "
            f"WHEN {score} >= 0.42 THEN 'moderate' ELSE 'weak' END")


STATE = ("CASE verification_status WHEN 'primary_confirmed' THEN 'verified' WHEN 'aggregator_only' THEN 'aggregator_only' "
         "WHEN 'stale' THEN 'conflict' ELSE 'unchecked' END")
DAYS = days_until("deadline")
one("p24_deadline_bucket", f"{bucket(DAYS)} AS bucket, {urgency_text(DAYS)} AS label")
one("p25_urgency_score", f"{urgency(DAYS)} AS urgency")
one("p26_fit_level", f"listing_id, {level('fit_score', 'hard_failed')} AS level", "feedback", "user_id")


def table_case(key: str, table: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


one("p27_trust_state", f"{STATE} AS state, {table_case(STATE, fr.TRUST_LABELS)} AS label, {table_case(STATE, fr.TRUST_HINTS)} AS hint")
one("p28_funding_category", ladder("lower(concat_ws(' ', funding_type, title, summary))", fr.VERIFY_FUNDING) + " AS category")


def org_name(title: str = "title", inst: str = "institution") -> str:
    t = f"trim(coalesce({title}, ''))"
    for s in fr.ORG_SUFFIXES:
        t = f"split_part({t}, {q(s)}, 1)"
    t = f"substr({t}, 1, 255)"
    return f"CASE WHEN length(trim(coalesce({inst}, ''))) > 2 THEN trim({inst}) WHEN {t} <> '' THEN {t} ELSE 'Unknown organization' END"


def org_key(x: str) -> str:
    return rf"substr(trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), 1, 255)"


one("p29_org_names", f"{org_name()} AS org, {org_key(org_name())} AS org_key")


def institutional(d: str) -> str:
    return any_c(d, fr.INSTITUTIONAL_TOKENS)


def non_primary(d: str) -> str:
    tail = " OR ".join(f"{d} = {q(k)} OR ends_with({d}, {q('.' + k)})" for k in fr.NON_PRIMARY_DOMAINS)
    return f"({d} = '' OR {tail})"


oracle("p30_domain_classes", f"""WITH d AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'm.medium.com' WHEN 1 THEN {host('url')} || '.ac.uk'
  ELSE {host('url')} END AS d FROM pages)
SELECT page_id, {institutional('d')} AS institutional, {non_primary('d')} AS non_primary FROM d""")


def matches_org(domain: str, org: str) -> str:
    core = rf"regexp_replace(regexp_replace(lower({domain}), '\.[^.]*$', ''), '[^a-z0-9]', '', 'g')"
    words = (f"list_filter(string_split_regex(lower({org}), '[^a-z0-9]+'), lambda t: length(t) >= 4 AND NOT list_contains({lst(fr.ORG_STOPWORDS)}, t) "
             f"AND NOT regexp_matches(t, '^[0-9]+$'))")
    present = f"list_filter({words}, lambda t: contains({core}, t))"
    return (f"coalesce({core} <> '' AND (len(list_filter({present}, lambda t: length(t) >= 8)) > 0 OR len({present}) >= 2 "
            f"OR contains({core}, {words}[1] || {words}[2])), false)")


_h = r"regexp_replace(lower(host), '^www\.', '')"
one("p31_domain_matches_org", matches_org(_h, "concat(split_part(host, '.', 1), ' ', title)") + " AS matches", "page_hits", "page_id")
one("p32_scam_phrases", "array_to_string(list_filter(" + lst(fr.SCAM_PHRASES) + ", lambda p: contains(lower(concat_ws(' ', title || "
    "CASE WHEN listing_id % 9 = 0 THEN ' pay to apply, wire transfer' ELSE '' END, summary)), p)), '|') AS hits")


def stale_page(x: str) -> str:
    return f"(length(trim({x})) < 80 OR regexp_matches(substr({x}, 1, 4000), {q(fr.STALE_PAGE)}))"


one("p33_page_looks_stale", stale_page("(CASE WHEN page_id % 6 = 0 THEN '<p>Applications closed</p>' || html ELSE html END)") + " AS stale", "page_hits", "page_id")


def article(u: str) -> str:
    p = path(u)
    return (f"((length({p}) > 80 AND length({p}) - length(replace({p}, '/', '')) >= 3) OR regexp_matches({p}, {q(fr.ARTICLE_PATH)}))")


def best_url(u: str) -> str:
    return f"CASE WHEN {article(u)} THEN regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/' ELSE {u} END"


_u = "(CASE WHEN page_id % 4 = 0 THEN 'https://' || host || '/blog/post-' || page_id ELSE url END)"
one("p34_article_urls", f"{article(_u)} AS article, {best_url(_u)} AS best_url", "page_hits", "page_id")
oracle("p35_chunk_text", """WITH s AS (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 800 THEN [0] ELSE generate_series(0, length(text) - 1, 700) END) AS st FROM documents)
SELECT doc_id, CAST(st // 700 AS BIGINT) AS idx, md5(CASE WHEN length(text) <= 800 THEN text ELSE substr(text, st + 1, 800) END) AS chunk_md5 FROM s""")
one("p36_matched_terms", "array_to_string(list_filter(" + lst(["Research", "Scholarship", "Doctoral position", "stipend", "prize", "monthly"])
    + f", lambda t: contains({LOW}, lower(t)))[1:4], '|') AS terms")


def degree(x: str) -> str:
    return ladder(f"replace(trim(lower({x})), '.', '')", fr.DEGREE_TOKENS.items())


one("p37_normalize_degree", f"{degree('degree_level')} AS level, {degree('research_interests[1]')} AS from_interest", "profiles", "user_id")
one("p38_search_text", "md5(substr(lower(title || ' ' || coalesce(summary, '')), 1, 8000)) AS search_md5")
oracle("s13_title_from_slug", f"""WITH s AS (SELECT page_id, list_last(string_split(trim({path('url')}, '/'), '/')) AS slug FROM pages),
w AS (SELECT page_id, slug, regexp_extract_all(trim(replace(slug, '-', ' ')), '(\\p{{L}}+|\\P{{L}}+)') AS parts FROM s)
SELECT page_id, CASE WHEN slug IN ('', 'fellowship', 'fellowships', 'scholarships') THEN ''
  ELSE array_to_string(list_transform(parts, lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), '') END AS title FROM w""")
