"""Oracle of the gate: relational term matching instead of array functions."""

from __future__ import annotations

from fairlead.bindings import with_views
from fairlead.functions.text import normalize_py
from fairlead.operators.synonyms import expand_list
from fairlead.oracle.helpers import norm, pat, q
from fairlead.plans.gate import TERMS
from fairlead.plans.registry import oracle
from fairlead.rules import gate_rules as gr


def _lexicon(name: str, terms, labels=None) -> list[str]:
    rows, seen = [], set()
    for i, t in enumerate(terms):
        key = normalize_py(t)
        if not key or key in seen:
            continue
        seen.add(key)
        rows.append(f"({q(name)}, {i}, {q(t)}, {q(key.split(' ')[0])}, {q(pat(t))})")
    return rows


_types = [t for v in gr.TYPE_LEXICON.values() for t in v]
_rows = (
    _lexicon("opportunity_type", _types + list(TERMS.extra_type_terms))
    + _lexicon("funding", gr.FUNDING_LEXICON)
    + _lexicon("application", gr.APPLICATION_LEXICON)
    + _lexicon("discipline", expand_list(TERMS.disciplines, gr.SYNONYMS))
    + _lexicon("degree", expand_list(TERMS.degrees, gr.SYNONYMS))
    + _lexicon("region", expand_list(TERMS.regions, gr.SYNONYMS))
    + _lexicon("global", gr.GLOBAL_MARKERS)
    + _lexicon("hard", [*gr.HARD_NEGATIVE, *TERMS.hard_drop])
    + _lexicon("soft", gr.SOFT_NEGATIVE)
)
_label_rows = [f"({i}, {q(k)}, {q(normalize_py(t).split(' ')[0])}, {q(pat(t))})"
               for i, (k, v) in enumerate(gr.TYPE_LEXICON.items()) for t in v]


def _first_match(text: str, pats) -> str:
    return "coalesce(" + ", ".join(
        f"CASE WHEN regexp_matches({text}, {q('(?i)' + p)}) THEN substr(trim(regexp_extract({text}, {q('(?i)' + p)})), 1, 60) END" for p in pats) + ")"


def single(t: str) -> str:
    veto = " OR ".join(f"regexp_matches({t}, {q(p)})" for p in gr.ROUNDUP_VETOES)
    hint = " OR ".join(f"regexp_matches({t}, {q('(?i)' + p)})" for p in gr.SINGLE_TITLE_HINTS)
    return f"(NOT (regexp_matches({t}, {q(gr.ROUNDUP_PLURAL)}) AND ({veto})) AND ({hint}))"


def gate_sql(items: str) -> str:
    """CTEs ending in ``gate``; items: (listing_id, source_id, pos, url, title, summary, content, detail, regions)."""
    return f"""
, items AS ({items}),
nf AS (SELECT *, {norm('title')} AS n_title, {norm("translate(url, '/-', '  ')")} AS n_url, {norm('summary')} AS n_summary,
  {norm('content')} AS n_content, length(coalesce(title, '')) + length(coalesce(summary, '')) + length(content) AS text_length FROM items),
nf2 AS (SELECT *, trim(n_title || ' ' || n_summary) AS headline,
  array_to_string(list_filter([n_title, n_summary, n_content, n_url], lambda x: x <> ''), ' ') AS blob,
  array_to_string(list_filter([title, summary, content], lambda x: x IS NOT NULL AND x <> ''), ' ') AS raw_blob, {single('n_title')} AS single FROM nf),
terms(lex, i, term, word, pat) AS (VALUES {', '.join(_rows)}),
labels(i, label, word, pat) AS (VALUES {', '.join(_label_rows)}),
fld AS (SELECT listing_id, 0 AS pri, 'title' AS f, 1.0::DOUBLE AS conf, n_title AS txt FROM nf2
  UNION ALL SELECT listing_id, 1, 'url', 0.9, n_url FROM nf2 UNION ALL SELECT listing_id, 2, 'summary', 0.85, n_summary FROM nf2
  UNION ALL SELECT listing_id, 3, 'content', 0.75, n_content FROM nf2),
hits AS (SELECT listing_id, pri, f, conf, lex, i, term FROM fld JOIN terms ON contains(txt, word) AND regexp_matches(txt, pat)
  WHERE lex NOT IN ('global', 'hard', 'soft') QUALIFY row_number() OVER (PARTITION BY listing_id, lex, pri ORDER BY i) <= 8),
firsts AS (SELECT listing_id, lex, term, min(pri * 1000 + i) AS ord, max(conf) AS conf FROM hits GROUP BY ALL),
scan AS (SELECT listing_id, lex, least(1.0, max(conf) + 0.05 * least(count(*) - 1, 2)) AS strength, list(term ORDER BY ord) AS ev,
  min(ord) // 1000 AS pri FROM firsts GROUP BY ALL),
am0 AS (SELECT listing_id, regexp_extract_all(raw_blob, {q(gr.AMOUNT_PATTERN)}) AS found FROM nf2),
am1 AS (SELECT listing_id, trim(unnest(found)) AS v, generate_subscripts(found, 1) AS i FROM am0),
am2 AS (SELECT listing_id, v, min(i) AS i FROM am1 GROUP BY listing_id, v QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY min(i)) <= 3),
am AS (SELECT listing_id, list(v ORDER BY i) AS amounts FROM am2 GROUP BY listing_id),
regt AS (SELECT listing_id, {norm("array_to_string(regions, ' ')")} AS txt FROM nf2),
reg AS (SELECT listing_id, list(term ORDER BY i) AS ev FROM (SELECT listing_id, i, term FROM regt JOIN terms ON lex = 'region' AND contains(txt, word)
  AND regexp_matches(txt, pat) QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY i) <= 8) GROUP BY ALL),
glo AS (SELECT listing_id, list(term ORDER BY i) AS ev FROM (SELECT listing_id, i, term FROM nf2 JOIN terms ON lex = 'global' AND contains(blob, word)
  AND regexp_matches(blob, pat) QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY i) <= 2) GROUP BY ALL),
neg AS (SELECT listing_id, lex, list(term ORDER BY i) AS ev, max(in_title) AS in_title FROM (SELECT listing_id, lex, i, term,
  CAST(regexp_matches(n_title, pat) AS INT) AS in_title FROM nf2 JOIN terms ON lex IN ('hard', 'soft') AND contains(headline, word)
  AND regexp_matches(headline, pat) QUALIFY row_number() OVER (PARTITION BY listing_id, lex ORDER BY i) <= 8) GROUP BY ALL),
lab AS (SELECT listing_id, arg_min(label, pri * 1000 + i) AS type_label FROM fld JOIN labels ON contains(txt, word) AND regexp_matches(txt, pat) GROUP BY listing_id),
ed AS (SELECT listing_id, {_first_match('n_title', gr.EDITORIAL_TITLE_PATTERNS)} AS et, {_first_match('headline', gr.EDITORIAL_TITLE_PATTERNS)} AS eh,
  {_first_match("replace(n_url, ' ', '/')", gr.EDITORIAL_URL_PATTERNS)} AS eu,
  contains(lower(url), '?p=') AND (n_title IN ('', 'test page', 'sample test') OR len(string_split(n_title, ' ')) <= 3) AS draft FROM nf2),
wide AS (SELECT n.*, lab.type_label, t.strength AS ty_s, t.ev AS ty_e, t.pri AS ty_p, fu.strength AS fu_s0, fu.ev AS fu_e0, fu.pri AS fu_p0, am.amounts,
  ap.strength AS ap_s, ap.ev AS ap_e, ap.pri AS ap_p, di.strength AS di_s, di.ev AS di_e, di.pri AS di_p, de.strength AS de_s, de.ev AS de_e, de.pri AS de_p,
  re.strength AS re_s0, re.ev AS re_e0, re.pri AS re_p0, reg.ev AS reg_e, glo.ev AS glo_e, h.ev AS hard_e, h.in_title AS hard_t, so.ev AS soft_e, so.in_title AS soft_t,
  CASE WHEN NOT single AND eh IS NOT NULL THEN eh WHEN NOT single AND eu IS NOT NULL THEN eu WHEN draft THEN 'wordpress draft url' END AS ed_e,
  CASE WHEN NOT single AND eh IS NOT NULL THEN CASE WHEN et IS NOT NULL THEN 'title' ELSE 'summary' END WHEN NOT single AND eu IS NOT NULL THEN 'url' WHEN draft THEN 'url' END AS ed_f
 FROM nf2 n LEFT JOIN lab USING (listing_id) LEFT JOIN am USING (listing_id) LEFT JOIN ed USING (listing_id) LEFT JOIN reg USING (listing_id) LEFT JOIN glo USING (listing_id)
 LEFT JOIN scan t ON t.listing_id = n.listing_id AND t.lex = 'opportunity_type' LEFT JOIN scan fu ON fu.listing_id = n.listing_id AND fu.lex = 'funding'
 LEFT JOIN scan ap ON ap.listing_id = n.listing_id AND ap.lex = 'application' LEFT JOIN scan di ON di.listing_id = n.listing_id AND di.lex = 'discipline'
 LEFT JOIN scan de ON de.listing_id = n.listing_id AND de.lex = 'degree' LEFT JOIN scan re ON re.listing_id = n.listing_id AND re.lex = 'region'
 LEFT JOIN neg h ON h.listing_id = n.listing_id AND h.lex = 'hard' LEFT JOIN neg so ON so.listing_id = n.listing_id AND so.lex = 'soft'),
sig AS (SELECT *, CASE WHEN amounts IS NOT NULL THEN 1.0 ELSE fu_s0 END AS fu_s,
  CASE WHEN amounts IS NOT NULL THEN list_concat(amounts, list_filter(coalesce(fu_e0, []), lambda e: NOT list_contains(amounts, e))) ELSE fu_e0 END AS fu_e,
  CASE WHEN amounts IS NOT NULL THEN coalesce(fu_p0, 0) ELSE fu_p0 END AS fu_p,
  CASE WHEN re_s0 IS NOT NULL THEN re_s0 WHEN reg_e IS NOT NULL THEN 0.8 WHEN glo_e IS NOT NULL THEN 0.85 END AS re_s,
  coalesce(re_e0, reg_e, glo_e) AS re_e,
  CASE WHEN re_s0 IS NOT NULL THEN ['title','url','summary','content'][re_p0 + 1] WHEN reg_e IS NOT NULL THEN 'registry' WHEN glo_e IS NOT NULL THEN 'text' END AS re_f,
  CASE WHEN hard_e IS NOT NULL THEN 1.0 WHEN soft_e IS NOT NULL THEN CASE WHEN soft_t = 1 THEN 0.6 ELSE 0.2 END END AS ne_s, coalesce(hard_e, soft_e) AS ne_e,
  CASE WHEN hard_e IS NOT NULL THEN CASE WHEN hard_t = 1 THEN 'title' ELSE 'summary' END WHEN soft_e IS NOT NULL THEN CASE WHEN soft_t = 1 THEN 'title' ELSE 'summary' END END AS ne_f,
  CASE WHEN detail THEN 1.0 WHEN text_length <= 120 THEN 0.15 WHEN text_length >= 1200 THEN 1.0 ELSE 0.15 + 0.85 * ((text_length - 120) / 1080.0) END AS suff,
  len(regexp_extract_all(coalesce(title, ''), {q(gr.AMOUNT_PATTERN)})) > 0 AS title_amount FROM wide),
sc AS (SELECT *, 1 - (1 - 0.95 * coalesce(ty_s, 0)::DOUBLE) * (1 - 0.7 * coalesce(fu_s, 0)::DOUBLE) * (1 - 0.5 * coalesce(ap_s, 0)::DOUBLE) AS corpus,
  1 - (1 - 0.6 * coalesce(di_s, 0)::DOUBLE) * (1 - 0.5 * coalesce(re_s, 0)::DOUBLE) * (1 - 0.4 * coalesce(de_s, 0)::DOUBLE) AS fit FROM sig),
sc2 AS (SELECT *, CASE WHEN ne_s IS NOT NULL THEN greatest(0, 0.7 * corpus + 0.3 * fit - 0.5 * ne_s) ELSE 0.7 * corpus + 0.3 * fit END AS score FROM sc),
gate AS (SELECT *, CASE WHEN ed_e IS NOT NULL OR ne_s >= 0.8 OR (ty_s IS NULL AND fu_s IS NULL AND NOT single) THEN 'reject'
   WHEN score >= 0.55 THEN CASE WHEN suff >= 0.5 OR ap_s IS NOT NULL OR title_amount OR (single AND ty_s IS NOT NULL) THEN 'admit' ELSE 'investigate' END
   WHEN ne_s IS NOT NULL AND score <= 0.22 THEN 'reject' WHEN suff >= 0.5 AND score <= 0.22 THEN 'reject'
   WHEN ap_s IS NULL AND suff < 0.5 THEN 'investigate' WHEN score > 0.22 AND suff < 0.5 AND single THEN 'investigate' ELSE 'reject' END AS verdict,
  CASE WHEN ed_e IS NOT NULL THEN 'editorial:' || ed_e WHEN ne_s >= 0.8 THEN 'hard_negative:' || ne_e[1]
   WHEN ty_s IS NULL AND fu_s IS NULL AND NOT single THEN 'no_opportunity_signal'
   WHEN score >= 0.55 THEN CASE WHEN suff >= 0.5 OR ap_s IS NOT NULL OR title_amount OR (single AND ty_s IS NOT NULL) THEN 'score_above_admit' ELSE 'needs_detail_confirmation' END
   WHEN ne_s IS NOT NULL AND score <= 0.22 THEN 'boilerplate:' || ne_e[1] WHEN suff >= 0.5 AND score <= 0.22 THEN 'low_score_with_full_text'
   WHEN ap_s IS NULL AND suff < 0.5 THEN 'needs_detail_for_application' WHEN score > 0.22 AND suff < 0.5 AND single THEN 'ambiguous_listing_title'
   ELSE 'below_admit_threshold' END AS reason FROM sc2)"""


ITEMS = """SELECT l.listing_id, l.source_id, l.listing_id AS pos, l.url, CASE WHEN l.title = '' THEN regexp_extract(l.url, '([^/]*)/[?]', 1) ELSE l.title END AS title,
  l.summary, '' AS content, false AS detail, s.regions FROM listings l LEFT JOIN sources s ON s.id = l.source_id"""
FIELDS = "['title','url','summary','content']"


def gq(name: str, select: str, extra: str = "") -> None:
    oracle(name, with_views("listings sources", gate_sql(ITEMS) + extra + "\n" + select))


def sigcols(p: str, found: str) -> str:
    return (f"{p}_s IS NOT NULL AS matched, round(CAST(coalesce({p}_s, 0) AS DOUBLE), 4) AS strength, coalesce(array_to_string({p}_e, '|'), '') AS evidence, "
            f"{found} AS found_in")


gq("g01_candidates", """SELECT listing_id, md5(n_title) AS title_md5, n_url, md5(n_summary) AS summary_md5, md5(blob) AS blob_md5,
  CAST(text_length AS BIGINT) AS text_length FROM nf2""")
gq("g02_scan_signal", f"SELECT listing_id, fu_s0 IS NOT NULL AS matched, round(CAST(coalesce(fu_s0, 0) AS DOUBLE), 4) AS strength, "
   f"coalesce(array_to_string(fu_e0, '|'), '') AS evidence, {FIELDS}[fu_p0 + 1] AS found_in FROM wide")
gq("g03_type_signal", f"SELECT listing_id, type_label, {sigcols('ty', FIELDS + '[ty_p + 1]')} FROM gate")
for _n, _p in (("g04_funding_signal", "fu"), ("g05_application_signal", "ap"), ("g06_discipline_signal", "di"), ("g06_degree_signal", "de")):
    gq(_n, f"SELECT listing_id, {sigcols(_p, FIELDS + f'[{_p}_p + 1]')} FROM gate")
gq("g07_region_signal", f"SELECT listing_id, {sigcols('re', 're_f')} FROM gate")
gq("g08_negative_signal", f"SELECT listing_id, {sigcols('ne', 'ne_f')} FROM gate")
gq("g09_editorial_signal", "SELECT listing_id, ed_e IS NOT NULL AS matched, CASE WHEN ed_e IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS strength, "
   "coalesce(ed_e, '') AS evidence, ed_f AS found_in FROM gate")
oracle("g10_looks_like_single", with_views("listings", f", n AS (SELECT listing_id, {norm('title')} AS t FROM listings) SELECT listing_id, {single('t')} AS single FROM n"))
gq("g11_sufficiency", """SELECT listing_id, round(CAST(CASE WHEN listing_id % 10 = 0 THEN 1.0 WHEN text_length <= 120 THEN 0.15 WHEN text_length >= 1200 THEN 1.0
  ELSE 0.15 + 0.85 * ((text_length - 120) / 1080.0) END AS DOUBLE), 4) AS sufficiency FROM nf2""")
gq("g12_gate_score", "SELECT listing_id, round(corpus, 4) AS corpus_score, round(fit, 4) AS fit_score, round(score, 4) AS score FROM gate")
gq("g13_gate_verdict", "SELECT listing_id, verdict, reason FROM gate")
_EV = "list_concat(" + ", ".join(
    f"list_transform(coalesce({p}_e, [])[1:2], lambda t: '{n}:' || t)" for n, p in
    (("opportunity_type", "ty"), ("funding", "fu"), ("discipline", "di"), ("region", "re"), ("degree", "de"), ("application", "ap"))) + ")"
_EV = _EV.replace("list_concat(", "flatten([", 1)[:-1] + "])"
gq("g14_explain", f"""SELECT listing_id, array_to_string({_EV}[1:6], '|') AS evidence,
  array_to_string(list_filter([CASE WHEN ty_s IS NOT NULL THEN 'opportunity_type' END, CASE WHEN fu_s IS NOT NULL THEN 'funding' END, CASE WHEN ap_s IS NOT NULL THEN 'application' END,
    CASE WHEN di_s IS NOT NULL THEN 'discipline' END, CASE WHEN de_s IS NOT NULL THEN 'degree' END, CASE WHEN re_s IS NOT NULL THEN 'region' END], lambda x: x IS NOT NULL), '|') AS matched,
  verdict || ' score=' || printf('%.2f', round_even(score, 2)) || ' | ' || reason || ' | ' || CASE WHEN len({_EV}) = 0 THEN 'no positive signals'
    ELSE 'evidence=' || array_to_string({_EV}[1:4], ', ') END AS explanation FROM gate""")
ALL = "9223372036854775807"
_LANES = """
, head AS (SELECT * FROM gate QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY pos) <= {items}),
lanes AS (SELECT *, CASE verdict WHEN 'admit' THEN 'admitted' WHEN 'reject' THEN 'rejected' ELSE CASE WHEN
  row_number() OVER (PARTITION BY source_id, verdict ORDER BY pos) <= {budget} THEN 'investigate' ELSE 'deferred' END END AS lane FROM head)"""
gq("g15_triage", "SELECT source_id, listing_id, verdict, lane FROM lanes", _LANES.replace("{budget}", "5").replace("{items}", "40"))
gq("g15_triage_all", "SELECT source_id, listing_id, verdict, lane FROM lanes", _LANES.replace("{budget}", "5").replace("{items}", ALL))

_second = """SELECT l.listing_id, l.source_id, l.pos, l.url, l.title, l.summary, d.text || CASE WHEN d.doc_id % 3 = 0 THEN
  ' Fellowship. Apply now, closing date 1 May.' ELSE '' END AS content, true AS detail, l.regions FROM lanes l JOIN documents d ON d.doc_id = l.listing_id
  WHERE lane IN ('admitted', 'investigate')"""
_pass1 = gate_sql(ITEMS) + _LANES.replace("{budget}", "40").replace("{items}", ALL)
_inner = with_views("listings sources", _pass1 + "\n" + _second)
oracle("g16_rescore_with_detail", "WITH seed AS (SELECT 1) " + gate_sql(f"SELECT * FROM ({_inner})") +
       "\nSELECT listing_id, verdict, reason, round(score, 4) AS score, CASE WHEN verdict = 'admit' THEN 'admitted' ELSE 'rejected_after_detail' END AS lane FROM gate")
gq("g17_pending_queue", """SELECT source_id, url FROM capped WHERE listing_id % 7 <> 0""", """
, pool AS (SELECT source_id, url, pos, listing_id, CASE WHEN listing_id % 3 = 0 THEN 0 ELSE 1 END AS age FROM gate WHERE listing_id % 3 = 0 OR verdict = 'investigate'),
capped AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY age, pos) <= 20)""")
gq("g20_verdict_report", """SELECT source_id, count(*) AS found, count(*) FILTER (verdict = 'admit') AS admit, count(*) FILTER (verdict = 'investigate') AS investigate,
  count(*) FILTER (verdict = 'reject') AS reject FROM gate GROUP BY ROLLUP(source_id)""")
gq("g21_low_fit_admitted", "SELECT listing_id, fit < 0.15 AND corpus >= 0.55 AS low_fit FROM gate")
gq("u05_noisy_or_grouped", "SELECT source_id, round(1 - exp(sum(ln(1 - least(score, 0.999)))), 4) AS any_hit FROM gate GROUP BY source_id")
