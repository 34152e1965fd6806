"""Oracles of the de-duplication and upsert queries."""

from __future__ import annotations

from fairlead.bindings import with_views
from fairlead.oracle.helpers import ladder
from fairlead.oracle.text import org_key
from fairlead.plans.registry import oracle
from fairlead.rules import fact_rules as fr

BATCH = """, ba AS (SELECT listing_id + 10000000 AS item_id, (source_id + listing_id % 2) % 20 AS source_id, listing_id AS pos, institution,
 CASE WHEN listing_id % 3 = 0 THEN title || 'x' ELSE title END AS title, CASE listing_id % 4 WHEN 0 THEN url_hash WHEN 1 THEN sha256('new' || (listing_id - listing_id % 8)) ELSE sha256('new' || listing_id) END AS url_hash FROM listings)"""


def dq(name: str, sql: str, views: str = "listings") -> None:
    oracle(name, with_views(views, sql))


def similar_sql(name: str, left: str, right: str, percent: float) -> str:
    """Table `name` (lt, rt, ratio) of titles t of two tables that share at least this percentage of characters in order,
    by the plain table of longest common subsequences, row after row, as far from its diagonal as such pairs get. Edit
    distance, which DuckDB counts in bytes, leaves out the rest beforehand."""
    room = f"floor({1 - percent / 100.0} * (length(a.t) + length(b.t)) + 1e-9)"
    return f"""{name}_p AS (SELECT a.t AS a, b.t AS b, CAST({room} AS INT) AS k FROM (SELECT DISTINCT t FROM {left}) a JOIN (SELECT DISTINCT t FROM {right}) b
  ON a.t <> b.t AND abs(length(a.t) - length(b.t)) <= {room} AND levenshtein(a.t, b.t) <= CASE WHEN strlen(a.t || b.t) = length(a.t || b.t) THEN 1 ELSE 4 END * {room} WHERE a.t <> '' AND b.t <> ''),
{name}_u AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, k FROM {name}_p),
{name}_l AS (WITH RECURSIVE dp AS (
  SELECT a, b, k, 0 AS i, unnest(range(0, CAST(least(k, length(b)) + 1 AS BIGINT))) AS j, 0 AS v FROM {name}_u
  UNION ALL SELECT a, b, k, i, j, max(w) OVER (PARTITION BY a, b ORDER BY j ROWS UNBOUNDED PRECEDING) AS v FROM (
    SELECT a, b, k, i + 1 AS i, unnest([j, j + 1]) AS j, unnest([v, v + CAST(substr(a, i + 1, 1) = substr(b, CAST(j + 1 AS BIGINT), 1) AS INT)]) AS w FROM dp WHERE i < length(a))
  WHERE j <= length(b) AND j BETWEEN i - k AND i + k QUALIFY row_number() OVER (PARTITION BY a, b, j ORDER BY w DESC) = 1)
  SELECT a, b, 200.0 * max(v) / (length(a) + length(b)) AS ratio FROM dp WHERE i = length(a) GROUP BY a, b),
{name} AS (SELECT p.a AS lt, p.b AS rt, ratio FROM {name}_p p JOIN {name}_l l ON l.a = least(p.a, p.b) AND l.b = greatest(p.a, p.b) WHERE ratio >= {percent}
  UNION ALL SELECT DISTINCT x.t, x.t, 100.0 FROM {left} x JOIN {right} y ON x.t = y.t WHERE x.t <> '')"""


def fuzzy_sql(batch: str) -> str:
    """Table `fuzzy` (item_id, fuzzy_id, fuzzy_source, ratio) of the rows of a table like `ba`."""
    return f"""rows_ AS (SELECT item_id, lower(title) AS t, CASE WHEN length(trim(coalesce(institution, ''))) >= 3 THEN lower(trim(institution)) ELSE '' END AS inst FROM {batch} WHERE length(coalesce(title, '')) >= 8),
pool AS (SELECT listing_id, source_id, last_seen_at, lower(coalesce(title, '')) AS t, lower(coalesce(institution, '') || chr(10) || coalesce(title, '')) AS body FROM listings WHERE duplicate_of IS NULL),
{similar_sql("old", "rows_", "pool", 92.0)},
fuzzy AS (SELECT r.item_id, p.listing_id AS fuzzy_id, p.source_id AS fuzzy_source, o.ratio FROM rows_ r JOIN old o ON o.lt = r.t JOIN pool p ON p.t = o.rt WHERE r.inst = '' OR contains(p.body, r.inst)
  QUALIFY row_number() OVER (PARTITION BY r.item_id ORDER BY o.ratio DESC, p.last_seen_at DESC NULLS LAST, p.listing_id) = 1)"""


def resolve_sql(batch: str, fuzzy: str) -> str:
    """Batch rows one by one in their order: the lists made and held carry which rows were created, and stored at all."""
    return f"""keyed AS (SELECT *, row_number() OVER (ORDER BY source_id, pos, item_id) AS n, lower(coalesce(title, '')) AS t, lower(coalesce(institution, '') || chr(10) || coalesce(title, '')) AS body,
  CASE WHEN length(trim(coalesce(institution, ''))) >= 3 THEN lower(trim(institution)) ELSE '' END AS inst FROM {batch}),
{similar_sql("new", "keyed", "keyed", 92.0)},
near AS (SELECT x.n, list({{'n': y.n, 'r': w.ratio, 's': y.source_id}} ORDER BY w.ratio DESC, y.n) AS near FROM keyed x JOIN new w ON w.lt = x.t JOIN keyed y ON y.t = w.rt AND y.n < x.n
  WHERE length(x.t) >= 8 AND (x.inst = '' OR contains(y.body, x.inst)) GROUP BY x.n),
same AS (SELECT x.n, list(y.n ORDER BY y.n) AS same FROM keyed x JOIN keyed y ON y.url_hash = x.url_hash AND y.n < x.n GROUP BY x.n),
steps AS (SELECT list({{'n': k.n, 's': k.source_id, 'e': l.listing_id, 'f': f.fuzzy_id, 'fs': f.fuzzy_source, 'fr': f.ratio, 'near': coalesce(near.near, []), 'same': coalesce(same.same, []),
    'made': CAST([] AS BIGINT[]), 'held': CAST([] AS BIGINT[]), 'told': CAST([] AS STRUCT(n BIGINT, a VARCHAR, o BIGINT)[])}} ORDER BY k.n) AS steps
  FROM keyed k LEFT JOIN listings l ON l.url_hash = k.url_hash LEFT JOIN {fuzzy} f ON f.item_id = k.item_id LEFT JOIN near USING (n) LEFT JOIN same USING (n)),
first_ AS (SELECT {{'n': CAST(0 AS BIGINT), 's': CAST(0 AS BIGINT), 'e': CAST(NULL AS BIGINT), 'f': CAST(NULL AS BIGINT), 'fs': CAST(NULL AS BIGINT), 'fr': CAST(NULL AS DOUBLE), 'near': CAST([] AS STRUCT(n BIGINT, r DOUBLE, s BIGINT)[]),
    'same': CAST([] AS BIGINT[]), 'made': CAST([] AS BIGINT[]), 'held': CAST([] AS BIGINT[]), 'told': CAST([] AS STRUCT(n BIGINT, a VARCHAR, o BIGINT)[])}} AS f0),
walked AS (SELECT list_reduce(list_prepend(f0, CAST(steps AS STRUCT(n BIGINT, s BIGINT, e BIGINT, f BIGINT, fs BIGINT, fr DOUBLE, near STRUCT(n BIGINT, r DOUBLE, s BIGINT)[], same BIGINT[], made BIGINT[], held BIGINT[], told STRUCT(n BIGINT, a VARCHAR, o BIGINT)[])[])),
  lambda x, y: list_transform([{{'hit': list_filter(y.same, lambda e: list_contains(x.held, e))[1], 'best': list_filter(y.near, lambda e: list_contains(x.made, e.n))[1]}}], lambda z:
    list_transform([CASE WHEN y.e IS NOT NULL THEN 'update' WHEN z.hit IS NOT NULL THEN 'update_new' WHEN z.best IS NOT NULL AND coalesce(y.fr, 0) <= z.best.r THEN CASE WHEN z.best.s <> y.s THEN 'shadow_new' ELSE 'update_new' END
      WHEN y.f IS NOT NULL THEN CASE WHEN y.fs <> y.s THEN 'shadow' ELSE 'update' END ELSE 'create' END], lambda a:
      {{'n': y.n, 's': y.s, 'e': y.e, 'f': y.f, 'fs': y.fs, 'fr': y.fr, 'near': y.near, 'same': y.same, 'made': CASE WHEN a = 'create' THEN list_append(x.made, y.n) ELSE x.made END,
        'held': CASE WHEN a IN ('create', 'shadow', 'shadow_new') THEN list_append(x.held, y.n) ELSE x.held END,
        'told': list_append(x.told, {{'n': y.n, 'a': a, 'o': CASE WHEN a = 'update' THEN coalesce(y.e, y.f) WHEN a = 'shadow' THEN y.f WHEN a IN ('update_new', 'shadow_new') THEN coalesce(z.hit, z.best.n) END}})}})[1])[1]).told AS told
  FROM steps, first_ WHERE len(steps) > 0),
told AS (SELECT k.item_id, w.u.a AS action, w.u.o AS ref, o.item_id AS other FROM (SELECT unnest(told) AS u FROM walked) w JOIN keyed k ON k.n = w.u.n LEFT JOIN keyed o ON o.n = w.u.o)"""


dq("d01_exact_match", BATCH + " SELECT item_id, l.listing_id AS exact_id FROM ba LEFT JOIN listings l ON l.url_hash = ba.url_hash")
dq("d02_prefilter", """, p AS (SELECT listing_id, lower(title) AS t, lower(title || ' extra words') AS o FROM listings)
SELECT listing_id, levenshtein(t, o) <= CAST(floor((length(t) + length(o)) * (1 - 92 / 100.0) + 1e-9) AS INT) AS may FROM p""")
dq("j09_similar_titles", f""", tt AS (SELECT lower(title) AS t FROM listings), {similar_sql("pairs", "tt", "tt", 92.0)} SELECT lt AS title, rt AS other, round(ratio, 4) AS ratio FROM pairs""")
dq("d02_fuzzy_title_match", f"{BATCH}, {fuzzy_sql('ba')} SELECT item_id, fuzzy_id, round(ratio, 4) AS ratio FROM fuzzy")
dq("d03_resolve_upsert", f"""{BATCH}, fresh AS (SELECT * FROM ba WHERE url_hash NOT IN (SELECT url_hash FROM listings)), {fuzzy_sql('fresh')}, {resolve_sql('ba', 'fuzzy')}
SELECT item_id, action, CASE WHEN action = 'update' THEN ref END AS target_id, CASE WHEN action = 'shadow' THEN ref END AS duplicate_of,
  CASE WHEN action = 'update_new' THEN other END AS first_item, CASE WHEN action = 'shadow_new' THEN other END AS shadow_of_item FROM told""")
dq("d03_new_batch", f"""{BATCH}, bn AS (SELECT * REPLACE (sha256('in batch ' || (pos - pos % 8)) AS url_hash) FROM ba), none AS (SELECT CAST(NULL AS BIGINT) AS item_id, CAST(NULL AS BIGINT) AS fuzzy_id, CAST(NULL AS BIGINT) AS fuzzy_source, CAST(NULL AS DOUBLE) AS ratio),
{resolve_sql('bn', 'none')}
SELECT item_id, action, CASE WHEN action = 'update_new' THEN other END AS first_item, CASE WHEN action = 'shadow_new' THEN other END AS shadow_of_item FROM told""")


def backlog_sql(limit: str, body: str) -> str:
    """Documents one by one: created ones are carried in a list, which the later ones look into."""
    return f""", raw AS (SELECT listing_id AS doc_id, CASE WHEN listing_id % 3 = 0 THEN url_hash ELSE sha256('r' || listing_id) END AS url_hash, summary, coalesce(summary, 'none') AS raw_content,
  CASE WHEN listing_id % 3 = 1 THEN title || '!' ELSE 'Unseen backlog title ' || md5(CAST(listing_id AS VARCHAR)) END AS title FROM listings WHERE listing_id % 2 <> 0 ORDER BY listing_id {limit}),
docs AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS n, lower(title) AS t, coalesce(summary, {body}) AS content FROM raw), lt AS (SELECT lower(title) AS t FROM listings),
{similar_sql("old", "docs", "lt", 90.0)}, {similar_sql("new", "docs", "docs", 90.0)},
near AS (SELECT n, list(m) AS near FROM (SELECT x.n, y.n AS m FROM docs x JOIN docs y ON y.n < x.n AND y.url_hash = x.url_hash
  UNION SELECT x.n, y.n FROM docs x JOIN new ON lt = x.t AND ratio > 90 JOIN docs y ON y.t = rt AND y.n < x.n) GROUP BY n),
steps AS (SELECT list({{'n': d.n, 'barred': d.url_hash IN (SELECT url_hash FROM listings) OR d.t IN (SELECT lt FROM old WHERE ratio > 90), 'near': coalesce(near, []), 'made': CAST([] AS BIGINT[])}} ORDER BY d.n) AS steps FROM docs d LEFT JOIN near USING (n)),
made AS (SELECT unnest(list_reduce(list_prepend({{'n': CAST(0 AS BIGINT), 'barred': true, 'near': CAST([] AS BIGINT[]), 'made': CAST([] AS BIGINT[])}}, CAST(steps AS STRUCT(n BIGINT, barred BOOLEAN, near BIGINT[], made BIGINT[])[])),
  lambda x, y: {{'n': y.n, 'barred': y.barred, 'near': y.near, 'made': CASE WHEN y.barred OR list_has_any(x.made, y.near) THEN x.made ELSE list_append(x.made, y.n) END}}).made) AS n FROM steps)
SELECT doc_id, CASE WHEN n IN (SELECT n FROM made) THEN 'create' ELSE 'skip' END AS action, {ladder("lower(title || ' ' || coalesce(content, ''))", fr.TYPE_KEYWORDS.items(), "'other'")} AS opportunity_type FROM docs"""


dq("d06_normalize_backlog", backlog_sql("", "raw_content"))
dq("d06_one_call", backlog_sql("LIMIT 100", "substr(raw_content, 1, 2000)"))
dq("d04_apply_updates", """, u AS (SELECT *, listing_id % 3 <> 2 AS hit, CASE WHEN listing_id % 2 = 0 THEN deadline + INTERVAL 5 DAY END AS nd,
 CASE WHEN listing_id % 4 = 0 THEN coalesce(summary, '') || ' longer' ELSE 'short' END AS ns, CASE WHEN listing_id % 5 = 0 THEN content_hash ELSE 'changed' END AS nh FROM listings),
f AS (SELECT *, hit AND nd IS NOT NULL AS moved, hit AND length(ns) > length(coalesce(summary, '')) AS longer, hit AND nh <> content_hash AS changed, listing_id % 25 + 1 AS n0 FROM u)
SELECT listing_id, strftime(CASE WHEN moved THEN nd ELSE deadline END, '%Y-%m-%d') AS deadline, CAST(length(CASE WHEN longer THEN ns ELSE summary END) AS BIGINT) AS summary_length,
 CASE WHEN hit THEN nh ELSE content_hash END AS content_hash, CASE WHEN hit AND listing_id % 6 = 0 THEN 'full' ELSE funding_type END AS funding_type,
 array_to_string(CASE WHEN hit AND listing_id % 7 = 0 THEN ['PhD'] ELSE degree_levels END, '|') AS degrees, CASE WHEN hit THEN 'grant' ELSE opportunity_type END AS opportunity_type,
 CAST(CASE WHEN moved THEN least(20, n0 + 1) ELSE n0 END AS BIGINT) AS changes, CAST(CASE WHEN moved AND n0 + 1 > 20 THEN n0 + 2 - 20 ELSE 1 END AS VARCHAR) AS oldest,
 CASE WHEN hit AND listing_id % 9 = 0 THEN 'admit' ELSE 'old' END AS gate, CAST(CASE WHEN hit AND listing_id % 9 = 0 THEN 3 ELSE 2 END AS BIGINT) AS meta_size, moved OR longer OR changed AS updated FROM f""")
dq("d05_record_also_seen", """, s AS (SELECT listing_id, source_id, listing_id % 20 AS src, CASE WHEN listing_id % 12 = 0 THEN [] ELSE list_transform(generate_series(1, listing_id % 12), lambda k: 'src' || k) END AS seen FROM listings),
g AS (SELECT *, CASE WHEN list_contains(seen, 'src' || src) THEN seen ELSE list_append(seen, 'src' || src) END AS grown FROM s)
SELECT listing_id, array_to_string(CASE WHEN source_id = src THEN seen ELSE grown[greatest(1, len(grown) - 9):] END, '|') AS seen FROM g""")
dq("d07_merge_snapshot", """, c AS (SELECT CASE WHEN listing_id % 2 = 0 THEN listing_id ELSE listing_id + 10000000 END AS listing_id, title || ' v2' AS title, source_id FROM listings WHERE listing_id % 3 = 0)
SELECT coalesce(c.listing_id, l.listing_id) AS listing_id, CASE WHEN c.listing_id IS NOT NULL THEN c.title ELSE l.title END AS title, coalesce(c.source_id, l.source_id) AS source_id
FROM listings l FULL OUTER JOIN c ON c.listing_id = l.listing_id""")
_rows = f"""SELECT {org_key('org')} AS org_key, regexp_replace(lower(host), '^www\\.', '') AS canonical_domain, CASE WHEN (page_id + {{o}}) % 4 <> 0 THEN url END AS canonical_url,
 ((page_id + {{o}}) % 10) / 10.0::DOUBLE AS confidence, page_id * 60 + {{o}} AS v, {{o}} AS age FROM page_hits"""
dq("d08_org_domain_upsert", f""", a AS ({_rows.replace('{o}', '0')} UNION ALL SELECT * FROM ({_rows.replace('{o}', '1')}) WHERE org_key < 'institute 3')
SELECT org_key, arg_max(canonical_domain, age * 1e12 + v) AS canonical_domain, arg_max(canonical_url, age * 1e12 + v) FILTER (canonical_url IS NOT NULL) AS canonical_url,
 arg_max(confidence, age * 1e12 + v) AS confidence FROM a GROUP BY org_key""", "page_hits")
dq("d08_domain_legitimacy_upsert", f""", h AS (SELECT regexp_replace(lower(host), '^www\\.', '') AS domain, min(page_id) AS k FROM page_hits GROUP BY 1),
x AS (SELECT domain, k, k % 3 <> 0 AS cached, k % 5 <> 0 AS fresh FROM h), y AS (SELECT *, cached AND (k % 180 < 90 OR NOT fresh) AS kept FROM x WHERE cached OR fresh)
SELECT domain, CASE WHEN kept THEN (k % 10) / 10.0::DOUBLE ELSE 0.75::DOUBLE END AS trust_score,
 coalesce(CASE WHEN NOT kept AND k % 4 = 0 THEN '2020-01-01' END, CASE WHEN cached AND k % 2 = 0 THEN '2015-01-01' END) AS registered, kept FROM y""", "page_hits")
dq("s15_append_raw_documents", """, r AS (SELECT listing_id AS doc_id, CASE WHEN listing_id % 3 = 0 THEN url_hash ELSE sha256('r' || listing_id) END AS url_hash, content_hash FROM listings)
SELECT DISTINCT url_hash, content_hash FROM r WHERE (url_hash, content_hash) NOT IN (SELECT (url_hash, content_hash) FROM r WHERE doc_id % 5 = 0)""")
dq("p02_changed_documents", "SELECT content_hash, count(*) AS copies, min(listing_id) AS first_id FROM listings GROUP BY 1 HAVING count(*) > 1")
