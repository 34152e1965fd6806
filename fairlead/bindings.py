"""Business views over the given tables.

Each view is one SQL text with the few words that differ between engines taken from a dialect object,
so the very same derivation feeds the Spark operators and stands as a WITH prefix of the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fairlead.session import pin_utc

AS_OF = "2026-06-30 00:00:00"

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


# Tables whose rows carry whole texts, with a key to spread them by.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


class SparkDialect:
    @staticmethod
    def sha(expr: str) -> str:
        return f"sha2({expr}, 256)"

    @staticmethod
    def row(*cols: str) -> str:
        return f"struct({', '.join(cols)})"

    @staticmethod
    def empty() -> str:
        return "CAST(array() AS ARRAY<STRING>)"

    @staticmethod
    def words(csv: str) -> str:
        return "array(" + ", ".join(f"'{w}'" for w in csv.split(",")) + ")"

    @staticmethod
    def host(url: str) -> str:
        return f"regexp_extract({url}, '^https?://([^/?#]*)', 1)"

    ref = "{{{}}}".format


class DuckDialect:
    @staticmethod
    def sha(expr: str) -> str:
        return f"sha256({expr})"

    @staticmethod
    def row(*cols: str) -> str:
        return f"row({', '.join(cols)})"

    @staticmethod
    def empty() -> str:
        return "CAST([] AS VARCHAR[])"

    @staticmethod
    def words(csv: str) -> str:
        return "[" + ", ".join(f"'{w}'" for w in csv.split(",")) + "]"

    @staticmethod
    def host(url: str) -> str:
        return f"regexp_extract({url}, '^https?://([^/?#]*)', 1)"

    ref = "{}".format


def _listings(d) -> str:
    return f"""
SELECT doc_id AS listing_id,
       CAST(substr(source, 4) AS BIGINT) AS source_id,
       substr(trim(concat(CASE doc_id % 12
           WHEN 0 THEN 'Alpha Scholarship 2026' WHEN 1 THEN 'Fully funded Beta Fellowship 2026'
           WHEN 2 THEN 'Research grant up to $10,000' WHEN 3 THEN 'Gamma Internship'
           WHEN 4 THEN 'Top 10 scholarships' WHEN 5 THEN 'Privacy policy'
           WHEN 6 THEN 'Delta Prize winners announced' WHEN 7 THEN 'PhD only doctoral position'
           WHEN 8 THEN 'Summer school workshop' WHEN 9 THEN ''
           WHEN 10 THEN 'Epsilon Award' ELSE 'Masters programme in Germany' END, ' ',
           trim(split_part(replace(text, chr(10), '.'), '.', 1)))), 1, 500) AS title,
       CASE WHEN doc_id % 10 = 9 THEN NULL ELSE concat(text, CASE doc_id % 4
           WHEN 0 THEN ' Application deadline: 15 Oct 2026. Eligibility: international students.'
           WHEN 1 THEN ' Apply now. Covers tuition and a monthly stipend.'
           WHEN 2 THEN ' Self-funded. Rolling.' ELSE '' END) END AS summary,
       CASE WHEN doc_id % 7 = 0 THEN NULL ELSE concat('Institute ', CAST(doc_id % 40 AS STRING)) END AS institution,
       CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(DATE '2026-06-30' + CAST((doc_id * 37) % 120 - 30 AS INT)
           AS TIMESTAMP) END AS deadline,
       CASE doc_id % 4 WHEN 0 THEN {d.words('technology,research')} WHEN 1 THEN {d.words('climate')}
           WHEN 2 THEN {d.words('health,policy,education')} ELSE {d.words('arts')} END AS tags,
       CASE doc_id % 6 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' WHEN 2 THEN 'self' WHEN 3 THEN 'stipend'
           ELSE NULL END AS funding_type,
       CASE doc_id % 9 WHEN 0 THEN 'primary_confirmed' WHEN 1 THEN 'aggregator_only' WHEN 2 THEN 'aggregator_only'
           WHEN 3 THEN 'stale' WHEN 8 THEN NULL ELSE 'unverified' END AS verification_status,
       CASE doc_id % 12 WHEN 0 THEN 'scholarship' WHEN 1 THEN 'fellowship' WHEN 2 THEN 'grant' WHEN 3 THEN 'internship'
           WHEN 7 THEN 'phd' WHEN 8 THEN 'workshop' WHEN 11 THEN 'graduate_program' ELSE 'other' END AS opportunity_type,
       CASE WHEN doc_id % 16 = 0 THEN {d.words('MSc')} WHEN doc_id % 16 = 5 THEN {d.words('Undergraduate,PhD')}
           ELSE {d.empty()} END AS degree_levels,
       CASE WHEN doc_id % 11 = 0 THEN {d.words('Kenya')} ELSE {d.empty()} END AS countries,
       CASE WHEN doc_id % 15 = 3 THEN {d.words('Transcript,Portfolio')} ELSE {d.empty()} END AS requirements,
       CAST(DATE '2026-06-01' + CAST(doc_id % 40 AS INT) AS TIMESTAMP) AS created_at,
       CASE WHEN doc_id % 23 = 0 THEN NULL ELSE CAST(DATE '2026-06-01' + CAST((doc_id * 7) % 30 AS INT)
           AS TIMESTAMP) END AS last_seen_at,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(DATE '2026-05-15' + CAST((doc_id * 11) % 45 AS INT)
           AS TIMESTAMP) END AS verified_at,
       CASE doc_id % 5 WHEN 0 THEN NULL WHEN 4 THEN 'reject' WHEN 3 THEN 'investigate' ELSE 'admit' END AS gate_verdict,
       CASE WHEN doc_id % 13 = 12 THEN doc_id - 12 ELSE NULL END AS duplicate_of,
       concat('https://www.Site', substr(source, 4), '.org/listing/', CAST(doc_id AS STRING), '/?utm_source=x') AS url,
       CASE WHEN doc_id % 50 = 49 THEN concat('demo-', CAST(doc_id AS STRING))
            ELSE {d.sha("concat('https://site', substr(source, 4), '.org/listing/', CAST(doc_id AS STRING))")}
            END AS url_hash,
       {d.sha('text')} AS content_hash
FROM {d.ref('documents')}"""


def _sources(d) -> str:
    return f"""
SELECT source_id AS id, concat('src', CAST(source_id AS STRING)) AS registry_id,
       concat('Source ', CAST(source_id AS STRING)) AS name,
       concat('https://www.site', CAST(source_id AS STRING), '.org/feed/') AS url,
       CASE source_id % 4 WHEN 3 THEN 'api' WHEN 2 THEN 'html' ELSE 'rss' END AS source_type,
       CASE source_id % 3 WHEN 0 THEN {d.words('global')} WHEN 1 THEN {d.words('us')} ELSE {d.words('Germany,Europe')} END AS regions,
       CASE source_id % 2 WHEN 0 THEN {d.words('scholarship,international')} ELSE {d.words('fellowship,phd')} END AS tags,
       CASE source_id % 3 WHEN 0 THEN {d.words('BSc,MSc,PhD,Mixed')} WHEN 1 THEN {d.words('PhD,MSc')}
            ELSE {d.empty()} END AS degree_levels,
       CASE source_id % 4 WHEN 0 THEN 'high' ELSE 'medium' END AS funding_signal,
       concat('Chip ', CAST(source_id AS STRING)) AS chip_label,
       CAST(0.5 + source_id / 100.0 AS DOUBLE) AS authority,
       source_id % 5 <> 4 AS is_active,
       CASE WHEN source_id % 4 = 1 THEN NULL ELSE CAST(DATE '2026-06-25' + CAST(source_id % 10 AS INT) AS TIMESTAMP) END AS next_fetch_at,
       CASE WHEN source_id % 6 = 5 THEN 'timeout' ELSE NULL END AS last_error,
       CAST(360 AS BIGINT) AS fetch_interval_minutes
FROM (SELECT CAST(substr(source, 4) AS BIGINT) AS source_id FROM {d.ref('documents')} GROUP BY source) s"""


def _profiles(d) -> str:
    return f"""
SELECT c.c_custkey AS user_id, c.c_name AS name, n.n_name AS nationality,
       CASE r.r_name WHEN 'AFRICA' THEN {d.words('Africa')} WHEN 'AMERICA' THEN {d.words('North America,Canada')}
            WHEN 'ASIA' THEN {d.words('Asia')} WHEN 'EUROPE' THEN {d.words('Europe,Germany')}
            ELSE {d.words('Middle East')} END AS target_regions,
       CASE c.c_custkey % 3 WHEN 0 THEN 'MSc' WHEN 1 THEN 'PhD' ELSE 'BSc' END AS degree_level,
       CASE c.c_mktsegment WHEN 'BUILDING' THEN {d.words('research,technology')}
            WHEN 'AUTOMOBILE' THEN {d.words('tuition,engineering')} WHEN 'MACHINERY' THEN {d.words('doctoral,climate')}
            WHEN 'HOUSEHOLD' THEN {d.words('arts,prize')} ELSE {d.words('policy,international students')} END AS research_interests,
       CASE c.c_custkey % 4 WHEN 0 THEN {d.words('python,sql')} WHEN 1 THEN {d.words('stipend,data')}
            WHEN 2 THEN {d.words('workshop')} ELSE {d.empty()} END AS skills,
       CASE c.c_custkey % 3 WHEN 0 THEN {d.words('Institute 1,Institute 7')} WHEN 1 THEN {d.words('Institute 12')}
            ELSE {d.empty()} END AS target_universities,
       CASE c.c_custkey % 5 WHEN 0 THEN {d.words('German')} ELSE {d.empty()} END AS other_languages,
       CASE c.c_custkey % 4 WHEN 0 THEN 'full_only' WHEN 1 THEN 'full_or_partial' WHEN 2 THEN 'any' ELSE NULL END AS require_funding,
       CASE WHEN c.c_custkey % 6 = 0 THEN 'target_list' ELSE 'open' END AS discovery_mode,
       CASE c.c_custkey % 7 WHEN 0 THEN {d.words('PhD only,unpaid')} WHEN 1 THEN {d.words('self-funded')}
            ELSE {d.empty()} END AS reject_phrases,
       CASE c.c_custkey % 2 WHEN 0 THEN {d.words('international students,fully funded')} ELSE {d.empty()} END AS boost_phrases,
       concat('Study ', lower(c.c_mktsegment), ' and ', CASE c.c_custkey % 3 WHEN 0 THEN 'covers monthly tuition'
            WHEN 1 THEN 'doctoral research position' ELSE 'summer school awards' END) AS long_term_goals
FROM (SELECT user_id FROM {d.ref('events')} GROUP BY user_id) u
JOIN {d.ref('customer')} c ON c.c_custkey = u.user_id
JOIN {d.ref('nation')} n ON n.n_nationkey = c.c_nationkey
JOIN {d.ref('region')} r ON r.r_regionkey = n.n_regionkey"""


def _status_events(d) -> str:
    return f"""
SELECT e.event_id, CAST(e.ts AS TIMESTAMP) AS happened_at, e.user_id, (e.event_id * 31) % (SELECT count(*) FROM {d.ref('documents')}) AS listing_id,
       CASE e.event_type WHEN 'view' THEN 'new' WHEN 'click' THEN 'saved' WHEN 'signup' THEN 'in_progress'
            WHEN 'purchase' THEN 'applied' ELSE 'dismissed' END AS status,
       CASE WHEN e.event_type = 'error' AND e.event_id % 2 = 0 THEN 'wrong_field' ELSE NULL END AS dismiss_reason
FROM {d.ref('events')} e"""


def _user_listings(d) -> str:
    return f"""
SELECT user_id, listing_id, max_by(status, {d.row('happened_at', 'event_id')}) AS status,
       max_by({d.row('dismiss_reason', 'event_id')}, {d.row('happened_at', 'event_id')}) AS last_reason,
       max(happened_at) AS status_changed_at, max(event_id) AS last_event_id
FROM {d.ref('status_events')} GROUP BY user_id, listing_id"""


def _feedback(d) -> str:
    pick = "last_reason.dismiss_reason" if d is SparkDialect else "struct_extract(last_reason, 1)"
    return f"""
SELECT user_id, listing_id, status, {pick} AS dismiss_reason, status_changed_at,
       CAST(DATE '2026-06-27' + CAST(last_event_id % 4 AS INT) AS TIMESTAMP) AS created_at,
       CAST(((last_event_id * 37) % 1001) / 1000.0 AS DOUBLE) AS fit_score,
       CASE WHEN (last_event_id * 37) % 1001 >= 620 THEN 'strong' WHEN (last_event_id * 37) % 1001 >= 420 THEN 'moderate'
            ELSE 'weak' END AS fit_level,
       CASE WHEN last_event_id % 17 = 0 THEN NULL ELSE last_event_id % 97 + 1 END AS rank_position,
       last_event_id % 19 = 0 AS hide_percent,
       CASE WHEN last_event_id % 5 = 0 THEN NULL ELSE concat('Reason ', CAST(last_event_id % 5 AS STRING)) END AS fit_explanation,
       CAST(((last_event_id * 13) % 101) / 100.0 AS DOUBLE) AS semantic,
       CAST(((last_event_id * 29) % 101) / 100.0 AS DOUBLE) AS eligibility,
       CAST(((last_event_id * 53) % 101) / 100.0 AS DOUBLE) AS urgency,
       last_event_id % 4 <> 0 AS has_semantic, last_event_id % 3 <> 0 AS has_urgency,
       last_event_id % 10 = 0 AS hard_failed
FROM {d.ref('user_listings')}"""


def _runs(d) -> str:
    return f"""
SELECT o_orderkey AS run_id, o_custkey % 20 AS source_id, CAST(o_orderdate AS TIMESTAMP) AS finished_at,
       CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'partial' END AS status,
       20 + o_orderkey % 30 AS discovered, o_orderkey % 15 AS admitted, o_orderkey % 7 AS rejected,
       o_orderkey % 5 AS created, o_orderkey % 3 AS updated, o_orderkey % 4 AS errors
FROM {d.ref('orders')}"""


def _requirements(d) -> str:
    return f"""
SELECT l_orderkey AS requirement_id, l_linenumber AS line, l_suppkey AS user_id,
       concat('Task ', CAST(l_partkey AS STRING)) AS title,
       CASE WHEN l_linenumber % 7 = 6 THEN NULL ELSE CAST(DATE '2026-06-30' + CAST(3 * l_linenumber - 7 AS INT) AS TIMESTAMP) END AS due_date,
       l_returnflag = 'R' AS is_completed
FROM {d.ref('lineitem')}"""


def _learning(d) -> str:
    return f"""
SELECT p_partkey AS item_id, p_partkey % (SELECT count(DISTINCT user_id) FROM {d.ref('events')}) AS user_id, p_name AS title, CAST(p_size AS BIGINT) AS progress,
       CASE p_partkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'in_progress' ELSE 'planned' END AS status
FROM {d.ref('part')}"""


def _page_hits(d) -> str:
    return f"""
SELECT page_id, url, {d.host('url')} AS host, html,
       substr(regexp_extract(html, '<title>([^<]*)</title>', 1), 1, 500) AS title,
       concat('Institute ', CAST(page_id % 40 AS STRING)) AS org,
       page_id // 50 AS batch_no
FROM {d.ref('pages')}""".replace("page_id // 50", "CAST(floor(page_id / 50) AS BIGINT)")


def _vectors(d) -> str:
    return f"SELECT vec_id, embedding FROM {d.ref('embeddings')}"


def _trace(d) -> str:
    return f"""
SELECT user_id AS run_id, event_id AS seq, CAST(ts AS TIMESTAMP) AS happened_at,
       CASE event_type WHEN 'view' THEN 'discover' WHEN 'click' THEN 'triage' WHEN 'signup' THEN 'process'
            WHEN 'purchase' THEN 'store' ELSE 'extract' END AS stage,
       CASE event_id % 2 WHEN 0 THEN 'stage_start' ELSE 'stage_end' END AS event_name
FROM {d.ref('events')}"""


VIEWS = {
    "listings": (_listings, ["documents"]),
    "sources": (_sources, ["documents"]),
    "profiles": (_profiles, ["events", "customer", "nation", "region"]),
    "status_events": (_status_events, ["events", "documents"]),
    "user_listings": (_user_listings, ["status_events"]),
    "feedback": (_feedback, ["user_listings"]),
    "runs": (_runs, ["orders"]),
    "requirements": (_requirements, ["lineitem"]),
    "learning": (_learning, ["part", "events"]),
    "page_hits": (_page_hits, ["pages"]),
    "vectors": (_vectors, ["embeddings"]),
    "trace": (_trace, ["events"]),
}


class Bindings:
    """Attribute access to base tables and business views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, text_partitions: int | None = None):
        """text_partitions: deal tables of texts out to so many partitions, for small tables in one row group, which
        Spark can't split while reading. By default the files' own splits stay, whatever their size."""
        pin_utc(spark)
        self.text_partitions = text_partitions
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.view(name)

    def view(self, name: str) -> DataFrame:
        if name in self._cache:
            return self._cache[name]
        if name in BASE_TABLES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            if name in TEXT_KEYS and self.text_partitions:
                df = df.repartition(self.text_partitions, TEXT_KEYS[name])
        else:
            build, needs = VIEWS[name]
            df = self.spark.sql(build(SparkDialect), **{n: self.view(n) for n in needs})
        self._cache[name] = df
        return df


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        if name in BASE_TABLES or name in out:
            return
        for need in VIEWS[name][1]:
            visit(need)
        out.append(name)

    for name in names:
        visit(name)
    return out


def with_views(names: str, body: str) -> str:
    """Oracle text: the named views (and what they need) as CTEs, then the body.

    The body may open with further CTEs, written as ``, name AS (...)`` before the final SELECT.
    """
    parts = [f"{n} AS ({VIEWS[n][0](DuckDialect)})" for n in _closure(names.split())]
    body = body.strip()
    if not parts:
        return body
    joined = ",\n".join(parts)
    if body.startswith(","):
        return f"WITH {joined}\n{body}"
    return f"WITH {joined}\n{body}"
