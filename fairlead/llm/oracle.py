"""SQL of queries whose text is made from parts."""

from __future__ import annotations

#: Levels that the manifest's SQL spells out: enough for 65,536 rows of a source, and for as many sources.
LEVELS = 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def crc_sql(data: str) -> str:
    """CRC-32 of a list of bytes, as DuckDB has none: a list of the bytes, each followed by eight steps (-1), is reduced."""
    steps = f"flatten(list_transform({data}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
    turn = "CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda x, y: {turn}), 4294967295)"


def leaf_sql(text: str) -> str:
    value = lambda c: text if c == "text" else f"CAST({c} AS VARCHAR)"
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({value(c)})) || ':' || {value(c)} END" for c in COLUMNS) + ")"


def levels_sql(name: str, leaves: str) -> str:
    """Common tables <name>_0 .. <name>_LEVELS with the nodes of all trees by level, each with its siblings' hashes."""
    run = "PARTITION BY tree, place // 16 ORDER BY place ROWS BETWEEN"
    parts = []
    for k in range(LEVELS + 1):
        nodes = leaves if k == 0 else f"""(SELECT tree, place // 16 AS place, CASE WHEN max(size) = 1 THEN min(hash) ELSE sha256(string_agg(hash, '' ORDER BY place)) END AS hash, (max(size) + 15) // 16 AS size
        FROM {name}_{k - 1} GROUP BY tree, place // 16)"""
        parts.append(f"""{name}_{k} AS (SELECT tree, place, hash, size, coalesce(string_agg(hash, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(hash, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {nodes})""")
    return ", ".join(parts)


def climb_sql(name: str, start: str, tree: str, place: str) -> str:
    """Common tables that carry (root so far, proof so far) of <start>_0 up the levels of <name>."""
    return ", ".join(f"""{start}_{k + 1} AS (SELECT x.* EXCLUDE (folded, proof), CASE WHEN n.size > 1 THEN sha256(n.l || folded || n.r) ELSE folded END AS folded, proof || n.l || n.r AS proof
        FROM {start}_{k} x JOIN {name}_{k} n ON n.tree = {tree} AND n.place = {place} // {16 ** k})""" for k in range(LEVELS))


def manifest_sql() -> str:
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = crc_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))")
    return f"""
WITH leaves AS (
    SELECT doc_id, coalesce('=' || source, '-') AS tree, {leaf_sql("text")} AS hash, CASE WHEN {crc} % 5 = 0 THEN {leaf_sql(lowered)} END AS tampered FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size FROM leaves
), {levels_sql("s", "placed")}, tops AS (
    SELECT '*' AS tree, tree AS source, hash, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS size FROM s_{LEVELS}
), {levels_sql("t", "tops")}, up_0 AS (
    SELECT doc_id, hash AS leaf, p.tree, p.place, coalesce(tampered, hash) AS folded, '' AS proof FROM placed p
), {climb_sql("s", "up", "x.tree", "x.place")}, over_0 AS (
    SELECT u.* EXCLUDE (place), t.place, t.hash AS subroot FROM up_{LEVELS} u JOIN tops t ON t.source = u.tree
), {climb_sql("t", "over", "'*'", "x.place")}
SELECT doc_id, leaf, subroot, (SELECT hash FROM t_{LEVELS}) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT hash FROM t_{LEVELS}) AS verified FROM over_{LEVELS}
"""


SPELLING = f"""
WITH runs AS (
    SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
    WHERE length(run) >= 6 GROUP BY ALL
), summed AS (
    SELECT *, {crc_sql("flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [CAST(192 + (ord(c) >> 6) AS BIGINT), CAST(128 + (ord(c) & 63) AS BIGINT)] END))")} AS h FROM runs
), words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM summed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), holes AS (
    SELECT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
    SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM holes x JOIN holes y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION SELECT x.word, x.n, y.word, y.n FROM holes x JOIN words y ON x.a || x.b = y.word
    UNION SELECT y.word, y.n, x.word, x.n FROM holes x JOIN words y ON x.a || x.b = y.word
), best AS (
    SELECT word, count(*) AS n_near, max(near_n) AS most, arg_min(near, (-near_n, encode(near))) AS form FROM near GROUP BY word
), led AS (
    SELECT w.word, CASE WHEN most >= 5 * w.n THEN form END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN most END AS form_n FROM words w LEFT JOIN best USING (word)
), steps AS (
    WITH RECURSIVE way AS (SELECT word, word AS root, form AS next FROM led UNION ALL SELECT way.word, led.word, led.form FROM way JOIN led ON way.next = led.word)
    SELECT word, root FROM way WHERE next IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM led JOIN steps USING (word)
"""
