"""The registered queries of this package: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm import bpe, chat_format, curriculum, language_id, merkle, ngram_join, oracle, quality, repeats, secret_scan, shard_tree, spelling, url_filter, vector_dedup
from fairlead.llm.shared import table
from fairlead.llm.url_filter import Rule

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def vocabulary() -> str:
    """The tokenizer file: FAIRLEAD_VOCABULARY, else the one installed with the public tokenizers."""
    if named := os.environ.get("FAIRLEAD_VOCABULARY"):
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_ngram_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    told = language_id.identify(docs, docs.where(~F.col("held_out")), keep=("doc_id", "held_out"))
    return told.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query("op3_vector_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


#: The two lists of the registered query.
URL_RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


@query("op4_url_filter", r"""
WITH parts AS (
    SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), split AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts
), judged AS (
    SELECT page_id, host, path, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM split
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
    CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op5_chat_format")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"{chat_format.END}{chat_format.START}assistant ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.format_conversations(turns.unionByName(planted))


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query("op7_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary())


@query("op8_shard_tree")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.assign(table(spark, sf_dir, "documents"), shard_tree.default_tree(8))


@query("op9_quality_rules", r"""
WITH words AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
    SELECT *, list_transform(range(1, greatest(len(words) - 7, 0) + 1), lambda i: array_to_string(words[i:i + 7], ' ')) AS windows, row_number() OVER () AS row FROM words
), places AS (
    SELECT row, unnest(windows) AS w, generate_subscripts(windows, 1) AS p FROM windows
), twice AS (
    SELECT row, p, lag(p) OVER (PARTITION BY row ORDER BY p) AS prev FROM (SELECT row, p, count(*) OVER (PARTITION BY row, w) AS n FROM places) WHERE n > 1
), covered AS (
    SELECT row, CAST(sum(least(8, p - coalesce(prev, p - 8))) AS BIGINT) AS n_repeat_words FROM twice GROUP BY row
), counts AS (
    SELECT doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines
    FROM windows LEFT JOIN covered USING (row)
), shares AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_length, CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbols,
        CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines, CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats FROM counts
), measures AS (
    UNPIVOT (SELECT lang, source, word_length, symbols, dup_lines, repeats FROM shares WHERE NOT base_failed) ON word_length, symbols, dup_lines, repeats INTO NAME measure VALUE value
), bins AS (
    SELECT lang, source, measure, (value >> greatest(0, length(bin(value)) - 7)) << greatest(0, length(bin(value)) - 7) AS bin FROM measures
), sketches AS (
    SELECT 0 AS level, lang, source, measure, bin, count(*) AS held FROM bins GROUP BY ALL
    UNION ALL SELECT 1, lang, NULL, measure, bin, count(*) FROM bins GROUP BY ALL
    UNION ALL SELECT 2, NULL, NULL, measure, bin, count(*) FROM bins GROUP BY ALL
), quartiles AS (
    SELECT level, lang, source, measure, max(size) AS size, min(bin) FILTER (upto * 4 >= size) AS q1, min(bin) FILTER (upto * 4 >= size * 2) AS q2, min(bin) FILTER (upto * 4 >= size * 3) AS q3
    FROM (SELECT *, sum(held) OVER (PARTITION BY level, lang, source, measure ORDER BY bin) AS upto, sum(held) OVER (PARTITION BY level, lang, source, measure) AS size FROM sketches)
    GROUP BY ALL
), limits AS (
    SELECT level, lang, source, max(size) AS size, max(q2 + 8.0 * (q3 - q2) + 1000) FILTER (measure = 'word_length') AS high_word_length, max(q2 - 8.0 * (q2 - q1) - 1000) FILTER (measure = 'word_length') AS low_word_length,
        max(q2 + 8.0 * (q3 - q2) + 150) FILTER (measure = 'symbols') AS high_symbols, max(q2 + 8.0 * (q3 - q2) + 400) FILTER (measure = 'dup_lines') AS high_dup_lines,
        max(q2 + 8.0 * (q3 - q2) + 250) FILTER (measure = 'repeats') AS high_repeats FROM quartiles GROUP BY ALL
), judged AS (
    SELECT s.*, CASE WHEN a.size IS NOT NULL THEN a WHEN b.size IS NOT NULL THEN b ELSE c END AS l FROM shares s
    LEFT JOIN (SELECT * FROM limits WHERE level = 0 AND size >= 300) a ON s.lang IS NOT DISTINCT FROM a.lang AND s.source IS NOT DISTINCT FROM a.source
    LEFT JOIN (SELECT * FROM limits WHERE level = 1 AND size >= 300) b ON s.lang IS NOT DISTINCT FROM b.lang
    LEFT JOIN (SELECT * FROM limits WHERE level = 2) c ON true
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND coalesce(word_length <= l.high_word_length AND word_length >= l.low_word_length AND symbols <= l.high_symbols AND dup_lines <= l.high_dup_lines AND repeats <= l.high_repeats, true) AS kept
FROM judged
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.filtered(table(spark, sf_dir, "documents"))


@query("op10_mixing", r"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS mixed FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM sized GROUP BY source
), weighed AS (
    SELECT *, CAST([3, 1, 2][turn % 3 + 1] AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS most FROM sources
), levels AS (
    SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM weighed WINDOW before AS (ORDER BY most / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
    SELECT source, turn, source_size, least(most, max(level) FILTER (level <= most / weight) OVER () * weight) AS target FROM levels
), placed AS (
    SELECT doc_id, s.source, size, turn, source_size, target,
        coalesce(CAST(sum(size) OVER (PARTITION BY s.source ORDER BY mixed, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) + size / CAST(2 AS DOUBLE) AS middle,
        CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), taken AS (
    SELECT *, least(2, whole + CAST(middle < target - whole * source_size AS BIGINT)) AS passes, least(CAST(1 AS DOUBLE), middle / target) AS share,
        CASE turn % 3 WHEN 0 THEN CAST(1.5 AS DOUBLE) WHEN 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS w, CASE turn % 3 WHEN 0 THEN CAST(-1 AS DOUBLE) WHEN 1 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS slope FROM placed
)
SELECT doc_id, size, source_size, target, CAST(size * passes AS BIGINT) AS taken, CAST(passes AS BIGINT) AS passes,
    CASE WHEN passes > 0 AND target > 0 THEN least(CAST(1 AS DOUBLE), CASE WHEN share > 0 THEN 2 * share / (w + sqrt(greatest(CAST(0 AS DOUBLE), w * w + 2 * slope * share))) ELSE 0 END) END AS position
FROM taken
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mixed(table(spark, sf_dir, "documents")).drop("source")


@query("op11_suffix_array_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


@query("op12_merkle_manifest", oracle.manifest_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


@query("op13_spelling_variants", oracle.SPELLING)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
