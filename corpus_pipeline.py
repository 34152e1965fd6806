"""The corpus pipeline: language ID, near-duplicates, secrets, mixing and tokens, one stage after the other.

Each stage takes what the one before has kept. All but the last return the columns of `documents`; the last returns the
token ids. SQL can't state the first three stages, so ORACLE_SQL is None and a brute-force version is in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm import bpe, curriculum, language_id, ngram_join, secret_scan
from fairlead.llm.queries import vocabulary
from fairlead.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model is sure of; the others go. `lang` stays what the table says: the model learns
    from it, and later stages don't use it."""
    told = language_id.identify(docs, docs, keep=tuple(COLUMNS))
    return told.where(~F.col("rejected")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, and of rows with that id the first by
    text. A document is an id with a text (rows that share only the id are not linked by that), told apart by a hash of
    both. Documents without any word are in no group and stay; so do rows without an id, which no link can name."""
    key = F.xxhash64("doc_id", "text")
    named = docs.where("doc_id IS NOT NULL").select("doc_id", "text", key.alias("key"))
    found = ngram_join.similar_components(named, id="key").withColumnRenamed("doc_id", "key").distinct()
    first = found.join(named.select("key", "doc_id", F.md5("text").alias("digest")).distinct(), "key")
    stay = first.groupBy("component_id").agg(F.min(F.struct("doc_id", "digest", "key")).alias("one")).select("one.key")
    kept = docs.where("doc_id IS NOT NULL").withColumn("key", key).join(stay, "key", "left_semi")
    one = kept.groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("d")).select("d.*")
    return one.union(docs.where("doc_id IS NULL").select(*COLUMNS))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret, encoded ones too, replaced by a mark."""
    told = secret_scan.scan(docs, keep=tuple(COLUMNS), redacted=True)
    text = F.when(F.col("text").isNotNull(), F.col("redacted"))
    return told.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("spans") != "", F.length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the curriculum. Rows are told apart by a hash of all they
    hold, with nulls in their columns; equal rows share it, and each counts."""
    keyed = docs.withColumn("key", F.sha2(F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"}), 256))
    taken = curriculum.occurrences(keyed, id="key").select(F.col("doc_id").alias("key"), "position", "pass")
    texts = keyed.dropDuplicates(["key"])
    return taken.join(texts, "key").orderBy("position", "key", "pass").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a check that they decode to its text."""
    return bpe.encode_documents(docs, vocabulary(), keep=("doc_id", "lang", "source"), ids=True)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scans", remove_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; each stage's rows are written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
