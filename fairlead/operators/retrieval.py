"""Chunk index, per-listing retrieval and a pluggable embedding column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead.functions import scoring as S
from fairlead.functions import text as T

EMBED_CHARS = 8000


def index_text() -> Column:
    """Labelled text block of a listing."""
    def label(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    return F.concat_ws("\n", label("Title", F.coalesce("title", F.lit(""))), label("Institution", F.coalesce("institution", F.lit("Unknown"))), F.lit("Program: N/A"),
                       label("Summary", F.coalesce("summary", F.lit(""))), label("Requirements", F.array_join("requirements", ", ")), label("Tags", F.array_join("tags", ", ")))


def chunk_listings(listings: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    rows = listings.select("listing_id", "url", F.inline(T.chunk_text(index_text(), size, overlap)))
    return rows.select("listing_id", F.col("idx").cast("bigint").alias("chunk_index"), F.col("chunk").alias("content"), F.col("url").alias("source_url"))


def index_listings(old_chunks: DataFrame, listings: DataFrame) -> DataFrame:
    """Chunk table with the chunks of the given listings replaced."""
    kept = old_chunks.join(listings.select("listing_id"), "listing_id", "left_anti")
    return kept.unionByName(chunk_listings(listings))


def unindexed_listings(listings: DataFrame, chunks: DataFrame) -> DataFrame:
    return listings.join(chunks.select("listing_id"), "listing_id", "left_anti")


def retrieve_topk(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Best k chunks of its own listing per query (query_id, listing_id, query_vec).

    A chunk without vector scores 0; a query without vector takes the first chunks. Vectors are compared
    with norms made once per side; the rank filter cuts each query's rows before the shuffle.
    """
    q = queries.withColumn("query_norm", S.norm(F.col("query_vec")))
    c = chunks.withColumn("vec_norm", S.norm(F.col("vec")))
    sim = S.cosine(F.col("query_vec"), F.col("vec"), F.col("query_norm"), F.col("vec_norm"))
    scored = q.join(c, "listing_id").select("query_id", "listing_id", "chunk_index", "content", "source_url",
                                            F.when(F.col("query_vec").isNotNull(), F.round(sim, 6)).otherwise(0.0).alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_index"))
    return scored.withColumn("place", place).filter(F.col("place") <= k)


def retrieval_context(top: DataFrame) -> DataFrame:
    """Context text and distinct citations per query; at most k chunks each."""
    return top.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "content"))), lambda s: s["content"]), "\n\n---\n\n").alias("context"),
        F.array_sort(F.collect_set("source_url")).alias("citations"))


def mentioned_connections(projects: Column, connections: Column, text: Column) -> Column:
    """Lines for projects and connections whose names occur in the text."""
    def lines(names: Column, make) -> Column:
        return T.let(F.lower(text), lambda t: F.transform(F.filter(names, lambda n: F.contains(t, F.lower(n))), make))

    return F.concat(lines(projects, lambda n: F.concat(F.lit("Your project '"), n, F.lit("' is mentioned in related context"))),
                    lines(connections, lambda n: F.concat(F.lit("Connection '"), n, F.lit("' appears relevant"))))


def embed_column(text: Column, dim: int = 64) -> Column:
    """Hashed bag-of-words vector of the first 8000 characters; NULL for blank text. Swap in an Arrow UDF for a model."""
    words = F.regexp_extract_all(F.lower(F.substring(text, 1, EMBED_CHARS)), F.lit("([a-z0-9]+)"), F.lit(1))
    slots = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int"), F.lit(dim)))
    vec = T.let(slots, lambda s: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(s, lambda x: x == i)).cast("double")))
    return F.when(F.trim(text) != "", vec)
