"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.bindings import Bindings
from fairlead.functions import text as T
from fairlead.operators import retrieval as A
from fairlead.plans.registry import query


@query("a01_index_listings")
def a01(b: Bindings):
    old = A.chunk_listings(b.listings).filter("listing_id % 4 = 0 OR chunk_index > 100")
    return A.index_listings(old, b.listings.filter("listing_id % 3 = 0")).select("listing_id", "chunk_index", F.md5("content").alias("content_md5"), "source_url")


def vectored(b: Bindings) -> DataFrame:
    """Chunks with the vector of a number derived from both keys; some have none."""
    n = b.vectors.agg(F.count("*")).scalar()
    c = A.chunk_listings(b.listings).withColumn("vec_id", (F.col("listing_id") * 31 + F.col("chunk_index")) % n)
    v = b.vectors.filter("vec_id % 4 <> 3").select("vec_id", F.col("embedding").alias("vec"))
    return c.join(v, "vec_id", "left").drop("vec_id")


def queries_(b: Bindings) -> DataFrame:
    q = b.feedback.filter(F.col("status") == "applied").select((F.col("user_id") * 1_000_000 + F.col("listing_id")).alias("query_id"), "user_id", "listing_id")
    return q.join(b.vectors.select(F.col("vec_id").alias("user_id"), F.col("embedding").alias("query_vec")), "user_id", "left").drop("user_id")


@query("a02_retrieve_topk")
def a02(b: Bindings):
    return A.retrieve_topk(queries_(b), vectored(b), 5).select("query_id", "chunk_index", F.col("place").cast("bigint").alias("place"), F.round(F.col("score") + 1e-9, 4).alias("score"))


@query("a02_retrieval_context")
def a02c(b: Bindings):
    return A.retrieval_context(A.retrieve_topk(queries_(b), vectored(b), 3)).select("query_id", F.md5("context").alias("context_md5"), T.joined(F.col("citations")).alias("citations"))


@query("a03_unindexed_listings")
def a03(b: Bindings):
    return A.unindexed_listings(b.listings, A.chunk_listings(b.listings.filter("listing_id % 4 <> 0"))).select("listing_id")


@query("a04_mentioned_connections")
def a04(b: Bindings):
    lines = A.mentioned_connections(T.str_array(["Scholarship", "Zebra"]), T.str_array(["beta", "Tuition", "nobody"]), F.concat_ws(" ", "title", "summary"))
    return b.listings.select("listing_id", T.joined(lines).alias("lines"))


@query("a05_embed_column")
def a05(b: Bindings):
    return b.documents.select("doc_id", F.array_join(F.transform(A.embed_column(F.col("text"), 16), lambda x: x.cast("int").cast("string")), ",").alias("vec"))
