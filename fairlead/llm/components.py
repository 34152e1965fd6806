"""Connected components by alternating large and small stars, without collecting nodes or edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.shared import dealt_afresh, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node that edges lead to. Edges may repeat, point
    either way or join a node to itself; nulls are no nodes. Self-joined nodes without other edges aren't returned.

    Every edge is kept as (high, low). Large star: what lies above a node is tied to the smallest of its neighbourhood;
    small star: what lies below, too. Each round roughly halves the distances; it ends when the edges are stars, that is
    when a round changes nothing. Joins are against one row per node, so that a hub of any size can be split."""
    found = edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    found, before = written(found), None
    while (now := mark(found)) != before and now[0]:
        before = now
        ends = found.select(F.col("low").alias("node"), F.col("low").alias("other")).union(found.select(F.col("high"), F.col("low")))
        smallest = ends.groupBy("node").agg(F.min("other").alias("least"))
        smallest = dealt_afresh(smallest, "node")
        large = found.join(smallest, found.low == smallest.node).select("high", F.col("least").alias("low")).distinct()
        below = large.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
        below = dealt_afresh(below, "node")
        both = large.join(below, large.high == below.node).select("high", "low", "least")
        small = both.select(F.explode(F.array(F.struct("high", F.col("least").alias("low")), F.struct(F.col("low").alias("high"), F.col("least").alias("low")))).alias("e")).select("e.*").where("high <> low").distinct()
        found = written(small)
    roots = found.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return found.select(F.col("high").alias("node"), F.col("low").alias("component")).union(roots)


def mark(edges: DataFrame) -> tuple[int, int | None]:
    """Number of edges, and a digest of the set."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("high", "low")).alias("x")).first()
    return row["n"], row["x"]
