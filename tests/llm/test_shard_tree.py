import math
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from fairlead.llm import queries, shard_tree
from fairlead.llm.shard_tree import Leaf


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def drawn(key, leaves):
    tree, path = shard_tree.tree_of(leaves), ""
    for _ in range(3):
        best = []
        for name, weight in tree[path]:
            seed = 42 if key is None else xxhash.xxh64(key.to_bytes(8, "little", signed=True), seed=42).intdigest()
            h = signed(xxhash.xxh64(name.encode(), seed=seed).intdigest()) % shard_tree.DRAWS
            best.append((-math.log((h + 0.5) / shard_tree.DRAWS) / weight, name))
        path = min(best)[1]
    return int(path.rsplit("/", 1)[1])


def check(docs, rows, leaves):
    grown = shard_tree.grown_tree(leaves)
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), "key", drawn(r.doc_id, leaves), drawn(r.doc_id, grown)) for r in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in rows) == want
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, len(leaves)) for r in rows)


def test_query_and_odd_rows(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check(docs, queries.QUERIES["op8_shard_tree"](spark, sf).collect(), shard_tree.default_tree(8))
    check(odd.select("doc_id", "text").collect(), shard_tree.assign(odd, shard_tree.default_tree(8)).collect(), shard_tree.default_tree(8))
    assert shard_tree.assign(empty, shard_tree.default_tree(8)).collect() == []


def test_shares_follow_weights(spark):
    leaves = [Leaf("a", "r1", 0, 1.0), Leaf("a", "r1", 1, 3.0), Leaf("a", "r2", 2, 2.0), Leaf("b", "r3", 3, 4.0)]
    keys = spark.range(20_000)
    got = {r.shard: r.n for r in keys.select(shard_tree.place(F.col("id"), leaves).alias("shard")).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert all(abs(got[x.shard] / 20_000 - x.weight / 10) < 0.02 for x in leaves)


def test_movement_stays_in_changed_subtrees(spark):
    old = shard_tree.default_tree(8)
    new = [Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 5 else 1.0) for x in old]
    moved = spark.range(20_000).select(shard_tree.place(F.col("id"), old).alias("a"), shard_tree.place(F.col("id"), new).alias("b")).where("a <> b").groupBy("a", "b").count().collect()
    assert moved and all(r.b // 4 == 1 for r in moved)  # only towards the region that grew
    assert all(r.b // 2 == 2 for r in moved if r.a // 4 == 1)  # within it, towards the rack
    assert all(r.b == 5 for r in moved if r.a // 2 == 2)  # within that, to the shard


def test_equal_rows_fill_many_slots(spark):
    rows = [(1, "same")] * 500 + [(2, "x"), (2, "y"), (None, None)]
    got = shard_tree.assign(spark.createDataFrame(rows, "doc_id long, text string"), shard_tree.default_tree(2)).collect()
    check(spark.createDataFrame(rows, "doc_id long, text string").collect(), got, shard_tree.default_tree(2))
