"""The similarity join and batch resolution against plain loops that go row by row."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fairlead.functions.similarity import indel_ratio
from fairlead.operators import resolve as X
from fairlead.operators import titles
from fairlead.operators.titles import _apart, _counted, _numbered, first_comers, similar_titles


def some_titles(rnd, n):
    base = ["alpha scholarship in ocean science", "beta fellowship", "gamma research grant on soils and rivers of the north", "délta prix für köln", "short one"]
    out = []
    for _ in range(n):
        t = list(rnd.choice(base) + rnd.choice(["", f" {rnd.randint(1, 30)}", " " + "long tail of words " * rnd.randint(1, 12)]))
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            k = rnd.randrange(len(t))
            t[k:k + rnd.randint(0, 1)] = rnd.choice(["x", "yz", "é", ""])
        out.append("".join(t))
    return out


@pytest.mark.parametrize("percent", [92.0, 80.0, 100.0])
def test_similarity_join_equals_all_pairs(spark, percent):
    rnd = random.Random(int(percent))
    left, right = some_titles(rnd, 70), some_titles(rnd, 90) + ["", None, "a", "ab"]
    left += right[:9] + ["", None, "a", "ab", "abc"]
    got = similar_titles(spark.createDataFrame([(t,) for t in left], "t string"), spark.createDataFrame([(t,) for t in right], "t string"), percent).collect()
    want = {(a, b): indel_ratio(a, b) for a in left for b in right if a and b and indel_ratio(a, b) >= percent}
    assert {(r["lt"], r["rt"]): r["ratio"] for r in got} == want and len(got) == len(want) > 10


def test_similarity_join_above_and_empty(spark):
    two = spark.createDataFrame([("abcdefghij",), ("abcdefghijk",)], "t string")
    assert {r["ratio"] for r in similar_titles(two, two, 95.0, above=True).collect()} == {100.0, 200.0 * 10 / 21}
    assert similar_titles(two.limit(0), two, 92.0).collect() == similar_titles(two, two.limit(0), 92.0).collect() == []


def test_common_words_bring_no_titles_together(spark):
    """Titles that share words but not their characters are told apart by numbers, before any text is looked at."""
    rnd = random.Random(3)
    rows = ["masters programme in germany " + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(300)]
    rows += ["\U0001f600" * 300 + "é" * 290, "\U0001f600" * 290 + "é" * 300, "e" * 300 + "é", "e" * 310, rows[0][:-1]]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = similar_titles(df, df, 92.0)
    assert {(r["lt"], r["rt"]) for r in got.collect()} == {(a, b) for a in rows for b in rows if indel_ratio(a, b) >= 92.0}
    counts = _counted(_numbered(df))
    met = counts.alias("x").join(counts.alias("y"), sum(_apart(f"x.h{k}", f"y.h{k}") for k in range(3)) <= 14)
    assert met.count() <= 2 * len(rows)


def test_keys_in_titles_are_told_apart_by_their_digits(spark):
    """Titles that differ by a hexadecimal key only: no more than two of a hundred pairs are looked at as texts."""
    rows = ["unseen backlog title " + hashlib.md5(str(i).encode()).hexdigest() for i in range(300)]
    rows += ["0" * n + "e" * 40 for n in (3, 15, 16, 17, 19, 20)]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = similar_titles(df, df, 90.0, above=True)
    assert {(r["lt"], r["rt"]) for r in got.collect()} == {(a, b) for a in rows for b in rows if indel_ratio(a, b) > 90.0}
    counts = _counted(_numbered(df.filter("length(t) = 53")))
    words = [c for c in counts.columns if c.startswith("h")]
    met = counts.alias("x").join(counts.alias("y"), sum(_apart(f"x.{h}", f"y.{h}") for h in words) <= 10)
    assert met.count() <= 0.02 * 300 ** 2


def one_by_one(batch, listings, percent=92.0):
    """Rows (item, source, pos, title, institution, hash) against listings (id, source, title, institution, seen, duplicate, hash)."""
    where = lambda inst, title: f"{inst or ''}\n{title or ''}".lower()
    hashes = {x[6]: ("old", x[0]) for x in listings}
    pool = [(x[1], (x[2] or "").lower(), where(x[3], x[2]), ("old", x[0]), (0, x[4] if x[4] is not None else -1, -x[0])) for x in listings if x[5] is None]
    out = {}
    for n, (item, source, _, title, inst, h) in enumerate(sorted(batch, key=lambda x: (x[1], x[2], x[0]))):
        if h in hashes:
            kind, to = hashes[h]
            out[item] = ("update" if kind == "old" else "update_new", to)
            continue
        key = (inst or "").strip().lower()
        best = None
        for src, lt, text, to, recency in pool if len(title or "") >= 8 else ():
            r = indel_ratio(title.lower(), lt)
            if r >= percent and (len(key) < 3 or key in text) and (best is None or (r, recency) > best[0]):
                best = ((r, recency), src, to)
        if best is None:
            out[item] = ("create", None)
            pool.append((source, (title or "").lower(), where(inst, title), ("new", item), (1, -n, 0)))
            hashes[h] = ("new", item)
        else:
            kind = "shadow" if best[1] != source else "update"
            out[item] = (kind + ("" if best[2][0] == "old" else "_new"), best[2][1])
            if kind == "shadow":
                hashes[h] = ("new", item)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_batches_equal_one_by_one(spark, seed):
    rnd = random.Random(seed)
    inst = lambda: rnd.choice([None, "", "MIT", "Institute 1", "institute 2", "xy"])
    titles = some_titles(rnd, 60)
    # A chain: each is similar to the next, the ends are not.
    chain = ["chain of titles number " + "a" * (30 - 2 * k) + "b" * (2 * k) for k in range(14)]
    listings = [(i, rnd.randrange(3), rnd.choice(titles[:12]) if i % 3 else None, inst(), rnd.choice([None, 5, 9]), rnd.choice([None, None, 1]), f"h{i}") for i in range(15)]
    batch = [(100 + k, rnd.randrange(3), rnd.randrange(40), rnd.choice(titles + chain * 2 + [None, "tiny"]) if rnd.random() < 0.9 else "the same title for many", inst(), rnd.choice([f"h{rnd.randrange(15)}", f"n{rnd.randrange(60)}", f"n{k + 100}"])) for k in range(150)]
    l = spark.createDataFrame(listings, "listing_id bigint, source_id bigint, title string, institution string, seen bigint, duplicate_of bigint, url_hash string").withColumn("last_seen_at", F.timestamp_seconds("seen"))
    b = spark.createDataFrame(batch, "item_id bigint, source_id bigint, pos bigint, title string, institution string, url_hash string")
    got = {}
    for r in X.resolve_upsert(b, l).collect():
        to = [r[c] for c in ("target_id", "first_item", "duplicate_of", "shadow_of_item") if r[c] is not None]
        got[r["item_id"]] = (r["action"], to[0] if to else None)
    want = one_by_one(batch, listings)
    assert got == want
    assert {a for a, _ in want.values()} >= {"create", "update", "update_new", "shadow_new"}


@pytest.mark.parametrize("seed", range(3))
def test_first_comers_and_backlog_equal_one_by_one(spark, seed):
    rnd = random.Random(seed)
    titles = some_titles(rnd, 25) + ["chain of titles number " + "a" * (30 - 2 * k) + "b" * (2 * k) for k in range(14)] + [None, ""]
    listings = [(i, f"h{i}", titles[i]) for i in range(4)]
    docs = [(i, rnd.choice([f"h{rnd.randrange(9)}", f"n{rnd.randrange(40)}"]), rnd.choice(titles), rnd.random() < 0.1, None, "<p>Some text</p> " * 300) for i in range(120)]
    raw = spark.createDataFrame(docs, "doc_id bigint, url_hash string, title string, processed boolean, summary string, raw_content string")
    l = spark.createDataFrame(listings, "listing_id bigint, url_hash string, title string")
    hashes, seen, want = {x[1] for x in listings}, [x[2].lower() for x in listings], {}
    for i, h, title, processed, _, _ in docs:
        if not processed:
            t = (title or "").lower()
            skip = h in hashes or any(t and s and indel_ratio(t, s) > 90 for s in seen)
            want[i] = "skip" if skip else "create"
            if not skip:
                hashes.add(h)
                seen.append(t)
    rows = X.normalize_backlog(raw, l).collect()
    assert {r["doc_id"]: r["action"] for r in rows} == want
    assert min(len(r["summary"]) for r in rows) > 2000
    assert {r["doc_id"] for r in X.normalize_backlog(raw, l, limit=10, body=50).collect()} == set(sorted(want)[:10])


def test_a_third_of_a_batch_with_one_title(spark):
    rows = spark.range(3000).selectExpr("id", "id AS o", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('c', id) END AS c", "concat('h', id) AS h", "false AS barred")
    done = first_comers(rows, spark.createDataFrame([("c1", "hot"), ("hot", "c1")], "c string, d string"))
    assert done.filter("created").count() == 2000 and not done.filter("id = 1").first()["created"]


def test_long_titles_meet_as_texts_only_if_they_may_be_similar(spark):
    """Of titles whose characters occur over sixteen times, or in another order, hardly any pair is looked at as texts, and
    no similar one is lost, with many titles of one length in several blocks too."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("etaoinsrhldcumpfgbywvk") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    rows = [" ".join(rnd.choice(words) for _ in range(120))[:n] for n in (200, 499, 500) for _ in range(60)]
    rows += [r[:k] + "q" + r[k:-1] for r in rows[::9] for k in (3, 90)] + [r[:50] + r[90:] for r in rows[::7]] + ["é" * n for n in range(480, 500, 3)]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    want = {(a, b) for a in rows for b in rows if indel_ratio(a, b) >= 92.0}
    few, titles.BLOCK = titles.BLOCK, 20
    try:
        assert {(r["lt"], r["rt"]) for r in similar_titles(df, df, 92.0).collect()} == want and len(want) > 250
    finally:
        titles.BLOCK = few
    numbered = _numbered(df).orderBy("tid").toArrow()
    counted = _counted(spark.createDataFrame(numbered)).toArrow()
    met = titles._may_be_similar(counted, counted, 0.08)
    named = dict(zip(numbered.column("tid").to_pylist(), numbered.column("t").to_pylist()))
    got = [(named[a], named[b]) for a, b in zip(met.column("l").to_pylist(), met.column("r").to_pylist())]
    assert want <= set(got) and len(got) == len(set(got)) <= 1.2 * len(want) < 0.02 * len(rows) ** 2


def test_chains_end_the_same_by_rounds_and_row_by_row(spark):
    """Rows settled in rounds only, in one task only, and by both."""
    rnd = random.Random(11)
    rows = [(k, rnd.choice([1, 2, None]), k, t, rnd.choice([None, "Ocean Institute"]), f"h{rnd.randrange(60)}") for k, t in enumerate(some_titles(rnd, 120))]
    batch = spark.createDataFrame(rows, "item_id long, source_id long, pos long, title string, institution string, url_hash string")
    old = spark.createDataFrame([(900 + k, 1, t, None, None, None, f"o{k}") for k, t in enumerate(some_titles(rnd, 6))],
                                "listing_id long, source_id long, title string, institution string, last_seen_at timestamp, duplicate_of long, url_hash string")
    found, last = [], X.LAST
    try:
        for X.LAST in (-1, 10 ** 6, 60):
            found.append(sorted(X.resolve_upsert(batch, old).select("item_id", "action", "target_id", "duplicate_of", "first_item", "shadow_of_item").collect()))
    finally:
        X.LAST = last
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows) and len({r["action"] for r in found[0]}) >= 4
