import random
from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from conftest_llm import documents_of
from fairlead.llm import curriculum
from fairlead.llm.curriculum import Schedule


def rows_of(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=lambda r: (r[0] is None, *map(str, r)))


def expected(docs):
    rows = [(d.doc_id, d.source, len(brute.WORDS.findall(d.text or ""))) for d in docs]
    return sorted(((k, n, s, round(t, 6), m) for k, n, s, t, m in brute.mix(rows)), key=lambda r: (r[0] is None, *map(str, r)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    sources = ["b", "a", None, "é", "Z", "src10", "src9"][: seed * 2 + 1]
    rows = [(i, " ".join("w" * rng.randrange(40)), "en", rng.choices(sources, [9, *[1] * (len(sources) - 1)])[0]) for i in range(300)]
    docs = documents_of(spark, rows)
    got = curriculum.mixed(docs)
    assert rows_of(got) == expected(docs.select("doc_id", "source", "text").collect())
    assert rows_of(got) == rows_of(curriculum.mixed(docs.repartition(7)))
    totals, most = defaultdict(int), defaultdict(int)
    for r in got.collect():
        totals[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
        assert r.taken <= 2 * r.size and r.taken == r.size * r.passes
    for r in got.select("source", "target").distinct().collect():
        assert abs(totals[r.source] - r.target) <= most[r.source] / 2 + 1e-6


def test_odd_rows(odd, empty):
    assert rows_of(curriculum.mixed(odd)) == expected(odd.select("doc_id", "source", "text").collect())
    assert curriculum.mixed(empty).collect() == []
    assert curriculum.mixed(odd.where("text IS NULL")).agg(F.sum("taken")).first()[0] == 0


def test_positions_follow_the_schedules(spark):
    rows = [(i, "w " * 10, "en", "abc"[i % 3]) for i in range(3000)]
    each = curriculum.occurrences(documents_of(spark, rows)).collect()
    for k, source in enumerate("abc"):
        times = sorted(r.position for r in each if r.source == source)
        assert all(0 <= t <= 1 for t in times)
        w = curriculum.SCHEDULES[k].points
        for cut in (0.25, 0.5, 0.75):  # the words due by then are the integral of the schedule
            due = w[0][1] * cut + (w[1][1] - w[0][1]) * cut * cut / 2
            assert abs(sum(t <= cut for t in times) / len(times) - due) < 0.01
    got = [r.position for r in curriculum.mixed(documents_of(spark, rows)).collect() if r.position is not None]
    assert got == sorted(got)


def test_schedules_of_several_pieces(spark):
    schedule = Schedule(((0.0, 0.0), (0.2, 2.0), (0.5, 0.0), (0.7, 0.0), (1.0, 1.0)))
    share = spark.range(0, 1001).select((F.col("id") / 1000).alias("s"))
    for r in share.select("s", curriculum.inverse(F.col("s"), F.lit(0), (schedule,)).alias("t")).collect():
        area = 0.0
        for (t, w), (u, v) in zip(schedule.points, schedule.points[1:]):
            x = min(max(r.t - t, 0), u - t)
            area += w * x + (v - w) / (u - t) * x * x / 2
        assert abs(area / 0.65 - r.s) < 1e-6
