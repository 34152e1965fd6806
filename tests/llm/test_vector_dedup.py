import math

import brute
import numpy as np
import pytest

from fairlead.llm import queries, vector_dedup


def expected(rows, threshold):
    unit = []
    for i, v, label in rows:
        ok = v is not None and label is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append((i, np.array(v, float) / np.linalg.norm(v) if ok else None, label))
    links = [(k, m) for k in range(len(unit)) for m in range(k) if unit[k][1] is not None and unit[m][1] is not None and unit[k][2] == unit[m][2] and len(unit[k][1]) == len(unit[m][1]) and unit[k][1] @ unit[m][1] >= threshold]
    root = brute.joined({i for i, _, _ in unit}, [(unit[a][0], unit[b][0]) for a, b in links])
    n = np.bincount([x for pair in links for x in pair], minlength=len(unit))
    return sorted((i, int(n[k]), root[i], root[i] == i) for k, (i, _, _) in enumerate(unit))


@pytest.mark.parametrize("tile", [512, 7])
def test_same_as_all_pairs(spark, tile, monkeypatch):
    monkeypatch.setattr(vector_dedup, "TILE", tile)
    rng = np.random.default_rng(5)
    rows = []
    for label in (1, 2):
        for c in range(6):
            centre = rng.normal(size=24)
            for _ in range(25):
                rows.append((centre + rng.normal(size=24) * rng.choice([0.02, 0.1, 0.14]), label))
        rows += [(rng.normal(size=24), label) for _ in range(60)]
    rows += [rows[0]] * 9 + [(3 * rows[1][0], 1), (rows[0][0], 2), (rows[0][0], None)]
    rows = [(i, None if v is None else [float(x) for x in np.float32(v)], label) for i, (v, label) in enumerate(rows)]
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [1.0] * 23 + [float("inf")], 1), (904, [None] + [1.0] * 23, 1), (905, [], 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "2 AS key", "3 AS z", "4 AS copies").repartition(3)
    assert sorted(map(tuple, vector_dedup.near_duplicates(df).collect())) == expected(rows, 0.98)


def test_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vector_dedup.near_duplicates(spark.createDataFrame([], kind)).collect() == []
    nulls = vector_dedup.near_duplicates(spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], kind)).collect()
    assert sorted(map(tuple, nulls)) == [(1, 0, 1, True), (2, 0, 2, True)]
    twice = vector_dedup.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (5, [1.0, 0.001], 1)], kind)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in twice if r.vec_id is not None)) == [(4, 3, 4), (4, 3, 4), (5, 0, 4), (5, 3, 4)]


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, queries.QUERIES["op3_vector_dedup"](spark, sf).collect())) == expected(rows, 0.98)
