import random

import brute
import pyarrow as pa
import pytest
from conftest_llm import documents_of

from fairlead.llm import ngram_join, queries, shingles
from fairlead.llm.components import components


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect() if r[0] is not None)


def family(rng, n, words, edits, name):
    """Texts that differ from one another in a few words."""
    base = [f"{name}{rng.randrange(300)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("percent", [80, 50])
def test_same_as_all_pairs(spark, percent):
    rng = random.Random(percent)
    passage = " ".join(f"common{i}" for i in range(60))
    texts = family(rng, 40, 90, 6, "a") + family(rng, 25, 30, 2, "b") + family(rng, 15, 200, 12, "c")
    texts += [f"{t} {passage}" for t in family(rng, 10, 40, 40, "d")] + [" ".join(rng.choices("uvwxyz", k=rng.randrange(1, 12))) for _ in range(40)]
    texts += texts[:12]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    assert rows_of(ngram_join.similar_components(documents_of(spark, rows), percent)) == brute.similar([r[:2] for r in rows], percent)


def test_odd_rows(odd):
    found = rows_of(ngram_join.similar_components(odd))
    assert found == brute.similar([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    by_id = {r[0]: r for r in found}
    assert by_id[1] == (1, 0, 1) and by_id[6] == (6, 1, 4) and by_id[8][2] == 7
    nulls = [r for r in ngram_join.similar_components(odd).collect() if r.doc_id is None]
    assert sorted((r.n_shingles, r.component_id) for r in nulls if r.component_id is not None) == [(1, 4)] and len(nulls) == 2


def test_empty(empty):
    assert ngram_join.similar_components(empty).collect() == []


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(queries.QUERIES["op1_ngram_join"](spark, sf)) == brute.similar([tuple(r) for r in docs])


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (300, 300)]
    want = brute.joined({x for e in edges if e[0] != e[1] for x in e}, edges[:-1])
    assert {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_words_over_several_blocks(monkeypatch):
    """Hashes do not depend on where blocks of bytes end, and a long text leaves nothing behind."""
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(30))) for _ in range(50)] + ["x" * 5000, "", None]
    data, offsets = shingles.bytes_of(pa.array(texts))
    want = shingles.words_of(data, offsets)
    for block in (1, 7, 64, 1000):
        monkeypatch.setattr(shingles, "BLOCK", block)
        for a, b in zip(shingles.words_of(data, offsets), want):
            assert (a == b).all()
