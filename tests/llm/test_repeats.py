import hashlib
import random

import numpy as np
import pytest
from conftest_llm import documents_of

from fairlead.llm import queries, repeats
from fairlead.llm.suffixes import common_prefixes, suffix_array

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def plain(rows, length=400):
    """(doc_id, text) rows without the bytes that strings met more than once cover, all strings counted."""
    data = [(i, (t or "").encode()) for i, t in rows]
    met = {}
    for _, d in data:
        for p in range(len(d) - length + 1):
            s = hash(d[p:p + length])
            met[s] = met.get(s, 0) + 1
    out = []
    for i, d in data:
        gone = np.zeros(len(d) + 1, int)
        for p in range(len(d) - length + 1):
            if met[hash(d[p:p + length])] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def told(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_arrays(seed):
    rng = random.Random(seed)
    for n in (1, 2, 3, 50, 700):
        text = "".join(rng.choice("ab" if seed % 2 else "abcdefgh\xe9") for _ in range(n // 2))
        text = (text + text[: n // 4] + "a" * (n // 4) + "b" * n)[:n]
        symbols = np.array([ord(c) for c in text], np.int64)
        order = suffix_array(symbols)
        assert order.tolist() == sorted(range(n), key=lambda i: text[i:])
        for lane in (1, 7, 256):
            shared = common_prefixes(symbols, order, 60, lane)
            want = [0]
            for a, b in zip(order[:-1], order[1:]):
                k = 0
                while k < 60 and max(a, b) + k < n and text[a + k] == text[b + k]:
                    k += 1
                want.append(k)
            assert shared.tolist() == want


def test_sliding_least():
    values = np.random.default_rng(1).integers(0, 99, 500).astype(np.uint64)
    for wide in (1, 2, 9, 64, 500):
        assert repeats.sliding_least(values, wide).tolist() == [min(values[i:i + wide]) for i in range(501 - wide)]


def corpus(rng):
    """Texts that share passages of lengths about 40, with edits, copies, runs of one letter and periods."""
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    passage = [" ".join(word() for _ in range(rng.choice([8, 9, 10, 11, 12, 30]))) for _ in range(6)]
    texts = []
    for _ in range(60):
        text = [" ".join(word() for _ in range(rng.randrange(12)))]
        for _ in range(rng.randrange(3)):
            text += [rng.choice(passage), word()]
        texts.append(" ".join(text))
    for t in texts[:15]:
        k = rng.randrange(len(t) + 1)
        texts.append(t[:k] + rng.choice("XYZ") + t[k + 1:])
    return texts + texts[:5] + ["a" * 120, "a" * 55, "ab" * 50 + "c", "abc" * 40, "xyz" + "abc" * 15, "q" * 39, "w" * 40, "w" * 40, None, ""]


@pytest.mark.parametrize("seed, most, together, length, gram", [(1, 1500, 1 << 18, 40, 13), (2, 3, 1 << 18, 41, 20), (3, 1, 64, 40, 13), (4, 2, 100, 41, 20)])
def test_same_as_counting_all_strings(spark, seed, most, together, length, gram):
    texts = corpus(random.Random(seed))
    docs = documents_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    assert told(repeats.without_repeats(docs, length, gram, most, together)) == plain(list(enumerate(texts)), length)


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = told(queries.QUERIES["op11_suffix_array_dedup"](spark, sf))
    assert found == plain([tuple(r) for r in rows])
    assert any(r[2] for r in found)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = told(repeats.without_repeats(odd))
    assert found == plain(rows) and {r[2] > 0 for r in found if r[0] in (7, 8)} == {True}
    assert told(repeats.without_repeats(empty)) == []


def test_a_passage_in_very_many_texts(spark):
    """One key holds more passages than a shard takes; all that stand in one border are different."""
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(70))
    texts = [f"{rng.randrange(10**12)} {passage} {rng.randrange(10**12)}" for _ in range(400)]
    docs = documents_of(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    found = told(repeats.without_repeats(docs, 48, 16, most=20))
    assert found == plain(list(enumerate(texts)), 48) and all(r[2] >= 70 for r in found)
