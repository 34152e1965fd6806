import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from conftest_llm import documents_of

from fairlead.llm import queries, spelling
from fairlead.llm.shared import written

RUN = re.compile("[a-zÀ-ÿ]+")
COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def counts(rows):
    out = Counter()
    for i, text in rows:
        for run in RUN.findall((text or "").translate(brute.LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    return out


def plain(rows, least=6, often=5, times=5):
    n = {w: c for w, c in counts(rows).items() if len(w) >= least and c >= often}
    by, near = {}, {w: [] for w in n}
    for w in n:
        for d in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            by.setdefault(d, set()).add(w)
    for group in by.values():
        for w in group:
            near[w] += [v for v in group if one_edit(w, v)]
    near = {w: set(v) for w, v in near.items()}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= times * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def told(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert told(queries.QUERIES["op13_spelling_variants"](spark, sf)) == plain([tuple(r) for r in rows])


def variants(rng, n):
    """Texts of words from a small alphabet, so that many are near, in chains of rising counts."""
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(60)] + ["x" * 40 + "é", "x" * 40, "x" * 41, "y" * 70 + "z", "y" * 70, "y" * 71 + "z"]
    text = [w for k, w in enumerate(words) for _ in range(rng.choice([4, 5, 6, 30, 160]))] + ["chaina"] * 7 + ["chainab"] * 50 + ["chainabc"] * 300
    rng.shuffle(text)
    return [(i, rng.choice([" ", "-", "× ", "\n"]).join(text[i::n]).upper() if i % 3 else " ".join(text[i::n])) for i in range(n)]


@pytest.mark.parametrize("most_bytes", [64 << 20, 4096])
def test_same_as_all_pairs(spark, most_bytes):
    rows = variants(random.Random(most_bytes), 40)
    docs = documents_of(spark, [(i, t, "en", "s") for i, t in rows])
    found = told(spelling.spelling_variants(docs, most_bytes=most_bytes))
    assert found == plain(rows) and any(r[2] not in (r[0], r[1]) for r in found)


def test_odd_rows(spark, odd, empty):
    assert told(spelling.spelling_variants(odd, least_count=1)) == plain([(r.doc_id, r.text) for r in odd.collect()], often=1)
    assert told(spelling.spelling_variants(empty)) == []


def test_one_word_in_a_third_of_all_places(spark):
    rows = [(i, "common " * 40 + f"comman comon other{'abcdefgh'[i % 8]}") for i in range(300)] + [(None, "commons " * 9)]
    assert told(spelling.spelling_variants(documents_of(spark, [(i, t, None, None) for i, t in rows]))) == plain(rows)


def test_counts_are_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(spelling, "MOST_WORDS", 3)
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 200))) for _ in range(50))) for i in range(30)]
    seen, total = spelling.Counts(1), Counter()
    for i, text in rows:
        seen.add([i], [text.encode()], most=7)
        for batch in seen.given():
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                total[word] += n
    assert +total == +counts(rows)


def test_filters_hold_every_word_in_rounds_of_bounded_size(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcdefghij") for _ in range(rng.randrange(6, 10))) for _ in range(3000)})
    hashes = np.array([spelling.hash_of(w.encode()) for w in words], np.uint64)
    table = written(spark.createDataFrame([(w, 5, len(w), int(h)) for w, h in zip(words, hashes.view(np.int64))], "word string, n long, size int, h long"))
    held = Counter(map(len, words))
    rounds, parts = spelling.rounds_of(dict(held), 1024)
    assert len(rounds) > 1 and max(parts.values()) > 1
    seen = np.zeros(len(words), int)
    for shards in rounds:
        filters = spelling.filters_of(table, shards, parts)
        assert filters.data.nbytes <= 32768 and sum(b for _, b in shards.values()) * 8 <= 1024
        for size in held:
            some = [k for k, w in enumerate(words) if len(w) == size]
            seen[some] += filters.holds(hashes[some], size)
    assert (seen == 1).all()


def test_blocks_end_between_words():
    text = "ab cd efgh i " * 50 + "z" * 300
    assert "".join(spelling.blocks(text, 20)) == text
    assert [w for b in spelling.blocks(text, 20) for w in RUN.findall(b)] == RUN.findall(text)
