import brute
import pytest

from conftest_llm import documents_of
from fairlead.llm import quality


def counts(text):
    text = text or ""
    words = brute.WORDS.findall(text)
    lines = [x for x in text.split("\n") if brute.WORDS.search(x)]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def check(docs, rows):
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    want = sorted([(d.doc_id, *counts(d.text)) for d in docs], key=key)
    got = sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows], key=key)
    assert got == want
    assert not any(r.kept and r.base_failed for r in rows)


def test_counts(spark, odd, empty, sf):
    check(odd.select("doc_id", "text").collect(), quality.filtered(odd).collect())
    assert quality.filtered(empty).collect() == []
    texts = ["a b c d e f g h " * 3 + "z", "a " * 9, "x y " * 30, "l1\nl1\n \nl2\nl1\r\nl1\r", "# $ <a> é|", "a b c d e f g h i a b c d e f g h", " ".join(map(str, range(40))) + " " + " ".join(map(str, range(5, 20)))]
    docs = documents_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    check(docs.select("doc_id", "text").collect(), quality.filtered(docs).collect())


def test_keeps_clean_documents_and_drops_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("toxic = 0")
    told = quality.filtered(docs).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in told if r.quality == 1], [r.kept for r in told if r.quality == 0]
    assert sum(good) >= 0.995 * len(good) and sum(bad) <= 0.2 * len(bad)


@pytest.mark.parametrize("level", ["own", "language", "all"])
def test_thresholds_follow_the_group(spark, level):
    words = {"own": 300, "language": 30, "all": 8}[level]
    rows = [(i, " ".join(["abcd" if i % 3 else "abcde"] * 3 + [f"w{i:03d}x{k:02d}" for k in range(25)]), "en", f"s{i % (3 if level == 'language' else 1)}") for i in range(min(words, 300) * 3)]
    rows.append((9999, " ".join(f"{'long' * 40}{k}" for k in range(30)), "en", "s0"))
    rows.append((9998, " ".join(f"{'w' * 5}{k}" for k in range(30)), "xx", None))
    told = {r.doc_id: r.kept for r in quality.filtered(documents_of(spark, rows), own=50).collect()}
    assert not told[9999] and told[9998] and all(told[i] for i in range(20))


def test_sketches_merge_exactly(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    values = quality.with_values(quality.measured(docs))
    one = quality.sketches(values).where("level = 2").select("measure", "bin", "held")
    a, b = (quality.sketches(values.where(f"doc_id % 2 = {k}")).where("level = 2") for k in (0, 1))
    merged = a.union(b).groupBy("measure", "bin").agg({"held": "sum"})
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, merged.collect()))
