import hashlib

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

import brute
from conftest_llm import documents_of
from fairlead.llm import language_id, secret_scan
from fairlead.llm.queries import vocabulary


def key(r):
    return tuple("" if x is None else str(x) for x in r)


@pytest.mark.parametrize("table", ["given", "odd"])
def test_every_stage(spark, sf, odd, table):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if table == "given" else odd.union(documents_of(spark, [(70 + i, f"the quick brown fox number {i} and some more words here", "en", "a") for i in range(20)])).select(*corpus_pipeline.COLUMNS)
    library = Tokenizer.from_file(vocabulary())
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        out = stage(spark, docs, sf)
        got = sorted(map(tuple, out.collect()), key=key)
        if name == "language_id":
            model = language_id.train(language_id.labelled_sample(docs, 400))
            want = [tuple(r) for r in rows if not model.predict([r.text or ""])[0][2]]
        elif name == "ngram_jaccard_join":
            some = sorted({(r.doc_id, r.text) for r in rows if r.doc_id is not None}, key=key)
            group = {k: c for k, _, c in brute.similar([(k, t) for k, (_, t) in enumerate(some)])}
            stay = {min((some[k][0], hashlib.md5((some[k][1] or "").encode()).hexdigest(), k) for k in group if group[k] == c)[2] for c in set(group.values())}
            want = [min(tuple(r) for r in rows if (r.doc_id, r.text) == some[k]) for k in stay] + [tuple(r) for r in rows if r.doc_id is None]
            assert len({w[0] for w in want}) > 1 and (table == "given" or "\xe9" * 3000 not in {r.text for r in rows} or [w[0] for w in want].count(10) == 2)
        elif name == "secret_scans":
            want = []
            for r in rows:
                spans = secret_scan.all_spans(r.text or "")[1]
                text = None if r.text is None else secret_scan.redact(r.text, spans)
                assert brute.base_spans(text or "") == []
                want.append((r.doc_id, text, r.lang, r.source, len(text) if spans else r.n_chars))
        elif name == "mixing":
            sizes, words, passes = {}, lambda r: len(brute.WORDS.findall(r.text or "")), {}
            for r in rows:
                sizes[r.source] = sizes.get(r.source, 0) + words(r)
            targets = brute.mix_targets(sizes)
            for r in got:
                passes[r] = passes.get(r, 0) + 1
            assert set(passes) <= {tuple(r) for r in rows} and max(passes.values()) <= 2
            for s, target in targets.items():
                taken = sum(n * len(brute.WORDS.findall(r[1] or "")) for r, n in passes.items() if r[3] == s)
                assert abs(taken - target) <= max(words(r) for r in rows if r.source == s) / 2 + 1e-6
            want = got
        else:
            ids = [library.encode(r.text or "", add_special_tokens=False).ids for r in rows]
            want = [(r.doc_id, r.lang, r.source, len(i), brute.sha(",".join(map(str, i))), brute.sha(r.text or ""), True, i) for r, i in zip(rows, ids, strict=True)]
        assert got == sorted(want, key=key), name
        assert name == "bpe" or out.columns == corpus_pipeline.COLUMNS
        docs = out.cache()


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.where("not round_trip").count() == 0 and out.count() > 100


def test_mixing_tells_rows_apart_by_where_their_nulls_are(spark, sf):
    rows = [(1, "one two three", "x", None), (1, "one two three", None, "x")]
    out = corpus_pipeline.mix_sources(spark, documents_of(spark, rows).select(*corpus_pipeline.COLUMNS), sf).collect()
    assert sorted([(r.lang, r.source) for r in out], key=str) == sorted([("x", None), (None, "x"), (None, "x")], key=str)


def test_rows_that_share_only_an_id_all_stay(spark, sf):
    rows = [(1, "one two three four five six", "en", "a"), (1, "quite another text of some more words", "en", "a"), (2, "one two three four five six", "en", "b"), (1, "one two three four five six", "en", "a")]
    out = corpus_pipeline.drop_near_duplicates(spark, documents_of(spark, rows).select(*corpus_pipeline.COLUMNS), sf).collect()
    assert sorted((r.doc_id, r.text[:3]) for r in out) == [(1, "one"), (1, "qui")]
