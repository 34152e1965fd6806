import random
import tracemalloc

import brute
import pytest
from tokenizers import Tokenizer

from fairlead.llm import bpe, queries

PIECES = ["abcdefgh th e", "aaaa", "the ing er on", "éàü", "日本語", " \n\t", "0123456789", "'s't're've", "-=_", "\u3000 x", "ſ\u212a", "\U0001f600", "\0", "<|endoftext|>"]


@pytest.fixture(scope="module")
def both():
    path = queries.vocabulary()
    return bpe.Vocabulary.load(path), Tokenizer.from_file(path)


def random_texts(rng, n):
    for k in range(n):
        yield "".join(rng.choice(rng.choice(PIECES)) if rng.random() < 0.97 else rng.choice(PIECES) for _ in range(rng.choice([0, 1, 5, 50, 600])))
        if k % 20 == 0:
            yield "".join(rng.choice("etaoinshrdlu") for _ in range(3000))


@pytest.mark.parametrize("block", [1, 8, 4096])
def test_same_as_the_library(both, block):
    v, library = both
    encoder = bpe.Encoder(v, block=block, most_words=50)
    for text in random_texts(random.Random(block), 250):
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids
        assert "".join(bpe.decode([ids[i:i + 3] for i in range(0, len(ids), 3)], v.parts)) == library.decode(ids, skip_special_tokens=False) == text


def test_many_rare_words_are_merged_once(both):
    """As many different words as a task meets in a file: what comes again is remembered, and short merges are all merges."""
    v, _ = both
    encoder, calls = bpe.Encoder(v), []
    word = encoder.word
    encoder.known.encode = lambda piece: calls.append(piece) or (piece, "", b"")
    words = [f" w{i}" for i in range(140_000)]
    for piece in words + words:
        encoder.known[piece]
    assert len(calls) == len(words)
    for piece in words[:3000] + PIECES:
        assert word(piece) == bpe.merge_all([v.of_byte[b] for b in piece.encode()], v.ranks)


def test_stream_holds_a_bounded_rest(both):
    v, _ = both
    encoder = bpe.Encoder(v, block=64)
    rng, sent, got = random.Random(0), bytearray(), 0

    def parts():
        for _ in range(400):
            part = bytes(rng.choice(b"etaoinshrdlu") for _ in range(rng.randrange(1, 40)))
            sent.extend(part)
            yield part

    most = 0
    for i in encoder.stream(parts()):
        got += len(v.parts[i])
        most = max(most, len(sent) - got)
    assert got == len(sent) and most <= 64 + encoder.ahead + 40 + 64
    whole = bpe.merge_all([v.of_byte[b] for b in bytes(sent)], v.ranks)
    assert list(encoder.stream([bytes(sent)])) == whole == list(encoder.stream(bytes(sent)[i:i + 1] for i in range(len(sent))))


def test_decoder_is_lossy_like_utf8(both):
    rng = random.Random(4)
    for _ in range(3000):
        data = bytes(rng.choice(b"a\xc3\xa9\xe6\x97\xa5\xf0\x9f\x98\x80\xff\xed\xa0\x80") for _ in range(rng.randrange(12)))
        state, out, at = bpe.TextState(), [], 0
        while at < len(data):
            n = rng.randrange(1, 4)
            out.append(state.feed(data[at:at + n]))
            assert len(state.rest) <= 3
            at += n
        assert "".join([*out, state.feed(b"", last=True)]) == data.decode("utf-8", "replace")


def test_every_text_goes_through_in_blocks(both):
    """Ids of a text leave in lists of bounded length, words are forgotten, and no list or cache grows with the text."""
    v, library = both
    encoder, rng = bpe.Encoder(v, most_words=100, block=64), random.Random(9)
    text = "".join(rng.choice(["the ", "x" * 5000, "\u65e5\u672c", " \n ", "word%d " % rng.randrange(500)]) for _ in range(3000)) + "y" * 40_000 + "<|endoftext|>z"
    lists = list(encoder.ids_of(text))
    assert [i for some in lists for i in some] == library.encode(text, add_special_tokens=False).ids
    assert len(lists) > 100 and max(map(len, lists)) <= 32 * 64 and len(encoder.known) + len(encoder.known.old) <= 200
    n, ids, again, same, _ = bpe.told_of(encoder, text)
    assert n == sum(map(len, lists)) and same and again == brute.sha(text)


@pytest.mark.parametrize("unit", ["the word and ", "a", "\u65e5"])
def test_memory_does_not_follow_the_text(both, unit):
    v, _ = both
    encoder = bpe.Encoder(v)
    most = []
    for size in (50_000, 500_000):
        text = unit * (size // len(unit))
        tracemalloc.start()
        assert bpe.told_of(encoder, text)[3]
        most.append(tracemalloc.get_traced_memory()[1] / len(text.encode()) * size)
        tracemalloc.stop()
    # A piece without any white space in it is held as text, and as bytes: a few times its own size, and no ids.
    assert most[1] < (2 * most[0] if " " in unit else 12 * 500_000 * len(unit.encode()))


def check(library, docs, told):
    want = []
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False)), True))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.round_trip) for r in told) == sorted(want)


def test_query_and_odd_rows(spark, sf, odd, empty, both):
    check(both[1], spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), queries.QUERIES["op7_bpe"](spark, sf).collect())
    check(both[1], odd.select("doc_id", "text").collect(), bpe.encode_documents(odd, queries.vocabulary()).collect())
    assert bpe.encode_documents(empty, queries.vocabulary()).collect() == []
