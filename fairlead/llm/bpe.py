"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding by a byte-to-text state machine."""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fairlead.llm.shared import map_text

#: Fixed value: the split pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such vocabularies: printable Latin-1 for itself, the others
    numbered from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Above any id; and a rank that no merge has.
WIDE = 1 << 24
NONE = 1 << 60


@dataclass
class Vocabulary:
    """ranks: a pair of ids to rank * WIDE + id of both together. parts: id to its bytes. special: strings that are one
    token."""

    ranks: dict[tuple[int, int], int]
    parts: dict[int, bytes]
    of_byte: list[int]
    special: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters, ids = byte_letters(), told["model"]["vocab"]
        raw = lambda token: bytes(letters[c] for c in token)
        ranks = {}
        for rank, pair in enumerate(told["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks[ids[a], ids[b]] = rank * WIDE + ids[a + b]
        parts = {i: raw(token) for token, i in ids.items()}
        special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        parts |= {i: text.encode() for text, i in special.items()}
        return cls(ranks, parts, [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], special)

    def by_rank(self) -> tuple[dict[tuple[int, int], int], list[int]]:
        """The merge list once more, in numbers of one machine digit: a pair of ids to its place, and by place the id of
        both together."""
        order = sorted(self.ranks.items(), key=lambda x: x[1])
        return {pair: place for place, (pair, _) in enumerate(order)}, [merge % WIDE for _, merge in order]

    def lookahead(self) -> int:
        """Bytes to the right of a token's end that can decide whether it stands.

        Let t be made of (a, b) by a merge of rank r. To its right, t's forming can only be prevented when b is taken by
        an earlier merge (b, c), which has to be known: that needs c and, by the same argument, what decides c. Merges
        that c waits for have smaller ranks, so one pass by rank computes need[t] = max(need[b], |c| + need[c]) over
        merges (b, c) below r, and need[a] - |b|. A standing token may still be merged with a right neighbour by any
        rank, hence the largest of need[t] and |c| + need[c] over all pairs (t, c)."""
        need: dict[int, int] = defaultdict(int)
        so_far: dict[int, int] = defaultdict(int)  # by left part b: the largest |c| + need[c] of the merges seen
        for (a, b), merge in sorted(self.ranks.items(), key=lambda x: x[1]):
            t = merge % WIDE
            need[t] = max(need[t], need[b], so_far[b], max(need[a], so_far[a]) - len(self.parts[b]))
            so_far[a] = max(so_far[a], len(self.parts[b]) + need[b])
        return max((max(need[t], so_far[t]) for t in self.parts), default=0)


def merge_all(ids: list[int], ranks: dict[tuple[int, int], int]) -> list[int]:
    """Applies the lowest-ranked pair, leftmost first, until no pair merges."""
    if len(ids) < 80:
        get = ranks.get
        order = [get(pair, NONE) for pair in zip(ids, ids[1:])]
        while order:
            best = min(order)
            if best == NONE:
                break
            at = order.index(best)
            ids[at] = best % WIDE
            del ids[at + 1], order[at]
            if at < len(order):
                order[at] = get((ids[at], ids[at + 1]), NONE)
            if at:
                order[at - 1] = get((ids[at - 1], ids[at]), NONE)
        return ids
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap = [(ranks[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
    heapify(heap)
    end = len(ids)
    while heap:
        merge, i, pair = heappop(heap)
        j = after[i]
        if ids[i] != pair[0] or j >= end or ids[j] != pair[1]:
            continue
        ids[i], ids[j], after[i] = merge % WIDE, -1, after[j]
        if after[j] < end:
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < end and (got := ranks.get((ids[left], ids[right]))):
                heappush(heap, (got, left, (ids[left], ids[right])))
    return [i for i in ids if i >= 0]


def merge_short(ids: list[int], places: dict[tuple[int, int], int], made: list[int]) -> list[int]:
    """merge_all for a few ids, by Vocabulary.by_rank."""
    get, none = places.get, len(made)
    order = [get(pair, none) for pair in zip(ids, ids[1:])]
    while order:
        best = min(order)
        if best == none:
            break
        at = order.index(best)
        ids[at] = new = made[best]
        del ids[at + 1], order[at]
        if at < len(order):
            order[at] = get((new, ids[at + 1]), none)
        if at:
            order[at - 1] = get((ids[at - 1], new), none)
    return ids


class Words(dict):
    """What is known of pieces. Two generations: when the young one is full it becomes the old one, and what is asked for
    again comes back, so that frequent pieces stay and others go. At most 2 * most of them are held."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, piece: str) -> tuple[tuple[int, ...], str, bytes]:
        found = self.old.get(piece) or self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


#: Where no piece goes on: between a character and white space behind it, as pieces hold white space at their start only.
CUT = regex.compile(r"(?<=\S)(?=\s)")


class Encoder:
    """The transducer from text to ids: text comes in blocks, ids leave in lists as soon as nothing that follows can
    change them, and what is held back does not grow. The end of a piece of the split pattern settles its ids; in a piece
    longer than `block` bytes, which runs through `stream`, the lookahead of the merge list does. Short pieces are
    remembered, about `most_words` of them."""

    def __init__(self, vocabulary: Vocabulary, most_words: int = 150_000, block: int = 4096):
        self.v, self.block = vocabulary, block
        self.ahead = vocabulary.lookahead()
        self.places, self.made = vocabulary.by_rank()
        self.decimal = [str(i) for i in range(max(vocabulary.parts) + 1)]
        self.known = Words(lambda piece: self.given(self.word(piece)), most_words)
        self.split, self.find = regex.compile(PATTERN).findall, regex.compile(PATTERN).finditer
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True)) or r"(?!)")

    def stream(self, data: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece that arrives in parts, each as soon as no later byte can change it: a token whose end lies
        at least the lookahead before the end of what has arrived is final, and no merge crosses its end, so that what
        follows can be encoded without it."""
        waiting = bytearray()
        for part in data:
            waiting += part
            if len(waiting) >= self.block + self.ahead:
                sure, size = [], 0
                for i in merge_all([self.v.of_byte[b] for b in waiting], self.v.ranks):
                    size += len(self.v.parts[i])
                    if size > len(waiting) - self.ahead:
                        size -= len(self.v.parts[i])
                        break
                    sure.append(i)
                yield from sure
                del waiting[:size]
        yield from merge_all([self.v.of_byte[b] for b in waiting], self.v.ranks)

    def word(self, piece: str) -> Iterable[int]:
        if len(piece) <= 20 and len(piece) * 4 <= self.block:
            return merge_short([self.v.of_byte[b] for b in piece.encode()], self.places, self.made)
        if len(piece) * 4 <= self.block or len(data := piece.encode()) <= self.block:
            return merge_all([self.v.of_byte[b] for b in piece.encode()], self.v.ranks)
        return self.stream(data[i:i + self.block] for i in range(0, len(data), self.block))

    def given(self, ids: Iterable[int]) -> tuple[tuple[int, ...], str, bytes]:
        """Ids, their decimal text, and the bytes that they stand for: nothing that the garbage collector has to visit."""
        ids = tuple(ids)
        return ids, ",".join([self.decimal[i] for i in ids]), b"".join([self.v.parts[i] for i in ids])

    def pieces(self, text: str, start: int, end: int) -> Iterator[list[tuple[tuple[int, ...], str, bytes]]]:
        """What text[start:end] gives, block by block; blocks end where pieces do."""
        known, step = self.known, 16 * self.block
        while start < end:
            cut = CUT.search(text, min(start + step, end), end)
            stop = cut.start() if cut else end
            if stop - start <= 2 * step:
                yield list(map(known.__getitem__, self.split(text, start, stop)))
            else:  # long without white space: pieces one after the other, and parts of long ones
                held = []
                for m in self.find(text, start, stop):
                    if len(m[0]) <= 64:
                        held.append(known[m[0]])
                    if len(m[0]) > 64 or len(held) >= self.block:
                        yield held
                        held = []
                    ids = iter(self.word(m[0]) if len(m[0]) > 64 else ())
                    while part := list(islice(ids, self.block)):
                        yield [self.given(part)]
                yield held
            start = stop

    def blocks(self, text: str) -> Iterator[list[tuple[tuple[int, ...], str, bytes]]]:
        """What a text gives, in lists of bounded length."""
        done = 0
        if any(s in text for s in self.v.special):
            for m in self.special.finditer(text):
                yield from self.pieces(text, done, m.start())
                yield [self.given([self.v.special[m[0]]])]
                done = m.end()
        yield from self.pieces(text, done, len(text))

    def ids_of(self, text: str) -> Iterator[list[int]]:
        for some in self.blocks(text):
            yield [i for ids, _, _ in some for i in ids]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.ids_of(text)))


class TextState:
    """Bytes to text as they come. It keeps at most three bytes of a character that has begun; bytes that can't belong
    to any character become U+FFFD, one for each longest beginning of one."""

    def __init__(self) -> None:
        self.rest = b""

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.rest + data
        self.rest = b""
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError as wrong:
            if last or wrong.end < len(data) or wrong.reason != "unexpected end of data":
                pass
            else:
                self.rest = data[wrong.start:]
                return data[:wrong.start].decode("utf-8")
        out = []
        while data:
            try:
                out.append(data.decode("utf-8"))
                break
            except UnicodeDecodeError as wrong:
                out.append(data[:wrong.start].decode("utf-8"))
                if not last and wrong.reason == "unexpected end of data":
                    self.rest = data[wrong.start:]
                    break
                out.append("�")
                data = data[wrong.end:]
        return "".join(out)


def decode(ids: Iterable[list[int]], parts: dict[int, bytes]) -> Iterator[str]:
    """The text of lists of ids, list by list; ids outside the vocabulary stand for nothing."""
    state = TextState()
    for some in ids:
        yield state.feed(b"".join([parts.get(x, b"") for x in some]))
    yield state.feed(b"", last=True)


_loaded: dict[str, Vocabulary] = {}


def loaded(path: str) -> Vocabulary:
    """The vocabulary, read once in each worker. The words an encoder remembers are not kept here: they go with the task,
    as other work follows in the same worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary.load(path)
    return _loaded[path]


def told_of(encoder: Encoder, text: str, keep: bool = False) -> tuple[int, str, str, bool, list[int] | None]:
    """Number of ids, digests of ids and of the text decoded from them, whether this is the text again, and with `keep`
    the ids. Encoder, decoder and digests go forward together, block by block."""
    ids, again, state = hashlib.sha256(), hashlib.sha256(), TextState()
    n, at, same, kept = 0, 0, True, []
    for some in encoder.blocks(text):
        decimal = ",".join([d for _, d, _ in some])
        if decimal:
            ids.update(("," + decimal if n else decimal).encode())
            n += decimal.count(",") + 1
        back = state.feed(b"".join([data for _, _, data in some]))
        same = same and text.startswith(back, at)
        at += len(back)
        again.update(back.encode())
        if keep:
            kept += [i for part, _, _ in some for i in part]
    rest = state.feed(b"", last=True)
    again.update(rest.encode())
    return n, ids.hexdigest(), again.hexdigest(), same and at == len(text) and not rest, kept if keep else None


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """One row per row of docs: the kept columns, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (the
    text decoded from the ids, UTF-8), round_trip (whether it is the text again), and with `ids` also the ids.

    vocabulary is the path of a tokenizer file, the same on every machine. A null text counts as empty and has no tokens;
    texts of any length are encoded whole; repeated rows stay; an empty table gives no rows; columns that are not kept
    are never read."""
    slim = docs.select(*keep, docs[text].alias("_text"))

    def start():
        encoder = Encoder(loaded(vocabulary))

        def each(batch: pa.RecordBatch) -> dict:
            told = [told_of(encoder, t.as_py() or "", ids) for t in batch.column("_text")]
            names = ("n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "ids")
            return {k: batch.column(k) for k in keep} | {c: [row[k] for row in told] for k, c in enumerate(names)}

        return each

    kinds = dict(slim.dtypes)
    schema = [*(f"`{k}` {kinds[k]}" for k in keep), "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"]
    return map_text(slim, ", ".join(schema + ["ids array<int>"] * ids), start)
