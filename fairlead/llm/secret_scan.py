"""Secret scans: every text is searched, then each layer that can be decoded out of it, until nothing new appears.

A layer is a text decoded from another one: its escapes (%41, \\u0041, &#65; ...) replaced in place, or what a base64 run,
possibly compressed, holds. Each content is searched once in a document, but counts at every place it is met at: its finds
go to all contents that hold it, through the offsets of each place, up to the document. Only new finds are passed on, so
that layers which decode to each other, or to themselves, end.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import partial
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame

from fairlead.llm.shared import map_text

KINDS = ("assign", "access", "hex")

#: The three patterns; `assign` counts where group 2 has 12 characters, `access` from 18, `hex` from 16.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

ESCAPE = re.compile(
    r"(?P<url>(?:%[0-9A-Fa-f]{2})+)"
    r"|(?P<unicode>(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})"
    r"|(?P<entity>&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});)"
)
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: The same where the text has line feeds: runs that go on behind one, or are long enough without.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]++(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++|[A-Za-z0-9+/_-]{16,}+)={0,2}")
#: How compressed data begins.
MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")
#: Bytes without such a stretch hold no match, and no escapes or run that lead to one.
PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]{16,}|" + MAGIC.pattern)
#: Up to the last byte that is in no match, escape or run.
APART = re.compile(rb".*[^A-Za-z0-9+/_.=:\"'%\\{}&#;\x20\t\r\n-]", re.DOTALL)
#: Bytes that are unpacked at a time, and from which on a stream is searched in windows.
BLOCK, WINDOW = 1 << 16, 4 << 20

Children = Iterator[tuple["Node", str, "Node", Callable[[int, int], tuple[int, int]]]]

Span = tuple[int, str, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of every match in this text alone. The lower bounds in ACCESS and HEX take the same matches as
    dropping short ones would, since these runs end only where their characters do; ASSIGN has to drop afterwards."""
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


class Node:
    """One content: the spans found in it so far, in its own offsets, and each place it was met at, as the content that
    holds it and a function that maps offsets to there. A binary one has a character for each byte, which is as good as the
    text: all that is searched for is ASCII."""

    def __init__(self, binary: bool = False):
        self.binary, self.spans, self.places = binary, set(), []


def add(node: Node, spans: set[Span]) -> None:
    """Adds spans to a content and to all that hold it, through the offsets of every place; cycles end, as nothing is
    added twice."""
    work = [(node, spans)]
    while work:
        node, spans = work.pop()
        if fresh := spans - node.spans:
            node.spans |= fresh
            work += [(holder, {((at := place(a, b))[0], kind, at[1]) for a, kind, b in fresh}) for holder, place in node.places]


def meet(child: Node, holder: Node, place: Callable[[int, int], tuple[int, int]]) -> None:
    child.places.append((holder, place))
    add(holder, {((at := place(a, b))[0], kind, at[1]) for a, kind, b in child.spans})


def unescaped(text: str) -> tuple[str, Callable[[int, int], tuple[int, int]]] | None:
    """The text with its escapes replaced by what they stand for, or None if it has none that decode. Piece i starts at
    at[i] there and stands for source[i] .. source[i] + width[i] here; step[i] is 1 where characters pair up and 0 where
    the piece stands for its source as a whole."""
    pieces, at, source, width, step = [], [], [], [], []
    done, size = 0, 0

    def put(part: str, start: int, end: int, paired: int) -> None:
        nonlocal size
        if part:
            at.append(size), source.append(start), width.append(end - start), step.append(paired)
            pieces.append(part)
            size += len(part)

    for m in ESCAPE.finditer(text):
        for part, start, end in decoded_escape(m):
            put(text[done:start], done, start, 1)
            put(part, start, end, 0)
            done = end
    if not done:
        return None
    put(text[done:], done, len(text), 1)

    def place(start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(at, start) - 1, bisect_right(at, end - 1) - 1
        return source[i] + step[i] * (start - at[i]), source[j] + (end - at[j] if step[j] else width[j])

    return "".join(pieces), place


def decoded_escape(m: re.Match) -> Iterator[tuple[str, int, int]]:
    """The characters of one run of escapes, each with the place of its own escape; nothing where it doesn't decode."""
    raw, start = m[0], m.start()
    try:
        if m["url"]:
            data, i = bytes.fromhex(raw.replace("%", "")), 0
            while i < len(data):
                n = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
                try:
                    yield data[i:i + n].decode("utf-8"), start + 3 * i, start + 3 * (i + n)
                except UnicodeDecodeError:
                    n = 1
                i += n
        elif m["entity"]:
            yield checked(chr(int(raw[3:-1], 16) if raw[2] in "xX" else int(raw[2:-1]))), start, m.end()
        elif raw.startswith("\\u{"):
            yield checked(chr(int(raw[3:-1], 16))), start, m.end()
        elif raw[1] == "u":
            units, i = [int(raw[k + 2:k + 6], 16) for k in range(0, len(raw), 6)], 0
            while i < len(units):
                pair = 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000
                code = 0x10000 + ((units[i] - 0xD800) << 10) + units[i + 1] - 0xDC00 if pair else units[i]
                if not 0xD800 <= code < 0xE000:
                    yield chr(code), start + 6 * i, start + 6 * (i + 1 + pair)
                i += 1 + pair
        else:
            yield checked(chr(int(raw[2:], 16))), start, m.end()
    except (ValueError, OverflowError):
        return


def checked(char: str) -> str:
    if "\ud800" <= char <= "\udfff":
        raise ValueError(char)
    return char


def unpacked(text: str, node: Node) -> Children:
    """What the base64 runs of the text hold, read from each of their first four characters on, as they may be glued to
    others, and across line feeds. Where a run on one line is text as it stands, its finds take the whole run; other
    finds take the groups of four characters they lie in."""
    for m in (WRAPPED if "\n" in text else RUN).finditer(text):
        lines = [(n.start(), n.end()) for n in LINE.finditer(m[0])]
        clean = "".join(m[0][a:b] for a, b in lines).replace("-", "+").replace("_", "/")
        if len(clean) < 16:
            continue
        ends = [(m.start() + a, m.end() if b == lines[-1][1] else m.start() + b) for a, b in lines]
        at = [0, *accumulate(b - a for a, b in lines)][:-1]
        runs = []
        for i, (a, b) in enumerate(lines):
            if b - a >= 16 and (b - a) % 4 != 1:
                data = decoded(clean[at[i]:at[i] + b - a])
                if PRINTABLE.search(data) and is_text(data):
                    runs.append((at[i], at[i] + b - a, ends[i]))
                    yield Node(True), data.decode("latin-1"), node, lambda a, b, run=ends[i]: run
        for shift in range(4):
            if len(lines) == 1 and runs and not shift:
                continue
            data = decoded(clean[shift:])
            if PRINTABLE.search(data):
                yield Node(True), data.decode("latin-1"), node, partial(place_in_run, shift, len(clean), at, ends, runs)


def decoded(run: str) -> bytes:
    """A last character that is alone in its group holds no byte."""
    run = run[:-1] if len(run) % 4 == 1 else run
    return base64.b64decode(run + "=" * (-len(run) % 4))


def place_in_run(shift: int, size: int, at: list[int], ends: list[tuple[int, int]], runs: list[tuple[int, int, tuple[int, int]]], start: int, end: int) -> tuple[int, int]:
    """Where bytes start .. end lie that were read from character `shift` of a run on: lines begin at at[i] of the run
    and reach over ends[i] of the text. Those that `runs` has as text of their own, in the same groups, are taken whole."""
    first, last = shift + start // 3 * 4, min(size, shift - (-end // 3) * 4)
    for a, b, whole in runs:
        if a <= first and last <= b and (a - shift) % 4 == 0:
            return whole
    i, j = bisect_right(at, first) - 1, bisect_right(at, last - 1) - 1
    return ends[i][0] + first - at[i], ends[j][1] if last == size else ends[j][0] + last - at[j]


def is_text(data: bytes) -> bool:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return sum(1 for c in text if c < " " and c not in "\t\n\r") * 10 <= len(text)


def expanded(text: str, node: Node) -> Children:
    """What compressed streams in these bytes hold. All members of a stream are one text, as for the tools that unpack it.
    It is searched in windows, whose finds count for the stream as a whole, once its end is known."""
    data, at = text.encode("latin-1"), 0
    while m := MAGIC.search(data, at):
        stream, source = Node(), Members(data[i:i + BLOCK] for i in range(m.start(), len(data), BLOCK))
        for window in windows(chained(source)):
            if PRINTABLE.search(window):
                yield Node(True), window.decode("latin-1"), stream, lambda a, b: (0, 1)
        end = m.start() + source.taken if source.whole else len(data)
        meet(stream, node, lambda a, b, span=(m.start(), end): span)
        at = end if source.whole else m.start() + 1


class Members:
    """The blocks that the members of a compressed stream hold, one member after the other, with zeros between them left
    out. `whole` says that a member came to its end, `taken` how many bytes the last such member and those before it have;
    what is no member ends the stream. What a broken or cut off member gives before it breaks counts too."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.left, self.pulled, self.taken, self.whole = pieces, b"", 0, 0, False

    def more(self, least: int = 1) -> bool:
        while len(self.left) < least and (piece := next(self.pieces, None)) is not None:
            self.left += piece
            self.pulled += len(piece)
        return len(self.left) >= least

    def __iter__(self) -> Iterator[bytes]:
        while self.more(10) or self.left:
            if self.whole and self.left[0] == 0:
                self.left = self.left.lstrip(b"\0")
                continue
            if (packed := decompressor(self.left)) is None:
                return
            try:
                yield from self.member(packed)
            except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError):
                return
            if not packed.eof:
                return
            self.whole, self.left = True, packed.unused_data + self.left
            self.taken = self.pulled - len(self.left)

    def member(self, packed) -> Iterator[bytes]:
        fed, full = b"", False
        while not packed.eof:
            if not fed and not full:
                if not self.more():
                    return
                fed, self.left = self.left[:BLOCK], self.left[BLOCK:]
            out = packed.decompress(fed, BLOCK)
            fed = getattr(packed, "unconsumed_tail", b"")
            full = len(out) == BLOCK or not getattr(packed, "needs_input", True)
            if out:
                yield out


def chained(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The blocks, with compression removed from a long stream as often as it was applied. Short ones come back as they
    are, for the search of all places in them; so do those that unpack to their own beginning."""
    seen = set()
    while True:
        blocks, first = iter(blocks), b""
        while len(first) <= WINDOW and (block := next(blocks, None)) is not None:
            first += block
        blocks = chain([first] if first else [], blocks)
        mark = hashlib.sha256(first).digest()
        if len(first) <= WINDOW or not MAGIC.match(first) or mark in seen:
            return blocks
        seen.add(mark)
        blocks = Members(blocks)


def windows(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The stream in windows that end where nothing searched for can lie across, which is after a byte that no pattern,
    escape or base64 run takes. Where none comes the window grows until one does: nothing is cut in two."""
    parts, size = [], 0
    for block in blocks:
        parts.append(block)
        size += len(block)
        if size >= WINDOW and (m := APART.match(block)):
            yield b"".join([*parts[:-1], block[:m.end()]])
            parts, size = [block[m.end():]], len(block) - m.end()
    if size:
        yield b"".join(parts)


def decompressor(data: bytes):
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(data) > 2 and data[0] == 0x78 and (data[0] << 8 | data[1]) % 31 == 0:
        return zlib.decompressobj(15)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans of the text, and those together with what its layers add, both sorted by start, then kind as listed."""
    base, root = base_spans(text), Node()
    add(root, set(base))
    known, work = {content_key(text): root}, [layers_of(text, root)]
    while work:
        if (met := next(work[-1], None)) is None:
            work.pop()
            continue
        child, inner, holder, place = met
        if (node := known.setdefault(content_key(inner), child)) is child:
            add(child, set(base_spans(inner)))
            work.append(layers_of(inner, child))
        meet(node, holder, place)
    order = lambda s: (s[0], KINDS.index(s[1]), s[2])
    return sorted(base, key=order), sorted(root.spans, key=order)


def content_key(text: str) -> str | bytes:
    return text if len(text) < 64 else hashlib.sha256(text.encode()).digest()


def layers_of(text: str, node: Node) -> Children:
    if (whole := unescaped(text)) is not None:
        yield Node(), whole[0], node, whole[1]
    yield from unpacked(text, node)
    if node.binary:
        yield from expanded(text, node)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every span replaced by the mark; spans that touch or overlap get one mark."""
    out, done, last = [], 0, -1
    for start, _, end in spans:
        if start > last:
            out += [text[done:start], mark]
        done = last = max(last, end)
    return "".join(out) + text[done:]


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), redacted: bool = False) -> DataFrame:
    """One row per row of docs: the kept columns, n_assign, n_access and n_hex (base matches), base_sha256, spans (base and
    decoded ones as kind:start:end, code points), n_decoded, and with `redacted` also the text without its secrets.

    A null text counts as empty; whole texts of any length are searched; repeated rows stay; an empty table gives no
    rows; columns that are not kept are never read. What a run unpacks to is searched to its end, in windows, whatever its
    size: a bomb costs its time."""
    slim = docs.select(*keep, docs[text].alias("_text"))

    def start():
        def each(batch: pa.RecordBatch) -> dict:
            rows, texts = [], [t or "" for t in batch.column("_text").to_pylist()]
            for t in texts:
                base, found = all_spans(t)
                counts = [sum(kind == k for _, kind, _ in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(found), len(found) - len(set(base)), redact(t, found) if redacted else None))
            made = list(zip(*rows, strict=True)) if rows else [[]] * 7
            names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded", "redacted")
            return {k: batch.column(k) for k in keep} | dict(zip(names, map(list, made), strict=True))

        return each

    kinds = dict(slim.dtypes)
    schema = [*(f"`{k}` {kinds[k]}" for k in keep), "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long"]
    return map_text(slim, ", ".join(schema + ["redacted string"] * redacted), start)
