"""Chat formatting: conversations rendered through a compiled template, with a loss mask, and read back from the output."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.template import Piece, compile_template, spans

START, END = "<|im_start|>", "<|im_end|>"

TEMPLATE = (
    "{% set open = '<|im_' + 'start|>' %}{% set close = '<|im_' + 'end|>\\n' %}"
    "{% for turn in turns %}{{ open + (turn.role | one_line | escape) }}\n"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}"
    "{{ close }}{% endfor %}"
)


def escape(text: str) -> str:
    """`<`, any number of backslashes and `|` get one backslash more, so that no control string can be in the result."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text or "")


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def one_line(text: str) -> str:
    """Roles are ended by a line feed, so theirs are spelled out."""
    return (text or "").replace("\\", "\\\\").replace("\n", "\\n")


def from_one_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


FILTERS = {"escape": escape, "one_line": one_line}


def render(turns: Iterable[dict[str, str]], template: str = TEMPLATE) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of turns ({role, text}), and the ranges a model is trained on."""
    return spans(compile_template(template, FILTERS)(turns=turns))


def parse_formatted(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns that a formatted text was made of."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = text.index("\n", at)
        close = text.index(END, line + 1)
        out.append((from_one_line(unescape(text[at + len(START):line])), unescape(text[line + 1:close])))
        at = close + len(END) + 1
    return out


class Reader:
    """Reads formatted pieces back, a turn at a time, and keeps digests only: memory follows the longest turn."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.waiting, self.marked = [], []

    def feed(self, pieces: Iterable[Piece]) -> None:
        """Takes pieces that end with a turn."""
        text, marked = spans(pieces)
        for role, said in parse_formatted(text):
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
        for start, end in marked:
            plain = unescape(text[start:end])
            self.loss.update(plain.encode())
            self.loss_chars += len(plain)
        self.formatted_chars += len(text)

    def row(self) -> dict:
        return {"n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.formatted_chars}


def format_conversations(turns: DataFrame, template: str = TEMPLATE, group: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", formatted: bool = False) -> DataFrame:
    """One row per conversation: what `Reader` reads back from its formatted text, and with `formatted` also that text and
    the ranges under the loss mask (as start:end, code points).

    Rows of a conversation follow their turn, equal turns by role, then text; null turns come first. A null text or role
    counts as empty. A null id is a conversation of its own. Repeated rows are repeated turns. Without `formatted`, the
    rows of a conversation are streamed in order through one task that keeps digests and one turn; that one task is due
    to the hash over all turns. An empty table gives no rows; other columns are not read."""
    kind = dict(turns.dtypes)[group]
    slim = turns.select(F.col(group).alias("id"), F.col(order).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    dealt = slim.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    columns = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"] + ["formatted", "loss_spans"] * formatted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = compile_template(template, FILTERS)
        reader, now, begun, all_pieces = Reader(), None, False, []
        done: dict[str, list] = {c: [] for c in ["id", *columns]}

        def close() -> None:
            row = reader.row() | {"id": now}
            if formatted:
                whole, marked = spans(all_pieces)
                row |= {"formatted": whole, "loss_spans": ",".join(f"{a}:{b}" for a, b in marked)}
            for c in done:
                done[c].append(row[c])

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(done[f.name], type=f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for i, r, t in zip(*(batch.column(c).to_pylist() for c in ("id", "role", "text")), strict=True):
                if not begun or i != now:
                    if begun:
                        close()
                    reader, now, begun, all_pieces = Reader(), i, True, []
                pieces = list(draw(turns=[{"role": r, "text": t}]))
                reader.feed(pieces)
                if formatted:
                    all_pieces += pieces
            if len(done["id"]) > 1000:
                yield made()
                done = {c: [] for c in done}
        if begun:
            close()
            yield made()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long" + ", formatted string, loss_spans string" * formatted
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return dealt.mapInArrow(run, schema).withColumnRenamed("id", group)
