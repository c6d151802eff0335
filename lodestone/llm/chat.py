"""Chat formatting by a compiled template, with loss masks; the turns can be read back from the output."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.templates import Chunk, compile_template
from lodestone.session import in_arrow

#: A turn: its role, then its text; the text of the assistant is under the loss mask.
TEMPLATE = (
    "{% for m in messages %}<s>{{ m.role | escape }}[INST]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "[/INST]</s>{% endfor %}"
)
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_SPECIAL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\\\|([<\[])\\")


def escape(text: str | None) -> str:
    """``text`` without control strings: a backslash goes behind the first character of each, and backslashes double."""
    return _SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text or "")


def unescape(text: str) -> str:
    """What :func:`escape` was given: of backslashes a pair is one, and one behind a bracket goes."""
    return _ESCAPED.sub(lambda m: m[1] or "\\", text)


class Reader:
    """Reads turns and the text under the loss mask back from formatted output, piece by piece. It sees the output only:
    a turn ends at its last control string, which no text can hold."""

    def __init__(self):
        self.n_turns = self.n_chars = self.n_loss = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self._text: list[str] = []
        self._masked: list[str] = []

    def feed(self, piece: str, masked: bool) -> None:
        self.n_chars += len(piece)
        self._text.append(piece)
        if masked:
            self._masked.append(piece)
        if "</s>" in piece:
            self._turns()

    def _turns(self) -> None:
        done, _, rest = "".join(self._text).rpartition("</s>")
        self._text = [rest]
        for turn in done.split("</s>"):
            m = re.fullmatch(r"<s>(.*?)\[INST\](.*)\[/INST\]", turn, re.S)
            if not m:
                raise ValueError("this is not the output of the template")
            self.n_turns += 1
            self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
        loss = unescape("".join(self._masked))
        self._masked.clear()
        self.n_loss += len(loss)
        self.loss.update(loss.encode())


def _messages(rows: Iterator[tuple]) -> Iterator[dict]:
    for role, text in rows:
        yield {"role": role or "", "text": text or ""}


def formatted(messages: Iterable[dict], template: str = TEMPLATE) -> Iterator[Chunk]:
    """The output for ``messages`` (role, text), piece by piece, each with whether it is under the loss mask."""
    return compile_template(template, {"escape": escape})(messages=messages)


def _sorted_rows(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation together and in order: by turn, equal ones by role and text, nulls first."""
    c = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """Groups of rows of one conversation, which may go on through batches; only one batch is held."""

    def rows():
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                yield from zip(*(c.to_pylist() for c in b.slice(at, 1000).columns), strict=True)

    from itertools import groupby

    for conv_id, group in groupby(rows(), key=lambda r: r[0]):
        yield conv_id, ((r[2], r[3]) for r in group)


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, loss_spans): the whole output of each conversation and its character spans under the mask.

    Null roles and texts count as empty; rows of a null conv_id are one conversation; turns that repeat or tie are all
    formatted, in the order of role and text. No rows give no rows; extra columns are ignored.
    """
    schema = "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>"

    def run(batches):
        from lodestone.llm.templates import spans

        for conv_id, rows in _conversations(batches):
            text, found = spans(formatted(_messages(rows), template))
            yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "formatted": text, "loss_spans": [{"start": a, "end": b} for a, b in found]}], schema=pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

    return in_arrow(_sorted_rows(conversations), run, schema)


def digest_conversations(conversations: DataFrame) -> DataFrame:
    """Per conversation the counts and digests of what :class:`Reader` reads back from the output of TEMPLATE.

    Nulls, ties, repeated and no rows: as in :func:`format_conversations`. Output is hashed as it is rendered, so that a
    conversation of any length takes the memory of its longest turn.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        out = []

        def flushed():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], names)

        for conv_id, rows in _conversations(batches):
            r = Reader()
            for piece, masked in formatted(_messages(rows)):
                r.feed(piece, masked)
            out.append((conv_id, r.n_turns, r.turns.hexdigest(), r.n_loss, r.loss.hexdigest(), r.n_chars))
            if len(out) == 2000:
                yield flushed()
                out.clear()
        if out:
            yield flushed()

    return in_arrow(_sorted_rows(conversations), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
