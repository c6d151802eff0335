"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import in_arrow

RANKS = "byte_bpe_50k.tiktoken"
#: Distinct pieces of text in each of the two generations that a worker remembers, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 150_000, 64


def byte_characters() -> list[str]:
    """A printable character for each byte: bytes that print in Latin-1 are themselves, the others follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class ByteBPE:
    """Encodes and decodes by a file of ranks (base64 token, rank), each match of ``pattern`` on its own."""

    def __init__(self, ranks_file: str, pattern: str = public_tokenizers.PATTERN):
        from tokenizers import models

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        chars = byte_characters()
        shown = {k: "".join(chars[b] for b in k) for k in ranks}
        # any two tokens that make up a third one may merge, with the third one's rank
        merges = [(shown[k[:i]], shown[k[i:]]) for k in sorted(ranks, key=ranks.get) for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks]
        # bytes are mapped to characters here: the library's own steps around its model take more time than the model
        self._tokenize = models.BPE(vocab={shown[k]: v for k, v in ranks.items()}, merges=merges).tokenize
        self._shown = dict(enumerate(chars))
        self._pieces = regex.compile(pattern).findall
        self._bytes = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self._bytes[v] = k
        self._known: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def _learn(self, piece: str) -> tuple[int, ...]:
        """Tokens of a piece that is new or was last seen two generations ago."""
        ids = self._older.get(piece)
        if ids is None:
            ids = tuple(t.id for t in self._tokenize(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._shown)))
        if len(piece) <= REMEMBERED_CHARS:
            if len(self._known) >= REMEMBERED:
                self._older, self._known = self._known, {}
            self._known[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Token ids; null counts as empty."""
        ids: list[int] = []
        known = self._known
        for p in self._pieces(text or ""):
            if (found := known.get(p)) is None:
                found, known = self._learn(p), self._known
            ids += found
        return ids

    def offsets(self, text: str | None) -> list[tuple[int, int]]:
        """For each token the first character that it has a byte of and the end of the last one."""
        out, at, owner = [], 0, []
        for i, c in enumerate(text or ""):
            owner += [i] * len(c.encode("utf-8", "surrogatepass"))
        for i in self.encode(text):
            n = len(self._bytes[i])
            out.append((owner[at], owner[at + n - 1] + 1))
            at += n
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        table = self._bytes
        return b"".join([table[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``; bytes of characters that they hold only in part become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@cache
def coder(ranks_file: str) -> ByteBPE:
    """One coder for each worker and file."""
    return ByteBPE(ranks_file)


def _map(df: DataFrame, schema: str, kept: int, make) -> DataFrame:
    """Rows with their first ``kept`` columns as they are and those that ``make`` gives for a list of the last one."""

    def run(batches):
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            for at in range(0, b.num_rows, 64):  # bounds what is decoded at once when texts are long
                part = b.slice(at, 64)
                yield pa.record_batch([*(part.column(i) for i in range(kept)), *make(part.column(kept).to_pylist())], names)

    return in_arrow(df, run, schema)


def encode(docs: DataFrame, ranks_file: str | None = None, with_offsets: bool = False) -> DataFrame:
    """(doc_id, token_ids) for each row of ``docs``: no special tokens, null and empty texts give an empty list.

    With offsets also (starts, ends): for each token the first code point that it has a byte of, and the end of the last;
    tokens that share a character overlap. Rows that repeat are all returned; extra columns are ignored; a null doc_id is
    returned as it is; strings that look like special tokens are plain text; an empty table gives no rows.
    """
    path = ranks_file or public_tokenizers.path(RANKS)
    lists = pa.list_(pa.int32())

    def make(texts):
        c = coder(path)
        ids = [pa.array([c.encode(t) for t in texts], lists)]
        spans = [c.offsets(t) for t in texts] if with_offsets else []
        return ids + [pa.array([[x[i] for x in s] for s in spans], lists) for i in (0, 1) if with_offsets]

    schema = "doc_id long, token_ids array<int>" + ", starts array<int>, ends array<int>" * with_offsets
    return _map(docs.select(F.col("doc_id").cast("long"), "text"), schema, 1, make)


def decode(tokens: DataFrame, ranks_file: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, token_ids); a null list gives an empty text."""
    path = ranks_file or public_tokenizers.path(RANKS)
    make = lambda lists: [pa.array([coder(path).decode(x or []) for x in lists], pa.string())]
    return _map(tokens.select(F.col("doc_id").cast("long"), "token_ids"), "doc_id long, text string", 1, make)


def round_trip(docs: DataFrame, ranks_file: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of ``docs``, with token_ids if asked for: the number of
    tokens and the digests of the ids and of the bytes that they decode to.

    Null and empty texts have no tokens and the digest of nothing; rows that repeat, or have no id, are all returned; extra
    columns are ignored; an empty table gives no rows.
    """
    path = ranks_file or public_tokenizers.path(RANKS)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def make(texts):
        c = coder(path)
        decimal = _decimals(path)
        lists = [c.encode(t) for t in texts]
        ids = [pa.array(lists, pa.list_(pa.int32()))] if with_ids else []
        return [*ids, pa.array(map(len, lists), pa.int64()), pa.array([sha(" ".join([decimal[i] for i in x]).encode()) for x in lists]), pa.array([sha(c.decode_bytes(x)) for x in lists])]

    schema = "doc_id long, " + "token_ids array<int>, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _map(docs.select(F.col("doc_id").cast("long"), "text"), schema, 1, make)


@cache
def _decimals(path: str) -> list[str]:
    return [str(i) for i in range(len(coder(path)._bytes))]
