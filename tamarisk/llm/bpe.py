"""Byte-level BPE: encoding and decoding over Arrow batches with the tokenizers library.

The merges come from a file of ranks. Each byte stands as one printable character inside the library
(its byte-to-character mapping); decoding reverses that table, so ids whose bytes end inside a
character are put together again before the bytes are read as UTF-8.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tamarisk.llm._common import bound_batches

#: Ids handed on at once; a batch of many long texts is passed on in parts.
PART_ROWS = 64
#: Pieces whose ids a worker remembers, and the longest of them in characters.
REMEMBERED, REMEMBERED_CHARS = 300_000, 40
#: Below this code point Python's re splits by classes taken from unicodedata, which no Unicode version has
#: changed there; a text with any higher character is split by the library's own regular expressions.
PLAIN_END = 0x530


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable Latin-1, else the next free one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _parts(token: bytes, rank: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge gives this one: what merging by rank leaves before its own rank."""
    parts = [bytes([b]) for b in token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], 1 << 60))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


@lru_cache(maxsize=4)
def tokenizer_json(path: str, pattern: str) -> str:
    """The tokenizers library's own description of the rank file, made once on the driver."""
    tokens, chars = read_ranks(path), byte_characters()
    shown = ["".join(chars[b] for b in token) for token in tokens]
    rank = {token: i for i, token in enumerate(tokens)}
    merges = [["".join(chars[b] for b in part) for part in _parts(token, rank)] for token in tokens if len(token) > 1]
    model = {"type": "BPE", "vocab": {s: i for i, s in enumerate(shown)}, "merges": merges, "ignore_merges": True, "byte_fallback": False, "fuse_unk": False, "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None}
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    to_chars = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, to_chars]}, "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}, "model": model})


@lru_cache(maxsize=2)
def _loaded(description: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use every core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(description)
    tok.encode_special_tokens = True
    return tok


@lru_cache(maxsize=2)
def _byte_table(description: str) -> list[bytes]:
    """Bytes of each id, from the library's vocabulary through the reversed byte table."""
    back = {c: b for b, c in enumerate(byte_characters())}
    vocab = json.loads(description)["model"]["vocab"]
    table = [b""] * (1 + max(vocab.values()))
    for shown, i in vocab.items():
        table[i] = bytes(back[c] for c in shown)
    return table


def _plain_class(*categories: str) -> str:
    """Characters below PLAIN_END of these general categories, written as the inside of a class."""
    held = [c for c in range(PLAIN_END) if unicodedata.category(chr(c)).startswith(categories)]
    return "".join(re.escape(chr(c)) for c in held)


@lru_cache(maxsize=2)
def _plain_splitter(pattern: str) -> re.Pattern:
    """The pattern with its Unicode classes spelt out for characters below PLAIN_END."""
    inside = {"\\p{L}": _plain_class("L"), "\\p{N}": _plain_class("N"), "\\s": r"\x09-\x0D\x20\x85\xA0"}

    def spelt(m: re.Match) -> str:
        if m[0].startswith("["):
            return re.sub(r"\\p\{[LN]\}|\\s", lambda x: inside[x[0]], m[0])
        return f"[^{inside[chr(92) + 's']}]" if m[0] == r"\S" else f"[{inside[m[0]]}]"

    return re.compile(re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\s|\\S", spelt, pattern))


_beyond_plain = re.compile(f"[{chr(PLAIN_END)}-\U0010ffff]").search


class _Pieces(dict):
    """Packed ids by piece; filled from the library's model as pieces come, and emptied when full."""

    def __init__(self, tok):
        super().__init__()
        self.tokenize = tok.model.tokenize
        self.chars = byte_characters()

    def __missing__(self, piece: str) -> bytes:
        shown = "".join(map(self.chars.__getitem__, piece.encode()))
        packed = np.array([t.id for t in self.tokenize(shown)], "<u4").tobytes()
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = packed
        return packed


@lru_cache(maxsize=2)
def _encoder(description: str, pattern: str):
    """A function from a text to its packed ids."""
    tok = _loaded(description)
    pieces, split = _Pieces(tok).__getitem__, _plain_splitter(pattern).findall

    def packed(text: str) -> bytes:
        if _beyond_plain(text):
            return np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()
        return b"".join(map(pieces, split(text)))

    return packed


def _schema_with(df: DataFrame, drop: list[str], *fields: T.StructField) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in drop] + list(fields))


def _joined(packed: bytes, of: Callable[[int], bytes]) -> bytes:
    """The bytes that packed ids stand for."""
    return b"".join(map(of, np.frombuffer(packed, "<u4").tolist()))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", offsets: str | None = None, keep_text: bool = False, data: str | None = None) -> DataFrame:
    """Adds the ids of each whole text as packed little-endian unsigned 32-bit integers (binary).

    A null text counts as empty and has no ids. No special tokens are added, and their strings are
    ordinary text. `offsets`: a column of packed int32 pairs, each token's begin and end in characters;
    tokens that split a character share that character's span. `data`: a column of the bytes that the ids stand
    for, as decode() gives them, by the same worker: one after it would be a second one for each core, with tables of
    its own. A column of the same name is replaced; all others, whatever their names, pass through. Each row stands for itself: repeated rows and ids
    need no care. An empty table gives an empty one with the same columns.
    """
    bound_batches(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(tokenizer_json(path, pattern))  # as large as the vocabulary, whatever the data
    more = [c for c in (offsets, data) if c]
    drop = [ids, *more, *([] if keep_text else [text])]
    schema = _schema_with(df, drop, *[T.StructField(c, T.BinaryType()) for c in (ids, *more)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, pack = _loaded(shipped.value), _encoder(shipped.value, pattern)
        of = _byte_table(shipped.value).__getitem__ if data else None
        for whole in batches:
            for begin in range(0, whole.num_rows, PART_ROWS):
                batch = whole.slice(begin, PART_ROWS)
                values = [value or "" for value in batch.column(text).to_pylist()]
                packed = list(map(pack, values))
                spans = [np.array(tok.encode(value, add_special_tokens=False).offsets, "<i4").tobytes() for value in values] if offsets else []
                arrays = {n: batch.column(n) for n in batch.schema.names if n not in drop}
                arrays[ids] = pa.array(packed, pa.binary())
                if offsets:
                    arrays[offsets] = pa.array(spans, pa.binary())
                if data:
                    arrays[data] = pa.array([_joined(p, of) for p in packed], pa.binary())
                yield pa.RecordBatch.from_pydict(arrays)

    return df.mapInArrow(work, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", data: str = "decoded_bytes", text: str | None = None) -> DataFrame:
    """Adds the bytes that packed ids stand for, and on demand the text.

    Bytes of neighbouring ids are joined before they are read, so a character split over ids comes back
    whole; bytes that are no UTF-8 even then read as U+FFFD in the text and stay as they are in the
    bytes. Null ids give null.
    """
    bound_batches(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(tokenizer_json(path, pattern))
    drop = [data, *([text] if text else [])]
    schema = _schema_with(df, drop, T.StructField(data, T.BinaryType()), *([T.StructField(text, T.StringType())] if text else []))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _byte_table(shipped.value).__getitem__
        for whole in batches:
            for begin in range(0, whole.num_rows, PART_ROWS):
                batch = whole.slice(begin, PART_ROWS)
                found = [None if p is None else _joined(p, of) for p in batch.column(ids).to_pylist()]
                arrays = {n: batch.column(n) for n in batch.schema.names if n not in drop}
                arrays[data] = pa.array(found, pa.binary())
                if text:
                    arrays[text] = pa.array([None if b is None else b.decode("utf-8", "replace") for b in found], pa.string())
                yield pa.RecordBatch.from_pydict(arrays)

    return df.mapInArrow(work, schema)
