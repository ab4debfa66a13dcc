"""Byte-level BPE: encoding with a priority queue of merge ranks over a linked symbol list.

Cases: a null text is an empty text and has no ids; texts of any length are encoded whole;
equal rows give equal results; an empty table gives an empty table. The file's added tokens
are cut out first, as the file's library does.
"""

from __future__ import annotations

import heapq
import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.common import arrow_map

#: White space of the Unicode standard, as the pre-tokeniser's \s has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The published pre-tokenisation pattern of byte-level BPE, with \s spelt out.
PIECES = rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Entries of one generation of a cache; a cache holds two generations at most.
CACHE = 220_000
#: Characters of a key that a cache holds at most: bounds its bytes where text has no spaces.
LONGEST = 128
#: Bits that hold an id.
WIDE = 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(shifted)) for b in range(256)]


class Cache(dict):
    """A bounded map that fills itself: ``make(key)`` gives what is missing.

    Two generations: when the young one is full it becomes the old one, and entries
    that are used again move to the young one. Keys over ``LONGEST`` characters are made anew.
    """

    def __init__(self, make, size: int = CACHE):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > LONGEST:
            return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Odd(Exception):
    """A chunk that isn't a run of whole pre-tokens when cut at single spaces."""


class ByteBPE:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or model["type"] != "BPE":
            raise ValueError(f"{path}: only byte-level BPE without a normaliser or prefix space")
        vocab: dict[str, int] = model["vocab"]
        symbols = byte_symbols()
        to_byte = {c: b for b, c in enumerate(symbols)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.first = [vocab[c] for c in symbols]
        self.ranks = {vocab[a] << WIDE | vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.strings = [b""] * size
        for s, i in [*vocab.items(), *self.added.items()]:
            self.strings[i] = b"".join(bytes([to_byte[c]]) if c in to_byte else c.encode() for c in s)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(PIECES)
        self.cuts = regex.compile(rf" (?=[^{SPACE}])")
        self.white = frozenset(c for c in map(chr, range(0x3001)) if regex.match(rf"[{SPACE}]", c))
        self.words = Cache(self.word)
        self.chunks = Cache(self.chunk)

    def word(self, piece: str) -> bytes:
        """Merge one pre-token: ids as little-endian unsigned 32-bit integers."""
        ids = list(map(self.first.__getitem__, piece.encode()))
        n, rank_of = len(ids), self.ranks.get
        if n == 1:
            return array("I", ids).tobytes()
        after, before, shift = [*range(1, n), -1], [*range(-1, n - 1)], n.bit_length()
        # an entry is a rank and the place of its left symbol, in one number
        queue = [r << shift | i for i in range(n - 1) if (r := rank_of(ids[i] << WIDE | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            rank, i = entry >> shift, entry & ((1 << shift) - 1)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank_of(ids[i] << WIDE | ids[j]) != rank:
                continue  # stale: one side has merged meanwhile
            made = ids[i] = self.made[rank]
            ids[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank_of(made << WIDE | ids[k])) is not None:
                    heapq.heappush(queue, r << shift | i)
            h = before[i]
            if h >= 0 and (r := rank_of(ids[h] << WIDE | made)) is not None:
                heapq.heappush(queue, r << shift | h)
        return array("I", [i for i in ids if i >= 0]).tobytes()

    def span(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pieces.findall(text)))

    def chunk(self, chunk: str) -> bytes:
        """Ids of a space and ``chunk``, which runs to the text's next single space."""
        if not chunk or chunk[0] in self.white:
            raise Odd
        return self.span(" " + chunk)

    def encode(self, text: str) -> bytes:
        """All ids of ``text``.

        A space before a character that isn't white space always opens a pre-token, so
        the text falls into chunks there, and most chunks come from a cache.
        """
        if self.specials and len(parts := self.specials.split(text)) > 1:
            return b"".join(array("I", [self.added[p]]).tobytes() if i % 2 else self.encode(p) for i, p in enumerate(parts))
        try:
            head, *rest = text.split(" ")
            return self.span(head) + b"".join(map(self.chunks.__getitem__, rest))
        except Odd:
            head, *rest = self.cuts.split(text)
            return self.span(head) + b"".join(map(self.chunks.__getitem__, rest))

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of ``ids`` put together; broken UTF-8 gives U+FFFD."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def byte_bpe(path: str) -> ByteBPE:
    """The encoder of ``path``, one in each process."""
    return ByteBPE(path)


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema if f.name != name), T.StructField(name, kind)])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``: each text's token ids as little-endian unsigned 32-bit integers.

    A column named ``ids`` is replaced; a null text has no ids (an empty value).
    """

    def run(batch: pa.RecordBatch) -> dict:
        bpe = byte_bpe(path)
        return dict(zip(batch.schema.names, batch.columns, strict=True)) | {ids: pa.array([bpe.encode(x or "") for x in batch[text].to_pylist()], pa.binary())}

    return arrow_map(df, run, _with(df, ids, T.BinaryType()))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``: the text of ``ids``; null ids give an empty text."""

    def run(batch: pa.RecordBatch) -> dict:
        bpe = byte_bpe(path)
        return dict(zip(batch.schema.names, batch.columns, strict=True)) | {decoded: [bpe.decode(x or b"") for x in batch[ids].to_pylist()]}

    return arrow_map(df, run, _with(df, decoded, T.StringType()))
