"""Best-fit packing planned over a histogram of lengths.

The planner sees counts by length, never documents: its work and its plan are bounded by
the sequence length. Pieces then take the planned slots by joining on their rank within
their length.

Cases: a null text is an empty text, one piece of one token; repeated rows are pieces of
their own; an empty table gives an empty table; texts of any length are cut into pieces; pieces of equal
length take their slots in any order; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, doc_texts, numbered, salts_for, stored
from plumbline.llm.tokenizer import ByteBPE

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: The published pre-tokenisation pattern of byte-level BPE, for a compiled library.
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Fast(ByteBPE):
    """``ByteBPE`` by a compiled library that merges by the same file's ranks.

    Only for files whose merges have ids in the order of their ranks; others are merged here.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.plain = super().encode
        made = self.made
        if made == sorted(set(made)) and min(made, default=256) > max(self.first):
            import tiktoken

            ranks = {self.strings[i]: i for i in [*self.first, *made]}
            ids = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.plain = lambda text: array("I", ids(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if self.specials and len(parts := self.specials.split(text)) > 1:
            return b"".join(array("I", [self.added[p]]).tobytes() if i % 2 else self.plain(p) for i, p in enumerate(parts))
        return self.plain(text)


@lru_cache(2)
def fast(path: str) -> Fast:
    """The encoder of ``path``, one in each process."""
    return Fast(path)


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all full but the first, which may be shorter."""
    first = n % most or most
    return [(0, first), *((s, most) for s in range(first, n, most))] if n else []


def pieces(docs: DataFrame, path: str, most: int = 2048, end: int = 0) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and cut each into pieces of at most ``most`` ids.

    Each document's ids are followed by ``end``.
    """
    last = np.array([end], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> dict:
        bpe = fast(path)
        columns = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc, ids in zip(batch["doc_id"].to_pylist(), map(bpe.encode, batch["text"].to_pylist()), strict=True):
            ids = memoryview(ids + last)
            for k, (start, length) in enumerate(cut(len(ids) // 4, most)):
                for name, value in zip(columns, (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                    columns[name].append(value)
        return columns

    return arrow_map(doc_texts(docs), run, PIECES)


def plan(histogram: dict[int, int], most: int = 2048) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts: rows (length, rank, n, sequence, each, offset).

    Pieces of ``length`` with ranks rank .. rank + n - 1 go to sequences from ``sequence``
    on, ``each`` to a sequence, the first of them at ``offset``. Runs of sequences that are
    filled alike stay one entry, so the rows are bounded by the lengths, not the counts.
    """
    rows, free, room, opened = [], {}, [], 0  # free: space left -> runs (sequence, count)

    def put(space: int, run: tuple[int, int]) -> None:
        if space and run[1]:
            if space not in free:
                insort(room, space)
                free[space] = []
            free[space].append(run)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= most:
            raise ValueError(f"a piece of {length} tokens does not fit")
        while left:
            k = bisect_left(room, length)
            if k < len(room):
                space = room[k]
                sequence, count = free[space].pop()
                if not free[space]:
                    del free[space], room[k]
            else:
                space, sequence = most, opened
                count = -(-left // (most // length))
                opened += count
            each = space // length
            n = min(left, count * each)
            full, rest = divmod(n, each)
            rows.append((length, rank, n, sequence, each, most - space))
            put(space - each * length, (sequence, full))
            put(space - rest * length, (sequence + full, bool(rest)))
            used = full + bool(rest)
            put(space, (sequence + used, count - used))
            left, rank = left - n, rank + n
    return rows


def pack(cut_pieces: DataFrame, most: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with doc_id, piece and ``length`` (1 to ``most``).

    ``cut_pieces`` is read three times, so pass a stored table. At most ``most`` rows of counts
    reach the driver; the plan that is broadcast is bounded by ``most`` as well.
    """
    spark = cut_pieces.sparkSession
    histogram = {r.length: r.n for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(plan(histogram, most), "length long, _rank long, _n long, _sequence long, _each long, _offset long")
    ranked = numbered(cut_pieces, ["length"], ["doc_id", "piece"], "_k", salts_for(sum(histogram.values())))
    fits = (ranked["length"] == slots["length"]) & (F.col("_k") >= F.col("_rank")) & (F.col("_k") < F.col("_rank") + F.col("_n"))
    at = F.col("_k") - F.col("_rank")
    return ranked.join(F.broadcast(slots), fits).select(
        *(ranked[c] for c in cut_pieces.columns if c not in ("sequence_id", "offset")),
        (F.col("_sequence") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (at % F.col("_each")) * ranked["length"]).cast("long").alias("offset"),
    )


def best_fit(docs: DataFrame, path: str, most: int = 2048, end: int = 0) -> DataFrame:
    """Tokenise, cut and pack ``docs``: one row per piece with its sequence and offset."""
    return pack(stored(pieces(docs, path, most, end), "pieces"), most)
