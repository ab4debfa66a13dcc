"""SimHash fingerprints and a Gray-order hierarchical index that links near ones.

Cases: a null text is an empty text, and texts without words have fingerprint zero, linked
like any other; repeated rows are linked; an empty table gives an empty table; a null doc_id
never is a component's smallest id unless the component has no other; texts of any length are
taken whole, each in one task; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, doc_texts, partition_map, stored
from plumbline.llm.graph import components, lowest

#: Rows of a block's group beyond which it is split by a further block of bits.
GROUP = 50_000
#: Query-node pairs that are held at once.
FRONTIER = 400_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of ``text``: a bit is 1 if it is set in over half of the shingles' XXH64 hashes.

    Words are runs without ASCII white space, with A-Z in lower case; a shingle is ``shingle``
    words joined by spaces, repeats included; fewer words are one shingle; none give zero.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return majority(np.array([digest(join(w), seed) for w in zip(*(words[i:] for i in range(shingle)), strict=False)], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The word whose bits are set in over half of ``hashes``."""
    columns = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 400:
        counts = np.unpackbits(columns, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text, its 64 bits as a long."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch["doc_id"], "fp": np.array([fingerprint(x, shingle, seed) for x in batch["text"].to_pylist()], np.uint64).view(np.int64)}

    return arrow_map(doc_texts(docs), run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """A forest over fingerprints that are sorted by group, then by Gray rank.

    A node stands for a run of up to ``fan`` nodes below. Its mask has the bits that all
    fingerprints under it share and no node above has; neighbours in Gray order differ in
    few bits, so much is shared high up. A search adds the differences of the masked bits
    on its way down and leaves a node, and so its whole group, when they exceed the bound.
    """

    def __init__(self, group: np.ndarray, fp: np.ndarray, fan: int = 8):
        self.fp, every = fp, ~np.uint64(0)
        levels = [(group, fp, np.full(len(fp), every), np.arange(len(fp)), np.arange(1, len(fp) + 1))]
        while True:
            g, pattern, shared, _, _ = levels[-1]
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            if len(first) == len(g):
                break
            place = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
            start = np.flatnonzero(place % fan == 0)
            end = np.append(start[1:], len(g))
            apart = (pattern ^ np.repeat(pattern[start], end - start)) | ~shared
            levels.append((g[start], pattern[start], ~np.bitwise_or.reduceat(apart, start), start, end))
        self.levels = []  # from the root: pattern, residual mask, first child, end of children
        above = np.zeros(len(levels[-1][0]), np.uint64)
        for g, pattern, shared, start, end in levels[::-1]:
            self.levels.append((pattern, shared & ~above, start, end))
            above = np.repeat(shared, end - start) if len(self.levels) < len(levels) else above
        self.root_of = np.searchsorted(levels[-1][0], group)

    def pairs(self, bound: int):
        """Arrays (query, found) of places with query < found, at most ``bound`` bits apart."""
        todo = [(0, q, self.root_of[q], np.zeros(len(q), np.int64)) for q in np.array_split(np.arange(len(self.fp)), max(1, len(self.fp) // 50_000))]
        while todo:
            depth, query, node, apart = todo.pop()
            pattern, mask, start, end = self.levels[depth]
            apart = apart + np.bitwise_count((self.fp[query] ^ pattern[node]) & mask[node])
            near = apart <= bound
            query, node, apart = query[near], node[near], apart[near]
            if depth + 1 == len(self.levels):
                later = query < node
                if later.any():
                    yield query[later], node[later]
                continue
            width = end[node] - start[node]
            below = np.repeat(start[node], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            query, apart = np.repeat(query, width), np.repeat(apart, width)
            for i in range(0, len(below), FRONTIER):
                todo.append((depth + 1, query[i : i + FRONTIER], below[i : i + FRONTIER], apart[i : i + FRONTIER]))


def _blocks(bits: np.ndarray | list[int], parts: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(bits, parts)]


def near_links(fps: DataFrame, bound: int = 2, group: int = GROUP) -> DataFrame:
    """(a, b): links of distinct fingerprints (``fp``) that connect all within ``bound`` bits.

    Words within ``bound`` bits agree in one of ``bound`` + 1 blocks of bits, so each goes to a
    group for every block. A group over ``group`` rows, counted first, is split by blocks of
    its other bits in the same way, three times at most, when under 20 bits are left. In each
    group a Gray-order index finds all near pairs; a spanning forest of them is returned.
    """
    table = stored(fps.select("fp").where("fp is not null").distinct(), "fingerprints")
    parts = bound + 1
    grouped = [(b, [i for i in range(64) if i not in b]) for b in _blocks(np.arange(64), parts)]
    found = None
    for depth in range(4):
        rows = None
        for bits, _ in grouped:
            mask = np.array(sum(1 << i for i in bits), np.uint64).astype(np.int64).item()
            made = table.select("fp", F.struct(F.lit(mask).alias("mask"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits")).alias("key"))
            rows = made if rows is None else rows.union(made)
        large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).select("key")
        last = depth == 3 or large.isEmpty()
        small = (rows if last else rows.join(large, "key", "left_anti")).select(F.xxhash64("key").alias("key"), "fp")
        links = partition_map(small.repartition("key"), lambda t: _link(t, bound), "a long, b long")
        found = links if found is None else found.union(links)
        if last:
            return found
        table = stored(rows.join(large, "key", "left_semi").select("fp").distinct(), "fingerprints")
        grouped = [(bits + more, [i for i in rest if i not in more]) for bits, rest in grouped for more in _blocks(rest, parts)]


def _link(table: pa.Table, bound: int) -> list[dict]:
    key = table["key"].to_numpy()
    fp = table["fp"].to_numpy().view(np.uint64)
    order = np.lexsort((gray_rank(fp), key))
    key, fp = key[order], fp[order]
    root = lowest(len(fp), GrayIndex(key, fp).pairs(bound))
    linked = root != np.arange(len(fp))
    fp = fp.view(np.int64)
    return [{"a": fp[linked], "b": fp[root[linked]]}]


def near_duplicates(docs: DataFrame, bound: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id of each row: the smallest doc_id that it reaches by links."""
    prints = stored(fingerprints(docs, shingle, seed), "prints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    parts = components(near_links(prints, bound)).select(F.col("node").alias("fp"), "component")
    parts = stored(parts, "parts")
    least = parts.join(first, "fp").groupBy("component").agg(F.min("first").alias("least"))
    owner = first.join(parts, "fp", "left").join(least, "component", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return prints.join(owner, "fp").select("doc_id", "fp", "component_id")
