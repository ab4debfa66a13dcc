"""Alignment of two tokenizers' tokens by a transducer over dangling bytes.

Both token runs of a text spell the same bytes. The transducer reads them together: its state is
which side leads and the bytes of that side which the other hasn't matched yet. From the empty
state it reads a token of A, then always one of the side that is behind; when nothing dangles, a
group closes. A transition depends on the residual and the next token only, so each is worked out
once and memoised: reading a token is then one look into a table. Residuals are ends of tokens,
so the states are bounded by the vocabularies; the memo is emptied at ``TRANSITIONS``.

The last tokens of a group's two sides end at the same byte and are linked (no token of either
vocabulary is empty, so a group has one link). How often each pair of ids is linked in the whole
corpus is summed in Spark; each document's links then look up their counts.

Hot keys: links are tallied within a document, and by partial aggregation within a task, so a pair
that a third of all links has is one row a task. Counts are looked up in a broadcast table if they
are counted to be ``BROADCAST`` rows at most, else by a join that Spark splits where it is skewed.

Cases: a null or empty text, and one whose tokens spell other bytes than a space and the text
(characters that a vocabulary normalises, U+2581), has no tokens: all numbers are 0 and the digest
is empty; the special tokens' strings within texts are plain text; texts of any length are taken
whole; repeated rows are documents of their own; ties for a B id's highest count all count as best;
an empty table gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, doc_texts, stored
from plumbline.llm.packing import fast
from plumbline.llm.tokenizer import Cache

#: Transitions that the memo holds at most.
TRANSITIONS = 1 << 20
#: Distinct linked pairs that are broadcast at most: some 40 bytes each.
BROADCAST = 1_000_000
#: Bits of the second id in a pair's number.
WIDE = 24
_CHUNKS = regex.compile(r" +[^ ]*|[^ ]+")


class Pieces:
    """A SentencePiece model whose text opens with a space: ids of texts and bytes of ids.

    Where no piece holds a space after another character, none spans the start of a run of spaces,
    so a text is encoded by its chunks from there to the next, and chunks are cached.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.strings = [bytes([int(s[1:-1], 16)]) if self.model.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(names)]
        self.apart = not any("▁" in s.lstrip("▁") for s in names)
        self.space = array("I", [self.model.piece_to_id("▁")]).tobytes()
        self.chunks = Cache(self.chunk)

    def chunk(self, chunk: str) -> bytes:
        """Ids of a space and ``chunk``."""
        return array("I", self.model.encode(chunk)).tobytes() if chunk else self.space

    def encode(self, text: str) -> bytes:
        """Ids of ``text``, which is not empty, as little-endian unsigned 32-bit integers."""
        if not self.apart:
            return self.chunk(text)
        chunks = text.split(" ")
        if "" in chunks:
            chunks = [c[1:] for c in _CHUNKS.findall(" " + text)]
        return b"".join(map(self.chunks.__getitem__, chunks))


class Transducer:
    """Groups of two token runs with equal bytes. State 0 has no residual; in odd states A leads."""

    def __init__(self, a: list[bytes], b: list[bytes], most: int = TRANSITIONS):
        if not all(a) or not all(b):
            raise ValueError("a token of no bytes")
        self.a, self.b, self.most = a, b, most
        self.clear()

    def clear(self) -> None:
        self.numbers, self.residuals, self.steps, self.held = {}, {0: b""}, {0: {}}, 0

    def number(self, a_leads: bool, residual: bytes) -> int:
        if not residual:
            return 0
        key = (a_leads, residual)
        if key not in self.numbers:
            state = self.numbers[key] = 2 * len(self.numbers) + (1 if a_leads else 2)
            self.residuals[state], self.steps[state] = residual, {}
        return self.numbers[key]

    def step(self, state: int, token: int) -> int:
        """The state after ``token`` of the side that is behind (A's, where nothing dangles)."""
        a_leads, residual = state & 1 == 1, self.residuals[state]
        read = (self.b if a_leads else self.a)[token]
        if residual.startswith(read):
            after = self.number(a_leads, residual[len(read) :])
        elif read.startswith(residual):
            after = self.number(not a_leads, read[len(residual) :])
        else:
            raise ValueError("the tokens spell different bytes")
        self.steps[state][token] = after
        self.held += 1
        return after

    def groups(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
        """How many tokens of ``a`` and of ``b`` there are up to the end of each group."""
        if self.held > self.most:
            self.clear()
        steps, step, ends_a, ends_b, i, j, state = self.steps, self.step, [], [], 0, 0, 0
        n = len(a)
        while i < n:
            token = a[i]
            i += 1
            after = steps[0].get(token)
            state = step(0, token) if after is None else after
            while state:
                if state & 1:
                    token = b[j]
                    j += 1
                else:
                    token = a[i]
                    i += 1
                after = steps[state].get(token)
                state = step(state, token) if after is None else after
            ends_a.append(i)
            ends_b.append(j)
        return ends_a, ends_b


class Aligner:
    """Both tokenizers and the transducer between them."""

    def __init__(self, a_path: str, b_path: str):
        self.first, self.second = fast(a_path), Pieces(b_path)
        a, b = self.first.strings, self.second.strings
        # a vocabulary's id without an entry never occurs
        self.transducer = Transducer([x or b"\0" for x in a], b)
        # an id's digits with what follows it within a group, then at the end of its side
        self.written = [f"{i}{c}" for i in range(len(a)) for c in ",|"] + [f"{i}{c}" for i in range(len(b)) for c in ",;"]

    def tokens(self, text: str) -> tuple[np.ndarray, list[int], np.ndarray, list[int]] | None:
        """Ids of both sides as arrays and lists; None if they don't both spell a space and the text."""
        if not text:
            return None
        whole = (" " + text).encode()
        a = np.frombuffer(self.first.plain(" " + text), "<u4")
        b = np.frombuffer(self.second.encode(text), "<u4")
        as_a, as_b = a.tolist(), b.tolist()
        if b"".join(map(self.second.strings.__getitem__, as_b)) != whole or b"".join(map(self.first.strings.__getitem__, as_a)) != whole:
            return None
        return a, as_a, b, as_b

    def groups(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides, and the ends of the groups in each."""
        found = self.tokens(text)
        if found is None:
            return (np.zeros(0, np.int64),) * 4
        a, as_a, b, as_b = found
        ends = self.transducer.groups(as_a, as_b)
        return a.astype(np.int64), b.astype(np.int64), np.array(ends[0], np.int64), np.array(ends[1], np.int64)

    def spelt(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> str:
        """The groups as ``a1,a2|b1;a3|b2,b3``."""
        if not len(ends_a):
            return ""
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[ends_a - 1] = last_b[ends_b - 1] = 1
        # a token's place is its own number and what the other side has before it
        at = np.empty(len(a) + len(b), np.int64)
        at[np.arange(len(a)) + np.repeat(np.r_[0, ends_b[:-1]], np.diff(ends_a, prepend=0))] = 2 * a + last_a
        at[np.arange(len(b)) + np.repeat(ends_a, np.diff(ends_b, prepend=0))] = 2 * (len(self.first.strings) + b) + last_b
        return "".join(map(self.written.__getitem__, at.tolist()))[:-1]


@lru_cache(2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of two files, one in each process."""
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Each document's alignment: row (a number of its own), doc_id, n_a, n_b, n_groups, groups_sha256,
    and its linked pairs of ids (a * 2**24 + b) with how often each is linked."""

    def run(batch: pa.RecordBatch) -> dict:
        made = aligner(a_path, b_path)
        columns = {k: [] for k in ("n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times")}
        for text in batch["text"].to_pylist():
            a, b, ends_a, ends_b = made.groups(text)
            pairs, times = np.unique((a[ends_a - 1] << WIDE) + b[ends_b - 1], return_counts=True)
            spelt = made.spelt(a, b, ends_a, ends_b)
            digest = hashlib.sha256(spelt.encode()).hexdigest() if spelt else ""
            for c, x in zip(columns.values(), (len(a), len(b), len(ends_a), digest, pairs, times), strict=True):
                c.append(x)
        return {"doc_id": batch["doc_id"]} | columns

    made = arrow_map(doc_texts(docs), run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>")
    return made.withColumn("row", F.monotonically_increasing_id())


def counted(links: DataFrame) -> DataFrame:
    """For each pair of rows (pair, times) how often it is linked, and whether no pair with its B id is linked more often."""
    counts = stored(links.groupBy("pair").agg(F.sum("times").alias("n")), "counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << WIDE) - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.join(most, b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, a_path: str, b_path: str, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
    made = stored(aligned(docs, a_path, b_path), "aligned")
    links = made.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    counts = stored(counted(links), "pairs")
    if counts.count() <= broadcast:
        counts = F.broadcast(counts)
    of = links.join(counts, "pair").groupBy("row")
    sums = of.agg(F.sum("times").alias("n_links"), F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    numbers = ["n_links", "n_best", "count_sum"]
    done = made.drop("pairs", "times").join(sums, "row", "left").fillna(0, numbers)
    return done.select("doc_id", "n_a", "n_b", "n_groups", *numbers, "groups_sha256")
