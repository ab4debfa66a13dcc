"""Maximum inner product search by score-aware (anisotropic) product quantisation.

Vectors are coded at length 1, beside their norms. Each dimension is coded by four bits. Codes and
codebooks minimise a loss in which error along the vector, which changes large inner products,
weighs ``eta`` times error across it. What the codes leave is coded by a byte a dimension, in
steps of each vector's own. The lengths of both errors are kept, so a product that is worked out
from codes has bounds. A query's tables of products are scanned over the codes of every candidate,
two codes to a byte; the ``FIRST`` best by code are looked at with their second codes. All candidates
whose upper bound reaches the ``k``-th best lower bound are ranked again by the exact inner
product, so none of the nearest is lost, whatever the rows are like.

The codebooks of each vector length are fitted on at most ``SAMPLE`` vectors, by hash; every
vector is coded. Only codes and queries meet in the scan, ``BLOCK`` candidates and ``QUERIES``
queries at a time; vectors are joined to what is left, once for each ``QUERIES`` queries.

Rows with equal vec_id and vector are one row. Equal vectors are one candidate with their
``k`` + 1 smallest ids, which is all that a query can ask of them, so copies of any number cost
no more than one. Rows with equal vec_id and other vectors are queries of their own.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part,
nor rows with a null vec_id; queries and candidates of different lengths don't meet; candidates
with a query's own vec_id are left out; ties go to the smaller vec_id; fewer candidates than
asked for are all returned; an empty table gives an empty table; further columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, grouped_map, hashed_sample, stored
from plumbline.llm.vectors import matrix, usable, vectors

WIDTH, CODES = 1, 16
SAMPLE, BLOCK, QUERIES, FIRST = 8192, 65536, 1024, 256
#: Queries whose tables are scanned at once, and candidates.
TOGETHER, CHUNK = 32, 8192
#: Inner products under this share of the norm don't count in the loss.
THRESHOLD = 0.2


class Codes(NamedTuple):
    """Packed codes, second codes, their steps, and how far the coded vector is by the first and by both."""

    codes: np.ndarray
    fine: np.ndarray
    step: np.ndarray
    far: np.ndarray
    near: np.ndarray


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``x`` at length 1, and their norms."""
    top = np.abs(x).max(1)
    x = x / top[:, None]
    norm = np.linalg.norm(x, axis=1)
    return x / norm[:, None], top * norm


class Quantiser:
    """Codebooks of ``parts`` x 16 x ``WIDTH`` that suit inner products with the vectors."""

    def __init__(self, x: np.ndarray, rounds: int = 6, seed: int = 3):
        n, self.dim = x.shape
        self.parts = -(-self.dim // WIDTH)
        self.eta = max(1.0, (self.dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        x = self._cut(x)
        rng = np.random.default_rng(seed)
        pick = rng.integers(0, n, (self.parts, CODES))
        self.books = np.stack([x[pick[m], m] + 1e-6 * rng.standard_normal((CODES, WIDTH)) for m in range(self.parts)])
        for _ in range(rounds):
            codes = self._assign(x)
            self._refit(x, codes)

    def _cut(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.parts * WIDTH - self.dim))).reshape(len(x), self.parts, WIDTH)

    def _assign(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by nearest centroid, then by coordinate descent on the anisotropic loss."""
        along = x / np.maximum(np.linalg.norm(x.reshape(len(x), -1), axis=1), 1e-300)[:, None, None]
        square, dots = np.empty((self.parts, len(x), CODES)), np.empty((self.parts, len(x), CODES))
        for m in range(self.parts):
            r = x[:, m, None, :] - self.books[m]
            square[m] = (r**2).sum(2)
            dots[m] = np.einsum("nkw,nw->nk", r, along[:, m])
        codes, at = square.argmin(2), np.arange(len(x))
        total = sum(dots[m][at, codes[m]] for m in range(self.parts))
        for _ in range(sweeps):
            for m in range(self.parts):
                rest = total - dots[m][at, codes[m]]
                codes[m] = (square[m] + (self.eta - 1) * (rest[:, None] + dots[m]) ** 2).argmin(1)
                total = rest + dots[m][at, codes[m]]
        return codes.T

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """The codebooks of least loss for given codes: one linear system for all parts."""
        n, size = len(x), self.parts * CODES * WIDTH
        along = x / np.maximum(np.linalg.norm(x.reshape(n, -1), axis=1), 1e-300)[:, None, None]
        slot = (np.arange(self.parts)[None, :] * CODES + codes)[:, :, None] * WIDTH + np.arange(WIDTH)
        slot, flat = slot.reshape(n, -1), x.reshape(n, -1)
        system, right = np.zeros((size, size)), np.bincount(slot.ravel(), flat.ravel(), size)
        norm = np.linalg.norm(flat, axis=1)
        for s in range(0, n, 2048):
            u = np.zeros((len(slot[s : s + 2048]), size), np.float32)
            np.put_along_axis(u, slot[s : s + 2048], along[s : s + 2048].reshape(len(u), -1).astype(np.float32), 1)
            system += (self.eta - 1) * (u.T @ u)
            right += (self.eta - 1) * (u.T @ norm[s : s + 2048])
        system[np.arange(size), np.arange(size)] += np.bincount(slot.ravel(), minlength=size) + 1e-6
        right += 1e-6 * self.books.ravel()
        self.books = np.linalg.solve(system, right).reshape(self.parts, CODES, WIDTH)

    def encode(self, x: np.ndarray) -> Codes:
        """Four-bit codes of unit vectors, two to a byte, and codes of what they leave."""
        codes = np.concatenate([self._assign(self._cut(x[i : i + 2048])) for i in range(0, len(x), 2048)])
        rest = x - self.books[np.arange(self.parts), codes].reshape(len(x), -1)[:, : self.dim]
        step = np.abs(rest).max(1) / 127
        fine = np.rint(rest / np.where(step > 0, step, 1)[:, None])
        codes = np.pad(codes, ((0, 0), (0, self.parts % 2))).astype(np.uint8)
        far, near = (np.linalg.norm(r, axis=1) for r in (rest, rest - step[:, None] * fine))
        return Codes(codes[:, ::2] | codes[:, 1::2] << 4, fine.astype(np.int8), step, far, near)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each pair of parts and of centroids, its product with each of ``q``: (parts / 2, 256, queries)."""
        one = np.einsum("mkw,qmw->mkq", self.books, self._cut(q))
        one = np.pad(one, ((0, self.parts % 2), (0, 0), (0, 0)))
        return (one[1::2, :, None] + one[::2, None, :]).reshape(-1, CODES * CODES, len(q)).astype(np.float32)


def least(low: np.ndarray, need: int) -> float:
    """The ``need``-th largest of lower bounds."""
    return np.partition(low, len(low) - need)[len(low) - need] if need <= len(low) else -np.inf


def scan(quantiser: Quantiser, coded: Codes, norm: np.ndarray, q: np.ndarray, need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the unit vectors ``q``: places of all candidates that can be among its ``need`` best, their upper and lower bounds."""
    n = len(norm)
    # what sums of single precision may be off by, of the lengths of coded vectors
    loss = (quantiser.parts + 8) * 2.0**-23 * (1 + coded.far)
    far, near = norm * (coded.far + loss), norm * (coded.near + loss)
    codes = np.ascontiguousarray(coded.codes.T)

    def bounded(row: np.ndarray, at: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = norm[at] * (row[at] + coded.step[at] * (coded.fine[at] @ one))
        return both + near[at], np.nan_to_num(both - near[at], nan=-np.inf, posinf=np.inf, neginf=-np.inf)

    for s in range(0, len(q), TOGETHER):
        tables = quantiser.tables(q[s : s + TOGETHER])
        total = np.empty((n, tables.shape[2]), np.float32)
        for c in range(0, n, CHUNK):
            part = total[c : c + CHUNK]
            np.take(tables[0], codes[0, c : c + CHUNK], axis=0, out=part)
            for t, code in zip(tables[1:], codes[1:, c : c + CHUNK], strict=True):
                part += t[code]
        for i, row in enumerate(np.ascontiguousarray(total.T).astype(np.float64), s):
            score, few = norm * row, min(n, max(FIRST, need[i]))
            best = np.argpartition(score, n - few)[n - few :] if few < n else np.arange(n)
            floor = least(bounded(row, best, q[i])[1], need[i])
            at = np.flatnonzero(~(score + far < floor))
            high, low = bounded(row, at, q[i])
            fits = ~(high < least(low, need[i]))
            yield at[fits], high[fits], low[fits]


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The inner products of the rows of ``x`` and ``y``, summed from the first dimension to the last."""
    total = np.zeros(len(x))
    for a, b in zip(x.T, y.T, strict=True):
        total += a * b
    return total


def _nearest(table: pa.Table, k: int) -> dict:
    """The ``k`` nearest of each query of a group, from its candidates' vectors."""
    asked = table.filter(pc.is_valid(table["cids"]))
    held = table.filter(pc.is_null(table["cids"]))
    place = {c: i for i, c in enumerate(held["id"].to_pylist())}
    x, y, ids = matrix(held["vector"]), matrix(asked["vector"]), held["ids"].to_pylist()
    out = {"id": [], "query_id": [], "vec_id": [], "score": []}
    for q, (row, own, cids) in enumerate(zip(asked["id"].to_pylist(), asked["vec_id"].to_pylist(), asked["cids"].to_pylist(), strict=True)):
        at = np.array([place[c] for c in cids])
        score = products(x[at], np.broadcast_to(y[q], (len(at), y.shape[1])))
        # of a candidate, copies with the query's own id are left out
        found = sorted((-v, i) for v, c in sorted(zip(score.tolist(), at.tolist(), strict=True), reverse=True) for i in ids[c] if i != own)[:k]
        out["id"] += [row] * len(found)
        out["query_id"] += [own] * len(found)
        out["vec_id"] += [i for _, i in found]
        out["score"] += [-v for v, _ in found]
    return out


def search(df: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest of each row for which ``is_query`` holds.

    ``df`` has vec_id and embedding; ``is_query`` is a condition on vec_id. The driver holds a
    sample of ``SAMPLE`` vectors, and a count for each length that occurs.
    """
    spark = df.sparkSession
    kind = df.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # floats stay floats until they are compared
    rows = vectors(df).withColumn("vector", F.col("vector").cast(kind)).where(F.col("vec_id").isNotNull() & usable("vector"))
    lowest = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.distinct().withColumn("_k", F.row_number().over(lowest)).where(F.col("_k") <= k + 1)
    classes = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("id"), "vector", "ids"), "classes")
    asked = rows.where(F.coalesce(is_query, F.lit(False))).distinct()
    asked = stored(asked.select(F.monotonically_increasing_id().alias("id"), "vec_id", "vector"), "asked")

    def sizes(table: DataFrame) -> dict[int, int]:
        return {r.d: r.n for r in table.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}

    n, m = sizes(classes), sizes(asked)
    schema = "query_id long, rank int, vec_id long, score double"
    if not m:
        return spark.createDataFrame([], schema)
    # candidates with a query's own id don't count, however many vectors it has
    often = asked.groupBy("vec_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    sized = asked.join(often, "vec_id", "left").select("id", "vec_id", "vector", F.size("vector").alias("length"), (k + F.coalesce("_n", F.lit(1))).cast("int").alias("need"))
    fitted = {d: Quantiser(unit(np.array([r.vector for r in hashed_sample(classes.where(F.size("vector") == d), "id", SAMPLE).select("vector").collect()]))[0]) for d in sorted(m)}

    def code(batch: pa.RecordBatch) -> dict:
        width = pc.list_value_length(batch["vector"]).to_numpy()
        out = {c: [None] * len(width) for c in ("codes", "fine", "norm", "step", "far", "near")}
        for d in np.unique(width).tolist():
            at = np.flatnonzero(width == d)
            x, norm = unit(matrix(batch["vector"].take(pa.array(at))))
            made = fitted[d].encode(x)
            for i, r in enumerate(at.tolist()):
                out["codes"][r], out["fine"][r], out["norm"][r] = made.codes[i].tobytes(), made.fine[i].tobytes(), norm[i]
                out["step"][r], out["far"][r], out["near"][r] = made.step[i], made.far[i], made.near[i]
        return {"id": batch["id"], "length": width} | out

    def dealt(count: dict[int, int], most: int) -> Column:
        parts = F.create_map(*(F.lit(x) for d in m for x in (d, max(1, -(-count[d] // most)))))
        return parts[F.col("length")]

    numbers = "norm double, step double, far double, near double"
    coded = arrow_map(classes.where(F.size("vector").isin(list(m))), code, f"id long, length int, codes binary, fine binary, {numbers}")
    coded = stored(coded, "codes")
    blocks, groups = dealt(n, BLOCK), dealt(m, QUERIES)
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    own = lambda count: F.pmod(F.xxhash64("id"), count).cast("int")
    none = lambda t, *names: [F.lit(None).cast(t).alias(c) for c in names]
    of = ("norm", "step", "far", "near")
    candidates = coded.select("id", "length", "codes", "fine", *of, *none(kind, "vector"), *none("int", "need"), own(blocks).alias("block"), every(groups).alias("group"))
    sent = sized.select("id", "length", *none("binary", "codes", "fine"), *none("double", *of), "vector", "need", every(blocks).alias("block"), own(groups).alias("group"))

    def meet(table: pa.Table) -> dict:
        q = table.filter(pc.is_null(table["codes"]))
        c = table.filter(pc.is_valid(table["codes"]))
        out = {"id": [], "block": [], "cids": [], "high": [], "low": []}
        if not len(q) or not len(c):
            return out
        ids, length, block = c["id"].to_numpy(), table["length"][0].as_py(), table["block"][0].as_py()
        packed, fine = (np.frombuffer(b"".join(c[x].to_pylist()), t).reshape(len(c), -1) for x, t in (("codes", np.uint8), ("fine", np.int8)))
        held = Codes(packed, fine, *(c[x].to_numpy() for x in of[1:]))
        need = q["need"].to_numpy()
        found = scan(fitted[length], held, c["norm"].to_numpy(), unit(matrix(q["vector"]))[0], need)
        for row, few, (at, high, low) in zip(q["id"].to_pylist(), need.tolist(), found, strict=True):
            out["id"].append(row)
            out["block"].append(block)
            out["cids"].append(ids[at])
            out["high"].append(high)
            out["low"].append(np.sort(low)[::-1][:few])
        return out

    met = grouped_map(candidates.union(sent), ["length", "block", "group"], meet, "id long, block int, cids array<long>, high array<double>, low array<double>")
    met = stored(met, "met")
    # over all blocks the bound is higher
    floors = met.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("low")), False).alias("low"))
    lists = met.drop("low").join(floors, "id").join(sized, "id")
    floor = F.coalesce(F.get("low", F.col("need") - 1), F.lit(float("-inf")))
    left = F.filter(F.arrays_zip("cids", "high"), lambda s: ~(s["high"] < floor))
    lists = lists.select("id", "vec_id", "vector", "length", "block", own(groups).alias("group"), left["cids"].alias("cids")).where(F.size("cids") > 0)
    grouped = stored(lists, "candidates")

    at = ["length", "group", "block"]
    need = grouped.select(*at, F.explode("cids").alias("id")).distinct().join(classes, "id")
    held = need.select(*at, "id", *none("long", "vec_id"), "vector", "ids", *none("array<long>", "cids"))
    ask = grouped.select(*at, "id", "vec_id", "vector", *none("array<long>", "ids"), "cids")
    exact = grouped_map(held.union(ask), at, lambda t: _nearest(t, k), "id long, query_id long, vec_id long, score double")
    best = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
