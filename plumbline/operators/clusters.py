"""k-means from many starts at once: each pass over the rows serves all of them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GOLDEN = 0x9E3779B97F4A7C15


def _draws(hashes: np.ndarray, number: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit hashes and a number, by the finaliser of splitmix64."""
    x = hashes.astype(np.int64).view(np.uint64) + np.uint64((number + 1) * _GOLDEN % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centres."""
    return np.stack([((points - c) ** 2).sum(1) for c in centres], 1)


def _batches(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(points, hashes, rows that are equal to each)"""
    for b in batches:
        if b.num_rows:
            yield b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "w"))


class Clusters:
    """Fitted centres of standardised columns, in lexical order, and their cost: the sum of squared distances."""

    def __init__(self, columns: list[str], mean: np.ndarray, sd: np.ndarray, centres: np.ndarray, cost: float):
        self.columns, self.mean, self.sd, self.centres, self.cost = columns, mean, sd, centres, cost

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``cluster``, the number of the nearest centre."""
        z = _scaled(self.columns, self.mean, self.sd)
        each = [F.struct(reduce(lambda s, x: s + (x[0] - float(x[1])) * (x[0] - float(x[1])), zip(z, c, strict=True), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(self.centres)]
        return df.withColumn("cluster", F.array_min(F.array(*each))["i"])


def _plain(column: str) -> Column:
    return F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(0.0)), F.lit(0.0))


def _scaled(columns: list[str], mean: np.ndarray, sd: np.ndarray) -> list[Column]:
    return [(_plain(c) - float(m)) / float(s) for c, m, s in zip(columns, mean, sd, strict=True)]


def kmeans(df: DataFrame, columns: list[str], k: int = 5, seed: int = 42, starts: int = 10, rounds: int = 5, steps: int = 50, tolerance: float = 1e-8) -> tuple[DataFrame, Clusters]:
    """Archetypes: (rows with ``cluster``, model) of z-scored ``columns``, the best of ``starts`` by cost.

    Missing values are 0. Equal rows are one point with their number. Seeds are oversampled: in each of ``rounds``
    a row would be drawn with a chance of 2k times its share of the cost, and a point comes, by a hash of its values,
    with the chance that one of its rows would. The few drawn (some 2k a round and start) are weighted by the rows nearest to them and reduced to k
    on the driver. Then Lloyd's steps go on until no centre of a start moves: each is one
    aggregate of all starts, to which a task gives one row a centre. With fewer than k different
    points there are as many clusters as those; no rows are an error.
    """
    if not columns or k < 1:
        raise ValueError("columns and one cluster or more are needed")
    dims = len(columns)
    m = df.agg(F.count(F.lit(1)), *(F.avg(_plain(c)) for c in columns), *(F.stddev_pop(_plain(c)) for c in columns)).first()
    if not m[0]:
        raise ValueError("no rows to fit")
    mean, sd = np.array(m[1 : dims + 1], float), np.array([x or 1.0 for x in m[dims + 1 :]], float)
    points = df.select(F.array(*_scaled(columns, mean, sd)).alias("v")).groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("w")).withColumn("h", F.xxhash64("v", F.lit(seed))).persist()

    first = points.select(F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("s"), "v", "h").groupBy("s").agg(F.min(F.struct(F.xxhash64("h", "s"), "v"))["v"].alias("v"))
    centres = {r.s: np.array([r.v]) for r in first.collect()}
    for turn in range(4 * rounds):
        short = [s for s in centres if len(centres[s]) < k]
        if turn >= rounds and not short:
            break
        cost = {s: sum(c for _, c, _ in found.values()) for s, found in _summed(points, centres, dims).items()}
        wanted = {s: cost[s] for s in (centres if turn < rounds else short) if cost[s] > 1e-12}
        if not wanted:
            break
        for s, drawn in _drawn(points, centres, wanted, 2 * k, turn, dims).items():
            centres[s] = np.concatenate([centres[s], drawn])

    rng = np.random.default_rng(seed)
    weights = _summed(points, centres, dims)
    now = {s: _reduced(c, np.array([weights[s].get(i, (0,))[0] for i in range(len(c))], float), k, rng) for s, c in sorted(centres.items())}
    going = dict(now)
    for _ in range(steps):
        if not going:
            break
        for s, found in _summed(points, going, dims).items():
            new = np.array([found[i][2] / found[i][0] if i in found else c for i, c in enumerate(going[s])])
            moved = ((new - going[s]) ** 2).sum(1).max()
            now[s] = going[s] = new
            if moved <= tolerance:
                del going[s]
    cost = {s: sum(c for _, c, _ in found.values()) for s, found in _summed(points, now, dims).items()}
    points.unpersist()
    best = min(cost, key=lambda s: (cost[s], s))
    order = np.lexsort(now[best].T[::-1])
    model = Clusters(columns, mean, sd, now[best][order], cost[best])
    return model.transform(df), model


def _summed(points: DataFrame, centres: dict[int, np.ndarray], dims: int) -> dict[int, dict[int, tuple]]:
    """By start and centre: (rows, cost, sum of points) of the points nearest to it, in one job."""
    centres = dict(centres)

    def run(batches):
        n = {s: np.zeros(len(c)) for s, c in centres.items()}
        cost, sums = {s: np.zeros(len(c)) for s, c in centres.items()}, {s: np.zeros((len(c), dims)) for s, c in centres.items()}
        for x, _, w in _batches(batches, dims):
            for s, c in centres.items():
                d = _distances(x, c)
                at = d.argmin(1)
                n[s] += np.bincount(at, w, len(c))
                cost[s] += np.bincount(at, w * d[np.arange(len(x)), at], len(c))
                for j in range(dims):
                    sums[s][:, j] += np.bincount(at, w * x[:, j], len(c))
        rows = [(s, i) for s in centres for i in np.flatnonzero(n[s])]
        columns = {"s": [s for s, _ in rows], "c": [int(i) for _, i in rows], "n": [n[s][i] for s, i in rows], "cost": [cost[s][i] for s, i in rows]}
        columns |= {f"x{j}": [sums[s][i, j] for s, i in rows] for j in range(dims)}
        yield pa.RecordBatch.from_pydict(columns, schema=pa.schema([("s", pa.int32()), ("c", pa.int32()), ("n", pa.float64()), ("cost", pa.float64()), *((f"x{j}", pa.float64()) for j in range(dims))]))

    names = ["n", "cost", *(f"x{j}" for j in range(dims))]
    parts = points.mapInArrow(run, ", ".join(["s int", "c int", *(f"{c} double" for c in names)]))
    out: dict[int, dict[int, tuple]] = {s: {} for s in centres}
    for r in parts.groupBy("s", "c").agg(*(F.sum(c).alias(c) for c in names)).collect():
        out[r.s][r.c] = (r.n, r.cost, np.array([r[f"x{j}"] for j in range(dims)]))
    return out


def _drawn(points: DataFrame, centres: dict[int, np.ndarray], cost: dict[int, float], many: int, turn: int, dims: int) -> dict[int, np.ndarray]:
    """New points of each start, drawn by their shares of its cost; equal points come once."""

    def run(batches):
        for x, h, w in _batches(batches, dims):
            starts, found = [], []
            for s, total in cost.items():
                chance = 1 - (1 - np.minimum(many * _distances(x, centres[s]).min(1) / total, 1.0)) ** w
                hit = np.flatnonzero(_draws(h, 1000 * turn + s) < chance)
                starts += [s] * len(hit)
                found += x[hit].tolist()
            yield pa.RecordBatch.from_pydict({"s": starts, "v": found}, schema=pa.schema([("s", pa.int32()), ("v", pa.list_(pa.float64()))]))

    out: dict[int, list] = {}
    for r in points.mapInArrow(run, "s int, v array<double>").collect():
        out.setdefault(r.s, []).append(r.v)
    return {s: np.array(sorted(v)) for s, v in out.items()}


def _reduced(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator, tries: int = 5) -> np.ndarray:
    """k of the weighted points, spread out by chance, and moved by Lloyd's steps; the best of some tries."""
    best: tuple[float, np.ndarray] | None = None
    for _ in range(tries):
        chosen = [points[rng.choice(len(points), p=weights / weights.sum())]]
        while len(chosen) < k:
            d = weights * _distances(points, np.array(chosen)).min(1)
            if d.sum() <= 0:
                break
            chosen.append(points[rng.choice(len(points), p=d / d.sum())])
        c = np.array(chosen)
        for _ in range(20):
            at = _distances(points, c).argmin(1)
            c = np.array([np.average(points[at == i], axis=0, weights=weights[at == i]) if weights[at == i].sum() > 0 else c[i] for i in range(len(c))])
        cost = float((weights * _distances(points, c).min(1)).sum())
        if best is None or cost < best[0]:
            best = (cost, c)
    return best[1]
