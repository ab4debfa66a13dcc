"""Search for parameters: tree-structured Parzen estimators, and random search to compare with."""

from __future__ import annotations

import bisect
import itertools
import math
import random
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Dimension:
    """A parameter as a place in [0, 1]: ``kind`` is int, float, log (float) or logint."""

    low: float
    high: float
    kind: str

    def __post_init__(self):
        if self.kind not in ("int", "float", "log", "logint"):
            raise ValueError(f"unknown kind {self.kind!r}")
        if self.low > self.high or ("log" in self.kind and self.low <= 0):
            raise ValueError(f"bad range {self.low} to {self.high} for {self.kind}")

    def _ends(self) -> tuple[float, float]:
        """The ends of the continuous range; an int has half a unit on both sides."""
        half = 0.5 if "int" in self.kind else 0.0
        low, high = self.low - half, self.high + half
        return (math.log(low), math.log(high)) if "log" in self.kind else (low, high)

    def value(self, place: float):
        low, high = self._ends()
        x = low + place * (high - low)
        x = math.exp(x) if "log" in self.kind else x
        x = round(x) if "int" in self.kind else x
        return min(max(x, self.low), self.high)

    def place(self, value) -> float:
        low, high = self._ends()
        x = math.log(value) if "log" in self.kind else value
        return (x - low) / (high - low) if high > low else 0.5

    def cell(self, value) -> tuple[float, float]:
        """The places whose value is this one: a stretch for an int, a point otherwise."""
        return (self.place(value - 0.5), self.place(value + 0.5)) if "int" in self.kind else (self.place(value),) * 2


class Parzen:
    """A density on [0, 1]: a normal around each point and a wide one in the middle, cut off at the ends.

    A normal is as wide as the distance to its farther neighbour, within bounds that shrink as
    points come in.
    """

    def __init__(self, points: list[float]):
        self.centres = sorted([*points, 0.5])
        least = 1.0 / min(100, len(self.centres) + 1)
        prior = bisect.bisect_left(self.centres, 0.5)
        gaps = [b - a for a, b in itertools.pairwise(self.centres)]
        self.widths = [1.0 if i == prior else min(max(*gaps[max(0, i - 1) : i + 1], least), 1.0) for i in range(len(self.centres))]

    @staticmethod
    def _under(z: float) -> float:
        return 0.5 * math.erfc(-z / math.sqrt(2))

    def density(self, low: float, high: float) -> float:
        """The density at a point, or the mass of a stretch."""
        out = 0.0
        for c, s in zip(self.centres, self.widths, strict=True):
            inside = self._under((1 - c) / s) - self._under(-c / s)
            at = math.exp(-0.5 * ((low - c) / s) ** 2) / (s * math.sqrt(2 * math.pi)) if low == high else self._under((high - c) / s) - self._under((low - c) / s)
            out += at / inside
        return out / len(self.centres)

    def draw(self, rng: random.Random) -> float:
        i = rng.randrange(len(self.centres))
        while True:
            x = rng.gauss(self.centres[i], self.widths[i])
            if 0.0 <= x <= 1.0:
                return x


def suggested(space: dict[str, Dimension], done: list[tuple[dict, float]], rng: random.Random, maximise: bool, first: int = 10, candidates: int = 24) -> dict:
    """The next trial: at random at first, then where good trials are dense and others are not.

    Good are the best tenth, rounded up, 25 at most; a trial whose score is None or NaN is not good.
    """
    if len(done) < first:
        return {name: d.value(rng.random()) for name, d in space.items()}
    worst = -math.inf if maximise else math.inf
    scored = [(p, worst if s is None or math.isnan(s) else s) for p, s in done]
    order = sorted(range(len(scored)), key=lambda i: (-scored[i][1] if maximise else scored[i][1], i))
    n = min(math.ceil(0.1 * len(order)), 25)
    out = {}
    for name, d in space.items():
        good, bad = (Parzen([d.place(scored[i][0][name]) for i in part]) for part in (order[:n], order[n:]))
        tried = [d.value(good.draw(rng)) for _ in range(candidates)]
        out[name] = max(tried, key=lambda v: good.density(*d.cell(v)) / bad.density(*d.cell(v)))
    return out


def _best(done: list[tuple[dict, float]], maximise: bool) -> tuple[dict, float, list]:
    fair = [t for t in done if t[1] is not None and not math.isnan(t[1])]
    if not fair:
        raise ValueError("no trial has a score")
    best = (max if maximise else min)(fair, key=lambda t: t[1])
    return best[0], best[1], done


def tuned(score: Callable[..., float], space: dict[str, tuple], trials: int = 20, maximise: bool = True, seed: int = 42) -> tuple[dict, float, list]:
    """(best parameters, best score, all trials) of a seeded Parzen search.

    space: name -> (low, high, kind) as in ``Dimension``; ``score`` takes the parameters, and
    should be a mean over temporal folds. Equal parameters are scored once.
    """
    return _searched(score, space, trials, maximise, seed, 10)


def random_search(score: Callable[..., float], space: dict[str, tuple], trials: int = 20, maximise: bool = True, seed: int = 42) -> tuple[dict, float, list]:
    """``tuned`` with all trials at random."""
    return _searched(score, space, trials, maximise, seed, trials)


def _searched(score, space, trials, maximise, seed, first):
    if trials < 1:
        raise ValueError("no trials")
    rng, done, known = random.Random(seed), [], {}
    dims = {name: Dimension(*spec) for name, spec in space.items()}
    for _ in range(trials):
        p = suggested(dims, done, rng, maximise, first)
        key = tuple(p.items())
        if key not in known:
            known[key] = score(**p)
        done.append((p, known[key]))
    return _best(done, maximise)
