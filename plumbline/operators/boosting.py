"""Gradient boosted trees over histograms, with a learned side for missing values, and their exact Shapley values.

Values are cut into bins once. A level of all trees of a round is one aggregate: the sums of
gradients and curvatures by (head, node, feature, bin), whose size hangs on the trees and not on
the rows; Spark combines it within tasks and the driver picks the splits. For each split the
missing rows are tried on both sides. Several heads (quantiles) grow in the same passes.
"""

from __future__ import annotations

import json
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut
from plumbline.functions.workers import importable
from plumbline.operators.ordered import quantiles

#: Rounds whose trees are added to the scores before these are written and read again.
ROUNDS = 8
#: Features on one path that Shapley values are worked out for at most: 2**12 patterns a leaf.
DEEP = 12


def _number(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


class BoostedTrees:
    """Trees by second-order gains on ``loss``: squared, logistic, or quantile (a head for each of ``quantiles``).

    A split's gain is GL**2 / (HL + penalty) + GR**2 / (HR + penalty) - G**2 / (H + penalty); a side
    has curvature ``least`` at least. A leaf's step is ``rate`` times -G / (H + penalty), for a quantile
    ``rate`` times the leaf's own quantile of the residuals. Ties go to the first feature, the lowest cut, and
    missing values on the left.

    Cases: a null or NaN feature is missing, at fit and at predict; where a node had none missing they
    go to its larger side; rows without a target are left out; no rows are an error; a feature without
    two bins is never split; a classifier's target of one class gives that class's share, without trees.
    """

    def __init__(self, features: list[str], target: str, loss: str = "squared", trees: int = 40, depth: int = 3, rate: float = 0.1, bins: int = 64, penalty: float = 1.0, least: float = 1.0, quantiles: list[float] = (0.5,)):
        if loss not in ("squared", "logistic", "quantile") or not 2 <= bins <= 128:
            raise ValueError("a loss of squared, logistic or quantile, and 2 to 128 bins")
        self.features, self.target, self.loss = list(features), target, loss
        self.trees, self.depth, self.rate, self.bins, self.penalty, self.least = trees, depth, rate, bins, penalty, least
        self.quantiles = list(quantiles) if loss == "quantile" else [None]

    # --- fitting

    def _cuts(self, rows: DataFrame) -> list[list[float]]:
        """The values that part each feature's bins: all but the last if they are few, else quantiles."""
        steps, names = [i / self.bins for i in range(1, self.bins)], [f"x{i}" for i in range(len(self.features))]
        if not names:
            return []
        got = rows.agg(*(F.struct(F.approx_count_distinct(c, 0.02).alias("n"), F.percentile_approx(c, steps, F.lit(10_000)).alias("q"), F.max(c).alias("top")).alias(c) for c in names)).first()
        few = [c for c in names if got[c].n <= self.bins]
        values = rows.agg(*(F.collect_set(c).alias(c) for c in few)).first().asDict() if few else {}
        return [sorted(v for v in set(values.get(c) or got[c].q or []) if v < got[c].top) for c in names]

    def _bases(self, rows: DataFrame) -> list[float]:
        if self.loss == "quantile":
            base = quantiles(rows, {"y": self.quantiles})["y"]
        else:
            base = [rows.agg(F.avg("y")).first()[0]]
        if base[0] is None:
            raise ValueError("no rows with a target")
        if self.loss == "logistic":
            p = base[0]
            base = [math.log(p / (1 - p)) if 0 < p < 1 else math.copysign(math.inf, p - 0.5)]
        return base

    def _slopes(self, h: int) -> tuple[Column, Column]:
        """Gradient and curvature of the loss in a row's score."""
        s = F.col(f"s{h}")
        if self.loss == "squared":
            return s - F.col("y"), F.lit(1.0)
        if self.loss == "logistic":
            p = 1 / (1 + F.exp(-s))
            return p - F.col("y"), p * (1 - p)
        return F.when(F.col("y") > s, -self.quantiles[h]).otherwise(1 - self.quantiles[h]), F.lit(1.0)

    def fit(self, df: DataFrame) -> BoostedTrees:
        x = [_number(c).alias(f"x{i}") for i, c in enumerate(self.features)]
        rows = cut(df.select(*x, _number(self.target).alias("y")).where("y is not null"))
        self.base, cuts = self._bases(rows), self._cuts(rows)
        self.models, heads = [[] for _ in self.base], range(len(self.base))
        if not all(map(math.isfinite, self.base)):
            return self
        of = lambda i: F.when(F.col(f"x{i}").isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts[i])), lambda c: c < F.col(f"x{i}"))) if cuts[i] else 0)
        rows = cut(rows.select("y", *(F.lit(float(b)).alias(f"s{h}") for h, b in enumerate(self.base)), *(of(i).cast("byte").alias(f"b{i}") for i in range(len(cuts)))))
        for k in range(self.trees):
            grown = self._round(rows, cuts)
            for h in heads:
                self.models[h].append(_flat(grown[h], cuts))
            rows = rows.withColumns({f"s{h}": F.col(f"s{h}") + _walk(grown[h], lambda n: F.lit(float(n["step"]))) for h in heads})
            if k % ROUNDS == ROUNDS - 1:
                rows = cut(rows)
        return self

    def _round(self, rows: DataFrame, cuts: list[list[float]]) -> list[dict]:
        """The next tree of each head."""
        trees = [{"id": 0} for _ in self.base]
        for level in range(self.depth):
            open_ = {(h, n["id"]): n for h, t in enumerate(trees) for n in _leaves(t) if n["id"] >= 2**level - 1}
            if not open_:
                break
            entries = [F.struct(F.lit(h).alias("h"), _walk(t, lambda n: F.lit(n["id"])).alias("node"), self._slopes(h)[0].alias("g"), self._slopes(h)[1].alias("c"), F.lit(i).alias("f"), F.col(f"b{i}").alias("b")) for h, t in enumerate(trees) for i in range(len(cuts))]
            if not entries:
                break
            met = rows.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where(F.col("node") >= 2**level - 1)
            sums = met.groupBy("h", "node", "f", "b").agg(F.sum("g").alias("g"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
            tables: dict = {}
            for r in sums:
                table = tables.setdefault((r.h, r.node), np.zeros((len(cuts), 3, self.bins + 1)))
                table[r.f, :, r.b + 1] = r.g, r.c, r.n
            for key, node in open_.items():
                if key in tables:
                    self._split(node, tables[key], cuts)
        for t in trees:
            for leaf in _leaves(t):
                g, c, n = leaf.get("sums", (0.0, 0.0, 0.0))
                leaf["step"], leaf["n"] = -self.rate * g / (c + self.penalty), n
        if self.loss == "quantile":
            self._own_steps(rows, trees)
        return trees

    def _split(self, node: dict, table: np.ndarray, cuts: list[list[float]]) -> None:
        """Give ``node`` its best split, if one gains."""
        total = table[0].sum(1)
        node["sums"] = tuple(total)
        worth = lambda s: s[0] ** 2 / (s[1] + self.penalty)
        best = (1e-9 * max(1.0, worth(total)), None)
        for i, c in enumerate(cuts):
            missing, up_to = table[i, :, :1], np.cumsum(table[i, :, 1 : len(c) + 2], axis=1)
            for left_missing in (True, False):
                left = up_to + missing if left_missing else up_to
                if not missing[2, 0]:
                    if not left_missing:
                        continue
                    left = left[:, :-1]
                right = total[:, None] - left
                gain = np.where((left[1] >= self.least) & (right[1] >= self.least), worth(left) + worth(right) - worth(total), -np.inf)
                if gain.size and gain.max() > best[0] * (1 + 1e-12):
                    k = int(gain.argmax())
                    goes_left = left_missing if missing[2, 0] else bool(left[2, k] >= right[2, k])
                    best = (float(gain[k]), (i, k, goes_left, left[:, k], right[:, k]))
        if best[1]:
            i, k, missing_left, left, right = best[1]
            node["split"] = (i, k, missing_left)
            node["children"] = [{"id": 2 * node["id"] + 1 + j, "sums": tuple(s)} for j, s in enumerate((left, right))]

    def _own_steps(self, rows: DataFrame, trees: list[dict]) -> None:
        """Steps of leaves by their rows' quantile of the residuals, of all heads in one job."""
        entries = [F.struct(F.lit(h).alias("h"), _walk(t, lambda n: F.lit(n["id"])).alias("node"), (F.col("y") - F.col(f"s{h}")).alias("r")) for h, t in enumerate(trees)]
        met = rows.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
        at = reduce(lambda e, h: e.when(F.col("h") == h[0], h[1]), enumerate(self.quantiles), F.when(F.lit(False), 0.0))
        points = sorted(set(self.quantiles))
        got = met.groupBy("h", "node").agg(F.percentile_approx("r", points, F.lit(10_000)).alias("q"), F.count(F.lit(1)).alias("n"), F.first(at).alias("at")).collect()
        for r in got:
            leaf = next(n for n in _leaves(trees[r.h]) if n["id"] == r.node)
            leaf["step"], leaf["n"] = self.rate * r.q[points.index(r["at"])], r.n

    # --- predicting

    def scores(self) -> Column:
        """An array of each head's score of a row, before any link."""
        models = [(b, t) for b, t in zip(self.base, self.models, strict=True)]

        @F.pandas_udf("array<double>")
        def score(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(float, na_value=np.nan) for c in columns[1:]]) if len(columns) > 1 else np.zeros((len(columns[0]), 0))
            return pd.Series(list(np.column_stack([b + sum((_stepped(t, x) for t in trees), np.zeros(len(x))) for b, trees in models])))

        return score(F.lit(0), *map(_number, self.features))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``: the score, of a classifier P(1); of quantiles their sorted values as an array ``scores``."""
        importable(df.sparkSession)
        if self.loss == "quantile":
            return df.withColumn("scores", F.array_sort(self.scores()))
        s = self.scores()[0]
        return df.withColumn("prediction", 1 / (1 + F.exp(-s)) if self.loss == "logistic" else s)

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def from_json(text: str) -> BoostedTrees:
        model = BoostedTrees([], "")
        model.__dict__.update(json.loads(text))
        return model


def _leaves(node: dict) -> list[dict]:
    return [x for c in node["children"] for x in _leaves(c)] if "children" in node else [node]


def _walk(node: dict, leaf) -> Column:
    """What ``leaf`` makes of the leaf that a row of bins falls into."""
    if "children" not in node:
        return leaf(node)
    i, k, missing_left = node["split"]
    left = F.col(f"b{i}") <= k if missing_left else F.col(f"b{i}").between(0, k)
    return F.when(left, _walk(node["children"][0], leaf)).otherwise(_walk(node["children"][1], leaf))


def _flat(tree: dict, cuts: list[list[float]]) -> dict[str, list]:
    """A tree as lists by node: feature (-1: a leaf), threshold, missing_left, left, right, step, n."""
    out = {k: [] for k in ("feature", "threshold", "missing_left", "left", "right", "step", "n")}

    def add(node: dict) -> int:
        at = len(out["step"])
        for v in out.values():
            v.append(0)
        if "children" not in node:
            out["feature"][at], out["step"][at], out["n"][at] = -1, float(node["step"]), float(node["n"])
            return at
        i, k, missing_left = node["split"]
        # the cut after the last one parts what is there from what is missing
        out["feature"][at], out["threshold"][at], out["missing_left"][at] = i, cuts[i][k] if k < len(cuts[i]) else math.inf, missing_left
        out["left"][at], out["right"][at] = add(node["children"][0]), add(node["children"][1])
        out["n"][at] = out["n"][out["left"][at]] + out["n"][out["right"][at]]
        return at

    add(tree)
    return out


def _goes_left(tree: dict, node: int, x: np.ndarray) -> np.ndarray:
    v = x[:, tree["feature"][node]]
    return np.where(np.isnan(v), tree["missing_left"][node], v <= tree["threshold"][node])


def _stepped(tree: dict, x: np.ndarray) -> np.ndarray:
    """Each row's step of one tree."""
    out = np.empty(len(x))

    def walk(node: int, rows: np.ndarray) -> None:
        if tree["feature"][node] < 0:
            out[rows] = tree["step"][node]
        elif len(rows):
            left = _goes_left(tree, node, x[rows])
            walk(tree["left"][node], rows[left])
            walk(tree["right"][node], rows[~left])

    walk(0, np.arange(len(x)))
    return out


def _paths(tree: dict) -> list[tuple[float, list[int], list[float], list[list[tuple[int, bool]]]]]:
    """Of each leaf: its step, the features on its path, each one's share of training rows that go its way
    there, and its nodes with the side that the path takes."""
    out = []

    def walk(node: int, path: dict) -> None:
        if tree["feature"][node] < 0:
            out.append((tree["step"][node], list(path), [z for z, _ in path.values()], [w for _, w in path.values()]))
            return
        f = tree["feature"][node]
        z, way = path.get(f, (1.0, []))
        for side in ("left", "right"):
            child = tree[side][node]
            share = tree["n"][child] / tree["n"][node] if tree["n"][node] else 0.5
            walk(child, path | {f: (z * share, [*way, (node, side == "left")])})

    walk(0, {})
    return out


def path_values(step: float, shares: list[float]) -> np.ndarray:
    """[pattern, feature]: Shapley values of a leaf's step for each set of features, as bits, that go its way.

    In a set S of known features the leaf counts by the product of 1 or 0 for S and of shares for the
    rest. The products over the other features by the size of S are a polynomial's coefficients, which
    grow by one feature at a time, and are weighted by sizes.
    """
    d = len(shares)
    patterns = np.arange(1 << d)
    goes = [(patterns >> i & 1).astype(float) for i in range(d)]
    weight = [math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)]
    out = np.zeros((1 << d, d))
    for j in range(d):
        sizes = [np.ones(1 << d)]
        for i in (i for i in range(d) if i != j):
            sizes = [a * shares[i] + b * goes[i] for a, b in zip([*sizes, 0.0], [0.0, *sizes], strict=True)]
        out[:, j] = step * (goes[j] - shares[j]) * sum(w * c for w, c in zip(weight, sizes, strict=True))
    return out


class TreeShap:
    """Exact Shapley values of boosted trees, where unknown features follow the training rows' shares.

    A leaf's values hang only on which of its path's features go its way, so they are worked out once
    for each pattern; a row looks its patterns up, leaf by leaf, and is never copied. Values of
    a row and ``shap_base`` sum to its score (a classifier's before the logistic link).
    """

    def __init__(self, model: BoostedTrees, head: int = 0):
        self.model, self.head, self.leaves, self.base = model, head, [], float(model.base[head])
        for tree in model.models[head]:
            for step, features, shares, ways in _paths(tree):
                if len(features) > DEEP:
                    raise ValueError(f"a path of over {DEEP} features")
                self.base += step * math.prod(shares)
                if features:
                    self.leaves.append((tree, features, ways, path_values(step, shares)))

    def values(self, x: np.ndarray) -> np.ndarray:
        """Shapley values [row, feature] of rows of numbers, missing ones NaN."""
        out, held = np.zeros(x.shape), {}
        for tree, features, ways, table in self.leaves:
            if id(tree) not in held:
                held = {id(tree): {n: _goes_left(tree, n, x) for n, f in enumerate(tree["feature"]) if f >= 0}}
            pattern = np.zeros(len(x), np.int64)
            for bit, way in enumerate(ways):
                ok = np.ones(len(x), bool)
                for node, left in way:
                    ok &= held[id(tree)][node] == left
                pattern |= ok.astype(np.int64) << bit
            for j, f in enumerate(features):
                out[:, f] += table[pattern, j]
        return out

    def local(self, df: DataFrame) -> DataFrame:
        """Add ``shap_base`` and ``shap_<feature>``."""
        importable(df.sparkSession)
        explain = self

        @F.pandas_udf("array<double>")
        def values(*columns: pd.Series) -> pd.Series:
            return pd.Series(list(explain.values(np.column_stack([c.to_numpy(float, na_value=np.nan) for c in columns]))))

        names = self.model.features
        out = df.withColumn("_shap", values(*map(_number, names)))
        return out.withColumns({"shap_base": F.lit(self.base), **{f"shap_{f}": F.col("_shap")[i] for i, f in enumerate(names)}}).drop("_shap")

    def importance(self, df: DataFrame) -> DataFrame:
        """feature, mean_abs_shap; the largest first."""
        names = self.model.features
        means = self.local(df).agg(F.array(*(F.struct(F.lit(f).alias("feature"), F.avg(F.abs(f"shap_{f}")).alias("mean_abs_shap")) for f in names)).alias("s"))
        return means.select(F.inline("s")).orderBy(F.desc("mean_abs_shap"), "feature")
