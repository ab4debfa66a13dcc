"""Intervals and tier probabilities: conformal, bootstrap, quantile and Bayesian models."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import TIER_EDGES, TIERS, linear_quantile, normal_cdf
from plumbline.operators.boosting import BoostedTrees
from plumbline.operators.models import Linear, gramian, ridge, ridge_from
from plumbline.operators.ordered import quantiles, running_total


def uniform(key: str, seed: int) -> Column:
    """A number in (0, 1) that hangs on a row's key and the seed only."""
    return (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def tiers_from_samples(samples: Column) -> dict[str, Column]:
    """Each tier's share of an array of samples, by half-open bands, to four places."""
    edges = [-math.inf, *TIER_EDGES, math.inf]
    return {f"p_{t}": _share(samples, low, high) for t, low, high in zip(TIERS, edges, edges[1:], strict=False)}


def _share(samples: Column, low: float, high: float) -> Column:
    return F.round(F.try_divide(F.size(F.filter(samples, lambda x: (x >= low) & (x < high))).cast("double"), F.size(samples)), 4)


def tiers_from_normal(mean: Column, sd: Column) -> dict[str, Column]:
    """Each tier's probability under a normal distribution, renormalised, to four places."""
    at = [F.lit(0.0), *(normal_cdf(F.lit(e), mean, sd) for e in TIER_EDGES), F.lit(1.0)]
    raw = [F.greatest(b - a, F.lit(0.0)) for a, b in zip(at, at[1:], strict=False)]
    total = sum(raw[1:], raw[0])
    return {f"p_{t}": F.round(p / total, 4) for t, p in zip(TIERS, raw, strict=True)}


def floor_ceiling(samples: Column, low: float = 0.1, high: float = 0.9) -> tuple[Column, Column]:
    return linear_quantile(samples, low), linear_quantile(samples, high)


class SplitConformal:
    """Intervals of constant width from absolute residuals of rows that the model hasn't seen."""

    def __init__(self, features: list[str], target: str, key: str, alpha: float = 0.2, calibration: float = 0.3, penalty: float = 10.0, seed: int = 42):
        self.features, self.target, self.key, self.alpha, self.calibration, self.penalty, self.seed = features, target, key, alpha, calibration, penalty, seed

    def fit(self, df: DataFrame) -> SplitConformal:
        draw = uniform(self.key, self.seed)
        self.model = ridge(df.where(draw >= self.calibration), self.features, self.target, self.penalty)
        residual = F.col(self.target) - self.model.expression()
        held = df.where(draw < self.calibration).select(residual.alias("r"), F.abs(residual).alias("a")).cache()
        n = held.count()
        if not n:
            raise ValueError("no calibration rows")
        level = min(1.0, math.ceil((n + 1) * (1 - self.alpha)) / n)
        self.width = quantiles(held, {"a": [level]}, ceil=True)["a"][0]  # the order statistic above
        self.residuals, self.n = held.select("r"), n
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        return out.withColumns({"lower": F.col("prediction") - self.width, "upper": F.col("prediction") + self.width})

    def tiers(self, df: DataFrame) -> DataFrame:
        """Each tier's share of the prediction plus each of all signed residuals; ``key`` tells rows apart.

        A row asks how many residuals are under each edge less its prediction; questions and
        residuals are put in one order, and a running count answers them all.
        """
        rows = self.model.transform(df)
        asked = rows.select(F.col(self.key).alias("_key"), F.posexplode(F.array(*(F.lit(e) - F.col("prediction") for e in TIER_EDGES))).alias("_edge", "_x")).withColumn("_one", F.lit(0))
        told = self.residuals.select(F.lit(None).cast(df.schema[self.key].dataType).alias("_key"), F.lit(None).cast("int").alias("_edge"), F.col("r").alias("_x"), F.lit(1).alias("_one"))
        under = running_total(asked.union(told), "_x", "_one", "_under", "_one").where("_one = 0")
        below = under.groupBy("_key").agg(*(F.max(F.when(F.col("_edge") == i, F.col("_under"))).alias(f"_c{i}") for i in range(len(TIER_EDGES))))
        at = [F.lit(0), *(F.col(f"_c{i}") for i in range(len(TIER_EDGES))), F.lit(self.n)]
        shares = {f"p_{t}": F.round((b - a) / F.lit(float(self.n)), 4) for t, a, b in zip(TIERS, at, at[1:], strict=False)}
        return rows.join(below, F.col(self.key) == F.col("_key")).withColumns(shares).drop("_key", *(f"_c{i}" for i in range(len(TIER_EDGES))))


class Bootstrap:
    """``members`` ridge models on Poisson-weighted rows; all their Gramians come from one pass."""

    def __init__(self, features: list[str], target: str, key: str, members: int = 30, penalty: float = 10.0, seed: int = 42):
        self.features, self.target, self.key, self.members, self.penalty, self.seed = features, target, key, members, penalty, seed

    def fit(self, df: DataFrame) -> Bootstrap:
        rows = df.select(self.key, *self.features, self.target).withColumn("_member", F.explode(F.sequence(F.lit(0), F.lit(self.members - 1))))
        u = (F.pmod(F.xxhash64(self.key, "_member", F.lit(self.seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        weight, cdf, term = F.lit(0.0), math.exp(-1), math.exp(-1)
        for k in range(1, 8):  # Poisson(1) by inversion
            weight = weight + F.when(u > cdf, 1.0).otherwise(0.0)
            term /= k
            cdf += term
        moments = gramian(rows.withColumn("_w", weight), self.features, self.target, F.col("_w"), "_member")
        self.models = [ridge_from(moments[m], self.features, self.penalty) for m in sorted(moments) if moments[m][0] > 0]
        return self

    def transform(self, df: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
        out = df.withColumn("samples", F.array(*(m.expression() for m in self.models)))
        floor, ceiling = floor_ceiling(F.col("samples"), low, high)
        mean = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x) / len(self.models)
        return out.withColumns({"prediction": mean, "lower": floor, "upper": ceiling})

    def tiers(self, df: DataFrame) -> DataFrame:
        return self.transform(df).withColumns(tiers_from_samples(F.col("samples")))


class QuantileLinear:
    """Quantiles by iteratively reweighted ridge on the pinball loss; sorted so that they don't cross."""

    def __init__(self, features: list[str], target: str, quantiles: list[float] = (0.1, 0.5, 0.9), penalty: float = 1e-3, rounds: int = 12):
        self.features, self.target, self.quantiles, self.penalty, self.rounds = features, target, sorted(quantiles), penalty, rounds

    def fit(self, df: DataFrame) -> QuantileLinear:
        rows = df.select(*self.features, self.target).cache()
        start = ridge(rows, self.features, self.target, self.penalty)
        self.models = []
        for q in self.quantiles:
            model = start
            for _ in range(self.rounds):
                r = F.col(self.target) - model.expression()
                w = F.when(r >= 0, q).otherwise(1 - q) / F.greatest(F.abs(r), F.lit(1e-3))
                model = ridge_from(gramian(rows.withColumn("_w", w), self.features, self.target, F.col("_w"))[None], self.features, self.penalty)
            self.models.append(model)
        rows.unpersist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_q", F.array_sort(F.array(*(m.expression() for m in self.models))))
        names = [f"q{round(100 * q)}" for q in self.quantiles]
        out = out.withColumns({n: F.col("_q")[i] for i, n in enumerate(names)}).drop("_q")
        return out.withColumns({"prediction": F.col(names[len(names) // 2]), "lower": F.col(names[0]), "upper": F.col(names[-1])})


class BayesianLinear:
    """Bayesian ridge by evidence iterations on the Gramian; mean and standard deviation per row."""

    def __init__(self, features: list[str], target: str, rounds: int = 100):
        self.features, self.target, self.rounds = features, target, rounds

    def fit(self, df: DataFrame) -> BayesianLinear:
        n, s, p = gramian(df, self.features, self.target)[None]
        mean = s / n
        c = p - n * np.outer(mean, mean)
        k = len(self.features)
        sd = np.sqrt(np.maximum(np.diag(c)[:k], 0) / n)
        scale = np.where(sd > 1e-12, sd, 1.0)
        xx, xy, yy = c[:k, :k] / np.outer(scale, scale), c[:k, k] / scale, c[k, k]
        a, b = 1.0, n / max(yy, 1e-12)
        for _ in range(self.rounds):
            cov = np.linalg.inv(a * np.eye(k) + b * xx)
            w = b * cov @ xy
            gamma = k - a * np.trace(cov)
            error = max(yy - 2 * w @ xy + w @ xx @ w, 1e-12)
            a, b = gamma / max(w @ w, 1e-12), max(n - gamma, 1e-12) / error
        self.linear = Linear(self.features, w / scale, mean[k] - (w / scale) @ mean[:k])
        self.cov, self.noise, self.mean = cov / np.outer(scale, scale), 1 / b, mean[:k]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        d = [F.col(f) - float(self.mean[i]) for i, f in enumerate(self.features)]
        var = F.lit(float(self.noise))
        for i in range(len(d)):
            for j in range(len(d)):
                var = var + d[i] * d[j] * float(self.cov[i, j])
        out = self.linear.transform(df).withColumn("prediction_sd", F.sqrt(var))
        return out.withColumns(tiers_from_normal(F.col("prediction"), F.col("prediction_sd")))


class QuantileTrees:
    """Quantiles by boosted trees on the pinball loss, all in the same passes; sorted so that they don't cross."""

    def __init__(self, features: list[str], target: str, quantiles: list[float] = (0.1, 0.5, 0.9), trees: int = 100, depth: int = 3, rate: float = 0.1):
        self.quantiles = sorted(quantiles)
        self.trees = BoostedTrees(features, target, "quantile", trees, depth, rate, quantiles=self.quantiles)

    def fit(self, df: DataFrame) -> QuantileTrees:
        self.trees.fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        names = [f"q{round(100 * q)}" for q in self.quantiles]
        out = self.trees.transform(df)
        out = out.withColumns({n: F.col("scores")[i] for i, n in enumerate(names)}).drop("scores")
        return out.withColumns({"prediction": F.col(names[len(names) // 2]), "lower": F.col(names[0]), "upper": F.col(names[-1])})
