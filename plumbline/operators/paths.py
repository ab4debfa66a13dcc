"""Penalised linear models for all folds and penalties from one pass over the rows.

Counts, means and co-moments of the features and the target are taken by year, in one aggregate;
those of any set of years follow by addition, on the driver: a few hundred numbers a year, whatever
the rows. So every expanding fold, every penalty and every validation error that is a sum of
squares needs no further job.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.models import Linear
from plumbline.operators.survival import soft
from plumbline.operators.temporal import Fold


@dataclass(frozen=True)
class Moments:
    """Rows, means and summed products of deviations; the target is last."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        apart = other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n))

    def squared_error(self, model: Linear) -> float:
        """Sum of squared errors of a model with these features."""
        w = np.append(-np.array(model.weights), 1.0)
        bias = float(w @ self.mean) - model.intercept
        return max(float(w @ self.products @ w), 0.0) + self.n * bias * bias


def moments(df: DataFrame, features: list[str], target: str, year: str | None = None) -> dict:
    """Moments by year, or under None. Rows without target or year don't count; a null or NaN feature is an error."""
    names = [*features, target]
    x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(names)}
    rows = df.select(*x.values(), *([F.col(year).alias("_y")] if year else [])).where(F.col(f"x{len(features)}").isNotNull())
    rows = rows.where("_y is not null") if year else rows
    terms = [F.count(F.lit(1)).alias("n"), F.sum(F.greatest(*(F.col(f"x{i}").isNull().cast("int") for i in range(len(names))), F.lit(0))).alias("missing")]
    terms += [F.avg(f"x{i}").alias(f"m{i}") for i in range(len(names))]
    terms += [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i in range(len(names)) for j in range(i, len(names))]
    out = {}
    for r in (rows.groupBy("_y").agg(*terms) if year else rows.agg(*terms)).collect():
        if r.missing:
            raise ValueError("nulls are left after preprocessing")
        if r.n:
            products = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))], float) * r.n
            out[r["_y"] if year else None] = Moments(r.n, np.array([r[f"m{i}"] for i in range(len(names))], float), products)
    return out


def total(by_year: dict, years: Iterable) -> Moments:
    """The moments of some years, added in order; none with rows is an error."""
    found = [by_year[y] for y in sorted(years) if y in by_year]
    if not found:
        raise ValueError("no rows to fit")
    return reduce(Moments.__add__, found)


def _standardised(m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(correlations, covariances with the target, deviations) of the features; 0 without spread."""
    k = len(m.mean) - 1
    sd = np.sqrt(np.maximum(np.diag(m.products)[:k], 0.0) / m.n)
    usable = sd > 1e-12 * np.maximum(1.0, np.abs(m.mean[:k]))
    scale = np.where(usable, sd, 1.0)
    keep = np.outer(usable, usable)
    return np.where(keep, m.products[:k, :k] / m.n / np.outer(scale, scale), 0.0), np.where(usable, m.products[:k, k] / m.n / scale, 0.0), np.where(usable, sd, 0.0)


def largest_alpha(m: Moments, l1_ratio: float = 1.0) -> float:
    """The least penalty that sets all weights to 0."""
    return float(np.abs(_standardised(m)[1]).max(initial=0.0)) / l1_ratio


def path(m: Moments, features: list[str], alphas: Iterable[float], l1_ratio: float = 1.0, rounds: int = 10_000, tolerance: float = 1e-13) -> list[Linear]:
    """A model for each penalty, in the order given, by coordinate descent on the moments alone.

    Minimises ``|y - Xw|^2 / 2n + alpha * (l1_ratio * |w| + (1 - l1_ratio) / 2 * w * w)`` over standardised
    features. Larger penalties come first and the next starts from their weights.
    """
    alphas = [float(a) for a in alphas]
    a, b, sd = _standardised(m)
    w, out = np.zeros(len(features)), {}
    for alpha in sorted(set(alphas), reverse=True):
        l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
        left = b - a @ w  # covariances of what is not explained yet
        for _ in range(rounds):
            most = 0.0
            for i in np.flatnonzero(sd):
                to = soft(left[i] + a[i, i] * w[i], l1) / (a[i, i] + l2)
                if to != w[i]:
                    left -= a[:, i] * (to - w[i])
                    most, w[i] = max(most, abs(to - w[i])), to
            if most <= tolerance * max(1.0, np.abs(b).max(initial=0.0)):
                break
        weights = np.divide(w, sd, out=np.zeros_like(w), where=sd > 0)
        out[alpha] = Linear(features, weights, m.mean[-1] - weights @ m.mean[:-1])
    return [out[x] for x in alphas]


def ridge_path(m: Moments, features: list[str], alphas: Iterable[float]) -> list[Linear]:
    """Ridge models that minimise ``|y - Xw|^2 + alpha * w * w``, by one eigendecomposition for all penalties."""
    a, b, sd = _standardised(m)
    values, vectors = np.linalg.eigh(a)
    turned, out = vectors.T @ b, []
    for alpha in alphas:
        under = values + alpha / m.n
        w = vectors @ np.where(under > 1e-12, turned / np.where(under > 1e-12, under, 1.0), 0.0)
        weights = np.divide(w, sd, out=np.zeros_like(w), where=sd > 0)
        out.append(Linear(features, weights, m.mean[-1] - weights @ m.mean[:-1]))
    return out


class Penalised:
    """Elastic net as fit and transform; the objective is that of ``path``."""

    def __init__(self, features: list[str], target: str, alpha: float, l1_ratio: float):
        self.features, self.target, self.alpha, self.l1_ratio = features, target, alpha, l1_ratio

    def fit(self, df: DataFrame) -> Penalised:
        self.model = path(total(moments(df, self.features, self.target), [None]), self.features, [self.alpha], self.l1_ratio)[0]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def elastic_net(features: list[str], target: str, alpha: float = 0.01, l1_ratio: float = 0.5) -> Penalised:
    return Penalised(features, target, alpha, l1_ratio)


def lasso(features: list[str], target: str, alpha: float = 0.01) -> Penalised:
    return elastic_net(features, target, alpha, 1.0)


def fold_paths(df: DataFrame, features: list[str], target: str, folds: list[Fold], alphas: list[float], l1_ratio: float | None = None, year: str = "draft_year") -> list[dict]:
    """fold, alpha, n, rmse and model of each fold and penalty, in one job; ``l1_ratio`` None is ridge.

    n and rmse are of the fold's validation years; a fold without rows there has rmse None.
    """
    by_year, out = moments(df, features, target, year), []
    for fold in folds:
        train = total(by_year, fold.train_years)
        fitted = ridge_path(train, features, alphas) if l1_ratio is None else path(train, features, alphas, l1_ratio)
        held = [by_year[y] for y in fold.val_years if y in by_year]
        for alpha, model in zip(alphas, fitted, strict=True):
            n = sum(h.n for h in held)
            rmse = (sum(h.squared_error(model) for h in held) / n) ** 0.5 if n else None
            out.append({"fold": fold.number, "alpha": float(alpha), "n": n, "rmse": rmse, "model": model})
    return out


def best_alpha(rows: list[dict]) -> float:
    """The penalty with the least mean validation error over folds; of equals the largest."""
    errors: dict[float, list[float]] = {}
    for r in rows:
        if r["rmse"] is not None:
            errors.setdefault(r["alpha"], []).append(r["rmse"])
    if not errors:
        raise ValueError("no validation rows")
    return min(errors, key=lambda a: (sum(errors[a]) / len(errors[a]), -a))


def fold_predictions(df: DataFrame, folds: list[Fold], models: dict[int, Linear], year: str = "draft_year") -> DataFrame:
    """Each validated row with its fold's prediction, in one pass; a row of several folds comes once for each."""
    each = F.array(*(F.when(F.col(year).isin(*f.val_years), F.struct(F.lit(f.number).alias("fold"), models[f.number].expression().alias("prediction"))) for f in folds))
    return df.withColumn("_fold", F.explode(F.array_compact(each))).select(*df.columns, "_fold.fold", "_fold.prediction")
