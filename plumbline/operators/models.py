"""Models that train on distributed aggregates; what reaches the driver is bounded by the features."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import TIERS, clip, dot
from plumbline.operators.boosting import BoostedTrees
from plumbline.operators.labels import REPLACEMENT


def gramian(df: DataFrame, features: list[str], target: str, weight: Column | None = None, group: str | None = None) -> dict:
    """(n, sums, products) of the features and the target, in one pass: by group, or under None."""
    w = F.lit(1.0) if weight is None else weight
    names = [*features, target]
    terms = [F.sum(w).alias("n"), *(F.sum(w * F.col(c)).alias(f"s{i}") for i, c in enumerate(names))]
    terms += [F.sum(w * F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    rows = (df.groupBy(group).agg(*terms) if group else df.agg(*terms)).collect()
    out, k = {}, len(names)
    for r in rows:
        p = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        out[r[group] if group else None] = (r["n"] or 0.0, np.array([r[f"s{i}"] or 0.0 for i in range(k)]), p)
    return out


class Linear:
    """prediction = intercept + features . weights, as an expression that stays in generated code."""

    def __init__(self, features: list[str], weights, intercept: float):
        self.features, self.weights, self.intercept = features, [float(w) for w in weights], float(intercept)

    def expression(self) -> Column:
        return dot(self.features, self.weights, self.intercept)

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.expression())

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "weights": self.weights, "intercept": self.intercept})

    @staticmethod
    def from_json(text: str) -> Linear:
        return Linear(**json.loads(text))


def ridge_from(moments, features: list[str], alpha: float) -> Linear:
    """Ridge on standardised features from a Gramian; a feature without spread gets weight 0."""
    n, s, p = moments
    if n <= 0:
        raise ValueError("no rows to fit")
    mean = s / n
    c = p - n * np.outer(mean, mean)
    k = len(features)
    sd = np.sqrt(np.maximum(np.diag(c)[:k], 0) / n)
    scale = np.where(sd > 1e-12, sd, 1.0)
    a = c[:k, :k] / np.outer(scale, scale) + alpha * np.eye(k)
    b = np.where(sd > 1e-12, c[:k, k] / scale, 0.0)
    w = np.linalg.lstsq(a, b, rcond=None)[0] / scale
    return Linear(features, w, mean[k] - w @ mean[:k])


def ridge(df: DataFrame, features: list[str], target: str, alpha: float = 10.0) -> Linear:
    return ridge_from(gramian(df, features, target)[None], features, alpha)


def mean_model(df: DataFrame, target: str) -> Linear:
    return Linear([], [], df.agg(F.avg(target)).first()[0])


class DraftPosition:
    """target = a + b ln(pick); a pick under 1 is an error."""

    def __init__(self, pick: str = "draft_pick"):
        self.pick = pick

    def _log(self) -> Column:
        p = F.col(self.pick)
        return F.when(p < 1, F.raise_error(F.lit("pick must be 1 or more")).cast("double")).otherwise(F.log(p.cast("double")))

    def fit(self, df: DataFrame, target: str) -> DraftPosition:
        self.slope, self.intercept = df.agg(F.regr_slope(F.col(target), self._log()), F.regr_intercept(F.col(target), self._log())).first()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(self.intercept) + F.lit(self.slope) * self._log())


class Boxed:
    """A pyspark.ml estimator behind fit and transform; ``prediction`` is P(1) for a classifier."""

    def __init__(self, estimator, features: list[str], target: str):
        self.estimator, self.features, self.target = estimator, features, target

    def _assembled(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.features, outputCol="_features", handleInvalid="keep").transform(df)

    def fit(self, df: DataFrame) -> Boxed:
        self.model = self.estimator.setFeaturesCol("_features").setLabelCol(self.target).fit(self._assembled(df.withColumn(self.target, F.col(self.target).cast("double"))))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self._assembled(df))
        if "probability" in out.columns:
            out = out.withColumn("prediction", vector_to_array("probability")[1])
        return out.drop("_features", "rawPrediction", "probability")


def gbm_regressor(features, target, trees: int = 40, depth: int = 3, rate: float = 0.1) -> BoostedTrees:
    return BoostedTrees(features, target, "squared", int(round(trees)), int(round(depth)), rate)


def gbm_classifier(features, target, trees: int = 40, depth: int = 3, rate: float = 0.1) -> BoostedTrees:
    return BoostedTrees(features, target, "logistic", int(round(trees)), int(round(depth)), rate)


def logistic(features, target, n: int, c: float = 1.0) -> Boxed:
    """Standardised L2 logistic; ``regParam`` is the one that has the optimum of strength ``c`` on ``n`` rows."""
    return Boxed(LogisticRegression(regParam=(n - 1) / (c * n * n), standardization=True), features, target)


class Hurdle:
    """EV = p(reach) * impact + (1 - p) * replacement; the impact head sees rows that reached only."""

    def __init__(self, features: list[str], reach: str = "reached", impact: str = "peak_impact", alpha: float = 10.0):
        self.features, self.reach, self.impact, self.alpha = features, reach, impact, alpha

    def fit(self, df: DataFrame) -> Hurdle:
        rows = df.withColumn("_y", F.col(self.reach).cast("double"))
        n, positive = rows.agg(F.count(F.lit(1)), F.sum("_y")).first()
        if not n:
            raise ValueError("no rows to fit")
        self.constant = positive / n if positive in (0.0, float(n)) else None
        self.head = None if self.constant is not None else logistic(self.features, "_y", n).fit(rows)
        reached = df.where(F.col(self.reach) & F.col(self.impact).isNotNull())
        if reached.limit(2).count() < 2:
            raise ValueError("two rows that reached are needed")
        self.value = ridge(reached, self.features, self.impact, self.alpha)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.head is None:
            out = df.withColumn("p_reach", F.lit(float(self.constant)))
        else:
            out = self.head.transform(df).withColumnRenamed("prediction", "p_reach")
        out = out.withColumn("p_reach", clip(F.col("p_reach"), 0, 1)).withColumn("impact_if_reached", self.value.expression())
        return out.withColumn("prediction", F.col("p_reach") * F.col("impact_if_reached") + (1 - F.col("p_reach")) * REPLACEMENT)


class TierModel:
    """Multinomial logistic probabilities of all tiers; tiers that weren't seen have 0."""

    def __init__(self, features: list[str], tier: str = "outcome_tier", c: float = 1.0):
        self.features, self.tier, self.c = features, tier, c

    def fit(self, df: DataFrame) -> TierModel:
        self.seen = [t for t in TIERS if t in {r[0] for r in df.select(self.tier).distinct().collect()}]
        n = df.count()
        index = reduce(lambda e, t: e.when(F.col(self.tier) == t[1], float(t[0])), enumerate(self.seen), F.when(F.lit(False), 0.0))
        self.boxed = Boxed(LogisticRegression(family="multinomial", regParam=(n - 1) / (self.c * n * n)), self.features, "_tier")
        self.boxed.fit(df.withColumn("_tier", index).where("_tier is not null"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.boxed.model.transform(self.boxed._assembled(df)).withColumn("_p", vector_to_array("probability"))
        return out.withColumns({f"p_{t}": F.round(F.col("_p")[self.seen.index(t)], 4) if t in self.seen else F.lit(0.0) for t in TIERS}).drop("_features", "rawPrediction", "probability", "prediction", "_p")
