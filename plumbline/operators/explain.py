"""Explanations of models, partial dependence, importance and counterfactuals."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.eda import quantile_edges
from plumbline.operators.models import Linear
from plumbline.operators.ordered import numbered


class LinearShap:
    """Shapley values of a linear model: weight times distance from the background's mean."""

    def __init__(self, model: Linear, background: DataFrame):
        self.model = model
        self.means = list(background.agg(*(F.avg(f) for f in model.features)).first())
        self.base = model.intercept + sum(w * m for w, m in zip(model.weights, self.means, strict=True))

    def local(self, df: DataFrame) -> DataFrame:
        """Add ``shap_base`` and ``shap_<feature>``; they sum to the prediction."""
        parts = {f"shap_{f}": (F.col(f) - float(m)) * w for f, w, m in zip(self.model.features, self.model.weights, self.means, strict=True)}
        return df.withColumns({"shap_base": F.lit(float(self.base)), **parts})

    def importance(self, df: DataFrame) -> DataFrame:
        """feature, mean_abs_shap; the largest first."""
        means = self.local(df).agg(F.array(*(F.struct(F.lit(f).alias("feature"), F.avg(F.abs(f"shap_{f}")).alias("mean_abs_shap")) for f in self.model.features)).alias("s"))
        return means.select(F.inline("s")).orderBy(F.desc("mean_abs_shap"), "feature")


def permuted(number: Column, n: int, seed: Column) -> Column:
    """A permutation of 0 to ``n`` - 1 for each ``seed``, as an expression of a number.

    Numbers are places of a grid of hardly more than ``n`` cells; in turn the row moves by a hash
    of the column and the column by a hash of the row, which can be taken back and so is a
    permutation of the cells. What lands beyond ``n`` moves on until it lands within; few cells
    are beyond, so 64 more moves are enough for all of them, or, in large tables, but for a chance
    under 10**-70, which is an error.
    """
    wide = math.isqrt(max(n - 1, 0)) + 1
    high = -(-n // wide) if n else 1

    def move(x: Column) -> Column:
        row, column = F.floor(x / wide).cast("long"), F.pmod(x, F.lit(wide))
        for turn in range(3):
            row = F.pmod(row + F.pmod(F.xxhash64(column, seed, F.lit(2 * turn)), F.lit(high)), F.lit(high))
            column = F.pmod(column + F.pmod(F.xxhash64(row, seed, F.lit(2 * turn + 1)), F.lit(wide)), F.lit(wide))
        return row * wide + column

    # one element bound at a time, so that a move is written out once
    stepped = F.transform(F.array(number.cast("long")), move)
    more = min(64, wide * high - n)
    if more:
        stepped = F.transform(stepped, lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(more)), x, lambda a, _: F.when(a < n, a).otherwise(F.element_at(F.transform(F.array(a), move), 1))))
    out = F.element_at(stepped, 1)
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("a number didn't land")).cast("long"))


def permutation_importance(df: DataFrame, predict: Callable[[DataFrame], DataFrame], metric: Callable[[DataFrame], float] | Column, features: list[str], key: str, shuffles: int = 5, seed: int = 42) -> DataFrame:
    """feature, importance: the mean drop of ``metric`` when a column's values change rows.

    ``key`` tells rows apart; its hashes number them without gaps, cut by cut, and each shuffle
    moves all features of a row to the row of the ``permuted`` number. A metric that is an
    aggregate expression over the scored rows is taken for all features and shuffles in one job,
    in which rows are joined once a shuffle; any other is a function of a scored frame, called
    for each. Without rows there is no importance (null).
    """
    names = list(dict.fromkeys(features))
    rows = numbered(df, [], F.xxhash64(key).cast("double"), [F.xxhash64(key), F.col(key)], "_n").withColumn("_n", F.col("_n") - 1).persist()
    n = rows.count()
    moved = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1)))).select("_k", permuted(F.col("_n"), n, F.col("_k") + seed).alias("_n"), F.struct(*names).alias("_new"))
    if isinstance(metric, Column):
        each = F.array(*(F.lit(i) for i in range(-1, len(names))))  # -1: nothing is changed
        met = rows.join(moved, "_n").withColumn("_i", F.explode(each))
        changed = {f: F.when(F.col("_i") == i, F.col(f"_new.`{f}`")).otherwise(F.col(f)) for i, f in enumerate(names)}
        got = predict(met.withColumns(changed).drop("_new", "_n")).groupBy("_i", "_k").agg(metric.cast("double").alias("m")).collect()
        value = {(r["_i"], r["_k"]): r.m for r in got}
    else:
        base, value = metric(predict(df)), {}
        for k in range(shuffles):
            value[-1, k] = base
            for i, f in enumerate(names):
                value[i, k] = metric(predict(rows.join(moved.where(F.col("_k") == k), "_n").withColumn(f, F.col(f"_new.`{f}`")).select(*df.columns)))
    rows.unpersist()
    out = []
    for i, f in enumerate(names):
        drops = [value.get((-1, k)) - value.get((i, k)) for k in range(shuffles) if value.get((-1, k)) is not None and value.get((i, k)) is not None]
        out.append((f, sum(drops) / len(drops) if drops else None))
    return df.sparkSession.createDataFrame(out, "feature string, importance double").orderBy(F.desc_nulls_last("importance"), "feature")


def partial_dependence(df: DataFrame, expression: Callable[[dict[str, Column]], Column], feature: str, points: int = 20, grid: list[float] | None = None) -> DataFrame:
    """value, mean_prediction over a grid: distinct quantiles unless given; each row meets each point."""
    grid = grid if grid is not None else quantile_edges(df, feature, points - 1)
    met = df.withColumn("_v", F.explode(F.array(*map(F.lit, map(float, grid)))))
    return met.groupBy(F.col("_v").alias("value")).agg(F.avg(expression({feature: F.col("_v")})).alias("mean_prediction")).orderBy("value")


def linear_expression(model: Linear) -> Callable[[dict[str, Column]], Column]:
    """The model's prediction with some features replaced."""
    return lambda new: reduce(lambda s, x: s + new.get(x[0], F.col(x[0])) * x[1], zip(model.features, model.weights, strict=True), F.lit(model.intercept))


def steps(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * i / (n - 1) for i in range(n)]


def single_counterfactual(df: DataFrame, model: Linear, feature: str, target: Column, low: float, high: float, points: int = 101) -> DataFrame:
    """Add ``counterfactual``: the grid value nearest to the present one that reaches ``target``, else null."""
    grid = F.array(*map(F.lit, steps(low, high, points)))
    predict = linear_expression(model)
    fits = F.filter(grid, lambda v: predict({feature: v}) >= target)
    nearest = F.array_min(F.transform(fits, lambda v: F.struct(F.abs(v - F.col(feature)).alias("d"), v.alias("v"))))
    return df.withColumn("counterfactual", nearest["v"])


def greedy_counterfactual(df: DataFrame, model: Linear, bounds: dict[str, tuple[float, float]], target: Column, rounds: int = 3, points: int = 51) -> DataFrame:
    """Add ``projected``, ``reached`` and ``changes``: the best single moves, one a round, until the target.

    All rows are searched in one pass; a feature moves once and only when the prediction gains.
    """
    names = list(bounds)
    predict = linear_expression(model)
    out = df.withColumns({f"_x_{f}": F.col(f) for f in model.features} | {"projected": model.expression(), "_target": target, "changes": F.array().cast("array<struct<feature:string,from_value:double,to_value:double>>")})
    for _ in range(rounds):
        now = {f: F.col(f"_x_{f}") for f in model.features}
        options = []
        for f in names:
            grid = F.array(*map(F.lit, steps(*bounds[f], points)))
            options.append(F.transform(grid, _mover(predict, now, f)))
        best = F.array_max(F.concat(*options))
        out = out.withColumn("_best", best)
        go = (F.col("projected") < F.col("_target")) & (F.col("_best.gain") > F.col("projected"))
        go = go & ~F.exists("changes", lambda c: c["feature"] == F.col("_best.feature"))
        moved = {f"_x_{f}": F.when(go & (F.col("_best.feature") == f), F.col("_best.value")).otherwise(F.col(f"_x_{f}")) for f in names}
        change = F.array(F.struct(F.col("_best.feature").alias("feature"), F.element_at(F.create_map(*(x for f in names for x in (F.lit(f), F.col(f"_x_{f}")))), F.col("_best.feature")).alias("from_value"), F.col("_best.value").alias("to_value")))
        out = out.withColumns({**moved, "changes": F.when(go, F.concat("changes", change)).otherwise(F.col("changes")), "projected": F.when(go, F.col("_best.gain")).otherwise(F.col("projected"))})
    return out.withColumn("reached", F.col("projected") >= F.col("_target")).drop("_best", "_target", *(f"_x_{f}" for f in model.features))


def _mover(predict, now: dict[str, Column], feature: str):
    """A function of a value: the prediction with it, the feature and the value."""

    def move(v: Column) -> Column:
        return F.struct(predict(now | {feature: v}).alias("gain"), F.lit(feature).alias("feature"), v.alias("value"))

    return move


class SampledShap:
    """Shapley values of any model, by sampled orders of the features against the background's means.

    ``predict`` adds ``prediction`` to a frame; each order comes with its reverse. A row meets
    each prefix of each order, ``orders`` * (features + 1) rows in all, and ``predict`` runs once
    over them. Values of a row sum to its prediction less the base whatever the orders are, and
    equal ``LinearShap`` for linear models. ``key`` tells the rows apart.
    """

    def __init__(self, predict: Callable[[DataFrame], DataFrame], features: list[str], background: DataFrame, key: str, orders: int = 16, seed: int = 42):
        self.predict, self.features, self.key = predict, features, key
        self.means = list(background.agg(*(F.avg(f) for f in features)).first())
        rng, n = random.Random(seed), len(features)
        half = [rng.sample(range(n), n) for _ in range(max(1, orders // 2))]
        self.orders = [o for x in half for o in (x, x[::-1])]

    def local(self, df: DataFrame) -> DataFrame:
        """key, shap_base and shap_<feature> of each row."""
        n, k = len(self.features), len(self.orders)
        place = [F.element_at(F.array(*(F.lit(o.index(i)) for o in self.orders)), F.col("_order") + 1) for i in range(n)]
        met = df.select(self.key, *self.features).withColumn("_order", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        met = met.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(n))))
        mixed = {f: F.when(place[i] < F.col("_step"), F.col(f)).otherwise(F.lit(float(self.means[i]))) for i, f in enumerate(self.features)}
        scored = self.predict(met.withColumns(mixed))
        sign = lambda i: F.when(F.col("_step") == place[i] + 1, 1.0).when(F.col("_step") == place[i], -1.0).otherwise(0.0)
        parts = [(F.sum(F.col("prediction") * sign(i)) / k).alias(f"shap_{f}") for i, f in enumerate(self.features)]
        return scored.groupBy(self.key).agg(F.avg(F.when(F.col("_step") == 0, F.col("prediction"))).alias("shap_base"), *parts)

    def importance(self, df: DataFrame) -> DataFrame:
        """feature, mean_abs_shap; the largest first."""
        means = self.local(df).agg(F.array(*(F.struct(F.lit(f).alias("feature"), F.avg(F.abs(f"shap_{f}")).alias("mean_abs_shap")) for f in self.features)).alias("s"))
        return means.select(F.inline("s")).orderBy(F.desc("mean_abs_shap"), "feature")


def model_dependence(df: DataFrame, predict: Callable[[DataFrame], DataFrame], feature: str, points: int = 20, grid: list[float] | None = None) -> DataFrame:
    """``partial_dependence`` of any model: ``predict`` adds ``prediction`` to a frame."""
    grid = grid if grid is not None else quantile_edges(df, feature, points - 1)
    met = df.withColumn("_v", F.explode(F.array(*map(F.lit, map(float, grid))))).withColumn(feature, F.col("_v"))
    return predict(met).groupBy(F.col("_v").alias("value")).agg(F.avg("prediction").alias("mean_prediction")).orderBy("value")
