"""Boosted trees against loops over all splits, and their Shapley values against all subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import models
from plumbline.operators.boosting import BoostedTrees, TreeShap, _stepped, path_values


def planted(spark, n=600, holes=0.2, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, 3)).astype(float)
    gone = rng.random((n, 3)) < holes
    y = np.where(gone[:, 0], 6.0, np.where(x[:, 0] > 5, 4.0, 0.0)) + np.where(x[:, 1] > 8, 2.0, 0.0) * (x[:, 0] > 2) + rng.normal(0, 0.1, n)
    x[gone] = np.nan
    rows = [(i, *(None if np.isnan(v) and i % 2 else float(v) for v in r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double").repartition(3), x, y


def looped(x, g, h, depth, cuts, rate, penalty=1.0, least=1.0):
    """One tree's steps by trying each split of each feature with missing rows on either side."""
    out = np.zeros(len(g))

    def grow(rows, level):
        worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + penalty)
        best = (1e-9 * max(1.0, worth(rows)), None)
        if level < depth:
            for f, c in enumerate(cuts):
                v = x[rows, f]
                for side in (True, False):
                    for t in [*c, math.inf]:
                        left = np.where(np.isnan(v), side, v <= t)
                        a, b = rows[left], rows[~left]
                        if h[a].sum() >= least and h[b].sum() >= least and worth(a) + worth(b) - worth(rows) > best[0] * (1 + 1e-9):
                            best = (worth(a) + worth(b) - worth(rows), (a, b))
        if best[1]:
            grow(best[1][0], level + 1)
            grow(best[1][1], level + 1)
        else:
            out[rows] = -rate * g[rows].sum() / (h[rows].sum() + penalty)

    grow(np.arange(len(g)), 0)
    return out


@pytest.mark.parametrize("loss", ["squared", "logistic"])
def test_trees_equal_loops(spark, loss):
    df, x, y = planted(spark)
    if loss == "logistic":
        df, y = df.withColumn("y", (F.col("y") > 3).cast("int")), (y > 3).astype(float)
    model = BoostedTrees(["a", "b", "c"], "y", loss, trees=4, depth=2, rate=0.5).fit(df)
    score = np.full(len(y), y.mean() if loss == "squared" else math.log(y.mean() / (1 - y.mean())))
    cuts = [sorted(set(c[~np.isnan(c)]))[:-1] for c in x.T]
    for _ in range(4):
        p = 1 / (1 + np.exp(-score))
        g, h = (score - y, np.ones(len(y))) if loss == "squared" else (p - y, p * (1 - p))
        score = score + looped(x, g, h, 2, cuts, 0.5)
    want = score if loss == "squared" else 1 / (1 + np.exp(-score))
    got = np.array([r.prediction for r in model.transform(df).orderBy("id").collect()])
    assert got == pytest.approx(want, abs=1e-9)


def test_missing_values_beat_a_line(spark):
    df, x, y = planted(spark)
    tree = models.gbm_regressor(["a", "b", "c"], "y", trees=25, rate=0.3).fit(df)
    loss = lambda d: d.agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0]
    filled = df.na.fill(float(np.nanmean(x)))
    line = models.ridge(filled, ["a", "b", "c"], "y", 1.0)
    assert loss(tree.transform(df)) < 0.1 * loss(line.transform(filled))
    again = BoostedTrees.from_json(tree.to_json())
    both = [m.transform(df).select("id", "prediction").orderBy("id").collect() for m in (again, tree)]
    assert both[0] == both[1]


def test_many_values_are_binned_and_odd_tables(spark):
    df = spark.range(3000).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("flat"), F.lit(None).cast("double").alias("gone"), F.when(F.col("id") < 1500, 0.0).otherwise(1.0).alias("y"))
    model = BoostedTrees(["x", "flat", "gone"], "y", trees=3, depth=2, rate=1.0, penalty=0.0).fit(df)
    assert model.transform(df).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 0.1
    assert {f for t in model.models[0] for f in t["feature"]} <= {-1, 0}
    one = models.gbm_classifier(["x"], "y", trees=2).fit(df.where("y = 1"))
    assert one.transform(df).agg(F.min("prediction")).first()[0] == 1.0
    with pytest.raises(ValueError):
        BoostedTrees(["x"], "y").fit(df.where("false"))
    assert models.gbm_classifier(["x"], "y", trees=2).fit(df).transform(df.where("false")).collect() == []


def subsets(tree, row):
    """Shapley values of one tree by all subsets of features: unknown ones follow the training shares."""
    d = len(row)

    def worth(known, node=0):
        f = tree["feature"][node]
        if f < 0:
            return tree["step"][node]
        left, right = tree["left"][node], tree["right"][node]
        if f in known:
            goes = tree["missing_left"][node] if np.isnan(row[f]) else row[f] <= tree["threshold"][node]
            return worth(known, left if goes else right)
        return (tree["n"][left] * worth(known, left) + tree["n"][right] * worth(known, right)) / tree["n"][node]

    out = []
    for j in range(d):
        rest = [i for i in range(d) if i != j]
        out.append(sum(math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) * (worth({*s, j}) - worth(set(s))) for k in range(d) for s in itertools.combinations(rest, k)))
    return out


def test_shapley_values_equal_all_subsets(spark):
    df, x, y = planted(spark)
    model = BoostedTrees(["a", "b", "c"], "y", trees=5, depth=4, rate=0.4, least=5.0).fit(df)
    shap = TreeShap(model)
    got = shap.local(model.transform(df)).orderBy("id").collect()
    for r, row in list(zip(got, x, strict=True))[::29]:
        assert [r.shap_a, r.shap_b, r.shap_c] == pytest.approx(np.sum([subsets(t, row) for t in model.models[0]], axis=0), abs=1e-9)
    for r in got:
        assert r.shap_base + r.shap_a + r.shap_b + r.shap_c == pytest.approx(r.prediction, abs=1e-9)
    assert sum(_stepped(t, x).mean() for t in model.models[0]) + model.base[0] == pytest.approx(shap.base, abs=1e-9)
    top = shap.importance(df).first()
    assert top.feature == "a" and top.mean_abs_shap > 0


def test_path_of_one_feature():
    assert path_values(4.0, [0.25]).tolist() == [[-1.0], [3.0]]
