"""Cox, penalised paths and the Parzen search, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import models, paths, search, survival, temporal


def objective(beta, z, t, e, penalty, l1_ratio):
    """Efron's negative log likelihood a row, with the penalty, event by event."""
    risk, out = np.exp(z @ beta), 0.0
    for now in set(t[e]):
        tied = np.flatnonzero(e & (t == now))
        for place, i in enumerate(tied):
            out -= z[i] @ beta - math.log(risk[t >= now].sum() - place / len(tied) * risk[tied].sum())
    return out / len(t) + penalty * (l1_ratio * np.abs(beta).sum() + (1 - l1_ratio) / 2 * beta @ beta)


def careers(spark, n, ties, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 3, 9]
    t = rng.exponential(np.exp(-0.8 * x[:, 0]))
    t = np.ceil(t * ties) if ties else t
    e = rng.random(n) < 0.7
    df = spark.createDataFrame([(*map(float, r), float(a), bool(c)) for r, a, c in zip(x, t, e, strict=True)], "a double, b double, c double, t double, e boolean")
    return df, (x - x.mean(0)) / x.std(0, ddof=1), t, e


@pytest.mark.parametrize("ties, l1_ratio, block", [(3, 0.0, 7), (0, 0.0, 100), (2, 0.7, 1)])
def test_cox_is_at_the_least_of_the_objective(spark, ties, l1_ratio, block):
    df, z, t, e = careers(spark, 150, ties)
    m = survival.Cox(["a", "b", "c"], "t", "e", 0.05, l1_ratio, block=block).fit(df)
    f = lambda beta: objective(beta, z, t, e, 0.05, l1_ratio)
    assert m.objectives[-1] == pytest.approx(f(m.beta), abs=1e-9)
    assert m.objectives == sorted(m.objectives, reverse=True)
    for i in range(3):
        for h in (-1e-3, 1e-3):
            moved = m.beta.copy()
            moved[i] += h
            assert f(moved) > f(m.beta) - 1e-12
    if l1_ratio:
        assert 0.0 in m.beta and m.beta[0] > 0
    risk = np.array([r.risk for r in m.transform(df).collect()])
    assert risk == pytest.approx(np.exp(z @ m.beta))


def test_cox_of_odd_tables(spark):
    df, *_ = careers(spark, 40, 2)
    with pytest.raises(ValueError, match="no rows"):
        survival.Cox(["a"], "t", "e").fit(df.where("false"))
    assert survival.Cox(["a"], "t", "e").fit(df.withColumn("e", F.lit(False))).beta.tolist() == [0.0]
    flat = survival.Cox(["a", "one"], "t", "e").fit(df.withColumn("one", F.lit(1.0)))
    assert flat.beta[1] == 0 and flat.beta[0] != 0
    holes = df.unionByName(df.withColumn("a", F.lit(None).cast("double"))).unionByName(df.withColumn("t", F.lit(float("nan"))))
    assert survival.Cox(["a"], "t", "e").fit(holes).beta == pytest.approx(survival.Cox(["a"], "t", "e").fit(df).beta)


@pytest.fixture(scope="module")
def seasons(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)) + 1e6
    x[:, 3] = x[:, 0] + 0.01 * x[:, 1]
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(size=300)
    df = spark.createDataFrame([(*map(float, r), float(v), 2000 + i % 8) for i, (r, v) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, d double, y double, draft_year int")
    return df.cache(), x, y, 2000 + np.arange(300) % 8


def test_paths_fulfil_the_conditions_of_the_optimum(seasons):
    df, x, y, _ = seasons
    z = (x - x.mean(0)) / x.std(0)
    m = paths.total(paths.moments(df, list("abcd"), "y"), [None])
    for l1_ratio in (1.0, 0.5):
        for alpha, model in zip((1.0, 0.01, 0.1), paths.path(m, list("abcd"), (1.0, 0.01, 0.1), l1_ratio), strict=True):
            w = np.array(model.weights) * x.std(0)
            slope = z.T @ (y - y.mean() - z @ w) / len(y) - alpha * (1 - l1_ratio) * w
            assert np.all(np.abs(slope) <= alpha * l1_ratio + 1e-6)
            assert slope[w != 0] == pytest.approx(alpha * l1_ratio * np.sign(w[w != 0]), abs=1e-6)
    over = paths.largest_alpha(m)
    assert not any(paths.path(m, list("abcd"), [over * 1.0001])[0].weights) and any(paths.path(m, list("abcd"), [over * 0.99])[0].weights)
    assert paths.lasso(list("abcd"), "y", 0.1).fit(df).model.weights == pytest.approx(paths.path(m, list("abcd"), [0.1])[0].weights)


def test_all_folds_and_penalties_in_one_job(spark, seasons):
    df, x, y, year = seasons
    folds = temporal.walk_forward(sorted(set(year.tolist())), 4)
    df.count()
    spark.sparkContext.setJobGroup("paths", "")
    found = paths.fold_paths(df, list("abc"), "y", folds, [0.5, 5.0])
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("paths"))
    spark.sparkContext.setJobGroup("other", "")
    assert jobs <= 2  # adaptive execution runs the shuffle's map side as a job
    assert len(found) == 8
    for r in found:
        train, val = np.isin(year, folds[r["fold"]].train_years), np.isin(year, folds[r["fold"]].val_years)
        z = (x[train, :3] - x[train, :3].mean(0)) / x[train, :3].std(0)
        w = np.linalg.solve(z.T @ z + r["alpha"] * np.eye(3), z.T @ (y[train] - y[train].mean())) / x[train, :3].std(0)
        error = y[val] - y[train].mean() - (x[val, :3] - x[train, :3].mean(0)) @ w
        assert r["n"] == val.sum() and r["rmse"] == pytest.approx(np.sqrt(np.mean(error**2)), rel=1e-6)
    best = paths.best_alpha(found)
    chosen = {r["fold"]: r["model"] for r in found if r["alpha"] == best}
    scored = paths.fold_predictions(df, folds, chosen)
    per_fold = {r.fold: r.e for r in scored.groupBy("fold").agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2)).alias("e")).collect()}
    assert per_fold == pytest.approx({r["fold"]: r["rmse"] for r in found if r["alpha"] == best}, rel=1e-6)


def test_paths_of_odd_tables(spark, seasons):
    df = seasons[0]
    with pytest.raises(ValueError, match="no rows"):
        paths.lasso(["a"], "y").fit(df.where("false"))
    with pytest.raises(ValueError, match="nulls"):
        paths.lasso(["a"], "y").fit(df.withColumn("a", F.when(F.col("b") > 1e6, F.col("a"))))
    flat = paths.elastic_net(["a", "one"], "y", 0.01).fit(df.withColumn("one", F.lit(7.0))).model
    assert flat.weights[1] == 0 and flat.weights[0] != 0
    assert paths.lasso(["a"], "y").fit(df.where("a = (select 1.0)").union(df.limit(1))).model.weights == [0.0]
    none = paths.lasso([], "y").fit(df).model
    assert none.intercept == pytest.approx(seasons[2].mean())
    twice = temporal.walk_forward(sorted({r[0] for r in df.select("draft_year").distinct().collect()}), 4, horizon=2)
    got = paths.fold_predictions(df, twice, {f.number: models.Linear([], [], 0.0) for f in twice})
    assert got.count() == sum(df.where(F.col("draft_year").isin(*f.val_years)).count() for f in twice)


def surface(x, n, rate):
    return -((x - 0.3) ** 2) * 4 - ((n - 17) / 20) ** 2 - (math.log10(rate) + 2) ** 2


SPACE = {"x": (-2.0, 2.0, "float"), "n": (1, 60, "logint"), "rate": (1e-5, 1.0, "log")}


def test_parzen_search_beats_random_search():
    runs = [(search.tuned(surface, SPACE, 50, seed=s)[1], search.random_search(surface, SPACE, 50, seed=s)[1]) for s in range(12)]
    better = sum(a > b for a, b in runs)
    assert better >= 9 and np.median([a for a, _ in runs]) > np.median([b for _, b in runs])
    assert search.tuned(surface, SPACE, 30, seed=3) == search.tuned(surface, SPACE, 30, seed=3)
    low = search.tuned(lambda **p: -surface(**p), SPACE, 50, maximise=False, seed=0)
    assert low[1] == pytest.approx(-runs[0][0])


def test_parzen_search_keeps_to_its_ranges():
    _, _, done = search.tuned(lambda **p: sum(p.values()), {"a": (1, 3, "int"), "b": (2.0, 2.0, "float"), "c": (1e-3, 10.0, "log")}, 40)
    for p, _ in done:
        assert p["a"] in (1, 2, 3) and isinstance(p["a"], int) and p["b"] == 2.0 and 1e-3 <= p["c"] <= 10.0
    best, score, _ = search.tuned(lambda x: math.nan if x < 0 else x, {"x": (-1.0, 1.0, "float")}, 30)
    assert best["x"] == score > 0.5
    with pytest.raises(ValueError, match="score"):
        search.tuned(lambda x: math.nan, {"x": (-1.0, 1.0, "float")}, 3)
    with pytest.raises(ValueError, match="kind"):
        search.tuned(lambda x: x, {"x": (0.0, 1.0, "round")}, 3)


def test_parzen_density_sums_to_one():
    rng = random.Random(0)
    p = search.Parzen([rng.random() ** 3 for _ in range(20)])
    assert sum(p.density((i + 0.5) / 5000, (i + 0.5) / 5000) for i in range(5000)) / 5000 == pytest.approx(1, abs=1e-3)
    cells = [search.Dimension(1, 9, "logint").cell(v) for v in range(1, 10)]
    assert cells[0][0] == 0 and cells[-1][1] == 1 and sum(p.density(*c) for c in cells) == pytest.approx(1)
    assert all(0 <= p.draw(rng) <= 1 for _ in range(200))
