"""k-means from many starts against runs of plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import clusters


def lloyd(x, k, rng):
    """The cost of one run from random rows."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(100):
        at = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.array([x[at == i].mean(0) if (at == i).any() else c[i] for i in range(k)])
    return ((x[:, None] - c) ** 2).sum(2).min(1).sum()


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(6, 3)) * 8
    x = np.concatenate([m + rng.normal(size=(60, 3)) for m in middles])
    df = spark.createDataFrame([(i, i // 60, *map(float, r)) for i, r in enumerate(x)], "id int, truth int, a double, b double, c double").cache()
    return df, (x - x.mean(0)) / x.std(0)


def test_cost_is_no_worse_than_ten_runs(spark, planted):
    df, z = planted
    spark.sparkContext.setJobGroup("kmeans", "")
    got, model = clusters.kmeans(df, ["a", "b", "c"], 6)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("kmeans"))
    spark.sparkContext.setJobGroup("other", "")
    rng = np.random.default_rng(0)
    assert model.cost <= min(lloyd(z, 6, rng) for _ in range(10)) * (1 + 1e-6)
    assert model.cost == pytest.approx(((z[:, None] - model.centres) ** 2).sum(2).min(1).sum())
    at = [r.cluster for r in got.orderBy("id").collect()]
    assert at == ((z[:, None] - model.centres) ** 2).sum(2).argmin(1).tolist()
    assert jobs <= 2 * (2 + 11 + 51)  # a pass of all starts is one aggregate
    again = clusters.kmeans(df.repartition(7), ["a", "b", "c"], 6)[1]
    assert again.centres == pytest.approx(model.centres)


def test_odd_tables(spark, planted):
    df, _ = planted
    with pytest.raises(ValueError, match="no rows"):
        clusters.kmeans(df.where("false"), ["a"], 2)
    same = df.select(F.lit(4.0).alias("a"), F.lit(None).cast("double").alias("b"))
    got, model = clusters.kmeans(same, ["a", "b"], 3, starts=2)
    assert len(model.centres) == 1 and model.cost == 0 and got.select("cluster").distinct().count() == 1
    hot = df.select(F.when(F.col("id") % 3 > 0, F.lit(1.0)).otherwise(F.col("id") % 2 * 5.0).alias("a"), F.lit(float("nan")).alias("b"))
    got, model = clusters.kmeans(hot, ["a", "b"], 5, starts=3)
    assert len(model.centres) == 3 and model.cost == pytest.approx(0, abs=1e-9)
    assert got.groupBy("cluster").agg(F.countDistinct("a").alias("n")).where("n > 1").isEmpty()
