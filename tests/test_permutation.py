"""Importance by permutation, against loops over the same moves."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import explain, models

FEATURES = ["a", "b"]

def rmse():
    return F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permuted_numbers_are_a_permutation(spark, n):
    got = spark.range(n).select(*(explain.permuted(F.col("id"), n, F.lit(s)).alias(f"s{s}") for s in (1, 2))).collect()
    assert sorted(r.s1 for r in got) == sorted(r.s2 for r in got) == list(range(n))
    if n > 100:
        assert sum(r.s1 == r.s2 for r in got) < 20 and sum(r.s1 == i for i, r in enumerate(got)) < 20


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(200).select("id", ((F.col("id") * 37 % 101) / 10.0).alias("a"), ((F.col("id") * 53 % 89) / 10.0).alias("b")).withColumn("y", 3 * F.col("a") + 0.1 * F.col("b")).cache()


def test_importance_in_one_job_equals_a_job_each(spark, rows):
    model = models.Linear(FEATURES, [3.0, 0.1], 0.0)
    together = explain.permutation_importance(rows, model.transform, -rmse(), FEATURES, "id", shuffles=3).collect()
    apart = explain.permutation_importance(rows, model.transform, lambda d: -d.agg(rmse()).first()[0], FEATURES, "id", shuffles=3).collect()
    assert [r.feature for r in together] == [r.feature for r in apart] == ["a", "b"]
    assert [r.importance for r in together] == pytest.approx([r.importance for r in apart])
    assert together[0].importance > 10 * together[1].importance > 0


def test_each_shuffle_deals_all_values_anew(spark, rows):
    total = F.sum(F.xxhash64("a") % 1000003)  # changes if a value is lost or doubled
    same = explain.permutation_importance(rows, lambda d: d.withColumn("prediction", F.col("a")), total, ["a"], "id").first()
    assert same.importance == 0
    none = explain.permutation_importance(rows.where("false"), models.Linear(FEATURES, [1.0, 1.0], 0.0).transform, rmse(), FEATURES, "id").collect()
    assert [(r.feature, r.importance) for r in none] == [("a", None), ("b", None)]
