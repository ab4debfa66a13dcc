"""Boosted quantile trees: quantiles that differ by region, in order, and empty input."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators.uncertainty import QuantileTrees, uniform


def test_quantiles_follow_the_spread(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 2).cast("double").alias("side"), uniform("id", 5).alias("noise"))
    rows = rows.withColumn("y", F.when(F.col("side") == 1, 10 + 8 * F.col("noise")).otherwise(F.col("noise")))
    model = QuantileTrees(["side", "noise"], "y", trees=12, depth=1, rate=0.5).fit(rows.withColumn("noise", F.lit(0.0)))
    got = model.transform(rows).cache()
    assert got.where("lower > prediction or prediction > upper").count() == 0
    for r in got.groupBy("side").agg(F.avg((F.col("y") <= F.col("lower")).cast("int")).alias("low"), F.avg((F.col("y") <= F.col("upper")).cast("int")).alias("high"), F.max("prediction").alias("p")).collect():
        assert r.low == pytest.approx(0.1, abs=0.05) and r.high == pytest.approx(0.9, abs=0.05)
        assert r.p == pytest.approx(14 if r.side else 0.5, abs=0.5)


def test_no_rows_is_an_error(spark):
    with pytest.raises(ValueError):
        QuantileTrees(["x"], "y", trees=1).fit(spark.createDataFrame([], "x double, y double"))
