"""Explanations of any model, and the commands."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.__main__ import main
from plumbline.operators import explain, models

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(60).select("id", *(((F.col("id") * k % 17) / 4.0).alias(f) for f, k in zip(FEATURES, (3, 5, 7), strict=True))).withColumn("y", F.col("a") * 2 - F.col("b") + F.col("a") * F.col("c"))


def test_sampled_shapley_values_of_a_linear_model_are_exact(rows):
    model = models.Linear(FEATURES, [1.5, -2.0, 0.25], 3.0)
    exact = explain.LinearShap(model, rows).local(rows)
    sampled = explain.SampledShap(model.transform, FEATURES, rows, "id", orders=4).local(rows)
    names = ["shap_base", *(f"shap_{f}" for f in FEATURES)]
    for x, y in zip(exact.orderBy("id").collect(), sampled.orderBy("id").collect(), strict=True):
        assert [x[n] for n in names] == pytest.approx([y[n] for n in names])


def test_sampled_shapley_values_sum_to_the_prediction(rows):
    predict = lambda d: d.withColumn("prediction", F.col("a") * F.col("b") + F.greatest("b", "c"))
    shap = explain.SampledShap(predict, FEATURES, rows, "id", orders=6)
    total = F.col("shap_base") + sum(F.col(f"shap_{f}") for f in FEATURES)
    got = predict(rows).join(shap.local(rows), "id").agg(F.max(F.abs(total - F.col("prediction"))), F.count(F.lit(1))).first()
    assert got[0] < 1e-9 and got[1] == 60
    assert {r.feature for r in shap.importance(rows).collect()} == set(FEATURES)


def test_boosted_trees_can_be_explained(rows):
    model = models.gbm_regressor(FEATURES, "y", trees=3, depth=2).fit(rows)
    shap = explain.SampledShap(model.transform, FEATURES, rows, "id", orders=4)
    total = F.col("shap_base") + sum(F.col(f"shap_{f}") for f in FEATURES)
    got = model.transform(rows).select("id", "prediction").join(shap.local(rows), "id")
    assert got.agg(F.max(F.abs(total - F.col("prediction")))).first()[0] < 1e-9
    curve = explain.model_dependence(rows, model.transform, "a", grid=[0.0, 2.0, 4.0]).collect()
    assert [r.value for r in curve] == [0.0, 2.0, 4.0] and curve[0].mean_prediction < curve[-1].mean_prediction


def test_dependence_of_a_model_equals_that_of_its_expression(rows):
    model = models.Linear(FEATURES, [1.5, -2.0, 0.25], 3.0)
    one = explain.partial_dependence(rows, explain.linear_expression(model), "b", points=5).collect()
    two = explain.model_dependence(rows, model.transform, "b", points=5).collect()
    assert [v for r in one for v in r] == pytest.approx([v for r in two for v in r])


def test_commands(spark, tmp_path, capsys):
    main(["list"])
    assert "ranked_board" in capsys.readouterr().out.split()
    (tmp_path / "s.yaml").write_text("sources: [{id: one, kind: open_dataset, base_url: 'https://example.org', license: CC0}]")
    main(["sources", "--file", str(tmp_path / "s.yaml")])
    assert json.loads(capsys.readouterr().out)["id"] == "one"
    main(["query", "age_at_draft", "/root/testdata/sf0.001", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    spark.range(40).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"), (F.col("id") % 2).alias("g")).write.parquet(str(tmp_path / "t"))
    main(["eda", str(tmp_path / "t"), str(tmp_path / "r.md"), "--features", "x", "--target", "y", "--group", "g", "--edges", "20", "40", "--labels", "low", "mid", "high"])
    assert (tmp_path / "r.md").read_text().startswith("# Report")
