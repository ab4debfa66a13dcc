"""Order statistics, pair counts and chains of links, against numpy and loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import cleaning, metrics, ordered


def test_quantiles_are_exact(spark, monkeypatch):
    x = np.random.default_rng(0).standard_normal(3000).round(3)
    y = np.r_[np.zeros(1500), np.ones(1450), np.linspace(0.1, 0.9, 50)]
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, y, strict=True)], "x double, y double, z double").cache()
    q = [0, 0.05, 0.5, 0.777, 1]
    for few in (16, 4096):
        monkeypatch.setattr(ordered, "FEW", few)
        got = ordered.quantiles(df, {"x": q, "y": q, "z": [0.5]})
        assert np.allclose(got["x"], np.quantile(x, q)) and np.allclose(got["y"], np.quantile(y, q)) and got["z"] == [None]
    assert ordered.quantiles(df, {"x": [0.8]}, ceil=True)["x"][0] == np.quantile(x, 0.8, method="higher")


def test_pairs_are_counted_without_a_nested_loop(spark):
    rng = random.Random(1)
    rows = [(float(rng.randrange(12)), rng.randrange(2), round(rng.random(), 1)) for _ in range(120)]
    df = spark.createDataFrame(rows, "t double, e int, r double").cache()
    sign = sum((u[0] < v[0]) * ((u[2] < v[2]) - (u[2] > v[2])) for u in rows for v in rows)
    assert abs(metrics.kendall(df, "t", "r", "t").first()[0] - sign / (120 * 119 / 2)) < 1e-12
    fit = [(u, v) for u in rows for v in rows if u[1] and (u[0] < v[0] or (u[0] == v[0] and not v[1]))]
    good = sum(1.0 if u[2] > v[2] else 0.5 if u[2] == v[2] else 0.0 for u, v in fit)
    assert abs(metrics.concordance(df, "t", "e", "r").first()[0] - good / len(fit)) < 1e-12


def test_numbers_go_on_over_groups_and_cuts(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), F.floor(F.col("id") / 50).cast("double").alias("v"))
    got = {r.id: r.n for r in ordered.numbered(df, ["g"], F.col("v"), ["id"], "n").collect()}
    assert got == {i: i // 3 + 1 for i in range(500)}


def test_chains_of_any_length_are_one(spark):
    nodes = spark.range(100).select(F.format_string("%03d", "id").alias("entity"))
    links = spark.range(99).select(F.format_string("%03d", F.col("id")).alias("a"), F.format_string("%03d", F.col("id") + 1).alias("b"))
    assert {r.root for r in cleaning.smallest_reached(nodes, links).collect()} == {"000"}


def test_quantiles_with_infinities(spark):
    inf = float("inf")
    df = spark.createDataFrame([(-inf,), (1.0,), (2.0,), (inf,), (None,), (float("nan"),)], "x double")
    assert ordered.quantiles(df, {"x": [0, 0.5, 0.9, 1]}) == {"x": [-inf, 1.5, inf, inf]}


@pytest.mark.parametrize("parts", [4, 8, 200])
def test_league_context_is_the_same_however_rows_are_dealt(spark, parts):
    from plumbline.operators.features import LeagueContext

    rows = [(i % 3, 1990 + i % 2, 27404.0 / 8 / 100 + i * 0.1 / 3, i * 0.7) for i in range(500)]
    df = spark.createDataFrame(rows, "league_id int, season int, pts double, strength_of_schedule double")
    fit = lambda n: LeagueContext(["pts"], 1).fit(df.repartition(n)).transform(df).orderBy("pts").collect()
    got = fit(parts)
    assert got == fit(1)
    assert all(r.pts_translated == r.pts for r in got if r.league_id == 1)
