"""Seeded synthetic tables for demos and tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

FEATURES = ["age", "pts_per100", "ast_per100", "reb_per100", "true_shooting", "usage", "wingspan_in", "league_tier"]


def synthetic_prospects(spark: SparkSession, first: int = 2010, last: int = 2023, size: int = 60, seed: int = 42) -> DataFrame:
    """One row per prospect; a latent talent drives statistics, picks (a permutation a year) and impact."""
    rng, rows, n = np.random.default_rng(seed), [], 0
    for year in range(first, last + 1):
        talent = rng.normal(0, 1, size)
        noisy = talent + rng.normal(0, 0.7, size)
        pick = np.empty(size, int)
        pick[np.argsort(-noisy)] = np.arange(1, size + 1)
        for i in range(size):
            t = talent[i]
            c = lambda x, lo, hi: float(np.clip(x, lo, hi))
            rows.append((
                n, year, c(21 - 0.6 * t + rng.normal(0, 1.2), 17.5, 24), c(14 + 4 * t + rng.normal(0, 4), 2, 35), c(4 + 1.3 * t + rng.normal(0, 2), 0, 12), c(6 + rng.normal(0, 2.2) + 0.6 * t, 2, 14),
                c(0.55 + 0.02 * t + rng.normal(0, 0.03), 0.4, 0.72), c(0.22 + 0.025 * t + rng.normal(0, 0.04), 0.1, 0.4), c(82 + rng.normal(0, 3.5), 72, 95), int(rng.integers(1, 4)), int(pick[i]), float(1.8 * t - 0.6 + 0.9 * rng.standard_t(3)),
            ))
            n += 1
    return spark.createDataFrame(rows, "player_id long, draft_year long, age double, pts_per100 double, ast_per100 double, reb_per100 double, true_shooting double, usage double, wingspan_in double, league_tier long, draft_pick long, nba_impact double")


def multisource(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(college, abroad, combine) with names spelt in several ways: six people in all."""
    college = spark.createDataFrame(
        [("Young, Trae", 2018, "NCAA Division I", 2018, 19.7, 27.4, 8.7, 3.9, 0.585, 0.371, 11.2, 8.1), ("Marvin Bagley III", 2018, "ncaa", 2018, 19.2, 21.0, 1.5, 11.1, 0.643, 0.26, 12.5, 9.0), ("Jaren Jackson Jr.", 2018, "College", 2018, 18.8, 10.9, 1.1, 5.8, 0.647, 0.21, 13.0, 8.4)],
        "full_name string, draft_year long, league string, season long, age double, pts_per100 double, ast_per100 double, reb_per100 double, true_shooting double, usage double, bpm_college double, strength_of_schedule double",
    )
    abroad = spark.createDataFrame([("Luka Dončić", 2018, "EuroLeague", 2018, 19.3, 16.0, 4.3, 4.8), ("Džanan Musa", 2018, "EuroLeague", 2018, 19.1, 10.5, 1.8, 3.1)], "full_name string, draft_year long, league string, season long, age double, pts_per100 double, ast_per100 double, reb_per100 double")
    combine = spark.createDataFrame(
        [("Trae Young", 2018, 75.0, 96.5, None, None, 6.2), ("Marvin Bagley", 2018, 84.5, 107.0, 40.5, 10.9, 5.9), ("Luka Doncic", 2018, 81.0, 104.0, 35.0, 11.2, 8.0), ("Chandler Hutchison", 2018, 83.0, 104.5, 36.5, 11.0, 6.5)],
        "full_name string, draft_year long, wingspan_in double, standing_reach_in double, max_vertical_in double, lane_agility_s double, body_fat_pct double",
    )
    return college, abroad, combine


def feature_rows(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seasons, combine, identity) of six players for feature tests."""
    s = "player_id string, draft_year long, league_id string, season long, age double, pts_per100 double, ast_per100 double, reb_per100 double, true_shooting double, usage double, strength_of_schedule double"
    rows = [
        ("p1", 2017, "ncaa", 2016, 19.0, 18.0, 3.0, 6.0, 0.560, 0.24, 2.0), ("p1", 2017, "ncaa", 2017, 20.0, 22.0, 4.0, 7.0, 0.585, 0.27, 8.5), ("p2", 2017, "ncaa", 2016, 19.5, 15.0, 2.0, 5.0, 0.575, 0.22, 3.0), ("p2", 2017, "ncaa", 2017, 20.5, 17.0, 2.5, 5.5, 0.545, 0.25, 7.0),
        ("p3", 2017, "euroleague", 2017, 19.8, 12.0, 4.0, 4.0, 0.550, 0.20, 9.0), ("p4", 2018, "ncaa", 2018, 19.1, 10.0, 10.0, 10.0, 0.600, 0.21, 5.0), ("p5", 2018, "nbl", 2018, 20.2, 14.0, 5.0, 6.0, 0.540, 0.23, None), ("p6", 2018, "euroleague", 2018, 20.0, 11.0, 3.0, 8.0, 0.570, 0.19, 8.0),
    ]
    combine = [("p1", 80.0, 34.0, 11.0, 6.0), ("p2", 82.0, 33.0, 11.3, 7.0), ("p3", 81.0, 30.0, 11.5, 8.0), ("p6", 84.0, 36.0, 10.8, 5.5)]
    names = [("p1", "A One", 2017), ("p2", "B Two", 2017), ("p3", "C Three", 2017), ("p4", "D Four", 2018), ("p5", "E Five", 2018), ("p6", "F Six", 2018)]
    return spark.createDataFrame(rows, s), spark.createDataFrame(combine, "player_id string, wingspan_in double, max_vertical_in double, lane_agility_s double, body_fat_pct double"), spark.createDataFrame(names, "player_id string, full_name string, draft_year long")
