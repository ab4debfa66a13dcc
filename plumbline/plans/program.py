"""The end-to-end program over landed payloads: parse, label, link, validate, train, serve, persist."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.names import season_start
from plumbline.operators import features, labels, metrics, mlops, models, search, survival, temporal
from plumbline.operators.board import Board
from plumbline.operators.cleaning import Preprocessor
from plumbline.sources import parse
from plumbline.sources.ingest import landed


@dataclass
class Frames:
    draft: DataFrame
    combine: DataFrame
    seasons: DataFrame
    honors: DataFrame | None = None
    births: DataFrame | None = None
    college: DataFrame | None = None
    abroad: DataFrame | None = None


def frames(spark: SparkSession, folder: str) -> Frames:
    """All payloads of a landing folder, by file name: draft_*, combine_*, base_<season>, advanced_<season>, awards_<id>, info_*, college_*, abroad_*."""
    files = landed(spark, folder, "*.json").withColumn("name", F.element_at(F.split("path", "/"), -1)).cache()
    of = lambda kind: files.where(F.col("name").startswith(f"{kind}_")).select("value")
    named = files.select("value", F.regexp_extract("name", r"^\w+?_(.*)\.json$", 1).alias("label"), F.regexp_extract("name", "^([a-z]+)_", 1).alias("kind"))
    years = sorted(r[0] for r in named.where("kind = 'base'").select("label").distinct().collect())
    pick = lambda kind, y: named.where((F.col("kind") == kind) & (F.col("label") == y)).select("value")
    parts = [parse.player_season(pick("base", y), pick("advanced", y), y) for y in years]
    seasons = labels.impact_metrics(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)) if parts else None
    first = Window.partitionBy("player_id").orderBy("draft_year")
    measures = parse.combine(of("combine")).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    awards = named.where("kind = 'awards'").select(F.col("label").try_cast("long").alias("player_id"), "value")
    has = {r[0] for r in named.select("kind").distinct().collect()}
    return Frames(
        parse.draft_history(of("draft")), measures, seasons, parse.player_awards(awards) if "awards" in has else None, parse.player_info(of("info")).select("player_id", "birthdate") if "info" in has else None,
        parse.college_season(of("college")) if "college" in has else None, parse.abroad_season(of("abroad")) if "abroad" in has else None,
    )


def modeling_table(f: Frames, through: int, targets: labels.Targets = labels.Targets()) -> DataFrame:
    """One row per drafted player, by year and pick."""
    facts = f.seasons.select("player_id", season_start(F.col("season")).alias("season_year"), "minutes", F.col("ebpm").alias("bpm"), "vorp")
    found = labels.outcomes(f.draft, facts, f.honors, through, targets)
    return features.modeling_table(f.draft, found, f.combine, f.college, f.abroad, f.births).orderBy("draft_year", "draft_pick")


def longevity(dev: DataFrame, held: DataFrame, columns: list[str]) -> float:
    """Cox concordance of careers on the holdout; NaN where there are too few rows or one kind of event."""
    dev, held = dev.where("career_seasons >= 1"), held.where("career_seasons >= 1")
    kinds = dev.select("career_ended").distinct().count()
    if dev.limit(10).count() < 10 or held.limit(3).count() < 3 or kinds < 2:
        return math.nan
    scored = survival.Cox(columns, "career_seasons", "career_ended").fit(dev).transform(held)
    got = metrics.concordance(scored, "career_seasons", "career_ended", "risk").first()[0]
    return math.nan if got is None else got


def evaluate(table: DataFrame, columns: list[str], registry: mlops.Registry, out: str | None = None, holdout_years: int = 2, trials: int = 8) -> dict:
    """Resolved rows, split in time; tune and cross-validate on the rest, score the holdout once, register, persist."""
    known = table.where("resolved").cache()
    dev, held = (x.cache() for x in temporal.holdout(known, holdout_years))
    folds = temporal.walk_forward(temporal.years_of(dev))
    realized = labels.realized_value(F.col("peak_impact"), F.col("reached"))

    class Hurdled:
        def __init__(self, train: DataFrame, alpha: float):
            self.pre = Preprocessor(columns).fit(train)
            self.model = models.Hurdle(columns, alpha=alpha).fit(self.pre.transform(train))

        def transform(self, df: DataFrame) -> DataFrame:
            return self.model.transform(self.pre.transform(df)).withColumn("realized", realized)

    score = {"spearman": lambda d: metrics.spearman(d, "realized", "prediction"), "rmse": lambda d: d.agg(metrics.rmse(F.col("realized"), F.col("prediction")))}
    mean_rho = lambda alpha: temporal.evaluated(dev, folds, lambda t: Hurdled(t, alpha), {"spearman": score["spearman"]})[1]["spearman"]["mean"]
    best, _, _ = search.tuned(mean_rho, {"alpha": (0.1, 100.0, "log")}, trials)
    _, cv = temporal.evaluated(dev, folds, lambda t: Hurdled(t, best["alpha"]), score)
    final = Hurdled(dev, best["alpha"])
    scored = final.transform(held)
    result = {"alpha": best["alpha"], "cross_validation": cv, "holdout": {k: m(scored).first()[0] for k, m in score.items()}}
    baseline = models.DraftPosition().fit(dev.withColumn("realized", realized), "realized").transform(held.withColumn("realized", realized))
    result["draft_position"] = metrics.spearman(baseline, "realized", "prediction").first()[0]
    pre = Preprocessor(columns).fit(dev)
    result["career_concordance"] = longevity(pre.transform(dev), pre.transform(held), columns)
    served = Board.fit(dev, columns).rank(held).select("player_id", "expected_value").join(held.select("player_id", realized.alias("realized")), "player_id")
    result["served_spearman"] = metrics.spearman(served, "realized", "expected_value").first()[0]
    result["version"] = registry.register("hurdle", final.model.value.to_json(), result["holdout"], columns).version
    if out:
        table.write.mode("overwrite").partitionBy("draft_year").parquet(f"{out}/modeling_table")
        Path(registry.folder / "summary.json").write_text(json.dumps(result, default=str))
    return result


def run(spark: SparkSession, landing: str, columns: list[str], through: int, registry: mlops.Registry, out: str | None = None, use_pick: bool = True) -> dict:
    """From landed payloads to a registered, evaluated model; the pick can be left out of the features."""
    table = modeling_table(frames(spark, landing), through)
    return evaluate(table, [c for c in columns if use_pick or c != "draft_pick"], registry, out)
