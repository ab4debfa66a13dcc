"""Outcome labels: box-impact metrics, windowed and censoring-aware career outcomes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.expressions import rounded

REPLACEMENT = -2.0
# The proxy's weights per 100 possessions and its shooting term.
WEIGHTS = {"pts_per100": 0.10, "ast_per100": 0.10, "oreb_per100": 0.07, "dreb_per100": 0.04, "stl_per100": 0.20, "blk_per100": 0.12, "tov_per100": -0.18}
SHOOTING, SHOOTING_WEIGHT = 0.55, 6.0
FULL_MINUTES = 240.0 * 82.0


@dataclass(frozen=True)
class Targets:
    """What counts as reaching a role, a stable season, and each tier (from the top down)."""

    window: int = 4
    debut_cap: int = 4
    reach_minutes: float = 1000.0
    stable_minutes: float = 500.0
    top_seasons: int = 2
    replacement: float = REPLACEMENT
    tiers: list[tuple[str, float, str | None]] = field(default_factory=lambda: [("superstar", 6.0, "all_nba_count"), ("all_star", 3.0, "all_star_count"), ("starter", 0.0, None), ("rotation", -2.0, None)])

    def __post_init__(self):
        known = {"superstar", "all_star", "starter", "rotation", "bust"}
        if unknown := {t for t, _, _ in self.tiers} - known:
            raise ValueError(f"unknown tiers: {unknown}")


def impact_metrics(seasons: DataFrame, season: str = "season", minutes: str = "minutes") -> DataFrame:
    """Add ``ebpm``, centred on its season's minutes-weighted mean, and ``vorp`` of the rounded value.

    The means are an aggregate that is joined, so a season's rows stay spread; a season without
    minutes has null.
    """
    raw = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        if name in seasons.columns:
            raw = raw + weight * F.coalesce(F.col(name), F.lit(0.0))
    if "true_shooting" in seasons.columns:
        raw = raw + SHOOTING_WEIGHT * (F.coalesce("true_shooting", F.lit(SHOOTING)) - SHOOTING)
    rows = seasons.withColumn("_raw", raw)
    means = rows.groupBy(F.col(season).alias("_season")).agg(F.try_divide(F.sum(F.col("_raw") * F.col(minutes)), F.sum(minutes)).alias("_mean"))
    out = rows.join(means, F.col(season).eqNullSafe(F.col("_season")), "left").withColumn("ebpm", rounded(F.col("_raw") - F.col("_mean"), 3))
    vorp = rounded((F.col("ebpm") - REPLACEMENT) * F.col(minutes) / FULL_MINUTES, 3)
    return out.withColumn("vorp", vorp).drop("_raw", "_mean", "_season")


def rank_agreement(df: DataFrame, a: str = "ebpm", b: str = "pie") -> DataFrame:
    """One row, ``rho``: Spearman of two columns over rows that have both (NaN under two rows)."""
    from plumbline.operators.metrics import spearman

    if a not in df.columns or b not in df.columns:
        return df.sparkSession.createDataFrame([(float("nan"),)], "rho double")
    return spearman(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b, few=float("nan"))


def valid_debut(debut: Column, draft: Column, cap: int) -> Column:
    return F.coalesce((debut - draft >= 0) & (debut - draft <= cap), F.lit(False))


def resolved(debut: Column, draft: Column, through: int, t: Targets) -> Column:
    """Whether all that a label needs had been played by the end of season ``through``."""
    return F.when(valid_debut(debut, draft, t.debut_cap), F.lit(through) >= debut + t.window - 1).otherwise(F.lit(through) - draft >= t.debut_cap)


def outcome_tier(reached: Column, peak: Column, t: Targets) -> Column:
    """The first tier, from the top, whose honour or band fits a player who reached a role and has a peak."""
    ladder = None
    for name, least, honour in t.tiers:
        fits = (peak >= least) | (F.col(honour) > 0) if honour else peak >= least
        fits = reached & peak.isNotNull() & fits
        ladder = F.when(fits, name) if ladder is None else ladder.when(fits, name)
    return ladder.otherwise("bust")


def outcomes(draft: DataFrame, seasons: DataFrame, honors: DataFrame | None, through: int, t: Targets = Targets()) -> DataFrame:
    """One row per drafted player: reached, peak_impact, cumulative_value, outcome_tier, resolved and careers.

    draft: player_id, draft_year; seasons: player_id, season_year, minutes, bpm, vorp (nulls: 0);
    honors: player_id, all_star_count, all_nba_count. A player's seasons are grouped once; the
    windows and the aggregate share one shuffle.
    """
    years = draft.groupBy("player_id").agg(F.min("draft_year").alias("draft_year"))
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("minutes", "bpm", "vorp")}
    facts = seasons.select("player_id", "season_year", *(zero[c].alias(c) for c in zero)).join(years, "player_id")
    player = Window.partitionBy("player_id")
    facts = facts.withColumn("debut_year", F.min("season_year").over(player))
    inside = valid_debut(F.col("debut_year"), F.col("draft_year"), t.debut_cap) & (F.col("season_year") < F.col("debut_year") + t.window)
    facts = facts.withColumn("_in", inside).withColumn("_stable", F.col("_in") & (F.col("minutes") >= t.stable_minutes))
    place = F.row_number().over(Window.partitionBy("player_id", "_stable").orderBy(F.desc("bpm"), "season_year"))
    facts = facts.withColumn("_top", F.col("_stable") & (place <= t.top_seasons))
    per = facts.groupBy("player_id").agg(
        F.first("debut_year").alias("debut_year"),
        F.sum(F.when(F.col("_in"), F.col("minutes")).otherwise(0.0)).alias("_minutes"),
        F.avg(F.when(F.col("_top"), F.col("bpm"))).alias("peak_impact"),
        F.sum(F.when(F.col("_in"), F.col("vorp")).otherwise(0.0)).alias("_vorp"),
        F.count_distinct("season_year").alias("_seasons"),
        F.max("season_year").alias("_last"),
    )
    out = years.join(per, "player_id", "left")
    if honors is not None:
        out = out.join(honors.select("player_id", "all_star_count", "all_nba_count"), "player_id", "left")
    else:
        out = out.withColumns({"all_star_count": F.lit(0), "all_nba_count": F.lit(0)})
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("all_star_count", "all_nba_count")})
    reached = F.coalesce(F.col("_minutes") >= t.reach_minutes, F.lit(False))
    out = out.withColumn("reached", reached)
    return out.select(
        "player_id",
        "draft_year",
        "debut_year",
        "reached",
        "peak_impact",
        F.coalesce("_vorp", F.lit(0.0)).alias("cumulative_value"),
        outcome_tier(F.col("reached"), F.col("peak_impact"), t).alias("outcome_tier"),
        resolved(F.col("debut_year"), F.col("draft_year"), through, t).alias("resolved"),
        F.coalesce("_seasons", F.lit(0)).cast("long").alias("career_seasons"),
        F.coalesce(F.col("_last") < through, F.lit(False)).alias("career_ended"),
    )


def realized_value(impact: Column, reached: Column, replacement: float = REPLACEMENT) -> Column:
    """The impact of a player who reached a role, else replacement; a missing impact is replacement."""
    return F.when(F.coalesce(reached, F.lit(False)) & impact.isNotNull() & ~F.isnan(impact), impact).otherwise(replacement)


def unconditional_value(p: Column, value: Column, replacement: float = REPLACEMENT) -> Column:
    """Expected value p * value + (1 - p) * replacement; a p outside [0, 1] is an error."""
    fine = F.when((p < 0) | (p > 1), F.raise_error(F.lit("p must be in [0, 1]")).cast("double")).otherwise(p)
    return fine * value + (1 - fine) * replacement


def honors_from_frame(df: DataFrame) -> DataFrame:
    """player_id and counts of honours (null: 0); all three columns must be there."""
    if missing := {"player_id", "all_star_count", "all_nba_count"} - set(df.columns):
        raise ValueError(f"honors lack {sorted(missing)}")
    return df.select(F.col("player_id").cast("long"), *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("all_star_count", "all_nba_count")))


def load_honors(spark, path: str) -> DataFrame:
    """``honors_from_frame`` of a CSV file with a header."""
    return honors_from_frame(spark.read.csv(path, header=True, schema="player_id long, all_star_count long, all_nba_count long"))
