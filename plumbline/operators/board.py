"""The ranked board: models trained on resolved classes, served for the latest one."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import TIER_EDGES, TIERS, measured, tier
from plumbline.operators import team_fit
from plumbline.operators.cleaning import Preprocessor
from plumbline.operators.explain import LinearShap, greedy_counterfactual
from plumbline.operators.metrics import mean_ranks
from plumbline.operators.models import Hurdle, Linear, TierModel, ridge
from plumbline.operators.ordered import numbered, quantiles
from plumbline.operators.uncertainty import Bootstrap, SplitConformal

LEAST_ROWS = 20


@dataclass
class Board:
    """Fitted heads and the training background; all methods return DataFrames."""

    features: list[str]
    pre: Preprocessor
    model: Linear
    background: DataFrame
    conformal: SplitConformal | None = None
    ensemble: Bootstrap | None = None
    hurdle: Hurdle | None = None
    tiers: TierModel | None = None

    @staticmethod
    def fit(train: DataFrame, features: list[str], target: str = "peak_impact", key: str = "player_id", alpha: float = 10.0) -> Board:
        """Train all heads that the rows allow: two targets at least, 20 rows for conformal and tiers."""
        pre = Preprocessor(features).fit(train)
        rows = pre.transform(train).cache()
        known = rows.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
        n = known.count()
        if n < 2:
            raise ValueError("two rows with a target are needed")
        board = Board(features, pre, ridge(known, features, target, alpha), rows)
        board.ensemble = Bootstrap(features, target, key, penalty=alpha).fit(known)
        if n >= LEAST_ROWS:
            board.conformal = SplitConformal(features, target, key, penalty=alpha).fit(known)
        if "reached" in train.columns:
            board.hurdle = Hurdle(features, impact=target, alpha=alpha).fit(rows)
        if "outcome_tier" in train.columns and n >= LEAST_ROWS and rows.select("outcome_tier").distinct().count() >= 2:
            board.tiers = TierModel(features).fit(rows)
        return board

    def rank(self, pool: DataFrame) -> DataFrame:
        """Point, floor, ceiling, tier probabilities and expected value, rounded, best first."""
        rows = self.pre.transform(pool)
        head = self.conformal or self.ensemble
        out = head.transform(rows).withColumnsRenamed({"prediction": "impact", "lower": "floor", "upper": "ceiling"}).drop("samples")
        if self.tiers:
            out = self.tiers.transform(out)
        else:
            probabilities = (self.conformal or self.ensemble).tiers(rows).select("player_id", *(f"p_{t}" for t in TIERS))
            out = out.join(probabilities, "player_id")
        if self.hurdle:
            out = self.hurdle.transform(out).withColumnsRenamed({"prediction": "expected_value"})
        else:
            out = out.withColumns({"p_reach": F.lit(None).cast("double"), "expected_value": F.col("impact")})
        out = out.withColumns({c: F.round(c, 3) for c in ("impact", "floor", "ceiling", "expected_value")}).withColumn("p_reach", F.round("p_reach", 4))
        return out.withColumn("predicted_tier", tier(F.col("impact"))).orderBy(F.desc("expected_value"), "player_id")

    def profile(self, pool: DataFrame) -> DataFrame:
        """Skills, archetype and what is known of each prospect."""
        rows = team_fit.skills(pool)
        shown = [c for c in ("full_name", "position", "draft_year", "draft_pick", "team_abbr", "team_name") if c in pool.columns]
        return rows.select("player_id", *shown, *(F.round(s, 1).alias(s) for s in team_fit.SKILLS), team_fit.archetype(rows).alias("archetype"), measured(rows, "age_at_draft", "age", default=None).alias("age"), measured(rows, "wingspan_in", default=None).alias("wingspan_in"))

    def ranked_with_profile(self, pool: DataFrame, cap: team_fit.Cap | None = None) -> DataFrame:
        """The board with rank, percentile, value in money, picture and the pick's distance from the rank."""
        ranked = self.rank(pool).select("player_id", "impact", "floor", "ceiling", *(f"p_{t}" for t in TIERS), "p_reach", "expected_value", "predicted_tier").cache()
        n = ranked.count()
        places = mean_ranks(ranked, "impact", "_place")
        ranked = numbered(ranked, [], -F.col("expected_value"), ["player_id"], "model_rank").join(places, F.col("impact") == F.col("_v")).drop("_v")
        ranked = ranked.withColumns({
            "model_rank": F.col("model_rank").cast("int"),
            "peak_pctile": F.round(F.col("_place") / n, 4),
            "value_usd": team_fit.projected_value(F.greatest("impact", F.lit(0.0)), cap or team_fit.load_cap()),
            "headshot": F.format_string("https://cdn.nba.com/headshots/nba/latest/260x190/%s.png", F.col("player_id").cast("string")),
        })
        out = ranked.drop("_place").join(self.profile(pool), "player_id", "left")
        return out.withColumn("slot_delta", F.col("draft_pick") - F.col("model_rank")) if "draft_pick" in out.columns else out

    def explain(self, pool: DataFrame, player_id=None) -> DataFrame:
        """Each prospect's, or one's, contributions of features to the prediction."""
        rows = self.pre.transform(pool if player_id is None else _one(pool, player_id))
        return LinearShap(self.model, self.background).local(self.model.transform(rows))

    def counterfactual(self, pool: DataFrame, player_id=None, rounds: int = 3) -> DataFrame:
        """The fewest moves within the background's 5th to 95th percentile that reach the next tier."""
        rows = self.model.transform(self.pre.transform(pool if player_id is None else _one(pool, player_id)))
        got = quantiles(self.background, {f: [0.05, 0.95] for f in self.features})
        bounds = {f: tuple(got[f]) for f in self.features if got[f][0] is not None and got[f][0] < got[f][1]}
        edge = F.array_min(F.filter(F.array(*map(F.lit, TIER_EDGES)), lambda e: e > F.col("prediction")))
        out = rows.withColumns({"current_tier": tier(F.col("prediction")), "target": edge, "target_tier": tier(edge)})
        return greedy_counterfactual(out, self.model, bounds, F.coalesce(F.col("target"), F.lit(float("-inf"))), rounds)

    def fit_for_team(self, pool: DataFrame, roster: DataFrame, payroll: DataFrame, cap: team_fit.Cap | None = None) -> DataFrame:
        """Each prospect with each team; the impact, 0 at least, stands for VORP a year."""
        ranked = self.rank(pool).select("player_id", "impact")
        rows = team_fit.skills(pool).join(ranked, "player_id").select("player_id", "impact", F.greatest("impact", F.lit(0.0)).alias("vorp"), F.col("draft_pick").alias("pick"), *team_fit.SKILLS)
        return team_fit.team_fit(rows, roster, payroll, cap)


def _one(pool: DataFrame, player_id) -> DataFrame:
    row = pool.where(F.col("player_id") == player_id)
    if row.isEmpty():
        raise KeyError(player_id)
    return row


class Service:
    """What a web service answers, as plain values; one instance loads and caches its board."""

    def __init__(self, board: Board, pool: DataFrame, mode: str = "master", version: str = "v1"):
        self.board, self.pool, self.mode, self.version = board, pool.cache(), mode, version

    @staticmethod
    def from_table(table: DataFrame, features: list[str], **more) -> Service:
        """The latest class is the pool, the resolved classes before it train."""
        last = table.agg(F.max("draft_year")).first()[0]
        train = table.where(F.col("draft_year") < last)
        if "resolved" in table.columns:
            train = train.where("resolved")
        train = train if not train.isEmpty() else table
        return Service(Board.fit(train, features), table.where(F.col("draft_year") == last), **more)

    @staticmethod
    def from_master(spark, folder: str, features: list[str]) -> Service:
        """A service over a written table; its version is that of the manifest beside it, if there is one."""
        try:
            manifest = json.loads(spark.read.text(f"{folder.rstrip('/').rsplit('/', 1)[0]}/manifest").first()[0])
        except (AnalysisException, TypeError, ValueError):
            manifest = {}
        return Service.from_table(spark.read.parquet(folder), features, mode="master", version=manifest.get("version", "v1"))

    @staticmethod
    def load(spark, folder: str, features: list[str]) -> Service:
        """``from_master``, or the demo's service where no table can be read."""
        try:
            return Service.from_master(spark, folder, features)
        except AnalysisException:
            return Service.demo(spark)

    @staticmethod
    def demo(spark, features: list[str] | None = None) -> Service:
        from plumbline.sources import fixtures

        rows = fixtures.synthetic_prospects(spark).withColumns({"peak_impact": F.col("nba_impact")}).drop("nba_impact")
        last = rows.agg(F.max("draft_year")).first()[0]
        board = Board.fit(rows.where(F.col("draft_year") < last - 1), features or fixtures.FEATURES)
        return Service(board, rows.where(F.col("draft_year") >= last - 1), mode="demo")

    def health(self) -> dict:
        return {"status": "ok"}

    def meta(self) -> dict:
        years = sorted(r[0] for r in self.pool.select("draft_year").distinct().collect())
        return {"mode": self.mode, "pool_size": self.pool.count(), "draft_years": years, "model_version": self.version}

    def prospects(self, limit: int = 30) -> list[dict]:
        return [r.asDict() for r in self.board.ranked_with_profile(self.pool).orderBy("model_rank").limit(limit).collect()]

    def explain(self, player_id) -> dict:
        row = self.board.explain(self.pool, player_id).first()
        return {"player_id": player_id, "base": row["shap_base"], "prediction": row["prediction"], "contributions": {f: row[f"shap_{f}"] for f in self.board.features}}

    def counterfactual(self, player_id) -> dict:
        row = self.board.counterfactual(self.pool, player_id).first()
        changes = [c.asDict() | {"delta": c.to_value - c.from_value} for c in row["changes"]]
        return {"current_impact": row["prediction"], "current_tier": row["current_tier"], "target": row["target"], "target_tier": row["target_tier"] if row["target"] is not None else None, "projected_impact": row["projected"], "reached": row["target"] is None or row["reached"], "changes": changes}

    def fit(self, player_id, roster: DataFrame, payroll: DataFrame, pick: int, season: str = "2026-27") -> dict:
        if pick < 1:
            raise ValueError("pick must be 1 or more")
        pool = _one(self.pool, player_id).withColumn("draft_pick", F.lit(pick))
        cap = team_fit.load_cap(season)
        return self.board.fit_for_team(pool, roster, payroll, cap).first().asDict() | {"assumptions": cap.assumptions, "exploratory": True}
