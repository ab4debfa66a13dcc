"""Source payloads (JSON) as typed DataFrames; what is missing or can't be read is null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SETS = "struct<resultSets:array<struct<headers:array<string>,rowSet:array<array<string>>>>,resultSet:struct<headers:array<string>,rowSet:array<array<string>>>>"


def result_rows(raw: DataFrame, index: int = 0, column: str = "value") -> DataFrame:
    """The rows of a payload's result set as maps from header to text; ``raw`` has a payload a row."""
    p = F.from_json(column, _SETS)
    block = F.coalesce(F.try_element_at(p["resultSets"], F.lit(index + 1)), p["resultSet"])
    rows = raw.select(*[c for c in raw.columns if c != column], block.alias("b"))
    return rows.select(*[c for c in raw.columns if c != column], F.col("b.headers").alias("h"), F.posexplode("b.rowSet").alias("row_no", "r")).select(
        *[c for c in raw.columns if c != column], "row_no", _by_key(F.col("h"), F.transform(F.sequence(F.lit(1), F.size("h")), lambda i: F.try_element_at(F.col("r"), i.cast("int")))).alias("m")
    )


def _by_key(keys: Column, values: Column) -> Column:
    """A map from keys to values; of a key that occurs twice the last value."""
    once, back = F.array_distinct(keys), F.reverse(keys)
    return F.map_from_arrays(once, F.transform(once, lambda k: F.element_at(values, -F.array_position(back, k).cast("int"))))


def _get(name: str, kind: str = "string") -> Column:
    return F.try_element_at("m", F.lit(name)).try_cast(kind)


def draft_history(raw: DataFrame) -> DataFrame:
    whole = {"player_id": "PERSON_ID", "draft_year": "SEASON", "draft_pick": "OVERALL_PICK", "draft_round": "ROUND_NUMBER"}
    text = {"full_name": "PLAYER_NAME", "organization": "ORGANIZATION", "organization_type": "ORGANIZATION_TYPE", "team_abbr": "TEAM_ABBREVIATION", "team_name": "TEAM_NAME"}
    columns = {k: _get(v, "long") for k, v in whole.items()} | {k: _get(v) for k, v in text.items()}
    order = ["player_id", "full_name", "draft_year", "draft_pick", "draft_round", "organization", "organization_type", "team_abbr", "team_name"]
    return result_rows(raw).select(*(columns[c].alias(c) for c in order))


def combine(raw: DataFrame) -> DataFrame:
    numbers = {"wingspan_in": "WINGSPAN", "standing_reach_in": "STANDING_REACH", "max_vertical_in": "MAX_VERTICAL_LEAP", "lane_agility_s": "LANE_AGILITY_TIME", "body_fat_pct": "BODY_FAT_PCT"}
    return result_rows(raw).select(_get("PLAYER_ID", "long").alias("player_id"), _get("PLAYER_NAME").alias("full_name"), _get("SEASON", "long").alias("draft_year"), _get("POSITION").alias("position"), *(_get(v, "double").alias(k) for k, v in numbers.items()))


def player_info(raw: DataFrame) -> DataFrame:
    """player_id, birthdate (ISO day) and draft_year: the first row of each payload."""
    return result_rows(raw).where("row_no = 0").select(_get("PERSON_ID", "long").alias("player_id"), F.substring(F.nullif(_get("BIRTHDATE"), F.lit("")), 1, 10).alias("birthdate"), _get("DRAFT_YEAR", "long").alias("draft_year"))


def player_awards(raw: DataFrame, key: str = "player_id") -> DataFrame:
    """Counts of All-Star and All-NBA selections by ``key``, a column beside the payload; none: 0."""
    text = F.lower(_get("DESCRIPTION"))
    marks = result_rows(raw).select(key, text.rlike("all[- ]star").alias("s"), text.rlike("all[- ]nba").alias("n"))
    counts = marks.groupBy(key).agg(F.count_if("s").alias("all_star_count"), F.count_if("n").alias("all_nba_count"))
    return raw.select(key).distinct().join(counts, key, "left").select(key, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("all_star_count", "all_nba_count")))


def player_season(base: DataFrame, advanced: DataFrame, season: str) -> DataFrame:
    """Totals of one payload per 100 possessions of the other; null without possessions."""
    b = result_rows(base).select(_get("PLAYER_ID", "long").alias("player_id"), _get("PLAYER_NAME").alias("full_name"), _get("AGE", "double").alias("age"), _get("GP", "long").alias("gp"), _get("MIN", "double").alias("minutes"), *(_get(c, "double").alias(f"_{c.lower()}") for c in ("PTS", "AST", "OREB", "DREB", "REB", "STL", "BLK", "TOV")))
    a = result_rows(advanced).select(_get("PLAYER_ID", "long").alias("player_id"), *(_get(v, "double").alias(k) for k, v in {"poss": "POSS", "true_shooting": "TS_PCT", "usage": "USG_PCT", "pie": "PIE", "net_rating": "NET_RATING"}.items()))
    rates = {f"{c}_per100": F.when(F.col("poss") > 0, F.col(f"_{c}") / F.col("poss") * 100.0) for c in ("pts", "ast", "oreb", "dreb", "reb", "stl", "blk", "tov")}
    out = b.join(a, "player_id").withColumns({"season": F.lit(season), **rates})
    return out.drop(*(c for c in out.columns if c.startswith("_")))


_COLLEGE = """array<struct<athleteId:string,name:string,team:string,conference:string,season:long,position:string,games:long,minutes:double,points:double,assists:double,
rebounds:struct<total:double>,steals:double,blocks:double,turnovers:double,trueShootingPct:double,usage:double,effectiveFieldGoalPct:double,threePointFieldGoals:struct<pct:double>,
offensiveReboundPct:double,offensiveRating:double,defensiveRating:double,netRating:double,PORPAG:double,assistsTurnoverRatio:double,winShares:struct<totalPer40:double>>>"""


def _per40(x: Column, minutes: Column) -> Column:
    return F.try_divide(x, minutes) * 40.0


def college_season(raw: DataFrame, column: str = "value") -> DataFrame:
    """An array of nested objects as per-40 rates; percents become fractions, true shooting is one already."""
    r = raw.select(F.explode(F.from_json(column, _COLLEGE)).alias("r")).select("r.*")
    m = F.coalesce("minutes", F.lit(0.0))
    rates = {"pts": "points", "ast": "assists", "reb": "rebounds.total", "stl": "steals", "blk": "blocks", "tov": "turnovers"}
    pct = {"usage": "usage", "efg": "effectiveFieldGoalPct", "three_pt_pct": "threePointFieldGoals.pct", "oreb_pct": "offensiveReboundPct"}
    plain = {"off_rating": "offensiveRating", "def_rating": "defensiveRating", "net_rating": "netRating", "porpag": "PORPAG", "win_shares_per40": "winShares.totalPer40", "ast_to": "assistsTurnoverRatio"}
    return r.select(
        F.col("athleteId").alias("cbd_athlete_id"), F.col("name").alias("full_name"), F.col("team").alias("school"), "conference", "season", "position", "games", m.alias("minutes"),
        *(_per40(F.col(v), m).alias(f"{k}_per40") for k, v in rates.items()), F.col("trueShootingPct").alias("true_shooting"), *((F.col(v) / 100.0).alias(k) for k, v in pct.items()), *(F.col(v).alias(k) for k, v in plain.items()),
    )


# The names that feeds give each field.
_ABROAD = {
    "full_name": ["playerName", "player.name", "player_name", "player", "name"],
    "season": ["season", "seasonCode", "season_code"],
    "games": ["gamesPlayed", "games", "gp"],
    "minutes": ["minutesPlayed", "minutes", "timePlayed", "min"],
    "points": ["pointsScored", "points", "pts"],
    "assists": ["assistances", "assists", "ast"],
    "rebounds": ["totalRebounds", "rebounds", "reb"],
    "steals": ["steals", "stl"],
    "blocks": ["blocksFavour", "blocks", "blk"],
    "turnovers": ["turnovers", "tov"],
    "fga2": ["fieldGoalsAttempted2", "twoPointersAttempted"],
    "fga3": ["fieldGoalsAttempted3", "threePointersAttempted"],
    "fta": ["freeThrowsAttempted"],
}


def _plain_key(k: Column) -> Column:
    return F.regexp_replace(F.lower(k), "[._ ]", "")


def season_number(x: Column) -> Column:
    """The first four digits, or all there are; none give null."""
    return F.substring(F.regexp_replace(x.cast("string"), "[^0-9]", ""), 1, 4).try_cast("long")


def abroad_season(raw: DataFrame, column: str = "value") -> DataFrame:
    """Flat records with keys of any case and spelling as per-40 rates and true shooting.

    Of keys that are spelled alike then, the last one's value counts.
    """
    r = raw.select(F.explode(F.from_json(column, "array<map<string,string>>")).alias("r"))
    m = r.select(_by_key(F.transform(F.map_keys("r"), _plain_key), F.map_values("r")).alias("m"))

    def field(name: str, kind: str = "double") -> Column:
        keys = [k.lower().replace(".", "").replace("_", "") for k in _ABROAD[name]]
        return reduce(lambda a, b: F.coalesce(a, b), [F.try_element_at("m", F.lit(k)) for k in keys]).try_cast(kind)

    minutes = F.coalesce(field("minutes"), F.lit(0.0))
    shots = 2.0 * ((field("fga2") + field("fga3")) + 0.44 * field("fta"))
    rates = {"pts": "points", "ast": "assists", "reb": "rebounds", "stl": "steals", "blk": "blocks", "tov": "turnovers"}
    return m.select(field("full_name", "string").alias("full_name"), season_number(field("season", "string")).alias("season"), field("games", "long").alias("games"), minutes.alias("minutes"), *(_per40(field(v), minutes).alias(f"{k}_per40") for k, v in rates.items()), F.when(shots > 0, field("points") / shots).alias("true_shooting"))
