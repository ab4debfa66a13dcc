"""Pre-draft features and their leakage guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.names import name_match_key, normalize_name
from plumbline.operators.ordered import keep_first

#: Columns that are known after the draft only; the pick itself is allowed.
POST_DRAFT = {"peak_impact", "cumulative_value", "reached", "outcome_tier", "resolved", "career_seasons", "career_ended", "nba_impact"}
EPSILON = 1e-9


class LeakageError(ValueError):
    """Data from after the draft, or a split that isn't strictly in time."""


def assert_pre_draft_safe(df: DataFrame) -> DataFrame:
    """``df`` unless it has a post-draft column; looks at names only, no job runs."""
    if found := POST_DRAFT & set(df.columns):
        raise LeakageError(f"post-draft columns: {sorted(found)}")
    return df


def stateless(df: DataFrame) -> DataFrame:
    """Add production_total, versatility, playmaking_share and scoring_share."""
    stats = ["pts_per100", "ast_per100", "reb_per100"]
    total = sum((F.col(c) for c in stats), F.lit(0.0)) + EPSILON
    shares = [F.col(c) / total for c in stats]
    return df.withColumns({
        "production_total": total,
        "versatility": 1 - sum((s * s for s in shares), F.lit(0.0)),
        "playmaking_share": F.col("ast_per100") / (F.col("pts_per100") + F.col("ast_per100") + EPSILON),
        "scoring_share": shares[0],
    })


def combine(df: DataFrame) -> DataFrame:
    """Add agility, leanness and explosiveness from the measurements that there are."""
    made = {"agility_score": ("lane_agility_s", -1), "leanness": ("body_fat_pct", -1), "explosiveness": ("max_vertical_in", 1)}
    return df.withColumns({new: F.col(old) * sign for new, (old, sign) in made.items() if old in df.columns})


def _latest(player: str, season: str):
    return Window.partitionBy(player).orderBy(F.desc(season))


def sequences(df: DataFrame, player: str = "player_id", season: str = "season") -> DataFrame:
    """Per player the last season less the one before, and the number of seasons; one shuffle."""
    w = Window.partitionBy(player).orderBy(season)
    changes = {"sos_jump": "strength_of_schedule", "usage_change": "usage", "ts_change": "true_shooting", "pts_change": "pts_per100"}
    rows = df.withColumns({k: F.col(c) - F.lag(c).over(w) for k, c in changes.items()})
    rows = rows.withColumns({"n_pre_draft_seasons": F.count(F.lit(1)).over(Window.partitionBy(player)), "_last": F.row_number().over(_latest(player, season))})
    held = F.when(F.col("sos_jump").isNotNull() & F.col("ts_change").isNotNull(), (F.col("sos_jump") > 0) & (F.col("ts_change") >= 0))
    return rows.where("_last = 1").select(player, *changes, held.alias("efficiency_held_up"), "n_pre_draft_seasons")


def primary_season(df: DataFrame, player: str = "player_id", season: str = "season") -> DataFrame:
    """The latest season row of each player."""
    return df.withColumn("_last", F.row_number().over(_latest(player, season))).where("_last = 1").drop("_last")


def assembled(seasons: DataFrame, measures: DataFrame, identity: DataFrame) -> DataFrame:
    """Latest season with features, season changes, combine features and the name, per player."""
    out = stateless(primary_season(seasons)).join(sequences(seasons), "player_id", "left")
    clash = [c for c in measures.columns if c in out.columns and c != "player_id"]
    out = out.join(combine(measures.drop(*clash)), "player_id", "left")
    return assert_pre_draft_safe(out.join(identity.select("player_id", "full_name"), "player_id", "left"))


def feature_matrix(seasons: DataFrame, measures: DataFrame, identity: DataFrame, context: LeagueContext) -> DataFrame:
    """``assembled`` with an already fitted league context; for inference, not inside temporal folds."""
    return assert_pre_draft_safe(context.transform(assembled(seasons, measures, identity)))


class LeagueContext:
    """Translates statistics to a reference league, and schedules to z-scores, by fitted moments.

    Fitted state is two grouped tables; leagues that weren't seen, or without spread, fall back
    to the whole training set, then to spread 1. A value of the reference league is its own
    translation. Sums are decimals of 18 places, so they don't depend on how rows are dealt;
    NaN and what is beyond 10**20 don't count.
    """

    def __init__(self, stats: list[str], reference: str = "ncaa", league: str = "league_id", season: str = "season", schedule: str = "strength_of_schedule"):
        self.stats, self.reference, self.league, self.season, self.schedule = stats, reference, league, season, schedule

    def fit(self, train: DataFrame) -> LeagueContext:
        def moments(columns):
            out = []
            for c in columns:
                x = F.col(c).cast("double")
                x, square = x.try_cast("decimal(38,18)"), (x * x).try_cast("decimal(38,18)")
                n, mean = F.count(x), F.try_sum(x).cast("double") / F.nullif(F.count(x), F.lit(0))
                var = (F.try_sum(square).cast("double") - n * mean * mean) / F.nullif(n - 1, F.lit(0))
                out += [mean.alias(f"_m_{c}"), F.sqrt(F.greatest(var, F.lit(0.0))).alias(f"_s_{c}")]
            return out

        self.leagues = train.groupBy(self.league).agg(*moments(self.stats))
        self.years = train.groupBy(self.league, self.season).agg(*moments([self.schedule])) if self.schedule in train.columns else None
        self.every = train.agg(*moments([*self.stats, *([self.schedule] if self.years is not None else [])])).first().asDict()
        of_reference = train.where(F.col(self.league) == self.reference)
        self.seen = not of_reference.isEmpty()
        self.target = (of_reference if self.seen else train).agg(*moments(self.stats)).first().asDict()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        def spread(column, whole):
            whole = whole if whole and whole > 0 else 1.0
            return F.when(column > 0, column).otherwise(F.lit(float(whole)))

        out, new = df.join(self.leagues, self.league, "left"), {}
        for c in self.stats:
            m = F.coalesce(f"_m_{c}", F.lit(self.every[f"_m_{c}"]))
            to_s = self.target[f"_s_{c}"]
            moved = (F.col(c) - m) / spread(F.col(f"_s_{c}"), self.every[f"_s_{c}"]) * F.lit(to_s if to_s and to_s > 0 else 1.0) + F.lit(self.target[f"_m_{c}"])
            own = F.col(self.league) == self.reference if self.seen and to_s and to_s > 0 else F.lit(False)
            new[f"{c}_translated"] = F.when(own, F.col(c)).otherwise(moved)
        if self.years is not None:
            s = self.schedule
            out = out.join(self.years, [self.league, self.season], "left")
            new["sos_z"] = (F.col(s) - F.coalesce(f"_m_{s}", F.lit(self.every[f"_m_{s}"]))) / spread(F.col(f"_s_{s}"), self.every[f"_s_{s}"])
        return out.withColumns(new).select(*df.columns, *new)


COLLEGE = ["pts_per40", "ast_per40", "reb_per40", "stl_per40", "blk_per40", "tov_per40", "true_shooting", "usage", "efg", "three_pt_pct", "off_rating", "def_rating", "net_rating", "porpag", "win_shares_per40"]
ABROAD = ["pts_per40", "ast_per40", "reb_per40", "stl_per40", "blk_per40", "tov_per40", "true_shooting"]


def _linked(draft: DataFrame, rows: DataFrame, tries: list[list[tuple]], columns: list[str]) -> DataFrame:
    """player_id and ``columns`` of the best row of the same name key; ties by the rows' own values, nulls last.

    A try is a list of pairs, of a row's and of a player's value that must be equal; the first try
    with a row counts. Each try's best row of a name key is found before players meet it, so names
    that many share make no pairs.
    """
    players = keep_first(draft, ["player_id"], "draft_year").withColumn("_key", name_match_key(F.col("full_name")))
    by = ["season", *(["school"] if "school" in rows.columns else [])]
    there = rows.select("full_name", *(F.col(c).alias(f"_r_{c}") for c in dict.fromkeys([*columns, *by])))
    values = F.struct(*(x for c in there.columns if c.startswith("_r_") for x in (F.col(c).isNull().alias(f"_no{c}"), F.col(c))))
    # one row of a spelling, so names are made alike once each
    there = there.groupBy("full_name", *(f"_r_{c}" for c in by)).agg(F.min(values).alias("_best")).withColumn("_rkey", name_match_key(F.col("full_name")))
    out = players.select("player_id", "_key", *(own.alias(f"_own{i}_{j}") for i, pairs in enumerate(tries) for j, (_, own) in enumerate(pairs)))
    for i, pairs in enumerate(tries):
        best = there.groupBy(F.col("_rkey").alias(f"_key{i}"), *(of.alias(f"_of{i}_{j}") for j, (of, _) in enumerate(pairs))).agg(F.min("_best").alias(f"_best{i}"))
        same = F.col("_key") == F.col(f"_key{i}")
        for j in range(len(pairs)):
            same = same & (F.col(f"_own{i}_{j}") == F.col(f"_of{i}_{j}"))
        out = out.join(best, same, "left")
    first = F.coalesce(*(F.col(f"_best{i}") for i in range(len(tries))))
    return out.select("player_id", *(first[f"_r_{c}"].alias(c) for c in columns))


def link_college(draft: DataFrame, college: DataFrame, columns: list[str] = COLLEGE) -> DataFrame:
    """Each drafted player's college row of the draft year; of several, that of the player's own school first."""
    year = (F.col("_r_season"), F.col("draft_year"))
    school = (normalize_name(F.col("_r_school")), normalize_name(F.col("organization").cast("string")))
    return _linked(draft, college, [[year, school], [year]], columns)


def link_abroad(draft: DataFrame, abroad: DataFrame, strict_pre_draft: bool = True, columns: list[str] = ABROAD) -> DataFrame:
    """Each drafted player's latest row from abroad.

    A season starts in its year, so only the one before the draft is over by then. Without
    ``strict_pre_draft`` the season that starts after the draft counts too, and first.
    """
    years = [F.col("draft_year") - 1] if strict_pre_draft else [F.col("draft_year"), F.col("draft_year") - 1]
    return _linked(draft, abroad, [[(F.col("_r_season"), y)] for y in years], columns)


def age_at_draft(birth, year):
    """Years from birth to 26 June of the draft year, to two places; a bad date gives null."""
    day = F.try_to_timestamp(birth.cast("string"), F.lit("yyyy-MM-dd")).cast("date")
    return F.round(F.datediff(F.make_date(year.cast("int"), F.lit(6), F.lit(26)), day) / F.lit(365.25).cast("double"), 2)


def modeling_table(draft: DataFrame, labels: DataFrame, measures: DataFrame, college: DataFrame | None = None, abroad: DataFrame | None = None, births: DataFrame | None = None) -> DataFrame:
    """One row per drafted player: labels, combine, college or international features, and age."""
    out = keep_first(draft, ["player_id"], "draft_year")
    out = out.join(labels.drop("draft_year"), "player_id", "left")
    taken = [c for c in measures.columns if c in out.columns and c != "player_id"]
    out = out.join(keep_first(measures.drop(*taken), ["player_id"]), "player_id", "left")
    if college is not None:
        out = out.join(link_college(draft, college), "player_id", "left")
    if abroad is not None:
        other = link_abroad(draft, abroad).withColumnsRenamed({c: f"_x_{c}" for c in ABROAD})
        out = out.join(other, "player_id", "left")
        out = out.withColumns({c: F.coalesce(c, f"_x_{c}") if c in out.columns else F.col(f"_x_{c}") for c in ABROAD}).drop(*(f"_x_{c}" for c in ABROAD))
    if births is not None:
        out = out.join(births.select("player_id", "birthdate"), "player_id", "left")
        out = out.withColumn("age_at_draft", age_at_draft(F.col("birthdate"), F.col("draft_year"))).drop("birthdate")
    return out
