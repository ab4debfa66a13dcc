"""How a prospect fits a team: needs, overlap, the lineup, and what the contract is worth."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.expressions import clip, measured, scale

SKILLS = ["scoring", "shooting_spacing", "playmaking", "rebounding", "rim_protection", "perimeter_defense"]
# The label of each dominant skill.
ARCHETYPES = ["Scorer", "Floor Spacer", "Playmaker", "Rebounder", "Rim Protector", "Perimeter Defender"]
TARGET_LEVEL = 60.0
#: Teams that prospects are paired with at most.
TEAMS = 10_000


@dataclass(frozen=True)
class Cap:
    """A season's cap rules and the assumptions that turn value into money."""

    salary_cap: float = 165_000_000.0
    luxury_tax: float = 201_000_000.0
    first_apron: float = 209_000_000.0
    second_apron: float = 222_000_000.0
    verified: bool = False
    wins_per_vorp: float = 2.7
    dollars_per_win: float = 3_500_000.0
    contract_years: int = 4
    # First-year salaries of the first picks.
    rookie_scale: tuple[float, ...] = (13825920, 12370200, 11108880, 9069840, 8237640, 7520040, 6889200, 6332520, 6016080, 5715120, 5429520, 5163480, 4914840, 4682640)
    notes: list[str] = field(default_factory=lambda: ["value of a win and wins per VORP are rules of thumb", "salaries after the listed picks are extrapolated"])

    @property
    def assumptions(self) -> list[str]:
        return [*self.notes, *([] if self.verified else ["cap figures are projections"])]


#: The seasons' rules.
SEASONS = {"2025-26": Cap(154_647_000.0, 187_895_000.0, 195_945_000.0, 207_824_000.0, True), "2026-27": Cap()}


def load_cap(season: str = "2026-27") -> Cap:
    if season not in SEASONS:
        raise KeyError(season)
    return SEASONS[season]


def rookie_first_year(pick: Column, cap: Cap) -> Column:
    """The listed salary, or the last one less 7 % for each further pick."""
    table = F.array(*(F.lit(float(x)) for x in cap.rookie_scale))
    n = len(cap.rookie_scale)
    return F.when(pick <= n, F.try_element_at(table, pick.cast("int"))).otherwise(float(cap.rookie_scale[-1]) * F.pow(F.lit(0.93), pick - n))


def rookie_cost(pick: Column, cap: Cap) -> Column:
    return F.round(rookie_first_year(pick, cap) * sum(1.05**k for k in range(4)), 2)


def projected_value(vorp: Column, cap: Cap) -> Column:
    return F.round(vorp * cap.wins_per_vorp * cap.dollars_per_win * cap.contract_years, 2)


def real_surplus(vorp: Column, pick: Column, cap: Cap) -> Column:
    return projected_value(vorp, cap) - rookie_cost(pick, cap)


def apron(salary: Column, cap: Cap) -> tuple[Column, Column]:
    """(multiplier, label) of what surplus is worth at a payroll."""
    steps = [(cap.second_apron, 1.5, "above second apron"), (cap.first_apron, 1.3, "above first apron"), (cap.luxury_tax, 1.15, "above tax")]
    m = name = None
    for edge, times, label in steps:
        m = F.when(salary >= edge, times) if m is None else m.when(salary >= edge, times)
        name = F.when(salary >= edge, label) if name is None else name.when(salary >= edge, label)
    return m.otherwise(1.0), name.otherwise("below tax")


def skills(df: DataFrame) -> DataFrame:
    """Add the six skills, 0 to 100, from per-40 statistics where there are any, else per-100 ones."""
    per40 = measured(df, "pts_per40", default=None).isNotNull()

    def either(a: tuple, b: tuple) -> Column:
        return F.when(per40, scale(measured(df, a[0]), *a[1:])).otherwise(scale(measured(df, b[0]), *b[1:]))

    block, steal = measured(df, "blk_per40", default=None), measured(df, "stl_per40", default=None)
    return df.withColumns({
        "scoring": either(("pts_per40", 5, 28), ("pts_per100", 2, 26)),
        "shooting_spacing": scale(measured(df, "true_shooting", default=0.5), 0.45, 0.65),
        "playmaking": either(("ast_per40", 0, 8), ("ast_per100", 0, 9)),
        "rebounding": either(("reb_per40", 1, 14), ("reb_per100", 1, 14)),
        "rim_protection": F.when(block.isNotNull(), scale(block, 0, 3)).otherwise(scale(measured(df, "wingspan_in", default=80.0), 76, 92)),
        "perimeter_defense": F.when(steal.isNotNull(), scale(steal, 0, 2.5)).otherwise(50.0),
    })


def archetype(df: DataFrame) -> Column:
    """The label of the strongest skill; the first of equals."""
    best = F.greatest(*(F.coalesce(s, F.lit(0.0)) for s in SKILLS))
    ladder = None
    for s, label in zip(SKILLS, ARCHETYPES, strict=True):
        hit = F.coalesce(s, F.lit(0.0)) == best
        ladder = F.when(hit, label) if ladder is None else ladder.when(hit, label)
    return ladder


def team_supply(roster: DataFrame, team: str = "team_id") -> DataFrame:
    """Per team and skill the mean of its two best, need under and surplus over the target level."""
    long = roster.select(team, F.explode(F.array(*(F.struct(F.lit(s).alias("skill"), F.coalesce(s, F.lit(0.0)).alias("level")) for s in SKILLS))).alias("x")).select(team, "x.*")
    top = long.withColumn("_n", F.row_number().over(Window.partitionBy(team, "skill").orderBy(F.desc("level")))).where("_n <= 2")
    supply = top.groupBy(team, "skill").agg(F.avg("level").alias("supply"))
    return supply.withColumns({"need": F.greatest(F.lit(0.0), TARGET_LEVEL - F.col("supply")), "surplus": F.greatest(F.lit(0.0), F.col("supply") - TARGET_LEVEL)})


def few_teams(teams: DataFrame) -> DataFrame:
    """A table of a row a team, to be sent to all tasks; over ``TEAMS`` rows are an error."""
    if (n := teams.count()) > TEAMS:
        raise ValueError(f"{n} teams; pairing every prospect with every team is meant for {TEAMS} at most")
    return F.broadcast(teams)


def synergy(prospects: DataFrame, supply: DataFrame, team: str = "team_id", key: str = "player_id") -> DataFrame:
    """Each prospect with each team: complementarity, redundancy and net, to four places.

    A team's six needs become columns first, so the pairing makes one row for a pair.
    """
    wide = supply.groupBy(team).agg(*(F.max(F.when(F.col("skill") == s, F.col(c))).alias(f"_{c}_{s}") for s in SKILLS for c in ("need", "surplus")))
    pairs = prospects.crossJoin(few_teams(wide))
    total = lambda c: sum((F.coalesce(f"_{c}_{s}", F.lit(TARGET_LEVEL if c == "need" else 0.0)) * F.coalesce(s, F.lit(0.0)) for s in SKILLS), F.lit(0.0)) / 600.0
    comp, red = total("need"), total("surplus")
    out = pairs.withColumns({"complementarity": F.round(comp, 4), "redundancy": F.round(red, 4), "net": F.round(comp - 0.5 * red, 4)})
    return out.drop(*(c for c in wide.columns if c != team))


@dataclass(frozen=True)
class LineupWeights:
    """What a point of mean spacing and of the best rim protection is worth, and from where it counts."""

    spacing: float = 0.06
    spacing_from: float = 55.0
    rim: float = 0.05
    rim_from: float = 50.0


def net_rating(impact: Column, spacing: Column, rim: Column, w: LineupWeights = LineupWeights()) -> Column:
    """A lineup's net rating from the sum of impact, mean spacing and best rim protection."""
    return F.round(impact + w.spacing * (spacing - w.spacing_from) + w.rim * (rim - w.rim_from), 2)


def lineups(roster: DataFrame, team: str = "team_id", order: str = "name") -> DataFrame:
    """Each team's five best by impact, and which of them is the weakest."""
    w = Window.partitionBy(team)
    five = roster.withColumn("_n", F.row_number().over(w.orderBy(F.desc("impact"), order))).where("_n <= 5")
    return five.withColumn("weakest", F.row_number().over(w.orderBy("impact", order)) == 1).drop("_n")


def lineup_upgrade(prospects: DataFrame, lineup: DataFrame, team: str = "team_id", weights: LineupWeights = LineupWeights()) -> DataFrame:
    """Each prospect with each team: net rating before and after taking the weakest's place, and who that is."""
    rest = F.col("weakest") == F.lit(False)
    sums = lineup.groupBy(team).agg(
        F.count(F.lit(1)).alias("_k"), F.sum("impact").alias("_i"), F.avg("shooting_spacing").alias("_s"), F.max("rim_protection").alias("_r"),
        F.coalesce(F.sum(F.when(rest, F.col("impact"))), F.lit(0.0)).alias("_i4"), F.coalesce(F.sum(F.when(rest, F.col("shooting_spacing"))), F.lit(0.0)).alias("_s4"), F.max(F.when(rest, F.col("rim_protection"))).alias("_r4"),
        F.max(F.when(F.col("weakest"), F.col("name"))).alias("replaced"),
    )
    out = prospects.crossJoin(few_teams(sums))
    before = net_rating(F.col("_i"), F.col("_s"), F.col("_r"), weights)
    after = net_rating(F.col("_i4") + F.col("impact"), (F.col("_s4") + F.col("shooting_spacing")) / F.col("_k"), F.greatest(F.coalesce("_r4", F.lit(0.0)), F.col("rim_protection")), weights)
    out = out.withColumns({"before": before, "after": after, "delta": F.round(after - before, 2)})
    return out.drop(*(c for c in sums.columns if c.startswith("_")))


def team_fit(prospects: DataFrame, roster: DataFrame, payroll: DataFrame, cap: Cap | None = None, basketball_weight: float = 0.6, team: str = "team_id") -> DataFrame:
    """Each prospect with each team: fit scores, surplus at the payroll, and the parts they come from.

    prospects: player_id, impact, vorp, pick and the six skills; roster: team_id, name, impact
    and skills; payroll: team_id, total_salary.
    """
    cap = cap or load_cap()
    pairs = synergy(prospects, team_supply(roster, team), team)
    moved = lineup_upgrade(prospects.select("player_id", "impact", "shooting_spacing", "rim_protection"), lineups(roster, team), team).select("player_id", team, "before", "after", "delta", "replaced")
    out = pairs.join(moved, ["player_id", team]).join(payroll, team, "left")
    times, label = apron(F.coalesce("total_salary", F.lit(0.0)), cap)
    out = out.withColumns({"rsv_usd": real_surplus(F.col("vorp"), F.col("pick"), cap), "apron_label": label, "_times": times})
    out = out.withColumn("rsv_modulated_usd", F.round(F.col("rsv_usd") * F.col("_times"), 2))
    out = out.withColumns({"_b": clip(50.0 + 100.0 * F.col("net") + 5.0 * F.col("delta"), 0, 100), "_f": 50.0 * (1.0 + F.tanh(F.col("rsv_modulated_usd") / 30_000_000.0))})
    story = F.format_string(
        "Taking the place of %s moves the net rating from %+.1f to %+.1f (%+.1f per 100). Synergy net %+.2f (fills needs %.2f, overlaps %.2f). Surplus of $%,.0f over the rookie deal, x%.2f (%s): $%,.0f. Exploratory.",
        "replaced", "before", "after", "delta", "net", "complementarity", "redundancy", "rsv_usd", "_times", "apron_label", "rsv_modulated_usd",
    )
    out = out.withColumns({"is_good_fit": F.col("net") > 0, "narrative": story})
    return out.withColumns({"basketball_fit": F.round("_b", 1), "financial_fit": F.round("_f", 1), "overall": F.round(basketball_weight * F.col("_b") + (1 - basketball_weight) * F.col("_f"), 1)}).drop("_b", "_f", "_times")
