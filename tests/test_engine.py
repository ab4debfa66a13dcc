"""The ranking engine by hand-computed cases, invariants and seeded data."""

import json
import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import names
from plumbline.functions.expressions import erf, mean_rank, tier
from plumbline.operators import board, cleaning, clusters, eda, explain, features, labels, metrics, mlops, models, search, survival, team_fit, temporal, uncertainty
from plumbline.plans import program
from plumbline.sources import fixtures, ingest, parse


def one(df):
    return df.first()[0]


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


# --- labels


def outcome(spark, draft, seasons, honors=(0, 0), through=2030):
    d = rows(spark, [(1, draft)], "player_id long, draft_year long")
    s = rows(spark, [(1, *x) for x in seasons], "player_id long, season_year long, minutes double, bpm double, vorp double")
    h = rows(spark, [(1, *honors)], "player_id long, all_star_count long, all_nba_count long")
    return labels.outcomes(d, s, h, through).first()


@pytest.mark.parametrize(
    ("draft", "seasons", "honors", "reached", "peak", "value", "name"),
    [
        (2015, [], (0, 0), False, None, 0.0, "bust"),
        (2015, [(2020, 2000.0, 5.0, 1.0)], (0, 0), False, None, 0.0, "bust"),
        (2015, [(2017, 1500.0, 1.0, 1.0), (2018, 1500.0, 2.0, 1.0)], (0, 0), True, 1.5, 2.0, "starter"),
        (2015, [(2015, 200.0, 1.0, 0.0), (2016, 300.0, 1.0, 0.0)], (0, 0), False, None, 0.0, "bust"),
        (2015, [(2015, 1000.0, 1.0, 0.0), (2016, 1000.0, 5.0, 0.0), (2017, 1000.0, 3.0, 0.0)], (0, 0), True, 4.0, 0.0, "all_star"),
        (2015, [(2015, 1000.0, 2.0, 0.0), (2016, 100.0, 10.0, 0.0)], (0, 0), True, 2.0, 0.0, "starter"),
        (2015, [(y, 1000.0, 0.0, 1.0) for y in range(2015, 2020)], (0, 0), True, 0.0, 4.0, "starter"),
        (2015, [(2015, 2000.0, 2.5, 0.0)], (1, 0), True, 2.5, 0.0, "all_star"),
        (2015, [(2015, 2000.0, 7.0, 0.0), (2016, 2000.0, 6.5, 0.0)], (0, 0), True, 6.75, 0.0, "superstar"),
    ],
)
def test_outcomes(spark, draft, seasons, honors, reached, peak, value, name):
    r = outcome(spark, draft, seasons, honors)
    assert (r.reached, r.peak_impact, r.cumulative_value, r.outcome_tier) == (reached, peak, value, name)


def test_resolution(spark):
    played = [(y, 1000.0, 0.0, 0.0) for y in range(2018, 2022)]
    assert outcome(spark, 2018, played, through=2021).resolved and not outcome(spark, 2018, played, through=2020).resolved
    assert not outcome(spark, 2024, [], through=2026).resolved and outcome(spark, 2024, [], through=2028).resolved


def test_impact_is_centred_and_vorp_exact(spark):
    df = rows(spark, [("2023-24", 1, 1000.0, 20.0, 0.6), ("2023-24", 2, 2000.0, 10.0, 0.5), ("2023-24", 3, 500.0, None, None), ("2024-25", 4, 0.0, 5.0, 0.5)], "season string, player_id long, minutes double, pts_per100 double, true_shooting double")
    got = labels.impact_metrics(df).collect()
    year = [r for r in got if r.season == "2023-24"]
    assert abs(sum(r.ebpm * r.minutes for r in year) / 3500) < 1e-2
    assert all(r.vorp == round((r.ebpm + 2) * r.minutes / (240 * 82), 3) for r in year)
    assert next(r for r in got if r.player_id == 4).ebpm is None


def test_vorp_rounds_halves_up(spark):
    df = rows(spark, [("2023-24", 1, 984.0, 20.6), ("2023-24", 2, 984.0, 20.0)], "season string, player_id long, minutes double, pts_per100 double")
    got = {r.player_id: (r.ebpm, r.vorp) for r in labels.impact_metrics(df).collect()}
    assert got == {1: (0.03, 0.102), 2: (-0.03, 0.099)}  # 0.1015 and 0.0985, the former less its last bit as a double


def test_values(spark):
    df = rows(spark, [(5.0, True), (float("nan"), False), (1.0, True), (float("nan"), True)], "v double, r boolean")
    assert [r[0] for r in df.select(labels.realized_value(F.col("v"), F.col("r"))).collect()] == [5.0, -2.0, 1.0, -2.0]
    assert one(spark.range(1).select(labels.unconditional_value(F.lit(0.25), F.lit(8.0)))) == 0.5
    with pytest.raises(Exception, match="must be in"):
        spark.range(1).select(labels.unconditional_value(F.lit(1.5), F.lit(8.0))).collect()
    with pytest.raises(ValueError, match="unknown"):
        labels.Targets(tiers=[("legend", 9.0, None)])
    with pytest.raises(ValueError, match="lack"):
        labels.honors_from_frame(spark.range(1))


# --- names, cleaning


def test_names(spark):
    df = rows(spark, [("Luka Dončić",), ("Young, Trae",), ("D'Angelo Russell",), ("Jaren Jackson Jr.",), ("Marvin Bagley III",)], "n string")
    assert [r[0] for r in df.select(names.name_match_key(F.col("n"))).collect()] == ["luka doncic", "trae young", "d angelo russell", "jaren jackson", "marvin bagley"]
    df = rows(spark, [("NCAA Division I",), ("G-League",), ("nowhere",), (None,)], "n string")
    assert [r[0] for r in df.select(names.normalize_league(F.col("n"))).collect()] == ["ncaa", "gleague", None, None]
    assert one(spark.range(1).select(names.season_start(F.lit("2023-24")))) == 2023


def test_entities(spark):
    stamped, identity = cleaning.resolve_entities(list(fixtures.multisource(spark)))
    assert identity.count() == 6
    assert {r.full_name: r.player_id for r in stamped[0].collect()}["Marvin Bagley III"] == {r.full_name: r.player_id for r in stamped[2].collect()}["Marvin Bagley"]
    df = rows(spark, [("Jon Smith", 2018, "1999-01-01"), ("Jonn Smith", 2018, "1998-05-05")], "full_name string, draft_year long, birthdate string")
    assert cleaning.resolve_entities([df])[1].count() == 2
    df = rows(spark, [("Jon Smith", 2018, None), ("Jonn Smith", 2018, "1998-05-05")], "full_name string, draft_year long, birthdate string")
    assert cleaning.resolve_entities([df])[1].count() == 1


def test_links_need_no_common_first_letters(spark):
    names = ["mcdermottson", "macdermottson", "ognjenovic", "gnjenovic", "someone else"]
    keys = rows(spark, [(n, n, 2018, None) for n in names], "entity string, match_key string, draft_year long, birthdate string")
    for similarity in (cleaning.ratio, cleaning.edit_similarity):
        got = {(r.a, r.b) for r in cleaning.fuzzy_links(keys, 0.88, similarity).collect()}
        assert got == {("macdermottson", "mcdermottson"), ("gnjenovic", "ognjenovic")}


def test_every_player_meets_every_team(spark):
    from plumbline.plans import queries, registry  # noqa: F401 - registers itself

    players = registry.table(spark, "/root/testdata/sf0.001", "customer").count()
    board = registry.queries()["team_fit_board"](spark, "/root/testdata/sf0.001")
    assert board.count() == 25 * players and board.select("player_id").distinct().count() == players


def test_master(spark, tmp_path):
    college, abroad, combine = fixtures.multisource(spark)
    a = cleaning.build_master([college, abroad], combine, str(tmp_path))
    b = cleaning.build_master([college.orderBy("age"), abroad], combine)
    assert a.version == b.version
    assert {r[0] for r in a.prospect_season.select("league_id").distinct().collect()} == {"ncaa", "euroleague"}
    luka = a.prospect_season.where("full_name like 'Luka%'").first()
    assert luka.usage is None and luka.usage_imputed
    assert spark.read.parquet(f"{tmp_path}/version={a.version}/identity").count() == 6
    assert cleaning.fingerprint(college.limit(0)) == "empty"


def test_imputer_sees_training_rows_only(spark):
    schema = "g string, x double, y double"
    train = rows(spark, [("a", 0.5, 1.0), ("a", 0.6, 1.0), ("a", None, 1.0), ("b", 0.1, 1.0), ("b", 0.0, 1.0)], schema)
    other = rows(spark, [("a", None, 1.0), ("a", 0.9, 1.0), ("c", None, 1.0)], schema)
    got = cleaning.Imputer(["x"], "g").fit(train).transform(other).orderBy("g", F.desc("x_imputed")).collect()
    assert abs(got[0].x - 0.55) < 1e-12 and got[0].x_imputed and got[0].x_impute_sd > 0
    assert got[1].x == 0.9 and got[1].x_impute_sd == 0 and not got[1].x_imputed
    assert abs(got[2].x - 0.30) < 1e-12
    pre = cleaning.Preprocessor(["x", "z"]).fit(rows(spark, [(2.0,), (4.0,)], "x double"))
    assert pre.transform(rows(spark, [(None,)], "x double")).first().x == 3.0


# --- features


def test_features(spark):
    seasons, combine, identity = fixtures.feature_rows(spark)
    got = {r.player_id: r for r in features.assembled(seasons, combine, identity).collect()}
    assert got["p1"].sos_jump > 0 and got["p1"].efficiency_held_up
    assert got["p2"].ts_change < 0 and not got["p2"].efficiency_held_up
    assert got["p3"].n_pre_draft_seasons == 1 and got["p3"].sos_jump is None
    assert abs(got["p4"].versatility - 2 / 3) < 1e-6 and got["p4"].agility_score is None
    model = features.LeagueContext(["pts_per100"]).fit(seasons)
    z = model.transform(seasons.where("league_id = 'ncaa' and season = 2017")).agg(F.avg("sos_z"))
    assert abs(one(z)) < 1e-9
    with pytest.raises(features.LeakageError):
        features.assert_pre_draft_safe(seasons.withColumn("peak_impact", F.lit(1.0)))


def test_links(spark):
    draft = rows(spark, [(1, "John Smith", 2023, 5, "Kansas"), (2, "Luka Dončić", 2018, 3, "Real Madrid"), (3, "No One", 2020, 9, "X")], "player_id long, full_name string, draft_year long, draft_pick long, organization string")
    college = rows(spark, [("John Smith", "Duke", 2023, 3.0), ("John Smith", "Kansas", 2023, 8.0)], "full_name string, school string, season long, pts_per40 double")
    got = {r.player_id: r.pts_per40 for r in features.link_college(draft, college, ["pts_per40"]).collect()}
    assert got == {1: 8.0, 2: None, 3: None}
    abroad = rows(spark, [("Luka Doncic", 2016, 1.0), ("Luka Doncic", 2017, 2.0), ("Luka Doncic", 2018, 3.0)], "full_name string, season long, pts_per40 double")
    pick = lambda **k: {r.player_id: r.pts_per40 for r in features.link_abroad(draft, abroad, columns=["pts_per40"], **k).collect()}[2]
    assert pick() == 2.0 and pick(strict_pre_draft=False) == 3.0
    df = rows(spark, [("1999-02-28", 2018), ("bad", 2018), (None, 2018)], "b string, y long")
    assert [r[0] for r in df.select(features.age_at_draft(F.col("b"), F.col("y"))).collect()] == [19.32, None, None]


def most_joined(df):
    """The most rows that a join of ``df`` makes."""
    df.collect()
    plans, most = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        p = plans.pop()
        name = p.nodeName()
        if "Join" in name:
            most = max(most, p.metrics().apply("numOutputRows").value())
        if "AdaptiveSparkPlan" in name:
            plans.append(p.executedPlan())
        elif "QueryStage" in name:
            plans.append(p.plan())
        plans += [p.children().apply(i) for i in range(p.children().size())]
    return most


@pytest.fixture(scope="module")
def namesakes(spark, tmp_path_factory):
    """900 players and 1500 parts with three names; a school without a price."""
    d = str(tmp_path_factory.mktemp("names"))
    rows(spark, [(k, f"c{k}", k % 25, float(k), "X") for k in range(900)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{d}/customer.parquet")
    parts = [(k, "abc"[k % 3], f"B{k % 4}", "t", k % 50, None if k % 25 in (3, 4) or k % 7 == 0 else float(k * 37 % 1001)) for k in range(1500)]
    rows(spark, parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{d}/part.parquet")
    return d


@pytest.mark.parametrize(("name", "players"), [("college_link", 900), ("college_features", 1500), ("abroad_features", 1500)])
def test_namesakes_make_no_pairs_and_nulls_are_last(spark, namesakes, name, players):
    import duckdb

    from plumbline.plans import payloads, queries, registry  # noqa: F401

    got = registry.queries()[name](spark, namesakes)
    assert most_joined(got) <= players
    con = duckdb.connect()
    for t in ("customer", "part"):
        con.execute(f"create view {t} as select * from '{namesakes}/{t}.parquet/*.parquet'")
    con.execute("create table orders (o_custkey bigint, o_orderkey bigint, o_orderdate timestamp)")
    con.execute("create table lineitem (l_orderkey bigint, l_quantity double, l_returnflag varchar, l_extendedprice double, l_partkey bigint)")
    expected = con.execute(registry.oracle_sql()[name]).fetchall()
    assert len(expected) == players and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


# --- temporal validation


def test_folds(spark):
    folds = temporal.walk_forward(list(range(2010, 2020)), 4)
    assert len(folds) == 6 and all(max(f.train_years) < min(f.val_years) for f in folds)
    assert {len(f.train_years) for f in temporal.walk_forward(list(range(2010, 2020)), 3, expanding=False)} == {3}
    with pytest.raises(features.LeakageError):
        temporal.Fold(0, (2010, 2012), (2011,))
    with pytest.raises(features.LeakageError):
        temporal.walk_forward([2010, 2011], 4)
    df = rows(spark, [(y,) for y in range(2010, 2016)], "draft_year long")
    dev, held = temporal.holdout(df, 2)
    assert one(dev.agg(F.max("draft_year"))) == 2013 and held.count() == 2


# --- metrics


def test_metrics(spark):
    df = rows(spark, [(1.0, 5.0, 1), (1.0, 5.0, 2), (2.0, 6.0, 3), (3.0, 7.0, 4)], "a double, b double, k long")
    assert abs(one(metrics.spearman(df, "a", "b")) - 1) < 1e-12
    assert abs(one(metrics.spearman(df.withColumn("b", -F.col("b")), "a", "b")) + 1) < 1e-12
    assert one(metrics.spearman(df.withColumn("b", F.lit(1.0)), "a", "b")) == 0.0
    assert abs(one(metrics.kendall(df, "a", "b", "k")) - 5 / 6) < 1e-12
    t = rows(spark, [(9.0, 1.0, 1), (8.0, 9.0, 2), (7.0, 8.0, 3), (1.0, 7.0, 4)], "a double, p double, k long")
    assert abs(one(metrics.top_k_hit_rate(t, "a", "p", "k", 3)) - 2 / 3) < 1e-12
    assert one(metrics.top_k_hit_rate(t, "a", "p", "k", 99)) == 1.0
    assert abs(one(rows(spark, [(0.0, 3.0), (0.0, 4.0)], "y double, p double").agg(metrics.rmse(F.col("y"), F.col("p")))) - math.sqrt(12.5)) < 1e-12
    assert one(rows(spark, [(1.0, 0.0, 2.0), (5.0, 0.0, 2.0), (2.0, 0.0, 2.0)], "y double, lo double, hi double").agg(metrics.interval_coverage(F.col("y"), F.col("lo"), F.col("hi")))) == 2 / 3
    c = metrics.calibration_table(rows(spark, [(0.0, 0), (0.1, 1), (0.3, 1), (1.0, 1)], "p double, y int"), "p", "y").orderBy("bin").collect()
    assert [r.n for r in c] == [2, 0, 1, 0, 0, 0, 0, 0, 0, 1] and c[1].mean_p is None
    with pytest.raises(Exception, match="probabilities"):
        metrics.calibration_table(rows(spark, [(1.2, 1)], "p double, y int"), "p", "y").collect()
    ranked = rows(spark, [(3.0,), (1.0,), (3.0,)], "x double").withColumn("r", mean_rank(F.col("x"))).orderBy("x").collect()
    assert [r.r for r in ranked] == [1.0, 2.5, 2.5]
    best = metrics.compare(spark, [{"model": "m", "rho": 0.4}, {"model": "base", "rho": 0.3}, {"model": "none", "rho": None}], "rho", "base").collect()
    assert [r.model for r in best] == ["m", "base", "none"] and abs(best[0].uplift - 0.1) < 1e-12


def test_eda(spark):
    df = rows(spark, [(1.0, "a"), (2.0, "a"), (None, "b"), (4.0, "b")], "x double, g string")
    s = eda.numeric_summary(df, ["x"]).first()
    assert (s.n, s.missing, s.median) == (4, 0.25, 2.0)
    assert {r.g: r.x for r in eda.missingness_by_group(df, "g", ["x"]).collect()} == {"a": 0.0, "b": 0.5}
    v = rows(spark, [(-5.0,), (-1.0,), (1.0,), (4.0,), (7.0,), (None,)], "x double")
    assert [r[0] for r in v.select(tier(F.col("x"))).collect()] == ["bust", "rotation", "starter", "all_star", "superstar", None]
    p = fixtures.synthetic_prospects(spark)
    text = eda.report(p, ["age", "pts_per100"], "nba_impact", "draft_year", [-2.0, 0.0, 3.0, 6.0], ["bust", "rotation", "starter", "all_star", "superstar"])
    assert text.count("## ") == 6


# --- models, uncertainty, explanations


@pytest.fixture(scope="module")
def prospects(spark):
    p = fixtures.synthetic_prospects(spark)
    reached = F.col("nba_impact") > -1
    years = F.greatest(F.lit(1), F.round(6 + F.col("nba_impact") + 2 * uncertainty.uniform("player_id", 3)).cast("int"))
    ended = F.pmod(F.xxhash64("player_id"), F.lit(4)) != 0
    return p.withColumns({"reached": reached, "peak_impact": F.when(reached, F.col("nba_impact")), "outcome_tier": F.when(reached, tier(F.col("nba_impact"))).otherwise("bust"), "resolved": F.lit(True), "career_seasons": years.cast("long"), "career_ended": ended}).cache()


def test_ridge_and_hurdle(spark, prospects):
    p = fixtures.FEATURES
    m = models.ridge(prospects, p, "nba_impact", 1.0)
    assert one(metrics.spearman(m.transform(prospects), "nba_impact", "prediction")) > 0.4
    assert models.Linear.from_json(m.to_json()).weights == m.weights
    h = models.Hurdle(p).fit(prospects).transform(prospects)
    assert one(h.agg(F.max(F.abs(F.col("p_reach") * F.col("impact_if_reached") - 2 * (1 - F.col("p_reach")) - F.col("prediction"))))) < 1e-9
    t = models.TierModel(p).fit(prospects).transform(prospects).select(sum(F.col(f"p_{x}") for x in models.TIERS).alias("s"))
    assert one(t.agg(F.max(F.abs(F.col("s") - 1)))) < 1e-3
    g = models.gbm_regressor(p, "nba_impact", trees=5).fit(prospects).transform(prospects)
    assert one(metrics.spearman(g, "nba_impact", "prediction")) > 0.4
    c = survival.Cox(p, "career_seasons", "career_ended").fit(prospects).transform(prospects)
    assert one(metrics.concordance(c, "career_seasons", "career_ended", "risk")) > 0.6
    best, score, done = search.tuned(lambda a, n: -((a - 3) ** 2) - n, {"a": (0.0, 9.0, "float"), "n": (0, 0, "int")}, 30)
    assert len(done) == 30 and score == max(s for _, s in done) and abs(best["a"] - 3) < 1.5
    grouped, _ = clusters.kmeans(prospects, ["pts_per100", "ast_per100"], 3)
    assert grouped.select("cluster").distinct().count() == 3


def test_baseline(spark):
    df = rows(spark, [(1, 10.0), (2, 10.0 - math.log(2)), (10, 10.0 - math.log(10))], "draft_pick long, y double")
    m = models.DraftPosition().fit(df, "y")
    assert abs(m.slope + 1) < 1e-9 and abs(m.intercept - 10) < 1e-9
    with pytest.raises(Exception, match="pick"):
        m.transform(rows(spark, [(0,)], "draft_pick long")).collect()


def test_intervals(spark, prospects):
    p, y = fixtures.FEATURES, "nba_impact"
    c = uncertainty.SplitConformal(p, y, "player_id").fit(prospects)
    out = c.transform(prospects)
    assert 0.72 < one(out.agg(metrics.interval_coverage(F.col(y), F.col("lower"), F.col("upper")))) < 0.92
    assert one(out.agg(F.max(F.col("upper") - F.col("lower")) - F.min(F.col("upper") - F.col("lower")))) < 1e-9
    b = uncertainty.Bootstrap(p, y, "player_id", members=12).fit(prospects).tiers(prospects)
    assert one(b.agg(F.max(F.abs(sum(F.col(f"p_{t}") for t in models.TIERS) - 1)))) < 1e-2
    assert one(b.agg(F.min(F.col("upper") - F.col("lower")))) >= 0
    q = uncertainty.QuantileLinear(p, y).fit(prospects).transform(prospects)
    assert 0.7 < one(q.agg(metrics.interval_coverage(F.col(y), F.col("lower"), F.col("upper")))) < 0.9
    bayes = uncertainty.BayesianLinear(p, y).fit(prospects).transform(prospects)
    assert one(bayes.agg(F.min("prediction_sd"))) > 0
    got = spark.range(1).select(erf(F.lit(0.7)), erf(F.lit(-1.3))).first()
    assert abs(got[0] - math.erf(0.7)) < 2e-7 and abs(got[1] - math.erf(-1.3)) < 2e-7
    s = spark.range(1).select(F.array(*map(F.lit, [-3.0, -1.0, 1.0, 4.0, 7.0])).alias("s")).select(*uncertainty.tiers_from_samples(F.col("s")).values()).first()
    assert list(s) == [0.2] * 5


def test_explanations(spark, prospects):
    p = fixtures.FEATURES
    m = models.ridge(prospects, p, "nba_impact", 1.0)
    local = explain.LinearShap(m, prospects).local(m.transform(prospects))
    assert one(local.agg(F.max(F.abs(F.col("shap_base") + sum(F.col(f"shap_{f}") for f in p) - F.col("prediction"))))) < 1e-6
    assert explain.LinearShap(m, prospects).importance(prospects).count() == len(p)
    g = explain.greedy_counterfactual(prospects.limit(20), m, {"pts_per100": (2.0, 35.0), "age": (17.5, 24.0)}, F.lit(1.0)).collect()
    assert all(len(r.changes) <= 3 and (r.projected >= 1.0) == r.reached for r in g)
    one_move = explain.single_counterfactual(prospects.limit(20), m, "pts_per100", m.expression() + 0.1, 2.0, 35.0).collect()
    assert any(r.counterfactual is not None for r in one_move)
    pd = explain.partial_dependence(prospects, explain.linear_expression(m), "pts_per100", grid=[5.0, 10.0]).collect()
    assert abs((pd[1].mean_prediction - pd[0].mean_prediction) / 5 - m.weights[p.index("pts_per100")]) < 1e-9
    imp = explain.permutation_importance(prospects, m.transform, lambda d: one(metrics.spearman(d, "nba_impact", "prediction")), ["pts_per100", "wingspan_in"], "player_id", 2).collect()
    assert imp[0].feature == "pts_per100"


# --- operations, fit, board


def test_drift_and_registry(spark, tmp_path, prospects):
    a = spark.range(4000).select((F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0).alias("x"))
    b = spark.range(4000, 8000).select((F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0).alias("x"))
    got = {r.k: r.psi for r in (mlops.stability_index(a, b, "x").withColumn("k", F.lit("same")).union(mlops.stability_index(a, b.select((F.col("x") + 5).alias("x")), "x").withColumn("k", F.lit("moved")))).collect()}
    assert got["same"] < 0.1 and got["moved"] > 0.25
    assert one(mlops.stability_index(a.select(F.lit(1.0).alias("x")), b, "x")) == 0
    assert mlops.drift_report(a, b, ["none"]).columns == ["feature", "psi", "drifted"]
    assert mlops.should_retrain(2024, 2025, 0.0)[0] and not mlops.should_retrain(2024, 2024, 0.05)[0] and mlops.should_retrain(2024, 2024, 0.4)[0]
    registry = mlops.Registry(tmp_path)
    out = mlops.run_pipeline(prospects, ["age", "pts_per100"], "nba_impact", registry)
    assert out["cross_validation"]["ridge"]["rmse"]["mean"] < out["cross_validation"]["mean"]["rmse"]["mean"]
    registry.promote(out["version"], "production")
    assert registry.load("production")[1].version == out["version"] and registry.models()[0].name == "ridge"
    with pytest.raises(KeyError):
        registry.load("v99")
    with pytest.raises(ValueError, match="gold"):
        registry.promote(out["version"], "gold")


def test_finance(spark):
    cap = team_fit.load_cap()
    r = spark.range(1).select(team_fit.rookie_first_year(F.lit(1), cap), team_fit.rookie_first_year(F.lit(16), cap), team_fit.projected_value(F.lit(2.0), cap)).first()
    assert r[0] == 13825920 and abs(r[1] - 4682640 * 0.93**2) < 1e-6 and r[2] == 2 * 2.7 * 3.5e6 * 4
    m = spark.createDataFrame([(230e6,), (210e6,), (202e6,), (100e6,)], "s double").select(*team_fit.apron(F.col("s"), cap)).collect()
    assert [x[0] for x in m] == [1.5, 1.3, 1.15, 1.0]
    assert "cap figures are projections" in cap.assumptions and not any("projections" in x for x in team_fit.load_cap("2025-26").assumptions)


def test_team_fit(spark):
    player = lambda i, name, impact, level: (i, 1, name, impact, *[float(level)] * 6)
    schema = "player_id long, team_id long, name string, impact double, " + ", ".join(f"{s} double" for s in team_fit.SKILLS)
    roster = rows(spark, [player(k, f"n{k}", float(k), 50) for k in range(6)], schema)
    pool = rows(spark, [(9, 4.0, 4.0, 3, *[100.0] * 6)], "player_id long, impact double, vorp double, pick long, " + ", ".join(f"{s} double" for s in team_fit.SKILLS))
    r = team_fit.team_fit(pool, roster, rows(spark, [(1, 1e8)], "team_id long, total_salary double")).first()
    assert r.complementarity == 10.0 and r.redundancy == 0.0 and r.replaced == "n1"
    assert r.before == round(15 + 0.06 * -5 + 0, 2) and r.after == round(18 + 0.06 * 5 + 0.05 * 50, 2)
    assert r.basketball_fit == 100.0 and 50 < r.financial_fit <= 100


def test_service(spark):
    s = board.Service.demo(spark)
    top = s.prospects(5)
    assert [r["model_rank"] for r in top] == [1, 2, 3, 4, 5] and all(r["floor"] <= r["ceiling"] for r in top)
    assert abs(sum(top[0][f"p_{t}"] for t in models.TIERS) - 1) < 1e-2
    who = top[0]["player_id"]
    e = s.explain(who)
    assert abs(e["base"] + sum(e["contributions"].values()) - e["prediction"]) < 1e-6
    c = s.counterfactual(who)
    assert c["reached"] in (True, False) and s.health() == {"status": "ok"} and s.meta()["mode"] == "demo"
    with pytest.raises(KeyError):
        s.explain(-1)


# --- sources


def payload(headers, data):
    return json.dumps({"resultSets": [{"headers": headers, "rowSet": data}]})


def test_parsers(spark, tmp_path):
    raw = lambda *texts: spark.createDataFrame([(t,) for t in texts], "value string")
    h = ["PERSON_ID", "PLAYER_NAME", "SEASON", "ROUND_NUMBER", "OVERALL_PICK", "ORGANIZATION", "ORGANIZATION_TYPE"]
    d = parse.draft_history(raw(payload(h, [[1, "A", "2018", 1, 3, "Duke", "College"]]))).first()
    assert (d.player_id, d.draft_year, d.draft_pick, d.team_abbr) == (1, 2018, 3, None)
    c = parse.combine(raw(payload(["PLAYER_ID", "PLAYER_NAME", "SEASON", "POSITION", "WINGSPAN", "BODY_FAT_PCT"], [[1, "A", "2018", "G", 80.5, None], [2, "B", "2018", "F", "-", 5]]))).collect()
    assert c[0].wingspan_in == 80.5 and c[0].body_fat_pct is None and c[1].wingspan_in is None
    awards = spark.createDataFrame([(7, payload(["PERSON_ID", "DESCRIPTION"], [[7, "NBA All-Star"], [7, "NBA All-Star"], [7, "All-NBA"], [7, "MVP"]])), (8, payload([], []))], "player_id long, value string")
    assert {r.player_id: (r.all_star_count, r.all_nba_count) for r in parse.player_awards(awards).collect()} == {7: (2, 1), 8: (0, 0)}
    base = payload(["PLAYER_ID", "PLAYER_NAME", "AGE", "GP", "MIN", "PTS", "AST", "OREB", "DREB", "REB", "STL", "BLK", "TOV"], [[1, "A", 20, 70, 2000, 1000, 300, 1, 1, 2, 1, 1, 1], [2, "B", 20, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1]])
    adv = payload(["PLAYER_ID", "POSS", "TS_PCT", "USG_PCT", "PIE", "NET_RATING"], [[1, 2000, 0.6, 0.2, 0.1, 1], [2, 0, 0.5, 0.1, 0.1, 0]])
    s = parse.player_season(raw(base), raw(adv), "2023-24").orderBy("player_id").collect()
    assert (s[0].pts_per100, s[0].ast_per100, s[1].pts_per100) == (50.0, 15.0, None)
    col = json.dumps([{"name": "J", "team": "K", "season": 2023, "minutes": 1144, "points": 489, "usage": 20.7, "effectiveFieldGoalPct": 54.4, "threePointFieldGoals": {"pct": 42.9}, "rebounds": {"total": 100}}])
    r = parse.college_season(raw(col)).first()
    assert abs(r.pts_per40 - 489 / 1144 * 40) < 1e-9 and abs(r.usage - 0.207) < 1e-9 and abs(r.three_pt_pct - 0.429) < 1e-9
    ab = json.dumps([{"Player.Name": "L", "Season_Code": "E2017", "minutesPlayed": 900, "pointsScored": 500, "fieldGoalsAttempted2": 250, "fieldGoalsAttempted3": 150, "freeThrowsAttempted": 120}, {"player": "M", "season": 2018, "min": 0}])
    x = parse.abroad_season(raw(ab)).orderBy("season").collect()
    assert x[0].season == 2017 and abs(x[0].pts_per40 - 500 / 900 * 40) < 1e-9 and abs(x[0].true_shooting - 500 / (2 * (400 + 0.44 * 120))) < 1e-9
    assert x[1].true_shooting is None and x[1].pts_per40 is None
    for name, text in (("draft_2018.json", payload(h, [[1, "A", "2018", 1, 3, "Duke", "College"]])), ("combine_2018.json", payload(["PLAYER_ID", "PLAYER_NAME", "SEASON", "POSITION", "WINGSPAN"], [[1, "A", "2018", "G", 80.5]])), ("base_2018-19.json", base), ("advanced_2018-19.json", adv)):
        (tmp_path / name).write_text(text)
    table = program.modeling_table(program.frames(spark, str(tmp_path)), 2024).collect()
    assert len(table) == 1 and table[0].reached and table[0].wingspan_in == 80.5


def test_program_evaluates(spark, prospects, tmp_path):
    out = program.evaluate(prospects, ["age", "pts_per100", "draft_pick"], mlops.Registry(tmp_path / "r"), str(tmp_path / "out"), trials=1)
    assert out["holdout"]["spearman"] > 0.2 and out["career_concordance"] > 0.5 and out["served_spearman"] > 0.2
    assert spark.read.parquet(str(tmp_path / "out/modeling_table")).count() == prospects.count()


def test_ingestion(spark, tmp_path):
    source = ingest.Source("s", "api", "https://x.test", "MIT", 60, True)
    assert source.min_interval_s == 1.0
    with pytest.raises(ValueError, match="rate"):
        ingest.Source("s", "api", "https://x.test", "MIT", 0, True)
    assert ingest.cache_key("u", {"a": 1, "b": 2}) == ingest.cache_key("u", {"b": 2, "a": 1})
    col = ingest.cache_key_column(F.lit("u"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))
    assert one(spark.range(1).select(col)) == ingest.cache_key("u", {"a": 1, "b": 2})
    answers, slept = [(500, b""), (200, b"payload")], []
    client = ingest.PoliteClient(source, ingest.FileCache(tmp_path), lambda *a: answers.pop(0), sleep=slept.append, limiter=ingest.RateLimiter(0))
    assert client.get("https://x.test/a") == b"payload" and client.get("https://x.test/a") == b"payload" and slept == [1.0]
    assert ingest.provenance_table(spark, str(tmp_path)).first().source == "s"
    with pytest.raises(ingest.FetchError):
        ingest.PoliteClient(source, ingest.FileCache(tmp_path), lambda *a: (404, b""), limiter=ingest.RateLimiter(0)).get("https://x.test/b")
    with pytest.raises(ingest.FetchBlocked):
        ingest.PoliteClient(ingest.Source("t", "scrape", "https://x.test", "none", 1, True, True), ingest.FileCache(tmp_path), lambda *a: (500, b"")).get("https://x.test/c")
    robots = ingest.Robots(lambda *a: (200, b"User-agent: *\nDisallow: /private"))
    assert robots.allowed("https://x.test/open") and not robots.allowed("https://x.test/private/1")
    empty = ingest.StatsIngester(ingest.FileCache(tmp_path / "n"), lambda *a: 1 / 0, source, ingest.RateLimiter(0))
    assert json.loads(empty.player_awards(3)) == {"resultSets": [{"headers": [], "rowSet": []}]}
    with pytest.raises(ingest.MissingKey):
        ingest.CollegeIngester(client, None)


def test_streaming_moments(spark, tmp_path):
    from plumbline.streaming.drift import windowed_moments

    spark.range(100).select(F.timestamp_seconds(F.col("id") * 120).alias("ts"), (F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, g long, v double").parquet(str(tmp_path / "in"))
    q = windowed_moments(stream, "ts", "g", "v").writeStream.outputMode("complete").format("memory").queryName("moments").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from moments").first()[0] == 100


def test_config(tmp_path):
    from plumbline.config import load_config, load_targets

    (tmp_path / "c.yaml").write_text("seed: 7\nvalidation: {n_holdout_years: 3}\n")
    c = load_config(tmp_path / "c.yaml")
    assert c.seed == 7 and c.validation.n_holdout_years == 3 and c.validation.min_train_years == 4
    (tmp_path / "c.yaml").write_text("sed: 7\n")
    with pytest.raises(ValueError, match="sed"):
        load_config(tmp_path / "c.yaml")
    (tmp_path / "t.yaml").write_text("window: 3\ntiers: [{name: superstar, least: 5}, {name: starter, least: 0}]\n")
    assert load_targets(tmp_path / "t.yaml").tiers == [("superstar", 5.0, None), ("starter", 0.0, None)]
