"""Registered queries of sources, parsers, links and fit: payloads built from the tables and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import names
from plumbline.operators import boosting, cleaning, features, labels, models, team_fit, uncertainty
from plumbline.plans import binding as b
from plumbline.plans.queries import _PLAYERS_SQL, WITH_IMPACT, WITH_LABELS, WITH_SEASONS, _players, _r
from plumbline.plans.registry import query, table
from plumbline.sources import ingest, parse


def _payload(cells: dict[str, Column]) -> Column:
    """A result set of one row, as the statistics source sends it."""
    one = F.struct(F.array(*map(F.lit, cells)).alias("headers"), F.array(F.array(*(c.cast("string") for c in cells.values()))).alias("rowSet"))
    return F.to_json(F.struct(F.array(one).alias("resultSets"))).alias("value")


def _k() -> Column:
    return F.col("c_custkey")


@query("select c_custkey as player_id, c_name as full_name, (1993 + c_custkey % 6)::bigint as draft_year, (1 + c_custkey % 60)::bigint as draft_pick, (1 + c_custkey % 2)::bigint as draft_round, c_mktsegment as organization, case when c_custkey % 4 > 0 then 'College' end as organization_type, 'T' || c_nationkey as team_abbr, null::varchar as team_name from customer")
def parsed_draft(spark: SparkSession, d: str) -> DataFrame:
    """A header that occurs twice counts with its last value; one that isn't there gives nulls."""
    cells = {"PERSON_ID": _k(), "PLAYER_NAME": F.col("c_name"), "SEASON": 1993 + _k() % 6, "OVERALL_PICK": 1 + _k() % 60, "ROUND_NUMBER": 1 + _k() % 2, "ORGANIZATION": F.col("c_mktsegment"), "ORGANIZATION_TYPE": F.when(_k() % 4 > 0, "College"), "TEAM_ABBREVIATION": F.concat(F.lit("T"), F.col("c_nationkey").cast("string"))}
    return parse.draft_history(table(spark, d, "customer").select(_payload(cells)))


@query("""select p_partkey as player_id, p_name as full_name, (1993 + p_partkey % 6)::bigint as draft_year, p_brand as position, round(70 + p_size / 4.0::double, 4) as wingspan_in, case when p_partkey % 7 > 0 then round(90 + p_size / 5.0::double, 4) end as standing_reach_in,
 null::double as max_vertical_in, round(10 + p_size / 40.0::double, 4) as lane_agility_s, null::double as body_fat_pct from part""")
def parsed_combine(spark, d):
    """Numbers as text, missing ones and some that can't be read."""
    p, size = F.col("p_partkey"), F.col("p_size").cast("double")
    cells = {"PLAYER_ID": p, "PLAYER_NAME": F.col("p_name"), "SEASON": 1993 + p % 6, "POSITION": F.col("p_brand"), "WINGSPAN": F.round(70 + size / 4.0, 4), "STANDING_REACH": F.when(p % 7 > 0, F.round(90 + size / 5.0, 4)), "MAX_VERTICAL_LEAP": F.lit("-"), "LANE_AGILITY_TIME": F.round(10 + size / 40.0, 4)}
    return parse.combine(table(spark, d, "part").select(_payload(cells)))


@query("select c_custkey as player_id, case when c_custkey % 5 > 0 then strftime(make_date(1970 + (c_custkey % 20)::int, 1 + (c_custkey % 12)::int, 1 + (c_custkey % 28)::int), '%Y-%m-%d') end as birthdate, case when c_custkey % 3 > 0 then (1993 + c_custkey % 6)::bigint end as draft_year from customer")
def parsed_info(spark, d):
    day = F.date_format(F.make_date((1970 + _k() % 20).cast("int"), (1 + _k() % 12).cast("int"), (1 + _k() % 28).cast("int")), "yyyy-MM-dd'T00:00:00'")
    cells = {"PERSON_ID": _k(), "BIRTHDATE": F.when(_k() % 5 > 0, day).otherwise(""), "DRAFT_YEAR": F.when(_k() % 3 > 0, (1993 + _k() % 6).cast("string")).otherwise("Undrafted")}
    return parse.player_info(table(spark, d, "customer").select(_payload(cells)))


@query("""select p_partkey as player_id, p_name as full_name, (20 + p_partkey % 15)::double as age, (p_partkey % 82)::bigint as gp, (p_size * 20)::double as minutes, (p_size % 3 * 100)::double as poss, 0.5::double as true_shooting, case when p_partkey % 4 > 0 then 0.2::double end as usage, 0.1::double as pie, null::double as net_rating, '2018-19' as season,
 """ + ", ".join(f"case when p_size % 3 > 0 then round({m}::double / (p_size % 3 * 100) * 100.0::double, 6) end as {c}_per100" for c, m in (("pts", "p_size * 9"), ("ast", "p_size * 2"), ("oreb", "p_size"), ("dreb", "p_size * 3"), ("reb", "p_size * 4"), ("stl", "p_partkey % 50"), ("blk", "p_partkey % 40"), ("tov", "p_partkey % 60"))) + " from part")
def parsed_season(spark, d):
    """Totals and rates of two payloads; without possessions the rates per 100 are null."""
    p, size = F.col("p_partkey"), F.col("p_size")
    base = {"PLAYER_ID": p, "PLAYER_NAME": F.col("p_name"), "AGE": 20 + p % 15, "GP": p % 82, "MIN": size * 20, "PTS": size * 9, "AST": size * 2, "OREB": size, "DREB": size * 3, "REB": size * 4, "STL": p % 50, "BLK": p % 40, "TOV": p % 60}
    advanced = {"PLAYER_ID": p, "POSS": size % 3 * 100, "TS_PCT": F.lit(0.5), "USG_PCT": F.when(p % 4 > 0, 0.2), "PIE": F.lit(0.1)}
    parts = table(spark, d, "part")
    got = parse.player_season(parts.select(_payload(base)), parts.select(_payload(advanced)), "2018-19")
    return got.select(*(_r(c) if c.endswith("_per100") else c for c in got.columns))


_P40 = ", ".join(f"case when p_size % 4 > 0 then round({v}::double / (p_size % 4 * 100) * 40.0::double, 6) end as {c}_per40" for c, v in (("pts", "p_size * 3"), ("ast", "p_size"), ("reb", "p_size * 2"), ("stl", "p_partkey % 9"), ("blk", "p_partkey % 8"), ("tov", "p_partkey % 7")))


@query(f"""select p_partkey::varchar as cbd_athlete_id, p_name as full_name, p_brand as school, p_type as conference, (1993 + p_partkey % 6)::bigint as season, 'G' as position, 30::bigint as games, (p_size % 4 * 100)::double as minutes, {_P40}, 0.55::double as true_shooting,
 round(p_size / 100.0::double, 6) as usage, null::double as efg, round((p_partkey % 50) / 100.0::double, 6) as three_pt_pct, null::double as oreb_pct, 110.5::double as off_rating, null::double as def_rating, 3.5::double as net_rating, null::double as porpag, (p_size / 200.0::double) as win_shares_per40, (p_size / 10.0::double) as ast_to from part""")
def parsed_college(spark, d):
    """Nested objects as per-40 rates; percents become fractions."""
    p, size = F.col("p_partkey"), F.col("p_size")
    one = F.struct(
        p.cast("string").alias("athleteId"), F.col("p_name").alias("name"), F.col("p_brand").alias("team"), F.col("p_type").alias("conference"), (1993 + p % 6).alias("season"), F.lit("G").alias("position"), F.lit(30).alias("games"), F.when(size % 4 > 0, size % 4 * 100).alias("minutes"),
        (size * 3).alias("points"), size.alias("assists"), F.struct((size * 2).alias("total")).alias("rebounds"), (p % 9).alias("steals"), (p % 8).alias("blocks"), (p % 7).alias("turnovers"), F.lit(0.55).alias("trueShootingPct"), size.alias("usage"), F.struct((p % 50).alias("pct")).alias("threePointFieldGoals"),
        F.lit(110.5).alias("offensiveRating"), F.lit(3.5).alias("netRating"), F.struct((size / 200.0).alias("totalPer40")).alias("winShares"), (size / 10.0).alias("assistsTurnoverRatio"),
    )
    got = parse.college_season(table(spark, d, "part").select(F.to_json(F.array(one)).alias("value")))
    return got.select(*(_r(c) if c in ("usage", "three_pt_pct") or c.endswith("_per40") and c != "win_shares_per40" else c for c in got.columns))


@query("""with x as (select *, (s_suppkey % 5 * 50)::double as m, s_suppkey % 30 as pts from supplier)
select s_name as full_name, (1993 + s_suppkey % 6)::bigint as season, (s_suppkey % 40)::bigint as games, m as minutes, case when m > 0 then round(pts / m * 40.0::double, 6) end as pts_per40, case when m > 0 then round(s_suppkey % 11 / m * 40.0::double, 6) end as ast_per40, null::double as reb_per40, null::double as stl_per40, null::double as blk_per40, null::double as tov_per40,
 case when s_suppkey % 3 > 0 then round(pts / (2.0::double * ((s_suppkey % 9 + s_suppkey % 7 + 1) + 0.44::double * (s_suppkey % 6))), 6) end as true_shooting from x""")
def parsed_abroad(spark, d):
    """Flat records whose keys differ in case and points; of keys that are alike the last one counts."""
    s = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    entries = {"player.name": F.lit("nobody"), "playerName": F.col("s_name"), "SEASON_CODE": F.concat(F.lit("E"), text(1993 + s % 6)), "Games Played": text(s % 40), "Minutes": text(s % 5 * 50), "Points_Scored": text(s % 30), "assistances": text(s % 11), "fieldGoalsAttempted2": text(s % 9), "fieldGoalsAttempted3": text(s % 7 + 1), "freeThrowsAttempted": F.when(s % 3 > 0, text(s % 6))}
    one = F.create_map(*(x for k, v in entries.items() for x in (F.lit(k), v)))
    got = parse.abroad_season(table(spark, d, "supplier").select(F.to_json(F.array(one)).alias("value")))
    return got.select(*(_r(c) if c.endswith("_per40") or c == "true_shooting" else c for c in got.columns))


@query("""select o_orderkey, year(o_orderdate)::bigint as start_year, year(o_orderdate)::bigint as digits, case o_orderkey % 4 when 0 then 'ncaa' when 1 then 'euroleague' when 2 then 'gleague' end as league, case when o_orderkey % 3 = 0 then -2.0 else o_totalprice / 100000.0::double end::double as realized from orders""")
def season_and_league_names(spark, d):
    """Season labels as years, spellings of leagues as ids, and values of what was reached."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    label = F.concat(F.year("o_orderdate").cast("string"), F.lit("-"), F.lpad(((F.year("o_orderdate") + 1) % 100).cast("string"), 2, "0"))
    league = F.element_at(F.array(*map(F.lit, ("NCAA Division I", " EuroLeague ", "G-League", "Parish League"))), (k % 4 + 1).cast("int"))
    return o.select("o_orderkey", names.season_start(label).alias("start_year"), parse.season_number(label).alias("digits"), names.normalize_league(league).alias("league"), labels.realized_value(F.col("o_totalprice") / 100000.0, k % 3 != 0).alias("realized"))


@query("select c_custkey, substr(sha256(case when c_custkey % 3 = 0 then 'https://x.test/' || c_custkey else 'https://x.test/' || c_custkey || '?page=' || (c_custkey % 7) || '&season=' || (1993 + c_custkey % 6) end), 1, 24) as key, sha256(c_name) as digest from customer")
def cache_keys(spark, d):
    """Keys of requests with and without parameters, in any order of these."""
    params = F.when(_k() % 3 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("season"), (1993 + _k() % 6).cast("string"), F.lit("page"), (_k() % 7).cast("string")))
    return table(spark, d, "customer").select("c_custkey", ingest.cache_key_column(F.concat(F.lit("https://x.test/"), _k().cast("string")), params).alias("key"), F.sha2("c_name", 256).alias("digest"))


# --- links, features, resolution

_PART_DRAFT = "pd as (select p_partkey as player_id, p_name as full_name, (1993 + p_partkey % 6)::bigint as draft_year, p_brand as organization from part)"
_PART_ROWS = "pr as (select p_name, lower(regexp_replace(p_name, '[^A-Za-z0-9 ]+', ' ', 'g')) as key, (1993 + p_partkey % 6)::bigint as season, p_brand as school, p_retailprice as v, (p_size / 100.0::double) as usage from part)"


def _part_sides(spark, d):
    p = table(spark, d, "part")
    draft = p.select(F.col("p_partkey").alias("player_id"), F.upper("p_name").alias("full_name"), (1993 + F.col("p_partkey") % 6).alias("draft_year"), F.col("p_brand").alias("organization"))
    rows = p.select(F.col("p_name").alias("full_name"), (1993 + F.col("p_partkey") % 6).alias("season"), F.col("p_brand").alias("school"), F.col("p_retailprice").alias("pts_per40"), (F.col("p_size") / 100.0).alias("usage"))
    return draft, rows


@query(f"""with {_PART_DRAFT}, {_PART_ROWS}, j as (select pd.player_id, pr.v, pr.usage, row_number() over (partition by pd.player_id order by case when lower(pr.school) = lower(pd.organization) then 0 else 1 end, pr.v, pr.usage) as k from pd left join pr on pr.p_name = pd.full_name and pr.season = pd.draft_year)
select player_id, v as pts_per40, usage from j where k = 1""")
def college_features(spark, d):
    """The linker on names, years and schools; ties by the rows' values."""
    draft, rows = _part_sides(spark, d)
    return features.link_college(draft, rows, ["pts_per40", "usage"])


@query(f"""with {_PART_DRAFT}, {_PART_ROWS}, j as (select pd.player_id, pr.v, row_number() over (partition by pd.player_id order by pr.season desc nulls last, pr.v) as k from pd left join pr on pr.p_name = pd.full_name and pr.season between pd.draft_year - 1 and pd.draft_year)
select player_id, v as pts_per40 from j where k = 1""")
def abroad_features(spark, d):
    draft, rows = _part_sides(spark, d)
    return features.link_abroad(draft, rows.drop("school"), False, ["pts_per40"])


@query("""with k as (select distinct trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) as key, 1993 + p_partkey % 6 as y from part)
select 'p_' || substr(sha1(key || '|' || y), 1, 12) as player_id, y::bigint as draft_year from k""")
def entity_ids(spark, d):
    """Whole tables from two sources that spell names differently, one person to a key and year."""
    p = table(spark, d, "part").select(F.col("p_name").alias("full_name"), (1993 + F.col("p_partkey") % 6).alias("draft_year"))
    _, identity = cleaning.resolve_entities([p, p.withColumn("full_name", F.concat(F.upper("full_name"), F.lit(" Jr.")))], 1.0, cleaning.edit_similarity)
    return identity.select("player_id", "draft_year")


@query(f"""{WITH_IMPACT}, base as (select avg(ebpm) as b, count(*) as n from impact), cuts as (select distinct usage as t from impact where usage < (select max(usage) from impact) union all select 'infinity'::double), sides as (select t, side from cuts cross join (values (true), (false)) v(side)),
sums as (select t, side, sum(case when coalesce(usage <= t, side) then b - ebpm else 0 end) as gl, count(*) filter (coalesce(usage <= t, side)) as nl, sum(b - ebpm) as g, any_value(n) as n from sides cross join impact cross join base group by all),
best as (select *, gl * gl / (nl + 1) + (g - gl) * (g - gl) / (n - nl + 1) as gain from sums where nl >= 1 and n - nl >= 1 order by gain desc, t, side desc limit 1),
steps as (select t, side, -0.5::double * gl / (nl + 1) as l, -0.5::double * (g - gl) / (n - nl + 1) as r, nl / n::double as share from best)
select player_id, season_year, round(b + case when coalesce(usage <= t, side) then l else r end, 6) as prediction, round(b + share * l + (1 - share) * r, 6) as shap_base, round(case when coalesce(usage <= t, side) then l - (share * l + (1 - share) * r) else r - (share * l + (1 - share) * r) end, 6) as shap_usage from impact cross join base cross join steps""")
def boosted_stump(spark, d):
    """A boosted split on a feature with missing values, and its Shapley values."""
    rows = b.impact(spark, d).select("player_id", "season_year", "usage", "ebpm")
    model = models.gbm_regressor(["usage"], "ebpm", trees=1, depth=1, rate=0.5).fit(rows)
    got = boosting.TreeShap(model).local(model.transform(rows))
    return got.select("player_id", "season_year", _r("prediction"), _r("shap_base"), _r("shap_usage"))


@query()
def boosted_value(spark, d):
    """Boosted trees and their exact Shapley values over all seasons; features with nulls."""
    rows = b.impact(spark, d).select("player_id", "season_year", "usage", "minutes", "true_shooting", "ebpm")
    model = models.gbm_regressor(["usage", "minutes", "true_shooting"], "ebpm", trees=10).fit(rows)
    return boosting.TreeShap(model).local(model.transform(rows))


#: Names of all parts, each once more with a letter left out; birth dates of some.
_PEOPLE = """people as (select p_name || ' ' || substr(p_type, 1, 9) as name, 1993 + p_partkey % 6 as y, case when p_partkey % 3 = 0 then '19' || (70 + p_partkey % 4) || '-01-01' end as birth from part),
spelt as (select * from people union all select substr(name, 1, 4) || substr(name, 6), y, null from people),
keyed as (select trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) as key, y::bigint as y, min(birth) as birth from spelt group by 1, 2),
alike as (select a.key as a, b.key as b, a.y from keyed a join keyed b on a.y = b.y and a.key < b.key and (a.birth is null or b.birth is null or a.birth = b.birth) and 1.0::double - levenshtein(a.key, b.key) / greatest(length(a.key), length(b.key))::double >= 0.88)"""


def _people(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" "), F.substring("p_type", 1, 9)).alias("full_name"), (F.lit(1993) + F.col("p_partkey") % 6).cast("long").alias("draft_year"))
    p = p.withColumn("birthdate", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("19"), 70 + F.col("p_partkey") % 4, F.lit("-01-01")))).drop("p_partkey")
    return p, p.withColumn("full_name", F.concat(F.substring("full_name", 1, 4), F.expr("substring(full_name, 6)"))).drop("birthdate")


@query(f"with {_PEOPLE} select a, b, y from alike")
def entity_links(spark, d):
    """Names of a year that are 0.88 alike by edits and whose birth dates agree."""
    one, two = _people(spark, d)
    every = one.unionByName(two, allowMissingColumns=True).withColumn("match_key", names.name_match_key(F.col("full_name")))
    every = every.groupBy("match_key", "draft_year").agg(F.min("birthdate").alias("birthdate"))
    got = cleaning.fuzzy_links(every.withColumn("entity", F.concat_ws("|", "match_key", "draft_year")), 0.88, cleaning.edit_similarity)
    part = lambda c, i: F.substring_index(c, "|", i)
    return got.select(part("a", 1).alias("a"), part("b", 1).alias("b"), part("a", -1).cast("long").alias("y"))


@query(f"""with recursive {_PEOPLE}, both_ as (select a, b, y from alike union all select b, a, y from alike), reach as (select key as a, key as b, y from keyed union select r.a, l.b, r.y from reach r join both_ l on r.b = l.a and r.y = l.y),
root as (select a as key, y, min(b) as root from reach group by 1, 2) select 'p_' || substr(sha1(root || '|' || y), 1, 12) as player_id, y as draft_year, min(birth) as birthdate, count(*)::bigint as spellings from root join keyed using (key, y) group by 1, 2""")
def resolved_people(spark, d):
    """People of two sources, one of which drops a letter of each name: fuzzy links, birth dates, chains."""
    sources, identity = cleaning.resolve_entities(list(_people(spark, d)), 0.88, cleaning.edit_similarity)
    known = sources[0].select("player_id", "full_name", "draft_year").unionByName(sources[1].select("player_id", "full_name", "draft_year"))
    spellings = known.groupBy("player_id").agg(F.count_distinct(names.name_match_key(F.col("full_name"))).alias("spellings"))
    return identity.select("player_id", "draft_year", "birthdate").join(spellings, "player_id")


@query(f"{WITH_SEASONS} select player_id, season_year, usage, usage is null as usage_imputed, -minutes as agility_score, -pts_per100 as leanness, ast_per100 as explosiveness from seasons")
def flags_and_measures(spark, d):
    rows = b.seasons(spark, d).withColumns({"lane_agility_s": F.col("minutes"), "body_fat_pct": F.col("pts_per100"), "max_vertical_in": F.col("ast_per100")})
    return cleaning.missing_flags(features.combine(rows), ["usage"]).select("player_id", "season_year", "usage", "usage_imputed", "agility_score", "leanness", "explosiveness")


# --- models, fit

_TWO = """m as (select count(*) as n, avg(minutes) as m1, avg(true_shooting) as m2, avg(ebpm) as my, stddev_pop(minutes) as s1, stddev_pop(true_shooting) as s2, covar_pop(minutes, true_shooting) as c12, covar_pop(minutes, ebpm) as c1, covar_pop(true_shooting, ebpm) as c2 from impact),
w as (select *, n + 10.0::double as a, n * c12 / (s1 * s2) as o, n * c1 / s1 as b1, n * c2 / s2 as b2 from m), v as (select *, (a * b1 - o * b2) / (a * a - o * o) / s1 as w1, (a * b2 - o * b1) / (a * a - o * o) / s2 as w2 from w)"""


@query(f"{WITH_IMPACT}, {_TWO} select player_id, season_year, round(my + w1 * (minutes - m1) + w2 * (true_shooting - m2), 5) as prediction, round(w1 * (minutes - m1), 5) as shap_minutes, round(w2 * (true_shooting - m2), 5) as shap_true_shooting from impact cross join v")
def ridge_two_features(spark, d):
    """Ridge and its Shapley values with correlated features."""
    from plumbline.operators.explain import LinearShap

    rows = b.impact(spark, d)
    model = models.ridge(rows, ["minutes", "true_shooting"], "ebpm", 10.0)
    got = LinearShap(model, rows).local(model.transform(rows))
    return got.select("player_id", "season_year", _r("prediction", 5), _r("shap_minutes", 5), _r("shap_true_shooting", 5))


_CDF = "(0.5::double * (1 + (case when {z} < 0 then -1 else 1 end) * (1 - (((((1.061405429::double * {t} - 1.453152027::double) * {t}) + 1.421413741::double) * {t} - 0.284496736::double) * {t} + 0.254829592::double) * {t} * exp(-{z} * {z}))))"
_EDGES = (-2.0, 0.0, 3.0, 6.0)
_ZS = ", ".join(f"({e}::double - ebpm) / 1.5::double / sqrt(2.0::double) as z{i}" for i, e in enumerate(_EDGES))
_TS = ", ".join(f"1 / (1 + 0.3275911::double * abs(z{i})) as t{i}" for i in range(4))
_FS = ", ".join(_CDF.format(z=f"z{i}", t=f"t{i}") + f" as f{i}" for i in range(4))


@query(f"{WITH_IMPACT}, z as (select player_id, season_year, {_ZS} from impact), t as (select *, {_TS} from z), f as (select player_id, season_year, {_FS} from t) select player_id, season_year, round(f0, 4) as p_bust, round(f1 - f0, 4) as p_rotation, round(f2 - f1, 4) as p_starter, round(f3 - f2, 4) as p_all_star, round(1 - f3, 4) as p_superstar from f")
def normal_tiers(spark, d):
    rows = b.impact(spark, d)
    return rows.select("player_id", "season_year", *(c.alias(k) for k, c in uncertainty.tiers_from_normal(F.col("ebpm"), F.lit(1.5)).items()))


_CLIP = "least(100.0::double, greatest(0.0::double, ({x} - {lo}) / {span}::double * 100.0::double))"


@query(f"{WITH_SEASONS} select player_id, season_year, round({_CLIP.format(x='pts_per100', lo='2.0::double', span='24')}, 9) as scoring, round({_CLIP.format(x='true_shooting', lo='0.45::double', span='(0.65::double - 0.45::double)')}, 9) as shooting_spacing, round({_CLIP.format(x='ast_per100', lo='0.0::double', span='9')}, 9) as playmaking, round({_CLIP.format(x='reb_per100', lo='1.0::double', span='13')}, 9) as rebounding, 25.0::double as rim_protection, 50.0::double as perimeter_defense from seasons")
def prospect_skills(spark, d):
    got = team_fit.skills(b.seasons(spark, d))
    return got.select("player_id", "season_year", *(F.round(s, 9).alias(s) for s in team_fit.SKILLS))


_WEAKEST = "five as (select *, row_number() over (partition by team_id order by impact, name) as w from (select *, row_number() over (partition by team_id order by impact desc, name) as k from players) where k <= 5)"


@query(f"with {_PLAYERS_SQL}, {_WEAKEST} select p.player_id, f.team_id, f.name as replaced from players p cross join five f where w = 1")
def lineup_upgrades(spark, d):
    """Every player in every team's lineup, in the weakest's place."""
    p = _players(spark, d)
    pool = p.select("player_id", "impact", "shooting_spacing", "rim_protection")
    return team_fit.lineup_upgrade(pool, team_fit.lineups(p)).select("player_id", "team_id", "replaced")


@query(f"""{WITH_LABELS} select player_id, draft_year, coalesce(all_star_count, 0)::bigint as all_star_count, coalesce(all_nba_count, 0)::bigint as all_nba_count, outcome_tier from labels_ left join honors using (player_id)""")
def honours(spark, d):
    """Counts of honours, those of players without any as nulls at first."""
    held = b.draft(spark, d).select("player_id").join(b.honors(spark, d), "player_id", "left")
    return b.labels(spark, d).select("player_id", "draft_year", "outcome_tier").join(labels.honors_from_frame(held), "player_id")
