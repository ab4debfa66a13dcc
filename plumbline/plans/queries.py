"""Registered queries of the ranking engine, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import names
from plumbline.functions.expressions import TIERS, normal_cdf
from plumbline.operators import board, cleaning, clusters, eda, explain, features, labels, metrics, mlops, models, ordered, paths, survival, team_fit, temporal, uncertainty
from plumbline.plans import binding as b
from plumbline.plans.registry import query, table
from plumbline.sources import parse

WITH_SEASONS = f"with {b.DRAFT_SQL}, {b.SEASONS_SQL}"
WITH_IMPACT = f"{WITH_SEASONS}, {b.IMPACT_SQL}"
WITH_LABELS = f"{WITH_IMPACT}, {b.HONORS_SQL}, {b.LABELS_SQL}"
WITH_PRED = f"with {b.PREDICTIONS_SQL}"


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


# --- labels and the board


@query(f"""{WITH_LABELS}, v as (select l.*, d.full_name, d.draft_pick, case when reached and peak_impact is not null then round(peak_impact, 4) else -2.0::double end as value from labels_ l join draft d using (player_id))
select row_number() over (order by value desc, player_id)::bigint as board_rank, player_id, full_name, draft_year, draft_pick, outcome_tier, value, round(cumulative_value, 4) as cumulative_value from v where resolved""")
def ranked_board(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: seasons to impact to labels to a board by realised value."""
    rows = b.labels(spark, d).where("resolved").join(b.picks(spark, d).select("player_id", "full_name", "draft_pick"), "player_id")
    rows = rows.withColumn("value", labels.realized_value(F.round("peak_impact", 4), F.col("reached")))
    rows = rows.select("player_id", "full_name", "draft_year", "draft_pick", "outcome_tier", "value", _r("cumulative_value", 4))
    rows = rows.cache()  # cut, counted and numbered
    return ordered.numbered(rows, [], -F.col("value"), ["player_id"], "board_rank").select("board_rank", *rows.columns)


@query(f"{WITH_IMPACT} select player_id, season_year, minutes, ebpm, vorp from impact")
def impact_metrics(spark, d):
    return b.impact(spark, d).select("player_id", "season_year", "minutes", "ebpm", "vorp")


@query(f"{WITH_LABELS} select player_id, draft_year, debut_year, reached, round(peak_impact, 6) as peak_impact, round(cumulative_value, 6) as cumulative_value, outcome_tier, resolved, career_seasons, career_ended from labels_")
def outcome_labels(spark, d):
    return b.labels(spark, d).select("player_id", "draft_year", "debut_year", "reached", _r("peak_impact"), _r("cumulative_value"), "outcome_tier", "resolved", "career_seasons", "career_ended")


@query(f"{WITH_LABELS} select outcome_tier, count(*)::bigint as n, avg(cumulative_value)::decimal(18,4)::double as mean_value from labels_ where resolved group by 1")
def tier_summary(spark, d):
    return b.labels(spark, d).where("resolved").groupBy("outcome_tier").agg(F.count(F.lit(1)).alias("n"), F.avg("cumulative_value").cast("decimal(18,4)").cast("double").alias("mean_value"))


@query(f"{WITH_LABELS} select player_id, round(0.25::double * coalesce(peak_impact, -2.0) + 0.75::double * -2.0, 6) as expected_value from labels_")
def unconditional_value(spark, d):
    return b.labels(spark, d).select("player_id", F.round(labels.unconditional_value(F.lit(0.25), F.coalesce("peak_impact", F.lit(-2.0))), 6).alias("expected_value"))


@query(f"{WITH_IMPACT}, r as (select rank() over (order by ebpm) + (count(*) over (partition by ebpm) - 1) / 2.0 as a, rank() over (order by pts_per100) + (count(*) over (partition by pts_per100) - 1) / 2.0 as c from impact) select round(corr(a, c), 6) as rho from r")
def impact_rank_agreement(spark, d):
    return labels.rank_agreement(b.impact(spark, d), "ebpm", "pts_per100").select(_r("rho"))


# --- features


@query(f"""{WITH_SEASONS}, x as (select *, pts_per100 + ast_per100 + reb_per100 + 1e-9::double as t from seasons)
select player_id, season_year, round(1 - (pts_per100 / t) * (pts_per100 / t) - (ast_per100 / t) * (ast_per100 / t) - (reb_per100 / t) * (reb_per100 / t), 6) as versatility, round(ast_per100 / (pts_per100 + ast_per100 + 1e-9::double), 6) as playmaking_share, round(pts_per100 / t, 6) as scoring_share from x""")
def stateless_features(spark, d):
    return features.stateless(b.seasons(spark, d)).select("player_id", "season_year", _r("versatility"), _r("playmaking_share"), _r("scoring_share"))


@query(f"""{WITH_SEASONS}, x as (select player_id, season_year, strength_of_schedule - lag(strength_of_schedule) over w as sos_jump, true_shooting - lag(true_shooting) over w as ts_change, usage - lag(usage) over w as usage_change, pts_per100 - lag(pts_per100) over w as pts_change,
 count(*) over (partition by player_id) as n, row_number() over (partition by player_id order by season_year desc) as k from seasons window w as (partition by player_id order by season_year))
select player_id, round(sos_jump, 6) as sos_jump, round(usage_change, 6) as usage_change, round(ts_change, 6) as ts_change, round(pts_change, 6) as pts_change, case when sos_jump is not null and ts_change is not null then sos_jump > 0 and ts_change >= 0 end as efficiency_held_up, n::bigint as n_pre_draft_seasons from x where k = 1""")
def sequence_features(spark, d):
    got = features.sequences(b.seasons(spark, d), season="season_year")
    return got.select("player_id", *(_r(c) for c in ("sos_jump", "usage_change", "ts_change", "pts_change")), "efficiency_held_up", "n_pre_draft_seasons")


@query(f"{WITH_SEASONS} select player_id, season_year, minutes from (select *, row_number() over (partition by player_id order by season_year desc) as k from seasons) where k = 1")
def primary_season(spark, d):
    return features.primary_season(b.seasons(spark, d), season="season_year").select("player_id", "season_year", "minutes")


@query(f"""{WITH_SEASONS}, x as (select s.*, d.league_id, d.draft_year from seasons s join draft d using (player_id)), tr as (select * from x where season_year < 1999),
m as (select league_id, avg(pts_per100) as m, stddev_samp(pts_per100) as s from tr group by 1), ref as (select avg(pts_per100) as m, stddev_samp(pts_per100) as s from tr where league_id = 'BUILDING'), al as (select avg(pts_per100) as m, stddev_samp(pts_per100) as s, avg(strength_of_schedule) as zm, stddev_samp(strength_of_schedule) as zs from tr),
z as (select league_id, season_year, avg(strength_of_schedule) as m, stddev_samp(strength_of_schedule) as s from tr group by 1, 2)
select x.player_id, x.season_year, case when league_id = 'BUILDING' then x.pts_per100 else (x.pts_per100 - coalesce(m.m, al.m)) / (case when m.s > 0 then m.s else al.s end) * ref.s + ref.m end as pts_per100_translated,
 (x.strength_of_schedule - coalesce(z.m, al.zm)) / (case when z.s > 0 then z.s else al.zs end) as sos_z from x left join m using (league_id) left join z on z.league_id = x.league_id and z.season_year = x.season_year cross join ref cross join al""")
def league_context(spark, d):
    rows = b.seasons(spark, d).join(b.draft(spark, d).select("player_id", "league_id", "draft_year"), "player_id")
    model = features.LeagueContext(["pts_per100"], "BUILDING", season="season_year").fit(rows.where("season_year < 1999"))
    return model.transform(rows).select("player_id", "season_year", "pts_per100_translated", "sos_z")


@query("""with a as (select c_custkey as player_id, 1993 + c_custkey % 6 as y, strftime(make_date(1970 + (c_custkey % 20)::int, 1 + (c_custkey % 12)::int, 1 + (c_custkey % 28)::int), '%Y-%m-%d') as bd from customer)
select player_id, round(date_diff('day', bd::date, make_date(y::int, 6, 26)) / 365.25::double, 2) as age from a""")
def age_at_draft(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("player_id"))
    birth = F.make_date((1970 + F.col("player_id") % 20).cast("int"), (1 + F.col("player_id") % 12).cast("int"), (1 + F.col("player_id") % 28).cast("int")).cast("string")
    return c.select("player_id", features.age_at_draft(birth, 1993 + F.col("player_id") % 6).alias("age"))


@query(f"""{WITH_SEASONS}, c as (select p_partkey, p_name, 1993 + p_partkey % 6 as season, p_partkey % 25 as school, p_retailprice as v from part), d0 as (select d.player_id, d.draft_year, d.organization, p.p_name as full_name from draft d join part p on p.p_partkey = d.player_id % 1000),
j as (select d0.player_id, c.v, row_number() over (partition by d0.player_id order by case when c.school = d0.organization then 0 else 1 end, c.v) as k from d0 left join c on c.p_name = d0.full_name and c.season = d0.draft_year) select player_id, v as linked_value from j where k = 1""")
def college_link(spark, d):
    """A name-and-season link, the same organisation first; the least value of a name is found before players meet it."""
    part = table(spark, d, "part")
    c = part.select(F.col("p_name").alias("name"), (F.lit(1993) + F.col("p_partkey") % 6).alias("draft_year"), (F.col("p_partkey") % 25).alias("organization"), F.col("p_retailprice").alias("v"))
    own = c.groupBy("name", "draft_year", "organization").agg(F.min("v").alias("own"), F.lit(0).alias("far"))
    every = c.groupBy("name", "draft_year").agg(F.min("v").alias("v"))
    named = part.select(F.col("p_partkey").alias("_k"), F.col("p_name").alias("name"))
    d0 = b.draft(spark, d).join(named, F.col("player_id") % 1000 == F.col("_k"))
    j = d0.join(own, ["name", "draft_year", "organization"], "left").join(every, ["name", "draft_year"], "left")
    v = F.when(F.col("far") == 0, F.col("own")).otherwise(F.col("v"))
    first = F.min(F.struct(F.coalesce("far", F.lit(1)).alias("far"), v.isNull().alias("none"), v.alias("v")))
    return j.groupBy("player_id").agg(first["v"].alias("linked_value"))


# --- metrics and exploration

RANKS = "rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0"


@query(f"{WITH_PRED}, r as (select {RANKS.format('p')} as a, {RANKS.format('y')} as c from pred) select round(corr(a, c), 6) as rho from r")
def spearman(spark, d):
    return metrics.spearman(b.predictions(spark, d), "p", "y").select(_r("rho"))


@query(f"{WITH_PRED}, x as (select row_number() over (order by doc_id) as i, p, size from pred), n as (select count(*) as n from x) select round(sum(sign(v.p - u.p) * sign(v.size - u.size)) / (max(n) * (max(n) - 1) / 2.0), 6) as tau from x u join x v on u.i < v.i cross join n")
def kendall(spark, d):
    return metrics.kendall(b.predictions(spark, d), "p", "size", "doc_id").select(_r("tau"))


@query(f"{WITH_PRED}, a as (select doc_id from pred order by size desc, doc_id limit 50), c as (select doc_id from pred order by p desc, doc_id limit 50) select round(count(*) / least(50, (select count(*) from pred))::double, 6) as hit_rate from a join c using (doc_id)")
def top_k_hit_rate(spark, d):
    return metrics.top_k_hit_rate(b.predictions(spark, d), "size", "p", "doc_id", 50).select(_r("hit_rate"))


@query(f"{WITH_PRED} select round(sqrt(avg((y - p) * (y - p))), 6) as rmse, round(avg((p - y) * (p - y)), 6) as brier, round(avg(case when y between p - 0.5 and p + 0.5 then 1.0::double else 0.0 end), 6) as coverage from pred")
def error_metrics(spark, d):
    y, p = F.col("y"), F.col("p")
    return b.predictions(spark, d).agg(F.round(metrics.rmse(y, p), 6).alias("rmse"), F.round(metrics.brier(p, y), 6).alias("brier"), F.round(metrics.interval_coverage(y, p - 0.5, p + 0.5), 6).alias("coverage"))


_BINS = "case " + " ".join(f"when p <= {i / 10!r}::double then {i - 1}" for i in range(1, 10)) + " else 9 end"


@query(f"{WITH_PRED}, g as (select {_BINS} as bin, count(*) as n, avg(p) as mp, avg(y) as my from pred group by 1) select r.range::int as bin, round(r.range / 10.0::double, 6) as lo, round((r.range + 1) / 10.0::double, 6) as hi, coalesce(n, 0)::bigint as n, round(mp, 6) as mean_p, round(my, 6) as mean_y from range(10) r left join g on g.bin = r.range")
def calibration(spark, d):
    t = metrics.calibration_table(b.predictions(spark, d), "p", "y")
    return t.select("bin", _r("lo"), _r("hi"), "n", _r("mean_p"), _r("mean_y"))


@query(f"{WITH_PRED}, g as (select {_BINS} as bin, count(*) as n, avg(p) as mp, avg(y) as my from pred group by 1) select round(sum(n * abs(my - mp)) / sum(n), 6) as ece from g")
def calibration_error(spark, d):
    return metrics.calibration_error(b.predictions(spark, d), "p", "y").select(_r("ece"))


@query(f"{WITH_PRED} select lang, count(*)::bigint as n, round(avg(p - y), 6) as bias, round(avg(abs(p - y)), 6) as mae, round(sqrt(avg((p - y) * (p - y))), 6) as rmse from pred group by 1")
def residual_segments(spark, d):
    return metrics.residual_segments(b.predictions(spark, d), "lang", "y", "p").select("lang", "n", _r("bias"), _r("mae"), _r("rmse"))


@query(f"{WITH_PRED} select doc_id, round(p - y, 6) as residual from pred order by abs(p - y) desc, doc_id limit 20")
def largest_errors(spark, d):
    return metrics.largest_errors(b.predictions(spark, d), "y", "p", 20, "doc_id").select("doc_id", _r("residual"))


def _concordance_rows(spark, d):
    return b.labels(spark, d).where("career_seasons >= 1").select((F.col("career_seasons")).cast("double").alias("t"), F.col("career_ended").cast("int").alias("e"), F.round("cumulative_value", 3).alias("risk"))


@query(f"{WITH_LABELS}, v as (select career_seasons::double as t, career_ended::int as e, round(cumulative_value, 3) as risk, count(*)::double as n from labels_ where career_seasons >= 1 group by 1, 2, 3) select round(sum(u.n * v.n * case when u.risk > v.risk then 1.0 when u.risk = v.risk then 0.5 else 0.0 end) / sum(u.n * v.n), 6) as c_index from v u join v on u.e = 1 and (u.t < v.t or (u.t = v.t and v.e = 0))")
def concordance(spark, d):
    return metrics.concordance(_concordance_rows(spark, d), "t", "e", "risk").select(_r("c_index"))


_NUM = "select '{0}' as feature, count(*)::bigint as n, round(avg(case when {0} is null then 1.0::double else 0.0 end), 6) as missing, round(avg({0}), 6) as mean, round(stddev_samp({0}), 6) as sd, round(min({0}), 6) as min, round(quantile_cont({0}, 0.25), 6) as q25, round(quantile_cont({0}, 0.5), 6) as median, round(quantile_cont({0}, 0.75), 6) as q75, round(max({0}), 6) as max from seasons"


@query(f"{WITH_SEASONS} " + " union all ".join(_NUM.format(c) for c in ("pts_per100", "usage", "true_shooting")))
def numeric_summary(spark, d):
    s = eda.numeric_summary(b.seasons(spark, d), ["pts_per100", "usage", "true_shooting"])
    return s.select("feature", "n", *(_r(c) for c in s.columns[2:]))


@query(f"{WITH_SEASONS} select league_id, round(avg(case when usage is null then 1.0::double else 0.0 end), 6) as usage from seasons join draft using (player_id) group by 1")
def missingness(spark, d):
    rows = b.seasons(spark, d).join(b.draft(spark, d).select("player_id", "league_id"), "player_id")
    return eda.missingness_by_group(rows, "league_id", ["usage"]).select("league_id", _r("usage"))


@query(f"{WITH_SEASONS}, r as (select {RANKS.format('pts_per100')} as a, {RANKS.format('stl_per100')} as c from seasons) select 'pts_per100' as a, 'stl_per100' as b, round(corr(a, c), 4) as rho from r union all select 'pts_per100', 'pts_per100', 1.0 union all select 'stl_per100', 'stl_per100', 1.0")
def correlation_matrix(spark, d):
    return eda.correlation_matrix(b.seasons(spark, d), ["pts_per100", "stl_per100"])


@query(f"{WITH_IMPACT}, r as (select {RANKS.format('true_shooting')} as a, {RANKS.format('minutes')} as m, {RANKS.format('ebpm')} as c from impact) select 'true_shooting' as feature, round(corr(a, c), 6) as rho from r union all select 'minutes', round(corr(m, c), 6) from r")
def feature_target(spark, d):
    return eda.feature_target(b.impact(spark, d), ["true_shooting", "minutes"], "ebpm").select("feature", _r("rho"))


_BAND = "case when ebpm < -2 then 'bust' when ebpm < 0 then 'rotation' when ebpm < 3 then 'starter' when ebpm < 6 then 'all_star' else 'superstar' end"


@query(f"{WITH_IMPACT}, gb as (select {_BAND} as band, count(*) as n from impact group by 1) select t.band, coalesce(n, 0)::bigint as n, round(coalesce(n, 0) / (select count(*) from impact)::double, 6) as base_rate from (values ('bust'), ('rotation'), ('starter'), ('all_star'), ('superstar')) t(band) left join gb using (band)")
def band_counts(spark, d):
    rows = eda.with_bands(b.impact(spark, d).select("ebpm"), "ebpm", [-2.0, 0.0, 3.0, 6.0], TIERS)
    return eda.band_counts(rows, order=TIERS).select("band", "n", _r("base_rate"))


@query(f"{WITH_IMPACT} select league_id, count(*)::bigint as n, round(avg(ebpm), 5) as mean_target, round(median(ebpm), 6) as median_target from impact join draft using (player_id) group by 1")
def grouped_target(spark, d):
    rows = b.impact(spark, d).join(b.draft(spark, d).select("player_id", "league_id"), "player_id")
    return eda.grouped_target(rows, "league_id", "ebpm").select("league_id", "n", _r("mean_target", 5), _r("median_target"))


@query(f"{WITH_IMPACT}, e as (select " + ", ".join(f"quantile_cont(minutes, {i / 5}) as e{i}" for i in range(6)) + " from impact), k as (select ebpm, case " + " ".join(f"when minutes < e{i} then {i - 1}" for i in range(1, 5)) + " else 4 end as bin from impact cross join e) select bin::int as bin, count(*)::bigint as n, round(avg(ebpm), 5) as mean_target from k group by 1")
def binned_relationship(spark, d):
    return eda.binned_relationship(b.impact(spark, d), "minutes", "ebpm", 5).select("bin", "n", _r("mean_target", 5))


@query("with e as (select min(value) as lo, max(value) as hi from events), k as (select least(floor((value - lo) / ((hi - lo) / 20)), 19)::int as bin from events, e) select r.range::int as bin, coalesce(n, 0)::bigint as n from range(20) r left join (select bin, count(*) as n from k group by 1) g on g.bin = r.range")
def histogram(spark, d):
    return eda.histogram(table(spark, d, "events"), "value").select("bin", "n")


@query("with e as (select " + ", ".join(f"quantile_cont(value, {i / 10}) filter (where event_id % 2 = 0) as e{i}" for i in range(1, 10)) + " from events), k as (select event_id % 2 as cur, case " + " ".join(f"when value < e{i} then {i - 1}" for i in range(1, 10)) + " else 9 end as bin from events, e), p as (select bin, count(*) filter (where cur = 0) / (select count(*) from k where cur = 0)::double as r, count(*) filter (where cur = 1) / (select count(*) from k where cur = 1)::double as c from k group by 1) select 'value' as feature, round(sum((greatest(c, 1e-6::double) - greatest(r, 1e-6::double)) * ln(greatest(c, 1e-6::double) / greatest(r, 1e-6::double))), 4) as psi, sum((greatest(c, 1e-6::double) - greatest(r, 1e-6::double)) * ln(greatest(c, 1e-6::double) / greatest(r, 1e-6::double))) > 0.25 as drifted from p")
def drift_report(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return mlops.drift_report(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["value"])


# --- cleaning, names, parsing


@query("select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(p_name || ' É ' || p_type || '-Jr.')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'), '( (jr|sr|ii|iii|iv|v)) *$', '')) as match_key from part")
def name_keys(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", names.name_match_key(F.concat("p_name", F.lit(" É "), "p_type", F.lit("-Jr."))).alias("match_key"))


@query("with k as (select distinct p_name as key, p_brand as y from part) select 'p_' || substr(sha1(key || '|' || y), 1, 12) as player_id, key, y from k")
def player_ids(spark, d):
    k = table(spark, d, "part").select(F.col("p_name").alias("key"), F.col("p_brand").alias("y")).distinct()
    return k.select(cleaning.player_id(F.col("key"), F.col("y")).alias("player_id"), "key", "y")


@query("with k as (select distinct p_name as key, p_brand as y from part) select u.y, u.key as a, v.key as b from k u join k v on u.y = v.y and u.key < v.key and 1.0::double - levenshtein(u.key, v.key) / greatest(length(u.key), length(v.key))::double >= 0.75")
def fuzzy_pairs(spark, d):
    """Pairs of a block by edit similarity, found by the rarest grams of their names."""
    k = table(spark, d, "part").select(F.col("p_name").alias("match_key"), F.col("p_brand").alias("draft_year")).distinct().withColumns({"entity": F.concat_ws("|", "match_key", "draft_year"), "birthdate": F.lit(None).cast("string")})
    links = cleaning.fuzzy_links(k, 0.75, cleaning.edit_similarity)
    part = lambda c, i: F.substring_index(c, "|", i)
    return links.select(part("a", -1).alias("y"), part("a", 1).alias("a"), part("b", 1).alias("b"))


@query(f"""{WITH_SEASONS}, x as (select s.*, d.league_id from seasons s join draft d using (player_id)), tr as (select * from x where season_year < 1999), m as (select league_id, avg(usage) as m, stddev_samp(usage) as s from tr group by 1), al as (select avg(usage) as m from tr)
select player_id, season_year, round(coalesce(usage, m.m, al.m), 6) as usage, usage is null as usage_imputed, round(case when usage is null then m.s else 0.0 end, 6) as usage_impute_sd from x left join m using (league_id) cross join al""")
def imputed(spark, d):
    rows = b.seasons(spark, d).join(b.draft(spark, d).select("player_id", "league_id"), "player_id")
    got = cleaning.Imputer(["usage"], "league_id").fit(rows.where("season_year < 1999")).transform(rows)
    return got.select("player_id", "season_year", _r("usage"), "usage_imputed", _r("usage_impute_sd"))


@query(f"{WITH_SEASONS} select player_id, season_year, round(coalesce(usage, (select median(usage) from seasons where season_year < 1999)), 6) as usage from seasons")
def median_backfill(spark, d):
    rows = b.seasons(spark, d)
    return cleaning.Preprocessor(["usage"]).fit(rows.where("season_year < 1999")).transform(rows).select("player_id", "season_year", _r("usage"))


@query("select event_id, json_extract_string(props, '$.k')::bigint as k, lower(event_type) as kind from events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.lower("event_type").alias("kind"))


@query("select user_id, count(*) filter (where event_type = 'purchase')::bigint as all_star_count, count(*) filter (where event_type = 'signup')::bigint as all_nba_count from events group by 1")
def award_counts(spark, d):
    """Result-set payloads built from events, parsed again and counted."""
    text = F.when(F.col("event_type") == "purchase", "NBA All-Star").when(F.col("event_type") == "signup", "All-NBA Team").otherwise("Player of the Week")
    rows = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.array(text)).alias("rows"))
    raw = rows.select("user_id", F.to_json(F.struct(F.array(F.struct(F.array(F.lit("DESCRIPTION")).alias("headers"), F.col("rows").alias("rowSet"))).alias("resultSets"))).alias("value"))
    return parse.player_awards(raw, "user_id")


# --- temporal validation, models, uncertainty


@query(f"{WITH_LABELS}, y as (select distinct draft_year from labels_), o as (select draft_year, row_number() over (order by draft_year desc) as k from y) select draft_year, count(*)::bigint as n, max(k) <= 2 as held_out from labels_ join o using (draft_year) group by 1")
def holdout_split(spark, d):
    dev, held = temporal.holdout(b.labels(spark, d), 2)
    both = dev.withColumn("held_out", F.lit(False)).union(held.withColumn("held_out", F.lit(True)))
    return both.groupBy("draft_year", "held_out").agg(F.count(F.lit(1)).alias("n")).select("draft_year", "n", "held_out")


@query(f"""{WITH_LABELS}, x as (select draft_year, cumulative_value as y from labels_), f as (select range as k, 1997 + range as val from range(2))
select f.k::int as fold, count(*)::bigint as n, round(sqrt(avg(power(v.y - t.m, 2))), 5) as rmse from f join (select k, avg(y) as m from f join x on x.draft_year < f.val group by 1) t using (k) join x v on v.draft_year = f.val group by 1""")
def walk_forward(spark, d):
    rows = b.labels(spark, d).cache()
    folds = temporal.walk_forward(temporal.years_of(rows), 4)
    got = temporal.predictions(rows, folds, lambda train: models.mean_model(train, "cumulative_value"))
    return got.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(metrics.rmse(F.col("cumulative_value"), F.col("prediction")), 5).alias("rmse"))


@query(f"{WITH_LABELS}, x as (select l.peak_impact as y, ln(d.draft_pick::double) as p from labels_ l join draft d using (player_id) where peak_impact is not null) select round(regr_slope(y, p), 6) as slope, round(regr_intercept(y, p), 6) as intercept from x")
def draft_position_baseline(spark, d):
    rows = b.labels(spark, d).join(b.picks(spark, d).select("player_id", "draft_pick"), "player_id").where("peak_impact is not null")
    m = models.DraftPosition().fit(rows, "peak_impact")
    return spark.createDataFrame([(round(m.slope, 6), round(m.intercept, 6))], "slope double, intercept double")


@query(f"{WITH_IMPACT}, m as (select avg(minutes) as mx, stddev_pop(minutes) as sx, avg(ebpm) as my, count(*) as n, covar_pop(minutes, ebpm) as c from impact), w as (select *, (n * c / sx) / (n + 10.0) / sx as w from m) select player_id, season_year, round(my + w * (minutes - mx), 5) as prediction from impact cross join w")
def ridge_regression(spark, d):
    rows = b.impact(spark, d)
    return models.ridge(rows, ["minutes"], "ebpm", 10.0).transform(rows).select("player_id", "season_year", _r("prediction", 5))


@query(f"{WITH_IMPACT}, m as (select avg(minutes) as mx, stddev_pop(minutes) as sx, avg(ebpm) as my, count(*) as n, covar_pop(minutes, ebpm) as c from impact), w as (select *, (n * c / sx) / (n + 10.0) / sx as w from m) select player_id, season_year, round(my, 5) as shap_base, round(w * (minutes - mx), 5) as shap_minutes from impact cross join w")
def linear_shap(spark, d):
    rows = b.impact(spark, d)
    got = explain.LinearShap(models.ridge(rows, ["minutes"], "ebpm", 10.0), rows).local(rows)
    return got.select("player_id", "season_year", _r("shap_base", 5), _r("shap_minutes", 5))


@query(f"{WITH_IMPACT}, m as (select avg(minutes) as mx, stddev_pop(minutes) as sx, avg(ebpm) as my, count(*) as n, covar_pop(minutes, ebpm) as c from impact), w as (select *, (n * c / sx) / (n + 10.0) / sx as w from m) select v::double as value, round(my + w * (v - mx), 5) as mean_prediction from w cross join (values (500), (1000), (2000)) t(v)")
def partial_dependence(spark, d):
    rows = b.impact(spark, d)
    model = models.ridge(rows, ["minutes"], "ebpm", 10.0)
    return explain.partial_dependence(rows, explain.linear_expression(model), "minutes", grid=[500, 1000, 2000]).select("value", _r("mean_prediction", 5))


_ERF = "(case when z < 0 then -1 else 1 end) * (1 - (((((1.061405429::double * t - 1.453152027::double) * t) + 1.421413741::double) * t - 0.284496736::double) * t + 0.254829592::double) * t * exp(-z * z))"


@query(f"with x as (select event_id, (value - 50.0::double) / 20.0::double / sqrt(2.0::double) as z from events), y as (select *, 1 / (1 + 0.3275911::double * abs(z)) as t from x) select event_id, round(0.5::double * (1 + {_ERF}), 6) as p from y")
def normal_distribution(spark, d):
    return table(spark, d, "events").select("event_id", F.round(normal_cdf(F.col("value"), F.lit(50.0), F.lit(20.0)), 6).alias("p"))


_SAMPLES = "list_transform(range(10), lambda i: round(ebpm + (i - 4.5::double), 3))"


def _share_sql(lo, hi):
    return f"round(len(list_filter(s, lambda x: x >= {lo} and x < {hi})) / 10.0::double, 4)"


@query(f"{WITH_IMPACT}, x as (select player_id, season_year, {_SAMPLES} as s from impact) select player_id, season_year, {_share_sql(-1e9, -2)} as p_bust, {_share_sql(-2, 0)} as p_rotation, {_share_sql(0, 3)} as p_starter, {_share_sql(3, 6)} as p_all_star, {_share_sql(6, 1e9)} as p_superstar, round(list_sort(s)[1] + 0.9::double * (list_sort(s)[2] - list_sort(s)[1]), 6) as floor, round(list_sort(s)[9] + 0.1::double * (list_sort(s)[10] - list_sort(s)[9]), 6) as ceiling from x")
def scenario_tiers(spark, d):
    s = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.round(F.col("ebpm") + (i - F.lit(4.5)), 3))
    rows = b.impact(spark, d).select("player_id", "season_year", s.alias("s"))
    low, high = uncertainty.floor_ceiling(F.col("s"))
    return rows.withColumns(uncertainty.tiers_from_samples(F.col("s")) | {"floor": F.round(low, 6), "ceiling": F.round(high, 6)}).drop("s")


# --- team fit and finance


@query("""with p as (select c_custkey as player_id, 1 + c_custkey % 60 as pick, c_acctbal / 2000.0::double as vorp from customer), t as (select [13825920, 12370200, 11108880, 9069840, 8237640, 7520040, 6889200, 6332520, 6016080, 5715120, 5429520, 5163480, 4914840, 4682640] as s),
f as (select player_id, pick, vorp, case when pick <= 14 then s[pick]::double else 4682640.0::double * power(0.93::double, pick - 14) end as first from p, t)
select player_id, round(round(vorp * 2.7::double * 3500000.0::double * 4, 2) - round(first * (1 + 1.05::double + 1.1025::double + 1.157625::double), 2), 0) as rsv_usd from f""")
def surplus_value(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("player_id"), (1 + F.col("c_custkey") % 60).alias("pick"), (F.col("c_acctbal") / 2000.0).alias("vorp"))
    return c.select("player_id", F.round(team_fit.real_surplus(F.col("vorp"), F.col("pick"), team_fit.load_cap()), 0).alias("rsv_usd"))


@query("select s_suppkey as team_id, case when s >= 222000000 then 1.5 when s >= 209000000 then 1.3 when s >= 201000000 then 1.15 else 1.0 end::double as multiplier, case when s >= 222000000 then 'above second apron' when s >= 209000000 then 'above first apron' when s >= 201000000 then 'above tax' else 'below tax' end as label from (select s_suppkey, 195000000 + s_acctbal * 3500 as s from supplier)")
def apron_pressure(spark, d):
    times, label = team_fit.apron(195_000_000 + F.col("s_acctbal") * 3500, team_fit.load_cap())
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("team_id"), times.alias("multiplier"), label.alias("label"))




def _players(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("player_id"), (F.col("c_custkey") % 25).alias("team_id"), F.col("c_name").alias("name"), F.round(F.col("c_acctbal") / 1000.0, 3).alias("impact"))
    return rows.withColumns({s: ((F.col("player_id") * k) % 101).cast("double") for s, k in zip(team_fit.SKILLS, (7, 13, 29, 31, 37, 41), strict=True)})


_PLAYERS_SQL = "players as (select c_custkey as player_id, c_custkey % 25 as team_id, c_name as name, round(c_acctbal / 1000.0::double, 3) as impact, " + ", ".join(f"((c_custkey * {k}) % 101)::double as {s}" for s, k in zip(team_fit.SKILLS, (7, 13, 29, 31, 37, 41), strict=True)) + " from customer)"
_LONG_SQL = "long as (" + " union all ".join(f"select team_id, '{s}' as skill, {s} as level from players" for s in team_fit.SKILLS) + "), top as (select *, row_number() over (partition by team_id, skill order by level desc) as k from long), supply as (select team_id, skill, avg(level) as supply from top where k <= 2 group by 1, 2)"


@query(f"with {_PLAYERS_SQL}, {_LONG_SQL} select team_id, skill, round(supply, 4) as supply, round(greatest(0, 60 - supply), 4) as need, round(greatest(0, supply - 60), 4) as surplus from supply")
def functional_need(spark, d):
    return team_fit.team_supply(_players(spark, d)).select("team_id", "skill", _r("supply", 4), _r("need", 4), _r("surplus", 4))


@query(f"with {_PLAYERS_SQL}, five as (select * from (select *, row_number() over (partition by team_id order by impact desc, name) as k from players) where k <= 5) select team_id, round(sum(impact) + 0.06::double * (avg(shooting_spacing) - 55) + 0.05::double * (max(rim_protection) - 50), 2) as net_rating from five group by 1")
def lineup_rating(spark, d):
    five = team_fit.lineups(_players(spark, d))
    return five.groupBy("team_id").agg(team_fit.net_rating(F.sum("impact"), F.avg("shooting_spacing"), F.max("rim_protection")).alias("net_rating"))


_W = ", ".join(f"max(supply) filter (where skill = '{s}') as {s}" for s in team_fit.SKILLS)


@query(f"with {_PLAYERS_SQL}, {_LONG_SQL}, w as (select team_id as t, {_W} from supply group by 1), pool as (select * from players) select pool.player_id, w.t as team_id, round((" + " + ".join(f"greatest(0, 60 - w.{s}) * pool.{s}" for s in team_fit.SKILLS) + ") / 600.0::double, 4) as complementarity, round((" + " + ".join(f"greatest(0, w.{s} - 60) * pool.{s}" for s in team_fit.SKILLS) + ") / 600.0::double, 4) as redundancy from pool cross join w")
def synergy_scores(spark, d):
    """Every player meets every team."""
    p = _players(spark, d)
    pool = p.drop("team_id", "name")
    return team_fit.synergy(pool, team_fit.team_supply(p)).select("player_id", "team_id", "complementarity", "redundancy")


@query(f"with {_PLAYERS_SQL} select player_id, case " + " ".join(f"when {s} = greatest({', '.join(team_fit.SKILLS)}) then '{a}'" for s, a in zip(team_fit.SKILLS, team_fit.ARCHETYPES, strict=True)) + " end as archetype from players")
def archetypes(spark, d):
    p = _players(spark, d)
    return p.select("player_id", team_fit.archetype(p).alias("archetype"))


# --- queries that SQL can't express: tested by properties


def _features(spark, d):
    rows = b.labels(spark, d).join(features.primary_season(b.seasons(spark, d), season="season_year").drop("season_year"), "player_id").join(b.picks(spark, d).select("player_id", "full_name", "draft_pick", "league_id"), "player_id")
    return rows


FEATURES = ["pts_per100", "ast_per100", "reb_per100", "true_shooting", "usage"]


@query()
def served_board(spark, d):
    """All heads trained on resolved classes, serving the last one with profile, intervals and tiers."""
    rows = _features(spark, d).cache()
    train = rows.where("resolved and draft_year < 1998")
    return board.Board.fit(train, FEATURES).ranked_with_profile(rows.where("draft_year = 1998"))


@query()
def team_fit_board(spark, d):
    """Every player with every team: fit scores and their parts."""
    p = _players(spark, d)
    pool = p.select("player_id", "impact", F.greatest("impact", F.lit(0.0)).alias("vorp"), (1 + F.col("player_id") % 60).alias("pick"), *team_fit.SKILLS)
    payroll = table(spark, d, "supplier").where("s_suppkey < 25").select(F.col("s_suppkey").alias("team_id"), (195_000_000 + F.col("s_acctbal") * 3500).alias("total_salary"))
    return team_fit.team_fit(pool, p, payroll)


@query()
def bootstrap_intervals(spark, d):
    rows = b.impact(spark, d).withColumn("key", F.concat_ws("|", "player_id", "season_year"))
    got = uncertainty.Bootstrap(["minutes", "true_shooting"], "ebpm", "key").fit(rows).transform(rows)
    return got.select("player_id", "season_year", "prediction", "lower", "upper")


@query()
def conformal_intervals(spark, d):
    rows = b.impact(spark, d).withColumn("key", F.concat_ws("|", "player_id", "season_year"))
    return uncertainty.SplitConformal(["minutes"], "ebpm", "key").fit(rows).transform(rows).select("player_id", "season_year", "prediction", "lower", "upper")


@query()
def counterfactuals(spark, d):
    rows = _features(spark, d).cache()
    return board.Board.fit(rows.where("resolved and draft_year < 1998"), FEATURES).counterfactual(rows.where("draft_year = 1998")).select("player_id", "prediction", "current_tier", "target", "projected", "reached", "changes")


@query()
def cox_risk(spark, d):
    rows = _features(spark, d).where("career_seasons >= 1")
    return survival.Cox(["pts_per100", "true_shooting"], "career_seasons", "career_ended").fit(rows).transform(rows).select("player_id", "risk")


@query()
def entity_resolution(spark, d):
    """All parts by name and year, from two sources that spell them differently, by difflib's ratio."""
    p = table(spark, d, "part").select(F.col("p_name").alias("full_name"), (1993 + F.col("p_partkey") % 6).alias("draft_year"))
    _, identity = cleaning.resolve_entities([p, p.withColumn("full_name", F.concat(F.upper("full_name"), F.lit(" III")))])
    return identity


#: Expanding folds over seasons, each with all penalties: the least objective over all sign patterns of two weights is the optimum.
PATHS_SQL = """ys as (select season_year as val, row_number() over (order by season_year) - 1 as k from (select distinct season_year from impact)), f as (select k - 4 as fold, val from ys where k >= 4),
m as (select fold, count(*)::double as nt, avg(minutes) as m1, avg(pts_per100) as m2, avg(ebpm) as my, stddev_pop(minutes) as s1, stddev_pop(pts_per100) as s2, covar_pop(minutes, pts_per100) as c12, covar_pop(minutes, ebpm) as c1, covar_pop(pts_per100, ebpm) as c2 from f join impact on season_year < val group by 1),
pen as (select * from (values ('lasso', 0.05), ('lasso', 0.5), ('net', 0.05), ('net', 0.5), ('ridge', 1.0), ('ridge', 100.0)) t(kind, alpha)),
z as (select fold, kind, alpha::double as alpha, nt, m1, m2, my, s1, s2, c12 / (s1 * s2) as r, c1 / s1 as b1, c2 / s2 as b2, case kind when 'lasso' then alpha when 'net' then alpha / 2 else 0 end::double as l1, case kind when 'lasso' then 0 when 'net' then alpha / 2 else alpha / nt end::double as l2 from m cross join pen),
c as (select *, case when a = 0 then 0 when b = 0 then (b1 - l1 * a) / (1 + l2) else ((b1 - l1 * a) * (1 + l2) - r * (b2 - l1 * b)) / ((1 + l2) * (1 + l2) - r * r) end as w1, case when b = 0 then 0 when a = 0 then (b2 - l1 * b) / (1 + l2) else ((b2 - l1 * b) * (1 + l2) - r * (b1 - l1 * a)) / ((1 + l2) * (1 + l2) - r * r) end as w2 from z cross join (select unnest([-1, 0, 1]) as a) cross join (select unnest([-1, 0, 1]) as b)),
w as (select fold, kind, alpha, arg_min(struct_pack(m1 := m1, m2 := m2, my := my, w1 := w1 / s1, w2 := w2 / s2), 0.5 * (w1 * w1 + 2 * r * w1 * w2 + w2 * w2) - b1 * w1 - b2 * w2 + l1 * (abs(w1) + abs(w2)) + l2 / 2 * (w1 * w1 + w2 * w2)) as g from c group by 1, 2, 3),
p as (select v.player_id, v.season_year, fold, kind, alpha, v.ebpm, g.my + g.w1 * (v.minutes - g.m1) + g.w2 * (v.pts_per100 - g.m2) as prediction from w join f using (fold) join impact v on v.season_year = f.val)"""
PENALTIES = {"lasso": (1.0, [0.05, 0.5]), "net": (0.5, [0.05, 0.5]), "ridge": (None, [1.0, 100.0])}


def _fold_paths(rows):
    folds = temporal.walk_forward(temporal.years_of(rows, "season_year"), 4)
    return folds, {kind: paths.fold_paths(rows, ["minutes", "pts_per100"], "ebpm", folds, alphas, ratio, "season_year") for kind, (ratio, alphas) in PENALTIES.items()}


@query(f"{WITH_IMPACT}, {PATHS_SQL} select fold::int as fold, kind, alpha, count(*)::bigint as n, round(sqrt(avg(power(ebpm - prediction, 2))), 5) as rmse from p group by 1, 2, 3")
def fold_paths(spark, d):
    """Walk-forward errors of lasso, elastic net and ridge at all penalties, from sums by season."""
    _, found = _fold_paths(b.impact(spark, d))
    got = [(r["fold"], kind, r["alpha"], r["n"], round(r["rmse"], 5)) for kind, rows in found.items() for r in rows]
    return spark.createDataFrame(got, "fold int, kind string, alpha double, n long, rmse double")


@query(f"{WITH_IMPACT}, {PATHS_SQL}, best as (select alpha from (select fold, alpha, sqrt(avg(power(ebpm - prediction, 2))) as e from p where kind = 'lasso' group by 1, 2) group by 1 order by avg(e), alpha desc limit 1) select player_id, season_year, fold::int as fold, round(prediction, 4) as prediction from p join best using (alpha) where kind = 'lasso'")
def fold_predictions(spark, d):
    """Out-of-fold predictions of the lasso with the least mean error over folds."""
    rows = b.impact(spark, d)
    folds, found = _fold_paths(rows)
    alpha = paths.best_alpha(found["lasso"])
    chosen = {r["fold"]: r["model"] for r in found["lasso"] if r["alpha"] == alpha}
    return paths.fold_predictions(rows, folds, chosen, "season_year").select("player_id", "season_year", "fold", _r("prediction", 4))


@query(f"""{WITH_LABELS}, careers as (select l.player_id, career_seasons::double as t, career_ended::int as e, pts_per100 as x from labels_ l join (select *, row_number() over (partition by player_id order by season_year desc) as k from seasons) s on s.player_id = l.player_id and s.k = 1 where career_seasons >= 1),
spread as (select avg(x) as m, stddev_samp(x) as s, count(*)::double as n from careers), scaled as (select careers.*, (x - m) / s as z from careers cross join spread),
times as (select t, count(*)::double as n, sum(z) as z1, sum(z * z) as z2, sum(e) as d, sum(e * z) as e1, sum(e * z * z) as e2 from scaled group by 1),
sets as (select t, d, e1, e2, sum(n) over w as s0, sum(z1) over w as s1, sum(z2) over w as s2 from times window w as (order by t desc)),
terms as (select sets.*, unnest(range(d::bigint))::double as l from sets where d > 0),
slopes as (select (sum((s1 - l / d * e1) / (s0 - l)) - (select sum(e1) from times)) / any_value(spread.n) as grad, sum((s2 - l / d * e2) / (s0 - l) - power((s1 - l / d * e1) / (s0 - l), 2)) / any_value(spread.n) + 0.005 as hess from terms cross join spread),
step as (select sign(-grad) * greatest(abs(grad) - 0.005, 0) / hess as beta from slopes)
select player_id, round(exp(beta * z), 5) as risk from scaled cross join step""")
def cox_first_step(spark, d):
    """One proximal Newton step with Efron's ties from 0, penalty 0.01, half of it absolute."""
    rows = b.labels(spark, d).join(features.primary_season(b.seasons(spark, d), season="season_year").drop("season_year"), "player_id").where("career_seasons >= 1")
    model = survival.Cox(["pts_per100"], "career_seasons", "career_ended", 0.01, 0.5, steps=1).fit(rows)
    return model.transform(rows).select("player_id", _r("risk", 5))


@query()
def archetype_clusters(spark, d):
    """Each player's cluster of five by the latest season's rates, the best of ten starts."""
    return clusters.kmeans(features.primary_season(b.seasons(spark, d), season="season_year"), FEATURES)[0].select("player_id", "cluster")


@query()
def shuffled_importance(spark, d):
    """How much R squared a ridge model of cumulative value loses when a feature changes rows."""
    rows = _features(spark, d).dropna(subset=[*FEATURES, "cumulative_value"])
    model = models.ridge(rows, FEATURES, "cumulative_value")
    fit = 1 - F.avg((F.col("cumulative_value") - F.col("prediction")) ** 2) / F.var_pop("cumulative_value")
    return explain.permutation_importance(rows, model.transform, fit, FEATURES, "player_id")
