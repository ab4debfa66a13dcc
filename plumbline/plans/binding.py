"""The engine's domain on the driver's tables: customers are players, their orders are seasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.ordered import numbered
from plumbline.plans.registry import table

THROUGH = 2001


def draft(spark: SparkSession, d: str) -> DataFrame:
    """player_id, full_name, draft_year, league, organization and balance."""
    c = table(spark, d, "customer").where("c_custkey is not null")
    year = (F.lit(1993) + F.col("c_custkey") % 6).cast("long")
    rows = c.select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("full_name"), year.alias("draft_year"), F.col("c_mktsegment").alias("league_id"), F.col("c_nationkey").cast("long").alias("organization"), F.col("c_acctbal").alias("balance"))
    return rows


def picks(spark: SparkSession, d: str) -> DataFrame:
    """``draft`` with draft_pick: the place by balance in a year."""
    return numbered(draft(spark, d), ["draft_year"], -F.col("balance"), ["player_id"], "draft_pick")


def seasons(spark: SparkSession, d: str) -> DataFrame:
    """player_id, season_year, minutes and per-100 statistics of each player and year.

    Line items meet orders on the order key, then both keys are aggregated in one go.
    """
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("player_id"), F.year("o_orderdate").cast("long").alias("season_year"))
    l = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), "l_discount", "l_partkey")  # noqa: E741
    q = F.col("l_quantity").cast("decimal(18,2)")
    flag = lambda x: F.sum(F.when(F.col("l_returnflag") == x, q).otherwise(0))
    g = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("player_id", "season_year").agg(
        F.sum(q).cast("double").alias("_q"), flag("A").cast("double").alias("_a"), flag("N").cast("double").alias("_n"), flag("R").cast("double").alias("_r"), F.sum("price").cast("double").alias("_p"), F.count(F.lit(1)).alias("_k"), F.sum(F.col("l_partkey") % 7).cast("double").alias("_s")
    )
    minutes = F.col("_q") * 8.0
    return g.select(
        "player_id", "season_year", minutes.alias("minutes"), (F.col("_p") / F.col("_q") / 100.0).alias("pts_per100"), (F.col("_a") / F.col("_q") * 20.0).alias("ast_per100"), (F.col("_n") / F.col("_q") * 15.0).alias("reb_per100"), (F.col("_r") / F.col("_q") * 3.0).alias("stl_per100"),
        (F.lit(0.45) + F.col("_s") / F.col("_k") / 30.0).alias("true_shooting"), F.when(F.col("player_id") % 5 != 0, F.col("_k") / 40.0).alias("usage"), (F.col("_s") / F.col("_k") * 2.0).alias("strength_of_schedule"),
    )


DRAFT_SQL = """draft as (select c_custkey as player_id, c_name as full_name, (1993 + c_custkey % 6)::bigint as draft_year, c_mktsegment as league_id, c_nationkey::bigint as organization, c_acctbal as balance,
  row_number() over (partition by 1993 + c_custkey % 6 order by c_acctbal desc, c_custkey)::bigint as draft_pick from customer)"""

SEASONS_SQL = """g as (select o_custkey as player_id, year(o_orderdate)::bigint as season_year, sum(l_quantity::decimal(18,2))::double as q, sum(case when l_returnflag = 'A' then l_quantity::decimal(18,2) else 0 end)::double as a,
  sum(case when l_returnflag = 'N' then l_quantity::decimal(18,2) else 0 end)::double as n, sum(case when l_returnflag = 'R' then l_quantity::decimal(18,2) else 0 end)::double as r, sum(l_extendedprice::decimal(18,2))::double as p, count(*) as k, sum(l_partkey % 7)::double as s
  from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
seasons as (select player_id, season_year, q * 8.0::double as minutes, p / q / 100.0::double as pts_per100, a / q * 20.0::double as ast_per100, n / q * 15.0::double as reb_per100, r / q * 3.0::double as stl_per100,
  0.45::double + s / k / 30.0::double as true_shooting, case when player_id % 5 <> 0 then k / 40.0::double end as usage, s / k * 2.0::double as strength_of_schedule from g)"""

IMPACT_SQL = """raw as (select *, pts_per100 * 0.10::double + ast_per100 * 0.10::double + stl_per100 * 0.20::double + 6.0::double * (true_shooting - 0.55::double) as raw from seasons),
means as (select season_year, sum(raw * minutes) / nullif(sum(minutes), 0) as mean from raw group by 1),
impact0 as (select raw.* exclude (raw), round(raw - mean, 3) as ebpm from raw join means using (season_year)),
impact as (select *, round((ebpm + 2.0::double) * minutes / 19680.0::double, 3) as vorp from impact0)"""

HONORS_SQL = "honors as (select o_custkey as player_id, count(*) filter (where o_orderpriority = '1-URGENT' and o_totalprice > 400000) as all_star_count, count(*) filter (where o_orderpriority = '1-URGENT' and o_totalprice > 450000) as all_nba_count from orders group by 1)"

LABELS_SQL = """facts as (select i.*, d.draft_year, min(season_year) over (partition by i.player_id) as debut_year from impact i join draft d using (player_id)),
inside as (select *, (debut_year - draft_year between 0 and 4) and season_year < debut_year + 4 as inn from facts),
stable as (select *, inn and minutes >= 500 as st from inside),
top as (select *, st and row_number() over (partition by player_id, st order by ebpm desc, season_year) <= 2 as tp from stable),
per as (select player_id, min(debut_year) as debut_year, sum(case when inn then minutes else 0 end) as m, avg(ebpm) filter (where tp) as peak, sum(case when inn then vorp else 0 end) as v, count(distinct season_year) as n, max(season_year) as last from top group by 1),
lab as (select d.player_id, d.draft_year, p.debut_year, coalesce(m >= 1000, false) as reached, p.peak, coalesce(v, 0) as v, coalesce(all_star_count, 0) as sc, coalesce(all_nba_count, 0) as nc, coalesce(n, 0) as n, coalesce(last < 2001, false) as ended
  from draft d left join per p using (player_id) left join honors h using (player_id)),
labels_ as (select player_id, draft_year, debut_year, reached, peak as peak_impact, v as cumulative_value,
  case when reached and peak is not null and (peak >= 6 or nc > 0) then 'superstar' when reached and peak is not null and (peak >= 3 or sc > 0) then 'all_star' when reached and peak >= 0 then 'starter' when reached and peak >= -2 then 'rotation' else 'bust' end as outcome_tier,
  case when coalesce(debut_year - draft_year between 0 and 4, false) then 2001 >= debut_year + 3 else 2001 - draft_year >= 4 end as resolved, n::bigint as career_seasons, ended as career_ended from lab)"""


def impact(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.operators.labels import impact_metrics

    return impact_metrics(seasons(spark, d), "season_year")


def honors(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    top = lambda x: F.count_if((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > x))
    return o.groupBy(F.col("o_custkey").alias("player_id")).agg(top(400000).alias("all_star_count"), top(450000).alias("all_nba_count"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.operators.labels import outcomes

    facts = impact(spark, d).select("player_id", "season_year", "minutes", F.col("ebpm").alias("bpm"), "vorp")
    return outcomes(draft(spark, d), facts, honors(spark, d), THROUGH)


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, y (quality) and p, a clipped score of the text's length, with a segment."""
    labels_ = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("y"))
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    return labels_.join(docs, "doc_id").select("doc_id", "y", "lang", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("p"), F.col("n_chars").cast("double").alias("size"))


PREDICTIONS_SQL = "pred as (select doc_id, quality::double as y, lang, least(1.0::double, n_chars / 4000.0::double) as p, n_chars::double as size from labels join documents using (doc_id))"
