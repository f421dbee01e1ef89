"""Season panel and tier feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import normalize_name
from ..functions.records import asof_latest, stage
from ..operators import metrics as m
from ..operators import panel as p
from ..operators import tiers as t
from ..settings import CUSTOMERS, SUPPLIERS
from ..sources import adapters as a
from .base import cte, query, settings_rows

ES = "entity:l season:l "


def _panel_sql(base: str, codes: dict) -> str:
    return f"""
SELECT *, value AS target, l1 AS value_lag1, l2 AS value_lag2, l3 AS value_lag3,
  l1-l2 AS trend_1, l2-l3 AS trend_2, coalesce(code, -1) AS grp_code,
  (coalesce(l1,0)*0.5::DOUBLE+coalesce(l2,0)*0.3::DOUBLE+coalesce(l3,0)*0.2::DOUBLE)/nullif(
   CASE WHEN l1 IS NULL THEN 0 ELSE 0.5::DOUBLE END+CASE WHEN l2 IS NULL THEN 0 ELSE 0.3::DOUBLE END
   +CASE WHEN l3 IS NULL THEN 0 ELSE 0.2::DOUBLE END,0) AS exp_smooth
FROM (SELECT *, lag(value) OVER w AS l1, lag(value,2) OVER w AS l2, lag(value,3) OVER w AS l3,
  lag(ppg) OVER w AS ppg_lag1, lag(ppg,2) OVER w AS ppg_lag2, lag(games) OVER w AS games_lag1,
  lag(games,2) OVER w AS games_lag2, row_number() OVER w - 1 AS career_season
  FROM (SELECT *, coalesce(value/nullif(games,0),0) AS ppg FROM {base})
  WINDOW w AS (PARTITION BY entity ORDER BY season))
LEFT JOIN {settings_rows(codes, 'gc(cg, code)')} ON cg=grp"""


cte("clags", _panel_sql("cseason", CUSTOMERS.group_codes))
cte("cpanel", "SELECT * FROM clags WHERE value_lag1 IS NOT NULL")
cte("slags", _panel_sql("(SELECT entity, season, entity_name, grp, team, value, value_base, games FROM ssum)",
                        SUPPLIERS.group_codes))
cte("spanel", "SELECT * FROM slags WHERE value_lag1 IS NOT NULL")
cte("cwho", "SELECT entity, min(as_of_date) AS first_date FROM orec GROUP BY entity")
cte("cborn", "SELECT entity, first_date - (7000 + entity % 3000)::INT AS birth_date FROM cwho")
cte("cpicks", """
SELECT entity, year(first_date) + extra AS season, (entity % 260 + 1) AS pick, entity % 7 + 1 AS round
FROM cwho CROSS JOIN (VALUES (0), (2)) v(extra) WHERE entity % 3 <> 0""")


def cseason(spark, sf):
    return stage(a.customer_season(spark, sf))


def cpanel(spark, sf):
    return p.lag_panel(cseason(spark, sf), CUSTOMERS)


def slog(spark, sf, opponent=False):
    return stage(a.supplier_log(spark, sf, opponent).select(
        "entity", "season", "period", "entity_name", "grp", "team", "value", "value_base", "targets",
        "carries", "attempts", "receptions", "target_share", *(["opponent"] if opponent else [])))


def spanel(spark, sf, lg=None):
    return p.lag_panel(m.season_totals(slog(spark, sf) if lg is None else lg), SUPPLIERS)


def _first_order(spark, sf):
    return a.order_records(spark, sf).groupBy("entity").agg(F.min("as_of_date").alias("first_date"))


def births(spark, sf):
    days = (7000 + F.pmod("entity", F.lit(3000))).cast("int")
    return _first_order(spark, sf).select(
        F.col("entity").alias("gsis_id"), F.date_sub("first_date", days).alias("birth_date"))


def picks(spark, sf):
    return (
        _first_order(spark, sf).where("entity % 3 <> 0")
        .select("entity", F.explode(F.array(F.lit(0), F.lit(2))).alias("extra"), "first_date")
        .select("entity", (F.year("first_date") + F.col("extra")).alias("season"),
                (F.col("entity") % 260 + 1).alias("pick"), (F.col("entity") % 7 + 1).alias("round"))
    )


_LAGS = ("target:d value_lag1:d value_lag2:d value_lag3:d ppg_lag1:d ppg_lag2:d games_lag1:l "
         "games_lag2:l trend_1:d trend_2:d career_season:l exp_smooth:d grp_code:l")


@query("lag_panel", ES + "entity_name:s grp:s " + _LAGS, "SELECT * FROM cpanel")
def _(spark, sf):
    return cpanel(spark, sf)


_MATRIX = ("career_season exp_smooth games_lag1 games_lag2 grp_code lag2_missing ppg_lag1 ppg_lag2 "
           "trend_1 trend_2 value_lag1 value_lag2 value_lag3").split()


@query("feature_matrix", ES + " ".join(c + ":d" for c in _MATRIX),
       "SELECT entity, season, (value_lag2 IS NULL)::INT AS lag2_missing, "
       + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _MATRIX if c != "lag2_missing")
       + " FROM cpanel")
def _(spark, sf):
    return p.feature_matrix(p.missing_indicators(cpanel(spark, sf)), 0, ("entity", "season"))


@query("forecast_rows", "entity:l season:l grp:s " + _LAGS.replace("target:d ", ""), _panel_sql(
    "(SELECT entity, season, grp, value, games FROM cseason UNION ALL SELECT entity, 2002, "
    "arg_max(grp, season), NULL, NULL FROM cseason GROUP BY entity)", CUSTOMERS.group_codes)
    + " WHERE season=2002")
def _(spark, sf):
    return p.forecast_rows(cseason(spark, sf), 2002, CUSTOMERS)


@query("gap_filter", "entity:l last_season:l",
       "SELECT entity, season AS last_season FROM (SELECT entity, season, season - lag(season) OVER w "
       "AS gap, row_number() OVER (PARTITION BY entity ORDER BY season DESC) AS rn FROM cseason "
       "WINDOW w AS (PARTITION BY entity ORDER BY season)) WHERE rn=1 AND season>=2000 AND "
       "(gap IS NULL OR gap<=2)")
def _(spark, sf):
    return p.gap_filter(a.customer_season(spark, sf), 2002)


@query("missing_indicators", ES + "lag1_missing:l lag2_missing:l lag3_missing:l",
       "SELECT *, (l1 IS NULL)::INT AS lag1_missing, (l2 IS NULL)::INT AS lag2_missing, "
       "(l3 IS NULL)::INT AS lag3_missing FROM cpanel")
def _(spark, sf):
    return p.missing_indicators(cpanel(spark, sf))


@query("rookie_flag", ES + "is_rookie:l", "SELECT *, (career_season=0)::INT AS is_rookie FROM clags")
def _(spark, sf):
    return p.rookie_flag(p.with_lags(p.fold_seasons(cseason(spark, sf)), CUSTOMERS.group_codes))


@query("top_n_entities", ES + "row_rank:l",
       "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY value DESC, entity) "
       "AS row_rank FROM cseason) WHERE row_rank<=200")
def _(spark, sf):
    return p.top_n_entities(a.customer_season(spark, sf), 200)


@query("asof_latest", ES + "rank:l amount:d", """
SELECT entity, season, rank, amount FROM (SELECT c.entity, c.season, o.rank, o.amount,
  row_number() OVER (PARTITION BY c.entity, c.season ORDER BY o.as_of_date DESC, o.record DESC) AS rn
  FROM cseason c LEFT JOIN orec o ON o.entity=c.entity AND o.as_of_date<=make_date(c.season,8,1))
WHERE rn=1""")
def _(spark, sf):
    return asof_latest(cseason(spark, sf), a.order_records(spark, sf), "as_of_date",
                       ["rank", "amount"], ["record"])


# -- tier 0 ------------------------------------------------------------------------------------

@query("age_features", ES + "age:d age_squared:d", """
SELECT *, age*age AS age_squared FROM (SELECT cpanel.*, round_even(date_diff('day', birth_date,
make_date(season,8,1))/365.25::DOUBLE, 2) AS age FROM cpanel LEFT JOIN cborn USING (entity))""")
def _(spark, sf):
    return t.age_features(cpanel(spark, sf), births(spark, sf))


@query("draft_features", ES + "draft_pick:d draft_round:d is_undrafted:l", """
SELECT cpanel.entity, cpanel.season, coalesce(pick, 300) AS draft_pick, coalesce(round, 8) AS draft_round,
  (pick IS NULL)::INT AS is_undrafted FROM cpanel LEFT JOIN (SELECT entity, min(season) AS y,
  arg_min(pick, season) AS pick, arg_min(round, season) AS round FROM cpicks GROUP BY entity) d
  ON d.entity=cpanel.entity AND d.y<=cpanel.season""")
def _(spark, sf):
    return t.draft_features(cpanel(spark, sf), picks(spark, sf))


# -- tier 1 ------------------------------------------------------------------------------------

cte("copp", "SELECT entity, season+1 AS season, sum(orders*150.0::DOUBLE) AS exp_points, "
    "sum(value-orders*150.0::DOUBLE) AS points_over_expected, count(*) AS n FROM clog "
    "GROUP BY entity, season")


def opportunity(spark, sf):
    e = F.col("orders") * 150.0
    return a.customer_orders(spark, sf).select(
        "entity", "season", "period", e.alias("points_exp"), (F.col("value") - e).alias("points_diff"))


@query("opportunity_features", ES + "exp_points:d exp_ppg:d points_over_expected:d poe_ppg:d", """
SELECT cpanel.entity, cpanel.season, exp_points, exp_points/n AS exp_ppg, points_over_expected,
  points_over_expected/n AS poe_ppg FROM cpanel LEFT JOIN copp ON copp.entity=cpanel.entity
  AND copp.season=cpanel.season""")
def _(spark, sf):
    return t.opportunity_features(cpanel(spark, sf), opportunity(spark, sf))


@query("normalize_name", "entity:l raw:s clean:s", """
SELECT c_custkey AS entity, raw, trim(regexp_replace(regexp_replace(trim(lower(raw)), '[^a-z ]+', '', 'g'),
  '\\s+(jr|sr|ii|iii|iv|v)$', '')) AS clean FROM (SELECT *, c_mktsegment || ' O''' ||
  translate(c_name, '0123456789#', 'abcdefghij ') || CASE WHEN c_custkey%3=0 THEN ' Jr.'
  WHEN c_custkey%3=1 THEN ' III' ELSE '' END AS raw FROM customer)""")
def _(spark, sf):
    k = F.col("c_custkey") % 3
    raw = F.concat(F.col("c_mktsegment"), F.lit(" O'"), _letters("c_name"),
                   F.when(k == 0, " Jr.").when(k == 1, " III").otherwise(""))
    return a.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity"), raw.alias("raw"), normalize_name(raw).alias("clean"))


def _letters(c):
    return F.translate(c, "0123456789#", "abcdefghij ")


def rankings(spark, sf):
    o = a.order_records(spark, sf).join(a.customers(spark, sf).drop("team"), "entity")
    page = F.when(F.col("rank") <= 3, "redraft-overall").otherwise("redraft-idp")
    return o.select(
        F.concat(_letters("entity_name"), F.lit(" Jr.")).alias("player"), F.col("grp").alias("pos"),
        F.col("as_of_date").alias("scrape_date"), F.col("amount").alias("ecr"),
        page.alias("page_type"), (F.col("amount") / 1000).alias("projection"))


cte("cecr", """
SELECT entity, season, consensus_rank, consensus_grp_rank, consensus_projection FROM (SELECT *,
  row_number() OVER (PARTITION BY season ORDER BY amount, entity_name) AS consensus_rank,
  row_number() OVER (PARTITION BY season, grp ORDER BY amount, entity_name) AS consensus_grp_rank,
  amount/1000 AS consensus_projection
FROM (SELECT o.entity, cust.grp, entity_name, amount, year(as_of_date) AS season, row_number() OVER
  (PARTITION BY o.entity, year(as_of_date) ORDER BY as_of_date DESC, amount DESC) AS rn
  FROM orec o JOIN cust ON cust.entity=o.entity WHERE rank<=3 AND month(as_of_date)*100+day(as_of_date)
  BETWEEN 601 AND 910) WHERE rn=1)""")


@query("consensus_rank", ES + "consensus_rank:l consensus_grp_rank:l consensus_projection:d",
       "SELECT cpanel.entity, cpanel.season, cecr.* EXCLUDE (entity, season) FROM cpanel LEFT JOIN cecr "
       "ON cecr.entity=cpanel.entity AND cecr.season=cpanel.season")
def _(spark, sf):
    named = cpanel(spark, sf).withColumn("entity_name", _letters("entity_name"))
    return t.consensus_rank(named, rankings(spark, sf))


cte("susage", """
SELECT u.entity, u.season+1 AS season, n AS periods_played_lag1, h2-h1 AS h2_vs_h1,
  tg/nullif(tt,0) AS target_share_lag1, cr/nullif(tc,0) AS carry_share_lag1 FROM (
  SELECT entity, season, any_value(team) AS team, count(*) AS n, avg(value) FILTER (period>9) AS h2,
    avg(value) FILTER (period<=9) AS h1, sum(targets) AS tg, sum(carries) AS cr
  FROM slog GROUP BY entity, season) u
JOIN (SELECT team, season, sum(targets) AS tt, sum(carries) AS tc FROM slog GROUP BY team, season) x
  ON x.team=u.team AND x.season=u.season""")
_USAGE = "periods_played_lag1:l h2_vs_h1:d target_share_lag1:d carry_share_lag1:d"


@query("usage_features", ES + _USAGE, "SELECT s.entity, s.season, u.* EXCLUDE (entity, season) FROM spanel "
       "s LEFT JOIN susage u ON u.entity=s.entity AND u.season=s.season")
def _(spark, sf):
    lg = slog(spark, sf)
    return t.usage_features(spanel(spark, sf, lg), lg, m.season_totals(lg))


# -- tier 2 ------------------------------------------------------------------------------------

cte("ssnap", """
SELECT entity, season+1 AS season, avg(target_share) AS snap_share_lag1,
  count(*) FILTER (target_share>=0.5) AS periods_above_50,
  count(*) FILTER (target_share>=0.75) AS periods_above_75, avg(target_share) FILTER (period>9)
  - avg(target_share) FILTER (period<=9) AS snap_share_trend FROM slog GROUP BY entity, season""")
_SNAP = "snap_share_lag1:d periods_above_50:l periods_above_75:l snap_share_trend:d"


@query("snap_features", ES + _SNAP, "SELECT s.entity, s.season, u.* EXCLUDE (entity, season) FROM spanel s "
       "LEFT JOIN ssnap u ON u.entity=s.entity AND u.season=s.season")
def _(spark, sf):
    lg = slog(spark, sf)
    return t.snap_features(spanel(spark, sf, lg), lg.withColumnRenamed("target_share", "offense_pct"))


cte("cdepth", """
SELECT entity, season, rank AS depth_position FROM (SELECT *, year(as_of_date) AS season, row_number() OVER
 (PARTITION BY entity, year(as_of_date) ORDER BY as_of_date DESC, rank DESC) AS rn FROM orec
 WHERE as_of_date<=make_date(year(as_of_date),8,1)) WHERE rn=1""")


def charts(spark, sf):
    return a.order_records(spark, sf).select(
        "entity", F.year("as_of_date").alias("season"), F.col("as_of_date").alias("date"),
        F.col("rank").alias("depth_team"))


@query("depth_position", ES + "depth_position:d", "SELECT c.entity, c.season, depth_position FROM cpanel c "
       "LEFT JOIN cdepth d ON d.entity=c.entity AND d.season=c.season")
def _(spark, sf):
    return t.depth_position(cpanel(spark, sf), charts(spark, sf))


cte("splay", """
SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.season, b.season)+1 AS season,
  air/nullif(tair,0) AS air_yards_share, 1.5*tgt/nullif(ttgt,0)+0.7*air/nullif(tair,0) AS wopr,
  rz/nullif(trz,0) AS rz_target_share, rrz/nullif(trrz,0) AS rz_carry_share FROM (
 SELECT entity, season, air, tgt, rz, sum(air) OVER w AS tair, sum(tgt) OVER w AS ttgt, sum(rz) OVER w AS trz
 FROM (SELECT receiver_id AS entity, season, team, sum(air_yards) AS air, count(*)::DOUBLE AS tgt,
  count(*) FILTER (yardline_100<=20)::DOUBLE AS rz FROM plays WHERE receiver_id IS NOT NULL
  GROUP BY receiver_id, season, team) WINDOW w AS (PARTITION BY season, team)) a
FULL JOIN (SELECT entity, season, rrz, sum(rrz) OVER (PARTITION BY season, team) AS trrz FROM (
 SELECT rusher_id AS entity, season, team, count(*) FILTER (yardline_100<=20)::DOUBLE AS rrz FROM plays
 WHERE rusher_id IS NOT NULL GROUP BY rusher_id, season, team)) b ON a.entity=b.entity AND a.season=b.season""")
cte("sroe", "SELECT team, season+1 AS season, avg(pass_oe) AS team_pass_roe FROM plays GROUP BY team, season")
_EVENT = "air_yards_share:d wopr:d rz_target_share:d rz_carry_share:d team_pass_roe:d"


@query("event_share_features", ES + _EVENT, "SELECT s.entity, s.season, e.* EXCLUDE (entity, season), "
       "team_pass_roe FROM spanel s LEFT JOIN splay e ON e.entity=s.entity AND e.season=s.season "
       "LEFT JOIN sroe r ON r.team=s.team AND r.season=s.season")
def _(spark, sf):
    return t.event_share_features(spanel(spark, sf), a.play_events(spark, sf))


cte("sroster", """
SELECT entity, season, opponent AS rteam FROM (SELECT *, row_number() OVER (PARTITION BY entity, season
 ORDER BY period DESC) AS rn FROM slog WHERE period<=8) WHERE rn=1""")
cte("tpicks", "SELECT n_name AS team, r_name AS grp, year(l_shipdate)::INT AS season, count(*) AS cc, "
    "sum(greatest(0, 33-l_quantity)) AS cap FROM lineitem JOIN nation ON l_partkey%25=n_nationkey "
    "JOIN region ON l_orderkey%5=r_regionkey GROUP BY ALL")


def rosters(lg):
    return lg.select("entity", "season", F.col("opponent").alias("team"),
                     F.make_date("season", "period", F.lit(1)).alias("date"))


def team_picks(spark, sf):
    li = a.table(spark, sf, "lineitem")
    n, g = a.table(spark, sf, "nation"), a.table(spark, sf, "region")
    return li.join(n, li.l_partkey % 25 == n.n_nationkey).join(
        g, li.l_orderkey % 5 == g.r_regionkey).select(
        F.col("n_name").alias("team"), F.col("r_name").alias("grp"),
        F.year("l_shipdate").alias("season"), F.col("l_quantity").alias("pick"))


@query("situation_features", ES + "changed_team:l competition_count:l competition_capital:d", """
SELECT s.entity, s.season, CASE WHEN a.rteam<>b.rteam THEN 1 ELSE 0 END AS changed_team,
  cc AS competition_count, cap AS competition_capital FROM spanel s
LEFT JOIN sroster a ON a.entity=s.entity AND a.season=s.season
LEFT JOIN sroster b ON b.entity=s.entity AND b.season=s.season-1
LEFT JOIN tpicks p ON p.team=a.rteam AND p.grp=s.grp AND p.season=s.season""")
def _(spark, sf):
    lg = slog(spark, sf, True)
    return t.situation_features(spanel(spark, sf, lg), rosters(lg), team_picks(spark, sf))


# -- tiers 3 and 4 -----------------------------------------------------------------------------

@query("tracking_features", ES + "separation_avg:d efficiency:d completion_pct_oe:d", """
SELECT s.entity, s.season, separation_avg, efficiency, completion_pct_oe FROM spanel s LEFT JOIN (
 SELECT entity, season+1 AS season, avg(value) FILTER (period<=6) AS separation_avg,
  avg(carries) FILTER (period>3) AS efficiency, avg(attempts) FILTER (period>3) AS completion_pct_oe
 FROM slog GROUP BY entity, season) u ON u.entity=s.entity AND u.season=s.season""")
def _(spark, sf):
    lg = slog(spark, sf)
    receiving = lg.where("period <= 6").select("entity", "season", F.col("value").alias("separation"))
    rushing = lg.where("period > 3").select(
        "entity", "season", F.col("carries").alias("efficiency"), F.col("attempts").alias("cpoe"),
        F.col("targets").alias("avg_separation"))
    return t.tracking_features(spanel(spark, sf, lg), [receiving, rushing])


@query("participation_features", ES + "participation_rate:d", "SELECT s.entity, s.season, snap_share_lag1 "
       "AS participation_rate FROM spanel s LEFT JOIN ssnap u ON u.entity=s.entity AND u.season=s.season")
def _(spark, sf):
    lg = slog(spark, sf)
    return t.participation_features(
        spanel(spark, sf, lg), lg.select("entity", "season", F.col("target_share").alias("participation")))


@query("prior_summary", ES + "drop_rate:d pressure_rate:d", """
SELECT s.entity, s.season, drop_rate, pressure_rate FROM spanel s LEFT JOIN (SELECT entity, season+1 AS season,
 avg(target_share) AS drop_rate, avg(attempts) AS pressure_rate FROM slog GROUP BY entity, season) u
 ON u.entity=s.entity AND u.season=s.season""")
def _(spark, sf):
    lg = slog(spark, sf)
    source = lg.select(F.col("entity").alias("gsis_id"), "season", F.col("target_share").alias("drop_pct"),
                       F.col("attempts").cast("string").alias("pressure_rate"))
    return t.prior_summary(spanel(spark, sf, lg), source, t.ADVANCED)


cte("cinj", """
SELECT entity, year(as_of_date)+1 AS season, count(*) AS injury_reports_lag1,
 count(*) FILTER (status IN ('F','P')) AS games_missed_lag1 FROM orec GROUP BY entity, year(as_of_date)""")


def injuries(spark, sf):
    s = F.when(F.col("status") == "F", "Out").when(F.col("status") == "P", "IR").otherwise("Questionable")
    return a.order_records(spark, sf).select(
        "entity", F.year("as_of_date").alias("season"), F.col("as_of_date").alias("report_date"),
        s.alias("report_status"))


@query("injury_features", ES + "injury_reports_lag1:l games_missed_lag1:l",
       "SELECT c.entity, c.season, i.* EXCLUDE (entity, season) FROM cpanel c LEFT JOIN cinj i "
       "ON i.entity=c.entity AND i.season=c.season")
def _(spark, sf):
    return t.injury_features(cpanel(spark, sf), injuries(spark, sf))


cte("ccon", """
SELECT entity, season, amount AS contract_guaranteed, greatest(0, e-season) AS contract_years_left FROM (
 SELECT c.entity, c.season, o.amount, year(o.as_of_date)+o.rank AS e, row_number() OVER (PARTITION BY c.entity,
 c.season ORDER BY o.as_of_date DESC, o.amount DESC) AS rn FROM cpanel c LEFT JOIN orec o
 ON o.entity=c.entity AND o.as_of_date<=make_date(c.season,8,1)) WHERE rn=1""")


def contracts(spark, sf):
    return a.order_records(spark, sf).select(
        "entity", F.col("as_of_date").alias("signed_date"), F.col("amount").alias("guaranteed"),
        (F.year("as_of_date") + F.col("rank")).alias("end_year"))


@query("contract_features", ES + "contract_guaranteed:d contract_years_left:d",
       "SELECT entity, season, contract_guaranteed, CASE WHEN contract_guaranteed IS NULL THEN NULL "
       "ELSE contract_years_left END AS contract_years_left FROM ccon")
def _(spark, sf):
    return t.contract_features(cpanel(spark, sf), contracts(spark, sf))


def customer_sources(spark, sf):
    return {"players": births(spark, sf), "draft_picks": picks(spark, sf),
            "ff_opportunity": opportunity(spark, sf), "depth_charts": charts(spark, sf),
            "injuries": injuries(spark, sf), "contracts": contracts(spark, sf)}


_WIDE_SQL = """
SELECT c.*, (l3 IS NULL)::INT AS lag3_missing, 0 AS is_rookie, round_even(date_diff('day', birth_date,
 make_date(c.season,8,1))/365.25::DOUBLE, 2) AS age, coalesce(d.pick, 300) AS draft_pick, exp_points,
 points_over_expected/n AS poe_ppg, depth_position, games_missed_lag1, contract_guaranteed
FROM cpanel c LEFT JOIN cborn b ON b.entity=c.entity
LEFT JOIN (SELECT entity, min(season) AS y, arg_min(pick, season) AS pick FROM cpicks GROUP BY entity) d
 ON d.entity=c.entity AND d.y<=c.season
LEFT JOIN copp o ON o.entity=c.entity AND o.season=c.season
LEFT JOIN cdepth e ON e.entity=c.entity AND e.season=c.season
LEFT JOIN cinj i ON i.entity=c.entity AND i.season=c.season
LEFT JOIN ccon k ON k.entity=c.entity AND k.season=c.season"""
_WIDE = ES + ("target:d exp_smooth:d lag3_missing:l is_rookie:l age:d draft_pick:d exp_points:d poe_ppg:d "
              "depth_position:d games_missed_lag1:l contract_guaranteed:d")


@query("wide_panel", _WIDE, _WIDE_SQL)
def _(spark, sf):
    return t.wide_panel(stage(cpanel(spark, sf)), 4, customer_sources(spark, sf))


@query("historical_wide_panel", _WIDE, _WIDE_SQL + " WHERE c.season>=1998")
def _(spark, sf):
    return t.wide_panel(stage(cpanel(spark, sf)).where("season >= 1998"), 4, customer_sources(spark, sf))


@query("tier_composers", ES + _SNAP + " " + _USAGE + " drop_rate:d participation_rate:d", """
SELECT s.entity, s.season, u.* EXCLUDE (entity, season), v.* EXCLUDE (entity, season),
 snap_share_lag1 AS participation_rate, snap_share_lag1 AS drop_rate
FROM spanel s LEFT JOIN ssnap u ON u.entity=s.entity AND u.season=s.season
LEFT JOIN susage v ON v.entity=s.entity AND v.season=s.season""")
def _(spark, sf):
    lg = slog(spark, sf)
    share = lg.withColumnRenamed("target_share", "offense_pct")
    return t.wide_panel(spanel(spark, sf, lg), 4, {
        "player_weekly": lg, "player_season": stage(m.season_totals(lg)), "snap_counts": share,
        "participation": share, "pfr": lg.withColumnRenamed("target_share", "drop_pct")})
