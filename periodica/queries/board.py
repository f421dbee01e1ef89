"""Ingest and season-board queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..functions.ordered import Rank, add_ranks
from ..functions.records import stage
from ..operators import metrics as m
from ..operators import rankings as r
from ..plans import season_board as plan
from ..settings import MEASURES, SUPPLIERS
from ..sources import adapters as a
from ..sources import export, scans, schema
from .base import cte, query, settings_rows

ES = "entity:l season:l "
S = SUPPLIERS
COUNTERS = [x for x in MEASURES if x not in ("value", "value_base")]

cte("ssum", "SELECT entity, season, any_value(entity_name) AS entity_name, any_value(grp) AS grp, "
    "any_value(team) AS team, count(DISTINCT period) AS games, avg(target_share) AS target_share, "
    "count(*) FILTER (carries+targets+attempts>0) AS games_active, "
    + ", ".join(f"sum({x}) AS {x}" for x in MEASURES) + " FROM slog GROUP BY entity, season")

cte("sscore", """
SELECT *, value AS points, value_base AS points_base, (value+value_base)/2 AS points_half,
  value/nullif(games,0) AS ppg, (value+value_base)/2/nullif(games,0) AS ppg_half,
  value_base/nullif(games,0) AS ppg_base FROM ssum""")

cte("svol", """
SELECT *, fumbles_lost + interceptions AS turnovers, touches/nullif(games,0) AS touch_pg,
  opportunities/nullif(games,0) AS opp_pg, scrim_yards/nullif(games,0) AS scrim_yds_pg,
  total_yards/nullif(games,0) AS total_yds_pg, total_tds/nullif(games,0) AS tds_pg
FROM (SELECT *, carries+receptions AS touches, carries+targets AS opportunities,
  rushing_yards+receiving_yards AS scrim_yards,
  rushing_yards+receiving_yards+passing_yards AS total_yards,
  passing_tds+rushing_tds+receiving_tds+special_teams_tds AS total_tds,
  sack_fumbles_lost+rushing_fumbles_lost+receiving_fumbles_lost AS fumbles_lost,
  passing_first_downs+rushing_first_downs+receiving_first_downs AS first_downs,
  passing_2pt+rushing_2pt+receiving_2pt AS two_pt FROM sscore)""")

cte("seff", """
SELECT *, points/nullif(touches,0) AS pts_per_touch, points/nullif(opportunities,0) AS pts_per_opp,
  scrim_yards/nullif(touches,0) AS yards_per_touch, rushing_yards/nullif(carries,0) AS ypc,
  receiving_yards/nullif(receptions,0) AS ypr, receiving_yards/nullif(targets,0) AS ypt,
  receptions/nullif(targets,0) AS catch_rate,
  (rushing_tds+receiving_tds)/nullif(touches,0) AS td_rate,
  receiving_yac/nullif(receptions,0) AS yac_per_rec, receiving_air_yards/nullif(targets,0) AS adot,
  completions/nullif(attempts,0) AS comp_pct, passing_yards/nullif(attempts,0) AS ypa,
  passing_air_yards/nullif(attempts,0) AS air_yards_pa,
  passing_tds/nullif(interceptions,0) AS td_int_ratio,
  sacks_taken/nullif(attempts+sacks_taken,0) AS sack_rate FROM svol""")

cte("swrank", """
SELECT *, rank() OVER (PARTITION BY season, period, grp ORDER BY value DESC) AS period_rank
FROM slog""")

cte("scons", f"""
SELECT entity, season, max(value) AS best_week, min(value) AS worst_week,
  quantile_cont(value, 0.5) AS median_week, stddev_samp(value) AS stdev,
  quantile_cont(value, 0.1) AS floor, quantile_cont(value, 0.9) AS ceiling,
  count(*) FILTER (value >= boom) AS boom_weeks, count(*) FILTER (value <= bust) AS bust_weeks,
  count(*) FILTER (period_rank <= coalesce(slots, 0)) AS starter_weeks,
  count(*) FILTER (period_rank <= 5) AS top5_weeks, min(period_rank) AS best_group_finish
FROM swrank LEFT JOIN {settings_rows(S.boom_bust, 'bb(g1, boom, bust)')} ON g1=grp
LEFT JOIN {settings_rows(S.starter_slots, 'ss(g2, slots)')} ON g2=grp GROUP BY entity, season""")

cte("sfull", """
SELECT seff.*, scons.* EXCLUDE (entity, season), stdev/nullif(ppg,0) AS cv,
  boom_weeks/nullif(games,0) AS boom_rate, bust_weeks/nullif(games,0) AS bust_rate,
  starter_weeks/nullif(games,0) AS starter_week_rate
FROM seff JOIN scons ON seff.entity=scons.entity AND seff.season=scons.season""")

cte("sranked", """
SELECT *, grp || group_rank AS group_label, rank - rank_ppg AS rank_delta FROM (
SELECT *, rank() OVER (PARTITION BY season ORDER BY points DESC) AS rank,
  rank() OVER (PARTITION BY season ORDER BY points_half DESC) AS rank_half,
  rank() OVER (PARTITION BY season ORDER BY points_base DESC) AS rank_base,
  rank() OVER (PARTITION BY season, grp ORDER BY points DESC) AS group_rank,
  CASE WHEN games>=4 THEN rank() OVER (PARTITION BY season, games>=4 ORDER BY ppg DESC) END AS rank_ppg,
  CASE WHEN games>=4 THEN rank() OVER (PARTITION BY season, grp, games>=4 ORDER BY ppg DESC) END
    AS group_rank_ppg FROM sfull)""")

cte("slevel", f"""
SELECT season, grp, coalesce(max(CASE WHEN rn=n THEN ppg END), min(ppg)) AS replacement_ppg,
  any_value(n) AS replacement_rank FROM (
  SELECT season, grp, ppg, n, row_number() OVER (PARTITION BY season, grp ORDER BY ppg DESC, entity) AS rn
  FROM sscore JOIN {settings_rows(S.replacement_rank, 'rr(g3, n)')} ON g3=grp
  WHERE games>=4 AND ppg IS NOT NULL) GROUP BY season, grp""")

cte("svor", """
SELECT sranked.*, replacement_ppg, ppg-replacement_ppg AS vor_ppg,
  (ppg-replacement_ppg)*games AS vor_total
FROM sranked LEFT JOIN slevel ON slevel.season=sranked.season AND slevel.grp=sranked.grp""")

cte("stier", f"""
SELECT entity, season, 1 + sum(step) OVER (PARTITION BY season, grp ORDER BY ppg DESC, entity
    ROWS UNBOUNDED PRECEDING) AS tier FROM (
  SELECT entity, season, grp, ppg,
    CASE WHEN lag(ppg) OVER (PARTITION BY season, grp ORDER BY ppg DESC, entity) - ppg >= gap
      THEN 1 ELSE 0 END AS step
  FROM sscore JOIN {settings_rows(S.tier_gap, 'tg(g4, gap)')} ON g4=grp WHERE games>=4)""")

cte("sboard", """
SELECT svor.*, tier, CASE WHEN team IS NULL THEN NULL ELSE team END AS teams
FROM svor LEFT JOIN stier ON stier.entity=svor.entity AND stier.season=svor.season""")

cte("stop", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY points DESC, entity) AS rn
  FROM sboard) WHERE rn <= 50""")


def log(spark, sf, opponent=False):
    return a.supplier_log(spark, sf, opponent)


def totals(spark, sf):
    return stage(m.add_scoring(m.season_totals(log(spark, sf))))


def scored(spark, sf):
    return plan.scored(log(spark, sf), S)


# -- ingest ------------------------------------------------------------------------------------

_RAW = {"entity": "player_id", "entity_name": "player_display_name", "grp": "position",
        "opponent": "opponent_team", "period": "week", "value": "fantasy_points_ppr",
        "value_base": "fantasy_points", "interceptions": "passing_interceptions",
        "sacks_taken": "sacks_suffered", "passing_2pt": "passing_2pt_conversions"}


def raw_log(spark, sf):
    """The supplier log under the names a raw file uses, with losing aliases beside them."""
    half = F.when(F.col("period") <= 10, "REG").otherwise("POST")
    return (
        log(spark, sf).withColumn("season_type", half).withColumnsRenamed(_RAW)
        .withColumn("player_name", F.lower("player_display_name"))
        .withColumn("targets", F.when(F.col("targets") > 60, F.lit("n/a"))
                    .otherwise(F.col("targets").cast("string")))
    )


@query("standardize", ES + "period:l entity_name:s grp:s value:d interceptions:l season_type:s",
       "SELECT *, CASE WHEN period<=10 THEN 'REG' ELSE 'POST' END AS season_type FROM slog")
def _(spark, sf):
    return schema.standardize(raw_log(spark, sf))


@query("coerce_numeric", ES + "period:l targets:d carries:d passing_yac:d",
       "SELECT *, 0.0 AS passing_yac FROM slog WHERE targets<=60 "
       "UNION ALL SELECT * REPLACE (0 AS targets), 0.0 AS passing_yac FROM slog WHERE targets>60")
def _(spark, sf):
    return schema.coerce_numeric(schema.standardize(raw_log(spark, sf)))


def _profile_sql():
    kept = (*MEASURES, "season", "team", "target_share", "season_type", "entity", "entity_name",
            "grp", "opponent", "period")
    absent = ("opponent",)
    rows = []
    for n in schema.ALIASES:
        there = n in kept and n not in absent
        source = _RAW.get(n, n) if there else ""
        count = f"(SELECT count({'season' if n == 'season_type' else n}) FROM slog)" if there else "0"
        rows.append(f"SELECT '{n}' AS canonical, '{source}' AS source_column, "
                    f"'{'ok' if there else 'MISSING'}' AS status, {count} AS filled")
    return " UNION ALL ".join(rows)


@query("schema_profile", "canonical:s source_column:s status:s filled:l", _profile_sql())
def _(spark, sf):
    return schema.schema_profile(raw_log(spark, sf))


@query("load_game_log", ES + "period:l grp:s value:d carries:d",
       "SELECT * FROM slog WHERE season IN (1996, 1997) AND period<=10 AND grp IN ('ASIA','EUROPE')")
def _(spark, sf):
    return scans.load_game_log(raw_log(spark, sf), [1996, 1997], "REG", ["ASIA", "EUROPE"])


@query("load_season_totals", "level:s " + ES + "games:l value:d carries:d", " UNION ALL ".join(
    f"SELECT '{level}' AS level, entity, season, count(DISTINCT period) AS games, sum(value) AS value, "
    f"sum(carries) AS carries FROM slog WHERE {rows} GROUP BY ALL"
    for level, rows in (("reg", "period<=10"), ("post", "period>10"), ("reg+post", "true"))))
def _(spark, sf):
    lg = scans.load_game_log(raw_log(spark, sf))
    return scans.union_ragged(scans.load_season_totals(lg, x).withColumn("level", F.lit(x)) for x in scans.LEVELS)


@query("multi_season_totals", ES + "value:d games:l ppg:d ppg_base:d",
       "SELECT *, CASE WHEN games=0 THEN 0 ELSE value/games END AS ppg, "
       "CASE WHEN games=0 THEN 0 ELSE value_base/games END AS ppg_base FROM ("
       "SELECT entity, season, sum(value) AS value, sum(value_base) AS value_base, "
       "CASE WHEN entity % 7 = 0 THEN 0 ELSE count(*) END AS games FROM slog "
       "WHERE season BETWEEN 1996 AND 1999 AND grp<>'AFRICA' GROUP BY entity, season)")
def _(spark, sf):
    totals = m.season_totals(log(spark, sf))
    games = F.when(F.pmod("entity", F.lit(7)) == 0, 0).otherwise(F.col("games"))
    old = totals.where("season <= 1997").withColumn("games", games)
    new = totals.where("season > 1997").withColumn("games", games).withColumnsRenamed(
        {"value": "fantasy_points_ppr", "value_base": "fantasy_points", "entity": "player_id"})
    return scans.multi_season_totals([schema.standardize(old), schema.standardize(new, strict=False)],
                                     [1996, 1997, 1998, 1999],
                                     ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])


@query("multi_season_game_log", ES + "period:l value:d",
       "SELECT entity, season, period, value + CASE WHEN season=1998 THEN 1 ELSE 0 END AS value "
       "FROM slog WHERE season IN (1997, 1998)")
def _(spark, sf):
    base = log(spark, sf)
    first = base.withColumn("seq", F.lit(1))
    fixed = base.where("season = 1998").withColumns({"value": F.col("value") + 1, "seq": F.lit(2)})
    return scans.multi_season_game_log([first, fixed], [1997, 1998], "seq")


@query("source_scans", "source:s rows:l first_season:l",
       "SELECT 'snap_counts' AS source, count(*) AS rows, min(season+15) AS first_season FROM slog "
       "WHERE season+15>=2012 UNION ALL SELECT 'ngs_passing', count(*), min(season+15) FROM slog "
       "WHERE season+15>=2016 UNION ALL SELECT 'players', count(*), min(season+15) FROM slog")
def _(spark, sf):
    later = log(spark, sf).withColumn("season", F.col("season") + 15)
    frames = scans.source_scans({"snap_counts": later, "ngs_passing": later, "pfr": later,
                                 "players": later}, 3)
    return scans.union_ragged(
        df.agg(F.count("*").alias("rows"), F.min("season").alias("first_season"))
        .withColumn("source", F.lit(n)) for n, df in frames.items())


@query("historical_union", "entity_name:s season:l grp:s value:d games:d",
       "SELECT entity_name, season, grp, value, games FROM ("
       "SELECT entity_name, season, grp, value, games, row_number() OVER (PARTITION BY entity_name, "
       "season ORDER BY recent, value DESC, grp DESC, games DESC) AS rn FROM ("
       "SELECT entity_name, season, grp, value, games, 0 AS recent FROM cseason WHERE season<=1999 "
       "AND entity_name<>'Customer#000000007' UNION ALL "
       "SELECT entity_name, season, grp, value/2, games, 0 FROM cseason WHERE season<=1999 "
       "AND entity_name<>'Customer#000000007' UNION ALL "
       "SELECT entity_name, season, grp, value, games, 1 FROM cseason WHERE season>=1999)) WHERE rn=1")
def _(spark, sf):
    df = a.customer_season(spark, sf).select("entity_name", "season", "grp", "value", "games")
    old = df.where("season <= 1999")
    traded = old.withColumn("value", F.col("value") / 2)
    return scans.historical_union(old.unionByName(traded), df.where("season >= 1999"),
                                  "Customer#000000007")


# -- season measures ---------------------------------------------------------------------------

@query("safe_div", ES + "period:l ratio:d",
       "SELECT *, attempts/nullif(carries,0) AS ratio FROM slog")
def _(spark, sf):
    return log(spark, sf).withColumn("ratio", safe_div("attempts", "carries"))


@query("games_played", ES + "games:l games_active:l first_period:l last_period:l team:s teams:s "
       "multi_team:b target_share:d", """
SELECT *, contains(teams, '/') AS multi_team FROM (
SELECT entity, season, count(DISTINCT period) AS games,
  count(*) FILTER (carries+targets+attempts>0) AS games_active, min(period) AS first_period,
  max(period) AS last_period, arg_max(opponent, period) AS team, avg(target_share) AS target_share,
  (SELECT string_agg(o, '/' ORDER BY p) FROM (SELECT opponent AS o, min(period) AS p FROM slog b
   WHERE b.entity=s.entity AND b.season=s.season GROUP BY opponent)) AS teams
FROM slog s GROUP BY entity, season)""")
def _(spark, sf):
    return m.games_played(log(spark, sf, True).withColumn("team", F.col("opponent")))


@query("add_scoring", ES + "points:d points_base:d points_half:d ppg:d ppg_half:d ppg_base:d",
       "SELECT * FROM sscore")
def _(spark, sf):
    return m.add_scoring(m.season_totals(log(spark, sf)))


_VOLUME = "touches opportunities scrim_yards total_yards total_tds fumbles_lost first_downs two_pt turnovers"


@query("add_volume", ES + " ".join(f"{x}:l" for x in _VOLUME.split())
       + " touch_pg:d opp_pg:d scrim_yds_pg:d total_yds_pg:d tds_pg:d", "SELECT * FROM svol")
def _(spark, sf):
    return m.add_volume(m.season_totals(log(spark, sf)))


@query("add_efficiency", ES + " ".join(f"{x}:d" for x in m.EFFICIENCY), "SELECT * FROM seff")
def _(spark, sf):
    return plan.measured(log(spark, sf))


@query("period_group_rank", ES + "period:l grp:s value:d period_rank:l", "SELECT * FROM swrank")
def _(spark, sf):
    return m.period_group_rank(log(spark, sf).select("entity", "season", "period", "grp", "value"))


_CONS = ("best_week:d worst_week:d median_week:d stdev:d floor:d ceiling:d boom_weeks:l bust_weeks:l "
         "starter_weeks:l top5_weeks:l best_group_finish:l")


@query("consistency_profile", ES + _CONS, "SELECT * FROM scons")
def _(spark, sf):
    return m.consistency_profile(log(spark, sf), S)


@query("consistency_rates", ES + "cv:d boom_rate:d bust_rate:d starter_week_rate:d",
       "SELECT * FROM sfull")
def _(spark, sf):
    lg = log(spark, sf)
    base = m.add_scoring(m.season_totals(lg)).select("entity", "season", "games", "ppg")
    return m.consistency_rates(base.join(m.consistency_profile(lg, S), m.ENTITY_SEASON))


@query("game_log", ES + "period:l entity_name:s grp:s value:d carries:l period_rank:l",
       "SELECT b.*, rank() OVER (PARTITION BY b.season, b.period, b.grp ORDER BY b.value DESC) "
       "AS period_rank FROM slog b SEMI JOIN stop t ON t.entity=b.entity AND t.season=b.season")
def _(spark, sf):
    lg = log(spark, sf)
    board = r.overall_board(m.add_scoring(m.season_totals(lg)))
    return m.game_log(lg, r.top_board(board, S.top_n))


# -- boards ------------------------------------------------------------------------------------

_RANKS = "rank:l rank_half:l rank_base:l group_rank:l rank_ppg:l group_rank_ppg:l rank_delta:l group_label:s"


@query("add_ranks", ES + _RANKS, "SELECT * FROM sranked")
def _(spark, sf):
    return r.season_ranks(totals(spark, sf), S)


@query("rank_variants", ES + "grp:s r_min:l r_first:l r_average:d r_pct:d r_asc:l", """
SELECT *, rank() OVER (PARTITION BY season, grp ORDER BY games DESC) AS r_min,
  row_number() OVER (PARTITION BY season, grp ORDER BY games DESC, entity) AS r_first,
  rank() OVER (PARTITION BY season, grp ORDER BY games DESC)
    + (count(*) OVER (PARTITION BY season, grp, games)-1)/2.0 AS r_average,
  (rank() OVER (PARTITION BY season, grp ORDER BY games DESC)
    + (count(*) OVER (PARTITION BY season, grp, games)-1)/2.0)/count(*) OVER (PARTITION BY season, grp)
    AS r_pct, rank() OVER (PARTITION BY season ORDER BY games) AS r_asc FROM cseason""")
def _(spark, sf):
    within = ("season", "grp")
    return add_ranks(a.customer_season(spark, sf), ["entity", "season"], [
        Rank("r_min", "games", within), Rank("r_first", "games", within, "first"),
        Rank("r_average", "games", within, "average"), Rank("r_pct", "games", within, "pct"),
        Rank("r_asc", "games", ("season",), descending=False)])


@query("replacement_levels", "season:l grp:s replacement_rank:l replacement_ppg:d",
       "SELECT * FROM slevel")
def _(spark, sf):
    return r.replacement_levels(totals(spark, sf), S)


@query("add_vor", ES + "replacement_ppg:d vor_ppg:d vor_total:d", "SELECT * FROM svor")
def _(spark, sf):
    return r.add_vor(totals(spark, sf), S)


@query("gap_tiers", ES + "value:d tier:l", """
SELECT *, 1 + sum(step) OVER (PARTITION BY season ORDER BY value DESC, entity
  ROWS UNBOUNDED PRECEDING) AS tier FROM (SELECT *, CASE WHEN lag(value) OVER (PARTITION BY season
  ORDER BY value DESC, entity) - value >= 5 THEN 1 ELSE 0 END AS step FROM cseason)""")
def _(spark, sf):
    return r.gap_tiers(a.customer_season(spark, sf), ["season"], "value", 5.0, ["entity", "season"])


@query("add_tiers", ES + "grp:s ppg:d tier:l",
       "SELECT sscore.*, tier FROM sscore LEFT JOIN stier ON stier.entity=sscore.entity "
       "AND stier.season=sscore.season")
def _(spark, sf):
    return r.add_tiers(totals(spark, sf), S)


def _spec(cols):
    texts = {"entity_name", "grp", "group_label", "team", "teams"}
    whole = {"season", "entity", "games", "games_active", "rank", "rank_half", "rank_base",
             "rank_ppg", "group_rank", "group_rank_ppg", "rank_delta", "tier", "boom_weeks",
             "bust_weeks", "starter_weeks", "top5_weeks", "best_group_finish",
             *COUNTERS, *_VOLUME.split()}
    return " ".join(f"{c}:{'s' if c in texts else 'l' if c in whole else 'd'}" for c in cols)


BOARD = _spec(r.BOARD_COLUMNS)


@query("overall_board", BOARD, "SELECT * FROM sboard")
def _(spark, sf):
    return r.overall_board(scored(spark, sf))


_SHORT = _spec(["season", "entity", "entity_name", "grp", "games", "points", "ppg", "rank",
                "group_rank", "vor_ppg", "tier"])


def _boards(spark, sf):
    return plan.build_season(log(spark, sf), S)


@query("group_board", _SHORT, "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season "
       "ORDER BY points DESC, entity) AS rn FROM sboard WHERE grp='ASIA') WHERE rn<=15")
def _(spark, sf):
    return _boards(spark, sf)["ASIA"]


@query("flex_board", _SHORT + " flex_rank:l", "SELECT * FROM (SELECT *, row_number() OVER "
       "(PARTITION BY season ORDER BY points DESC, entity) AS flex_rank FROM sboard "
       "WHERE grp IN ('AFRICA','ASIA','EUROPE')) WHERE flex_rank<=30")
def _(spark, sf):
    return _boards(spark, sf)["flex"]


@query("value_gainers", ES + "entity_name:s group_label:s team:s games:l points:d rank:l ppg:d "
       "rank_ppg:l rank_delta:l", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season "
       "ORDER BY rank_delta DESC NULLS LAST, entity) AS rn FROM sranked WHERE games>=4 AND games<15 "
       "AND ppg>=10) WHERE rn<=20")
def _(spark, sf):
    return r.value_gainers(r.season_ranks(totals(spark, sf), S), S)


@query("build_season", "board:s season:l rows:l points:d", """
SELECT 'overall' AS board, season, count(*) AS rows, sum(points) AS points FROM sboard GROUP BY ALL
UNION ALL SELECT 'top_n', season, count(*), sum(points) FROM stop GROUP BY ALL
UNION ALL SELECT 'flex', season, count(*), sum(points) FROM (SELECT *, row_number() OVER (PARTITION BY season
  ORDER BY points DESC, entity) AS rn FROM sboard WHERE grp IN ('AFRICA','ASIA','EUROPE')) WHERE rn<=30 GROUP BY ALL
UNION ALL SELECT 'gainers', season, count(*), sum(points) FROM (SELECT *, row_number() OVER (PARTITION BY season
  ORDER BY rank_delta DESC NULLS LAST, entity) AS rn FROM sranked WHERE games>=4 AND games<15 AND ppg>=10)
  WHERE rn<=20 GROUP BY ALL
UNION ALL SELECT 'replacement', season, count(*), sum(replacement_ppg) FROM slevel GROUP BY ALL
UNION ALL SELECT 'game_log', b.season, count(*), sum(b.value) FROM slog b
  SEMI JOIN stop t ON t.entity=b.entity AND t.season=b.season GROUP BY ALL
""" + " ".join(f"""UNION ALL SELECT '{g}', season, count(*), sum(points) FROM (SELECT *, row_number() OVER
  (PARTITION BY season ORDER BY points DESC, entity) AS rn FROM sboard WHERE grp='{g}')
  WHERE rn<={n} GROUP BY ALL""" for g, n in S.board_sizes.items()))
def _(spark, sf):
    boards = _boards(spark, sf)
    value = {"game_log": "value", "replacement": "replacement_ppg"}
    return scans.union_ragged(
        b.groupBy("season").agg(F.count("*").alias("rows"), F.sum(value.get(n, "points")).alias("points"))
        .withColumn("board", F.lit(n)) for n, b in boards.items())


@query("table_ready", "ID:l Season:l Name:s PPG:d CV:d", """
SELECT entity AS "ID", season AS "Season", CASE WHEN entity%3=0 THEN '''=' || entity_name
  WHEN entity%3=1 THEN '' ELSE entity_name END AS "Name",
  round_even(ppg, 2) AS "PPG", round_even(cv, 4) AS "CV" FROM sfull""")
def _(spark, sf):
    lg = log(spark, sf)
    base = m.add_scoring(m.season_totals(lg)).select(
        "entity", "season", "games", "ppg",
        F.when(F.pmod("entity", F.lit(3)) == 0, F.concat(F.lit("="), "entity_name"))
        .when(F.pmod("entity", F.lit(3)) == 2, F.col("entity_name")).alias("entity_name"))
    rates = m.consistency_rates(base.join(m.consistency_profile(lg, S), m.ENTITY_SEASON))
    return export.table_ready(rates.select("entity", "season", "entity_name", "ppg", "cv"))


@query("board_summary", "season:l grp:s entities:l board_size:l short:b",
       "SELECT *, sum(entities) OVER (PARTITION BY season) AS board_size, sum(entities) OVER "
       "(PARTITION BY season) < 50 AS short FROM (SELECT season, grp, count(*) AS entities "
       "FROM stop GROUP BY season, grp)")
def _(spark, sf):
    board = r.overall_board(m.add_scoring(m.season_totals(log(spark, sf))))
    return r.board_summary(r.top_board(board, S.top_n), S.top_n)


@query("external_board_merge", "name:s outside_rank:l season:l entity:l points:d",
       "SELECT * FROM (SELECT 'Supplier#' || lpad((s_suppkey*2)::VARCHAR, 9, '0') AS name, "
       "s_suppkey+1 AS outside_rank FROM supplier) x "
       "FULL JOIN sscore y ON x.name=y.entity_name")
def _(spark, sf):
    board = r.overall_board(m.add_scoring(m.season_totals(log(spark, sf))))
    key = F.lpad((F.col("s_suppkey") * 2).cast("string"), 9, "0")
    outside = a.table(spark, sf, "supplier").select(
        F.concat(F.lit("Supplier#"), key).alias("name"), (F.col("s_suppkey") + 1).alias("outside_rank"))
    return r.external_board_merge(outside, board)


@query("dropoff_curve", "season:l grp:s entity:l group_rank:l ppg:d",
       "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season, grp ORDER BY points DESC, "
       "entity) AS rn FROM sranked WHERE ppg IS NOT NULL) WHERE rn<=48")
def _(spark, sf):
    ranked = r.season_ranks(totals(spark, sf), S)
    return r.dropoff_curve(ranked, ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])


@query("risk_quadrant", ES + "grp:s ppg:d stdev:d ppg_line:d stdev_line:d high_value:b high_spread:b",
       "SELECT *, ppg>=ppg_line AS high_value, stdev>=stdev_line AS high_spread FROM ("
       "SELECT *, median(ppg) OVER (PARTITION BY season) AS ppg_line, median(stdev) OVER "
       "(PARTITION BY season) AS stdev_line FROM (SELECT *, row_number() OVER (PARTITION BY season "
       "ORDER BY points DESC, entity) AS rn FROM sfull WHERE games>=4) WHERE rn<=41)")
def _(spark, sf):
    lg = log(spark, sf)
    base = m.add_scoring(m.season_totals(lg)).join(m.consistency_profile(lg, S), m.ENTITY_SEASON)
    return r.risk_quadrant(base, S.min_games, 41)
