"""League queries: blocks of twenty customers form a league, their segment is the group."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.records import stage
from ..operators import leagues as lg
from ..sources import adapters as a
from .base import cte, query

GRP = ("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'QB' WHEN 'BUILDING' THEN 'RB' WHEN 'FURNITURE' THEN 'WR' "
       "WHEN 'HOUSEHOLD' THEN 'TE' ELSE 'K' END")
SLOTS = ["QB", "RB", "RB", "WR", "WR", "TE", "FLEX", "K", "BN", "BN"]

cte("lroster", f"""
SELECT 'L' || (c_custkey//20) AS league_id, c_custkey::VARCHAR AS foreign_id, CASE WHEN c_custkey%4<>3 THEN c_custkey END AS entity,
 CASE WHEN c_custkey%4<>3 THEN c_name ELSE upper(c_name) END AS entity_name, {GRP} AS grp, c_custkey%3=0 AS is_starter,
 c_custkey%17=0 AS is_ir, c_custkey%19=0 AS is_taxi, CASE WHEN (c_custkey//20)%2=0 THEN 1.0 ELSE 0.5 END AS rec,
 round_even(c_acctbal/100, 1) AS proj_points, (c_custkey%5)::DOUBLE AS receptions_ma3 FROM customer""")


def people(spark, sf):
    c = a.table(spark, sf, "customer")
    return c.selectExpr("*", "concat('L', CAST(c_custkey div 20 AS STRING)) AS league_id",
                        "CAST(c_custkey AS STRING) AS foreign_id", f"{GRP} AS grp")


def landed(spark, sf):
    """League, roster, user and player objects as the source would land them."""
    c = people(spark, sf)
    ids = c.select("league_id").distinct()
    rec = F.when(F.substring("league_id", 2, 9).cast("int") % 2 == 0, 1.0).otherwise(0.5)
    leagues = ids.select("league_id", F.concat(F.lit("League "), "league_id").alias("name"),
                         F.array(*[F.lit(s) for s in SLOTS]).alias("roster_positions"),
                         F.create_map(F.lit("rec"), rec).alias("scoring_settings"))

    def those(cond):
        return F.collect_list(F.when(F.expr(cond), F.col("foreign_id")))

    rosters = c.groupBy("league_id").agg(
        F.collect_list("foreign_id").alias("players"), those("c_custkey % 3 = 0").alias("starters"),
        those("c_custkey % 17 = 0").alias("reserve"), those("c_custkey % 19 = 0").alias("taxi")
    ).withColumn("owner_id", F.lit("111"))
    users = ids.select("league_id", F.lit("111").alias("user_id"), F.lit("Owner").alias("display_name"),
                       F.struct(F.lit("The Owners").alias("team_name")).alias("metadata"))
    players = c.select("foreign_id", F.upper("c_name").alias("full_name"), F.col("grp").alias("position"),
                       F.lit("").alias("team"))
    known = c.where("c_custkey % 4 <> 3").select(
        F.col("c_custkey").alias("entity"), "foreign_id", F.col("c_name").alias("name"), "grp",
        F.lit("T").alias("team"))
    return leagues, rosters, users, players, known


def rosters(spark, sf):
    return stage(lg.league_rosters(*landed(spark, sf), owner="111"))


def board(spark, sf, rows=None):
    rows = rosters(spark, sf) if rows is None else rows
    c = people(spark, sf).select("foreign_id", F.bround(F.col("c_acctbal") / 100, 1).alias("proj_points"),
                                 (F.col("c_custkey") % 5).cast("double").alias("receptions_ma3"))
    return lg.scoring_adjust(rows.join(c, "foreign_id"), ("proj_points",))


def lineups(spark, sf, rows=None):
    rows = rosters(spark, sf) if rows is None else rows
    slots = rows.select("league_id", "slots").dropDuplicates(["league_id"])
    return stage(lg.best_lineup(lg.startable(board(spark, sf, rows)).drop("slots"), slots))


@query("id_crosswalk", "foreign_id:s entity:l", "SELECT (c_custkey//2)::VARCHAR AS foreign_id, min(c_custkey) AS entity "
       "FROM customer WHERE c_custkey%5<>0 GROUP BY c_custkey//2")
def _(spark, sf):
    raw = F.when(F.col("c_custkey") % 5 != 0, F.expr("CAST(c_custkey div 2 AS DOUBLE)"))
    return lg.id_crosswalk(people(spark, sf).select(raw.alias("foreign_id"), F.col("c_custkey").alias("entity")))


@query("league_rosters", "league_id:s foreign_id:s entity:l entity_name:s grp:s is_starter:b is_ir:b is_taxi:b rec:d",
       "SELECT * FROM lroster")
def _(spark, sf):
    return rosters(spark, sf)


_ADJ = "CASE WHEN rec=1 THEN proj_points ELSE round_even(greatest(0, proj_points-receptions_ma3*(1-rec)), 1) END"


@query("scoring_adjust", "league_id:s foreign_id:s proj_points:d",
       f"SELECT league_id, foreign_id, {_ADJ} AS proj_points FROM lroster")
def _(spark, sf):
    return board(spark, sf)


cte("lpool", f"SELECT *, row_number() OVER (PARTITION BY league_id, grp ORDER BY pts DESC, foreign_id) AS rn FROM (SELECT *, {_ADJ} "
    "AS pts FROM lroster WHERE grp<>'K' AND NOT is_ir AND NOT is_taxi)")
cte("lflex", "SELECT league_id, pts, row_number() OVER (PARTITION BY league_id ORDER BY pts DESC) AS fr "
    "FROM lpool WHERE (grp IN ('RB','WR') AND rn>2) OR (grp='TE' AND rn>1)")


@query("best_lineup", "league_id:s filled:l total:d bench:l", """
SELECT p.league_id, count(*) FILTER (base)+count(any_flex)//greatest(count(*),1) AS filled, sum(CASE WHEN base THEN pts ELSE 0 END)
 + coalesce(any_value(any_flex),0) AS total, count(*)-count(*) FILTER (base)-count(any_flex)//greatest(count(*),1) AS bench
FROM (SELECT *, CASE WHEN grp IN ('RB','WR') THEN rn<=2 ELSE rn<=1 END AS base FROM lpool) p
LEFT JOIN (SELECT league_id, pts AS any_flex FROM lflex WHERE fr=1) f ON f.league_id=p.league_id GROUP BY p.league_id""")
def _(spark, sf):
    rows = lineups(spark, sf)
    starter = F.col("status") == "starter"
    return rows.groupBy("league_id").agg(
        F.count_if(starter).alias("filled"), F.sum(F.when(starter, F.col("proj_points"))).alias("total"),
        F.count_if(F.col("status") == "bench").alias("bench"))


# the flexible slot takes the best left over; of equal totals the later group's
cte("lline", """
SELECT p.league_id, p.foreign_id, p.pts, CASE WHEN base THEN p.grp WHEN fr=1 THEN 'FLEX' END AS slot FROM (SELECT *,
 CASE WHEN grp IN ('RB','WR') THEN rn<=2 ELSE rn<=1 END AS base FROM lpool) p LEFT JOIN (SELECT league_id, foreign_id,
 row_number() OVER (PARTITION BY league_id ORDER BY pts DESC, grp DESC, rn) AS fr FROM lpool
 WHERE grp<>'QB' AND ((grp IN ('RB','WR') AND rn>2) OR (grp='TE' AND rn>1))) f
 ON f.league_id=p.league_id AND f.foreign_id=p.foreign_id""")


@query("lineup_slots", "league_id:s slot:s foreign_id:s status:s proj_points:d", """
SELECT l.league_id, n.slot, foreign_id, CASE WHEN foreign_id IS NULL THEN 'empty' ELSE 'starter' END AS status, pts AS proj_points
FROM (SELECT DISTINCT league_id FROM lroster) l CROSS JOIN (VALUES ('QB', 1), ('RB', 1), ('RB', 2), ('WR', 1), ('WR', 2),
 ('TE', 1), ('FLEX', 1)) n(slot, k) LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY league_id, slot ORDER BY pts DESC,
 foreign_id) AS k FROM lline WHERE slot IS NOT NULL) s ON s.league_id=l.league_id AND s.slot=n.slot AND s.k=n.k
UNION ALL SELECT league_id, NULL, foreign_id, 'bench', pts FROM lline WHERE slot IS NULL""")
def _(spark, sf):
    return lineups(spark, sf)


cte("lpass", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY league_id ORDER BY is_starter DESC, foreign_id) AS rn FROM lroster "
    "WHERE grp='K' AND NOT is_ir AND NOT is_taxi) WHERE rn=1")


@query("passthrough_slots", "league_id:s slot:s foreign_id:s is_starter:b", "SELECT *, 'K' AS slot FROM lpass")
def _(spark, sf):
    return lg.passthrough_slots(rosters(spark, sf))


def recommended(rows, passed):
    cols = ["league_id", "foreign_id", "entity_name"]
    return rows.where("status = 'starter'").select(*cols).unionByName(passed.select(*cols))


cte("lwant", "SELECT league_id, foreign_id FROM lline WHERE slot IS NOT NULL UNION SELECT league_id, foreign_id FROM lpass")
cte("lnow", "SELECT league_id, foreign_id FROM lroster WHERE is_starter")


@query("swap_list", "league_id:s foreign_id:s action:s", "SELECT *, 'START' AS action FROM (FROM lwant EXCEPT FROM lnow) "
       "UNION ALL SELECT *, 'BENCH' FROM (FROM lnow EXCEPT FROM lwant)")
def _(spark, sf):
    r = rosters(spark, sf)
    return lg.swap_list(recommended(lineups(spark, sf, r), lg.passthrough_slots(r)), r)


@query("league_export", "league_id:s slug:s rows:l starters:l", """
SELECT league_id, 'league_' || lower(league_id) AS slug, count(*) AS rows, count(*) FILTER (starter) AS starters FROM (
 SELECT league_id, slot IS NOT NULL AS starter FROM lline UNION ALL SELECT league_id, true FROM lpass) GROUP BY league_id""")
def _(spark, sf):
    r = rosters(spark, sf)
    out = lg.league_export(lineups(spark, sf, r), lg.passthrough_slots(r), r)
    return out.groupBy("league_id", "slug").agg(
        F.count("*").alias("rows"), F.count_if(F.col("status") == "starter").alias("starters"))
