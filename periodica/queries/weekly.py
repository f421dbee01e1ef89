"""In-season queries over the supplier log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.records import stage
from ..operators import metrics as m
from ..operators import weekly as w
from ..plans import weekly as pw
from ..settings import SUPPLIERS
from ..sources import adapters as a
from .base import cte, query, settings_rows
from .panel import slog

ESP = "entity:l season:l period:l "
CODES = [-1, 0, 1, 2, 3]
EVAL = [1996, 1997, 1998, 1999, 2000, 2001]
GROUPS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

cte("wmatch", """
SELECT def_team, season, period, grp, avg(v) OVER (PARTITION BY def_team, season, grp ORDER BY period
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opp_allowed_avg FROM (SELECT opponent AS def_team, season, period, grp,
 sum(value) AS v FROM slog WHERE opponent IS NOT NULL GROUP BY ALL)""")
cte("wflag", f"""
SELECT slog.*, (value>=coalesce(boom,20))::INT AS bf, (value<=coalesce(bust,10))::INT AS uf, coalesce(code,-1) AS grp_code
FROM slog LEFT JOIN {settings_rows(SUPPLIERS.boom_bust, 'wb(g5, boom, bust)')} ON g5=grp
LEFT JOIN {settings_rows(SUPPLIERS.group_codes, 'wc(g6, code)')} ON g6=grp""")
_FORM = """
SELECT *, lag1-ma3 AS trend, (period-1)/16.0::DOUBLE AS period_norm, round(std5/greatest(coalesce(ma5,0),3), 6) AS cv5
FROM (SELECT *, lag(value) OVER o AS lag1, avg(value) OVER w3 AS ma3, avg(value) OVER w5 AS ma5, avg(value) OVER w17 AS season_avg,
 avg(targets) OVER w3 AS targets_ma3, avg(carries) OVER w3 AS carries_ma3, avg(receptions) OVER w3 AS receptions_ma3,
 avg(target_share) OVER w3 AS target_share_ma3, row_number() OVER o - 1 AS games_played,
 coalesce(stddev_samp(value) OVER w3, 0) AS std3, coalesce(stddev_samp(value) OVER w5, 0) AS std5,
 coalesce(avg(bf) OVER w5, 0) AS boom_rate5, coalesce(avg(uf) OVER w5, 0) AS bust_rate5
FROM {src} WINDOW o AS (PARTITION BY entity, season ORDER BY period),
 w3 AS (PARTITION BY entity, season ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
 w5 AS (PARTITION BY entity, season ORDER BY period ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
 w17 AS (PARTITION BY entity, season ORDER BY period ROWS BETWEEN 17 PRECEDING AND 1 PRECEDING))"""
cte("wform", _FORM.format(src="wflag"))
cte("wpanel", """
SELECT f.*, value AS target, opp_allowed_avg, s.value_sum/s.games AS prior_ppg, s.games AS prior_games FROM wform f
LEFT JOIN wmatch m ON m.def_team=f.opponent AND m.season=f.season AND m.period=f.period AND m.grp=f.grp
LEFT JOIN (SELECT entity, season, sum(value) AS value_sum, count(DISTINCT period) AS games FROM slog GROUP BY ALL) s
 ON s.entity=f.entity AND s.season=f.season-1 WHERE games_played>=1""")


def _pct(c):
    return (f"(rank() OVER (PARTITION BY grp ORDER BY {c})+(count(*) OVER (PARTITION BY grp, {c})-1)/2.0)"
            f"/count(*) OVER (PARTITION BY grp)")


cte("wvar", f"SELECT *, round_even(round(50.0*({_pct('cv5')}+{_pct('boom_rate5')})::DOUBLE, 6), 1) AS explosiveness FROM wpanel")


def log(spark, sf):
    return slog(spark, sf, True)


def panel(spark, sf):
    lg = log(spark, sf)
    return stage(w.weekly_panel(lg, SUPPLIERS, w.matchup_table(lg), m.season_totals(lg)))


def scored(spark, sf):
    return stage(w.variance_features(panel(spark, sf)))


@query("matchup_table", "def_team:s season:l period:l grp:s opp_allowed_avg:d", "SELECT * FROM wmatch")
def _(spark, sf):
    return w.matchup_table(a.supplier_log(spark, sf, True))


_F = " ".join(f"{c}:{'l' if c in ('games_played', 'grp_code') else 'd'}" for c in w.FEATURES)


@query("weekly_panel", ESP + "target:d " + _F, "SELECT * FROM wpanel")
def _(spark, sf):
    return panel(spark, sf)


@query("weekly_feature_matrix", ESP + " ".join(c + ":d" for c in w.FEATURES),
       "SELECT entity, season, period, " + ", ".join(f"coalesce({c},0) AS {c}" for c in w.FEATURES) + " FROM wpanel")
def _(spark, sf):
    return w.weekly_feature_matrix(panel(spark, sf))


_UP = _FORM.format(src="(SELECT * FROM wflag WHERE season={s} AND period<{p} UNION ALL BY NAME SELECT entity, {s} AS season, "
                       "{p} AS period, any_value(grp) AS grp, any_value(grp_code) AS grp_code FROM wflag "
                       "WHERE season={s} AND period<{p} GROUP BY entity)")


def _upcoming_sql(s, p):
    return f"SELECT * FROM ({_UP.format(s=s, p=p)}) WHERE period={p}"


def schedule(spark, sf):
    n = a.table(spark, sf, "nation")
    return n.select(F.col("n_name").alias("team"),
                    F.concat(F.lit("NATION_"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("opponent"))


@query("upcoming_rows", ESP + _F, f"""
SELECT u.*, opp_allowed_avg, pv/pg AS prior_ppg, pg AS prior_games FROM ({_upcoming_sql(2000, 9)}) u
JOIN (SELECT DISTINCT entity, team AS t2 FROM slog) t ON t.entity=u.entity JOIN nation ON n_name=t2
LEFT JOIN (SELECT opponent AS dt, grp, avg(v) AS opp_allowed_avg FROM (SELECT opponent, grp, period, sum(value) AS v FROM slog
 WHERE season=2000 AND period<9 GROUP BY ALL) GROUP BY ALL) x ON dt='NATION_' || ((n_nationkey+1)%25) AND x.grp=u.grp
LEFT JOIN (SELECT entity, sum(value) AS pv, count(DISTINCT period) AS pg FROM slog WHERE season=1999 GROUP BY entity) y
 ON y.entity=u.entity""")
def _(spark, sf):
    lg = log(spark, sf)
    return w.upcoming_rows(lg, 2000, 9, SUPPLIERS, schedule(spark, sf), m.season_totals(lg))


@query("variance_features", ESP + "std3:d std5:d cv5:d boom_rate5:d bust_rate5:d explosiveness:d", "SELECT * FROM wvar")
def _(spark, sf):
    return scored(spark, sf)


@query("variance_snapshot", "entity:l std5:d cv5:d boom_rate5:d bust_rate5:d", _upcoming_sql(2000, 9))
def _(spark, sf):
    return w.variance_snapshot(log(spark, sf), 2000, 9, SUPPLIERS)


cte("wref", "SELECT * FROM wpanel WHERE games_played>=3")


@query("score_scaler", "grp:s measure:s v:d rows:l", "SELECT grp, 'cv5' AS measure, cv5 AS v, count(*) AS rows FROM wref "
       "GROUP BY ALL UNION ALL SELECT grp, 'boom_rate5', boom_rate5, count(*) FROM wref GROUP BY ALL")
def _(spark, sf):
    return w.score_scaler(panel(spark, sf))


cte("wnew", f"SELECT entity, CASE WHEN entity%10=0 THEN 'NOWHERE' ELSE grp END AS grp, cv5, boom_rate5 FROM ({_upcoming_sql(2000, 9)})")


@query("score_explosiveness", "entity:l explosiveness:d", """
SELECT n.entity, coalesce(round_even(round(50.0*(count(*) FILTER (r.cv5<=n.cv5)/nullif(count(r.cv5),0)
 + count(*) FILTER (r.boom_rate5<=n.boom_rate5)/nullif(count(r.cv5),0)), 6), 1), 50) AS explosiveness
FROM wnew n LEFT JOIN wref r ON r.grp=n.grp GROUP BY n.entity""")
def _(spark, sf):
    p = panel(spark, sf)
    new = w.upcoming_rows(log(spark, sf), 2000, 9, SUPPLIERS).withColumn(
        "grp", F.when(F.pmod("entity", F.lit(10)) == 0, "NOWHERE").otherwise(F.col("grp")))
    return w.score_explosiveness(stage(new.select("entity", "grp", "cv5", "boom_rate5")), w.score_scaler(p), ["entity"])


cte("wcut", "SELECT grp, quantile_cont(explosiveness, 1/3::DOUBLE) AS lo, quantile_cont(explosiveness, 2/3::DOUBLE) AS hi, "
    "min(explosiveness) AS e0, max(explosiveness) AS e3 FROM wvar GROUP BY grp")


@query("tercile_thresholds", "grp:s lo:d hi:d", "SELECT * FROM wcut")
def _(spark, sf):
    return w.tercile_thresholds(scored(spark, sf))


cte("wband", "SELECT v.*, CASE WHEN explosiveness<lo THEN 'Low' WHEN explosiveness>hi THEN 'High' ELSE 'Medium' END AS risk_tier, "
    "CASE WHEN e0<lo AND lo<hi AND hi<e3 THEN CASE WHEN explosiveness<=lo THEN 'Low' WHEN explosiveness<=hi THEN 'Medium' "
    "ELSE 'High' END ELSE 'Medium' END AS tercile FROM wvar v JOIN wcut c ON c.grp=v.grp")


@query("apply_tercile", ESP + "risk_tier:s", "SELECT * FROM wband")
def _(spark, sf):
    p = scored(spark, sf)
    return w.apply_tercile(p, w.tercile_thresholds(p))


@query("explosiveness_tercile", ESP + "tercile:s", "SELECT * FROM wband")
def _(spark, sf):
    return w.explosiveness_tercile(scored(spark, sf))


@query("risk_bands", ESP + "risk_tier:s floor:d ceiling:d", """
SELECT entity, season, period, risk_tier, round_even(greatest(0, round(lag1,1)+CASE risk_tier WHEN 'Low' THEN -5.21::DOUBLE WHEN 'Medium'
 THEN -5.64::DOUBLE ELSE -6.26::DOUBLE END), 1) AS floor, round_even(round(lag1,1)+CASE risk_tier WHEN 'Low' THEN 6.32::DOUBLE
 WHEN 'Medium' THEN 5.20::DOUBLE ELSE 6.47::DOUBLE END, 1) AS ceiling FROM wband""")
def _(spark, sf):
    p = scored(spark, sf)
    return w.risk_bands(p.withColumn("proj_points", F.round("lag1", 1)), w.tercile_thresholds(p))


def _rk(c, part):
    return f"rank() OVER (PARTITION BY {part} ORDER BY {c})+(count(*) OVER (PARTITION BY {part}, {c})-1)/2.0"


@query("variance_persistence", "grp:s n:l spearman_r:d", f"""
SELECT grp, count(*) AS n, CASE WHEN count(*)>=8 THEN corr(ra, rb) END AS spearman_r FROM (SELECT grp, {_rk('f', 'grp')} AS ra,
 {_rk('s', 'grp')} AS rb FROM (SELECT entity, season, grp,
 round(stddev_samp(target) FILTER (i<=n//2)/greatest(avg(target) FILTER (i<=n//2),3), 6) AS f,
 round(stddev_samp(target) FILTER (i>n//2)/greatest(avg(target) FILTER (i>n//2),3), 6) AS s FROM (SELECT *,
  count(*) OVER (PARTITION BY entity, season) AS n, row_number() OVER (PARTITION BY entity, season ORDER BY period) AS i FROM wpanel)
 WHERE n>=10 GROUP BY entity, season, grp) WHERE f IS NOT NULL AND s IS NOT NULL) GROUP BY grp""")
def _(spark, sf):
    return w.variance_persistence(panel(spark, sf))


_BLEND = ("(0.5*lag1+0.3*CASE WHEN ma3=0 THEN lag1 ELSE ma3 END+0.2*CASE WHEN season_avg=0 THEN CASE WHEN ma3=0 THEN lag1 "
          "ELSE ma3 END ELSE season_avg END)")
cte("wbase", f"SELECT *, season*100+period AS fold, {_BLEND} AS blend FROM wpanel")
cte("wrun", """
SELECT fold, sum(n) OVER b AS train_rows, sum(r) OVER b/sum(n) OVER b AS shift FROM (SELECT fold, count(*) AS n,
 sum(target-blend) AS r FROM wbase GROUP BY fold) WINDOW b AS (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
cte("wallow", """
SELECT grp_code, fold, sum(s) OVER b/nullif(sum(c) OVER b,0) AS allowed FROM (SELECT grp_code, fold, count(opp_allowed_avg) AS c,
 sum(opp_allowed_avg) AS s FROM wbase GROUP BY ALL)
WINDOW b AS (PARTITION BY grp_code ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
cte("wpred", """
SELECT b.*, train_rows, greatest(0, ma3) AS f_rolling_mean, greatest(0, season_avg) AS f_season_avg,
 greatest(0, blend+coalesce(shift,0)) AS f_weighted_rolling, greatest(0, season_avg*CASE WHEN opp_allowed_avg>0 AND allowed>0
 THEN least(1.6, greatest(0.6, opp_allowed_avg/allowed)) ELSE 1 END) AS f_opponent_adjusted
FROM wbase b JOIN wrun r ON r.fold=b.fold JOIN wallow l ON l.fold=b.fold AND l.grp_code=b.grp_code""")
cte("wcv", "SELECT *, abs(predicted-actual) AS abs_error, predicted-actual AS error, (predicted-actual)*(predicted-actual) AS sq_error, "
    "abs(baseline-actual) AS baseline_abs_error FROM (" + " UNION ALL ".join(
        f"SELECT '{b}' AS model, p.entity, p.season AS eval_season, period, grp, target AS actual, ma3 AS baseline, f_{b} AS predicted "
        f"FROM wpred p JOIN wtop t ON t.entity=p.entity AND t.season=p.season WHERE games_played>=2 "
        f"AND train_rows>=200" for b in pw.BASELINES) + ")")
cte("wtop", "SELECT entity, season+1 AS season FROM (SELECT entity, season, row_number() OVER (PARTITION BY season ORDER BY "
    "sum(target) DESC, entity) AS rn FROM wpanel GROUP BY entity, season) WHERE rn<=60")

for _b in pw.BASELINES:
    @query("weekly_" + _b, ESP + "predicted:d", f"SELECT *, f_{_b} AS predicted FROM wpred WHERE train_rows>0")
    def _(spark, sf, b=_b):
        return pw.with_baselines(panel(spark, sf)).where("train_rows > 0").withColumn("predicted", F.col("f_" + b))


def cv(spark, sf, p=None):
    p = panel(spark, sf) if p is None else p
    return stage(pw.weekly_walk_forward(p, EVAL, CODES, 60, models=pw.BASELINES))


@query("weekly_walk_forward", "model:s entity:l eval_season:l period:l grp:s actual:d predicted:d baseline:d abs_error:d "
       "baseline_abs_error:d", "SELECT * FROM wcv")
def _(spark, sf):
    return cv(spark, sf)


@query("weekly_summary", "model:s mae:d rmse:d bias:d pearson_r:d skill:d n:l", "SELECT model, avg(abs_error) AS mae, "
       "sqrt(avg(sq_error)) AS rmse, avg(error) AS bias, corr(actual, predicted) AS pearson_r, "
       "1-avg(abs_error)/avg(baseline_abs_error) AS skill, count(*) AS n FROM wcv GROUP BY model")
def _(spark, sf):
    return pw.weekly_summary(cv(spark, sf))


def _pivot(c, values):
    return "SELECT model, " + ", ".join(f"avg(abs_error) FILTER ({c}={v!r}) AS \"{v}\"" for v in values) + " FROM wcv GROUP BY model"


@query("weekly_by_group", "model:s " + " ".join(g.replace(" ", "_") + ":d" for g in GROUPS),
       _pivot("grp", GROUPS).replace('"MIDDLE EAST"', '"MIDDLE_EAST"'))
def _(spark, sf):
    return pw.weekly_by_group(cv(spark, sf), GROUPS).withColumnRenamed("MIDDLE EAST", "MIDDLE_EAST")


@query("weekly_by_period", "model:s " + " ".join(f"{k}:d" for k in range(3, 13)), _pivot("period", range(3, 13)))
def _(spark, sf):
    return pw.weekly_by_period(cv(spark, sf), list(range(3, 13)))


@query("boom_accuracy", "model:s precision:d recall:d f1:d boom_n:l", """
SELECT model, coalesce(tp/nullif(tp+fp,0),0) AS precision, coalesce(tp/nullif(tp+fn,0),0) AS recall,
 coalesce(2*tp/nullif(2*tp+fp+fn,0),0) AS f1, tp+fn AS boom_n FROM (SELECT model,
 count(*) FILTER (actual>=300 AND predicted>=300) AS tp, count(*) FILTER (actual<300 AND predicted>=300) AS fp,
 count(*) FILTER (actual>=300 AND predicted<300) AS fn FROM wcv GROUP BY model)""")
def _(spark, sf):
    return pw.boom_accuracy(cv(spark, sf), 300.0)


@query("variance_vs_error", "model:s n:l spearman_r:d", f"""
SELECT model, count(*) AS n, corr(ra, rb) AS spearman_r FROM (SELECT model, {_rk('explosiveness', 'model')} AS ra,
 {_rk('e', 'model')} AS rb FROM (SELECT model, explosiveness, round(abs_error, 6) AS e FROM wcv c JOIN wvar v ON v.entity=c.entity
 AND v.season=c.eval_season AND v.period=c.period)) GROUP BY model""")
def _(spark, sf):
    p = scored(spark, sf)
    return w.variance_vs_error(cv(spark, sf, p).withColumn("abs_error", F.round("abs_error", 6)), p)


cte("wcal", """
SELECT tercile, count(*) AS n, round_even(round(quantile_cont(actual-predicted, 0.2), 8), 2) AS floor_offset,
 round_even(round(quantile_cont(actual-predicted, 0.8), 8), 2) AS ceiling_offset FROM wcv c JOIN wband v ON v.entity=c.entity
 AND v.season=c.eval_season AND v.period=c.period GROUP BY tercile""")


@query("calibrate_bands", "tercile:s n:l floor_offset:d ceiling_offset:d", "SELECT * FROM wcal")
def _(spark, sf):
    p = scored(spark, sf)
    return w.calibrate_bands(cv(spark, sf, p), p)


@query("coverage", "n:l coverage:d", "SELECT count(*) AS n, avg((actual-predicted BETWEEN floor_offset-1e-9 AND ceiling_offset+1e-9)::INT) "
       "AS coverage FROM wcv c JOIN wband v ON v.entity=c.entity AND v.season=c.eval_season AND v.period=c.period "
       "JOIN wcal k ON k.tercile=v.tercile")
def _(spark, sf):
    p = scored(spark, sf)
    c = cv(spark, sf, p)
    return w.coverage(c, p, w.calibrate_bands(c, p))


# -- learned models and projections ------------------------------------------------------------

@query("weekly_ridge", ESP + "target:d f_ridge:d")
def _(spark, sf):
    return pw.weekly_ridge(panel(spark, sf), CODES).where("f_ridge IS NOT NULL")


@query("weekly_trees", ESP + "target:d predicted:d")
def _(spark, sf):
    rows = panel(spark, sf)
    folds = sorted(r[0] for r in rows.select(pw.fold_key()).distinct().collect())[1:]
    return pw.weekly_trees(rows, folds).where("predicted IS NOT NULL")


def bundle(spark, sf):
    return pw.fit_weekly_bundle(log(spark, sf), SUPPLIERS, CODES)


@query("fit_weekly_bundle", "fold:l intercept:d n_coef:l")
def _(spark, sf):
    return bundle(spark, sf).fit.withColumn("n_coef", F.size("coef"))


_BOARD = "entity:l entity_name:s grp:s proj_points:d floor:d ceiling:d explosiveness:d risk_tier:s data_source:s"


@query("project_entities", _BOARD)
def _(spark, sf):
    return pw.project_entities(bundle(spark, sf), 2001, 9)


@query("projection_features", "entity:l lag1:d ma3:d prior_ppg:d games_played:l data_source:s", f"""
SELECT entity, lag1, ma3, pv/pg AS prior_ppg, games_played, 'current_season' AS data_source FROM ({_upcoming_sql(2001, 2)}) u
LEFT JOIN (SELECT entity AS e, sum(value) AS pv, count(DISTINCT period) AS pg FROM slog WHERE season=2000 GROUP BY entity) ON e=entity
UNION ALL SELECT entity, v, v, v, 0, 'prior_season_only' FROM (SELECT entity, sum(value)/count(DISTINCT period) AS v FROM slog
 WHERE season=2000 GROUP BY entity HAVING count(DISTINCT period)>=4) WHERE entity NOT IN (SELECT entity FROM slog WHERE season=2001 AND period<2)""")
def _(spark, sf):
    return pw.projection_features(bundle(spark, sf), 2001, 2)


@query("lineup_board", _BOARD)
def _(spark, sf):
    return pw.lineup_board(bundle(spark, sf), 2001)


@query("compare_entities", "entity_name_a:s entity_name_b:s higher_floor:s higher_ceiling:s")
def _(spark, sf):
    return w.compare_entities(pw.lineup_board(bundle(spark, sf), 2001), "SUPPLIER#000000001", "#000000004")
