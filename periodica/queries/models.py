"""Model and back-test queries over the customer season panel."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.records import stage, unstage
from ..functions.stats import normal_cdf, normal_cdf_sql, normal_crps
from ..models import closed, pooled, ridge
from ..operators import panel as p
from ..operators import scoring as s
from ..operators import tiers as t
from ..plans import backtest as bt
from ..settings import CUSTOMERS
from .base import CTES, cte, query
from .panel import _letters, births, cpanel, cseason, customer_sources, rankings

ES = "entity:l season:l "
GROUPS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
EVAL = [1999, 2000, 2001]
CODES = [-1, 0, 1, 2, 3]
FOUR = closed.CLOSED_FORM[:4]
LAGS = ["career_season", "exp_smooth", "games_lag1", "games_lag2", "ppg_lag1", "ppg_lag2", "trend_1",
        "trend_2", "value_lag1", "value_lag2", "value_lag3"]

cte("cmp", "SELECT c.*, e.consensus_rank, e.consensus_projection FROM cpanel c LEFT JOIN cecr e "
    "ON e.entity=c.entity AND e.season=c.season")
cte("cfold", "SELECT DISTINCT season AS fold FROM cmp")
cte("ctrain", "SELECT fold, cmp.* FROM cfold JOIN cmp ON season<fold")
cte("mgm", "SELECT fold, grp_code, avg(target) AS gm FROM ctrain GROUP BY ALL")
cte("mall", "SELECT fold, avg(target) AS am, count(DISTINCT season) AS ts FROM ctrain GROUP BY fold")


def _smooth(alpha):
    parts = [("value_lag1", alpha), ("value_lag2", f"{alpha}*(1-{alpha})"),
             ("value_lag3", f"{alpha}*(1-{alpha})*(1-{alpha})")]
    num = "+".join(f"coalesce({c}*({w}),0)" for c, w in parts)
    den = "+".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w} END" for c, w in parts)
    return f"(({num})/({den}))"


_SSE = f"round(sum(({_smooth('a')}-target)*({_smooth('a')}-target)), 4)"
for _i, _step in enumerate(closed.STEPS):
    _wide = closed.STEPS[_i - 1]
    _span = "SELECT fold, 0.05 AS lo, 0.95 AS hi FROM cfold" if not _i else (
        f"SELECT fold, greatest(0.05, alpha-{_wide}) AS lo, least(0.95, alpha+{_wide}) AS hi FROM malpha{_i}")
    cte(f"malpha{_i + 1}", f"""
SELECT fold, arg_min(a, (e, a)) AS alpha FROM (SELECT t.fold, a, {_SSE} AS e FROM ctrain t JOIN (SELECT fold, unnest(
 list_transform(range(0, CAST(round((hi-lo)/{_step}) AS BIGINT)+1), lambda k: round(CAST(lo AS DOUBLE)+{_step}::DOUBLE*k, 5))) AS a
 FROM ({_span})) g ON g.fold=t.fold GROUP BY ALL) GROUP BY fold""")
cte("mrtm", """
SELECT fold, grp_code, avg(value_lag1) AS mu_x, avg(target) AS mu_y, CASE WHEN count(*)<2 OR var_samp(value_lag1)=0
 THEN 1 ELSE greatest(0, least(1.5, covar_samp(target, value_lag1)/var_samp(value_lag1))) END AS beta
FROM ctrain GROUP BY ALL""")
cte("mmk", """
SELECT fold, grp_code, regr_slope(target, lx) AS sl, regr_intercept(target, lx) AS ic, count(*) AS n FROM
 (SELECT *, ln(1+greatest(consensus_rank,1)) AS lx FROM ctrain WHERE consensus_rank IS NOT NULL) GROUP BY ALL""")
cte("mmka", """
SELECT fold, regr_slope(target, lx) AS sl, regr_intercept(target, lx) AS ic, count(*) AS n FROM
 (SELECT *, ln(1+greatest(consensus_rank,1)) AS lx FROM ctrain WHERE consensus_rank IS NOT NULL) GROUP BY ALL""")
cte("mwide", f"""
SELECT c.*, ts, value_lag1 AS f_random_walk, coalesce(gm, am) AS f_group_mean, coalesce({_smooth('alpha')}, value_lag1) AS f_exp_smoothing,
 greatest(0, mu_y + beta*(value_lag1-mu_x)) AS f_regression_to_mean,
 CASE WHEN consensus_rank IS NULL THEN value_lag1 ELSE greatest(0, CASE WHEN k.n>=20 THEN k.ic+k.sl*ln(1+consensus_rank)
  WHEN a.n>=50 THEN a.ic+a.sl*ln(1+consensus_rank) ELSE 150-0.5*ln(1+consensus_rank) END) END AS f_market_consensus
FROM cmp c LEFT JOIN mgm g ON g.fold=c.season AND g.grp_code=c.grp_code LEFT JOIN mall m ON m.fold=c.season
LEFT JOIN malpha4 l ON l.fold=c.season LEFT JOIN mrtm r ON r.fold=c.season AND r.grp_code=c.grp_code
LEFT JOIN mmk k ON k.fold=c.season AND k.grp_code=c.grp_code LEFT JOIN mmka a ON a.fold=c.season""")
cte("mlong", "SELECT *, predicted-actual AS error, abs(predicted-actual) AS abs_error, (predicted-actual)*(predicted-actual) "
    "AS sq_error, abs(lag1-actual) AS lag1_abs_error FROM ("
    + " UNION ALL ".join(f"SELECT '{m}' AS model, season AS eval_season, entity, entity_name, grp, ts, target AS actual, "
                         f"value_lag1 AS lag1, f_{m} AS predicted FROM mwide" for m in closed.CLOSED_FORM)
    + ") WHERE predicted IS NOT NULL")
cte("mcv", """
SELECT l.* FROM mlong l JOIN (SELECT entity, season+1 AS season, row_number() OVER (PARTITION BY season ORDER BY value DESC,
 entity) AS rn FROM cseason) b ON b.entity=l.entity AND b.season=l.eval_season AND rn<=200
WHERE model<>'market_consensus' AND ts>=3 AND eval_season IN (1999,2000,2001)""")
cte("mev", "SELECT *, 1 AS max_tier FROM mlong WHERE ts>=3")

# the same chain over a panel that begins later, as the panel of a higher tier does
LATER = 1997
_CHAIN = ["cmp", "cfold", "ctrain", "mgm", "mall", "malpha1", "malpha2", "malpha3", "malpha4", "mrtm", "mmk", "mmka", "mwide",
          "mlong", "mev"]
for _name in _CHAIN:
    _body = re.sub(r"\b(" + "|".join(_CHAIN) + r")\b", r"\1_later", CTES[_name])
    cte(_name + "_later", _body + (f" WHERE c.season>={LATER}" if _name == "cmp" else ""))


def panel(spark, sf):
    return stage(cpanel(spark, sf))


def market_panel(spark, sf):
    named = cpanel(spark, sf).withColumn("entity_name", _letters("entity_name"))
    ranked = t.consensus_rank(named, rankings(spark, sf)).drop("consensus_projection")
    return stage(ranked)


def cv(spark, sf):
    totals = cseason(spark, sf)
    return stage(bt.walk_forward_cv(p.lag_panel(totals, CUSTOMERS), totals, EVAL, FOUR, 200, 0, 3))


def evaluated(spark, sf):
    return bt.walk_forward_evaluate(market_panel(spark, sf), 1, None, 3, closed.CLOSED_FORM)


for _m in closed.CLOSED_FORM:
    @query(_m, ES + "predicted:d", f"SELECT entity, season, f_{_m} AS predicted FROM mwide")
    def _(spark, sf, m=_m):
        rows = market_panel(spark, sf) if m == "market_consensus" else panel(spark, sf)
        return closed.forecasts(rows, (m,)).withColumn("predicted", F.col("f_" + m))


@query("train_top_n_filter", ES + "value_lag1:d", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season "
       "ORDER BY value_lag1 DESC, entity) AS rn FROM cpanel) WHERE rn<=100")
def _(spark, sf):
    return bt.train_top_n_filter(panel(spark, sf), 100)


_LONG = "model:s eval_season:l entity:l grp:s actual:d predicted:d error:d abs_error:d sq_error:d"


@query("walk_forward_cv", _LONG + " lag1:d lag1_abs_error:d", "SELECT * FROM mcv")
def _(spark, sf):
    return cv(spark, sf)


@query("walk_forward_evaluate", _LONG + " max_tier:l", "SELECT * FROM mev")
def _(spark, sf):
    return evaluated(spark, sf)


@query("model_scores", "model:s mae:d rmse:d bias:d pearson_r:d n:l n_seasons:l skill:d", """
SELECT model, avg(abs_error) AS mae, sqrt(avg(sq_error)) AS rmse, avg(error) AS bias, corr(actual, predicted) AS pearson_r,
 count(*) AS n, count(DISTINCT eval_season) AS n_seasons,
 1-avg(abs_error)/(SELECT avg(lag1_abs_error) FROM mcv WHERE model='random_walk') AS skill FROM mcv GROUP BY model""")
def _(spark, sf):
    return s.model_scores(cv(spark, sf))


def _pivot(col, values, agg="avg(abs_error)", table="mcv"):
    return "SELECT model, " + ", ".join(
        f"{agg} FILTER ({col}={v!r}) AS \"{v}\"" for v in values) + f" FROM {table} GROUP BY model"


@query("mae_by_group", "model:s " + " ".join(g + ":d" for g in GROUPS), _pivot("grp", GROUPS))
def _(spark, sf):
    return s.mae_by_group(cv(spark, sf), GROUPS)


@query("mae_by_season", "model:s " + " ".join(f"{y}:d" for y in EVAL), _pivot("eval_season", EVAL))
def _(spark, sf):
    return s.mae_by_season(cv(spark, sf), EVAL)


@query("forecast_table", "eval_season:l entity:l grp:s rw_forecast:d forecast:d forecast_group_mean:d",
       "SELECT eval_season, entity, grp, max(lag1) AS rw_forecast, "
       "round_even(max(predicted) FILTER (model='regression_to_mean'),1) AS forecast, "
       "round_even(max(predicted) FILTER (model='group_mean'),1) AS forecast_group_mean FROM mcv "
       "GROUP BY eval_season, entity, grp")
def _(spark, sf):
    return s.forecast_table(cv(spark, sf), list(FOUR), "regression_to_mean")


def _top(col, name):
    return (f"row_number() OVER (PARTITION BY model, eval_season, grp ORDER BY {col} DESC, entity) AS {name}")


def _avg_rank(col, name):
    part = "PARTITION BY model, eval_season, grp"
    return (f"rank() OVER ({part} ORDER BY {col}) + (count(*) OVER ({part}, {col})-1)/2.0 AS {name}")


@query("score_predictions", "model:s max_tier:l eval_season:l mae:d rmse:d spearman_within_group:d top_precision:d "
       "vor_weighted_mae:d skill_vs_market:d", f"""
SELECT *, 1-mae/(max(mae) FILTER (model='market_consensus') OVER (PARTITION BY eval_season)) AS skill_vs_market FROM (
SELECT model, 1 AS max_tier, eval_season, sum(sae)/sum(n) AS mae, sqrt(sum(sse)/sum(n)) AS rmse,
 avg(CASE WHEN NOT isnan(rho) THEN rho END) AS spearman_within_group, avg(hits/least(24, n)) AS top_precision,
 sum(wn)/sum(wd) AS vor_weighted_mae FROM (
 SELECT model, eval_season, grp, count(*) AS n, sum(abs_error) AS sae, sum(sq_error) AS sse,
  CASE WHEN min(ra)<max(ra) AND min(rp)<max(rp) THEN corr(ra, rp) END AS rho, count(*) FILTER (ta<=24 AND tp<=24) AS hits,
  sum((greatest(0, actual-lvl)+1)*abs_error) AS wn, sum(greatest(0, actual-lvl)+1) AS wd FROM (
  SELECT *, min(CASE WHEN ta<=24 THEN actual END) OVER (PARTITION BY model, eval_season, grp) AS lvl FROM (
   SELECT *, {_top('actual', 'ta')}, {_top('predicted', 'tp')}, {_avg_rank('actual', 'ra')},
    {_avg_rank('predicted', 'rp')} FROM mev)) GROUP BY model, eval_season, grp) GROUP BY model, eval_season)""")
def _(spark, sf):
    return s.score_predictions(evaluated(spark, sf))


def _mean_of_seasons(table):
    return (f"SELECT model, avg(mae) AS mae FROM (SELECT model, eval_season, avg(abs_error) AS mae FROM {table} GROUP BY ALL) "
            "GROUP BY model")


@query("ablation_table", "model:s 0:d 1:d", f"""
SELECT l.model, e.mae AS "0", l.mae AS "1" FROM ({_mean_of_seasons('mev_later')}) l LEFT JOIN
 ({_mean_of_seasons("mev WHERE model<>'market_consensus'")}) e ON e.model=l.model""")
def _(spark, sf):
    rows = market_panel(spark, sf)
    later = rows.where(F.col("season") >= LATER)
    runs = bt.walk_forward_evaluate(rows, 0, None, 3, FOUR).unionByName(
        bt.walk_forward_evaluate(later, 1, None, 3, closed.CLOSED_FORM))
    return s.ablation_table(runs.groupBy("model", "max_tier", "eval_season").agg(F.avg("abs_error").alias("mae")), [0, 1])


@query("leak_audit", "column:s n:l spearman_r:d", """
SELECT col AS "column", count(*) AS n, corr(ra, rb) AS spearman_r FROM (SELECT *,
 rank() OVER (PARTITION BY col ORDER BY v)+(count(*) OVER (PARTITION BY col, v)-1)/2.0 AS ra,
 rank() OVER (PARTITION BY col ORDER BY target)+(count(*) OVER (PARTITION BY col, target)-1)/2.0 AS rb FROM (
 SELECT 'ppg_now' AS col, target/games AS v, target FROM cpanel UNION ALL SELECT 'leaky', target*2, target FROM cpanel
 UNION ALL SELECT 'value_lag1', value_lag1, target FROM cpanel UNION ALL
 SELECT 'games', games, target FROM cpanel) WHERE v IS NOT NULL) GROUP BY col HAVING abs(corr(ra, rb))>0.3""")
def _(spark, sf):
    rows = panel(spark, sf).withColumns({"ppg_now": F.col("target") / F.col("games"), "leaky": F.col("target") * 2})
    return s.leak_audit(rows, ["ppg_now", "leaky", "value_lag1", "games"], threshold=0.3)


@query("ranked_forecast", ES + "predicted:d age:d overall_rank:l group_place:l",
       "SELECT entity, season, f_regression_to_mean AS predicted, round_even(date_diff('day', birth_date, "
       "make_date(season,8,1))/365.25::DOUBLE, 2) AS age, row_number() OVER (PARTITION BY season ORDER BY "
       "f_regression_to_mean DESC, entity) AS overall_rank, rank() OVER (PARTITION BY season, grp ORDER BY "
       "f_regression_to_mean DESC) AS group_place FROM (SELECT * REPLACE (round(f_regression_to_mean, 6) AS "
       "f_regression_to_mean) FROM mwide) JOIN cborn USING (entity) WHERE season=2001")
def _(spark, sf):
    rows = closed.forecasts(panel(spark, sf), ("regression_to_mean",)).where("season = 2001")
    rows = rows.withColumn("predicted", F.round("f_regression_to_mean", 6))
    return s.ranked_forecast(stage(t.age_features(rows, births(spark, sf))))


@query("error_percentiles", "model:s n:l p25:d p50:d p75:d p90:d", "SELECT model, count(*) AS n, "
       + ", ".join(f"quantile_cont(abs_error, {x / 100}) AS p{x}" for x in (25, 50, 75, 90)) + " FROM mcv GROUP BY model")
def _(spark, sf):
    return s.error_percentiles(cv(spark, sf))


@query("bias_by_group", "model:s " + " ".join(g + ":d" for g in GROUPS), _pivot("grp", GROUPS, "avg(error)"))
def _(spark, sf):
    return s.bias_by_group(cv(spark, sf), GROUPS)


@query("skill_by_season", "model:s eval_season:l mae:d skill:d", "SELECT *, 1-mae/max(mae) FILTER (model='random_walk') "
       "OVER (PARTITION BY eval_season) AS skill FROM (SELECT model, eval_season, avg(abs_error) AS mae FROM mcv GROUP BY ALL)")
def _(spark, sf):
    return s.skill_by_season(cv(spark, sf))


# -- learned models: no SQL form, checked by property tests -------------------------------------

@query("ridge", ES + "target:d f_ridge:d")
def _(spark, sf):
    return bt.ridge_forecasts(panel(spark, sf), LAGS, CODES)


@query("boosted_trees", ES + "target:d predicted:d")
def _(spark, sf):
    rows = bt.learned_forecasts(panel(spark, sf), ("trees",), LAGS, CODES)
    return rows.where("f_trees IS NOT NULL").withColumn("predicted", F.col("f_trees"))


@query("partial_pooling", ES + "predicted:d distribution_sd:d")
def _(spark, sf):
    rows = pooled.forecasts(panel(spark, sf)).where("f_partial_pooling IS NOT NULL")
    return rows.withColumn("predicted", F.col("f_partial_pooling"))


@query("learned_scores", "model:s max_tier:l eval_season:l mae:d rmse:d spearman_within_group:d top_precision:d "
       "vor_weighted_mae:d crps:d skill_vs_market:d")
def _(spark, sf):
    wanted = ("market_consensus", "ridge", "partial_pooling")
    return s.score_predictions(bt.walk_forward_evaluate(market_panel(spark, sf), 1, None, 3, wanted, CODES))


@query("tune_hyperparameters", "alpha:d mae:d")
def _(spark, sf):
    rows, _names = ridge.design(panel(spark, sf), LAGS, CODES)
    _best, scores = ridge.cross_validated_alpha(ridge.moments(rows, "season"), rows, "season")
    return spark.createDataFrame([(float(k), float(v)) for k, v in scores.items()], "alpha double, mae double")


@query("shuffled_target_r2", "r2:d")
def _(spark, sf):
    r2 = bt.shuffled_target_r2(panel(spark, sf), LAGS, CODES, 2001)
    return spark.createDataFrame([(r2,)], "r2 double")


@query("run_ablation", "model:s max_tier:l eval_season:l mae:d spearman_within_group:d")
def _(spark, sf):
    rows = panel(spark, sf)
    wide = stage(t.wide_panel(rows, 4, customer_sources(spark, sf)))
    unstage(rows)
    return bt.run_ablation(wide, first_season=lambda tier: 1996 + min(tier, 2), codes=CODES)[1]


@query("model_weights", "family:s feature:s coefficient:d")
def _(spark, sf):
    return bt.model_weights(market_panel(spark, sf), LAGS, CODES)


@query("model_lines", "family:s feature:s coefficient:d", """
SELECT 'regression_to_mean' AS family, unnest(['beta_' || grp_code, 'mu_x_' || grp_code, 'mu_y_' || grp_code]) AS feature,
 unnest([CASE WHEN count(*)<2 OR var_samp(value_lag1)=0 THEN 1 ELSE greatest(0, least(1.5, covar_samp(target, value_lag1)
 /var_samp(value_lag1))) END, avg(value_lag1), avg(target)]) AS coefficient FROM cmp GROUP BY grp_code UNION ALL
SELECT 'market_consensus', unnest(['m_slope_' || grp_code, 'm_icept_' || grp_code]), unnest(CASE WHEN count(*)>=20 THEN
 [regr_slope(target, lx), regr_intercept(target, lx)] ELSE [NULL, NULL] END) FROM
 (SELECT *, ln(1+greatest(consensus_rank,1)) AS lx FROM cmp WHERE consensus_rank IS NOT NULL) GROUP BY grp_code""")
def _(spark, sf):
    return bt.model_lines(market_panel(spark, sf))


cte("mspread", "SELECT fold, stddev_samp(target-value_lag1) AS sd FROM ctrain GROUP BY fold")


@query("normal_crps", ES + "cdf:d crps:d", f"""
SELECT entity, season, {normal_cdf_sql('z')} AS cdf, sd*(z*(2*{normal_cdf_sql('z')}-1)+2*exp(-z*z/2)/sqrt(2*pi())-1/sqrt(pi()))
 AS crps FROM (SELECT c.entity, season, sd, (target-value_lag1)/sd AS z FROM cmp c JOIN mspread m ON m.fold=c.season)""")
def _(spark, sf):
    rows = panel(spark, sf)
    error = F.col("target") - F.col("value_lag1")
    spread = closed.fold_sums(rows, F.lit(True), {"n": F.lit(1), "e": error, "ee": error * error}).groupBy("fold").agg(
        F.sqrt((F.sum("ee") - F.sum("e") * F.sum("e") / F.sum("n")) / (F.sum("n") - 1)).alias("sd"))
    known = closed.with_fold_params(rows.withColumn("fold", F.col("season")), [], [spread]).where("sd IS NOT NULL")
    return known.withColumns({"cdf": normal_cdf(error / F.col("sd")), "crps": normal_crps("target", "value_lag1", "sd")})


@query("assert_tier_window", "first_season:l", "SELECT min(season) AS first_season FROM cpanel")
def _(spark, sf):
    rows = panel(spark, sf)
    s.assert_tier_window(rows, 1996)
    return rows.agg(F.min("season").alias("first_season"))
