"""Long-run study queries over customer seasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordered import spearman
from ..functions.records import stage
from ..functions.stats import T_TABLE
from ..operators import research as r
from ..settings import CUSTOMERS
from ..sources import adapters as a
from .base import cte, query

ES = "entity:l season:l "
GROUPS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

cte("cfin", """
SELECT *, row_number() OVER (PARTITION BY season ORDER BY value DESC, entity) AS finish,
 row_number() OVER (PARTITION BY season, grp ORDER BY value DESC, entity) AS group_finish,
 season - min(season) OVER (PARTITION BY entity) + 1 AS career_year FROM cseason""")
cte("cpair", "SELECT a.entity, b.season, a.grp, a.value AS v1, b.value AS v2, a.finish AS y1, b.finish AS y2, "
    "a.value/nullif(a.games,0) AS r1, b.value/nullif(b.games,0) AS r2 "
    "FROM cfin a JOIN cfin b ON a.entity=b.entity AND b.season=a.season+1")
cte("cnext", "SELECT a.*, b.finish AS next_finish FROM cfin a LEFT JOIN cfin b ON a.entity=b.entity "
    "AND b.season=a.season+1 WHERE a.season<2001")
cte("ttab", "SELECT * FROM (VALUES " + ", ".join(
    f"({i + 1}, {t!r}::DOUBLE)" for i, t in enumerate(T_TABLE)) + ") v(df, tcrit)")
_Z = 1.959963984540054
_SERIES = (f"{_Z!r}::DOUBLE + {(_Z**3 + _Z) / 4!r}::DOUBLE/(n-1) + {(5*_Z**5 + 16*_Z**3 + 3*_Z) / 96!r}::DOUBLE"
           f"/((n-1)*(n-1)) + {(3*_Z**7 + 19*_Z**5 + 17*_Z**3 - 15*_Z) / 384!r}::DOUBLE/((n-1)*(n-1)*(n-1))")


def _interval(body: str, mean: str = "mean", least: int = 2) -> str:
    half = f"CASE WHEN n<{least} THEN NULL ELSE coalesce(tcrit, {_SERIES})*sd/sqrt(n) END"
    return f"SELECT *, {mean}-{half} AS ci_lo, {mean}+{half} AS ci_hi FROM ({body}) LEFT JOIN ttab ON df=n-1"


def base(spark, sf):
    return stage(a.customer_season(spark, sf))


def ranked(spark, sf):
    return stage(r.finishes(base(spark, sf)))


def pairs(spark, sf, value="finish"):
    return r.lag_pairs(ranked(spark, sf), value)


@query("finish_rank", ES + "finish:l", "SELECT * FROM cfin")
def _(spark, sf):
    return r.finish_rank(base(spark, sf))


@query("group_finish_rank", ES + "group_finish:l", "SELECT * FROM cfin")
def _(spark, sf):
    return r.group_finish_rank(base(spark, sf))


@query("career_year", ES + "career_year:l", "SELECT * FROM cfin")
def _(spark, sf):
    return r.career_year(a.customer_season(spark, sf))


_TIER = ("CASE WHEN finish<=50 THEN 0 WHEN finish<=100 THEN 1 WHEN finish<=150 THEN 2 "
         "WHEN finish<=200 THEN 3 ELSE 4 END")
_GTIER = ("CASE WHEN grp IN ('AUTOMOBILE','BUILDING') THEN CASE WHEN group_finish<=12 THEN 0 "
          "WHEN group_finish<=24 THEN 1 WHEN group_finish<=36 THEN 2 ELSE 3 END "
          "WHEN grp IN ('FURNITURE','HOUSEHOLD') THEN CASE WHEN group_finish<=5 THEN 0 WHEN group_finish<=10 "
          "THEN 1 WHEN group_finish<=16 THEN 2 ELSE 3 END ELSE 4 END")
cte("ctier", f"SELECT *, {_TIER} AS tier, {_GTIER} AS group_tier FROM cfin")


def tiered(spark, sf):
    return r.group_tier(r.finish_tier(ranked(spark, sf)), CUSTOMERS.group_tier_cuts)


@query("finish_tier", ES + "tier:l", "SELECT * FROM ctier")
def _(spark, sf):
    return r.finish_tier(ranked(spark, sf))


@query("group_tier", ES + "group_tier:l", "SELECT * FROM ctier")
def _(spark, sf):
    return r.group_tier(ranked(spark, sf), CUSTOMERS.group_tier_cuts)


@query("lag_pairs", ES + "y1:d y2:d y3:d", "SELECT c.entity, c.season, a.value AS y1, b.value AS y2, "
       "c.value AS y3 FROM cseason a JOIN cseason b ON a.entity=b.entity AND b.season=a.season+1 "
       "JOIN cseason c ON c.entity=a.entity AND c.season=a.season+2")
def _(spark, sf):
    return r.lag_pairs(a.customer_season(spark, sf), "value", 2)


@query("conditional_finish_prob", "season:l n:l prob:d", "SELECT season, count(*) AS n, "
       "avg((coalesce(next_finish,9999)<=40)::INT) AS prob FROM cnext WHERE finish<=60 GROUP BY season")
def _(spark, sf):
    return r.conditional_finish_prob(ranked(spark, sf), 40, 60)


def _curve_sql(hit, within=""):
    return (f"SELECT {within} k, avg(p) AS prob FROM (SELECT {within} season, k, "
            f"avg(({hit})::INT) AS p FROM cnext JOIN (SELECT unnest(range(1, 101)) AS k) ON finish<=k "
            f"GROUP BY ALL) GROUP BY ALL")


@query("repeat_curve", "k:l prob:d", _curve_sql("coalesce(next_finish,9999)<=k"))
def _(spark, sf):
    return r.repeat_curve(ranked(spark, sf))


@query("repeat_curve_by_group", "grp:s k:l prob:d",
       "SELECT g.grp, g.k, coalesce(prob, 0) AS prob FROM (SELECT DISTINCT grp, k FROM cnext, "
       "(SELECT unnest(range(1, 101)) AS k)) g LEFT JOIN ("
       + _curve_sql("coalesce(next_finish,9999)<=k", "grp,") + ") c ON c.grp=g.grp AND c.k=g.k")
def _(spark, sf):
    return r.repeat_curve(ranked(spark, sf), by_group=True)


@query("repeat_curve_strict", "k:l prob:d", "SELECT g.k, coalesce(prob, 0) AS prob FROM (SELECT unnest(range(1, 101)) AS k) g "
       "LEFT JOIN (SELECT k, avg(p) AS prob FROM (SELECT season, k, avg((coalesce(next_finish,9999)<k)::INT) AS p FROM cnext "
       "JOIN (SELECT unnest(range(1, 101)) AS k) ON finish<k WHERE season<2000 GROUP BY ALL) GROUP BY ALL) c ON c.k=g.k")
def _(spark, sf):
    return r.repeat_curve(ranked(spark, sf), strict=True)


@query("new_finish_curve", "k:l prob:d", _curve_sql("coalesce(next_finish,9999)<=10"))
def _(spark, sf):
    return r.new_finish_curve(ranked(spark, sf))


cte("cmark", """
SELECT i, j, regr_intercept(p, jj) OVER (PARTITION BY i) + regr_slope(p, jj) OVER (PARTITION BY i)*j AS prob
FROM (SELECT g.i, g.j, g.j::DOUBLE AS jj, coalesce(c::DOUBLE/t, 0) AS p FROM (SELECT a.i, b.j FROM
 (SELECT unnest(range(1,201)) AS i) a, (SELECT unnest(range(1,201)) AS j) b) g
LEFT JOIN (SELECT y1, y2, count(*) AS c, sum(count(*)) OVER (PARTITION BY y1) AS t FROM cpair
 WHERE y1<=200 AND y2<=200 GROUP BY y1, y2) m ON m.y1=i AND m.y2=j)""")


@query("markov_matrix", "i:l j:l prob:d", "SELECT * FROM cmark")
def _(spark, sf):
    return r.markov_matrix(pairs(spark, sf))


@query("one_step_expectation", "i:l expected:l", "SELECT i, floor(sum(j*prob) + "
       "greatest(0, 1-sum(prob))*201 + 1e-6::DOUBLE) AS expected FROM cmark GROUP BY i")
def _(spark, sf):
    return r.one_step_expectation(r.markov_matrix(pairs(spark, sf)))


@query("repeat_stats_rank", "prev_finish:l n:l min:l q1:d median:d mean:d q3:d max:l sd:d ci_lo:d ci_hi:d",
       _interval("SELECT y1 AS prev_finish, count(*) AS n, min(y2) AS min, quantile_cont(y2,0.25) AS q1, "
                 "quantile_cont(y2,0.5) AS median, avg(y2) AS mean, quantile_cont(y2,0.75) AS q3, max(y2) AS max, "
                 "stddev_samp(y2) AS sd FROM cpair WHERE y1<=250 GROUP BY y1 HAVING count(*)>=2"))
def _(spark, sf):
    return r.repeat_stats_rank(pairs(spark, sf))


@query("repeat_stats_value", "bucket:d n:l median:d mean:d sd:d ci_lo:d ci_hi:d",
       _interval("SELECT (floor(v1/25)+1)*25 AS bucket, count(*) AS n, quantile_cont(v2,0.5) AS median, "
                 "avg(v2) AS mean, stddev_samp(v2) AS sd FROM cpair WHERE v1>=0 GROUP BY ALL HAVING count(*)>=2"))
def _(spark, sf):
    return r.repeat_stats_value(pairs(spark, sf, "value"))


@query("smoothed_repeat", "cohort:l n:l prob:d", "SELECT floor((y1-1)/21)+1 AS cohort, count(*) AS n, "
       "avg((y2<=(floor((y1-1)/21)+1)*21)::INT) AS prob FROM cpair WHERE y1<=210 GROUP BY ALL")
def _(spark, sf):
    return r.smoothed_repeat(pairs(spark, sf), 20, 10)


@query("quantile_profile", "step:l mean:d ci_lo:d ci_hi:d", _interval(
    "SELECT step, count(*) AS n, avg(q) AS mean, stddev_samp(q) AS sd FROM (SELECT season, unnest(qs) AS q, "
    "generate_subscripts(qs, 1) AS step FROM (SELECT season, quantile_cont(value, ["
    + ",".join(f"{(k + 1) / 20}" for k in range(20))
    + "]) AS qs FROM cfin WHERE finish<=200 GROUP BY season)) GROUP BY step"))
def _(spark, sf):
    return r.quantile_profile(a.customer_season(spark, sf))


def _fit(y, x, key):
    return (f"SELECT {key}, count(*) AS n, regr_r2({y},{x}) AS r2, sqrt(greatest(0, regr_syy({y},{x})"
            f"-regr_slope({y},{x})*regr_sxy({y},{x}))/count(*)) AS rmse, regr_slope({y},{x}) AS slope, "
            f"regr_intercept({y},{x}) AS intercept FROM cpair")


@query("lag_regression", "lags:l n:l r2:d rmse:d slope:d intercept:d", _fit("v2", "v1", "1 AS lags"))
def _(spark, sf):
    return r.lag_regression(a.customer_season(spark, sf))


@query("lag_regression_multi", "lags:l n:l r2:d rmse:d", """
SELECT 2 AS lags, count(*) AS n, (r1*r1+r2*r2-2*r1*r2*r12)/(1-r12*r12) AS r2,
 sqrt(var_y*(1-(r1*r1+r2*r2-2*r1*r2*r12)/(1-r12*r12))) AS rmse FROM (SELECT count(*) OVER () AS k,
 corr(c.value,a.value) OVER () AS r1, corr(c.value,b.value) OVER () AS r2, corr(a.value,b.value) OVER () AS r12,
 var_pop(c.value) OVER () AS var_y FROM cseason a JOIN cseason b ON a.entity=b.entity AND b.season=a.season+1
 JOIN cseason c ON c.entity=a.entity AND c.season=a.season+2) GROUP BY r1, r2, r12, var_y""")
def _(spark, sf):
    return r.lag_regression(a.customer_season(spark, sf), lags=2)


cte("cever", "SELECT * FROM cfin WHERE entity IN (SELECT entity FROM cfin WHERE finish<=200)")


@query("career_trajectory", "career_year:l n:l mean_value:d ci_lo:d ci_hi:d mean_ppg:d", _interval(
    "SELECT career_year, count(*) AS n, avg(value) AS mean_value, stddev_samp(value) AS sd, "
    "avg(value/nullif(games,0)) AS mean_ppg FROM cever GROUP BY career_year", "mean_value", 3))
def _(spark, sf):
    return r.career_trajectory(ranked(spark, sf))


cte("cpeak", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY value DESC, season) AS rn "
    "FROM cever) WHERE rn=1")


@query("peak_career_year", "entity:l grp:s career_year:l value:d", "SELECT * FROM cpeak")
def _(spark, sf):
    return r.peak_career_year(ranked(spark, sf))


@query("peak_summary", "grp:s n:l mean_peak:d median_peak:d", "SELECT grp, count(*) AS n, avg(career_year) AS "
       "mean_peak, quantile_cont(career_year, 0.5) AS median_peak FROM cpeak GROUP BY grp")
def _(spark, sf):
    return r.peak_summary(r.peak_career_year(ranked(spark, sf)))


@query("tier_transition", "from_tier:l to_tier:l n:l prob:d", "SELECT a.tier AS from_tier, b.tier AS to_tier, "
       "count(*) AS n, count(*)/sum(count(*)) OVER (PARTITION BY a.tier) AS prob FROM ctier a JOIN ctier b "
       "ON a.entity=b.entity AND b.season=a.season+1 GROUP BY a.tier, b.tier")
def _(spark, sf):
    return r.tier_transition(tiered(spark, sf))


@query("tier_transition_by_group", "grp:s from_tier:l to_tier:l n:l prob:d", "SELECT a.grp, a.group_tier AS "
       "from_tier, b.group_tier AS to_tier, count(*) AS n, count(*)/sum(count(*)) OVER (PARTITION BY a.grp, "
       "a.group_tier) AS prob FROM ctier a JOIN ctier b ON a.entity=b.entity AND b.season=a.season+1 "
       "GROUP BY a.grp, a.group_tier, b.group_tier")
def _(spark, sf):
    return r.tier_transition(tiered(spark, sf), "group_tier", ("grp",))


@query("survival_curve", "grp:s relative_year:l n_cohort:l survival_rate:d", """
SELECT g.grp, ry AS relative_year, n AS n_cohort, coalesce(c,0)/n AS survival_rate FROM (SELECT grp, n, ry FROM
 (SELECT grp, count(*) AS n FROM (SELECT DISTINCT entity, grp FROM cfin WHERE finish<=200) GROUP BY grp),
 (SELECT unnest(range(0,15)) AS ry)) g
LEFT JOIN (SELECT grp, season-anchor AS r, count(*) AS c FROM (SELECT *, min(season) OVER (PARTITION BY entity)
 AS anchor FROM cfin WHERE finish<=200) GROUP BY ALL) x ON x.grp=g.grp AND x.r=ry""")
def _(spark, sf):
    return r.survival_curve(ranked(spark, sf))


@query("group_share_over_time", "season:l " + " ".join(g + ":d" for g in GROUPS),
       "SELECT season, " + ", ".join(f"100*coalesce(sum(value) FILTER (grp='{g}'),0)/sum(value) AS \"{g}\""
                                     for g in GROUPS)
       + " FROM cseason WHERE grp IN ('" + "','".join(GROUPS) + "') GROUP BY season")
def _(spark, sf):
    return r.group_share_over_time(a.customer_season(spark, sf), GROUPS)


@query("era_fit", "era:s n:l r2:d rmse:d slope:d intercept:d",
       " UNION ALL ".join(_fit("v2", "v1", f"'{x}-{y}' AS era") + f" WHERE season<={y} AND season-1>={x}"
                          for x, y in ((1995, 1998), (1997, 2001), (1999, 2001))))
def _(spark, sf):
    return r.era_fit(a.customer_season(spark, sf), [(1995, 1998), (1997, 2001), (1999, 2001)])


@query("breakout_probability", "career_year:l mean_p:d ci_lo:d ci_hi:d n:l", """
SELECT career_year, avg(p) AS mean_p, quantile_cont(p,0.05) AS ci_lo, quantile_cont(p,0.95) AS ci_hi, sum(c) AS n
FROM (SELECT season, career_year, count(*) AS c, avg((coalesce(next_finish,9999)<=50)::INT) AS p FROM cnext
 WHERE finish>150 AND career_year<=10 GROUP BY ALL HAVING count(*)>=3) GROUP BY career_year""")
def _(spark, sf):
    return r.breakout_probability(ranked(spark, sf))


@query("rate_vs_total_fit", "measure:s n:l r2:d rmse:d slope:d",
       _fit("v2", "v1", "'total' AS measure") + " UNION ALL " + _fit("r2", "r1", "'per_game' AS measure"))
def _(spark, sf):
    return r.rate_vs_total_fit(a.customer_season(spark, sf))


@query("career_cohort", ES + "career_year:l n_seasons:l", "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY "
       "entity) AS n_seasons FROM cfin) WHERE n_seasons>=3 AND career_year=2")
def _(spark, sf):
    return r.career_cohort(a.customer_season(spark, sf), 3, 2)


cte("cshrink", """
SELECT *, prior/career_year + naive*(career_year-1)/career_year AS shrunk FROM (
SELECT entity, season, career_year, grp, fold, value AS actual, naive, mean_fc, median_fc,
 (sum(value) OVER g - sum(value) OVER f)/(count(*) OVER g - count(*) OVER f) AS prior, count(naive) OVER g AS np
FROM (SELECT b.*, b.entity%5 AS fold, a.value AS naive FROM (SELECT *, count(*) OVER (PARTITION BY entity) AS ns,
  avg(value) OVER w AS mean_fc, quantile_cont(value, 0.5) OVER w AS median_fc FROM cfin
  WINDOW w AS (PARTITION BY entity ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) b
 LEFT JOIN cfin a ON a.entity=b.entity AND a.season=b.season-1
 WHERE b.career_year BETWEEN 2 AND 12 AND ns>=b.career_year)
WINDOW g AS (PARTITION BY career_year, grp), f AS (PARTITION BY career_year, grp, fold))
WHERE naive IS NOT NULL AND np>=10""")


@query("shrinkage_backtest", ES + "career_year:l grp:s fold:l actual:d prior:d shrunk:d naive:d mean_fc:d median_fc:d",
       "SELECT * FROM cshrink")
def _(spark, sf):
    return r.shrinkage_backtest(a.customer_season(spark, sf))


@query("shrinkage_summary", "career_year:l grp:s n:l shrunk_mae:d naive_mae:d mean_mae:d median_mae:d",
       "SELECT career_year, grp, count(*) AS n, avg(abs(shrunk-actual)) AS shrunk_mae, avg(abs(naive-actual)) AS "
       "naive_mae, avg(abs(mean_fc-actual)) AS mean_mae, avg(abs(median_fc-actual)) AS median_mae FROM cshrink GROUP BY ALL")
def _(spark, sf):
    return r.shrinkage_summary(r.shrinkage_backtest(a.customer_season(spark, sf)))


@query("series_backtest", "grp:s n:l mean_mae:d naive_mae:d drift_mae:d", """
SELECT grp, count(*) AS n, avg(abs(greatest(0,m)-value)) AS mean_mae, avg(abs(l-value)) AS naive_mae,
 avg(abs(greatest(0, CASE WHEN t>=2 THEN l+(l-f)/(t-1) ELSE l END)-value)) AS drift_mae
FROM (SELECT *, count(*) OVER (PARTITION BY entity) AS ns, row_number() OVER o - 1 AS t, lag(value) OVER o AS l,
 first_value(value) OVER o AS f, avg(value) OVER w AS m FROM cseason
 WINDOW o AS (PARTITION BY entity ORDER BY season), w AS (PARTITION BY entity ORDER BY season
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE ns>=3 AND t>=1 GROUP BY grp""")
def _(spark, sf):
    return r.series_backtest(a.customer_season(spark, sf))


@query("smoothing_backtest", "grp:s n:l simple_mae:d holt_mae:d damped_mae:d", """
SELECT * FROM (WITH RECURSIVE s AS (
 SELECT * FROM (SELECT entity, grp, value, row_number() OVER o - 1 AS t, lead(value) OVER o AS following,
  count(*) OVER (PARTITION BY entity) AS ns FROM cseason WINDOW o AS (PARTITION BY entity ORDER BY season)) WHERE ns>=3),
points AS (SELECT unnest(range(1, 20))/20.0::DOUBLE AS x),
grid AS (SELECT 'simple' AS model, x AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS d FROM points
 UNION ALL SELECT 'holt', p.x, q.x, 1.0 FROM points p, points q
 UNION ALL SELECT 'damped', p.x, q.x, unnest([0.8, 0.9, 0.98]::DOUBLE[]) FROM points p, points q),
r(entity, model, a, b, d, t, level, trend, sse, before, f) AS (
 SELECT entity, model, a, b, d, t, value, CASE model WHEN 'simple' THEN 0.0 ELSE following-value END, 0.0::DOUBLE, NULL::DOUBLE,
  NULL::DOUBLE FROM s, grid WHERE t=0
 UNION ALL SELECT entity, model, a, b, d, t, f+a*(value-f), b*(f+a*(value-f)-level)+(1-b)*d*trend,
  sse+(value-f)*(value-f), sse, f FROM (SELECT r.* EXCLUDE (f, t, before), s.t, s.value, level+d*trend AS f FROM r
   JOIN s ON s.entity=r.entity AND s.t=r.t+1)),
best AS (SELECT entity, model, t, arg_min(f, (before, f)) AS f FROM r WHERE t>0 GROUP BY ALL),
shown AS (SELECT s.grp, s.value, model, CASE WHEN s.t>=3 OR model='simple' THEN f ELSE p.value END AS f FROM best JOIN s
  ON s.entity=best.entity AND s.t=best.t JOIN s p ON p.entity=s.entity AND p.t=s.t-1)
SELECT grp, count(*) FILTER (model='simple') AS n, """ + ", ".join(
    f"avg(abs(greatest(0,f)-value)) FILTER (model='{x}') AS {x}_mae" for x in ("simple", "holt", "damped")) + """
FROM shown GROUP BY grp)""")
def _(spark, sf):
    return r.smoothing_backtest(a.customer_season(spark, sf))


@query("spearman", "season:l n:l spearman_r:d", """
SELECT season, count(*) AS n, corr(ra, rb) AS spearman_r FROM (SELECT season,
 rank() OVER (PARTITION BY season ORDER BY value) + (count(*) OVER (PARTITION BY season, value)-1)/2.0 AS ra,
 rank() OVER (PARTITION BY season ORDER BY games) + (count(*) OVER (PARTITION BY season, games)-1)/2.0 AS rb
 FROM cseason) GROUP BY season""")
def _(spark, sf):
    return spearman(a.customer_season(spark, sf), ["entity", "season"], ["season"], "value", "games")
