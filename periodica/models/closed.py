"""Forecasts with closed-form fits, for every walk-forward fold at once.

The panel is reduced to sums per season and group in one scan. A fold's training sums are the sums
of the seasons before it, so each season's row is repeated once per later fold (seasons squared
times groups, a small table) instead of scanning the panel per fold. All parameters of a fold meet
its rows as one row of a small table, so the panel itself is never shuffled.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, safe_div
from ..functions.records import small_join

LOW, HIGH = 0.05, 0.95                   # bounds of smoothing weights
STEPS = (0.05, 0.005, 0.0005, 0.00005)   # grid steps, each around the best weight of the one before
CLOSED_FORM = ("random_walk", "group_mean", "exp_smoothing", "regression_to_mean", "market_consensus")


def smooth(alpha: Column) -> Column:
    """Geometric weights over the lags that exist."""
    pairs = [(F.col("value_lag1"), alpha), (F.col("value_lag2"), alpha * (1 - alpha)),
             (F.col("value_lag3"), alpha * (1 - alpha) * (1 - alpha))]
    num = reduce(lambda s, p: s + F.coalesce(p[0] * p[1], F.lit(0.0)), pairs, F.lit(0.0))
    den = reduce(lambda s, p: s + F.when(p[0].isNotNull(), p[1]).otherwise(0.0), pairs, F.lit(0.0))
    return F.coalesce(F.try_divide(num, den), F.coalesce("value_lag1", F.lit(0.0)))


def log_rank() -> Column:
    return F.log1p(F.greatest(F.col("consensus_rank").cast("double"), F.lit(1.0)))


def _later(stats: DataFrame, last: Column) -> DataFrame:
    return stats.withColumn("fold", F.explode(F.when(
        F.col("season") < last, F.sequence(F.col("season") + 1, last)).otherwise(F.array())))


def fold_sums(panel: DataFrame, train: Column, sums: dict[str, Column]) -> DataFrame:
    """Training sums per fold and group code; ``seasons`` counts the seasons behind them."""
    per = panel.groupBy("season", "grp_code").agg(
        *[F.sum(F.when(train, v)).alias(n) for n, v in sums.items()])
    last = panel.agg(F.max("season")).scalar()
    return _later(per, last).groupBy("fold", "grp_code").agg(
        *[F.sum(n).alias(n) for n in sums])


def train_seasons(panel: DataFrame) -> DataFrame:
    """Per fold, how many seasons lie before it."""
    seasons = panel.select("season").distinct()
    last = panel.agg(F.max("season")).scalar()
    return _later(seasons, last).groupBy("fold").agg(F.count("*").alias("train_seasons"))


def group_mean_params(panel: DataFrame, train: Column) -> tuple[DataFrame, DataFrame]:
    per = fold_sums(panel, train, {"_n": F.lit(1), "_y": F.col("target")})
    groups = per.select("fold", "grp_code", safe_div("_y", "_n").alias("group_mean_y"))
    whole = per.groupBy("fold").agg(safe_div(F.sum("_y"), F.sum("_n")).alias("all_mean_y"))
    return groups, whole


def smoothing_moments(panel: DataFrame, train: Column) -> DataFrame:
    """Sums of products of the lags and the target per season and pattern of lags that exist."""
    lags = [f"value_lag{k}" for k in (1, 2, 3)]
    v = [*[F.coalesce(F.col(c), F.lit(0.0)) for c in lags], F.col("target")]
    pattern = sum((F.col(c).isNotNull().cast("int") * (1 << k) for k, c in enumerate(lags)), F.lit(0))
    return panel.where(train).groupBy("season", pattern.alias("pattern")).agg(
        *[F.sum(v[i] * v[j]).alias(f"m{i}{j}") for i in range(4) for j in range(i, 4)])


def smoothing_error(moments: dict[int, np.ndarray], alpha: float) -> float:
    """Squared error of a weight from moments by pattern; patterns without lags do not depend on it."""
    weights, total = np.array([alpha, alpha * (1 - alpha), alpha * (1 - alpha) ** 2]), 0.0
    for pattern, m in moments.items():
        w = weights * [pattern >> k & 1 for k in range(3)]
        u = np.append(w / w.sum() if pattern else w, -1.0)
        total += float(u @ m @ u)
    return total


def smoothing_params(panel: DataFrame, train: Column) -> DataFrame:
    """Per fold the weight with the least squared error on the seasons before it, to five places.

    The error of any weight follows from at most eight small matrices per season, so rows are read once.
    """
    by_season: dict[int, dict[int, np.ndarray]] = {}
    for r in smoothing_moments(panel, train).collect():
        m = np.zeros((4, 4))
        for i in range(4):
            for j in range(i, 4):
                m[i, j] = m[j, i] = r[f"m{i}{j}"] or 0.0
        by_season.setdefault(r["season"], {})[r["pattern"]] = m
    seasons = [r[0] for r in panel.select("season").distinct().orderBy("season").collect()]
    past, rows = {}, []
    for season in seasons:
        if past:
            low, high, best = LOW, HIGH, None
            for step in STEPS:
                grid = [round(low + step * k, 5) for k in range(round((high - low) / step) + 1)]
                # rounded so that equal fits do not hinge on the order of addition
                best = min(grid, key=lambda a: (round(smoothing_error(past, a), 4), a))
                low, high = max(LOW, best - step), min(HIGH, best + step)
            rows.append((season, best))
        for pattern, m in by_season.get(season, {}).items():
            past[pattern] = past.get(pattern, 0) + m
    return panel.sparkSession.createDataFrame(rows, "fold int, alpha double")


def mean_reversion_params(panel: DataFrame, train: Column) -> tuple[DataFrame, DataFrame]:
    x, y = F.coalesce("value_lag1", F.lit(0.0)), F.col("target")
    s = fold_sums(panel, train, {"_n": F.lit(1), "_x": x, "_y": y, "_xx": x * x, "_xy": x * y})
    s = s.withColumns({"mu_x": safe_div("_x", "_n"), "mu_y": safe_div("_y", "_n")})
    var = F.col("_xx") - F.col("_x") * F.col("mu_x")
    cov = F.col("_xy") - F.col("_x") * F.col("mu_y")
    flat = (F.col("_n") < 2) | (var <= 1e-9 * F.greatest(F.lit(1.0), F.col("_xx")))
    beta = F.when(flat, 1.0).otherwise(F.least(F.lit(1.5), F.greatest(F.lit(0.0), F.try_divide(cov, var))))
    groups = s.where("_n > 0").select("fold", "grp_code", "mu_x", "mu_y", beta.alias("beta"))
    whole = groups.groupBy("fold").agg(F.avg("mu_x").alias("all_mu_x"), F.avg("mu_y").alias("all_mu_y"))
    return groups, whole


def market_params(panel: DataFrame, train: Column, group_rows: int = 20,
                  all_rows: int = 50) -> tuple[DataFrame, DataFrame]:
    """Line of target on log rank per group; too few rows leave the pooled or the default line."""
    ranked = train & F.col("consensus_rank").isNotNull()
    x, y = log_rank(), F.col("target")
    s = fold_sums(panel, ranked, {"_n": F.lit(1), "_x": x, "_y": y, "_xx": x * x, "_xy": x * y})

    def line(least: int) -> tuple[Column, Column]:
        n, sx, sy, sxx, sxy = (F.col(c) for c in ("_n", "_x", "_y", "_xx", "_xy"))
        slope = F.when(n >= least, F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx))
        return slope, F.try_divide(sy - slope * sx, n)

    slope, icept = line(group_rows)
    groups = s.select("fold", "grp_code", slope.alias("m_slope"), icept.alias("m_icept"))
    pooled = s.groupBy("fold").agg(*[F.sum(c).alias(c) for c in ("_n", "_x", "_y", "_xx", "_xy")])
    slope, icept = line(all_rows)
    whole = pooled.select("fold", F.coalesce(slope, F.lit(-0.5)).alias("all_slope"),
                          F.coalesce(icept, F.lit(150.0)).alias("all_icept"))
    return groups, whole


def fold_table(groups: list[DataFrame], wholes: list[DataFrame]) -> DataFrame:
    """One row per fold: its own parameters, and those of its groups in a map by group code."""
    parts = list(wholes)
    if groups:
        both = ["fold", "grp_code"]
        joined = reduce(lambda a, b: a.join(b, both, "full"), groups).where("grp_code IS NOT NULL")
        values = F.struct(*[c for c in joined.columns if c not in both])
        parts.append(joined.groupBy("fold").agg(
            F.map_from_entries(F.collect_list(F.struct("grp_code", values))).alias("_groups")))
    return reduce(lambda a, b: a.join(b, "fold", "full"), parts)


def with_fold_params(rows: DataFrame, groups: list[DataFrame], wholes: list[DataFrame]) -> DataFrame:
    """Rows with their fold's parameters and ``_g``, those of their group; the table is counted and broadcast."""
    if not groups and not wholes:
        return rows
    out = small_join(rows, fold_table(groups, wholes), ["fold"])
    return out.withColumn("_g", F.try_element_at("_groups", F.col("grp_code"))).drop("_groups") if groups else out


def forecasts(panel: DataFrame, models: tuple[str, ...], train: Column | None = None) -> DataFrame:
    """Panel with one ``f_*`` column per model, fitted on the seasons before each row's season."""
    train = F.lit(True) if train is None else train
    lag1 = F.coalesce("value_lag1", F.lit(0.0))
    zero, g = F.lit(0.0), lambda c: F.col(f"_g.{c}")
    made: dict[str, Column] = {}
    groups, wholes = [], []

    def learned(pair: tuple[DataFrame, DataFrame]) -> None:
        groups.append(pair[0])
        wholes.append(pair[1])

    if "random_walk" in models:
        made["f_random_walk"] = lag1
    if "group_mean" in models:
        learned(group_mean_params(panel, train))
        made["f_group_mean"] = F.coalesce(g("group_mean_y"), "all_mean_y")
    if "exp_smoothing" in models:
        wholes.append(smoothing_params(panel, train))
        made["f_exp_smoothing"] = smooth(F.col("alpha"))
    if "regression_to_mean" in models:
        learned(mean_reversion_params(panel, train))
        line = F.coalesce(g("mu_y"), "all_mu_y") + F.coalesce(g("beta"), F.lit(1.0)) * (
            lag1 - F.coalesce(g("mu_x"), "all_mu_x"))
        made["f_regression_to_mean"] = F.greatest(zero, line)
    if "market_consensus" in models:
        learned(market_params(panel, train))
        default = F.coalesce("all_icept", F.lit(150.0)) + F.coalesce("all_slope", F.lit(-0.5)) * log_rank()
        line = F.when(g("m_slope").isNull(), default).otherwise(g("m_icept") + g("m_slope") * log_rank())
        proj = col("consensus_projection") if "consensus_projection" in panel.columns else F.lit(None)
        made["f_market_consensus"] = F.when(proj.isNotNull(), F.greatest(zero, proj.cast("double"))).when(
            F.col("consensus_rank").isNull(), lag1).otherwise(F.greatest(zero, line))
    out = with_fold_params(panel.withColumn("fold", F.col("season")), groups, wholes).withColumns(made)
    return out.select(*panel.columns, *[c for c in made if c not in panel.columns])
