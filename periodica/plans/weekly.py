"""Weekly walk-forward evaluation and next-period projections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, safe_corr, safe_div
from ..functions.ordered import top_rows
from ..functions.records import stage
from ..models import boosting, closed, ridge
from ..operators import weekly as w
from ..operators.metrics import season_totals
from ..operators.scoring import hit_rates, mae_pivot, with_errors
from ..settings import Settings

RIDGE_FEATURES = [c for c in w.FEATURES if c != "grp_code"]
BASELINES = ("rolling_mean", "season_avg", "weighted_rolling", "opponent_adjusted")


def fold_key(season: Column | str = "season", period: Column | str = "period") -> Column:
    """One ordered number per (season, period), for periods of any size."""
    return F.shiftleft(col(season).cast("bigint"), 32) + col(period)


def fold_columns(panel: DataFrame) -> DataFrame:
    """Training sums of everything before each (season, period): rows, residual, group mean allowed."""
    panel = panel.withColumns({"fold": fold_key(), "_blend": w.weighted_blend()})
    per = panel.groupBy("fold").agg(F.count("*").alias("_n"),
                                    F.sum(F.col("target") - F.col("_blend")).alias("_res"))
    before = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)  # one row per fold
    whole = per.select("fold", F.sum("_n").over(before).alias("train_rows"),
                       (F.sum("_res").over(before) / F.sum("_n").over(before)).alias("_shift"))
    allowed = panel.groupBy("grp_code", "fold").agg(
        F.count("opp_allowed_avg").alias("_c"), F.sum("opp_allowed_avg").alias("_s"))
    ahead = Window.partitionBy("grp_code").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    groups = allowed.select("grp_code", "fold", F.try_divide(
        F.sum("_s").over(ahead), F.sum("_c").over(ahead).cast("double")).alias("_allowed"))
    out = closed.with_fold_params(panel, [groups], [whole])
    return out.withColumn("_allowed", F.col("_g._allowed")).drop("_g")


def with_baselines(panel: DataFrame) -> DataFrame:
    """``f_*`` columns of the four baselines, each fitted on earlier folds only."""
    zero = F.lit(0.0)
    return fold_columns(panel).withColumns({
        "f_rolling_mean": w.baseline("rolling_mean"),
        "f_season_avg": w.baseline("season_avg"),
        "f_weighted_rolling": F.greatest(zero, F.col("_blend") + F.coalesce("_shift", zero)),
        "f_opponent_adjusted": F.greatest(zero, w.baseline("season_avg") * w.opponent_factor("_allowed")),
    }).drop("_blend", "_shift", "_allowed")


def weekly_ridge(panel: DataFrame, codes: list[int], alpha: float = 5.0, min_rows: int = 200) -> DataFrame:
    """Ridge of every fold from running moments; the code list is fixed, whatever a batch holds."""
    rows, _ = ridge.design(panel, RIDGE_FEATURES, codes)
    rows = rows.withColumn("_fold", fold_key())
    fits = ridge.fold_fits(ridge.moments(rows, "_fold"), alpha, min_rows)
    return ridge.predict(rows, ridge.fit_table(panel.sparkSession, fits), "_fold", "f_ridge").drop("x", "_fold")


def weekly_walk_forward(panel: DataFrame, eval_seasons: list[int], codes: list[int], top_n: int = 150,
                        min_prior_games: int = 2, min_train_rows: int = 200,
                        models: tuple[str, ...] = (*BASELINES, "ridge"), tree_rounds: int = 150) -> DataFrame:
    """Each period from everything before it, on last season's best entities with enough games.

    ``trees`` among the models boosts all folds in the same passes.
    """
    out = with_baselines(panel)
    if "ridge" in models:
        out = weekly_ridge(out, codes, min_rows=min_train_rows)
    if "trees" in models:
        seasons = out.where(F.col("season").isin(eval_seasons)).select(fold_key().alias("k")).distinct()
        out = weekly_trees(out, sorted(r[0] for r in seasons.collect()), tree_rounds).withColumnRenamed(
            "predicted", "f_trees")
    out = out.where(F.col("season").isin(eval_seasons) & (F.col("games_played") >= min_prior_games)
                    & (F.col("train_rows") >= min_train_rows))
    if top_n:
        sums = panel.groupBy("entity", "season").agg(F.sum("target").alias("value"))
        best = top_rows(sums, ["season"], "value", top_n, ["entity"]).select(
            "entity", (F.col("season") + 1).cast("int").alias("season"))
        out = out.join(best, ["entity", "season"], "left_semi")
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col("f_" + m).alias("predicted"))
                               for m in models]))
    long = out.select("entity", F.col("season").alias("eval_season"), "period", "grp",
                      F.col("target").alias("actual"),
                      F.coalesce("ma3", "lag1", F.lit(0.0)).alias("baseline"), rows.alias("_r"))
    long = long.select("*", "_r.*").drop("_r").where("predicted IS NOT NULL")
    return with_errors(long).withColumn("baseline_abs_error", F.abs(F.col("baseline") - F.col("actual")))


def weekly_summary(cv: DataFrame) -> DataFrame:
    level = F.avg("baseline_abs_error")
    return cv.groupBy("model").agg(
        F.avg("abs_error").alias("mae"), F.sqrt(F.avg("sq_error")).alias("rmse"), F.avg("error").alias("bias"),
        safe_corr("actual", "predicted").alias("pearson_r"),
        (1 - safe_div(F.avg("abs_error"), level)).alias("skill"), F.count("*").alias("n"))


def weekly_by_group(cv: DataFrame, groups: list[str]) -> DataFrame:
    return mae_pivot(cv, "grp", groups)


def weekly_by_period(cv: DataFrame, periods: list[int]) -> DataFrame:
    return mae_pivot(cv, "period", periods)


def boom_accuracy(cv: DataFrame, threshold: float = 20.0) -> DataFrame:
    rates = hit_rates(F.col("actual") >= threshold, F.col("predicted") >= threshold)
    return cv.groupBy("model").agg(*[c.alias(n) for n, c in rates.items()])


@dataclass
class Bundle:
    """What a projection needs: the panel, the fitted model and the reference tables."""

    log: DataFrame
    totals: DataFrame
    panel: DataFrame
    fit: DataFrame
    scaler: DataFrame
    thresholds: DataFrame
    codes: list[int]
    settings: Settings


def fit_weekly_bundle(log: DataFrame, settings: Settings, codes: list[int], alpha: float = 5.0) -> Bundle:
    """Panel, ridge on all its rows, score reference and tercile cuts; fit once, project often."""
    log = stage(log)
    totals = stage(season_totals(log))
    panel = stage(w.variance_features(stage(w.weekly_panel(log, settings, w.matchup_table(log), totals))))
    rows, _ = ridge.design(panel, RIDGE_FEATURES, codes)
    m = ridge.moments(rows, "season")
    fit = ridge.fit_table(log.sparkSession, {0: ridge.solve(sum(m.values()), alpha)})
    return Bundle(log, totals, panel, fit, stage(w.score_scaler(panel)), stage(w.tercile_thresholds(panel)),
                  codes, settings)


def projection_features(bundle: Bundle, season: int, period: int, candidates: DataFrame | None = None,
                        min_prior_games: int = 4, prior_top_n: int | None = None,
                        schedule: DataFrame | None = None) -> DataFrame:
    """Current-season rows, and last season's averages for candidates without one."""
    now = w.upcoming_rows(bundle.log, season, period, bundle.settings, schedule, bundle.totals)
    if candidates is not None:
        now = now.join(candidates.select("entity").distinct(), "entity", "left_semi")
    cols = ["entity", "entity_name", "grp", "season", "period", *w.FEATURES, "cv5", "boom_rate5", "bust_rate5"]
    now = stage(now.withColumn("data_source", F.lit("current_season")).select(*cols, "data_source"))
    prior = bundle.totals.where((F.col("season") == season - 1) & (F.col("games") >= min_prior_games))
    if candidates is not None:
        prior = prior.join(candidates.select("entity").distinct(), "entity", "left_semi")
    prior = prior.join(now.select("entity"), "entity", "left_anti")
    if prior_top_n:
        prior = top_rows(prior, ["season"], "value", prior_top_n, ["entity"])
    spread = w.variance_snapshot(bundle.log, season - 1, w.AFTER_LAST, bundle.settings)
    ppg = F.coalesce(safe_div("value", "games"), F.lit(0.0))
    zero = F.lit(0.0)
    fallback = prior.join(spread, "entity", "left").select(
        "entity", "entity_name", "grp", F.lit(season).alias("season"), F.lit(period).alias("period"),
        *[ppg.alias(c) for c in ("lag1", "ma3", "ma5", "season_avg")],
        *[zero.alias(c) for c in ("targets_ma3", "carries_ma3", "receptions_ma3", "target_share_ma3", "trend")],
        F.lit(0).alias("games_played"), F.lit((period - 1) / float(bundle.settings.season_steps)).alias("period_norm"),
        w.group_code(bundle.settings.group_codes).alias("grp_code"), zero.alias("opp_allowed_avg"),
        ppg.alias("prior_ppg"), F.col("games").cast("double").alias("prior_games"),
        "cv5", "boom_rate5", "bust_rate5", F.lit("prior_season_only").alias("data_source"))
    return now.unionByName(fallback)


def project_entities(bundle: Bundle, season: int, period: int, **options) -> DataFrame:
    """Projection, explosiveness, risk tier, floor and ceiling per entity."""
    rows = stage(projection_features(bundle, season, period, **options))
    x, _ = ridge.design(rows.withColumn("_all", F.lit(0)), RIDGE_FEATURES, bundle.codes)
    scored = ridge.predict(x, bundle.fit, "_all", "proj_points").drop("x", "_all")
    scored = scored.withColumn("proj_points", F.bround("proj_points", 1))
    return w.risk_bands(w.score_explosiveness(stage(scored), bundle.scaler, ["entity"]), bundle.thresholds)


def next_period(log: DataFrame, season: int) -> int:
    """The period after the last one played, 1 if none."""
    last = log.where(F.col("season") == season).agg(F.max("period")).first()[0]
    return 1 if last is None else int(last) + 1


def lineup_board(bundle: Bundle, season: int, period: int | None = None, top_n_fallback: int = 150) -> DataFrame:
    """Everyone active or present last season, by group and projection."""
    period = next_period(bundle.log, season) if period is None else period
    board = project_entities(bundle, season, period, prior_top_n=top_n_fallback)
    return board.select("entity", "entity_name", "grp", "season", "period", "proj_points", "floor", "ceiling",
                        "explosiveness", "risk_tier", "boom_rate5", "data_source"
                        ).orderBy("grp", F.desc("proj_points"), "entity")


def weekly_trees(panel: DataFrame, folds: list[int], trees_n: int = 150, penalty: float = 3.0,
                 exact: bool = True) -> DataFrame:
    """Boosted trees of every fold, each trained on the rows before its key.

    Rows of other folds have no forecast, or (not ``exact``) that of the last fold before them.
    """
    rows, runs = panel.withColumn("_fold", fold_key()), [boosting.Run(k, penalty=penalty) for k in folds]
    forest, _ = boosting.fit(rows, list(w.FEATURES), runs, "_fold", w.KEY, trees=trees_n, columns=1.0)
    return boosting.predict(rows, forest, "_fold", exact=exact).drop("_fold")
