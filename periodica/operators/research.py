"""Long-run studies over one row per entity and season: finishes, transitions, careers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import lookup, safe_div
from ..functions.ordered import Rank, add_ranks, group_quantiles, top_rows
from ..functions.records import small_join
from ..functions.shipping import ship
from ..functions.stats import t_interval

ES = ["entity", "season"]


def career():
    """An entity's seasons in order; at most one row per season."""
    return Window.partitionBy("entity").orderBy("season")


def finish_rank(df: DataFrame) -> DataFrame:
    """Place in the season by value, no shared places."""
    return add_ranks(df, ES, [Rank("finish", "value", ("season",), "first")])


def group_finish_rank(df: DataFrame) -> DataFrame:
    return add_ranks(df, ES, [Rank("group_finish", "value", ("season", "grp"), "first")])


def finishes(df: DataFrame) -> DataFrame:
    return add_ranks(df, ES, [Rank("finish", "value", ("season",), "first"),
                              Rank("group_finish", "value", ("season", "grp"), "first")])


def career_year(df: DataFrame) -> DataFrame:
    """1 in the entity's first season on record."""
    first = F.min("season").over(Window.partitionBy("entity"))
    return df.withColumn("career_year", F.col("season") - first + 1)


def _tier(place: Column, cuts: tuple[int, ...]) -> Column:
    out = F.lit(len(cuts))
    for t in range(len(cuts) - 1, -1, -1):
        out = F.when(place <= cuts[t], F.lit(t)).otherwise(out)
    return out


def finish_tier(df: DataFrame, cuts: tuple[int, ...] = (50, 100, 150, 200)) -> DataFrame:
    return df.withColumn("tier", _tier(F.col("finish"), cuts))


def group_tier(df: DataFrame, cuts: dict[str, tuple[int, ...]], other: int = 4) -> DataFrame:
    """Tier by the group's own cuts; groups without cuts fall in the last tier."""
    out = F.lit(other)
    for g, c in cuts.items():
        out = F.when(F.col("grp") == g, _tier(F.col("group_finish"), c)).otherwise(out)
    return df.withColumn("group_tier", out)


def season_index(df: DataFrame) -> DataFrame:
    """Number the seasons that occur; a year nobody has is no gap."""
    seasons = df.select("season").distinct()  # one row per season
    return small_join(df, seasons.withColumn("_s", F.row_number().over(Window.orderBy("season"))), ["season"], "inner")


def lag_pairs(df: DataFrame, value: str = "value", lags: int = 1,
              keep: tuple[str, ...] = ()) -> DataFrame:
    """``y1 .. y(lags+1)`` over runs of consecutive seasons, with the last season of the run."""
    rows = season_index(df.where(F.col(value).isNotNull()))
    cols = {f"y{lags + 1 - k}": F.lag(value, k).over(career()) for k in range(1, lags + 1)}
    out = rows.withColumns({**cols, "_back": F.lag("_s", lags).over(career()),
                            f"y{lags + 1}": F.col(value)})
    return out.where(F.col("_s") - F.col("_back") == lags).select(
        "entity", "season", *keep, *[f"y{k}" for k in range(1, lags + 2)])


def with_next(df: DataFrame, *cols: str) -> DataFrame:
    """Rows that have a following season on record, with ``next_*`` where the entity is in it."""
    rows = season_index(df)
    last = rows.agg(F.max("_s")).scalar()
    near = F.lead("_s").over(career()) == F.col("_s") + 1
    return rows.withColumns(
        {f"next_{c}": F.when(near, F.lead(c).over(career())) for c in cols}
    ).where(F.col("_s") < last).drop("_s")


def conditional_finish_prob(ranked: DataFrame, new: int, old: int, strict: bool = False) -> DataFrame:
    """Per season: share of the first ``old`` that are in the first ``new`` a season later."""
    edge = 1 if strict else 0
    pairs = with_next(ranked.select("entity", "season", "finish"), "finish")
    return pairs.where(F.col("finish") <= old - edge).groupBy("season").agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col("next_finish") <= new - edge, 1.0).otherwise(0.0)).alias("prob"))


def _curve(pairs: DataFrame, hit: Column, lowest: int, within: list[str]) -> DataFrame:
    """Mean over seasons of share(hit <= k among finish <= k) for every k, from two histograms."""
    key = [*within, "season"]
    base = pairs.where(F.col("finish") <= lowest).groupBy(*key, F.col("finish").alias("k")).agg(
        F.count("*").alias("_n"))
    hits = pairs.where(hit <= lowest).groupBy(*key, hit.alias("k")).agg(F.count("*").alias("_h"))
    grid = pairs.select(*key).distinct().withColumn(
        "k", F.explode(F.sequence(F.lit(1), F.lit(lowest))))
    up = Window.partitionBy(*key).orderBy("k")  # ``lowest`` rows
    full = grid.join(base, [*key, "k"], "left").join(hits, [*key, "k"], "left").select(
        *key, "k", F.sum(F.coalesce("_n", F.lit(0))).over(up).alias("_n"),
        F.sum(F.coalesce("_h", F.lit(0))).over(up).alias("_h"))
    return full.groupBy(*within, "k").agg(F.avg(safe_div("_h", "_n")).alias("prob"))


def _finish_pairs(ranked: DataFrame, within: list[str], strict: bool) -> DataFrame:
    """Finish and next finish; strict moves both up one place and leaves out the last transition."""
    pairs = with_next(ranked.select("entity", "season", "finish", *within), "finish")
    if not strict:
        return pairs
    last = ranked.agg(F.max("season")).scalar()
    return pairs.where(F.col("season") < last - 1).withColumns({
        "finish": F.col("finish") + 1, "next_finish": F.col("next_finish") + 1})


def repeat_curve(ranked: DataFrame, lowest: int = 100, by_group: bool = False,
                 strict: bool = False) -> DataFrame:
    """P(next finish <= k given finish <= k) for k = 1 .. lowest, zero where nobody qualifies."""
    within = ["grp"] if by_group else []
    pairs = _finish_pairs(ranked, within, strict)
    both = F.when(F.col("next_finish").isNotNull(), F.greatest("finish", "next_finish"))
    return _curve(pairs, both, lowest, within).withColumn("prob", F.coalesce("prob", F.lit(0.0)))


def new_finish_curve(ranked: DataFrame, lowest: int = 100, new: int = 10, strict: bool = False) -> DataFrame:
    """P(next finish <= new given finish <= k) for k = 1 .. lowest."""
    pairs = _finish_pairs(ranked, [], strict)
    return _curve(pairs, F.when(F.col("next_finish") <= new, F.col("finish")), lowest, [])


def markov_matrix(pairs: DataFrame, states: int = 200) -> DataFrame:
    """Transition probabilities from finish i to j, every row replaced by its linear fit.

    The fit over j = 1 .. states needs only the row's mean, so no dense matrix is aggregated.
    """
    mean = (states + 1) / 2
    sxx = states * (states**2 - 1) / 12
    kept = pairs.where((F.col("y1") <= states) & (F.col("y2") <= states))
    rows = kept.groupBy(F.col("y1").cast("int").alias("i")).agg(F.avg("y2").alias("_mean"))
    slope = (F.col("_mean") - mean) / sxx
    line = F.when(F.col("_mean").isNull(), 0.0).otherwise(
        F.lit(1.0 / states) + slope * (F.col("j") - mean))
    every = kept.sparkSession.range(1, states + 1).select(F.col("id").cast("int").alias("i"))
    return (
        every.join(rows, "i", "left")
        .withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(states))))
        .select("i", "j", line.alias("prob"))
    )


def one_step_expectation(matrix: DataFrame, states: int = 200) -> DataFrame:
    """Whole part of the expected next finish; missing mass sits on the state after the last."""
    mass = F.sum("prob")
    rest = F.greatest(F.lit(0.0), 1.0 - mass) * (states + 1)
    return matrix.groupBy("i").agg(
        F.floor(F.sum(F.col("j") * F.col("prob")) + rest + 1e-6).alias("expected"))


def repeat_stats_rank(pairs: DataFrame, buckets: int = 250) -> DataFrame:
    """Spread of the next finish per earlier finish; a finish occurs once per season."""
    lo, hi = t_interval("y2")
    q = lambda p: F.percentile("y2", F.lit(p))
    return (
        pairs.where(F.col("y1") <= buckets).groupBy(F.col("y1").alias("prev_finish")).agg(
            F.count("*").alias("n"), F.min("y2").alias("min"), q(0.25).alias("q1"),
            q(0.5).alias("median"), F.avg("y2").alias("mean"), q(0.75).alias("q3"),
            F.max("y2").alias("max"), F.stddev_samp("y2").alias("sd"), lo.alias("ci_lo"),
            hi.alias("ci_hi"))
        .where("n >= 2")
    )


def repeat_stats_value(pairs: DataFrame, width: float = 25.0, buckets: int | None = None) -> DataFrame:
    """Spread of the next value per bucket of the earlier value; ``buckets`` keeps the first ones only."""
    lo, hi = t_interval("y2")
    b = pairs.withColumn("bucket", (F.floor(F.col("y1") / width) + 1) * width).where(F.col("y1") >= 0)
    if buckets is not None:
        b = b.where(F.col("y1") < width * buckets)
    stats = b.groupBy("bucket").agg(
        F.count("*").alias("n"), F.avg("y2").alias("mean"), F.stddev_samp("y2").alias("sd"),
        lo.alias("ci_lo"), hi.alias("ci_hi")).where("n >= 2")
    return stats.join(group_quantiles(b, ["bucket"], "y2", {"median": 0.5}).drop("n"), "bucket")


def smoothed_repeat(pairs: DataFrame, smooth: int, cohorts: int) -> DataFrame:
    """Per cohort of ``smooth + 1`` finishes: share whose next finish is no worse than its last."""
    size = smooth + 1
    c = pairs.withColumn("cohort", F.floor((F.col("y1") - 1) / size) + 1).where(
        F.col("y1") <= size * cohorts)
    stay = F.when(F.col("y2") <= F.col("cohort") * size, 1.0).otherwise(0.0)
    return c.groupBy("cohort").agg(F.count("*").alias("n"), F.avg(stay).alias("prob"))


def quantile_profile(df: DataFrame, top: int = 200, levels: int = 20, min_rows: int = 5) -> DataFrame:
    """Quantiles of the best ``top`` values of each season, mean and interval over seasons."""
    points = [(k + 1) / levels for k in range(levels)]
    best = top_rows(df.select(*ES, "value"), ["season"], "value", top, ["entity"])
    per = best.groupBy("season").agg(
        F.count("*").alias("_n"),
        F.percentile("value", F.array(*[F.lit(x) for x in points])).alias("_q"))
    lo, hi = t_interval("q")
    return per.where(F.col("_n") >= min_rows).select(F.posexplode("_q").alias("step", "q")).groupBy(
        (F.col("step") + 1).alias("step")).agg(
        F.avg("q").alias("mean"), lo.alias("ci_lo"), hi.alias("ci_hi"))


def line_fit(pairs: DataFrame, within: list[str], min_pairs: int = 2) -> DataFrame:
    """Least squares of y2 on y1 per key: R2, RMSE, slope, intercept, n."""
    n = F.regr_count("y2", "y1")
    left = F.regr_syy("y2", "y1") - F.regr_slope("y2", "y1") * F.regr_sxy("y2", "y1")
    return pairs.groupBy(*within).agg(
        n.alias("n"), F.regr_r2("y2", "y1").alias("r2"),
        F.sqrt(F.greatest(F.lit(0.0), left) / n).alias("rmse"),
        F.regr_slope("y2", "y1").alias("slope"), F.regr_intercept("y2", "y1").alias("intercept"),
    ).where(F.col("n") >= min_pairs)


def lag_regression(df: DataFrame, value: str = "value", lags: int = 1) -> DataFrame:
    """One row: fit of a season on the 1 to 3 before it."""
    pairs = lag_pairs(df, value, lags)
    if lags == 1:
        return line_fit(pairs.withColumn("lags", F.lit(1)), ["lags"])
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    x = [f"y{k}" for k in range(1, lags + 1)]
    data = VectorAssembler(inputCols=x, outputCol="features").transform(
        pairs.select(*[F.col(c).cast("double") for c in [*x, f"y{lags + 1}"]]))
    fit = LinearRegression(labelCol=f"y{lags + 1}", solver="normal").fit(data)
    s = fit.summary
    row = [(lags, s.numInstances, s.r2, s.rootMeanSquaredError, float(fit.intercept),
            [float(c) for c in fit.coefficients])]
    return df.sparkSession.createDataFrame(
        row, "lags int, n bigint, r2 double, rmse double, intercept double, slopes array<double>")


def ever_top(ranked: DataFrame, top: int = 200) -> DataFrame:
    """All seasons of entities that were in the first ``top`` at least once."""
    return ranked.join(ranked.where(F.col("finish") <= top).select("entity").distinct(),
                       "entity", "left_semi")


def career_trajectory(ranked: DataFrame, max_year: int = 15, top: int = 200) -> DataFrame:
    """Mean value with interval and mean per-game value by career year."""
    lo, hi = t_interval("value", 3)
    rows = ever_top(career_year(ranked), top).where(F.col("career_year") <= max_year)
    return rows.groupBy("career_year").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean_value"), lo.alias("ci_lo"),
        hi.alias("ci_hi"), F.avg(safe_div("value", "games")).alias("mean_ppg"))


def peak_career_year(ranked: DataFrame, top: int = 200) -> DataFrame:
    """Career year of the entity's best season."""
    return ever_top(career_year(ranked), top).groupBy("entity").agg(
        F.max_by(F.struct("grp", "career_year", "value"),
                 F.struct("value", -F.col("season"))).alias("_r")).select("entity", "_r.*")


def peak_summary(peaks: DataFrame) -> DataFrame:
    means = peaks.groupBy("grp").agg(F.avg("career_year").alias("mean_peak"))
    return means.join(group_quantiles(peaks, ["grp"], "career_year", {"median_peak": 0.5}), "grp")


def tier_transition(df: DataFrame, tier: str = "tier", within: tuple[str, ...] = ()) -> DataFrame:
    """Share of each tier's rows found in every tier a season later."""
    counts = lag_pairs(df, tier, 1, within).groupBy(*within, "y1", "y2").agg(F.count("*").alias("n"))
    row = Window.partitionBy(*within, "y1")
    return counts.select(*within, F.col("y1").alias("from_tier"), F.col("y2").alias("to_tier"), "n",
                         (F.col("n") / F.sum("n").over(row)).alias("prob"))


def survival_curve(ranked: DataFrame, top: int = 200, max_years: int = 14) -> DataFrame:
    """Share of each group's cohort (first season in the top) in the top k years later."""
    in_top = F.col("finish") <= top
    first = F.min(F.when(in_top, F.col("season"))).over(Window.partitionBy("entity"))
    rows = ranked.withColumn("_anchor", first).where(in_top & F.col("_anchor").isNotNull())
    rows = rows.withColumn("relative_year", F.col("season") - F.col("_anchor"))
    mine = F.max(F.when(F.col("relative_year") == 0, F.col("grp"))).over(Window.partitionBy("entity"))
    kept = rows.withColumn("_mine", mine).where(
        (F.col("grp") == F.col("_mine")) & (F.col("relative_year") <= max_years))
    alive = kept.groupBy("grp", "relative_year").agg(F.count("*").alias("_alive"))
    cohort = alive.where("relative_year = 0").select("grp", F.col("_alive").alias("n_cohort"))
    grid = cohort.withColumn("relative_year", F.explode(F.sequence(F.lit(0), F.lit(max_years))))
    return grid.join(alive, ["grp", "relative_year"], "left").select(
        "grp", "relative_year", "n_cohort",
        (F.coalesce("_alive", F.lit(0)) / F.col("n_cohort")).alias("survival_rate"))


def group_share_over_time(df: DataFrame, groups: list[str]) -> DataFrame:
    """Percent of the season's value per group, one column per group."""
    sums = df.where(F.col("grp").isin(groups)).groupBy("season").pivot("grp", groups).agg(F.sum("value"))
    parts = [F.coalesce(F.col(f"`{g}`"), F.lit(0.0)) for g in groups]
    total = sum(parts[1:], parts[0])
    return sums.select("season", *[(safe_div(v, total) * 100).alias(g) for g, v in zip(groups, parts)])


def era_fit(df: DataFrame, eras: list[tuple[int, int]], value: str = "value",
            min_pairs: int = 50) -> DataFrame:
    """Lag-1 fit per era, both seasons inside it; eras may overlap."""
    spans = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in eras])
    pairs = lag_pairs(df, value).withColumn("_e", F.explode(spans))
    inside = pairs.where((F.col("season") <= F.col("_e.b")) & (F.col("season") - 1 >= F.col("_e.a")))
    return line_fit(inside.withColumn("era", F.concat_ws("-", "_e.a", "_e.b")), ["era"], min_pairs)


def breakout_probability(ranked: DataFrame, elite: int = 50, outside: int = 150, years: int = 10) -> DataFrame:
    """P(in the elite next season | outside the cut now) by career year, over seasons."""
    rows = with_next(career_year(ranked).select(*ES, "finish", "career_year"), "finish")
    cells = rows.where((F.col("finish") > outside) & (F.col("career_year") <= years)).groupBy(
        "season", "career_year").agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col("next_finish") <= elite, 1.0).otherwise(0.0)).alias("_p")).where("n >= 3")
    q = lambda p: F.percentile("_p", F.lit(p))  # noqa: E731  one row per season
    return cells.groupBy("career_year").agg(
        F.avg("_p").alias("mean_p"), q(0.05).alias("ci_lo"), q(0.95).alias("ci_hi"),
        F.sum("n").alias("n"))


def rate_vs_total_fit(df: DataFrame, min_pairs: int = 50) -> DataFrame:
    """Lag-1 fit of the per-game value beside the total, same rows."""
    rows = df.withColumn("ppg", safe_div("value", "games")).where(F.col("ppg").isNotNull())
    both = [lag_pairs(rows, c).select(F.lit(n).alias("measure"), F.col("y1").cast("double").alias("y1"),
                                      F.col("y2").cast("double").alias("y2"))
            for n, c in (("total", "value"), ("per_game", "ppg"))]
    return line_fit(both[0].unionByName(both[1]), ["measure"], min_pairs)


def career_cohort(df: DataFrame, min_seasons: int, year: int) -> DataFrame:
    """Row in career year ``year`` of entities with enough seasons."""
    n = F.count("*").over(Window.partitionBy("entity"))
    return career_year(df).withColumn("n_seasons", n).where(
        (F.col("n_seasons") >= min_seasons) & (F.col("career_year") == year))


def shrinkage_backtest(df: DataFrame, folds: int = 5, last_year: int = 12) -> DataFrame:
    """Career year N from N-1: prior mean of the other folds at weight 1/N, against simple forecasts.

    The prior of a fold is (group total - fold total) over the counts: no refit per fold.
    """
    # text ids go to folds by a hash
    number = F.xxhash64("entity") if dict(df.dtypes)["entity"] == "string" else F.col("entity")
    earlier = career().rowsBetween(Window.unboundedPreceding, -1)
    near = F.lag("career_year").over(career()) == F.col("career_year") - 1
    past = F.array_sort(F.collect_list("value").over(earlier))
    size = F.size(past)
    median = (F.try_element_at(past, F.floor((size + 1) / 2).cast("int"))
              + F.try_element_at(past, F.floor((size + 2) / 2).cast("int"))) / 2
    rows = career_year(df).withColumns({
        "_n": F.count("*").over(Window.partitionBy("entity")),
        "naive": F.when(near, F.lag("value").over(career())),
        "mean_fc": F.avg("value").over(earlier),
        "median_fc": median,
        "fold": F.pmod(number, F.lit(folds)).cast("int"),
    })
    year = F.col("career_year")
    rows = rows.where((year >= 2) & (year <= last_year) & (F.col("_n") >= year))
    parts = rows.groupBy("career_year", "grp", "fold").agg(
        F.sum("value").alias("_s"), F.count("*").alias("_c"), F.count("naive").alias("_pairs"))
    whole = Window.partitionBy("career_year", "grp")
    prior = parts.select(
        "career_year", "grp", "fold",
        safe_div(F.sum("_s").over(whole) - F.col("_s"), F.sum("_c").over(whole) - F.col("_c"))
        .alias("prior"),
        F.sum("_pairs").over(whole).alias("_pairs"))
    out = rows.join(prior, ["career_year", "grp", "fold"]).where(
        (F.col("_pairs") >= folds * 2) & F.col("naive").isNotNull())
    shrunk = F.col("prior") / year + F.col("naive") * (year - 1) / year
    return out.select("entity", "season", "career_year", "grp", "fold", F.col("value").alias("actual"),
                      "prior", shrunk.alias("shrunk"), "naive", "mean_fc", "median_fc")


def shrinkage_summary(backtest: DataFrame) -> DataFrame:
    mae = lambda c: F.avg(F.abs(F.col(c) - F.col("actual")))
    return backtest.groupBy("career_year", "grp").agg(
        F.count("*").alias("n"), mae("shrunk").alias("shrunk_mae"), mae("naive").alias("naive_mae"),
        mae("mean_fc").alias("mean_mae"), mae("median_fc").alias("median_mae"))


def series_backtest(df: DataFrame, min_seasons: int = 3) -> DataFrame:
    """One-step-ahead mean, naive and drift forecasts of each entity's series; MAE per group."""
    earlier = career().rowsBetween(Window.unboundedPreceding, -1)
    last, first = F.lag("value").over(career()), F.first("value").over(earlier)
    t = F.row_number().over(career()) - 1
    rows = df.withColumns({
        "_n": F.count("*").over(Window.partitionBy("entity")), "_t": t, "naive": last,
        "mean": F.avg("value").over(earlier),
        "drift": F.when(t >= 2, last + (last - first) / (t - 1)).otherwise(last),
    }).where((F.col("_n") >= min_seasons) & (F.col("_t") >= 1))
    err = lambda c: F.avg(F.abs(F.greatest(F.lit(0.0), F.col(c)) - F.col("value")))
    return rows.groupBy("grp").agg(F.count("*").alias("n"), *[
        err(c).alias(c + "_mae") for c in ("mean", "naive", "drift")])


def _smoothing_grid(step: float, trend: bool, damping: tuple[float, ...]) -> list[tuple]:
    k = round(1 / step)
    points = [round(i * step, 4) for i in range(1, k)]
    return [(a, b if trend else 0.0, d) for a in points for b in (points if trend else [0.0])
            for d in damping]


#: Series smoothed at a time in a task.
_SERIES = 256


def _one_step(y: np.ndarray, size: np.ndarray, grid: list[tuple], trend: bool) -> np.ndarray:
    """Forecasts of y[:, 1:] (series padded at the end): each by the grid point with the least squared error before it.

    All series and grid points take a step together; of equal errors the least forecast counts.
    """
    a, b, d = (np.array(x) for x in zip(*grid, strict=True))
    level = np.repeat(y[:, :1], len(grid), axis=1)
    slope = np.repeat(y[:, 1:2] - y[:, :1], len(grid), axis=1) if trend else np.zeros_like(level)
    error, out = np.zeros_like(level), np.full((len(y), y.shape[1] - 1), np.nan)
    for t in range(1, y.shape[1]):
        v = y[:, t: t + 1]
        f = level + d * slope
        best = np.where(error == error.min(axis=1, keepdims=True), f, np.inf).min(axis=1)
        # a trend is fitted from three points on; until then the last value stands
        out[:, t - 1] = best if t >= (3 if trend else 1) else y[:, t - 1]
        new = f + a * (v - f)
        slope = b * (new - level) + (1 - b) * d * slope
        level, error = new, error + (v - f) * (v - f)
    return out


def smoothing_backtest(df: DataFrame, step: float = 0.05, min_seasons: int = 3) -> DataFrame:
    """Simple, Holt and damped smoothing, one step ahead, refitted on every prefix by grid search.

    A recursion run once per grid point yields the forecast and the squared error so far at every step, so the best
    point of each prefix is a minimum over the grid. A series is an entity's seasons; series are smoothed in Arrow
    batches, some hundred at a time.
    """
    series = df.groupBy("entity", F.col("grp").cast("string").alias("grp")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("season", F.col("value").cast("double").alias("value")))),
                    lambda x: x["value"]).alias("y")).where(F.size("y") >= min_seasons)
    grids = {"simple": _smoothing_grid(step, False, (1.0,)), "holt": _smoothing_grid(step, True, (1.0,)),
             "damped": _smoothing_grid(step, True, (0.8, 0.9, 0.98))}
    ship(df.sparkSession)
    schema = "grp string, actual double, simple double, holt double, damped double"

    def work(batches):
        for batch in batches:
            whole, sizes = batch.column(1), batch.column(1).value_lengths().to_numpy()
            flat = whole.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for at in range(0, batch.num_rows, _SERIES):
                n = sizes[at: at + _SERIES]
                here = np.arange(n.max()) < n[:, None]
                y = np.zeros(here.shape)
                y[here] = flat[starts[at]: starts[at] + n.sum()]
                known = here[:, 1:]
                found = [_one_step(y, n, grid, name != "simple")[known] for name, grid in grids.items()]
                grp = batch.column(0).slice(at, len(n)).take(pa.array(np.repeat(np.arange(len(n)), n - 1)))
                yield pa.RecordBatch.from_arrays(
                    [grp, *[pa.array(x) for x in (y[:, 1:][known], *found)]], ["grp", "actual", *grids])

    long = series.select("grp", "y").mapInArrow(work, schema)
    err = lambda c: F.avg(F.abs(F.greatest(F.lit(0.0), F.col(c)) - F.col("actual")))
    return long.groupBy("grp").agg(F.count("*").alias("n"), *[err(c).alias(c + "_mae") for c in grids])
