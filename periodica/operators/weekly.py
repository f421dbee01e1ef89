"""In-season form, matchup and variance features; risk bands. One row per entity, season, period.

All windows run inside one season of one entity and look at earlier rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, group_code, lookup, safe_div
from ..functions.ordered import Rank, add_ranks, group_quantiles, running_total, spearman
from ..functions.records import stage
from ..settings import Settings

KEY = ["entity", "season", "period"]
MEAN_FLOOR = 3.0          # least mean in a coefficient of variation
OTHER_BOOM_BUST = (20.0, 10.0)

# Offsets of the floor and ceiling bands.
BAND_OFFSETS = {"Low": (-5.21, 6.32), "Medium": (-5.64, 5.20), "High": (-6.26, 6.47)}
OTHER_OFFSETS = (-5.5, 6.5)

# The columns that weekly models learn from.
FEATURES = [
    "lag1", "ma3", "ma5", "season_avg", "targets_ma3", "carries_ma3", "receptions_ma3", "target_share_ma3",
    "trend", "games_played", "period_norm", "grp_code", "opp_allowed_avg", "prior_ppg", "prior_games",
]


def in_form():
    return Window.partitionBy("entity", "season").orderBy("period")


def last(n: int):
    return in_form().rowsBetween(-n, -1)


def matchup_table(log: DataFrame) -> DataFrame:
    """Mean value a team allowed to a group over its earlier periods of the season."""
    allowed = log.where(F.col("opponent").isNotNull()).groupBy(
        F.col("opponent").alias("def_team"), "season", "period", "grp").agg(F.sum("value").alias("_v"))
    before = Window.partitionBy("def_team", "season", "grp").orderBy("period").rowsBetween(
        Window.unboundedPreceding, -1)
    return allowed.select("def_team", "season", "period", "grp", F.avg("_v").over(before).alias("opp_allowed_avg"))


def form_features(log: DataFrame, settings: Settings) -> DataFrame:
    """Every window feature, the first game of a season included."""
    v = F.col("value")
    boom = lookup({g: t[0] for g, t in settings.boom_bust.items()}, "grp", OTHER_BOOM_BUST[0])
    bust = lookup({g: t[1] for g, t in settings.boom_bust.items()}, "grp", OTHER_BOOM_BUST[1])
    df = log.withColumns({"_boom": F.when(v >= boom, 1.0).when(v.isNotNull(), 0.0),
                          "_bust": F.when(v <= bust, 1.0).when(v.isNotNull(), 0.0)})
    volume = {f"{c}_ma3": F.avg(c).over(last(3)) if c in log.columns else F.lit(None).cast("double")
              for c in ("targets", "carries", "receptions", "target_share")}
    df = df.withColumns({
        "lag1": F.lag("value").over(in_form()), "ma3": F.avg("value").over(last(3)),
        "ma5": F.avg("value").over(last(5)), "season_avg": F.avg("value").over(in_form().rowsBetween(Window.unboundedPreceding, -1)),
        **volume, "games_played": F.row_number().over(in_form()) - 1,
        "std3": F.coalesce(F.stddev_samp("value").over(last(3)), F.lit(0.0)),
        "std5": F.coalesce(F.stddev_samp("value").over(last(5)), F.lit(0.0)),
        "boom_rate5": F.coalesce(F.avg("_boom").over(last(5)), F.lit(0.0)),
        "bust_rate5": F.coalesce(F.avg("_bust").over(last(5)), F.lit(0.0)),
    })
    return df.withColumns({
        "trend": F.col("lag1") - F.col("ma3"), "period_norm": (F.col("period") - 1) / float(settings.season_steps),
        "grp_code": group_code(settings.group_codes),
        # rounded so that equal histories in another order rank alike
        "cv5": F.round(F.col("std5") / F.greatest(F.coalesce("ma5", F.lit(0.0)), F.lit(MEAN_FLOOR)), 6),
    }).drop("_boom", "_bust")


def with_context(form: DataFrame, matchups: DataFrame | None = None,
                 totals: DataFrame | None = None) -> DataFrame:
    """Join the opponent's record and the entity's season before."""
    none = F.lit(None).cast("double")
    if matchups is None or "opponent" not in form.columns:
        form = form.withColumn("opp_allowed_avg", none)
    else:
        form = form.join(matchups.withColumnRenamed("def_team", "opponent"),
                         ["opponent", "season", "period", "grp"], "left")
    if totals is None:
        return form.withColumns({"prior_ppg": none, "prior_games": none})
    prior = totals.select("entity", (F.col("season") + 1).cast("int").alias("season"),
                          F.coalesce(safe_div("value", "games"), F.lit(0.0)).alias("prior_ppg"),
                          F.col("games").cast("double").alias("prior_games"))
    return form.join(prior, ["entity", "season"], "left")


def weekly_panel(log: DataFrame, settings: Settings, matchups: DataFrame | None = None,
                 totals: DataFrame | None = None) -> DataFrame:
    """Rows with at least one earlier game; windows still see the first game."""
    rows = form_features(log, settings).where("games_played >= 1")
    return with_context(rows, matchups, totals).withColumn("target", F.col("value"))


def variance_features(panel: DataFrame, per_season: bool = False) -> DataFrame:
    """0-100 score: mean of the in-group percentiles of variation and boom rate."""
    within = ("grp", "season") if per_season else ("grp",)
    ranked = add_ranks(panel, KEY, [Rank("_cv", "cv5", within, "pct", False),
                                    Rank("_boom", "boom_rate5", within, "pct", False)])
    score = F.bround(F.round(50.0 * (F.col("_cv") + F.col("_boom")), 6), 1)
    return ranked.withColumn("explosiveness", score).drop("_cv", "_boom")


def weekly_feature_matrix(panel: DataFrame, keep: tuple[str, ...] = tuple(KEY)) -> DataFrame:
    return panel.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                                 for c in FEATURES if c in panel.columns])


def upcoming_rows(log: DataFrame, season: int, period: int, settings: Settings,
                  schedule: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """Features of the next, unplayed period for entities with a game this season."""
    history = log.where((F.col("season") == season) & (F.col("period") < period))
    labels = [c for c in ("entity_name", "grp", "team") if c in log.columns]
    ahead = history.groupBy("entity").agg(
        *[F.max_by(c, "period").alias(c) for c in labels]
    ).withColumns({"season": F.lit(season), "period": F.lit(period)})
    if schedule is not None:
        ahead = ahead.join(schedule.select("team", "opponent"), "team", "left")
    cols = [c for c in log.columns if schedule is not None or c != "opponent"]
    both = history.select(*[c for c in cols]).unionByName(ahead, allowMissingColumns=True)
    rows = form_features(both, settings).where(F.col("period") == period)
    return with_context(rows, matchup_table(both) if schedule is not None else None, totals)


#: A period after every other, for a season that is over.
AFTER_LAST = (1 << 31) - 1


def variance_snapshot(log: DataFrame, season: int, period: int, settings: Settings) -> DataFrame:
    """Spread, variation, boom and bust rate of the last five games before a period."""
    return upcoming_rows(log, season, period, settings).select("entity", "std5", "cv5", "boom_rate5", "bust_rate5")


def score_scaler(panel: DataFrame, min_games: int = 3) -> DataFrame:
    """Reference distribution per group: how often each value of each measure occurred."""
    pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v"))
                      for c in ("cv5", "boom_rate5")])
    long = panel.where(F.col("games_played") >= min_games).select("grp", F.explode(pairs).alias("_p"))
    return long.select("grp", "_p.*").where("v IS NOT NULL").groupBy("grp", "measure", "v").agg(
        F.count("*").alias("rows"))


def score_explosiveness(rows: DataFrame, scaler: DataFrame, ids: list[str]) -> DataFrame:
    """Share of the reference at or below each new value, both measures averaged to 0-100.

    Reference and new rows are merged into one order, a value's references first, so the count is one running total
    that stays on the new row.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v"))
                      for c in ("cv5", "boom_rate5")])
    key = ["grp", "measure"]
    asked = rows.select(*ids, "grp", F.explode(pairs).alias("_p")).select(*ids, "grp", "_p.*").where("v IS NOT NULL")
    merged = scaler.select(*key, "v", F.lit(0).alias("_new"), "rows").unionByName(
        asked.withColumns({"_new": F.lit(1), "rows": F.lit(0).cast("bigint")}), allowMissingColumns=True)
    placed = running_total(merged, key, ["v", "_new", *ids], F.col("rows"), "_before", "_n").where("_new = 1")
    got = placed.groupBy(*ids).agg(F.bround(F.round(
        50.0 * F.sum(F.try_divide(F.col("_before"), F.col("_n"))), 6), 1).alias("explosiveness"))
    return rows.join(got, ids, "left").withColumn("explosiveness", F.coalesce("explosiveness", F.lit(50.0)))


def tercile_thresholds(panel: DataFrame, value: str = "explosiveness") -> DataFrame:
    return group_quantiles(panel, ["grp"], value, {"lo": 1 / 3, "hi": 2 / 3}).drop("n")


def apply_tercile(rows: DataFrame, thresholds: DataFrame, out: str = "risk_tier") -> DataFrame:
    """Low below the first cut, High above the second; unknown groups use 33.3 and 66.7."""
    s = F.col("explosiveness")
    tier = F.when(s < F.coalesce("lo", F.lit(33.3)), "Low").when(
        s > F.coalesce("hi", F.lit(66.7)), "High").otherwise("Medium")
    return rows.join(thresholds, "grp", "left").withColumn(out, tier).drop("lo", "hi")


def explosiveness_tercile(panel: DataFrame, value: str = "explosiveness") -> DataFrame:
    """Three equal-count bins per group, right-closed; Medium throughout where edges repeat."""
    q = group_quantiles(panel, ["grp"], value, {"_e0": 0.0, "_e1": 1 / 3, "_e2": 2 / 3, "_e3": 1.0}).drop("n")
    v = F.col(value)
    distinct = (F.col("_e0") < F.col("_e1")) & (F.col("_e1") < F.col("_e2")) & (F.col("_e2") < F.col("_e3"))
    tier = F.when(~distinct, "Medium").when(v <= F.col("_e1"), "Low").when(
        v <= F.col("_e2"), "Medium").otherwise("High")
    return panel.join(q, "grp", "left").withColumn("tercile", tier).drop("_e0", "_e1", "_e2", "_e3")


def risk_bands(board: DataFrame, thresholds: DataFrame,
               bands: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Risk tier, floor and ceiling around the projection."""
    bands = bands or BAND_OFFSETS
    low = lookup({t: b[0] for t, b in bands.items()}, "risk_tier", OTHER_OFFSETS[0])
    high = lookup({t: b[1] for t, b in bands.items()}, "risk_tier", OTHER_OFFSETS[1])
    return apply_tercile(board, thresholds).withColumns({
        "floor": F.bround(F.greatest(F.lit(0.0), F.col("proj_points") + low), 1),
        "ceiling": F.bround(F.col("proj_points") + high, 1)})


def variance_persistence(panel: DataFrame, min_games: int = 10, min_pairs: int = 8) -> DataFrame:
    """Rank correlation of first- and second-half variation per group."""
    size = F.count("*").over(Window.partitionBy("entity", "season"))
    rows = panel.withColumns({"_n": size, "_i": F.row_number().over(in_form())}).where(F.col("_n") >= min_games)
    first = F.col("_i") <= F.floor(F.col("_n") / 2)

    def cv(half: Column) -> Column:
        v = F.when(half, F.col("target"))
        return F.stddev_samp(v) / F.greatest(F.avg(v), F.lit(MEAN_FLOOR))

    halves = rows.groupBy("entity", "season", "grp").agg(
        F.round(cv(first), 6).alias("first_cv"), F.round(cv(~first), 6).alias("second_cv"))
    out = spearman(halves, ["entity", "season"], ["grp"], "first_cv", "second_cv")
    groups = panel.select("grp").distinct()
    return groups.join(out, "grp", "left").select(
        "grp", F.coalesce("n", F.lit(0)).alias("n"),
        F.when(F.col("n") >= min_pairs, F.col("spearman_r")).alias("spearman_r"))


def _on_panel(cv: DataFrame, panel: DataFrame, *cols: str) -> DataFrame:
    right = panel.select("entity", F.col("season").alias("eval_season"), "period", *cols)
    return cv.join(right, ["entity", "eval_season", "period"])


def variance_vs_error(cv: DataFrame, panel: DataFrame) -> DataFrame:
    rows = _on_panel(cv, panel, "explosiveness")
    return spearman(rows, ["model", "entity", "eval_season", "period"], ["model"], "explosiveness", "abs_error")


def calibrate_bands(cv: DataFrame, panel: DataFrame, lo: float = 0.20, hi: float = 0.80) -> DataFrame:
    """Residual quantiles per tercile: what to add to a projection for floor and ceiling."""
    rows = _on_panel(cv, explosiveness_tercile(panel), "tercile").withColumn(
        "_r", F.col("actual") - F.col("predicted"))
    q = group_quantiles(rows, ["tercile"], "_r", {"floor_offset": lo, "ceiling_offset": hi})
    return q.withColumns({c: F.bround(F.round(c, 8), 2) for c in ("floor_offset", "ceiling_offset")})


def coverage(cv: DataFrame, panel: DataFrame, bands: DataFrame) -> DataFrame:
    """Share of actuals inside the band."""
    rows = _on_panel(cv, explosiveness_tercile(panel), "tercile").join(
        bands.select("tercile", "floor_offset", "ceiling_offset"), "tercile", "left")
    inside = F.col("actual").between(F.col("predicted") + F.col("floor_offset"),
                                     F.col("predicted") + F.col("ceiling_offset"))
    return rows.agg(F.count("*").alias("n"), F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("coverage"))


def compare_entities(board: DataFrame, a: str, b: str) -> DataFrame:
    """First name match of two search texts, and which has the higher floor and ceiling."""
    def find(text: str, tag: str) -> DataFrame:
        hit = board.where(F.lower("entity_name").contains(text.lower()))
        return hit.orderBy("grp", F.desc("proj_points"), "entity").limit(1).select(
            F.lit(1).alias("_k"), *[F.col(c).alias(f"{c}_{tag}") for c in ("entity_name", "proj_points", "floor", "ceiling")])

    one = find(a, "a").join(find(b, "b"), "_k")  # one row a side
    better = lambda c: F.when(F.col(c + "_a") >= F.col(c + "_b"), F.col("entity_name_a")).otherwise(
        F.col("entity_name_b"))
    return one.withColumns({"higher_floor": better("floor"), "higher_ceiling": better("ceiling")}).drop("_k")


def baseline(name: str) -> Column:
    """Column-only weekly baselines."""
    zero = F.lit(0.0)
    if name == "rolling_mean":
        return F.greatest(zero, F.coalesce("ma3", "lag1", zero))
    return F.greatest(zero, F.coalesce("season_avg", "lag1", zero))


def weighted_blend() -> Column:
    lag1 = F.coalesce("lag1", F.lit(0.0))
    ma3 = F.when(F.coalesce("ma3", F.lit(0.0)) == 0, lag1).otherwise(F.col("ma3"))
    avg = F.when(F.coalesce("season_avg", F.lit(0.0)) == 0, ma3).otherwise(F.col("season_avg"))
    return 0.5 * lag1 + 0.3 * ma3 + 0.2 * avg


def opponent_factor(mean: Column | str) -> Column:
    ratio = safe_div("opp_allowed_avg", mean)
    usable = (F.col("opp_allowed_avg") > 0) & (col(mean) > 0)
    return F.when(usable, F.least(F.lit(1.6), F.greatest(F.lit(0.6), ratio))).otherwise(1.0)
