"""Season panel: lags, trends, forecast rows and the feature registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import flag, group_code, safe_div
from ..functions.ordered import top_rows
from ..settings import Settings

# Feature -> (tier, first season with data).
REGISTRY: dict[str, tuple[int, int]] = {
    "value_lag1": (0, 1999),
    "value_lag2": (0, 1999),
    "value_lag3": (0, 1999),
    "ppg_lag1": (0, 1999),
    "ppg_lag2": (0, 1999),
    "games_lag1": (0, 1999),
    "games_lag2": (0, 1999),
    "trend_1": (0, 1999),
    "trend_2": (0, 1999),
    "career_season": (0, 1999),
    "exp_smooth": (0, 1999),
    "grp_code": (0, 1999),
    "lag1_missing": (0, 1999),
    "lag2_missing": (0, 1999),
    "lag3_missing": (0, 1999),
    "age": (0, 1999),
    "age_squared": (0, 1999),
    "is_rookie": (0, 1999),
    "draft_pick": (0, 1980),
    "draft_round": (0, 1980),
    "is_undrafted": (0, 1980),
    "exp_points": (1, 2006),
    "exp_ppg": (1, 2006),
    "points_over_expected": (1, 2006),
    "poe_ppg": (1, 2006),
    "consensus_rank": (1, 2021),
    "consensus_grp_rank": (1, 2021),
    "consensus_projection": (1, 2021),
    "target_share_lag1": (1, 1999),
    "carry_share_lag1": (1, 1999),
    "periods_played_lag1": (1, 1999),
    "h2_vs_h1": (1, 1999),
    "snap_share_lag1": (2, 2012),
    "snap_share_trend": (2, 2012),
    "periods_above_50": (2, 2012),
    "periods_above_75": (2, 2012),
    "depth_position": (2, 2012),
    "team_pass_roe": (2, 2012),
    "air_yards_share": (2, 2012),
    "wopr": (2, 2012),
    "rz_target_share": (2, 2012),
    "rz_carry_share": (2, 2012),
    "changed_team": (2, 2012),
    "competition_capital": (2, 2012),
    "competition_count": (2, 2012),
    "separation_avg": (3, 2016),
    "cushion_avg": (3, 2016),
    "intended_air_yards": (3, 2016),
    "rush_yards_oe": (3, 2016),
    "efficiency": (3, 2016),
    "time_to_los": (3, 2016),
    "completion_pct_oe": (3, 2016),
    "participation_rate": (3, 2016),
    "broken_tackles": (4, 2018),
    "drop_rate": (4, 2018),
    "yac_per_rec": (4, 2018),
    "pressure_rate": (4, 2018),
    "contract_guaranteed": (4, 2018),
    "contract_years_left": (4, 2018),
    "games_missed_lag1": (4, 2009),
    "injury_reports_lag1": (4, 2009),
    "ftn_xyac": (4, 2022),
    "ftn_no_huddle_rate": (4, 2022),
}


def tier_columns(max_tier: int) -> list[str]:
    return sorted(c for c, (tier, _) in REGISTRY.items() if tier <= max_tier)


def tier_first_season(max_tier: int) -> int:
    """First season in which every column up to the tier has data."""
    return max(first for tier, first in REGISTRY.values() if tier <= max_tier)


def fold_seasons(totals: DataFrame, season_length: int = 17) -> DataFrame:
    """One row per entity and season: values summed, games at most (none given: a whole season), labels last."""
    labels = [F.max(c).alias(c) for c in ("entity_name", "grp", "team") if c in totals.columns]
    out = totals.groupBy("entity", "season").agg(
        *labels, F.sum("value").alias("value"), F.sum("value_base").alias("value_base"),
        (F.max("games") if "games" in totals.columns else F.lit(season_length)).alias("games"))
    return out.withColumn("ppg", F.coalesce(safe_div("value", "games"), F.lit(0.0)))


def blend(lag1: Column, lag2: Column, lag3: Column) -> Column:
    """0.5 / 0.3 / 0.2 blend over the lags that exist."""
    pairs = ((lag1, 0.5), (lag2, 0.3), (lag3, 0.2))
    num = sum((F.coalesce(v, F.lit(0.0)) * w for v, w in pairs), F.lit(0.0))
    den = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in pairs), F.lit(0.0))
    return F.try_divide(num, den)


def with_lags(seasons: DataFrame, codes: dict[str, int]) -> DataFrame:
    """Lags are the entity's previous rows, whatever the calendar gap."""
    w = Window.partitionBy("entity").orderBy("season")
    lagged = seasons.withColumns({
        **{f"value_lag{k}": F.lag("value", k).over(w) for k in (1, 2, 3)},
        **{f"ppg_lag{k}": F.lag("ppg", k).over(w) for k in (1, 2)},
        **{f"games_lag{k}": F.lag("games", k).over(w) for k in (1, 2)},
        "career_season": F.row_number().over(w) - 1,
    })
    l1, l2, l3 = (F.col(f"value_lag{k}") for k in (1, 2, 3))
    return lagged.withColumns({
        "trend_1": l1 - l2, "trend_2": l2 - l3, "exp_smooth": blend(l1, l2, l3),
        "grp_code": group_code(codes),
    })


def lag_panel(totals: DataFrame, settings: Settings) -> DataFrame:
    """Rows with at least one earlier season; ``target`` is this season's value."""
    out = with_lags(fold_seasons(totals), settings.group_codes)
    return out.withColumnRenamed("value", "target").where(F.col("value_lag1").isNotNull())


def forecast_rows(totals: DataFrame, season: int, settings: Settings) -> DataFrame:
    """One row per entity for a season not yet played, lags from its last three seasons."""
    past = fold_seasons(totals.where(F.col("season") < season))
    labels = [c for c in ("entity_name", "grp", "team") if c in past.columns]
    ahead = past.groupBy("entity").agg(
        *[F.max_by(c, "season").alias(c) for c in labels]
    ).withColumn("season", F.lit(season))
    rows = with_lags(past.unionByName(ahead, allowMissingColumns=True), settings.group_codes)
    return rows.where(F.col("season") == season).drop("value", "value_base", "games", "ppg")


def gap_filter(totals: DataFrame, season: int, max_gap: int = 2) -> DataFrame:
    """Entities seen in one of the two seasons before, without a long gap before the last one."""
    w = Window.partitionBy("entity").orderBy("season")
    last = totals.select("entity", "season").distinct().withColumn(
        "_gap", F.col("season") - F.lag("season").over(w))
    return (
        last.groupBy("entity").agg(F.max("season").alias("last_season"),
                                   F.max_by("_gap", "season").alias("_gap"))
        .where((F.col("last_season") >= season - 2)
               & (F.col("_gap").isNull() | (F.col("_gap") <= max_gap)))
        .drop("_gap")
    )


def missing_indicators(panel: DataFrame) -> DataFrame:
    return panel.withColumns({
        f"lag{k}_missing": flag(F.col(f"value_lag{k}").isNull())
        if f"value_lag{k}" in panel.columns else F.lit(0) for k in (1, 2, 3)
    })


def rookie_flag(panel: DataFrame) -> DataFrame:
    return panel.withColumn("is_rookie", flag(F.col("career_season") == 0))


def feature_matrix(panel: DataFrame, max_tier: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Registered columns present up to a tier, zero-filled."""
    cols = [c for c in tier_columns(max_tier) if c in panel.columns]
    return panel.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                                 for c in cols])


def top_n_entities(totals: DataFrame, n: int, season: int | None = None) -> DataFrame:
    """Best n entities per season by value, or of one season."""
    pool = totals if season is None else totals.where(F.col("season") == season)
    return top_rows(pool.select("entity", "season", "value"), ["season"], "value", n, ["entity"])
