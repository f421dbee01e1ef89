"""Ranks, value over replacement, gap tiers and board layouts. One row per entity and season."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import lookup
from ..functions.ordered import Rank, add_ranks, top_rows, with_bucket
from ..functions.records import stage
from ..settings import Settings
from .metrics import ENTITY_SEASON

# Reading order of the board.
BOARD_COLUMNS = (
    "season", "entity", "rank", "entity_name", "grp", "group_label", "team", "teams", "games", "games_active",
    "points", "ppg", "points_half", "ppg_half", "points_base", "ppg_base", "rank_ppg", "group_rank",
    "group_rank_ppg", "rank_delta", "rank_half", "rank_base", "vor_ppg", "vor_total", "tier", "floor",
    "ceiling", "median_week", "stdev", "cv", "best_week", "worst_week", "boom_weeks", "boom_rate", "bust_weeks",
    "bust_rate", "starter_weeks", "starter_week_rate", "top5_weeks", "best_group_finish", "touches", "touch_pg",
    "opportunities", "opp_pg", "target_share", "scrim_yards", "scrim_yds_pg", "total_yards", "total_tds",
    "tds_pg", "first_downs", "turnovers", "fumbles_lost", "two_pt", "pts_per_touch", "pts_per_opp",
    "yards_per_touch", "ypc", "ypr", "ypt", "catch_rate", "td_rate", "adot", "yac_per_rec", "completions",
    "attempts", "passing_yards", "passing_tds", "interceptions", "comp_pct", "ypa", "air_yards_pa",
    "td_int_ratio", "sack_rate", "carries", "rushing_yards", "rushing_tds", "targets", "receptions",
    "receiving_yards", "receiving_tds",
)


def season_ranks(df: DataFrame, settings: Settings) -> DataFrame:
    """Overall and group ranks; per-game ranks among entities with enough games only."""
    qualified = F.col("games") >= settings.min_games
    ranked = add_ranks(df, ENTITY_SEASON, [
        Rank("rank", "points", ("season",)),
        Rank("rank_half", "points_half", ("season",)),
        Rank("rank_base", "points_base", ("season",)),
        Rank("group_rank", "points", ("season", "grp")),
        Rank("rank_ppg", "ppg", ("season",), where=qualified),
        Rank("group_rank_ppg", "ppg", ("season", "grp"), where=qualified),
    ])
    return ranked.withColumns({
        "group_label": F.concat(F.col("grp").cast("string"), F.col("group_rank").cast("string")),
        "rank_delta": F.col("rank") - F.col("rank_ppg"),
    })


def replacement_levels(df: DataFrame, settings: Settings) -> DataFrame:
    """Per season and group: per-game value of the n-th best qualified entity, else the lowest."""
    n = settings.replacement_rank
    pool = df.where(
        (F.col("games") >= settings.min_games) & F.col("ppg").isNotNull()
        & F.col("grp").isin(list(n))
    ).select("season", "grp", "entity", "ppg")
    best = top_rows(pool, ["season", "grp"], "ppg", max(n.values(), default=1), ["entity"])
    # the lowest of the best n rows is the n-th, or the lowest of all where there are fewer
    return (
        best.where(F.col("row_rank") <= lookup(n, "grp", 0))
        .groupBy("season", "grp").agg(F.min("ppg").alias("replacement_ppg"))
        .withColumn("replacement_rank", lookup(n, "grp"))
    )


def add_vor(df: DataFrame, settings: Settings, levels: DataFrame | None = None) -> DataFrame:
    """Value over replacement per game and over the season."""
    levels = replacement_levels(df, settings) if levels is None else levels
    return df.join(levels.drop("replacement_rank"), ["season", "grp"], "left").withColumns({
        "vor_ppg": F.col("ppg") - F.col("replacement_ppg"),
        "vor_total": (F.col("ppg") - F.col("replacement_ppg")) * F.col("games"),
    })


def gap_tiers(df: DataFrame, within: list[str], value: str, gap, ids: list[str],
              out: str = "tier") -> DataFrame:
    """In descending order a new tier starts where the drop to the next value is at least the gap.

    ``gap`` is a number or a column constant within a key. Null values and null gaps get no tier.
    """
    gap = F.lit(gap) if isinstance(gap, (int, float)) else gap
    rows = df.select(*dict.fromkeys([*ids, *within]), (-F.col(value)).alias("_v"), gap.alias("_gap"))
    steps = stage(rows.where(F.col("_v").isNotNull() & F.col("_gap").isNotNull()))
    # tiers depend on distinct values only
    distinct = steps.groupBy(*within, "_v").agg(F.max("_gap").alias("_gap"))
    parts = with_bucket(distinct, within, ["_v"])
    inside = Window.partitionBy(*within, "_bucket").orderBy("_v")
    by_bucket = Window.partitionBy(*within).orderBy("_bucket")
    last = parts.groupBy(*within, "_bucket").agg(F.max("_v").alias("_last")).select(
        *within, "_bucket", F.lag("_last").over(by_bucket).alias("_edge"))
    stepped = (
        parts.join(last, [*within, "_bucket"])
        .withColumn("_prev", F.coalesce(F.lag("_v").over(inside), F.col("_edge")))
        .withColumn("_new", F.when(F.col("_v") - F.col("_prev") >= F.col("_gap"), 1).otherwise(0))
    )
    opened = stepped.groupBy(*within, "_bucket").agg(F.sum("_new").alias("_sum")).select(
        *within, "_bucket",
        F.coalesce(F.sum("_sum").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_offset"))
    tiers = (
        stepped.withColumn("_run", F.sum("_new").over(inside))
        .join(opened, [*within, "_bucket"])
        .select(*within, "_v", (F.col("_run") + F.col("_offset") + 1).alias(out))
    )
    found = steps.join(tiers, [*within, "_v"]).select(*ids, out)
    return df.join(found, ids, "left")


def add_tiers(df: DataFrame, settings: Settings) -> DataFrame:
    """Gap tiers of the per-game value per season and group, qualified entities only."""
    gap = F.when(F.col("games") >= settings.min_games, lookup(settings.tier_gap, "grp"))
    return gap_tiers(df, ["season", "grp"], "ppg", gap, ENTITY_SEASON)


def board_columns(df: DataFrame) -> DataFrame:
    """Reading-order columns that exist, in no order of rows: what other boards are cut from."""
    return df.select(*[c for c in BOARD_COLUMNS if c in df.columns])


def overall_board(df: DataFrame) -> DataFrame:
    """Reading-order columns that exist, best total first."""
    return board_columns(df).orderBy("season", F.desc_nulls_last("points"), "entity")


def top_board(board: DataFrame, size: int, rank: str = "row_rank") -> DataFrame:
    return top_rows(board, ["season"], "points", size, ["entity"], rank)


def group_board(board: DataFrame, group: str, size: int | None = None) -> DataFrame:
    """One peer group, optionally its first rows."""
    mine = board.where(F.col("grp") == group)
    return mine if size is None else top_board(mine, size).drop("row_rank")


def flex_board(board: DataFrame, groups: tuple[str, ...], size: int = 200) -> DataFrame:
    """Several groups merged, numbered from the best."""
    return top_board(board.where(F.col("grp").isin(list(groups))), size, "flex_rank")


def value_gainers(df: DataFrame, settings: Settings, games_below: int = 15, ppg_from: float = 10.0,
                  n: int = 20) -> DataFrame:
    """Entities whose per-game rank ran ahead of their season rank."""
    pool = df.where(
        (F.col("games") >= settings.min_games) & (F.col("games") < games_below)
        & (F.col("ppg") >= ppg_from))
    return top_rows(pool, ["season"], "rank_delta", n, ["entity"]).select(
        "season", "entity", "entity_name", "group_label", "team", "games", "points", "rank",
        "ppg", "rank_ppg", "rank_delta")


def board_summary(board: DataFrame, wanted: int) -> DataFrame:
    """Group mix of a board and whether it came out short."""
    mix = board.groupBy("season", "grp").agg(F.count("*").alias("entities"))
    size = board.groupBy("season").agg(F.count("*").alias("board_size"))
    return mix.join(size, "season").withColumn("short", F.col("board_size") < wanted)


def external_board_merge(external: DataFrame, board: DataFrame, name: str = "name") -> DataFrame:
    """Outside ranked list beside the board, unmatched rows of both kept."""
    return external.join(board, external[name] == board["entity_name"], "full")


def dropoff_curve(board: DataFrame, groups: list[str], depth: int = 48) -> DataFrame:
    """Per group the first rows by points with a per-game value."""
    pool = board.where(F.col("ppg").isNotNull() & F.col("grp").isin(groups))
    return top_rows(pool, ["season", "grp"], "points", depth, ["entity"]).select(
        "season", "grp", "entity", "group_rank", "ppg")


def risk_quadrant(board: DataFrame, min_games: int, size: int = 120) -> DataFrame:
    """Top qualified entities against the medians of their per-game value and spread."""
    pool = top_board(board.where(F.col("games") >= min_games), size)
    # the pool holds at most ``size`` rows per season
    lines = pool.groupBy("season").agg(
        F.percentile("ppg", F.lit(0.5)).alias("ppg_line"),
        F.percentile("stdev", F.lit(0.5)).alias("stdev_line"))
    return pool.join(lines, "season").select(
        "season", "entity", "entity_name", "grp", "ppg", "stdev", "ppg_line", "stdev_line",
        (F.col("ppg") >= F.col("ppg_line")).alias("high_value"),
        (F.col("stdev") >= F.col("stdev_line")).alias("high_spread"))
