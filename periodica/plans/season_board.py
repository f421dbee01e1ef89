"""From a game log to every season board."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.records import stage
from ..operators import metrics as m
from ..operators import rankings as r
from ..settings import Settings


def measured(log: DataFrame) -> DataFrame:
    """Season totals with games, scoring, volume and efficiency."""
    totals = m.season_totals(log).drop("team", "games", "target_share")
    df = totals.join(m.games_played(log), m.ENTITY_SEASON)
    return m.add_efficiency(m.add_volume(m.add_scoring(df)))


def scored(log: DataFrame, settings: Settings) -> DataFrame:
    """Everything known about an entity-season, ranks and tiers included.

    The log is read five times from here on, so it is staged unless it is a plain scan already.
    """
    log = stage(log)
    base = measured(log).join(m.consistency_profile(log, settings), m.ENTITY_SEASON, "left")
    base = stage(m.consistency_rates(base))
    # ranks, levels and tiers each read the staged base, not one another
    narrow = base.select(*m.ENTITY_SEASON, "grp", "games", "ppg")
    tiers = r.add_tiers(narrow, settings).select(*m.ENTITY_SEASON, "tier")
    ranked = r.season_ranks(base, settings).join(tiers, m.ENTITY_SEASON, "left")
    return r.add_vor(ranked, settings, r.replacement_levels(narrow, settings))


def build_season(log: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """All boards over one scored frame, by name."""
    log = stage(log)
    season = stage(scored(log, settings))
    board = r.board_columns(season)
    boards = {
        "overall": r.overall_board(season),
        "top_n": r.top_board(board, settings.top_n).drop("row_rank"),
        "flex": r.flex_board(board, settings.flex_groups, settings.flex_size),
        "gainers": r.value_gainers(season, settings),
        "replacement": r.replacement_levels(season, settings),
    }
    boards["game_log"] = m.game_log(log, boards["top_n"])
    for group, size in settings.board_sizes.items():
        boards[group] = r.group_board(board, group, size)
    return boards
