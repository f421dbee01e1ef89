"""Neutral column names and the per-group parameters the operators take."""

from __future__ import annotations

from dataclasses import dataclass, field

# Summable counters of a game log. A log may carry any subset of them.
MEASURES = (
    "value", "value_base",
    "attempts", "completions", "passing_yards", "passing_tds", "interceptions",
    "sacks_taken", "sack_fumbles_lost", "passing_air_yards", "passing_first_downs", "passing_2pt",
    "carries", "rushing_yards", "rushing_tds", "rushing_fumbles_lost",
    "rushing_first_downs", "rushing_2pt",
    "targets", "receptions", "receiving_yards", "receiving_tds", "receiving_fumbles_lost",
    "receiving_air_yards", "receiving_yac", "receiving_first_downs", "receiving_2pt",
    "special_teams_tds",
)


@dataclass(frozen=True)
class Settings:
    """Thresholds per peer group; groups not listed have none."""

    min_games: int = 4
    top_n: int = 250
    flex_groups: tuple[str, ...] = ()
    flex_size: int = 200
    replacement_rank: dict[str, int] = field(default_factory=dict)
    boom_bust: dict[str, tuple[float, float]] = field(default_factory=dict)
    starter_slots: dict[str, int] = field(default_factory=dict)
    tier_gap: dict[str, float] = field(default_factory=dict)
    board_sizes: dict[str, int] = field(default_factory=dict)
    group_codes: dict[str, int] = field(default_factory=dict)
    season_steps: int = 16
    tier_cuts: tuple[int, ...] = (50, 100, 150, 200)
    group_tier_cuts: dict[str, tuple[int, ...]] = field(default_factory=dict)


# Football thresholds (12-team league).
FOOTBALL = Settings(
    flex_groups=("RB", "WR", "TE"),
    replacement_rank={"QB": 12, "RB": 30, "WR": 42, "TE": 12},
    boom_bust={"QB": (24.0, 14.0), "RB": (20.0, 10.0), "WR": (20.0, 10.0), "TE": (15.0, 7.0)},
    starter_slots={"QB": 12, "RB": 24, "WR": 36, "TE": 12},
    tier_gap={"QB": 1.5, "RB": 1.5, "WR": 1.5, "TE": 1.2},
    board_sizes={"QB": 40, "RB": 90, "WR": 110, "TE": 50},
    group_codes={"QB": 0, "RB": 1, "WR": 2, "TE": 3},
    group_tier_cuts={"QB": (5, 10, 16), "RB": (12, 24, 36), "WR": (12, 24, 36), "TE": (5, 10, 16)},
)

# Parameters for the supplier log of the driver tables (groups are regions).
SUPPLIERS = Settings(
    top_n=50,
    flex_groups=("AFRICA", "ASIA", "EUROPE"),
    flex_size=30,
    replacement_rank={"AFRICA": 5, "AMERICA": 6, "ASIA": 7, "EUROPE": 40},
    boom_bust={"AFRICA": (300.0, 150.0), "AMERICA": (320.0, 140.0), "ASIA": (300.0, 150.0),
               "EUROPE": (280.0, 160.0)},
    starter_slots={"AFRICA": 5, "AMERICA": 6, "ASIA": 7, "EUROPE": 5},
    tier_gap={"AFRICA": 4.0, "AMERICA": 5.0, "ASIA": 4.0, "EUROPE": 6.0},
    board_sizes={"AFRICA": 10, "AMERICA": 12, "ASIA": 15, "EUROPE": 8},
    group_codes={"AFRICA": 0, "AMERICA": 1, "ASIA": 2, "EUROPE": 3},
    tier_cuts=(10, 25, 50, 75),
    group_tier_cuts={"AFRICA": (3, 6, 10), "AMERICA": (4, 8, 12), "ASIA": (4, 8, 12),
                     "EUROPE": (3, 6, 10)},
)

# Parameters for customer seasons (groups are market segments).
CUSTOMERS = Settings(
    top_n=200,
    group_codes={"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2, "HOUSEHOLD": 3},
    group_tier_cuts={"AUTOMOBILE": (12, 24, 36), "BUILDING": (12, 24, 36),
                     "FURNITURE": (5, 10, 16), "HOUSEHOLD": (5, 10, 16)},
)
