"""Canonical column names for raw logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import number_or_zero
from ..settings import MEASURES

# Canonical name -> accepted source names, best first.
ALIASES: dict[str, tuple[str, ...]] = {
    "entity": ("player_id", "gsis_id", "entity"),
    "entity_name": ("player_display_name", "player_name", "full_name", "entity_name"),
    "grp": ("position", "grp"),
    "position_group": ("position_group",),
    "team": ("team", "recent_team"),
    "opponent": ("opponent_team", "opponent"),
    "season": ("season",),
    "period": ("week", "period"),
    "season_type": ("season_type",),
    "game_id": ("game_id",),
    "games": ("games", "g"),
    "completions": ("completions", "passing_completions"),
    "attempts": ("attempts", "passing_attempts"),
    "passing_yards": ("passing_yards",),
    "passing_tds": ("passing_tds",),
    "interceptions": ("passing_interceptions", "interceptions"),
    "sacks_taken": ("sacks_suffered", "sacks", "sacks_taken"),
    "sack_yards": ("sack_yards_lost", "sack_yards"),
    "sack_fumbles": ("sack_fumbles",),
    "sack_fumbles_lost": ("sack_fumbles_lost",),
    "passing_air_yards": ("passing_air_yards",),
    "passing_yac": ("passing_yards_after_catch", "passing_yac"),
    "passing_first_downs": ("passing_first_downs",),
    "passing_2pt": ("passing_2pt_conversions", "passing_2pt"),
    "passing_epa": ("passing_epa",),
    "carries": ("carries", "rushing_attempts"),
    "rushing_yards": ("rushing_yards",),
    "rushing_tds": ("rushing_tds",),
    "rushing_fumbles": ("rushing_fumbles",),
    "rushing_fumbles_lost": ("rushing_fumbles_lost",),
    "rushing_first_downs": ("rushing_first_downs",),
    "rushing_2pt": ("rushing_2pt_conversions", "rushing_2pt"),
    "rushing_epa": ("rushing_epa",),
    "receptions": ("receptions",),
    "targets": ("targets",),
    "receiving_yards": ("receiving_yards",),
    "receiving_tds": ("receiving_tds",),
    "receiving_fumbles": ("receiving_fumbles",),
    "receiving_fumbles_lost": ("receiving_fumbles_lost",),
    "receiving_air_yards": ("receiving_air_yards",),
    "receiving_yac": ("receiving_yards_after_catch", "receiving_yac"),
    "receiving_first_downs": ("receiving_first_downs",),
    "receiving_2pt": ("receiving_2pt_conversions", "receiving_2pt"),
    "receiving_epa": ("receiving_epa",),
    "target_share": ("target_share", "tgt_share"),
    "air_yards_share": ("air_yards_share",),
    "wopr": ("wopr", "wopr_x", "wopr_y"),
    "special_teams_tds": ("special_teams_tds",),
    "value_base": ("fantasy_points", "value_base"),
    "value": ("fantasy_points_ppr", "value"),
}

REQUIRED = ("entity", "entity_name", "grp", "season", "value_base", "value")

# Measures and the counters no operator sums.
NUMERIC = (*MEASURES, "sack_fumbles", "passing_yac", "rushing_fumbles", "receiving_fumbles")


def resolve(columns: list[str]) -> dict[str, str]:
    """Canonical name -> source column, the first accepted name that is there."""
    found = {}
    for name, accepted in ALIASES.items():
        hit = [a for a in accepted if a in columns]
        if hit:
            found[name] = hit[0]
    return found


def standardize(df: DataFrame, strict: bool = True) -> DataFrame:
    """Rename to canonical names; other accepted names are dropped, unknown columns stay."""
    found = resolve(df.columns)
    gaps = [n for n in REQUIRED if n not in found]
    if gaps and strict:
        raise KeyError(f"log lacks required columns {gaps}; it has {sorted(df.columns)}")
    canonical = {source: name for name, source in found.items()}
    accepted = {a for names in ALIASES.values() for a in names}
    return df.select(*[
        F.col(f"`{c}`").alias(canonical.get(c, c))
        for c in df.columns if c in canonical or c not in accepted
    ])


def coerce_numeric(df: DataFrame, names: tuple[str, ...] = NUMERIC) -> DataFrame:
    """Counters as doubles; bad, null and absent ones are zero."""
    return df.withColumns({
        n: number_or_zero(n) if n in df.columns else F.lit(0.0) for n in names
    })


def schema_profile(df: DataFrame) -> DataFrame:
    """Per canonical name: the source column, whether it resolved, and its non-null count."""
    found = resolve(df.columns)
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(n) for n, c in found.items()])
    rows = [
        F.struct(
            F.lit(n).alias("canonical"), F.lit(found.get(n, "")).alias("source_column"),
            F.lit("ok" if n in found else "MISSING").alias("status"),
            (F.col(n) if n in found else F.lit(0)).cast("bigint").alias("filled"),
        )
        for n in ALIASES
    ]
    return counts.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
