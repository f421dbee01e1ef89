"""Readers of logs, season totals and outside sources."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import number_or_zero, safe_div
from ..functions.records import keep_one
from ..settings import MEASURES
from .schema import coerce_numeric, standardize

# First season each outside source covers.
SOURCE_FIRST_SEASON = {
    "ff_opportunity": 2006, "injuries": 2009, "snap_counts": 2012, "depth_charts": 2012,
    "rosters": 2012, "pbp": 2012, "ngs_receiving": 2016, "ngs_rushing": 2016, "ngs_passing": 2016,
    "participation": 2016, "pfr": 2018, "ftn": 2022,
}

# Sources each tier reads.
TIER_SOURCES = {
    0: ("players", "draft_picks"),
    1: ("ff_opportunity", "ff_rankings", "player_weekly", "player_season"),
    2: ("snap_counts", "depth_charts", "rosters", "pbp"),
    3: ("ngs_receiving", "ngs_rushing", "ngs_passing", "participation"),
    4: ("pfr", "ftn", "injuries", "contracts"),
}


def read_any(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """Parquet, CSV with header or JSON lines, by file ending; several files merge their columns."""
    first = path if isinstance(path, str) else path[0]
    reader = spark.read.schema(schema) if schema else spark.read
    if first.endswith((".csv", ".csv.gz")):
        return reader.csv(path, header=True)
    if first.endswith((".json", ".jsonl")):
        return reader.json(path)
    return reader.option("mergeSchema", True).parquet(*([path] if isinstance(path, str) else path))


def union_ragged(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def load_game_log(raw: DataFrame, seasons: list[int] | None = None, season_type: str | None = None,
                  groups: list[str] | None = None) -> DataFrame:
    """Canonical period log of the wanted seasons, season type and groups."""
    df = coerce_numeric(standardize(raw))
    if seasons:
        df = df.where(F.col("season").isin(seasons))
    if season_type and "season_type" in df.columns:
        df = df.where(F.col("season_type") == season_type)
    if groups:
        df = df.where(F.col("grp").isin(groups))
    return df.withColumn("period", F.col("period").try_cast("int")) if "period" in df.columns else df


# Season levels and the season types they cover.
LEVELS = {"reg": ("REG",), "post": ("POST",), "reg+post": ("REG", "POST")}


def load_season_totals(log: DataFrame, level: str = "reg") -> DataFrame:
    """Totals per entity and season over the season types of the level."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {sorted(LEVELS)}, not {level!r}")
    rows = log.where(F.col("season_type").isin(list(LEVELS[level])))
    sums = [F.sum(m).alias(m) for m in MEASURES if m in log.columns]
    names = [F.max_by(c, F.struct("period", c)).alias(c)
             for c in ("entity_name", "grp", "team") if c in log.columns]
    return rows.groupBy("entity", "season").agg(
        *names, *sums, F.count_distinct("period").alias("games"))


def multi_season_totals(frames: list[DataFrame], seasons: list[int],
                        groups: list[str] | None = None, season_length: int = 17) -> DataFrame:
    """Season totals from several files with per-game values; no games column counts as a whole season."""
    df = coerce_numeric(standardize(union_ragged(frames), strict=False))
    df = df.withColumn("season", F.col("season").try_cast("int")).where(F.col("season").isin(seasons))
    if groups:
        df = df.where(F.col("grp").isin(groups))
    games = F.col("games") if "games" in df.columns else F.lit(season_length)
    return df.withColumns({
        "ppg": F.coalesce(safe_div("value", games), F.lit(0.0)),
        "ppg_base": F.coalesce(safe_div("value_base", games), F.lit(0.0)),
    })


def multi_season_game_log(frames: list[DataFrame], seasons: list[int], sequence: str,
                          groups: list[str] | None = None) -> DataFrame:
    """Period log from several files; the latest by ``sequence`` wins per entity and period."""
    df = coerce_numeric(standardize(union_ragged(frames), strict=False))
    df = df.where(F.col("season").isin(seasons))
    if groups:
        df = df.where(F.col("grp").isin(groups))
    return keep_one(df, ["entity", "season", "period"], [sequence])


def source_scans(available: dict[str, DataFrame], max_tier: int) -> dict[str, DataFrame]:
    """Sources a tier needs, cut to the seasons they cover."""
    wanted = [n for t in range(max_tier + 1) for n in TIER_SOURCES[t] if n in available]
    out = {}
    for n in wanted:
        df, first = available[n], SOURCE_FIRST_SEASON.get(n)
        out[n] = df.where(F.col("season") >= first) if first and "season" in df.columns else df
    return out


def historical_union(history: DataFrame, recent: DataFrame, ambiguous: str | None = None,
                     value_below: float | None = None, groups: list[str] | None = None) -> DataFrame:
    """Old seasons with known faults removed, best row per name and season, recent rows fill gaps."""
    h = history.withColumns({"value": number_or_zero("value"), "games": number_or_zero("games")})
    if value_below is not None:
        h = h.where(F.col("value") < value_below)
    if ambiguous is not None:
        h = h.where(F.col("entity_name") != ambiguous)
    if groups:
        h = h.where(F.col("grp").isin(groups))
    both = h.withColumn("_recent", F.lit(0)).unionByName(
        recent.withColumn("_recent", F.lit(1)), allowMissingColumns=True)
    order = [-F.col("_recent"), F.col("value"), F.col("grp"), F.col("games")]
    return keep_one(both, ["entity_name", "season"], order).drop("_recent")
