"""Season measures of an entity: totals, rates, efficiency, consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import lookup, safe_div
from ..functions.ordered import Rank, add_ranks
from ..settings import MEASURES, Settings

ENTITY_SEASON = ["entity", "season"]


def games_played(log: DataFrame) -> DataFrame:
    """Periods played, active periods, span, teams in order of appearance, mean target share."""
    active = (F.col("carries") + F.col("targets") + F.col("attempts")) > 0
    aggs = [
        F.count_distinct("period").alias("games"),
        F.count_if(active).alias("games_active"),
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
    ]
    if "team" in log.columns:
        # at most one row per period of a season, so the list is short
        path = F.array_sort(F.collect_list(
            F.when(F.col("team").isNotNull(), F.struct("period", "team"))))
        aggs += [
            F.max_by("team", F.struct("period", "team")).alias("team"),
            F.array_distinct(F.transform(path, lambda x: x["team"])).alias("_teams"),
        ]
    if "target_share" in log.columns:
        aggs.append(F.avg("target_share").alias("target_share"))
    out = log.groupBy(*ENTITY_SEASON).agg(*aggs)
    if "team" in log.columns:
        out = out.select(
            "*", F.concat_ws("/", "_teams").alias("teams"),
            (F.size("_teams") > 1).alias("multi_team"),
        ).drop("_teams")
    return out


def season_totals(log: DataFrame) -> DataFrame:
    """Sum every counter of the log per entity and season; latest name, group and team."""
    sums = [F.sum(m).alias(m) for m in MEASURES if m in log.columns]
    labels = [
        F.max_by(c, F.struct("period", c)).alias(c)
        for c in ("entity_name", "grp", "team") if c in log.columns
    ]
    return log.groupBy(*ENTITY_SEASON).agg(
        *labels, *sums, F.count_distinct("period").alias("games"))


def add_scoring(df: DataFrame) -> DataFrame:
    """Points in both scorings and their midpoint, with rates per game."""
    half = (F.col("value_base") + F.col("value")) / 2
    return df.withColumns({
        "points": F.col("value"),
        "points_base": F.col("value_base"),
        "points_half": half,
        "ppg": safe_div("value", "games"),
        "ppg_half": safe_div(half, "games"),
        "ppg_base": safe_div("value_base", "games"),
    })


def add_volume(df: DataFrame) -> DataFrame:
    """Touches, opportunities, yardage, scores, turnovers and their per-game forms."""
    c = F.col
    df = df.withColumns({
        "touches": c("carries") + c("receptions"),
        "opportunities": c("carries") + c("targets"),
        "scrim_yards": c("rushing_yards") + c("receiving_yards"),
        "total_yards": c("rushing_yards") + c("receiving_yards") + c("passing_yards"),
        "total_tds": c("passing_tds") + c("rushing_tds") + c("receiving_tds")
        + c("special_teams_tds"),
        "fumbles_lost": c("sack_fumbles_lost") + c("rushing_fumbles_lost")
        + c("receiving_fumbles_lost"),
        "first_downs": c("passing_first_downs") + c("rushing_first_downs")
        + c("receiving_first_downs"),
        "two_pt": c("passing_2pt") + c("rushing_2pt") + c("receiving_2pt"),
    })
    return df.withColumns({
        "turnovers": c("interceptions") + c("fumbles_lost"),
        "touch_pg": safe_div("touches", "games"),
        "opp_pg": safe_div("opportunities", "games"),
        "scrim_yds_pg": safe_div("scrim_yards", "games"),
        "total_yds_pg": safe_div("total_yards", "games"),
        "tds_pg": safe_div("total_tds", "games"),
    })


# rate column -> (numerator columns, denominator columns)
EFFICIENCY = {
    "pts_per_touch": (("points",), ("touches",)),
    "pts_per_opp": (("points",), ("opportunities",)),
    "yards_per_touch": (("scrim_yards",), ("touches",)),
    "ypc": (("rushing_yards",), ("carries",)),
    "ypr": (("receiving_yards",), ("receptions",)),
    "ypt": (("receiving_yards",), ("targets",)),
    "catch_rate": (("receptions",), ("targets",)),
    "td_rate": (("rushing_tds", "receiving_tds"), ("touches",)),
    "yac_per_rec": (("receiving_yac",), ("receptions",)),
    "adot": (("receiving_air_yards",), ("targets",)),
    "comp_pct": (("completions",), ("attempts",)),
    "ypa": (("passing_yards",), ("attempts",)),
    "air_yards_pa": (("passing_air_yards",), ("attempts",)),
    "td_int_ratio": (("passing_tds",), ("interceptions",)),
    "sack_rate": (("sacks_taken",), ("attempts", "sacks_taken")),
}


def add_efficiency(df: DataFrame) -> DataFrame:
    """Points and yards per chance, catch, completion and sack rates."""
    def total(names):
        out = F.col(names[0])
        for n in names[1:]:
            out = out + F.col(n)
        return out

    return df.withColumns({k: safe_div(total(a), total(b)) for k, (a, b) in EFFICIENCY.items()})


def period_group_rank(log: DataFrame, out: str = "period_rank") -> DataFrame:
    """Rank of the value among the peer group of the same period, best first, ties share."""
    return add_ranks(log, ["entity", "season", "period"],
                     [Rank(out, "value", ("season", "period", "grp"))])


def consistency_profile(log: DataFrame, settings: Settings) -> DataFrame:
    """Best, worst, median, spread, P10 floor, P90 ceiling, boom/bust/starter/top-5 counts.

    Quantiles run over the periods of one season of one entity, a handful of rows.
    """
    boom = lookup({g: t[0] for g, t in settings.boom_bust.items()}, "grp")
    bust = lookup({g: t[1] for g, t in settings.boom_bust.items()}, "grp")
    slots = lookup(settings.starter_slots, "grp", 0)
    v, r = F.col("value"), F.col("period_rank")
    marked = period_group_rank(
        log.select("entity", "season", "period", "grp", "value")
    ).withColumns({"_boom": v >= boom, "_bust": v <= bust, "_start": r <= slots})
    return marked.groupBy(*ENTITY_SEASON).agg(
        F.max("value").alias("best_week"),
        F.min("value").alias("worst_week"),
        F.percentile("value", F.lit(0.5)).alias("median_week"),
        F.stddev_samp("value").alias("stdev"),
        F.percentile("value", F.lit(0.1)).alias("floor"),
        F.percentile("value", F.lit(0.9)).alias("ceiling"),
        F.count_if("_boom").alias("boom_weeks"),
        F.count_if("_bust").alias("bust_weeks"),
        F.count_if("_start").alias("starter_weeks"),
        F.count_if(r <= 5).alias("top5_weeks"),
        F.min(r).alias("best_group_finish"),
    )


def consistency_rates(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "cv": safe_div("stdev", "ppg"),
        "boom_rate": safe_div("boom_weeks", "games"),
        "bust_rate": safe_div("bust_weeks", "games"),
        "starter_week_rate": safe_div("starter_weeks", "games"),
    })


# Columns of the log of periods.
LOG_COLUMNS = (
    "entity", "season", "entity_name", "grp", "team", "opponent", "period", "value", "value_base",
    "carries", "rushing_yards", "rushing_tds", "targets", "receptions", "receiving_yards",
    "receiving_tds", "attempts", "passing_yards", "passing_tds", "interceptions",
)


def game_log(log: DataFrame, chosen: DataFrame) -> DataFrame:
    """Period rows of the chosen entity-seasons, ranked among the chosen only."""
    mine = log.join(chosen.select(*ENTITY_SEASON), ENTITY_SEASON, "left_semi")
    cols = [c for c in LOG_COLUMNS if c in mine.columns]
    return period_group_rank(mine.select(*cols)).orderBy("season", "entity_name", "period", "entity")
