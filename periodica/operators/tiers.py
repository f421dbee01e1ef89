"""Point-in-time features from outside sources.

Every function takes the panel and a source and returns the panel with columns added. The cutoff
is a column, 1 August of the row's season, so all seasons are built in one pass. Features of the
season before are joined on season + 1, which keeps later data out by itself. A source without
the columns needed leaves the panel as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from ..functions.columns import cutoff, first_present, flag, normalize_name, safe_div, to_day, to_number
from ..functions.ordered import Rank, rank_values
from ..functions.records import asof_latest, keep_one, prior_join, stage, unstage
from . import panel as p

IDS = ("entity", "player_id", "gsis_id", "player_gsis_id")


def _entity(df: DataFrame) -> DataFrame | None:
    name = first_present(df, *IDS)
    if name is None:
        return None
    return df if name == "entity" else df.withColumnRenamed(name, "entity")


# -- tier 0 ------------------------------------------------------------------------------------

def age_features(panel: DataFrame, people: DataFrame) -> DataFrame:
    """Age in years at the cutoff, and its square."""
    born = _entity(people).select("entity", to_day("birth_date").alias("_born")).where(
        F.col("_born").isNotNull())
    born = keep_one(born, ["entity"], ["_born"], last=False)
    age = F.bround(F.datediff(cutoff(), F.col("_born")) / 365.25, 2)
    return (
        panel.join(born, "entity", "left").withColumn("age", age)
        .withColumn("age_squared", F.col("age") * F.col("age")).drop("_born")
    )


def draft_features(panel: DataFrame, picks: DataFrame) -> DataFrame:
    """Earliest pick of the entity known in the row's season; 300 and round 8 if none."""
    first = _entity(picks).where(F.col("entity").isNotNull()).groupBy("entity").agg(
        F.min(F.struct(F.col("season").alias("_year"), "pick", "round")).alias("_p"))
    seen = F.col("_p._year") <= F.col("season")
    out = panel.join(first, "entity", "left")
    return out.withColumns({
        "is_undrafted": flag(~F.coalesce(seen, F.lit(False)) | F.col("_p.pick").isNull()),
        "draft_pick": F.coalesce(F.when(seen, F.col("_p.pick").cast("double")), F.lit(300.0)),
        "draft_round": F.coalesce(F.when(seen, F.col("_p.round").cast("double")), F.lit(8.0)),
    }).drop("_p")


# -- tier 1 ------------------------------------------------------------------------------------

def opportunity_features(panel: DataFrame, opportunity: DataFrame) -> DataFrame:
    """Expected points of the season before, points over expected, and both per period."""
    agg = _entity(opportunity).groupBy("entity", "season").agg(
        F.sum("points_exp").alias("exp_points"),
        F.sum("points_diff").alias("points_over_expected"),
        F.count("period").alias("_n"))
    agg = agg.withColumns({"exp_ppg": safe_div("exp_points", "_n"),
                           "poe_ppg": safe_div("points_over_expected", "_n")}).drop("_n")
    return prior_join(panel, agg)


def consensus_rank(panel: DataFrame, rankings: DataFrame, page: str = "redraft-overall",
                   last_day: tuple[int, int] = (9, 10)) -> DataFrame:
    """Rank on the last list of one page type published from 1 June to the given day.

    Names are matched per season after normalising; of several hits the best rank counts.
    """
    day = to_day("scrape_date")
    year = F.year(day)
    in_window = (day >= F.make_date(year, F.lit(6), F.lit(1))) & (
        day <= F.make_date(year, F.lit(last_day[0]), F.lit(last_day[1])))
    of_page = F.col("page_type") == page if "page_type" in rankings.columns else (
        F.col("ecr_type") == "ro")
    proj = first_present(rankings, "projected_points", "fantasy_points", "projection")
    rows = rankings.where(in_window & of_page).select(
        "player", "pos", year.alias("season"), to_number("ecr").alias("ecr"), day.alias("_day"),
        (to_number(proj) if proj else F.lit(None).cast("double")).alias("consensus_projection"))
    latest = stage(keep_one(rows, ["player", "pos", "season"],
                            ["_day", "ecr", "consensus_projection"]))
    ranked = latest.join(rank_values(latest, ["player", "pos", "season"], [
        Rank("consensus_rank", "ecr", ("season",), "first", descending=False),
        Rank("consensus_grp_rank", "ecr", ("season", "pos"), "first", descending=False),
    ]), ["player", "pos", "season"])
    names = ranked.withColumn("_name", normalize_name("player"))
    take = ["consensus_rank", "consensus_grp_rank", "consensus_projection"]
    best = keep_one(names.select("_name", "season", *take), ["_name", "season"],
                    ["consensus_rank"], last=False)
    return (
        panel.withColumn("_name", normalize_name("entity_name"))
        .join(best, ["_name", "season"], "left").drop("_name")
    )


def usage_features(panel: DataFrame, log: DataFrame, totals: DataFrame | None = None,
                   groups: list[str] | None = None, half: int = 9) -> DataFrame:
    """Periods played, second- against first-half mean, target and carry share of the team."""
    late = F.col("period") > half
    agg = _entity(log).groupBy("entity", "season").agg(
        F.count("*").alias("periods_played_lag1"),
        (F.avg(F.when(late, F.col("value"))) - F.avg(F.when(~late, F.col("value"))))
        .alias("h2_vs_h1"),
        F.sum("targets").alias("_targets"), F.sum("carries").alias("_carries"))
    if totals is not None:
        mine = totals if groups is None else totals.where(F.col("grp").isin(groups))
        team = mine.groupBy("entity", "season").agg(F.min("team").alias("team"))
        teams = totals.groupBy("season", "team").agg(
            F.sum("targets").alias("_team_targets"), F.sum("carries").alias("_team_carries"))
        agg = agg.join(team, ["entity", "season"], "left").join(teams, ["season", "team"], "left")
        agg = agg.withColumns({
            "target_share_lag1": safe_div("_targets", "_team_targets"),
            "carry_share_lag1": safe_div("_carries", "_team_carries"),
        }).drop("team", "_team_targets", "_team_carries")
    return prior_join(panel, agg.drop("_targets", "_carries"))


# -- tier 2 ------------------------------------------------------------------------------------

def snap_features(panel: DataFrame, snaps: DataFrame, half: int = 9) -> DataFrame:
    """Mean share of the season before, periods above 50 and 75 percent, half-season trend."""
    df, share = _entity(snaps), first_present(snaps, "offense_pct", "offense_snap_pct", "snap_pct")
    if df is None or share is None:
        return panel
    s, early = to_number(share), F.col("period") <= half
    agg = df.groupBy("entity", "season").agg(
        F.avg(s).alias("snap_share_lag1"),
        F.count_if(s >= 0.50).alias("periods_above_50"),
        F.count_if(s >= 0.75).alias("periods_above_75"),
        (F.avg(F.when(~early, s)) - F.avg(F.when(early, s))).alias("snap_share_trend"))
    return prior_join(panel, agg)


def _dated(df: DataFrame) -> Column | None:
    """Day of a record under any of the names that feeds use."""
    name = first_present(df, "dt", "date", "timestamp", "as_of")
    return None if name is None else to_day(name)


def depth_position(panel: DataFrame, charts: DataFrame) -> DataFrame:
    """Position on the season's latest chart published on or before the cutoff."""
    df = _entity(charts)
    place = first_present(charts, "depth_position", "depth_team", "depth", "pos_rank")
    day = _dated(charts)
    if df is None or place is None or day is None:
        return panel
    known = df.where(day <= cutoff()).select(
        "entity", "season", day.alias("_day"), to_number(place).alias("depth_position"))
    return panel.join(
        keep_one(known, ["entity", "season"], ["_day", "depth_position"]).drop("_day"),
        ["entity", "season"], "left")


def _shares(plays: DataFrame, who: str, sums: dict[str, Column]) -> DataFrame:
    """Sums per entity, season and team beside the team's sums."""
    mine = plays.where(F.col(who).isNotNull()).groupBy(
        F.col(who).alias("entity"), "season", "team").agg(*[s.alias(n) for n, s in sums.items()])
    team = mine.groupBy("season", "team").agg(*[F.sum(n).alias("team_" + n) for n in sums])
    both = mine.join(team, ["season", "team"])
    # an entity with two teams in a season keeps one row: its parts over its teams' parts
    return both.groupBy("entity", "season").agg(
        *[F.sum(c).alias(c) for n in sums for c in (n, "team_" + n)])


def event_share_features(panel: DataFrame, plays: DataFrame) -> DataFrame:
    """Share of team air yards, weighted opportunity, red-zone shares, team pass rate over expected."""
    near = F.col("yardline_100") <= 20
    air = F.coalesce(to_number("air_yards"), F.lit(0.0))
    zero = F.lit(0)
    thrown = _shares(plays, "receiver_id", {
        "_air": F.sum(air), "_tgt": F.count("*"), "_rz": F.sum(F.when(near, 1).otherwise(zero))})
    thrown = thrown.withColumns({
        "air_yards_share": safe_div("_air", "team__air"),
        "rz_target_share": safe_div("_rz", "team__rz"),
    }).withColumn("wopr", 1.5 * safe_div("_tgt", "team__tgt") + 0.7 * F.col("air_yards_share"))
    run = _shares(plays, "rusher_id", {"_rz": F.sum(F.when(near, 1).otherwise(zero))})
    run = run.select("entity", "season", safe_div("_rz", "team__rz").alias("rz_carry_share"))
    both = thrown.select("entity", "season", "air_yards_share", "wopr", "rz_target_share").join(
        run, ["entity", "season"], "full")
    out = prior_join(panel, both)
    if "pass_oe" in plays.columns and "team" in panel.columns:
        roe = plays.groupBy("season", "team").agg(F.avg("pass_oe").alias("team_pass_roe"))
        out = prior_join(out, roe, "team")
    return out


def situation_features(panel: DataFrame, rosters: DataFrame,
                       picks: DataFrame | None = None) -> DataFrame:
    """Team changed since last season; number and capital of draftees in the same team and group."""
    df, day = _entity(rosters), _dated(rosters)
    if df is None or day is None:
        return panel
    known = df.where(day <= cutoff()).select("entity", "season", day.alias("_day"),
                                             F.col("team").alias("_team"))
    now = keep_one(known, ["entity", "season"], ["_day", "_team"]).drop("_day")
    out = prior_join(panel.join(now, ["entity", "season"], "left"),
                     now.withColumnRenamed("_team", "_before"))
    out = out.withColumn("changed_team", flag(F.col("_team") != F.col("_before")))
    if picks is None:
        out = out.withColumns({"competition_count": F.lit(0).cast("bigint"),
                               "competition_capital": F.lit(0.0)})
    else:
        capital = F.greatest(F.lit(0.0), 33 - to_number("pick"))
        comp = picks.groupBy("season", F.col("team").alias("_team"), "grp").agg(
            F.count("pick").alias("competition_count"), F.sum(capital).alias("competition_capital"))
        out = out.join(comp, ["season", "_team", "grp"], "left")
    return out.drop("_team", "_before")


# -- tiers 3 and 4 -----------------------------------------------------------------------------

# Feature -> source columns, best first.
TRACKING = {
    "separation_avg": ("avg_separation", "separation"),
    "cushion_avg": ("avg_cushion", "cushion"),
    "intended_air_yards": ("avg_intended_air_yards", "avg_air_yards"),
    "rush_yards_oe": ("rush_yards_over_expected_per_att", "ryoe_per_att"),
    "efficiency": ("efficiency",),
    "time_to_los": ("avg_time_to_los", "time_to_los"),
    "completion_pct_oe": ("completion_percentage_above_expectation", "cpoe"),
}
# Feature -> source columns, best first.
ADVANCED = {
    "broken_tackles": ("broken_tackles", "brk_tkl"),
    "drop_rate": ("drop_pct", "drop_rate"),
    "yac_per_rec": ("yac_per_rec",),
    "pressure_rate": ("pressure_pct", "pressure_rate"),
}
# Feature -> source columns, best first.
CHARTING = {"ftn_xyac": ("xyac", "x_yac"), "ftn_no_huddle_rate": ("no_huddle_rate", "no_huddle")}


def _means(source: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame | None:
    df = _entity(source)
    found = {n: c for n, names in aliases.items() if (c := first_present(source, *names))}
    if df is None or "season" not in df.columns or not found:
        return None
    return df.groupBy("entity", "season").agg(
        *[F.avg(to_number(c)).alias(n) for n, c in found.items()])


def prior_summary(panel: DataFrame, source: DataFrame,
                  aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Means of the season before for whichever aliased columns the source has."""
    agg = _means(source, aliases)
    return panel if agg is None else prior_join(panel, agg)


def tracking_features(panel: DataFrame, frames: list[DataFrame]) -> DataFrame:
    """Means over several frames; a column found in two frames counts from the first."""
    wide, taken = None, set()
    for frame in frames:
        agg = _means(frame, {n: a for n, a in TRACKING.items() if n not in taken})
        if agg is None:
            continue
        taken |= set(agg.columns)
        wide = agg if wide is None else wide.join(agg, ["entity", "season"], "full")
    return panel if wide is None else prior_join(panel, wide)


def participation_features(panel: DataFrame, source: DataFrame) -> DataFrame:
    return prior_summary(panel, source, {
        "participation_rate": ("offense_pct", "participation", "route_participation")})


def injury_features(panel: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports of the season before that were filed before the cutoff, and games missed."""
    df = _entity(reports)
    status = first_present(reports, "report_status", "game_status", "status")
    missed = F.lower(F.col(status)).isin("out", "inactive", "ir") if status else F.lit(False)
    date = first_present(reports, "date", "report_date")
    known = df.where(to_day(date) < cutoff(F.col("season") + 1)) if date else df
    agg = known.groupBy("entity", "season").agg(
        F.count("*").alias("injury_reports_lag1"), F.count_if(missed).alias("games_missed_lag1"))
    return prior_join(panel, agg)


def _year(df: DataFrame, name: str) -> Column:
    """Year of a column that holds years as numbers or as digits, or dates."""
    kind = df.schema[name].dataType
    if isinstance(kind, NumericType):
        return F.col(name).cast("double")
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.year(name).cast("double")
    text = F.trim(F.col(name).cast("string"))
    return F.when(text.rlike(r"^[0-9]{1,4}([.]0*)?$"), text.try_cast("double")).otherwise(
        F.year(to_day(text)).cast("double"))


def contract_features(panel: DataFrame, contracts: DataFrame) -> DataFrame:
    """Guarantee and years left of the latest contract signed on or before the cutoff."""
    df = _entity(contracts)
    signed = first_present(contracts, "signed_date", "date_signed", "contract_date")
    if df is None or signed is None:
        return panel
    money = first_present(contracts, "guaranteed", "guaranteed_money")
    end = first_present(contracts, "contract_end", "end_year")
    none = F.lit(None).cast("double")
    rows = df.select("entity", to_day(signed).alias("_signed"),
                     (to_number(money) if money else none).alias("contract_guaranteed"),
                     (_year(df, end) if end else none).alias("_end"))
    out = asof_latest(panel, rows, "_signed", ["contract_guaranteed", "_end"])
    return out.withColumn(
        "contract_years_left",
        F.when(F.col("_end").isNotNull(), F.greatest(F.lit(0.0), F.col("_end") - F.col("season")))
    ).drop("_end")


# -- composition -------------------------------------------------------------------------------

def tier_features(panel: DataFrame, tier: int, sources: dict[str, DataFrame]) -> DataFrame:
    """Add one tier's features whose source is at hand."""
    def have(name, fn):
        nonlocal panel
        if name in sources:
            panel = fn(panel, sources[name])

    if tier == 0:
        panel = p.rookie_flag(p.missing_indicators(panel))
        have("players", age_features)
        have("draft_picks", draft_features)
    elif tier == 1:
        have("ff_opportunity", opportunity_features)
        have("ff_rankings", consensus_rank)
        have("player_weekly", lambda d, s: usage_features(d, s, sources.get("player_season")))
    elif tier == 2:
        have("snap_counts", snap_features)
        have("depth_charts", depth_position)
        have("pbp", event_share_features)
        have("rosters", lambda d, s: situation_features(d, s, sources.get("team_picks")))
    elif tier == 3:
        frames = [sources[n] for n in ("ngs_receiving", "ngs_rushing", "ngs_passing") if n in sources]
        panel = tracking_features(panel, frames)
        have("participation", participation_features)
    else:
        have("pfr", lambda d, s: prior_summary(d, s, ADVANCED))
        have("ftn", lambda d, s: prior_summary(d, s, CHARTING))
        have("injuries", injury_features)
        have("contracts", contract_features)
    return panel


def wide_panel(panel: DataFrame, max_tier: int, sources: dict[str, DataFrame]) -> DataFrame:
    """All tiers up to one, every season in the same pass.

    A tier is written before the next one joins to it, so no more than the shuffles of one tier are held at a time.
    """
    written = None
    for tier in range(max_tier + 1):
        wider = tier_features(panel, tier, sources)
        if wider is panel:
            continue
        if tier < max_tier:
            wider = stage(wider)
            if written is not None:
                unstage(written)
            written = wider
        panel = wider
    return panel
