"""Spreadsheet-ready tables and CSV / Parquet sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

# Rates keep four decimals, every other double two.
RATE_COLUMNS = frozenset({
    "catch_rate", "boom_rate", "bust_rate", "starter_week_rate", "comp_pct", "td_rate", "target_share", "cv",
    "sack_rate",
})

# Headers that title case would get wrong.
HEADERS = {
    "rank": "Rank", "rank_half": "Rank (Half)", "rank_base": "Rank (Base)", "rank_ppg": "Rank (PPG)",
    "entity": "ID", "entity_name": "Name", "grp": "Group", "group_label": "Group Rank Label",
    "games": "G", "games_active": "G Active", "points": "Pts", "ppg": "PPG",
    "points_half": "Half Pts", "ppg_half": "Half PPG", "points_base": "Base Pts",
    "ppg_base": "Base PPG", "group_rank_ppg": "Group Rank (PPG)", "vor_ppg": "VOR PPG",
    "vor_total": "VOR Total", "replacement_ppg": "Replacement PPG", "floor": "Floor (P10)",
    "ceiling": "Ceiling (P90)", "median_week": "Median Wk", "stdev": "Std Dev", "cv": "CV",
    "best_week": "Best Wk", "worst_week": "Worst Wk", "ypc": "YPC", "ypr": "YPR", "ypt": "YPT",
    "ypa": "YPA", "adot": "aDOT", "td_int_ratio": "TD:INT", "comp_pct": "Comp %",
    "flex_rank": "FLEX Rank", "target_share": "Target Share (Avg)", "two_pt": "2PT Conv",
    "boom_weeks": "Boom Wks", "bust_weeks": "Bust Wks", "starter_weeks": "Starter Wks",
    "starter_week_rate": "Starter Wk Rate", "top5_weeks": "Top 5 Wks", "touch_pg": "Touches/G", "opp_pg": "Opp/G",
    "scrim_yards": "Scrim Yds", "scrim_yds_pg": "Scrim Yds/G", "total_yards": "Total Yds",
    "total_yds_pg": "Total Yds/G", "total_tds": "Total TDs", "tds_pg": "TDs/G", "pts_per_touch": "Pts/Touch",
    "pts_per_opp": "Pts/Opp", "yards_per_touch": "Yds/Touch", "td_rate": "TD Rate", "yac_per_rec": "YAC/Rec",
    "completions": "Comp", "attempts": "Att", "passing_yards": "Pass Yds", "passing_tds": "Pass TD",
    "interceptions": "INT", "air_yards_pa": "Air Yds/Att", "rushing_yards": "Rush Yds", "rushing_tds": "Rush TD",
    "receptions": "Rec", "receiving_yards": "Rec Yds", "receiving_tds": "Rec TD", "opponent": "Opp",
    "period_group_rank": "Wk Group Rank",
}


def header(name: str) -> str:
    return HEADERS.get(name, name.replace("_", " ").title())


def table_ready(df: DataFrame, decimals: int = 2) -> DataFrame:
    """Round half-even, empty text for null, quote text a spreadsheet would run, pretty headers."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.bround(c, 4 if name in RATE_COLUMNS else decimals)
        elif kind == "string":
            c = F.coalesce(c, F.lit(""))
            c = F.when(c.rlike("^[=+@]"), F.concat(F.lit("'"), c)).otherwise(c)
        out.append(c.alias(header(name)))
    return df.select(*out)


def _counted(df: DataFrame, write) -> int:
    """Rows that went into a write, counted on their way."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return seen.get["rows"]


def write_csv(df: DataFrame, path: str, single_file: bool = True) -> int:
    """Rows written as CSV with a header and empty nulls; one file for boards, which are small by design."""
    ready = table_ready(df)
    return _counted(ready.coalesce(1) if single_file else ready, lambda rows: rows.write.mode("overwrite").csv(
        path, header=True, nullValue="", emptyValue=""))


def export_boards(boards: dict[str, DataFrame], folder: str, only: list[str] | None = None,
                  whole: tuple[str, ...] = ("overall",)) -> dict[str, int]:
    """Write each board to its own folder, and a manifest; path -> row count. ``whole`` boards stay partitioned."""
    written, top = {}, folder.rstrip("/")
    for name, df in boards.items():
        if only and name not in only:
            continue
        path = f"{top}/{slug_name(name)}"
        written[path] = write_csv(df, path, name not in whole)
    if written:
        rows = [(p.rsplit("/", 1)[1], n) for p, n in written.items()]
        df.sparkSession.createDataFrame(rows, "board string, rows long").coalesce(1).write.mode("overwrite").json(
            f"{top}/_manifest")
    return written


def slug_name(name: str) -> str:
    return "_".join(name.lower().split())


def write_panel(df: DataFrame, path: str, by: str = "season") -> int:
    """Rows written as Parquet, one folder per season, so readers of some seasons open no other."""
    return _counted(df, lambda rows: rows.write.mode("overwrite").partitionBy(by).parquet(path))


def write_by_slug(df: DataFrame, path: str, slug_column: str = "slug") -> int:
    """Rows written as CSV, one folder per slug (a league, say)."""
    return _counted(df, lambda rows: rows.write.mode("overwrite").partitionBy(slug_column).csv(
        path, header=True, nullValue=""))
