"""Rosters of many leagues at once: id crosswalk, scoring shift, best line-ups, swaps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import slug
from ..functions.records import keep_one, stage

MODELED = ("QB", "RB", "WR", "TE")
# Groups a slot accepts; any other slot accepts its own name.
SLOTS: dict[str, tuple[str, ...]] = {
    "FLEX": ("RB", "WR", "TE"), "WRRB_FLEX": ("RB", "WR"), "WRTE_FLEX": ("WR", "TE"),
    "REC_FLEX": ("WR", "TE"), "SUPER_FLEX": ("QB", "RB", "WR", "TE"),
}
BENCH_SLOTS = ("BN", "IR", "TAXI")


def accepts(slot: str) -> tuple[str, ...]:
    return SLOTS.get(slot, (slot,))


def _accepts(slot: Column, grp: Column) -> Column:
    out = slot == grp
    for name, groups in SLOTS.items():
        out = F.when(slot == name, grp.isin(*groups)).otherwise(out)
    return out


def modeled_slots(slots: Column) -> Column:
    """Slots at least one modelled group may fill."""
    return F.filter(slots, lambda s: s.isin(*SLOTS, *MODELED))


def id_crosswalk(df: DataFrame, foreign: str = "foreign_id") -> DataFrame:
    """Foreign id as whole-number text, nulls dropped, one row per foreign id."""
    rows = df.withColumn(foreign, F.col(foreign).try_cast("bigint").cast("string")).where(F.col(foreign).isNotNull())
    rest = [c for c in df.columns if c != foreign]
    return keep_one(rows, [foreign], rest, last=False).select(*df.columns)


def league_rosters(leagues: DataFrame, rosters: DataFrame, users: DataFrame, players: DataFrame,
                   crosswalk: DataFrame, owner: str) -> DataFrame:
    """The owner's roster in every league, one row per player; an empty roster keeps one bare row.

    Names come from the crosswalk where it knows the player, else from the source's own list.
    """
    def has(c: str) -> Column:
        return F.coalesce(F.array_contains(F.coalesce(c, F.array()), F.col("foreign_id")), F.lit(False))

    label = users.where(F.col("user_id") == owner).select(
        "league_id", F.coalesce(F.when(F.col("metadata.team_name") != "", F.col("metadata.team_name")),
                                F.col("display_name"), F.lit("")).alias("team_name"))
    mine = (
        rosters.where(F.col("owner_id") == owner).join(leagues, "league_id").join(label, "league_id", "left")
        .withColumn("slots", F.filter("roster_positions", lambda s: ~s.isin(*BENCH_SLOTS)))
        .withColumn("foreign_id", F.explode_outer("players"))
        .select("league_id", F.col("name").alias("league_name"), "team_name", "slots",
                F.coalesce(F.try_element_at("scoring_settings", F.lit("rec")), F.lit(1.0)).alias("rec"),
                "foreign_id", has("starters").alias("is_starter"), has("reserve").alias("is_ir"),
                has("taxi").alias("is_taxi"))
    )
    known = crosswalk.select("foreign_id", "entity", F.col("name").alias("_n"), F.col("grp").alias("_g"),
                             F.col("team").alias("_t"))
    own = players.select("foreign_id", F.col("full_name").alias("_pn"), F.col("position").alias("_pg"),
                         F.col("team").alias("_pt"))
    there = F.col("foreign_id").isNotNull()
    return (
        mine.join(known, "foreign_id", "left").join(own, "foreign_id", "left")
        .select("league_id", "league_name", "team_name", "slots", "rec", "foreign_id", "entity",
                F.coalesce("_n", "_pn", "foreign_id").alias("entity_name"),
                F.when(there, F.coalesce("_g", "_pg", F.lit("UNK"))).alias("grp"),
                F.when(there, F.coalesce("_t", "_pt", F.lit(""))).alias("team"),
                "is_starter", "is_ir", "is_taxi")
    )


def scoring_adjust(board: DataFrame, columns: tuple[str, ...] = ("proj_points", "floor", "ceiling")) -> DataFrame:
    """Take the missing part of a reception's worth off the projection; full value changes nothing."""
    shift = F.coalesce("receptions_ma3", F.lit(0.0)) * (1.0 - F.col("rec"))
    return board.withColumns({
        c: F.when(F.col("rec") == 1.0, F.col(c)).otherwise(F.bround(F.greatest(F.lit(0.0), F.col(c) - shift), 1))
        for c in columns if c in board.columns})


def count_vectors(slots: list[str]) -> list[tuple[dict[str, int], list[str]]]:
    """Every way to split the slots over groups, as counts, each with one slot assignment.

    Slots left empty are part of the search; equal counts are merged slot by slot, which keeps the
    table to a few hundred rows.
    """
    states: dict[tuple, tuple[str, ...]] = {(): ()}
    for slot in slots:
        grown: dict[tuple, tuple[str, ...]] = {}
        for counts, plan in states.items():
            for g in (*accepts(slot), ""):
                c = dict(counts)
                if g:
                    c[g] = c.get(g, 0) + 1
                grown.setdefault(tuple(sorted(c.items())), (*plan, g))
        states = grown
    return [(dict(c), list(p)) for c, p in states.items()]


def slot_vectors(templates: DataFrame) -> DataFrame:
    """Count vectors of each distinct slot list."""
    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(list(s), c, p, sum(c.values())) for s in b["slots"] for c, p in count_vectors(list(s))]
            out = pd.DataFrame(rows, columns=["slots", "_counts", "plan", "filled"])
            out["counts"] = [[{"g": g, "n": n} for g, n in c.items()] for c in out.pop("_counts")]
            yield out[["slots", "counts", "plan", "filled"]]

    return templates.select("slots").distinct().mapInPandas(
        expand, "slots array<string>, counts array<struct<g:string,n:int>>, plan array<string>, filled int")


def best_lineup(candidates: DataFrame, slots: DataFrame, objective: str = "proj_points") -> DataFrame:
    """Exact best line-up of every league: most slots filled first, then the highest total.

    A line-up is fixed by how many of each group it takes, since the best of a group always go
    first. Each league tries the count vectors of its slot list on the sorted scores per group.
    Returns starters with their slot, bench rows without one, and unfilled slots without a player.
    """
    pool = candidates.withColumn(objective, F.coalesce(F.col(objective).cast("double"), F.lit(0.0)))
    order = Window.partitionBy("league_id", "grp").orderBy(F.desc(objective), "foreign_id")
    pool = stage(pool.withColumn("_nth", F.row_number().over(order)))
    lists = slots.select("league_id", modeled_slots(F.col("slots")).alias("slots"))
    lists = stage(lists.where(F.size("slots") > 0))
    # one roster per league, so these lists are short
    scores = pool.groupBy("league_id", "grp").agg(
        F.sort_array(F.collect_list(objective), asc=False).alias("_s")).groupBy("league_id").agg(
        F.map_from_entries(F.collect_list(F.struct("grp", "_s"))).alias("_by"))
    tried = lists.join(slot_vectors(lists), "slots").join(scores, "league_id", "left")

    def taken(c):
        return F.coalesce(F.try_element_at("_by", c["g"]), F.array().cast("array<double>"))

    fits = F.forall("counts", lambda c: F.size(taken(c)) >= c["n"])
    total = F.aggregate(
        "counts", F.lit(0.0),
        lambda s, c: s + F.aggregate(F.slice(taken(c), F.lit(1), c["n"]), F.lit(0.0), lambda x, v: x + v))
    best = tried.where(fits).groupBy("league_id").agg(
        F.max_by(F.struct("slots", "plan"), F.struct("filled", F.round(total, 6), "plan")).alias("_b"))
    chosen = best.select("league_id", F.posexplode(F.arrays_zip("_b.slots", "_b.plan")).alias("slot_no", "_p")
                         ).select("league_id", "slot_no", F.col("_p.slots").alias("slot"), F.col("_p.plan").alias("grp"))
    nth = Window.partitionBy("league_id", "grp").orderBy("slot_no")
    chosen = chosen.withColumn("_nth", F.row_number().over(nth))
    both = chosen.join(pool, ["league_id", "grp", "_nth"], "full")
    status = F.when(F.col("slot").isNull(), "bench").when(F.col("foreign_id").isNull(), "empty").otherwise("starter")
    return both.withColumn("status", status).drop("_nth")


def passthrough_slots(rosters: DataFrame) -> DataFrame:
    """Slots no model covers keep the current starter, else the first eligible player."""
    every = rosters.select("league_id", "slots").dropDuplicates(["league_id"])
    other = every.select("league_id", F.explode(F.filter(
        "slots", lambda s: ~s.isin(*SLOTS, *MODELED))).alias("slot"))
    nth = F.row_number().over(Window.partitionBy("league_id", "slot").orderBy("slot"))
    other = other.withColumn("_nth", nth)
    free = rosters.where(~F.col("is_ir") & ~F.col("is_taxi") & F.col("foreign_id").isNotNull())
    order = Window.partitionBy("league_id", "grp").orderBy(F.desc("is_starter"), "foreign_id")
    free = free.withColumn("_nth", F.row_number().over(order)).drop("slots")
    return other.join(free.withColumnRenamed("grp", "slot"), ["league_id", "slot", "_nth"]).drop("_nth")


def swap_list(recommended: DataFrame, rosters: DataFrame) -> DataFrame:
    """START whom the line-up has and the owner does not, BENCH the reverse."""
    now = rosters.where("is_starter").select("league_id", "foreign_id", "entity_name")
    want = recommended.select("league_id", "foreign_id", "entity_name")
    key = ["league_id", "foreign_id"]
    return want.join(now, key, "left_anti").withColumn("action", F.lit("START")).unionByName(
        now.join(want, key, "left_anti").withColumn("action", F.lit("BENCH")))


def only_leagues(leagues: DataFrame, text: str) -> DataFrame:
    return leagues.where(F.lower("name").contains(text.lower()))


def league_export(lineups: DataFrame, passed: DataFrame, names: DataFrame) -> DataFrame:
    """Starters, passed-through starters and bench of each league with its slug."""
    out = lineups.where("status <> 'empty'").select("league_id", "slot", "foreign_id", "entity_name", "grp",
                                                    "proj_points", "status")
    kept = passed.select("league_id", "slot", "foreign_id", "entity_name", F.col("slot").alias("grp"),
                         F.lit("starter").alias("status"))
    both = out.unionByName(kept, allowMissingColumns=True).withColumn("slot", F.coalesce("slot", F.lit("")))
    return both.join(names.select("league_id", "league_name").distinct(), "league_id").withColumn(
        "slug", slug("league_name"))


def startable(board: DataFrame, objective: str = "proj_points") -> DataFrame:
    """Projected, modelled, neither injured-reserve nor taxi."""
    return board.where(F.col("grp").isin(*MODELED) & F.col(objective).isNotNull()
                       & ~F.col("is_ir") & ~F.col("is_taxi"))
