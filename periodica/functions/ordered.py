"""Exact ranks, running totals and quantiles for groups of any size.

A plain ``rank() OVER (PARTITION BY grp)`` sorts a whole group in one task. Here rows are range-partitioned on
(group, value, id), so a large group, or a value shared by a third of all rows, lies in as many ranges as its rows need.
Each range is counted on its own and the totals of the ranges before it are added. Where the cuts fall steers balance
only; the result is exact for any cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import safe_corr
from .records import stage
from .shipping import ship

PARTS: int | None = None   # ranges of all groups together; none: as many as the session's shuffle partitions
MAP_SIDE = 1000            # largest top n that Spark cuts before the shuffle
CHUNK = 1 << 17            # rows that a task counts at a time; it holds no more of them


def _ranged(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.repartitionByRange(PARTS, *columns) if PARTS else df.repartitionByRange(*columns)


def with_bucket(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows with the number of their range of (key, order), written once; ranges of a key follow its order."""
    return stage(_ranged(df, [*key, *order]).withColumn("_bucket", F.spark_partition_id()))


def running_total(
    df: DataFrame, key: list[str], order: list[str], weight: Column, before: str, total: str
) -> DataFrame:
    """Add the sum of ``weight`` over rows ahead of this one in its key, and over the whole key.

    Keys must not be null. Rows equal in ``order`` may come in any order among themselves.
    """
    parts = with_bucket(df, key, order).withColumn("_weight", weight)
    sums = parts.groupBy(*key, "_bucket").agg(F.sum("_weight").alias("_sum"))
    # as many rows per key as it has ranges from here on
    whole = Window.partitionBy(*key)
    ahead = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *key, "_bucket",
        F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(whole).alias(total),
    )
    inside = (
        Window.partitionBy(*key, "_bucket").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        parts.withColumn(before, F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
        .join(offsets, [*key, "_bucket"])
        .withColumn(before, F.col(before) + F.col("_offset"))
        .drop("_bucket", "_weight", "_offset")
    )


@dataclass(frozen=True)
class Rank:
    """One rank column: method is min, average, pct (average over n) or first (ties by id)."""

    out: str
    value: str
    within: tuple[str, ...] = ()
    method: str = "min"
    descending: bool = True
    where: Column | None = None


def _long(df: DataFrame, ids: list[str], ranks: list[Rank]) -> tuple[DataFrame, list[str]]:
    """(a thin row per row and rank it takes part in: ids, _no, key columns, _v; the key columns, typed)."""
    within = list(dict.fromkeys(k for r in ranks for k in r.within))
    kinds, keys = dict(df.dtypes), [f"_k{i}" for i in range(len(within))]
    rows = []
    for no, r in enumerate(ranks):
        v = F.nanvl(F.col(r.value).cast("double"), F.lit(None).cast("double"))
        v = F.when(r.where, v) if r.where is not None else v
        rows.append(F.struct(
            F.lit(no).alias("_no"), (-v if r.descending else v).alias("_v"),
            *[(F.col(c) if c in r.within else F.lit(None)).cast(kinds[c]).alias(k)
              for c, k in zip(within, keys, strict=True)]))
    long = df.select(*ids, F.explode(F.array(*rows)).alias("_r")).select(*ids, "_r.*")
    return long.where(F.col("_v").isNotNull()), keys


def _placed(long: DataFrame, ids: list[str], keys: list[str]) -> DataFrame:
    """Rows in their range: _before (rows of the group in it with a smaller value), _same (with this one), _size (of
    the group), _at (place by value and id), _part, and _edge for groups that may go on in the next range.

    What a task counts is cut into ranges of about ``CHUNK`` rows, in order, however many rows its partition has.
    """
    ship(long.sparkSession)
    order = ["_no", *keys, "_v", *ids]
    sorted_rows = _ranged(long, order).sortWithinPartitions(*order).select(
        *ids, "_no", F.xxhash64("_no", *keys).alias("_g"), "_v")
    n = len(ids)
    schema = sorted_rows.schema.simpleString()[len("struct<"): -1] + (
        ",_before:bigint,_same:bigint,_size:bigint,_at:bigint,_part:bigint,_edge:boolean")

    def lengths(starts: np.ndarray, total: int) -> np.ndarray:
        size = np.diff(np.append(starts, total))
        return np.repeat(size, size)

    def work(batches):
        part, held, n_held = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n_held += b.num_rows
            if n_held >= CHUNK:
                yield from counted(held, part)
                part, held, n_held = part + 1, [], 0
        if held:
            yield from counted(held, part)

    def counted(held, part):
        rows = pa.Table.from_batches(held).combine_chunks()
        total = rows.num_rows
        g, v = rows.column(n + 1).to_numpy(), rows.column(n + 2).to_numpy()
        place, first = np.arange(total), np.ones(total, bool)
        first[1:] = g[1:] != g[:-1]
        tie = first.copy()
        tie[1:] |= v[1:] != v[:-1]
        group, run = np.flatnonzero(first), np.flatnonzero(tie)
        size, same = lengths(group, total), lengths(run, total)
        opened = np.repeat(group, np.diff(np.append(group, total)))
        before = np.repeat(run, np.diff(np.append(run, total))) - opened
        edge = (opened == 0) | (opened == group[-1])
        more = {"_before": before, "_same": same, "_size": size, "_at": place - opened,
                "_part": np.full(total, part, np.int64), "_edge": edge}
        for name, values in more.items():
            rows = rows.append_column(name, pa.array(values))
        yield from rows.to_batches(max_chunksize=1 << 16)

    return sorted_rows.mapInArrow(work, schema)


def _over_edges(placed: DataFrame) -> DataFrame | None:
    """What groups in several ranges have ahead of each of these: at most two rows per range, put together here."""
    rows = placed.where("_edge").groupBy("_no", "_g", "_part").agg(
        F.max("_size").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"),
        F.max(F.when(F.col("_before") == 0, F.col("_same"))).alias("n_low"),
        F.max(F.when(F.col("_before") + F.col("_same") == F.col("_size"), F.col("_same"))).alias("n_high")).collect()
    groups: dict[tuple[int, int], list] = {}
    for r in sorted(rows, key=lambda r: r["_part"]):
        groups.setdefault((r["_no"], r["_g"]), []).append(r)
    out = []
    for (no, g), parts in groups.items():
        if len(parts) == 1:
            continue
        ties: dict[float, list[int]] = {}
        ahead, offsets = 0, []
        for r in parts:
            offsets.append(ahead)
            for value, start, n in {r["low"]: (r["low"], ahead, r["n_low"]),
                                    r["high"]: (r["high"], ahead + r["n"] - r["n_high"], r["n_high"])}.values():
                known = ties.setdefault(value, [start, 0])
                known[1] += n
            ahead += r["n"]
        out += [(no, g, r["_part"], before, ahead, r["low"], *ties[r["low"]], r["high"], *ties[r["high"]])
                for r, before in zip(parts, offsets, strict=True)]
    if not out:
        return None
    return placed.sparkSession.createDataFrame(out, (
        "_no int, _g long, _part long, _ahead long, _all long, _low double, _low_before long, _low_same long, "
        "_high double, _high_before long, _high_same long"))


def rank_values(df: DataFrame, ids: list[str], ranks: list[Rank]) -> DataFrame:
    """Rank columns alone, one row per id that has at least one rank; all ranks share one range partitioning."""
    long, keys = _long(df, ids, ranks)
    placed = stage(_placed(long, ids, keys))
    over = _over_edges(placed)
    before, same, size, at = (F.col(c) for c in ("_before", "_same", "_size", "_at"))
    if over is not None:
        placed = placed.join(F.broadcast(over), ["_no", "_g", "_part"], "left")
        v = F.col("_v")

        def of(c, name):
            return F.when(v == F.col("_low"), F.col(f"_low_{name}")).when(
                v == F.col("_high"), F.col(f"_high_{name}")).otherwise(c)

        ahead = F.coalesce("_ahead", F.lit(0))
        before, same = of(ahead + before, "before"), of(same, "same")
        size, at = F.coalesce("_all", size), ahead + at
    average = before + (same + 1) / 2.0
    value = {"min": before + 1, "average": average, "pct": average / size, "first": at + 1}
    return placed.groupBy(*ids).agg(*[
        F.max(F.when(F.col("_no") == no, value[r.method])).alias(r.out) for no, r in enumerate(ranks)])


def add_ranks(df: DataFrame, ids: list[str], ranks: list[Rank]) -> DataFrame:
    """Add every rank column in one pass over the frame, written once; ``ids`` must identify a row."""
    df = stage(df)
    return df.join(rank_values(df, ids, ranks), ids, "left")


def group_quantiles(
    df: DataFrame, key: list[str], value: str, probs: dict[str, float], count: str = "n"
) -> DataFrame:
    """Exact linearly interpolated quantiles per key, nulls left out, plus the row count."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    distinct = stage(
        df.select(*key, v.alias("_v")).where(F.col("_v").isNotNull())
        .groupBy(*key, "_v").agg(F.count("*").alias("_c"))
    )
    placed = running_total(distinct, key, ["_v"], F.col("_c"), "_before", "_n")
    aggs = [F.max("_n").alias(count)]
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("_before") <= place) & (place < F.col("_before") + F.col("_c"))
            aggs.append(F.max(F.when(here, F.col("_v"))).alias(f"_{name}_{side}"))
    out = placed.groupBy(*key).agg(*aggs)
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col(count) - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out = out.withColumn(name, lo + (hi - lo) * (at - F.floor(at)))
    return out.select(*key, count, *probs)


def spearman(
    df: DataFrame, ids: list[str], key: list[str], a: str, b: str, out: str = "spearman_r"
) -> DataFrame:
    """Spearman correlation per key over rows where both values are present, with the count."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = rank_values(rows, list(dict.fromkeys([*ids, *key])), [
        Rank("_ra", a, tuple(key), "average"), Rank("_rb", b, tuple(key), "average")])
    varies = (F.min("_ra") < F.max("_ra")) & (F.min("_rb") < F.max("_rb"))
    return ranked.groupBy(*key).agg(
        F.count("*").alias("n"), F.when(varies, safe_corr("_ra", "_rb")).alias(out))


def top_rows(
    df: DataFrame, within: list[str], value: str, n: int, ids: list[str], rank: str = "row_rank"
) -> DataFrame:
    """Best ``n`` rows per key, ties by id; keys must not be null where n is above ``MAP_SIDE``.

    Up to there Spark cuts each map task to n rows before the shuffle; larger n are ranked bucket by bucket.
    """
    if n > MAP_SIDE:
        v = F.col(value)
        kind = F.when(v.isNull(), 2).when(F.isnan(v.cast("double")), 0).otherwise(1)
        placed = running_total(df.withColumns({"_kind": kind, "_down": -v}), within, ["_kind", "_down", *ids],
                               F.lit(1), rank, "_rows")
        return placed.withColumn(rank, (F.col(rank) + 1).cast("int")).where(F.col(rank) <= n).select(
            *df.columns, rank)
    order = Window.partitionBy(*within).orderBy(F.col(value).desc_nulls_last(), *ids)
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n)
