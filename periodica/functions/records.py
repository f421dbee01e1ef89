"""Keep-one, as-of and shifted-season joins."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_one(df: DataFrame, key: list[str], order: list[Column | str], last: bool = True) -> DataFrame:
    """First or last row of each key by a total order; an aggregate, so it combines map-side."""
    rest = [c for c in df.columns if c not in key]
    pick = F.max_by if last else F.min_by
    by = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return df.groupBy(*key).agg(pick(F.struct(*rest), by).alias("_row")).select(*key, "_row.*")


def asof_latest(
    panel: DataFrame, records: DataFrame, date: str, take: list[str],
    tie: list[str] | None = None, strict: bool = False, month: int = 8, day: int = 1,
) -> DataFrame:
    """Latest record of the entity dated on or before (or, strict, before) each season's cutoff, a day of its year.

    Records are first folded to the newest one per entity and first season that may see it, so a
    busy entity costs one row per season before anything is joined.
    """
    d = F.col(date).cast("date")
    line = F.make_date(F.year(d), F.lit(month), F.lit(day))
    in_time = d < line if strict else d <= line
    by = F.struct(date, *(tie or take))
    newest = (
        records.where(d.isNotNull())
        .withColumn("_season", F.when(in_time, F.year(d)).otherwise(F.year(d) + 1))
        .groupBy("entity", "_season")
        .agg(F.max(by).alias("_by"), F.max_by(F.struct(*take), by).alias("_row"))
    )
    found = (
        panel.select("entity", "season").join(newest, "entity")
        .where(F.col("_season") <= F.col("season"))
        .groupBy("entity", "season").agg(F.max_by("_row", "_by").alias("_row"))
        .select("entity", "season", *[F.col("_row." + t).alias(t) for t in take])
    )
    return panel.join(found, ["entity", "season"], "left")


def prior_join(panel: DataFrame, features: DataFrame, key: str = "entity") -> DataFrame:
    """Features of season t-1 on the row of season t."""
    shifted = features.withColumn("season", (F.col("season") + 1).cast("int"))
    return panel.join(shifted, [key, "season"], "left")


@contextmanager
def settings(spark, values: dict[str, str]):
    """Session settings that hold for what is run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_FALLBACK: dict[str, str] = {}


def shared_folder(spark) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, or a scratch one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir")
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        app = context.applicationId
        if app not in _FALLBACK:
            _FALLBACK[app] = tempfile.mkdtemp(prefix="run-")
        folder = _FALLBACK[app]
    return folder.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write a frame that several branches of a plan read, and read it back.

    The written table survives lost executors, ends the lineage and is read column by column.
    A frame that came from here is returned as it is. What the write shuffled is removed at once, not when the driver
    next collects garbage.
    """
    spark = df.sparkSession
    if getattr(df, "_staged", False):
        return df
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return out


def over(df: DataFrame, staged: DataFrame) -> DataFrame:
    """A frame worked out row by row from a staged one: branches read that one again instead of a copy."""
    df._staged = staged._staged
    return df


def small_join(rows: DataFrame, small: DataFrame, on: list[str], how: str = "left", bound: int = 100_000) -> DataFrame:
    """Join to a table of parameters: counted, and broadcast where it has at most ``bound`` rows."""
    small = stage(small)
    return rows.join(F.broadcast(small) if small.count() <= bound else small, on, how)


#: Staged tables of each application that were not removed yet.
_WRITTEN: dict[str, list[str]] = {}


def staged_tables(spark) -> list[str]:
    """Paths of this application's staged tables, oldest first."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, ()))


def release(spark, paths: list[str]) -> None:
    """Remove staged tables; nothing that is still to run may read them."""
    written = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for p in paths:
        if p in written:
            written.remove(p)
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unstage(*frames: DataFrame) -> None:
    """Remove the tables behind frames that ``stage`` gave, once all that reads them is staged itself."""
    for df in frames:
        release(df.sparkSession, [df._staged])
