"""Error tables of long predictions: model, eval_season, entity, grp, actual, predicted."""

from __future__ import annotations

import random
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_corr, safe_div
from ..functions.ordered import Rank, add_ranks, group_quantiles, spearman, top_rows
from ..functions.records import over, release, small_join, stage, staged_tables
from ..functions.stats import normal_crps


#: Rows of predictions that are ranked at a time.
RANKED = 1 << 22


def with_errors(df: DataFrame) -> DataFrame:
    e = F.col("predicted") - F.col("actual")
    return df.withColumns({"error": e, "abs_error": F.abs(e), "sq_error": e * e})


def model_scores(cv: DataFrame, base_error: str = "lag1_abs_error") -> DataFrame:
    """MAE, RMSE, bias, correlation and skill against the random walk per model."""
    walk = cv.where(F.col("model") == "random_walk").agg(F.avg(base_error)).scalar()
    spread = (F.stddev_pop("actual") > 0) & (F.stddev_pop("predicted") > 1e-9)
    return cv.groupBy("model").agg(
        F.avg("abs_error").alias("mae"), F.sqrt(F.avg("sq_error")).alias("rmse"),
        F.avg("error").alias("bias"), F.when(spread, safe_corr("actual", "predicted")).alias("pearson_r"),
        F.count("*").alias("n"), F.count_distinct("eval_season").alias("n_seasons"),
    ).withColumn("skill", 1 - safe_div("mae", walk))


def mae_pivot(cv: DataFrame, by: str, values: list) -> DataFrame:
    """MAE per model, one column per group, season or period."""
    return cv.groupBy("model").pivot(by, values).agg(F.avg("abs_error"))


def mae_by_group(cv: DataFrame, groups: list[str]) -> DataFrame:
    return mae_pivot(cv, "grp", groups)


def mae_by_season(cv: DataFrame, seasons: list[int]) -> DataFrame:
    return mae_pivot(cv, "eval_season", seasons)


def forecast_table(cv: DataFrame, models: list[str], best: str) -> DataFrame:
    """One row per entity, one column per model, the best one named ``forecast``."""
    key = ["eval_season", "entity", "entity_name", "grp"]
    wide = cv.groupBy(*key).pivot("model", models).agg(F.first("predicted"))
    cols = [F.bround(F.col(m), 1).alias("forecast" if m == best else f"forecast_{m}") for m in models]
    lag = cv.groupBy("eval_season", "entity").agg(F.max("lag1").alias("rw_forecast"))
    out = wide.select(*key, *cols).join(lag, ["eval_season", "entity"])
    return out.withColumn("vs_rw", F.bround(F.col("forecast") - F.col("rw_forecast"), 1))


def score_predictions(predictions: DataFrame, tier: str = "max_tier", market: str = "market_consensus",
                      k: int = 24) -> DataFrame:
    """Per model, tier and season: raw error, rank quality in groups, weighted error, CRPS, skill."""
    run = ["model", tier, "eval_season"]
    key = [*run, "grp"]
    p = predictions.select(*key, "entity", "actual", "predicted", "abs_error", "sq_error", "distribution_sd")
    p = over(p, predictions) if getattr(predictions, "_staged", False) else stage(p)
    rank = _group_spearman(p, run, key).where("n >= 3").groupBy(*run).agg(
        F.avg("spearman_r").alias("spearman_within_group"))

    best = stage(top_rows(p.select(*key, "entity", "actual"), key, "actual", k, ["entity"]))
    picked = top_rows(p.select(*key, "entity", "predicted"), key, "predicted", k, ["entity"])
    hit = best.select(*key, "entity").join(picked.select(*key, "entity"), [*key, "entity"], "left_semi")
    per = stage(best.groupBy(*key).agg(F.count("*").alias("_k"), F.min("actual").alias("_level")).join(
        hit.groupBy(*key).agg(F.count("*").alias("_hits")), key, "left"))
    precision = per.groupBy(*run).agg(
        F.avg(F.coalesce("_hits", F.lit(0)) / F.col("_k")).alias("top_precision"))

    weight = F.greatest(F.lit(0.0), F.col("actual") - F.col("_level")) + 1
    weighted = small_join(p, per.select(*key, "_level"), key, "inner")
    crps = normal_crps("actual", "predicted", "distribution_sd")
    sure = F.count_if(F.coalesce(F.col("distribution_sd") > 0, F.lit(False))) == F.count("*")
    base = weighted.withColumns({"_w": weight, "_crps": crps}).groupBy(*run).agg(
        F.avg("abs_error").alias("mae"), F.sqrt(F.avg("sq_error")).alias("rmse"),
        (F.sum(F.col("_w") * F.col("abs_error")) / F.sum("_w")).alias("vor_weighted_mae"),
        F.when(sure, F.avg("_crps")).alias("crps"))
    level = p.where(F.col("model") == market).groupBy("eval_season").agg(
        F.avg("abs_error").alias("_market"))
    return (
        base.join(rank, run, "left").join(precision, run).join(level, "eval_season", "left")
        .withColumn("skill_vs_market", 1 - safe_div("mae", "_market")).drop("_market")
    )


def _group_spearman(p: DataFrame, run: list[str], key: list[str]) -> DataFrame:
    """Spearman correlation of actual and predicted per key, with the count.

    Runs are ranked about ``RANKED`` rows at a time, a group under one number, and what ranking a batch wrote is removed.
    """
    spark, number, group = p.sparkSession, F.xxhash64(*run), F.xxhash64(*key)
    batches, held = [[]], 0
    for r in p.groupBy(number.alias("run")).count().sort("run").collect():
        if batches[-1] and held + r["count"] > RANKED:
            batches.append([])
            held = 0
        batches[-1].append(r["run"])
        held += r["count"]
    named = stage(p.groupBy(*key).agg(F.first(group).alias("_group")))
    parts = []
    for batch in batches:
        before = set(staged_tables(spark))
        rows = p.where(number.isin(batch)) if len(batches) > 1 else p
        rows = rows.select(group.alias("_group"), "entity", "actual", "predicted")
        parts.append(stage(spearman(rows, ["_group", "entity"], ["_group"], "actual", "predicted")))
        release(spark, [t for t in staged_tables(spark) if t not in before and t != parts[-1]._staged])
    return named.join(reduce(lambda a, b: a.union(b), parts), "_group").drop("_group")


def ablation_table(scores: DataFrame, tiers: list[int], metric: str = "mae") -> DataFrame:
    return scores.groupBy("model").pivot("max_tier", tiers).agg(F.avg(metric))


def error_percentiles(cv: DataFrame) -> DataFrame:
    return group_quantiles(cv, ["model"], "abs_error", {"p25": .25, "p50": .5, "p75": .75, "p90": .9})


def bias_by_group(cv: DataFrame, groups: list[str]) -> DataFrame:
    return cv.groupBy("model").pivot("grp", groups).agg(F.avg("error"))


def skill_by_season(cv: DataFrame) -> DataFrame:
    """Skill of every model against the random walk, season by season."""
    mae = cv.groupBy("model", "eval_season").agg(F.avg("abs_error").alias("mae"))
    walk = mae.where(F.col("model") == "random_walk").select("eval_season", F.col("mae").alias("_w"))
    return mae.join(walk, "eval_season", "left").withColumn("skill", 1 - safe_div("mae", "_w")).drop("_w")


def ranked_forecast(forecast: DataFrame, value: str = "predicted") -> DataFrame:
    """Overall places without ties, group places with shared ones."""
    return add_ranks(forecast, ["season", "entity"], [
        Rank("overall_rank", value, ("season",), "first"), Rank("group_place", value, ("season", "grp"))])


def leak_audit(panel: DataFrame, columns: list[str], target: str = "target",
               threshold: float = 0.85) -> DataFrame:
    """Columns whose rank correlation with the target is suspicious, all columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
                      for c in columns])
    long = panel.select("entity", "season", F.col(target).alias("t"), F.explode(pairs).alias("_p")).select(
        "entity", "season", "t", "_p.*")
    r = spearman(long, ["entity", "season", "column"], ["column"], "v", "t")
    return r.where((F.col("n") >= 3) & (F.abs(F.col("spearman_r")) > threshold))


def assert_tier_window(panel: DataFrame, first: int) -> None:
    actual = panel.agg(F.min("season")).first()[0]
    if actual != first:
        raise AssertionError(f"panel begins in {actual}, the registry says {first}")


def permutations(n: int, repeats: int, seed: int) -> list[tuple[int, int, int]]:
    """(number, factor, shift) of maps i -> (factor * i + shift) mod n that reach every index once."""
    rng, out = random.Random(seed), []
    for k in range(repeats):
        factor = next(a for a in iter(lambda: rng.randrange(1, max(n, 2)), None) if gcd(a, n) == 1)
        out.append((k, factor, rng.randrange(n) if n else 0))
    return out


def dealt_targets(train: DataFrame, repeats: int, seed: int, keep: tuple[str, ...] = ("x",)) -> DataFrame:
    """Every row once, with the targets it gets in ``repeats`` deals (``_dealt``, by deal), in one join.

    Rows are numbered once in a pseudorandom order; a deal maps numbers through its own permutation. Only numbers and
    targets travel once per deal: each target to the numbers that get it.
    """
    hashed = stage(train.select("target", *keep, F.xxhash64("entity", "season", F.lit(seed)).cast("double").alias("_h"))
                   .withColumn("_row", F.monotonically_increasing_id()))
    placed = stage(add_ranks(hashed, ["_row"], [Rank("_i", "_h", (), "first")]))
    n = placed.count()
    # row i gets the target of row a * i + b, so that of row j goes to (j - b) / a
    deals = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(pow(a, -1, max(n, 1))).cast("decimal(18,0)").alias("a"),
                               F.lit(n - b).alias("b")) for k, a, b in permutations(n, repeats, seed)])
    sent = placed.select((F.col("_i") - 1).cast("decimal(18,0)").alias("_j"), "target", F.explode(deals).alias("_d"))
    to = F.pmod(F.col("_d.a") * (F.col("_j") + F.col("_d.b")).cast("decimal(19,0)"), F.lit(n)).cast("long") + 1
    sent = sent.select(to.alias("_i"), F.struct(F.col("_d.k").alias("k"), F.col("target").alias("y")).alias("_t"))
    dealt = sent.groupBy("_i").agg(F.sort_array(F.collect_list("_t")).alias("_t"))
    # sizes of exploded rows are guessed far too low for a broadcast
    return placed.join(dealt.hint("merge"), "_i").select(*keep, F.transform("_t", lambda t: t["y"]).alias("_dealt"))


def hit_rates(actual: Column, predicted: Column) -> dict[str, Column]:
    tp, fp, fn = (F.count_if(a) for a in (actual & predicted, ~actual & predicted, actual & ~predicted))
    precision = F.coalesce(safe_div(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(safe_div(tp, tp + fn), F.lit(0.0))
    return {"precision": precision, "recall": recall,
            "f1": F.coalesce(safe_div(2 * precision * recall, precision + recall), F.lit(0.0)),
            "boom_n": F.count_if(actual)}
