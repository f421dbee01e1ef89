"""Walk-forward evaluation of season forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import top_rows
from ..functions.records import over, small_join, stage
from ..models import boosting, closed, pooled, ridge
from ..operators.panel import tier_columns, tier_first_season, top_n_entities
from ..operators.scoring import dealt_targets, score_predictions, with_errors

CV_COLUMNS = ["model", "eval_season", "entity", "entity_name", "grp", "actual", "predicted", "lag1"]


def train_top_n_filter(panel: DataFrame, n: int) -> DataFrame:
    """Rows of the best n by lag 1 within each season."""
    return top_rows(panel, ["season"], "value_lag1", n, ["entity"]).drop("row_rank")


def long_form(wide: DataFrame, models: tuple[str, ...], sd: dict[str, str] | None = None,
              keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per model from ``f_*`` columns, with errors."""
    sd = sd or {}
    none = F.lit(None).cast("double")
    rows = F.explode(F.array(*[F.struct(
        F.lit(m).alias("model"), F.col(f"f_{m}").cast("double").alias("predicted"),
        (F.col(sd[m]) if m in sd else none).alias("distribution_sd")) for m in models]))
    name = F.col("entity_name") if "entity_name" in wide.columns else F.lit("")
    out = wide.select(
        F.col("season").alias("eval_season"), "entity", name.alias("entity_name"), "grp", *keep,
        F.col("target").cast("double").alias("actual"),
        F.coalesce(F.col("value_lag1"), F.lit(0.0)).alias("lag1"), rows.alias("_r"),
    ).select("*", "_r.*").drop("_r").where(F.col("predicted").isNotNull())
    out = with_errors(out)
    return out.withColumn("lag1_abs_error", F.abs(F.col("lag1") - F.col("actual")))


def _eligible(panel: DataFrame, eval_seasons: list[int] | None, min_train: int) -> DataFrame:
    ok = closed.train_seasons(panel).where(F.col("train_seasons") >= min_train)
    if eval_seasons:
        ok = ok.where(F.col("fold").isin(eval_seasons))
    return ok.select(F.col("fold").alias("season"))


def walk_forward_cv(panel: DataFrame, totals: DataFrame, eval_seasons: list[int],
                    models: tuple[str, ...] = closed.CLOSED_FORM[:4], top_n: int = 200,
                    train_top_n: int = 0, min_train_seasons: int = 5, features: list[str] | None = None,
                    codes: list[int] | None = None, tree_rounds: int = 200) -> DataFrame:
    """Season T from the seasons before it, scored on the best entities of T-1 by season total.

    ``ridge`` and ``trees`` learn from ``features``, ``partial_pooling`` from the first lag; all folds of a model are
    fitted together.
    """
    train = None
    if train_top_n:
        kept = train_top_n_filter(panel, train_top_n).select("entity", "season", F.lit(True).alias("_train"))
        panel = panel.join(kept, ["entity", "season"], "left")
        train = F.coalesce("_train", F.lit(False))
    panel = stage(panel)
    out = over(closed.forecasts(panel, models, train), panel)
    out = learned_forecasts(out, models, features or [], codes, eval_seasons, train, tree_rounds=tree_rounds)
    out = small_join(out, _eligible(panel, eval_seasons, min_train_seasons), ["season"], "left_semi")
    if top_n:
        best = top_n_entities(totals, top_n).select("entity", (F.col("season") + 1).cast("int").alias("season"))
        out = out.join(best, ["entity", "season"], "left_semi")
    return long_form(out, models, _SPREAD)


def ridge_forecasts(panel: DataFrame, features: list[str], codes: list[int], alpha: float = 10.0,
                    tune: bool = False, out: str = "f_ridge", target: str = "target") -> DataFrame:
    rows, _ = ridge.design(panel, features, codes)
    m = ridge.moments(rows, "season", target)
    if not tune:
        fits = ridge.fold_fits(m, alpha)
    else:
        fits = {}
        for k in sorted(m)[1:]:
            past = {j: v for j, v in m.items() if j < k}
            best, _ = ridge.cross_validated_alpha(past, rows.where(F.col("season") < k), "season", target=target)
            fits[k] = ridge.solve(sum(past.values()), best)
    return ridge.predict(rows, ridge.fit_table(panel.sparkSession, fits), "season", out).drop("x")


#: Models whose forecasts have a spread, and its column.
_SPREAD = {"partial_pooling": "distribution_sd"}


def learned_forecasts(rows: DataFrame, models: tuple[str, ...], features: list[str], codes: list[int] | None,
                      folds: list[int] | None = None, train: Column | None = None, tune: bool = False,
                      tree_rounds: int = 200) -> DataFrame:
    """Rows with ``f_ridge``, ``f_trees`` and ``f_partial_pooling``, whichever are wanted, each season from those before it.

    Rows outside ``train`` get forecasts and teach nothing.
    """
    if not {"ridge", "trees", "partial_pooling"} & set(models):
        return rows
    learn = F.col("target") if train is None else F.when(train, F.col("target"))
    out = rows.withColumn("_learn", learn)
    out = over(out, rows) if getattr(rows, "_staged", False) else stage(out)
    if "ridge" in models:
        if codes is None:
            raise ValueError("ridge needs the group codes of the settings")
        out = ridge_forecasts(out, [c for c in features if c != "grp_code"], codes, tune=tune, target="_learn")
    if "trees" in models:
        known = sorted(r[0] for r in rows.select("season").distinct().collect())[1:]
        known = [k for k in known if not folds or k in folds]
        runs = [boosting.Run(k) for k in known]
        if tune:
            runs, _ = boosting.tuned_runs(out, features, known, "season", ["entity", "season"], tree_rounds,
                                          target="_learn")
        forest, _ = boosting.fit(out, features, runs, "season", ["entity", "season"], "_learn", tree_rounds)
        out = boosting.predict(out, forest, "season", "f_trees")
    if "partial_pooling" in models:
        out = pooled.forecasts(out, "_learn")
    return out.drop("_learn")


def walk_forward_evaluate(panel: DataFrame, max_tier: int = 0, eval_seasons: list[int] | None = None,
                          min_train_seasons: int = 3, models: tuple[str, ...] | None = None,
                          codes: list[int] | None = None, tune: bool = False,
                          tree_rounds: int = 200) -> DataFrame:
    """Every entity of season T from the seasons before; models whose inputs are absent are left out."""
    out, wanted = _evaluated(panel, max_tier, eval_seasons, min_train_seasons, models, codes, tune, tree_rounds)
    return long_form(out, wanted, _SPREAD).withColumn("max_tier", F.lit(max_tier))


def _evaluated(panel: DataFrame, max_tier: int, eval_seasons: list[int] | None, min_train: int,
               models: tuple[str, ...] | None, codes: list[int] | None, tune: bool, tree_rounds: int = 200,
               control: bool = False) -> tuple[DataFrame, tuple[str, ...]]:
    """(rows to be scored with ``f_*`` columns, their models), with a ridge on tier 0 beside them if ``control``."""
    wanted = models or (*closed.CLOSED_FORM[:4], "ridge",
                        *(("market_consensus",) if max_tier >= 1 else ()))
    if "consensus_rank" not in panel.columns:
        wanted = tuple(m for m in wanted if m != "market_consensus")
    panel = stage(panel)

    def of(tier: int) -> list[str]:
        return [c for c in tier_columns(tier) if c in panel.columns]

    out = over(closed.forecasts(panel, wanted), panel)
    out = learned_forecasts(out, wanted, of(max_tier), codes, None, None, tune, tree_rounds)
    if control:
        if codes is None:
            raise ValueError("ridge needs the group codes of the settings")
        out = ridge_forecasts(out, [c for c in of(0) if c != "grp_code"], codes, tune=tune, out=f"f_{CONTROL}")
        wanted = (*wanted, CONTROL)
    return small_join(out, _eligible(panel, eval_seasons, min_train), ["season"], "left_semi"), wanted


#: Ridge on tier 0 alone, over the panel of a higher tier.
CONTROL = "ridge_tier0_control"


def run_ablation(panel: DataFrame, tiers: tuple[int, ...] = (0, 1, 2, 3, 4), min_train_seasons: int = 3,
                 first_season=tier_first_season, models: tuple[str, ...] | None = None,
                 codes: list[int] | None = None, tune: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nested tier sweep, with a tier-0 ridge control on every restricted panel.

    Tiers read the one staged panel. What is written of a tier is its scored rows, once, with a column per model; the
    long predictions are worked out from these.
    """
    panel = stage(panel)
    parts = []
    for tier in tiers:
        cut = over(panel.where(F.col("season") >= first_season(tier)), panel)
        out, wanted = _evaluated(cut, tier, None, min_train_seasons, models, codes, tune, control=tier > 0)
        kept = ["season", "entity", "entity_name", "grp", "target", "value_lag1", *_SPREAD.values()]
        wide = stage(out.select(*[c for c in kept if c in out.columns], *[f"f_{m}" for m in wanted]))
        parts.append(long_form(wide, wanted, _SPREAD).withColumn("max_tier", F.lit(tier)))
    raw = over(reduce(lambda a, b: a.unionByName(b), parts), wide)
    return raw, score_predictions(raw)


def shuffled_target_r2(panel: DataFrame, features: list[str], codes: list[int], eval_season: int,
                       repeats: int = 20, alpha: float = 10.0, seed: int = 42) -> float:
    """Mean hold-out R2 of a ridge fitted on permuted targets; a sound panel gives about zero.

    All permutations are dealt in one join, and one scan gives a matrix of cross products for each; a row's features
    travel once, not once per permutation.
    """
    rows, _ = ridge.design(stage(panel), features, codes)
    train, test = rows.where(F.col("season") < eval_season), rows.where(F.col("season") == eval_season)
    m = ridge.dealt_moments(dealt_targets(train, repeats, seed))
    fits = ridge.fit_table(panel.sparkSession, {k: ridge.solve(v, alpha) for k, v in m.items()})
    tried = test.withColumn("_seed", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    e = F.col("target") - F.col("_p")
    scores = ridge.predict(tried, fits, "_seed", "_p").groupBy("_seed").agg(
        (1 - F.sum(e * e) / (F.var_pop("target") * F.count("*"))).alias("r2"))
    return float(scores.agg(F.avg("r2")).first()[0])


def model_weights(panel: DataFrame, features: list[str], codes: list[int], alpha: float = 10.0,
                  tree_rounds: int = 0) -> DataFrame:
    """family, feature, coefficient of every model fitted on all rows, each from sums of one scan.

    Ridge: standardised coefficients. Lines: per group slope and means (regression to the mean), slope and intercept
    (market, if the panel has ranks). Pooling: lines per group, shared slope and spread. Trees (``tree_rounds`` above
    0): shares of all gains. The table has a few rows per feature and group.
    """
    panel = stage(panel)
    rows, names = ridge.design(panel, features, codes)
    m = ridge.moments(rows, "season")
    beta = ridge.solve(sum(m.values()), alpha)["beta"]
    table = [("ridge", n, float(b)) for n, b in zip(names, beta, strict=True)]
    sums = pooled.group_sums(panel.where("target IS NOT NULL"))
    fitted = pooled.fit(sums)
    for c, a, b in zip(fitted["codes"], fitted["alpha"], fitted["beta"], strict=True):
        table += [("partial_pooling", f"alpha_{c}", float(a)), ("partial_pooling", f"beta_{c}", float(b))]
    table += [("partial_pooling", n, float(fitted[n])) for n in ("gamma", "sigma", "center")]
    if tree_rounds:
        last = panel.agg(F.max("season")).first()[0]
        forest, _ = boosting.fit(panel, features, [boosting.Run(last + 1)], "season", ["entity", "season"],
                                 trees=tree_rounds)
        table += [("trees", n, g) for n, g in boosting.importances(forest).items()]
    learned = panel.sparkSession.createDataFrame(table, "family string, feature string, coefficient double")
    return learned.unionByName(model_lines(panel))


def model_lines(panel: DataFrame) -> DataFrame:
    """family, feature, coefficient of the closed-form lines per group, fitted on all rows."""
    whole = panel.withColumn("season", F.lit(0)).unionByName(panel.limit(1).withColumn("season", F.lit(1)))
    parts = [("regression_to_mean", closed.mean_reversion_params(whole, F.lit(True))[0], ("beta", "mu_x", "mu_y"))]
    if "consensus_rank" in panel.columns:
        parts.append(("market_consensus", closed.market_params(whole, F.lit(True))[0], ("m_slope", "m_icept")))
    out = []
    for family, params, cols in parts:
        pairs = F.explode(F.array(*[F.struct(
            F.concat(F.lit(c + "_"), F.col("grp_code").cast("string")).alias("feature"),
            F.col(c).alias("coefficient")) for c in cols]))
        out.append(params.where("fold = 1").select(F.lit(family).alias("family"), pairs.alias("_p")).select("family", "_p.*"))
    return reduce(lambda a, b: a.unionByName(b), out)
