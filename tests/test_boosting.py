"""Boosted trees of all folds in one pass against trees grown one by one, and the normal distribution."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodica.functions.stats import normal_cdf, normal_crps
from periodica.models import boosting, closed

SEASONS = range(2000, 2005)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for s in SEASONS:
        for e in range(90):
            x = rng.normal(size=3).round(2).tolist()
            y = 10 + 5 * (x[0] > 0.3) - 4 * (x[1] > 0) * (x[0] < 0) + rng.normal()
            out.append((e, s, x[0], x[1] if e % 7 else None, x[2], float(y) if e % 11 else None))
    return spark.createDataFrame(out, "entity long, season int, a double, b double, c double, target double").repartition(3)


def _grown(bins, grad, use, run, level, allowed, node=0):
    """(splits, values) of one tree over the rows in use, by recursion."""
    g, h = grad[use].sum(), use.sum()
    best = (0, -1, 0)
    if level < run.depth:
        for f in allowed:
            for c in range(int(bins[:, f].max())):
                left, right = use & (bins[:, f] <= c), use & (bins[:, f] > c)
                if left.sum() and right.sum():
                    gain = round(sum(grad[s].sum() ** 2 / (s.sum() + run.penalty) for s in (left, right))
                                 - g * g / (h + run.penalty), 6)
                    if gain > best[0]:
                        best = (gain, f, c)
    out = np.full(len(bins), -run.rate * g / (h + run.penalty))
    if best[1] >= 0:
        for side in (bins[:, best[1]] <= best[2], bins[:, best[1]] > best[2]):
            out[side] = _grown(bins, grad, use & side, run, level + 1, allowed)[side]
    return out


def test_all_folds_at_once(spark, rows):
    runs = [boosting.Run(2002), boosting.Run(2004), boosting.Run(2004, 3, 0.3, 1.0), boosting.Run(2000)]
    forest, state = boosting.fit(rows, ["a", "b", "c"], runs, "season", ["entity", "season"], trees=4, bins=16, columns=0.67)
    got = state.toPandas()
    assert len(got) == rows.where("target IS NOT NULL").count()
    bins = np.array([np.frombuffer(b, np.uint8) for b in got.bins])
    key, ids, y = (got[c].to_numpy() for c in ("key", "id", "y"))
    for i, run in enumerate(runs):
        past = key < run.fold
        pred = np.full(len(y), y[past].mean() if past.any() else 0.0)
        for t in range(4):
            use = past & boosting.in_sample(ids, t, 0.8, 42)
            pred = pred + (_grown(bins, pred - y, use, run, 0, boosting.columns_of(t, 3, 0.67, 42)) if use.any() else 0.0)
        assert np.allclose(np.stack(got.pred.to_numpy())[:, i], pred)
    shown = boosting.predict(rows, forest, "season").where("target IS NOT NULL").toPandas().set_index(["entity", "season"])
    assert shown.loc[shown.index.get_level_values(1) == 2002, "predicted"].notna().all()
    assert shown.loc[shown.index.get_level_values(1) == 2001, "predicted"].isna().all()
    errors = boosting.errors_by_run(state, forest)
    mine = shown.xs(2002, level=1)
    assert np.isclose(errors[runs[0]][1], (mine.predicted - mine.target).abs().sum()) and errors[runs[0]][0] == len(mine)
    assert abs(sum(boosting.importances(forest).values()) - 1) < 1e-9
    later = boosting.predict(rows, forest, "season", exact=False).where("season = 2003").toPandas()
    assert later.predicted.notna().all()


def test_staged_predictions_and_empty_input(spark, rows, monkeypatch):
    run = [boosting.Run(2004, 2, 0.2, 1.0)]
    whole = boosting.fit(rows, ["a", "b"], run, "season", ["entity", "season"], trees=5)[0]
    monkeypatch.setattr(boosting, "STAGE_EVERY", 2)
    cut = boosting.fit(rows, ["a", "b"], run, "season", ["entity", "season"], trees=5)[0]
    assert np.array_equal(whole.feature, cut.feature) and np.allclose(whole.value, cut.value)
    none = boosting.fit(rows.limit(0), ["a"], run, "season", ["entity", "season"], trees=2)[0]
    assert none.trees == 2 and boosting.predict(rows.limit(0), none, "season").count() == 0


def test_grid_is_shared_by_folds(spark, rows, monkeypatch):
    monkeypatch.setattr(boosting, "GRID", {"depth": (1, 2), "rate": (0.1, 0.5), "penalty": (1.0,)})
    best, scores = boosting.tuned_runs(rows, ["a", "b"], [2003, 2004], "season", ["entity", "season"], trees=3)
    assert best[0] == boosting.Run(2003) and best[1] == min(scores, key=scores.get)[1] and len(scores) == 4


def test_normal(spark):
    z = [-9.0, -7.2, -3.5, -1.0, -1e-9, 0.0, 0.4, 2.0, 6.9, 7.5, 12.0]
    df = spark.createDataFrame([(x, 0.0) for x in z] + [(None, 0.0), (1.0, -1.0)], "z double, s double")
    got = [r[0] for r in df.where("s = 0").select(normal_cdf("z")).collect()]
    assert got[-1] is None
    for x, p in zip(z, got):
        assert abs(p - 0.5 * math.erfc(-x / math.sqrt(2))) < 1e-14
    c = df.where("s = 0 AND z IS NOT NULL").select(normal_crps("z", F.lit(0.0), F.lit(1.0))).collect()
    for x, (v,) in zip(z, c):
        phi = math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        assert abs(v - (x * math.erf(x / math.sqrt(2)) + 2 * phi - 1 / math.sqrt(math.pi))) < 1e-12
    assert df.where("s < 0").select(normal_crps("z", F.lit(0.0), "s")).first()[0] is None


def test_smoothing_error_from_moments(spark):
    rng = np.random.default_rng(9)
    rows = [(int(s), *[float(v) if rng.random() < .7 else None for v in rng.normal(10, 3, 3)], float(rng.normal(10, 3)))
            for s in rng.integers(2000, 2004, 400)]
    df = spark.createDataFrame(rows, "season int, value_lag1 double, value_lag2 double, value_lag3 double, target double")
    got = {r["fold"]: r["alpha"] for r in closed.smoothing_params(df, F.lit(True)).collect()}
    assert sorted(got) == [2001, 2002, 2003]
    for fold, alpha in got.items():
        def error(a):
            w, total = [a, a * (1 - a), a * (1 - a) ** 2], 0.0
            for s, *lags, y in rows:
                have = [(v, x) for v, x in zip(lags, w) if v is not None]
                f = sum(v * x for v, x in have) / sum(x for _, x in have) if have else 0.0
                total += (f - y) ** 2 if s < fold else 0.0
            return total
        low, high = 0.05, 0.95
        grid = np.linspace(low, high, 181)
        best = min(grid, key=error)
        fine = min(np.linspace(max(low, best - .005), min(high, best + .005), 201), key=error)
        assert abs(alpha - fine) <= 1e-4


def test_passes_walk_few_trees_and_gather_own_rows(spark, rows, monkeypatch):
    """A pass works out the predictions of a few trees at most, however many there are."""
    asked = []
    level = boosting._level
    monkeypatch.setattr(boosting, "_level", lambda state, since, *more: asked.append(
        0 if since["value"] is None else since["value"].shape[1]) or level(state, since, *more))
    boosting.fit(rows, ["a", "b"], [boosting.Run(2004, 1)], "season", ["entity", "season"], trees=6)
    assert len(asked) == 6 and max(asked) <= 2
    bins = np.array([[0, 3], [2, 3], [2, 0]], np.uint8)
    feature, cut = np.array([[0, -1, 1, -1, -1, -1, -1]], np.int16), np.array([[1, 0, 1, 0, 0, 0, 0]], np.uint8)
    assert boosting._walk(bins, feature, cut, 2)[:, 0].tolist() == [1, 6, 5]
    assert boosting._packed(bins).to_pylist() == [r.tobytes() for r in bins]


def test_runs_alone_grow_what_passes_grow(spark, rows, monkeypatch):
    """Runs that each grow in a task, and runs that grow together some at a time, have the same trees."""
    runs = [boosting.Run(2002), boosting.Run(2004, 3, 0.3, 1.0), boosting.Run(2003), boosting.Run(2000), boosting.Run(2004, 1)]
    monkeypatch.setattr(boosting, "CHUNK", 50)

    def grown(bytes_in_task, tasks=128):
        monkeypatch.setattr(boosting, "IN_TASK", bytes_in_task)
        monkeypatch.setattr(boosting, "TASKS", tasks)
        return boosting.fit(rows, ["a", "b", "c"], runs, "season", ["entity", "season"], trees=4, columns=0.67)[0]

    monkeypatch.setattr(boosting, "TOGETHER", 2)
    passes = grown(-1)
    monkeypatch.setattr(boosting, "_passes", None)
    for alone in (grown(1 << 20), grown(1 << 20, 2)):
        assert np.array_equal(alone.feature, passes.feature) and np.array_equal(alone.cut, passes.cut)
        assert np.allclose(alone.value, passes.value) and np.allclose(alone.gain, passes.gain)
    bins = np.random.default_rng(1).integers(0, 40, (70, 3)).astype(np.uint8)
    one = boosting._sum_of_trees(bins, passes.feature, passes.cut, passes.value)
    each = sum(v[np.arange(5), boosting._walk(bins, f, c, 4)] for f, c, v in (
        (passes.feature[:, t], passes.cut[:, t], passes.value[:, t]) for t in range(4)))
    assert np.allclose(one, each)


def _asked(monkeypatch):
    """(runs, trees) of every forest that is fitted."""
    asked, fit = [], boosting.fit

    def noted(rows, features, runs, key, ids, target="target", trees=200, **options):
        asked.append((runs, trees))
        return fit(rows, features, runs, key, ids, target, trees, **options)

    monkeypatch.setattr(boosting, "fit", noted)
    return asked


def test_season_trees_do_the_whole_job(spark, rows, monkeypatch):
    """The registered query grows 200 trees for every season after the first."""
    from periodica.queries import QUERIES, models

    asked = _asked(monkeypatch)
    names = [c for c in models.LAGS if c not in ("career_season", "value_lag1")]
    frame = rows.selectExpr("*", "a AS value_lag1", "1 AS career_season", *[f"b AS {c}" for c in names])
    monkeypatch.setattr(models, "panel", lambda spark, sf: frame)
    got = QUERIES["boosted_trees"](spark, "").groupBy("season").count().collect()
    assert [(len(runs), trees) for runs, trees in asked] == [(len(SEASONS) - 1, 200)]
    assert {r["season"]: r["count"] for r in got} == {s: 90 for s in SEASONS[1:]}


def test_weekly_trees_do_the_whole_job(spark, monkeypatch):
    """The registered query grows 150 trees for every period after the first, each from all rows before it."""
    from periodica.operators import weekly as w
    from periodica.plans import weekly as pw
    from periodica.queries import QUERIES
    from periodica.queries import weekly

    asked = _asked(monkeypatch)
    rng = np.random.default_rng(8)
    keys = [(s, p) for s in (2000, 2001) for p in (1, 2, 3)]
    data = [(e, s, p, float(rng.normal(10, 2)), *rng.normal(size=len(w.FEATURES)).tolist()) for e in range(14) for s, p in keys]
    columns = ", ".join(f"{c} double" for c in w.FEATURES)
    frame = spark.createDataFrame(data, f"entity long, season int, period int, target double, {columns}")
    monkeypatch.setattr(weekly, "panel", lambda spark, sf: frame)
    got = {(r["entity"], r["season"], r["period"]): r["predicted"] for r in QUERIES["weekly_trees"](spark, "").collect()}
    folds = [(s << 32) + p for s, p in keys[1:]]
    assert [([r.fold for r in runs], trees) for runs, trees in asked] == [(folds, 150)]
    assert len(got) == 14 * 5
    one = pw.weekly_trees(frame, folds[2:4]).where("season = 2001 AND period = 1").collect()
    assert len(one) == 14 and all(abs(got[r["entity"], 2001, 1] - r["predicted"]) < 1e-3 for r in one)
