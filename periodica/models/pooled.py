"""Partially pooled regression: group intercepts and slopes shrunk to shared means (MAP)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import small_join

# Priors. alpha mean N(150, 60), spread half-normal 30; beta mean N(0.75, 0.15),
# spread half-normal 0.15; gamma N(0, 5); residual half-normal 60.
A_MU, A_MU_SD, A_SD = 150.0, 60.0, 30.0
B_MU, B_MU_SD, B_SD = 0.75, 0.15, 0.15
G_SD, S_SD = 5.0, 60.0


def season_sums(rows: DataFrame, target: str = "target") -> dict[int, dict[int, np.ndarray]]:
    """Per season and group code the sums of products of [1, lag 1, per-game lag 1, target], from one scan."""
    v = [F.lit(1.0), F.coalesce("value_lag1", F.lit(0.0)), F.coalesce("ppg_lag1", F.lit(0.0)),
         F.col(target).cast("double")]
    aggs = [F.sum(v[i] * v[j]).alias(f"s{i}{j}") for i in range(4) for j in range(i, 4)]
    known = rows.where(F.col(target).isNotNull() & F.col("grp_code").isNotNull())
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in known.groupBy("season", "grp_code").agg(*aggs).collect():  # one row per season and group
        m = np.array([r[f"s{min(i, j)}{max(i, j)}"] for i in range(4) for j in range(4)]).reshape(4, 4)
        out.setdefault(r["season"], {})[r["grp_code"]] = m
    return out


def group_sums(train: DataFrame) -> dict[int, np.ndarray]:
    """Per group code the sums over all seasons; rows need no season."""
    return season_sums(train.withColumn("season", F.lit(0))).get(0, {})


def fit(sums: dict[int, np.ndarray], rounds: int = 500) -> dict:
    """Alternate the linear solve with closed-form spread updates until nothing moves."""
    codes = sorted(sums)
    total = sum(sums.values())
    n, center = total[0, 0], total[0, 1] / total[0, 0]
    shift = np.eye(4)
    shift[0, 1] = -center
    s = {c: shift.T @ m @ shift for c, m in sums.items()}
    g, p = len(codes), 2 * len(codes) + 3  # offsets a_g, b_g, then mu_a, mu_b, gamma
    sa, sb, sig = A_SD, B_SD, S_SD
    theta = np.zeros(p)
    for _ in range(rounds):
        lhs, rhs, yy = np.zeros((p, p)), np.zeros(p), 0.0
        for i, c in enumerate(codes):
            z = np.zeros((3, p))
            z[0, [i, p - 3]] = 1
            z[1, [g + i, p - 2]] = 1
            z[2, p - 1] = 1
            lhs += z.T @ s[c][:3, :3] @ z
            rhs += z.T @ s[c][:3, 3]
            yy += s[c][3, 3]
        prior = np.r_[np.full(g, 1 / max(sa, 1e-6) ** 2), np.full(g, 1 / max(sb, 1e-6) ** 2),
                      1 / A_MU_SD**2, 1 / B_MU_SD**2, 1 / G_SD**2]
        mean = np.zeros(p)
        mean[p - 3], mean[p - 2] = A_MU, B_MU
        new = np.linalg.solve(lhs / sig**2 + np.diag(prior), rhs / sig**2 + prior * mean)
        rss = max(yy - 2 * new @ rhs + new @ lhs @ new, 1e-9)
        sa = (A_SD * np.sqrt((new[:g] ** 2).sum())) ** 0.5
        sb = (B_SD * np.sqrt((new[g:2 * g] ** 2).sum())) ** 0.5
        sig = float(np.sqrt((-n + np.sqrt(n * n + 4 * rss / S_SD**2)) * S_SD**2 / 2))
        done = np.abs(new - theta).max() < 1e-9
        theta = new
        if done:
            break
    return {"codes": codes, "alpha": theta[:g] + theta[p - 3], "beta": theta[g:2 * g] + theta[p - 2],
            "gamma": float(theta[p - 1]), "sigma": sig, "center": float(center)}


def params_table(spark, fitted: dict) -> DataFrame:
    rows = [(int(c), float(a), float(b)) for c, a, b in
            zip(fitted["codes"], fitted["alpha"], fitted["beta"])]
    return spark.createDataFrame(rows, "grp_code int, alpha double, beta double")


def predict(rows: DataFrame, fitted: dict, out: str = "predicted") -> DataFrame:
    """Forecast and its constant predictive spread; an unseen group takes the first one's line."""
    p = params_table(rows.sparkSession, fitted)
    first = (float(fitted["alpha"][0]), float(fitted["beta"][0]))
    line = (F.coalesce("alpha", F.lit(first[0]))
            + F.coalesce("beta", F.lit(first[1])) * (F.coalesce("value_lag1", F.lit(0.0)) - fitted["center"])
            + fitted["gamma"] * F.coalesce("ppg_lag1", F.lit(0.0)))
    return rows.join(p, "grp_code", "left").withColumns({
        out: F.greatest(F.lit(0.0), line), "distribution_sd": F.lit(fitted["sigma"])}).drop("alpha", "beta")


def forecasts(rows: DataFrame, target: str = "target", out: str = "f_partial_pooling") -> DataFrame:
    """Forecast and spread of every season from the seasons before it; null for the first.

    Sums are carried on over the seasons, so all folds cost one scan; their lines are one small table.
    """
    sums, past, lines = season_sums(rows, target), {}, []
    for season in sorted(r[0] for r in rows.select("season").distinct().collect()):
        if past:
            f = fit(past)
            by_code = {int(c): (float(a), float(b)) for c, a, b in zip(f["codes"], f["alpha"], f["beta"], strict=True)}
            lines.append((season, f["center"], f["gamma"], f["sigma"], by_code, by_code[int(f["codes"][0])]))
        for c, m in sums.get(season, {}).items():
            past[c] = past.get(c, 0) + m
    line = "struct<alpha:double, beta:double>"
    table = rows.sparkSession.createDataFrame(lines, (
        f"season int, _center double, _gamma double, distribution_sd double, _lines map<int, {line}>, _first {line}"))
    own = F.coalesce(F.try_element_at("_lines", F.col("grp_code")), "_first")
    lag1, ppg = (F.coalesce(c, F.lit(0.0)) for c in ("value_lag1", "ppg_lag1"))
    value = own["alpha"] + own["beta"] * (lag1 - F.col("_center")) + F.col("_gamma") * ppg
    got = F.when(F.col("_first").isNotNull(), F.greatest(F.lit(0.0), value))
    return small_join(rows, table, ["season"]).withColumn(out, got).drop("_center", "_gamma", "_lines", "_first")
