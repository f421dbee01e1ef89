"""Ridge regression for all folds from one pass of cross-product sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def design(df: DataFrame, features: list[str], codes: list[int]) -> tuple[DataFrame, list[str]]:
    """Vector column ``x``: zero-filled features and one 0/1 column per code after the first."""
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]
    dummies = [F.when(F.col("grp_code") == c, 1.0).otherwise(0.0) for c in codes[1:]]
    names = [*features, *[f"grp_code_{c}" for c in codes[1:]]]
    return df.withColumn("x", F.array(*values, *dummies)), names


def moments(rows: DataFrame, fold: str, target: str = "target") -> dict[int, np.ndarray]:
    """Per fold key the matrix sum of [1, x, y] outer products.

    Every task adds up its own rows, the shuffle carries one matrix per task and key, and the
    driver receives one matrix per key.
    """
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            x = np.column_stack([np.ones(len(b)), np.stack(b["x"].to_numpy()), b["y"].to_numpy()])
            for k in b["k"].unique():
                part = x[(b["k"] == k).to_numpy()]
                sums[int(k)] = sums.get(int(k), 0) + part.T @ part
        for k, m in sums.items():
            yield pd.DataFrame({"k": k, "i": np.arange(m.size), "v": m.ravel()})

    thin = rows.select(F.col(fold).cast("bigint").alias("k"), "x", F.col(target).cast("double").alias("y"))
    return _matrices(thin.where("y IS NOT NULL").mapInPandas(partial, "k bigint, i int, v double"))


def dealt_moments(rows: DataFrame, targets: str = "_dealt") -> dict[int, np.ndarray]:
    """What ``moments`` gives for each place of an array of targets, from one scan of the rows."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = 0
        for b in batches:
            x = np.column_stack([np.ones(len(b)), np.stack(b["x"].to_numpy())])
            y = np.stack(b["y"].to_numpy()).astype(float)
            known = ~np.isnan(y)
            y = np.where(known, y, 0.0)
            part = np.zeros((y.shape[1], x.shape[1] + 1, x.shape[1] + 1))
            part[:, :-1, :-1] = x.T @ x
            for k in np.flatnonzero(~known.all(axis=0)):
                part[k, :-1, :-1] = x[known[:, k]].T @ x[known[:, k]]
            part[:, :-1, -1] = part[:, -1, :-1] = (x.T @ y).T
            part[:, -1, -1] = (y * y).sum(axis=0)
            sums = sums + part
        for k, m in enumerate(sums if isinstance(sums, np.ndarray) else ()):
            yield pd.DataFrame({"k": k, "i": np.arange(m.size), "v": m.ravel()})

    flat = rows.select("x", F.col(targets).alias("y")).mapInPandas(partial, "k bigint, i int, v double")
    return _matrices(flat)


def _matrices(flat: DataFrame) -> dict[int, np.ndarray]:
    got = flat.groupBy("k", "i").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for k, g in got.groupby("k"):
        v = g.sort_values("i")["v"].to_numpy()
        n = int(round(len(v) ** 0.5))
        out[int(k)] = v.reshape(n, n)
    return out


def solve(m: np.ndarray, alpha: float) -> dict:
    """Ridge on population-standardised columns; returns coefficients in original units too."""
    n, p = m[0, 0], m.shape[0] - 2
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov)[:p], 0, None))
    sd = np.where(sd < 1e-10 * (1 + np.abs(mean[:p])), 1.0, sd)
    c = n * cov[:p, :p] / np.outer(sd, sd)
    beta = np.linalg.solve(c + alpha * np.eye(p), n * cov[:p, p] / sd)
    raw = beta / sd
    return {"n": int(n), "beta": beta, "coef": raw, "intercept": mean[p] - raw @ mean[:p],
            "mean": mean[:p], "sd": sd, "my": mean[p], "cov": cov}


def fold_fits(m: dict[int, np.ndarray], alpha: float, min_rows: int = 1) -> dict[int, dict]:
    """Fit of every fold on all keys before it, from running sums."""
    fits, total = {}, None
    for k in sorted(m):
        if total is not None and total[0, 0] >= min_rows:
            fits[k] = solve(total, alpha)
        total = m[k] if total is None else total + m[k]
    return fits


def fit_table(spark, fits: dict[int, dict]) -> DataFrame:
    rows = [(k, float(f["intercept"]), [float(c) for c in f["coef"]]) for k, f in fits.items()]
    return spark.createDataFrame(rows, "fold bigint, intercept double, coef array<double>")


def predict(rows: DataFrame, fits: DataFrame, fold: str, out: str) -> DataFrame:
    """Forecast of each row by its fold's fit, never below zero."""
    dot = F.aggregate(F.zip_with("coef", "x", lambda a, b: a * b), F.col("intercept"), lambda s, v: s + v)
    return (
        rows.join(fits, rows[fold].cast("bigint") == fits["fold"], "left")
        .withColumn(out, F.when(F.col("coef").isNotNull(), F.greatest(F.lit(0.0), dot))).drop("coef", "intercept", "fold")
    )


def cross_validated_alpha(m: dict[int, np.ndarray], rows: DataFrame, fold: str,
                          alphas: tuple[float, ...] = (0.1, 1.0, 10.0, 50.0, 200.0),
                          min_train: int = 2, target: str = "target") -> tuple[float, dict[float, float]]:
    """Grid search by MAE over nested forward-chaining folds, from the same moments."""
    keys = sorted(m)[min_train:]
    if len(keys) < 2:
        return 10.0, {}
    held = rows.where(F.col(fold).isin(keys) & F.col(target).isNotNull())
    for i, a in enumerate(alphas):
        fits = {k: f for k, f in fold_fits(m, a).items() if k in keys}
        held = predict(held, fit_table(rows.sparkSession, fits), fold, f"_p{i}")
    err = [F.avg(F.abs(F.col(f"_p{i}") - F.col(target))).alias(f"e{i}") for i in range(len(alphas))]
    # mean over folds of the fold's error
    per = held.groupBy(fold).agg(*err).agg(*[F.avg(f"e{i}").alias(f"e{i}") for i in range(len(alphas))])
    scores = dict(zip(alphas, per.first()))
    return min(scores, key=lambda a: (scores[a], a)), scores
