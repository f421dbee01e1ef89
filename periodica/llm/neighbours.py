"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample is cut into balanced parts by recursive spectral bisection with swaps.
A small network learns to tell a vector's part, with its neighbours' parts as soft labels. Every row goes to its
most probable part; a query visits the most probable parts, as many as sample vectors kept out of the fit needed for
their recall and at least as many as hold k others, and the rows met there are ranked by exact inner products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.records import stage
from .shipping import ship

#: Most vectors that the fit sees, the first by a hash of their id.
SAMPLE = 4_096


@dataclass
class Router:
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray
    probes: int

    def chances(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.first + self.first_bias, 0) @ self.second + self.second_bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _nearest(queries: np.ndarray, x: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    out = []
    for a in range(0, len(queries), 512):
        s = queries[a: a + 512] @ x.T
        if own is not None:
            s[np.arange(len(s)), own[a: a + 512]] = -np.inf
        out.append(np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k])
    return np.concatenate(out)


def _bisect(members: np.ndarray, near: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of equal size with few neighbour links between them."""
    place = np.full(near.shape[0], -1)
    place[members] = np.arange(len(members))
    links = place[near[members]]
    rows, cols = np.repeat(np.arange(len(members)), links.shape[1]), links.ravel()
    rows, cols = rows[cols >= 0], cols[cols >= 0]
    a, b = np.concatenate([rows, cols]), np.concatenate([cols, rows])
    degree = np.bincount(a, minlength=len(members)) + 1e-9
    v = rng.standard_normal(len(members))
    for _ in range(60):  # towards the second eigenvector of the random walk
        v = v + np.bincount(a, v[b], len(members)) / degree
        v -= (v * degree).sum() / degree.sum()
        v /= np.linalg.norm(v) + 1e-12
    side = np.zeros(len(members), bool)
    side[np.argsort(v, kind="stable")[len(members) // 2:]] = True
    for _ in range(8):  # swap the pairs that gain most
        across = np.bincount(a, side[a] != side[b], len(members))
        gain = 2 * across - np.bincount(a, minlength=len(members))
        one, two = (np.flatnonzero(side == s) for s in (False, True))
        one, two = one[np.argsort(-gain[one], kind="stable")], two[np.argsort(-gain[two], kind="stable")]
        n = min(len(one), len(two), max(1, len(members) // 50))
        good = gain[one[:n]] + gain[two[:n]] > 2
        if not good.any():
            break
        side[one[:n][good]], side[two[:n][good]] = True, False
    return members[~side], members[side]


def parts_of(near: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """Balanced part of every vertex; ``parts`` is a power of two."""
    rng, groups = np.random.default_rng(seed), [np.arange(len(near))]
    while len(groups) < parts:
        groups = [h for g in groups for h in _bisect(g, near, rng)]
    out = np.zeros(len(near), np.int64)
    for p, g in enumerate(groups):
        out[g] = p
    return out


def fit(x: np.ndarray, parts: int, k: int, recall: float = 0.95, hidden: int = 128, epochs: int = 40,
        seed: int = 3) -> Router:
    """Learn parts and router from three quarters of the sample vectors (in no order).

    probes: least number whose rows hold ``recall`` of the nearest among the other quarter, for which k shrinks as
    their number does, so that neighbours are as far away as in the sample.
    """
    share = k / len(x)
    x, kept_out = x[: -(len(x) // 4)], x[-(len(x) // 4):]
    rng, n = np.random.default_rng(seed), len(x)
    near = _nearest(x, x, min(k, n - 1), np.arange(n))
    part = parts_of(near, parts, seed)
    soft = np.full((n, parts), 1e-3)
    np.add.at(soft, (np.repeat(np.arange(n), near.shape[1]), part[near].ravel()), 1.0)
    soft[np.arange(n), part] += near.shape[1]
    soft /= soft.sum(axis=1, keepdims=True)
    d = x.shape[1]
    w = [rng.standard_normal((d, hidden)) * (2 / d) ** 0.5 / (np.abs(x).mean() * d ** 0.5 + 1e-12), np.zeros(hidden),
         rng.standard_normal((hidden, parts)) * hidden ** -0.5, np.zeros(parts)]
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, 128):
            i = order[a: a + 128]
            h = np.maximum(x[i] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = (e / e.sum(axis=1, keepdims=True) - soft[i]) / len(i)
            gh = (g @ w[2].T) * (h > 0)
            grads, t = [x[i].T @ gh, gh.sum(0), h.T @ g, g.sum(0)], t + 1
            for j, q in enumerate(grads):
                m[j], v[j] = 0.9 * m[j] + 0.1 * q, 0.999 * v[j] + 0.001 * q * q
                w[j] -= 3e-3 * (m[j] / (1 - 0.9 ** t)) / (np.sqrt(v[j] / (1 - 0.999 ** t)) + 1e-8)
    router = Router(*w, probes=parts)
    n = len(kept_out)
    near = _nearest(kept_out, kept_out, max(1, min(round(share * n), n - 1)), np.arange(n))
    chances = router.chances(kept_out)
    placed, rank = chances.argmax(axis=1), np.argsort(np.argsort(-chances, axis=1), axis=1)
    needed = rank[np.arange(n)[:, None], placed[near]].ravel()
    router.probes = int(np.quantile(needed, recall, method="higher")) + 1
    return router


def usable(rows: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector is there, not all zero, and free of null and non-finite components."""
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).where(~bad & F.exists(vec, lambda v: v != 0))


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def nearest(rows: DataFrame, vec: str = "embedding", key: str = "vec_id", every: int = 20, k: int = 20,
            sample: int = SAMPLE, per_part: int = 4_000, block: int = 8_192, lot: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each query.

    Queries are rows whose key ``every`` divides; candidates all rows but the query's own. Vectors that are null,
    zero or hold null or non-finite numbers take no part, nor do rows with a null key or of another length than
    the sample's most frequent one. Every query gets k rows if there are so many others. Repeated keys are rows of their own; ties go to the smaller key; other
    columns are ignored. The number of parts is a power of two near rows / ``per_part``, bounded by the sample.
    """
    spark = rows.sparkSession
    ship(spark)
    plain = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vec}`").cast("array<double>").alias("v"))
    good = stage(usable(plain.where("id IS NOT NULL"), "v").withColumn("row", F.monotonically_increasing_id()))
    lengths = {r["d"]: r["count"] for r in good.groupBy(F.size("v").alias("d")).count().orderBy(
        F.desc("count"), "d").limit(1).collect()}
    if not lengths:
        return good.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"),
                           F.lit(0.0).alias("score")).limit(0)
    d, n = next(iter(lengths.items()))
    good = good.where(F.size("v") == d)
    seen = good.select("v", F.xxhash64("id").alias("h"), "id", "row").orderBy("h", "id", "row").limit(sample).toPandas()
    most = min(n // per_part, max(1, len(seen) // 16))
    parts = 1 << max(3, int(most).bit_length() - 1) if len(seen) >= 64 else 1
    router = fit(_matrix(seen["v"]), parts, k) if parts > 1 else None
    probes = router.probes if router else 1
    model = spark.sparkContext.broadcast(router)

    def route(frames):
        for f in frames:
            if model.value is None:
                best = np.zeros((len(f), 1), np.int64)
            else:
                chances = model.value.chances(_matrix(f["v"])) if len(f) else np.zeros((0, parts))
                best = np.argsort(-chances, axis=1, kind="stable")
            # only queries need the order of the parts
            visits = [b if i % every == 0 else b[:0] for i, b in zip(f["id"], best.astype(np.int32), strict=True)]
            yield f.assign(part=best[:, 0].astype(np.int32), visits=visits)

    routed = stage(good.mapInPandas(route, "id long, v array<double>, row long, part int, visits array<int>"))
    # each part is cut into blocks of about `block` rows, so a task never holds more
    counts = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
    sizes = {p: -(-c // block) for p, c in counts.items()}
    blocks = F.element_at(F.create_map(*[F.lit(x) for p, b in sizes.items() for x in (p, b)]), F.col("part"))
    spread = F.pmod(F.xxhash64("row"), blocks).cast("int")
    held = routed.select("id", "row", "v", "part", spread.alias("cell"))
    # a query goes on to the next parts until those visited hold k rows besides its own
    rows_of = F.array(*[F.lit(counts.get(p, 0)).cast("long") for p in range(parts)])
    none = F.struct(F.lit(0).cast("long").alias("rows"), F.lit(0).alias("parts"))
    enough = F.aggregate("visits", none, lambda a, p: F.when(a["rows"] > k, a).otherwise(F.struct(
        (a["rows"] + F.get(rows_of, p)).alias("rows"), (a["parts"] + 1).alias("parts"))))["parts"]
    asks = routed.where(F.col("id") % every == 0).withColumn(
        "visits", F.slice("visits", F.lit(1), F.greatest(F.lit(probes), enough)))
    lots = max(1, -(-asks.count() // lot))
    asks = asks.select(F.col("id").alias("q"), F.col("row").alias("q_row"), F.col("v").alias("q_v"),
                       F.pmod(F.xxhash64("row"), F.lit(lots)).cast("int").alias("lot"), F.explode("visits").alias("part"))
    asks = asks.where(F.col("part").isin(list(sizes))).withColumn("cell", F.explode(F.sequence(F.lit(0), blocks - 1)))
    # candidates go once to every lot of queries, a fixed share of them at a time
    held = held.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))

    def meet(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(there):
            x, ids, row = _matrix(there["v"]), there["id"].to_numpy(), there["row"].to_numpy()
            scores = _matrix(asked["q_v"]) @ x.T
            scores[asked["q_row"].to_numpy()[:, None] == row[None, :]] = -np.inf
            for q, q_row, s in zip(asked["q"], asked["q_row"], scores, strict=True):
                top = np.lexsort((row, ids, -s))[:k]
                top = top[np.isfinite(s[top])]
                out.append(pd.DataFrame({"q": q, "q_row": q_row, "id": ids[top], "row": row[top], "score": s[top]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "q_row": [], "id": [], "row": [], "score": []})

    on = ["part", "cell", "lot"]
    found = asks.groupBy(*on).cogroup(held.groupBy(*on)).applyInPandas(
        meet, "q long, q_row long, id long, row long, score double")
    rank = F.row_number().over(W.partitionBy("q_row").orderBy(F.desc("score"), "id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
