"""Gradient boosted trees for every walk-forward fold and grid point in the same passes.

Features are binned once. A run is one fold (it learns from rows with a smaller key) at one grid point. Runs whose binned
rows fit a task grow there by themselves, side by side: a task reads its fold's rows once, nothing is shuffled and only
trees leave it. The others, and a run that is the only one, grow together, one level of one tree in a pass: tasks add
gradients and counts by (run, node, feature, bin), the shuffle adds these up, and the best split of each node, a few
numbers, goes to the driver. Rows are never grouped by run, so a pass costs one scan of the binned rows, and what is
shuffled does not depend on the number of rows.

Squared error with second-order weights: a leaf says ``-G / (H + penalty)`` times the rate, a split's gain is the sum of
``G^2 / (H + penalty)`` of its sides less that of the node. Every run begins from the mean of its training targets.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.records import settings, stage, unstage
from ..functions.shipping import ship

#: The grid that is searched.
GRID = {"depth": (3, 4, 6), "rate": (0.03, 0.05, 0.1), "penalty": (1.0, 5.0, 15.0)}
#: Trees after which rows get their predictions written; until then they are worked out anew in each pass.
STAGE_EVERY = 2
#: Bytes of binned rows that a task may hold to grow runs alone, and rows that it counts at a time.
IN_TASK, CHUNK = 1 << 28, 1 << 16
#: Runs that share passes (their predictions are written with every row), and tasks that grow runs alone.
TOGETHER, TASKS = 16, 128
_SPLITS = "run int, node int, feature int, cut int, gain double, g double, h double, gl double, hl double"
_FOUND = [c.split()[0] for c in _SPLITS.split(", ")]


@dataclass(frozen=True)
class Run:
    """Learns from rows whose key is below ``fold``."""

    fold: int
    depth: int = 4
    rate: float = 0.05
    penalty: float = 5.0


def grid_runs(folds: list[int]) -> list[Run]:
    """Every fold at every point of the grid."""
    return [Run(k, *point) for k in folds for point in product(*GRID.values())]


@dataclass
class Forest:
    """Trees of all runs: per run, tree and node (children of i at 2i + 1 and 2i + 2) feature, last bin of the left
    side and value; no feature (-1) is a leaf. ``edges`` are each feature's upper bin bounds."""

    features: list[str]
    edges: list[np.ndarray]
    runs: list[Run]
    start: np.ndarray
    feature: np.ndarray = field(default=None)
    cut: np.ndarray = field(default=None)
    value: np.ndarray = field(default=None)
    gain: np.ndarray = field(default=None)

    @property
    def trees(self) -> int:
        return 0 if self.feature is None else self.feature.shape[1]


def _walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, steps: int) -> np.ndarray:
    """Node (rows x runs) that rows reach in one tree of each run."""
    out = np.empty((len(bins), len(feature)), np.int64)
    flat = np.ascontiguousarray(bins).reshape(-1)
    for r in range(len(feature)):
        out[:, r] = _walk_one(flat, bins.shape, feature[r], cut[r], steps)
    return out


def _walk_one(flat: np.ndarray, shape: tuple[int, int], feature: np.ndarray, cut: np.ndarray, steps: int) -> np.ndarray:
    """Node that rows (their bins one after the other) reach in one run's tree."""
    node = np.zeros(shape[0], np.int64)
    if not steps or feature[0] < 0:
        return node
    rows, column = np.arange(shape[0]) * shape[1], feature.astype(np.int64)
    # a leaf passes its rows on to itself
    leaf, own = column < 0, np.arange(len(column))
    left, column = np.where(leaf, own, 2 * own + 1), np.maximum(column, 0)
    bound = np.where(leaf, 255, cut).astype(np.uint8)
    for _ in range(steps):
        node = left[node] + (flat[rows + column[node]] > bound[node])
    return node


def _sum_of_trees(bins: np.ndarray, feature, cut, value) -> np.ndarray:
    """Sum of values over trees (run x tree x node arrays), rows x runs; few rows walk many trees at once."""
    depth, trees = int(np.log2(feature.shape[2] + 1)) - 1, feature.shape[1]
    out = np.zeros((len(bins), feature.shape[0]))
    flat = np.ascontiguousarray(bins).reshape(-1)
    at_once = max(1, CHUNK // max(len(bins), 1))
    for r in range(feature.shape[0]):
        for t in range(0, trees, at_once):
            if at_once == 1:
                out[:, r] += value[r, t][_walk_one(flat, bins.shape, feature[r, t], cut[r, t], depth)]
                continue
            said = _walk_many(flat, bins.shape, feature[r, t: t + at_once], cut[r, t: t + at_once],
                              value[r, t: t + at_once], depth)
            for one in said:
                out[:, r] += one
    return out


def _walk_many(flat: np.ndarray, shape: tuple[int, int], feature: np.ndarray, cut: np.ndarray, value: np.ndarray,
               steps: int) -> np.ndarray:
    """Values (trees x rows) of the nodes that rows reach in several trees of a run."""
    trees, nodes = feature.shape
    if not shape[1]:
        return np.repeat(value[:, :1], shape[0], axis=1)
    base, rows = (np.arange(trees) * nodes)[:, None], np.arange(shape[0]) * shape[1]
    column, own = feature.astype(np.int64).ravel(), np.arange(trees * nodes)
    leaf = column < 0
    left = np.where(leaf, own, base.repeat(nodes, 1).ravel() + 2 * (own % nodes) + 1)
    column, bound = np.maximum(column, 0), np.where(leaf, 255, cut.ravel()).astype(np.uint8)
    node = np.repeat(base, shape[0], axis=1)
    for _ in range(steps):
        node = left[node] + (flat[rows + column[node]] > bound[node])
    return value.ravel()[node]


def in_sample(ids: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Whether rows belong to a tree's sample, by their id."""
    h = ids.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return (h >> np.uint64(11)) < np.uint64(share * (1 << 53))


def columns_of(tree: int, n: int, share: float, seed: int) -> np.ndarray:
    """Features that a tree may split on."""
    rng = np.random.default_rng([seed, tree])
    return np.sort(rng.choice(n, max(1, round(share * n)), replace=False))


def best_split(hist: np.ndarray, penalty: float, allowed: np.ndarray, least: float = 1.0) -> tuple:
    """(feature, cut, gain, G, H, left G, left H) from gradients and counts (feature x bin x 2); -1 if none gains."""
    total = hist[0].sum(axis=0)
    left = hist.cumsum(axis=1)[:, :-1]
    right = total - left
    own = total[0] ** 2 / (total[1] + penalty)
    gain = left[..., 0] ** 2 / (left[..., 1] + penalty) + right[..., 0] ** 2 / (right[..., 1] + penalty) - own
    ok = (left[..., 1] >= least) & (right[..., 1] >= least)
    ok[np.setdiff1d(np.arange(len(hist)), allowed)] = False
    # rounded so that equal gains do not hinge on the order of addition
    gain = np.where(ok, np.round(gain, 6), -np.inf)
    f, c = np.unravel_index(int(gain.argmax()), gain.shape)
    if not gain[f, c] > 0:
        return -1, 0, 0.0, total[0], total[1], 0.0, 0.0
    return int(f), int(c), float(gain[f, c]), total[0], total[1], left[f, c, 0], left[f, c, 1]


def _edges(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Up to bins - 1 upper bounds per feature: values at even places, as near as one ten-thousandth of the rows."""
    at = [(i + 1) / bins for i in range(bins - 1)]
    got = rows.agg(*[F.percentile_approx(c, at, 10_000).alias(f"_{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.array(q if q is not None else [0.0])) for q in got]


def _binned(batch: pa.RecordBatch, edges: list[np.ndarray]) -> np.ndarray:
    cols = [np.searchsorted(e, batch.column(i).to_numpy(zero_copy_only=False), "left") for i, e in enumerate(edges)]
    return np.stack(cols, axis=1).astype(np.uint8) if cols else np.zeros((batch.num_rows, 0), np.uint8)


def _plain(rows: DataFrame, features: list[str], *more) -> DataFrame:
    return rows.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(features)],
                       *more)


def _base_of(batch: pa.RecordBatch, width: int):
    """Key, id, bins and target of rows."""
    def numbers(i):
        return batch.column(i).to_numpy(zero_copy_only=False)

    n, packed = batch.num_rows, batch.column(2)
    # the bytes of all rows lie one after the other
    at = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset] if n and width else 0
    data = np.frombuffer(packed.buffers()[2], np.uint8) if n and width else np.zeros(0, np.uint8)
    bins = data[at: at + n * width].reshape(n, width)
    return numbers(0), numbers(1), bins, numbers(3)


def _read(batch: pa.RecordBatch, width: int, runs: int):
    pred = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, runs)
    return *_base_of(batch, width), pred


def fit(rows: DataFrame, features: list[str], runs: list[Run], key: str, ids: list[str], target: str = "target",
        trees: int = 200, share: float = 0.8, columns: float = 0.8, bins: int = 64, seed: int = 42,
        ) -> tuple[Forest, DataFrame]:
    """(forest, training rows with their predictions: key, id, bins, y, pred by run).

    Missing features count as 0, rows without a target are left out, runs without rows say 0. ``ids`` must tell rows
    apart: they decide which tree sees a row.
    """
    ship(rows.sparkSession)
    thin = stage(_plain(
        rows.where(F.col(target).isNotNull()), features, F.col(key).cast("long").alias("key"),
        F.xxhash64(*ids).alias("id"), F.col(target).cast("double").alias("y")))
    per_key = {r["key"]: (r["n"], r["y"]) for r in thin.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("y").alias("y")).collect()}
    start = np.zeros(len(runs))
    for i, run in enumerate(runs):
        past = [v for k, v in per_key.items() if k < run.fold]
        if past:
            start[i] = sum(y for _, y in past) / sum(n for n, _ in past)
    edges = _edges(thin, [f"_x{i}" for i in range(len(features))], bins)
    forest = Forest(features, edges, runs, start)
    folds, width, n_runs = np.array([r.fold for r in runs]), len(features), len(runs)

    def binned(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(width), b.column(width + 1), _packed(_binned(b, edges)), b.column(width + 2)],
                ["key", "id", "bins", "y"])

    base = stage(thin.mapInArrow(binned, _BASE))
    unstage(thin)
    if not width or not per_key:
        return replace(forest, **_none(n_runs, trees)), _begun(base, start)
    nodes, sizes = (1 << (max(r.depth for r in runs) + 1)) - 1, [len(e) + 1 for e in edges]
    whole = {n: np.zeros((n_runs, trees, nodes), kind) for n, kind in _KINDS.items()}
    whole["feature"][:] = -1
    before = [sum(n for k, (n, _) in per_key.items() if k < f) for f in folds]
    alone = [i for i, n in enumerate(before) if n * (width + _HELD) <= IN_TASK]
    alone = alone if len(alone) > 1 else []
    together = [i for i in range(n_runs) if i not in set(alone)]
    for i, part in _alone(base, alone, runs, before, start, width, sizes, trees, nodes, share, columns, seed).items():
        for n in whole:
            whole[n][i] = part[n]
    for at in range(0, len(together), TOGETHER):
        some = together[at: at + TOGETHER]
        part = _passes(base, [runs[i] for i in some], start[some], width, sizes, trees, nodes, share, columns, seed)
        for n in whole:
            whole[n][some] = part[n]
    return replace(forest, **whole), _advanced(_begun(base, start), whole, width)


_BASE = "key long, id long, bins binary, y double"
_KINDS = {"feature": np.int16, "cut": np.uint8, "value": np.float64, "gain": np.float64}
#: Bytes of a row that is held in a task, besides its bins: key, id, target, gradient, node and sample.
_HELD = 34


def _begun(base: DataFrame, start: np.ndarray) -> DataFrame:
    """Binned rows with the predictions that runs begin from."""
    def work(batches):
        for b in batches:
            pred = np.repeat(start[None, :], b.num_rows, axis=0)
            yield pa.RecordBatch.from_arrays([*b.columns, _listed(pred)], [*b.schema.names, "pred"])

    return base.mapInArrow(work, _BASE + ", pred array<double>")


def _blank(runs: int, nodes: int) -> dict[str, np.ndarray]:
    now = {n: np.zeros((runs, nodes), kind) for n, kind in _KINDS.items()}
    now["feature"][:] = -1
    return now


def _note(now: dict[str, np.ndarray], found: list, runs: list[Run], level: int) -> np.ndarray:
    """Put a level's splits into the trees; which nodes (run x node) of the next level may split."""
    first = (1 << level) - 1
    more = np.zeros((len(runs), 2 << level), bool)
    for r in found:
        run, i, at = runs[r["run"]], r["run"], first + r["node"]
        if r["feature"] < 0:
            if level == 0:
                now["value"][i, 0] = -run.rate * r["g"] / (r["h"] + run.penalty)
            continue
        now["feature"][i, at], now["cut"][i, at], now["gain"][i, at] = r["feature"], r["cut"], r["gain"]
        for child, g, h in ((2 * at + 1, r["gl"], r["hl"]), (2 * at + 2, r["g"] - r["gl"], r["h"] - r["hl"])):
            now["value"][i, child] = -run.rate * g / (h + run.penalty)
        if level + 1 < run.depth:
            more[i, 2 * r["node"]: 2 * r["node"] + 2] = True
    return more


def _passes(base, runs, start, width, sizes, trees, nodes, share, columns, seed) -> dict[str, np.ndarray]:
    """Trees (run x tree x node) of runs that grow together, a level in a pass."""
    folds, state, written = np.array([r.fold for r in runs]), _begun(base, start), None
    parts: dict[str, list] = {n: [] for n in _KINDS}
    done = 0
    for tree in range(trees):
        now = _blank(len(runs), nodes)
        allowed = columns_of(tree, width, columns, seed)
        since = {n: np.stack(x[done:], axis=1) if x[done:] else None for n, x in parts.items()}
        grows = np.ones((len(runs), 1), bool)
        for level in range(max(r.depth for r in runs)):
            if not grows.any():
                break
            found = _level(state, since, now, level, folds, width, sizes, tree, share, seed, runs, allowed)
            grows = _note(now, found, runs, level)
        for n, x in parts.items():
            x.append(now[n])
        if len(parts["value"]) - done == STAGE_EVERY and tree + 1 < trees:
            state = stage(_advanced(state, {n: np.stack(x[done:], axis=1) for n, x in parts.items()}, width))
            if written is not None:
                unstage(written)
            written, done = state, len(parts["value"])
    if written is not None:
        unstage(written)
    return {n: np.stack(x, axis=1) if x else _none(len(runs), 0)[n] for n, x in parts.items()}


def _alone(base, which, runs, before, start, width, sizes, trees, nodes, share, columns, seed) -> dict[int, dict[str, np.ndarray]]:
    """Trees (tree x node) of runs that grow each in one task, which reads the rows of its fold."""
    if not which:
        return {}
    # the longest ones first; neighbours in this order have folds close to each other
    which = sorted(which, key=lambda i: (-runs[i].fold, i))
    size = -(-len(which) // TASKS)
    tasks = [which[i: i + size] for i in range(0, len(which), size)]

    def task(some):
        def work(batches):
            ids, y, bins = _held(batches, max(before[i] for i in some), width)
            for i in some:
                n = before[i]
                made = _forest_of(bins[:, :n], ids[:n], start[i] - y[:n], runs[i], sizes, trees, nodes, share, columns, seed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), *[pa.array([made[n].tobytes()], pa.binary()) for n in _KINDS]], ["run", *_KINDS])

        rows = base.where(F.col("key") < max(runs[i].fold for i in some))
        return rows.coalesce(1).mapInArrow(work, "run int, " + ", ".join(f"{n} binary" for n in _KINDS))

    # or Spark 4.1 puts the single partitions of all tasks into one
    with settings(base.sparkSession, {"spark.sql.unionOutputPartitioning": "false"}):
        got = reduce(lambda a, b: a.union(b), map(task, tasks)).collect()
    return {r["run"]: {n: np.frombuffer(r[n], kind).reshape(trees, nodes) for n, kind in _KINDS.items()} for r in got}


def _held(batches, n: int, width: int) -> tuple[np.ndarray, ...]:
    """Id, target and bins (feature by feature) of ``n`` rows, smaller keys first."""
    key, ids, y, bins = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n), np.empty((width, n), np.uint8)
    at = 0
    for b in batches:
        s = slice(at, at + b.num_rows)
        key[s], ids[s], part, y[s] = _base_of(b, width)
        bins[:, s] = part.T
        at = s.stop
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        for column in (key, ids, y, *bins):
            column[:] = column[order]
    return ids, y, bins


def _forest_of(bins, ids, g, run, sizes, trees, nodes, share, columns, seed) -> dict[str, np.ndarray]:
    """Trees (tree x node) of one run from its rows: bins (feature x row), ids and gradients, which it changes."""
    width, most = len(bins), max(sizes)
    out = {n: np.zeros((trees, nodes), kind) for n, kind in _KINDS.items()}
    out["feature"][:] = -1
    spans = [slice(i, min(i + CHUNK, len(ids))) for i in range(0, len(ids), CHUNK)]
    node = np.zeros(len(ids), np.uint8 if nodes < 256 else np.uint16)
    for tree in range(trees if len(ids) else 0):
        now, allowed = _blank(1, nodes), columns_of(tree, width, columns, seed)
        used = in_sample(ids, tree, share, seed)
        node[:] = 0
        grows = np.ones((1, 1), bool)
        for level in range(run.depth):
            if not grows.any():
                break
            first, here = (1 << level) - 1, 1 << level
            # rows outside the sample and in leaves above are counted in a place of their own
            place = np.full(nodes, here * most)
            place[first: first + here] = np.arange(here) * most
            sums = np.zeros((2, here + 1, width, most))
            for s in spans:
                at, own = place[node[s]], g[s]
                at[~used[s]] = here * most
                for f in allowed:
                    cell = at + bins[f, s]
                    sums[0, :, f] += np.bincount(cell, own, (here + 1) * most).reshape(here + 1, most)
                    sums[1, :, f] += np.bincount(cell, minlength=(here + 1) * most).reshape(here + 1, most)
            found = []
            for k in range(here):
                if sums[1, k].any():
                    f, *rest = best_split(np.moveaxis(sums[:, k, allowed], 0, 2), run.penalty, np.arange(len(allowed)))
                    found.append(dict(zip(_FOUND, (0, k, int(allowed[f]) if f >= 0 else -1, *rest), strict=True)))
            grows = _note(now, found, [run], level)
            for k in range(first, first + here):
                if now["feature"][0, k] >= 0:
                    for s in spans:
                        on = np.flatnonzero(node[s] == k)
                        node[s][on] = 2 * k + 1 + (bins[now["feature"][0, k], s][on] > now["cut"][0, k])
        for n in out:
            out[n][tree] = now[n][0]
        for s in spans:
            g[s] += now["value"][0][node[s]]
    return out


def _none(runs: int, trees: int) -> dict[str, np.ndarray]:
    return {"feature": np.full((runs, trees, 1), -1, np.int16), "cut": np.zeros((runs, trees, 1), np.uint8),
            "value": np.zeros((runs, trees, 1)), "gain": np.zeros((runs, trees, 1))}


def _packed(bins: np.ndarray) -> pa.Array:
    at = np.arange(len(bins) + 1, dtype=np.int32) * np.int32(bins.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(at), pa.py_buffer(bins.tobytes())])


def _listed(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1] or 1, dtype=np.int32)[
        : len(values) + 1]), pa.array(values.ravel()))


def _advanced(state: DataFrame, since: dict[str, np.ndarray], width: int) -> DataFrame:
    def work(batches):
        for b in batches:
            _, _, bins, _, pred = _read(b, width, len(since["value"]))
            pred = pred + _sum_of_trees(bins, since["feature"], since["cut"], since["value"])
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], _listed(pred)], b.schema.names)

    return state.mapInArrow(work, _BASE + ", pred array<double>")


def _level(state, since, now, level, folds, width, sizes, tree, share, seed, runs, allowed) -> list:
    """Best split of every node at a level of all runs' trees."""
    n_runs, first, here, most = len(runs), (1 << level) - 1, 1 << level, max(sizes)
    cells = width * most
    penalties = [r.penalty for r in runs]
    active = [i for i, r in enumerate(runs) if r.depth > level]
    last = max((folds[i] for i in active), default=0)

    def partial(batches):
        sums = np.zeros((2, n_runs, here, width, most))
        for b in batches:
            key, ids, bins, y, pred = _read(b, width, n_runs)
            seen = np.flatnonzero((key < last) & in_sample(ids, tree, share, seed)) if active else np.zeros(0, int)
            key, bins, y, pred = key[seen], bins[seen], y[seen], pred[seen]
            columns = np.ascontiguousarray(bins.T)
            for i in active:
                mine = np.flatnonzero(key < folds[i])
                if not len(mine):
                    continue
                own, part = (bins, columns) if len(mine) == len(key) else (bins[mine], columns[:, mine])
                flat = np.ascontiguousarray(own).reshape(-1)
                node = _walk_one(flat, own.shape, now["feature"][i], now["cut"][i], level) - first
                said = pred[mine, i]
                if since["value"] is not None:
                    said = said + _sum_of_trees(own, *(since[n][i: i + 1] for n in ("feature", "cut", "value")))[:, 0]
                g = said - y[mine]
                if (node < 0).any():  # rows that stay in a leaf above
                    live = np.flatnonzero(node >= 0)
                    node, g, part = node[live], g[live], part[:, live]
                at = node * most
                for f in allowed:
                    place = at + part[f]
                    sums[0, i, :, f] += np.bincount(place, g, here * most).reshape(here, most)
                    sums[1, i, :, f] += np.bincount(place, minlength=here * most).reshape(here, most)
        block = sums.reshape(2, n_runs * here, cells)
        for i in np.flatnonzero(block[1].any(axis=1)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i // here], pa.int32()), pa.array([i % here], pa.int32()),
                 pa.array([np.ascontiguousarray(block[:, i]).tobytes()], pa.binary())], ["run", "node", "sums"])

    def chosen(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for run, node, sums in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                part = np.frombuffer(sums, np.float64).reshape(2, width, most)
                held[run, node] = held[run, node] + part if (run, node) in held else part
        rows = []
        for (run, node), sums in held.items():
            hist = np.moveaxis(sums, 0, 2)
            rows.append((run, node, *best_split(hist[allowed], penalties[run], np.arange(len(allowed)))))
        out = [(r, n, int(allowed[f]) if f >= 0 else -1, *rest) for r, n, f, *rest in rows]
        if out:
            kinds = [pa.int32()] * 4 + [pa.float64()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], _FOUND)

    dealt = state.mapInArrow(partial, "run int, node int, sums binary").repartition(
        min(16, n_runs * here), "run", "node")
    return dealt.mapInArrow(chosen, _SPLITS).collect()


def predict(rows: DataFrame, forest: Forest, key: str, out: str = "predicted", exact: bool = True) -> DataFrame:
    """Forecast of each row, never below zero, by the run of its own fold (not ``exact``: of the last fold up to its
    key); null where there is none. The forest is sent to all tasks; its size is runs x trees x nodes."""
    ship(rows.sparkSession)
    folds = np.array([r.fold for r in forest.runs])
    order = np.argsort(folds, kind="stable")
    width = len(forest.features)
    model = rows.sparkSession.sparkContext.broadcast(forest)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])
    names = [*rows.columns, out]
    kept = [F.col(f"`{c}`") for c in rows.columns]

    def work(batches):
        f = model.value
        for b in batches:
            bins, k = _binned(b, f.edges), b.column(width).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(folds[order], k, "right") - 1
            run = order[np.maximum(at, 0)]
            ok = (at >= 0) & ((folds[run] == k) | (not exact))
            total = np.full(len(k), np.nan)
            for r in np.unique(run[ok]):
                mine = np.flatnonzero(ok & (run == r))
                total[mine] = f.start[r] + _sum_of_trees(
                    bins[mine], f.feature[r: r + 1], f.cut[r: r + 1], f.value[r: r + 1])[:, 0]
            got = pa.array(np.maximum(total, 0.0), mask=~ok)
            yield pa.RecordBatch.from_arrays([*b.columns[width + 1:], got], names)

    return _plain(rows, forest.features, F.col(key).cast("long").alias("_key_of_row"), *kept).mapInArrow(work, schema)


def errors_by_run(state: DataFrame, forest: Forest) -> dict[Run, tuple[int, float]]:
    """(rows, sum of absolute errors) of every run on the rows of its own fold."""
    folds, width = np.array([r.fold for r in forest.runs]), len(forest.features)

    def work(batches):
        n, e = np.zeros(len(folds), np.int64), np.zeros(len(folds))
        for b in batches:
            key, _, _, y, pred = _read(b, width, len(folds))
            use = key[:, None] == folds[None, :]
            n += use.sum(axis=0)
            e += np.where(use, np.abs(np.maximum(pred, 0.0) - y[:, None]), 0.0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(folds))), pa.array(n), pa.array(e)], ["run", "n", "e"])

    sums = state.mapInArrow(work, "run long, n long, e double").groupBy("run").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    return {forest.runs[r["run"]]: (r["n"], r["e"]) for r in sums.collect()}


def tuned_runs(rows: DataFrame, features: list[str], folds: list[int], key: str, ids: list[str], trees: int = 200,
               min_train: int = 2, **options) -> tuple[list[Run], dict[tuple[int, Run], float]]:
    """(best run of every fold, mean absolute error by fold and grid point over the inner folds before it).

    Inner folds are the seasons after the first ``min_train``; all outer folds share them, so the whole search is one
    fit. A fold with fewer than two inner folds keeps the default point.
    """
    seasons = sorted(r[0] for r in rows.select(F.col(key).cast("long")).distinct().collect())
    forest, state = fit(rows, features, grid_runs(seasons[min_train:]), key, ids, trees=trees, **options)
    errors = errors_by_run(state, forest)
    best, scores = [], {}
    for fold in folds:
        inner = [k for k in seasons[min_train:] if k < fold]
        if len(inner) < 2:
            best.append(Run(fold))
            continue
        for point in product(*GRID.values()):
            per = [errors[Run(k, *point)] for k in inner]
            scores[fold, Run(fold, *point)] = float(np.mean([e / n for n, e in per if n]))
        best.append(min((round(s, 9), i, run) for i, ((k, run), s) in enumerate(scores.items()) if k == fold)[2])
    return best, scores


def importances(forest: Forest) -> dict[str, float]:
    """Share of all gains by feature."""
    gains = np.zeros(len(forest.features))
    np.add.at(gains, forest.feature[forest.feature >= 0], forest.gain[forest.feature >= 0])
    return dict(zip(forest.features, (gains / (gains.sum() or 1.0)).tolist(), strict=True))
