"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to whole numbers. The index holds blocks of rows; for every attribute (component) of a block
and every binary place of its values there is one bitmap, a slice, with a bit per row. A query's products are added
up on bitmaps alone: each set bit of a weight sends the attribute's slices to their places (of a negative weight, the
complements), and full adders reduce every place to one slice of the sum. The top rows are then chosen from the most
significant slice downward: rows surely in, rows still tied. What is tied at the last slice is settled by key.

Blocks are dealt to shelves. Only queries travel to every shelf, each block is read by one task; a task merges the
top rows of its blocks, so k rows per query and shelf leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.records import stage
from .shipping import ship
from .texts import lists

#: Rows of a block; queries added up at a time.
BLOCK, BATCH = 4096, 128
#: Fewest shelves (where there are as many blocks) and most rows of one.
SHELVES, SHELF_ROWS = 24, 1 << 20
#: Scores are ordered exactly as two longs: what lies above this place, and the rest.
_HIGH = 62
#: Codes end here, where doubles cease to tell whole numbers apart.
_MOST_CODE = 1 << 53

_INDEX = ("block long, dim int, n int, keys array<long>, nulls array<boolean>, rows array<long>, offsets array<long>, "
          "widths array<int>, slices binary")
_FOUND = "row long, key long, found long, found_row long, high long, low long"


def quantise(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """_key and codes (``floor(scale * x)``, x as double) of the rows that take part, staged with a row number.

    Vectors null or holding null or non-finite components take no part; codes stop at 2 ** 53 and its negative.
    """
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    def code(x):
        most = F.lit(float(_MOST_CODE))
        return F.floor(F.greatest(F.least(x.cast("double") * scale, most), -most)).cast("long")

    codes = F.transform(v, code)
    rows = vectors.where(v.isNotNull() & finite).select(F.col(f"`{key}`").cast("long").alias("_key"), codes.alias("codes"))
    return stage(rows.withColumn("_row", F.monotonically_increasing_id()))


def _slices_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, widths, bitmaps of all attributes in turn, lowest place first) of a block's codes."""
    n, dim = codes.shape
    offsets = codes.min(axis=0)
    above = codes.view(np.uint64) - offsets.view(np.uint64)  # true differences, also where the range exceeds a long
    top = above.max(axis=0) if dim else np.zeros(0, np.uint64)
    widths = np.array([int(t).bit_length() for t in top], np.int32)
    words = -(-n // 64)
    places = int(widths.max()) if dim else 0
    bits = np.zeros((dim, places, words * 64), bool)
    for b in range(places):
        bits[:, b, :n] = (above >> np.uint64(b) & np.uint64(1)).T
    keep = np.arange(places)[None, :] < widths[:, None]
    return offsets, widths, np.packbits(bits[keep], axis=1, bitorder="little")


def build_index(codes: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per block of at most ``block`` rows of equal length, in order of (key, row), null keys last.

    Each task cuts the rows it reads; nothing is shuffled, and a task holds one open block per vector length.
    """
    ship(codes.sparkSession)

    def closed(number, dim, keys, nulls, rows, values):
        order = np.lexsort((rows, keys, nulls))
        offsets, widths, bitmaps = _slices_of(np.ascontiguousarray(values[order]))
        one = lambda x: lists(x, np.array([len(x)]))
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([dim], pa.int32()), pa.array([len(rows)], pa.int32()),
            one(keys[order]), one(nulls[order]), one(rows[order]), one(offsets), one(widths),
            pa.array([bitmaps.tobytes()], pa.binary())],
            ["block", "dim", "n", "keys", "nulls", "rows", "offsets", "widths", "slices"])

    def work(batches):
        task, made, open_ = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            key, vec = batch.column(0), batch.column(1)
            lengths = vec.value_lengths().to_numpy(zero_copy_only=False)
            flat = vec.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            keys = key.fill_null(0).to_numpy(zero_copy_only=False)
            nulls, rows = key.is_null().to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            for dim in np.unique(lengths):
                here = np.flatnonzero(lengths == dim)
                values = flat[starts[here][:, None] + np.arange(dim)].reshape(len(here), dim)
                parts = open_.setdefault(int(dim), [])
                parts.append((keys[here], nulls[here], rows[here], values))
                joined = [np.concatenate(p) for p in zip(*parts, strict=True)]
                at = 0
                while len(joined[0]) - at >= block:
                    yield closed((made << 32) + task, int(dim), *[p[at: at + block] for p in joined])
                    made, at = made + 1, at + block
                open_[int(dim)] = [[p[at:] for p in joined]]
        for dim, ((keys, nulls, rows, values),) in open_.items():
            if len(rows):
                yield closed((made << 32) + task, dim, keys, nulls, rows, values)
                made += 1

    return codes.select("_key", "codes", "_row").mapInArrow(work, _INDEX)


class Block:
    """A block of the index, ready for queries."""

    def __init__(self, keys, nulls, rows, offsets, widths, slices):
        self.keys, self.nulls, self.rows, self.widths = keys, nulls, rows, widths
        self.offsets = offsets
        self.words = -(-len(rows) // 64)
        own = np.frombuffer(slices, np.uint64).reshape(-1, self.words)
        #: Slices, their complements, and one of zeros for places without a slice.
        self.table = np.concatenate([own, ~own, np.zeros((1, self.words), np.uint64)])
        self.first = np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)
        self.by_row = np.argsort(rows)
        bits = np.zeros(self.words * 64, bool)
        bits[: len(rows)] = True
        self.all = np.packbits(bits, bitorder="little").view(np.uint64)

    def _inputs(self, size: np.ndarray, negative: np.ndarray) -> list[np.ndarray]:
        """Per place of the sum the table rows that each query adds there, padded with the row of zeros."""
        zero, half = len(self.table) - 1, self.first[-1]
        weight_bits = int(size.max()).bit_length() if size.size else 0
        width = int(self.widths.max()) if len(self.widths) else 0
        out = []
        for place in range(weight_bits + width - 1 if weight_bits and width else 0):
            parts = []
            for b in range(max(0, place - width + 1), min(place, weight_bits - 1) + 1):
                c = place - b
                has = np.flatnonzero(self.widths > c)
                ids = self.first[has] + c + np.where(negative[:, has], half, 0)
                parts.append(np.where(size[:, has] >> np.uint64(b) & np.uint64(1), ids, zero))
            ids = np.sort(np.concatenate(parts, axis=1), axis=1)
            out.append(ids[:, : int((ids < zero).sum(axis=1).max())])
        return out

    def sums(self, codes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(slices of each query's sum over all rows, lowest first; what to add to turn sums into products)."""
        negative = codes < 0
        size = np.where(negative, -codes.view(np.uint64), codes.view(np.uint64))
        done, waiting = [], []
        inputs = self._inputs(size, negative)
        place = 0
        while place < len(inputs) or waiting:
            mine, carried = waiting, []
            for column in (inputs[place].T if place < len(inputs) else ()):
                mine.append(self.table[column])
                if len(mine) == 3:
                    a, b, c = mine
                    x = a ^ b
                    mine = [x ^ c]
                    a &= b
                    x &= c
                    a |= x
                    carried.append(a)
            while len(mine) > 1:
                if len(mine) > 2:
                    a, b, c = mine.pop(), mine.pop(), mine.pop()
                    x = a ^ b
                    mine.append(x ^ c)
                    carried.append((a & b) | (x & c))
                else:
                    a, b = mine
                    mine = [a ^ b]
                    carried.append(a & b)
            done.append(mine[0] if mine else np.zeros((len(codes), self.words), np.uint64))
            waiting, place = carried, place + 1
        full = np.array([(1 << int(w)) - 1 for w in self.widths], object)
        wide = codes.astype(object)
        least = (wide * self.offsets.astype(object)).sum(axis=1) + np.where(negative, wide * full, 0).sum(axis=1)
        return done, np.asarray(least, object).reshape(len(codes))

    def top(self, codes: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(query, position, high and low score) of every query's k best rows but its own, highest slice first."""
        slices, least = self.sums(codes)
        tied = np.repeat(self.all[None, :], len(codes), axis=0)
        at = np.searchsorted(self.rows, own, sorter=self.by_row)
        at = self.by_row[np.minimum(at, len(self.rows) - 1)]
        mine = np.flatnonzero(self.rows[at] == own)
        tied[mine, at[mine] >> 6] &= ~(np.uint64(1) << (at[mine] & 63).astype(np.uint64))
        sure = np.zeros_like(tied)
        for s in reversed(slices):
            upper = tied & s
            n = np.bitwise_count(sure | upper).sum(axis=1)[:, None]
            sure, tied = np.where(n > k, sure, sure | upper), np.where(
                n > k, upper, np.where(n < k, tied & ~s, np.uint64(0)))
        short = k - np.bitwise_count(sure).sum(axis=1).astype(np.int64)
        bits = np.unpackbits(tied.view(np.uint8), axis=1, bitorder="little")
        bits &= np.cumsum(bits, axis=1, dtype=np.int32) <= short[:, None]
        bits |= np.unpackbits(sure.view(np.uint8), axis=1, bitorder="little")
        query, position = np.nonzero(bits)
        word, bit = position >> 6, (position & 63).astype(np.uint64)
        kind = np.int64 if len(slices) < 62 else object
        score = np.zeros(len(query), kind)
        for i, s in enumerate(slices):
            score += (s[query, word] >> bit & np.uint64(1)).astype(np.int64).astype(kind) << i
        score = score.astype(object) + least[query]
        return query, position, (score >> _HIGH).astype(np.int64), (score & ((1 << _HIGH) - 1)).astype(np.int64)


def _best(blocks: list[Block], codes: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, key, null, row, high, low) of the k best rows over all blocks, ties to the smaller key."""
    parts = []
    for b in blocks:
        query, position, *score = b.top(codes, own, k)
        parts.append((query, b.keys[position], b.nulls[position], b.rows[position], *score))
    query, key, null, row, high, low = found = [np.concatenate(p) for p in zip(*parts, strict=True)]
    order = np.lexsort((row, key, null, ~low, ~high, query))
    rank = np.arange(len(query)) - np.searchsorted(query[order], query[order])
    return tuple(x[order[rank < k]] for x in found)


def search(index: DataFrame, queries: DataFrame, k: int = 20, shelves: int = SHELVES) -> DataFrame:
    """query row and key, rank, found key and score: every query's k best rows of its length but itself.

    ``queries`` has _key, codes and _row as ``quantise`` gives them.
    """
    ship(index.sparkSession)
    task, turn = F.expr("block & 4294967295"), F.shiftright("block", 32)
    size = index.agg(F.count("*").alias("blocks"), F.sum("n").alias("rows"), F.max(task).alias("task")).first()
    n_shelves = max(1, min(size["blocks"], max(shelves, -(-(size["rows"] or 0) // SHELF_ROWS))))
    own = index.select(F.pmod(task + turn * ((size["task"] or 0) + 1), F.lit(n_shelves)).cast("int").alias("shelf"),
                       F.lit(0).alias("kind"), *index.columns)
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_shelves - 1))).alias("shelf"), F.lit(1).alias("kind"),
        F.col("_row").alias("row"), F.col("_key").alias("key"), "codes")
    both = own.unionByName(asked, allowMissingColumns=True).repartitionById(n_shelves, F.col("shelf"))
    both = both.sortWithinPartitions("shelf", "kind", "dim")
    names = both.columns

    def array_of(column, i):
        return column[i].values.to_numpy(zero_copy_only=False)

    def work(batches):
        blocks, now = {}, None
        for batch in batches:
            c = {name: batch.column(j) for j, name in enumerate(names)}
            shelf, kind = c["shelf"].to_numpy(), c["kind"].to_numpy()
            cuts = np.flatnonzero((shelf[1:] != shelf[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if shelf[a] != now:
                    blocks, now = {}, shelf[a]
                if kind[a] == 0:
                    for i in range(a, b):
                        blocks.setdefault(c["dim"][i].as_py(), []).append(Block(
                            *[array_of(c[x], i) for x in ("keys", "nulls", "rows", "offsets", "widths")],
                            c["slices"][i].as_buffer()))
                    continue
                vec, row, key = (c[x].slice(a, b - a) for x in ("codes", "row", "key"))
                lengths = vec.value_lengths().to_numpy(zero_copy_only=False)
                starts = np.concatenate([[0], np.cumsum(lengths)])
                flat, row = vec.flatten().to_numpy(zero_copy_only=False), row.to_numpy(zero_copy_only=False)
                for dim in np.unique(lengths):
                    here = np.flatnonzero(lengths == dim)
                    for lot in np.split(here, range(BATCH, len(here), BATCH)):
                        if dim not in blocks:
                            continue
                        codes = np.ascontiguousarray(flat[starts[lot][:, None] + np.arange(dim)].reshape(len(lot), dim))
                        q, found, null, found_row, high, low = _best(blocks[dim], codes, row[lot], k)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(row[lot][q]), key.take(pa.array(lot[q])), pa.array(found, mask=null),
                            pa.array(found_row), pa.array(high), pa.array(low)],
                            ["row", "key", "found", "found_row", "high", "low"])

    near = both.mapInArrow(work, _FOUND)
    order = W.partitionBy("row").orderBy(F.desc("high"), F.desc("low"), F.asc_nulls_last("found"), "found_row")
    score = F.when(F.col("high") > 1, F.lit((1 << 63) - 1)).when(F.col("high") < -2, F.lit(-(1 << 63))).otherwise(
        F.shiftleft("high", _HIGH) + F.col("low"))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "row", "key", "rank", "found", score.alias("score"))


def top_products(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, k: int = 20,
                 every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of the rows whose key is divisible by ``every``.

    Ties go to the smaller key, a null key last and never a query. Candidates are all rows but the query's own, so
    repeated rows meet each other. Vectors null or holding null or non-finite components take no part, vectors of other
    lengths than the query's are none of its candidates, empty vectors score 0 among themselves, no rows give none.
    Rows are ordered by exact scores, shown ones stop at the ends of a long. Other columns are ignored.
    """
    codes = quantise(vectors, key, vector, scale)
    index = stage(build_index(codes))
    found = search(index, codes.where(F.col("_key") % every == 0), k)
    return found.select(F.col("key").alias("query_id"), F.col("rank").cast("int").alias("rank"),
                        F.col("found").alias(key), "score")
