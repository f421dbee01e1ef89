"""Trie of conversation prefixes from padded turn-id matrices.

A turn is 128 bits of its role and text, so no text is shuffled. Conversations are range-sharded by their turn ids.
A task numbers its shard's turns, pads them into matrices of 32 columns at a time (rows that are long enough only),
orders rows with lexsort, and OR-accumulates the column changes between neighbours: a row starts a node at every depth
behind its first change. Sums of any node are then sums over its run of rows, taken with reduceat depth by depth:

- a row's turns shared with the row before it are tokens saved by the nodes there,
- a row that starts a node at depth d + 1 is a child of its node at depth d,
- a row that the next one does not continue is a leaf.

All three need the row before or after, across shards too: shards exchange how much of their first and last rows they
share. Nodes that reach over a shard's edge lie on these rows' paths only; they are emitted in parts, named by the
shard they start in, and added up. Everything else is final when it leaves its task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.records import stage
from .shipping import ship

#: Columns of a padded matrix; turns per shard, and shards that even a small table is cut into (of this many turns).
WIDTH, SHARD, FEWEST, LITTLE = 32, 1 << 20, 64, 1 << 13
#: Most parts of nodes over edges that are broadcast to name parents (48 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1 << 18
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_NODES = ("owner int, depth int, conv_id long, parent_owner int, parent_conv_id long, n_convs long, n_children long, "
          "n_leaves long, saved_tokens long, ends_sha256 string, ends array<long>")


def sequences(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """conv and its turns in order: arrays of ids (16 bytes of a SHA-256 of role and text) and chars.

    Turns go by number, null first, ties by id. Null role and text count as empty; rows without a conversation are
    left out. A conversation is one row of 24 bytes a turn.
    """
    empty = F.lit("")
    said = F.coalesce(F.col(f"`{text}`").cast("string"), empty)
    by = F.coalesce(F.col(f"`{role}`").cast("string"), empty)
    digest = F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256)
    one = F.struct(F.col(f"`{turn}`").alias("turn"), F.unhex(F.substring(digest, 1, 32)).alias("id"),
                   F.length(said).cast("long").alias("chars"))
    got = rows.select(F.col(f"`{conv}`").cast("long").alias("conv"), one.alias("one")).where("conv is not null")
    got = got.groupBy("conv").agg(F.sort_array(F.collect_list("one")).alias("all"))
    return got.select("conv", F.col("all.id").alias("ids"), F.col("all.chars").alias("chars"))


def rebuilt(seq: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of c - c % every; h = crc32(c) % most."""
    c = F.col("conv")
    own = seq.select(c, (F.crc32(c.cast("string")) % most).cast("int").alias("h"), (c - c % every).alias("from"),
                     "ids", "chars")
    # sources of at most ``every`` conversations each, cut to the turns that can be asked for
    heads = seq.where(c % every == 0).select(
        c.alias("from"), *[F.slice(x, 1, most - 1).alias(f"head_{x}") for x in ("ids", "chars")])
    both = own.join(heads, "from", "left")

    def spliced(x: str) -> Column:
        head = F.when(F.col("h") > 0, F.slice(f"head_{x}", 1, F.greatest("h", F.lit(1))))
        rest = F.slice(x, F.col("h") + 1, F.greatest(F.size(x), F.lit(1)))
        return F.when(head.isNull(), rest).otherwise(F.concat(head, rest)).alias(x)

    return both.select("conv", spliced("ids"), spliced("chars"))


def _shared(a: str, b: str) -> Column:
    """How many turns two arrays of ids have in common from the start; -1 where one is missing."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.coalesce(F.when(first > 0, first - 1).otherwise(F.size(same)), F.lit(-1))


def _edges(sharded: DataFrame) -> dict[int, tuple[int, int, list[tuple[int, int]]]]:
    """Per shard: turns its first row shares with the row before it and its last one with the row after it, and for
    the nodes that begin before it (up to depth, starting shard). A few numbers per shard."""
    ends = sharded.groupBy("shard").agg(F.min("ids").alias("low"), F.max("ids").alias("high"))
    line = W.orderBy("shard")
    ends = ends.select("shard", "low", "high", F.lag("high").over(line).alias("ahead"))
    found = ends.select("shard", _shared("ahead", "low").alias("before"), _shared("low", "high").alias("inside"))
    rows = found.orderBy("shard").collect()
    out, open_ = {}, []
    for i, r in enumerate(rows):
        after = rows[i + 1]["before"] if i + 1 < len(rows) else -1
        begun = [(min(d, r["before"]), s) for d, s in open_]
        out[r["shard"]] = (r["before"], after, begun)
        through = min(r["before"], r["inside"])  # nodes that hold the whole shard and more
        open_, last = [], -1
        for d, s in begun:
            if min(d, through) > last:
                open_.append((min(d, through), s))
                last = min(d, through)
        if after > last:
            open_.append((after, r["shard"]))
    return out


def _dense(ids: pa.Array) -> np.ndarray:
    """Numbers of distinct 16-byte ids in their order."""
    whole = ids.cast(pa.binary(16))
    raw = np.zeros(0, ">u8") if not len(ids) else np.frombuffer(
        whole.buffers()[1], ">u8", 2 * len(ids), 16 * whole.offset)
    raw = raw.astype(np.uint64).reshape(-1, 2)
    order = np.lexsort((raw[:, 1], raw[:, 0]))
    new = np.ones(len(raw), bool)
    new[1:] = (raw[order[1:]] != raw[order[:-1]]).any(axis=1)
    out = np.empty(len(raw), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _padded(ids: np.ndarray, first: np.ndarray, size: np.ndarray, rows: np.ndarray, at: int) -> np.ndarray:
    """Turn ids of the rows in columns at, at + 1 and so on; -1 behind a row's end."""
    here = np.arange(WIDTH) < (size[rows] - at)[:, None]
    out = np.full(here.shape, -1, np.int64)
    out[here] = ids[((first[rows] + at)[:, None] + np.arange(WIDTH))[here]]
    return out


def ordered(ids: np.ndarray, first: np.ndarray, size: np.ndarray, conv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in order of their turn ids and conv, turns that each shares with the row before; -1 for the first)."""
    n, deepest = len(size), int(size.max(initial=0))
    rank = np.zeros(n, np.int64)
    for at in range(0, deepest, WIDTH):
        rows = np.flatnonzero(size > at)
        m = _padded(ids, first, size, rows, at)
        order = np.lexsort((*m.T[::-1], rank[rows]))
        m, held = m[order], rank[rows][order]
        new = (m[1:] != m[:-1]).any(axis=1) | (held[1:] != held[:-1])
        place = rank * (n + 1)  # rows that have ended stay ahead of longer ones
        place[rows[order]] += np.concatenate([[1], 1 + np.cumsum(new)])
        rank = np.unique(place, return_inverse=True)[1]
    order = np.lexsort((conv, rank))
    shared = np.full(n, -1, np.int64)
    alive = np.arange(1, n)
    shared[1:] = 0
    for at in range(0, deepest, WIDTH):
        alive = alive[np.minimum(size[order[alive]], size[order[alive - 1]]) > at]
        changed = _padded(ids, first, size, order[alive], at) != _padded(ids, first, size, order[alive - 1], at)
        begun = np.logical_or.accumulate(changed, axis=1)
        same = (~begun).sum(axis=1)
        shared[alive] = np.minimum(at + same, np.minimum(size[order[alive]], size[order[alive - 1]]))
        alive = alive[same == WIDTH]
    return order, shared


def _join(numbers: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, numbers.tolist())).encode()).hexdigest()


def shard_nodes(shard: int, conv: np.ndarray, size: np.ndarray, ids: np.ndarray, chars: np.ndarray,
                before: int, after: int, begun: list[tuple[int, int]]):
    """Nodes of one shard, a dict of columns per depth; nodes over its edges have an owner, and ends as numbers."""
    first = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
    order, shared = ordered(ids, first, size, conv)
    conv, size, first = conv[order], size[order], first[order]
    shared[0] = before
    total = np.concatenate([[0], np.cumsum(chars)])
    leaf = np.append(shared[1:], after) < size
    act, prev = np.arange(len(size)), None
    for depth in range(int(size.max()) + 1):
        act = act[size[act] >= depth]
        start = shared[act] < depth
        start[0] = True
        heads = np.flatnonzero(start)
        tails = np.append(heads[1:], len(act))
        base, own = max(depth - 1, 0), shared[act]
        saved = total[first[act] + np.maximum(own, base)] - total[first[act] + base]
        least = np.minimum.reduceat(conv[act], heads)
        owner = np.full(len(heads), -1, np.int64)
        if act[-1] == len(size) - 1 and depth <= after:
            owner[-1] = shard
        if act[0] == 0 and depth <= before:
            owner[0] = next(s for d, s in begun if depth <= d)
        if prev is None:
            parent_owner, parent_least = np.full(len(heads), -1, np.int64), np.full(len(heads), -1, np.int64)
        else:
            up = np.searchsorted(prev[0], act[heads], "right") - 1
            parent_owner, parent_least = prev[1][up], prev[2][up]
        ending = size[act] == depth
        many = np.add.reduceat(ending.astype(np.int64), heads)
        stops = np.cumsum(many)
        closing = conv[act][ending]
        sha, ends = [EMPTY_SHA] * len(heads), [None] * len(heads)
        for i in np.flatnonzero(many):
            mine = closing[stops[i] - many[i]: stops[i]]
            if owner[i] < 0:
                sha[i] = _join(mine)
            else:
                ends[i] = mine
        yield {
            "owner": owner, "depth": np.full(len(heads), depth), "conv_id": least, "parent_owner": parent_owner,
            "parent_conv_id": parent_least, "n_convs": tails - heads,
            "n_children": np.add.reduceat(((own <= depth) & (size[act] > depth)).astype(np.int64), heads),
            "n_leaves": np.add.reduceat(leaf[act].astype(np.int64), heads),
            "saved_tokens": np.add.reduceat(saved, heads), "ends_sha256": sha, "ends": ends}
        prev = (act[heads], owner, least)


def _batch(part: dict) -> pa.RecordBatch:
    whole, inner, root = part["owner"] < 0, part["parent_owner"] < 0, part["depth"] == 0
    masks = {"owner": whole, "parent_owner": inner | root, "parent_conv_id": root}
    kinds = {"owner": pa.int32(), "depth": pa.int32(), "parent_owner": pa.int32(), "ends_sha256": pa.string(),
             "ends": pa.list_(pa.int64())}
    cols = [pa.array(v, kinds.get(c, pa.int64()), mask=masks[c]) if c in masks else pa.array(v, kinds.get(c, pa.int64()))
            for c, v in part.items()]
    return pa.RecordBatch.from_arrays(cols, list(part))


def _closing_hashes(ends: DataFrame) -> DataFrame:
    """owner, depth, sha of the sorted conversations that end in a node over edges, streamed through the task."""
    def work(batches):
        now, state = None, None
        out = []
        for batch in batches:
            for o, d, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (o, d) != now:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = (o, d), hashlib.sha256(str(c).encode())
                else:
                    state.update(f",{c}".encode())
        if now:
            out.append((*now, state.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.string()), strict=True)],
                ["owner", "depth", "sha"])

    rows = ends.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "conv")
    return rows.mapInArrow(work, "owner int, depth int, sha string")


def build_trie(seq: DataFrame, turns_per_shard: int | None = None) -> DataFrame:
    """The trie's nodes from ``conv, ids, chars``: conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256. No conversations give no nodes, one without turns belongs to the root."""
    ship(seq.sparkSession)
    seq = stage(seq)
    size = seq.agg(F.coalesce(F.sum(F.size("ids") + 1), F.lit(0))).first()[0]
    shards = -(-size // (turns_per_shard or SHARD)) if turns_per_shard else max(
        -(-size // SHARD), min(FEWEST, -(-size // LITTLE)))
    ranged = seq.repartitionByRange(max(1, shards), "ids", "conv")
    sharded = stage(ranged.withColumn("shard", F.spark_partition_id()))
    edges = _edges(sharded)

    def work(table):
        table = table.combine_chunks()
        ids, chars = (table.column(c).combine_chunks() for c in ("ids", "chars"))
        sizes = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        shard = table.column("shard")[0].as_py()
        parts = [_batch(p) for p in shard_nodes(
            shard, table.column("conv").to_numpy(), sizes, _dense(ids.flatten()),
            chars.flatten().to_numpy(zero_copy_only=False), *edges[shard])]
        return pa.Table.from_batches(parts)

    nodes = stage(sharded.groupBy("shard").applyInArrow(work, _NODES))
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    split = nodes.where("owner is not null")
    joined = split.groupBy("owner", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.max("parent_owner").alias("parent_owner"),
        *[F.sum(c).alias(c) for c in sums])
    sha = _closing_hashes(split.select("owner", "depth", F.explode("ends").alias("conv")))
    joined = stage(joined.join(sha, ["owner", "depth"], "left"))
    parents = joined.select(F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"),
                            F.col("conv_id").alias("_above"))
    if joined.count() <= BROADCAST_ROWS:
        parents = F.broadcast(parents)
    out = ["conv_id", "depth", "parent_owner", "parent_conv_id", *sums, "ends_sha256"]
    every = nodes.where("owner is null").select(*out).unionByName(joined.select(
        "conv_id", "depth", "parent_owner", F.lit(None).cast("long").alias("parent_conv_id"), *sums,
        F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256")))
    named = every.join(parents, ["parent_owner", "depth"], "left")
    return named.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.coalesce("_above", "parent_conv_id").alias(
            "parent_conv_id"), *sums, "ends_sha256")


def prefix_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                turns_per_shard: int | None = None) -> DataFrame:
    """Trie of the conversations as they are; columns, nulls and order as in ``sequences`` and ``build_trie``.

    Repeated rows are repeated turns, other columns are ignored.
    """
    return build_trie(sequences(rows, conv, turn, role, text), turns_per_shard)


def rebuilt_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 turns_per_shard: int | None = None) -> DataFrame:
    """Trie of the conversations after each got the first turns of the one at the start of its hundred."""
    return build_trie(rebuilt(stage(sequences(rows, conv, turn, role, text))), turns_per_shard)
