"""Order-preserving packing: dynamic programming over document and sentence boundaries.

The texts of an input split are one stream of tokens. Windows of at most ``size`` tokens are cut at the
boundaries that make padding plus truncation penalties smallest. A window that ends at boundary j and begins
at i costs ``size - (b[j] - b[i])`` padding (none where its length is a power of two), the penalty of a cut at
j and a small price per window. As the padding is linear, the best i is the least ``cost[i] + b[i]`` in the
window: a monotone queue gives it in constant time.
"""

from __future__ import annotations

import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import SPECIAL, Pretokens, default_path, id_cache, tokenizer
from .shipping import ship
from .texts import per_text, text_chunks


@dataclass(frozen=True)
class Costs:
    """In padding tokens. Boundaries between documents are free."""

    sentence: float = 8.0
    #: A cut anywhere else, offered only where no sentence ends for ``gap`` tokens.
    inside: float = 64.0
    gap: int = 256
    window: float = 2.0


def best_cuts(bounds: np.ndarray, penalty: np.ndarray, size: int, window: float) -> list[int]:
    """Positions in ``bounds`` where the cheapest windows end; the first bound is 0 and gaps are at most size."""
    b, pen = bounds.tolist(), penalty.tolist()
    at = np.full(b[-1] + 1, -1, np.int64)
    at[bounds] = np.arange(len(b))
    at = at.tolist()
    powers = [1 << k for k in range(size.bit_length()) if 1 << k <= size]
    cost, back = [0.0] * len(b), [0] * len(b)
    queue = deque([(0.0, 0)])
    for j in range(1, len(b)):
        end = b[j]
        while b[queue[0][1]] < end - size:
            queue.popleft()
        least, i = queue[0][0] + size - end, queue[0][1]
        for p in powers:
            if p > end:
                break
            k = at[end - p]
            if k >= 0 and cost[k] < least:
                least, i = cost[k], k
        cost[j], back[j] = least + pen[j] + window, i
        key = cost[j] + end
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], len(b) - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, costs: Costs):
    """Candidate cuts of a stream and their penalties."""
    n = len(ids)
    penalty = np.full(n + 1, np.inf)
    penalty[np.flatnonzero(ends_sentence[ids]) + 1] = costs.sentence
    penalty[doc_ends[doc_ends <= n]] = 0.0
    penalty[[0, n]] = 0.0
    known = np.flatnonzero(np.isfinite(penalty))
    gaps = np.diff(known)
    wide = np.flatnonzero(gaps > costs.gap)
    if len(wide):
        more = np.concatenate([np.arange(known[i] + costs.gap, known[i + 1], costs.gap) for i in wide])
        penalty[more] = costs.inside
        known = np.flatnonzero(np.isfinite(penalty))
    return known, penalty[known]


def _tail(length: int, size: int, costs: Costs) -> list[int]:
    """Lengths of the stream's last windows: powers of two where their cuts cost less than the padding."""
    bits = [1 << k for k in reversed(range(length.bit_length())) if length >> k & 1]
    return bits if (len(bits) - 1) * (costs.inside + costs.window) < size - length else [length]


def sentence_ends(path: str) -> np.ndarray:
    """Whether an id ends a sentence: a full stop, question or exclamation mark, or a line feed."""
    tok = tokenizer(path)
    out = np.zeros(max(tok.get_vocab_size(), 2), bool)
    for piece, i in tok.get_vocab().items():
        out[i] = piece.endswith((".", "!", "?", "Ċ"))
    return out


def pack(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", size: int = 2048,
         end_id: int = 1, block: int = 1 << 17, costs: Costs = Costs()) -> DataFrame:
    """Pieces of whole tokenised documents: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is its ids and ``end_id``; each id lies in exactly one piece. Input order is kept inside an
    input split, which is packed on its own without a shuffle; its number is the high part of sequence_id.
    The search runs over ``block`` tokens at a time and carries the last windows on, so memory is bounded
    but for a single text. Null text counts as empty, repeated rows are packed again, a null key stays null.
    """
    path = path or default_path()
    ship(docs.sparkSession)
    source = docs.select(F.col(f"`{key}`").alias("_key"), F.col(text).cast("string").alias("_text"))

    def documents(batches):
        cache = id_cache(path)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, _, data, offsets in text_chunks(batch.column(1)):
                if SPECIAL.encode() in data.tobytes():
                    whole = [data[x:y].tobytes().decode() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
                    for i, e in enumerate(tokenizer(path).encode_batch(whole, add_special_tokens=False)):
                        yield keys[a + i], np.array([*e.ids, end_id], np.uint32)
                    continue
                p = Pretokens(data, offsets)
                ids, lengths = cache.encode(p)
                ends = np.cumsum(per_text(lengths, p.first))
                for i, (x, y) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                    yield keys[a + i], np.append(ids[x:y], np.uint32(end_id))

    def work(batches):
        table = sentence_ends(path)
        number = TaskContext.get().partitionId() << 36
        held: list[tuple] = []  # key, ids, where the rest begins
        n_held = 0

        def emit(last: bool):
            """Cut what is held; keeps the last windows back unless the stream ends."""
            nonlocal held, n_held, number
            ids = np.concatenate([d[1][d[2]:] for d in held])
            ends = np.cumsum([len(d[1]) - d[2] for d in held])
            bounds, penalty = boundaries(ids, ends, table, costs)
            cuts = [int(bounds[j]) for j in best_cuts(bounds, penalty, size, costs.window)]
            if last:
                before = cuts[-2] if len(cuts) > 1 else 0
                cuts = cuts[:-1] + (before + np.cumsum(_tail(cuts[-1] - before, size, costs))).tolist()
            else:
                cuts = cuts[:-3] or cuts[:1]
            starts = ends - np.array([len(d[1]) - d[2] for d in held])
            edges = np.unique(np.concatenate([[0], cuts, ends[ends < cuts[-1]]]).astype(np.int64))
            owner = np.searchsorted(ends, edges[:-1], "right")
            window = np.searchsorted(cuts, edges[:-1], "right")
            first = np.concatenate([[0], cuts])[window]
            start = edges[:-1] - starts[owner] + np.array([d[2] for d in held])[owner]
            crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(edges[:-1], edges[1:], strict=True)]
            rows = pa.RecordBatch.from_pydict({
                "_key": pa.array([held[i][0] for i in owner], keys_type), "start": start, "length": np.diff(edges),
                "ids_crc32": np.array(crc, np.int64), "doc_tokens": np.array([len(d[1]) for d in held])[owner],
                "sequence_id": number + window, "offset": edges[:-1] - first})
            number += len(cuts)
            left = int(np.searchsorted(ends, cuts[-1], "right"))
            rest = held[left:]
            if rest:
                k, own, begin = rest[0]
                rest[0] = (k, own, begin + max(0, cuts[-1] - int(starts[left])))
            held, n_held = rest, sum(len(d[1]) - d[2] for d in rest)
            return rows

        for key_value, ids in documents(batches):
            held.append((key_value, ids, 0))
            n_held += len(ids)
            while n_held >= block:
                yield emit(last=False)
        if held:
            yield emit(last=True)

    from pyspark.sql.pandas.types import to_arrow_type

    keys_type = to_arrow_type(source.schema["_key"].dataType)
    kind = source.schema["_key"].dataType.simpleString()
    out = source.mapInArrow(
        work, f"_key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("_key", key)
