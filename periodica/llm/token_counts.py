"""Token counts without ids: pieces per distinct pre-token, joined to each text's pre-token frequencies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.records import stage
from .pretokens import SPECIAL, Pretokens, default_path, tokenizer
from .shipping import ship
from .texts import lists, map_texts, mix, per_text, signed, text_chunks

#: Pre-tokens that every task holds: hash and pieces, 12 bytes each.
COMMON = 1 << 20


def _special(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Texts that hold the vocabulary's special string; the library counts those whole."""
    whole = data.tobytes()
    found, at = [], whole.find(SPECIAL.encode())
    while at >= 0:
        i = int(np.searchsorted(offsets, at, "right")) - 1
        if at + len(SPECIAL) <= offsets[i + 1] and (not found or found[-1] != i):
            found.append(i)
        at = whole.find(SPECIAL.encode(), at + 1)
    return found


def _without(data: np.ndarray, offsets: np.ndarray, special: list[int]) -> tuple[np.ndarray, np.ndarray]:
    if not special:
        return data, offsets
    lengths = np.diff(offsets)
    keep = np.ones(len(lengths), bool)
    keep[special] = False
    return data[np.repeat(keep, lengths)], np.concatenate([[0], np.cumsum(np.where(keep, lengths, 0))])


def vocabulary(docs: DataFrame, path: str, text: str = "text", most: int = 400_000) -> DataFrame:
    """Every distinct pre-token of the corpus: hash, piece, n (how often), pieces (tokens, counted once)."""

    def tally(batches):
        def rows():
            return pa.RecordBatch.from_pydict(
                {"hash": signed(keys), "piece": pa.array(strings, pa.string()), "n": counts})

        def empty():
            return np.zeros(0, np.uint64), [], np.zeros(0, np.int64)

        keys, strings, counts = empty()
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), 1 << 22):
                p = Pretokens(*_without(data, offsets, _special(data, offsets)))
                own, index, n = np.unique(p.hashes, return_index=True, return_counts=True)
                at = np.searchsorted(keys, own)
                old = keys[np.minimum(at, max(len(keys) - 1, 0))] == own if len(keys) else np.zeros(len(own), bool)
                counts[at[old]] += n[old]
                strings += [p.string(i) for i in index[~old]]
                order = np.argsort(merged := np.concatenate([keys, own[~old]]), kind="stable")
                keys, counts = merged[order], np.concatenate([counts, n[~old]])[order]
                strings = [strings[i] for i in order]
                if len(keys) > most:
                    yield rows()
                    keys, strings, counts = empty()
        if len(keys):
            yield rows()

    def pieces(batches):
        tok = tokenizer(path)
        for b in batches:
            got = tok.encode_batch(b.column("piece").to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_pydict({
                "hash": b.column("hash"), "n": b.column("n"),
                "pieces": np.fromiter((len(e) for e in got), np.int32, len(got))})

    ship(docs.sparkSession)
    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(tally, "hash long, piece string, n long")
    total = found.groupBy("hash", "piece").agg(F.sum("n").alias("n"))
    return total.mapInArrow(pieces, "hash long, n long, pieces int")


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id",
                 limit: int = 512, common: int = COMMON) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every whole text.

    Each distinct pre-token is counted once. The most frequent quarter, at most ``common``, goes to all tasks as
    two arrays (a fixed bound); frequencies of the others are joined to the vocabulary by hash. One row per input row:
    repeated keys stay apart. Null text counts as empty, a null key stays null, other columns are ignored.
    """
    path = path or default_path()
    words = stage(vocabulary(docs, path, text))
    most = min(common, -(-words.count() // 4))
    top = words.orderBy(F.desc("n"), "hash").limit(most).select("hash", "pieces").toArrow()
    hashes = top.column(0).to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    table = docs.sparkSession.sparkContext.broadcast(
        (hashes[order], top.column(1).to_numpy()[order].astype(np.int32)))

    def known(data, offsets):
        special = _special(data, offsets)
        whole = [data[offsets[i]: offsets[i + 1]].tobytes().decode() for i in special]
        n_bytes = np.diff(offsets)
        p = Pretokens(*_without(data, offsets, special))
        keys, pieces = table.value
        own, inverse = np.unique(p.hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
        n = np.where(hit, pieces[at], 0) if len(keys) else np.zeros(len(own), np.int64)
        total = per_text(n[inverse].astype(np.int64), p.first)
        for i, e in zip(special, tokenizer(path).encode_batch(whole, add_special_tokens=False), strict=True):
            total[i] = len(e.ids)
        rare = np.flatnonzero(~hit[inverse])
        doc = np.searchsorted(p.first, rare, "right") - 1
        both, index, freq = np.unique(
            mix(p.hashes[rare] + doc.astype(np.uint64)), return_index=True, return_counts=True)
        by_doc = np.argsort(doc[index], kind="stable")
        index, freq = index[by_doc], freq[by_doc]
        lengths = np.bincount(doc[index], minlength=len(total))
        return {"n_bytes": n_bytes, "known": total, "rare": lists(signed(p.hashes[rare[index]]), lengths),
                "freq": lists(freq.astype(np.int64), lengths)}

    fields = [("n_bytes", T.LongType()), ("known", T.LongType()), ("rare", T.ArrayType(T.LongType())),
              ("freq", T.ArrayType(T.LongType()))]
    plain = docs.select(F.col(f"`{key}`").alias("_key"), F.col(text).alias("_source"))
    base = stage(map_texts(plain, known, fields, "_source", ["_key"])
                 .withColumn("_row", F.monotonically_increasing_id()))
    rare = (
        base.where(F.size("rare") > 0)
        .select("_row", F.explode(F.arrays_zip("rare", "freq")).alias("_r"))
        .select("_row", F.col("_r.rare").alias("hash"), F.col("_r.freq").alias("freq"))
        .join(words.select("hash", "pieces"), "hash")
        .groupBy("_row").agg(F.sum(F.col("freq") * F.col("pieces")).alias("_more"))
    )
    n = F.col("known") + F.coalesce("_more", F.lit(0))
    return (
        base.select("_row", "_key", "n_bytes", "known").join(rare, "_row", "left")
        .select(F.col("_key").alias(key), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
    )
