"""Substring deduplication by content-defined chunks.

A gear hash rolls over the UTF-8 bytes; where its upper bits are zero a chunk ends, so cuts depend on the last
16 bytes only and an insertion moves none but its own. Chunks are compared by a 128-bit digest. Runs of chunks
that were seen before are passages; those of enough words are reported or cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.records import stage
from .texts import lists, map_texts

#: A cut where the top 5 of 16 bits are zero: every 32 bytes on average, beyond the least length.
_TOP, LEAST, MOST = 5, 16, 1024
_GEAR = np.random.default_rng(16).integers(0, 1 << 16, 256, dtype=np.uint16)


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text's bytes, always between characters."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint16(k) if len(h) > k else 0
        h = h + shifted
    after = np.append(data[1:], np.uint8(0)) if len(data) else data
    found = (np.flatnonzero((h >> np.uint16(16 - _TOP) == 0) & ((after & 0xC0) != 0x80)) + 1).tolist()
    out, begin = [], 0
    for end in found:
        while end - begin > MOST:
            begin = _boundary(data, begin + MOST)
            out.append(begin)
        if end - begin >= LEAST:
            out.append(end)
            begin = end
    while len(data) - begin > MOST:
        begin = _boundary(data, begin + MOST)
        out.append(begin)
    if begin < len(data):
        out.append(len(data))
    return np.array(out, np.int64)


def _boundary(data: np.ndarray, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _chunks(data: np.ndarray, offsets: np.ndarray) -> dict:
    """Digests, ends (code points) and words of each text's chunks."""
    high, low, ends, words, lengths = [], [], [], [], []
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    starts_word = ~blank
    starts_word[1:] &= blank[:-1]
    starts_word[offsets[:-1][np.diff(offsets) > 0]] = ~blank[offsets[:-1][np.diff(offsets) > 0]]
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    begun = np.concatenate([[0], np.cumsum(starts_word)])
    whole = data.tobytes()
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        edge = a + cuts(data[a:b])
        begin = np.concatenate([[a], edge[:-1]]) if len(edge) else edge
        for x, y in zip(begin.tolist(), edge.tolist(), strict=True):
            digest = xxhash.xxh3_128_intdigest(whole[x:y])
            high.append((digest >> 64) - (1 << 63))
            low.append((digest & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
        ends.append(heads[edge] - heads[a])
        words.append(begun[edge] - begun[begin])
        lengths.append(len(edge))
    lengths = np.array(lengths)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return {"high": lists(np.array(high, np.int64), lengths), "low": lists(np.array(low, np.int64), lengths),
            "ends": lists(join(ends).astype(np.int32), lengths), "words": lists(join(words).astype(np.int32), lengths)}


def _chunked(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    kinds = [("high", T.LongType()), ("low", T.LongType()), ("ends", T.IntegerType()), ("words", T.IntegerType())]
    return map_texts(docs, _chunks, [(n, T.ArrayType(t)) for n, t in kinds], text, carry)


def repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = 16) -> DataFrame:
    """Every passage that other places of the corpus hold too, one row each.

    Columns: key, start, end (code points, end exclusive), n_words, n_copies (places of its rarest chunk),
    first_doc (key of the first place of its first chunk) and is_first (whether all its chunks are first here).
    First means the least key, null last, then the earliest place. Passages are runs of repeated chunks with
    at least ``min_words`` words. Null and empty texts have none; repeated rows repeat each other; other columns
    are ignored; no rows give none.
    """
    plain = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    base = stage(_chunked(plain, "_text", ["_key"]).withColumn("_row", F.monotonically_increasing_id()))
    begins = F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    rows = (
        base.where(F.size("ends") > 0)
        .select("_key", "_row", F.posexplode(F.arrays_zip("high", "low", begins.alias("begin"), "ends", "words")))
        .select("_key", "_row", F.col("pos").alias("_at"), "col.*")
    )
    place = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_row").alias("row"),
                     F.col("_at").alias("at"))
    digests = rows.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1")
    again = stage(rows.join(digests, ["high", "low"]))
    first = again.groupBy("high", "low").agg(F.min(place).alias("first"))
    own = again.join(first, ["high", "low"])
    own = own.withColumn("is_first", (F.col("first.row") == F.col("_row")) & (F.col("first.at") == F.col("_at")))
    by_text = W.partitionBy("_row").orderBy("_at")
    runs = own.withColumn("_run", F.col("_at") - F.row_number().over(by_text))
    return (
        runs.groupBy("_row", "_run", "_key").agg(
            F.min("begin").alias("start"), F.max("ends").alias("end"), F.sum("words").alias("n_words"),
            F.min("n").alias("n_copies"), F.min_by("first.key", "_at").alias("first_doc"),
            F.min("is_first").alias("is_first"))
        .where(F.col("n_words") >= min_words)
        .select(F.col("_key").alias(key), "start", "end", "n_words", "n_copies", "first_doc", "is_first", "_row")
        .drop("_row")
    )


def cut_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = 16) -> DataFrame:
    """The documents with every passage that is not first cut out of their text; keys must be unique.

    All columns stay. A text without such a passage stays as it is; a null key or text is left alone.
    """
    gone = repeated_passages(docs, text, key, min_words).where(~F.col("is_first") & F.col(f"`{key}`").isNotNull())
    spans = gone.groupBy(F.col(f"`{key}`").alias("_key")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
                        F.col(f"`{key}`").alias("_own"), F.col(f"`{text}`").alias("_text"))
    joined = whole.join(spans, F.col("_own") == F.col("_key"), "left")
    begin = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))
    bounds = F.concat(begin, F.coalesce("_spans", F.array().cast("array<struct<start:int,end:int>>")))
    final = F.array(F.struct(F.length("_text").alias("start"), F.length("_text").alias("end")))
    kept = F.zip_with(bounds, F.concat(F.slice(bounds, 2, F.greatest(F.size(bounds) - 1, F.lit(0))), final),
                      lambda a, b: F.substring(F.col("_text"), a["end"] + 1, b["start"] - a["end"]))
    cut = F.when(F.size("_spans") > 0, F.array_join(kept, "")).otherwise(F.col("_text"))
    return joined.select(*[(cut if c == text else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])
