"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged per document, softmax on top.

The vectors are learned by numpy stochastic gradient descent in one task on a bounded sample of labelled rows.
As the output is linear in the average, each bucket's part of the logit is a single number: scoring sums these
over every word and n-gram of the whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.records import stage
from .shipping import ship
from .texts import Rolling, lists, map_texts

BITS = 18
GRAMS = (3, 4, 5)
#: Most labelled rows that the fit sees, the first by a hash of their key.
SAMPLE = 3_000


def _features(data: np.ndarray, offsets: np.ndarray):
    """Buckets by position, one array per kind of feature (-1: none), and where each text's positions begin."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    padded = np.full(len(data) + n + 1, 32, np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    padded[np.arange(len(data)) + owner + 1] = np.where(blank, np.uint8(32), data)
    first = offsets + np.arange(n + 1)
    rolling, space = Rolling(padded), padded == 32
    spaces = np.concatenate([[0], np.cumsum(space)])
    out, length = [], len(padded)
    for size in GRAMS:
        got = np.full(length, -1, np.int32)
        at = np.arange(max(0, length - size + 1))
        at = at[spaces[at + size - 1] == spaces[np.minimum(at + 1, length)]]
        got[at] = (rolling.of(at, at + size) >> np.uint64(64 - BITS)).astype(np.int32)
        out.append(got)
    words = np.full(length, -1, np.int32)
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 2
    words[starts] = ((rolling.of(starts, ends) * np.uint64(3)) >> np.uint64(64 - BITS)).astype(np.int32)
    return [*out, words], first


def _bags(data: np.ndarray, offsets: np.ndarray) -> dict:
    """Distinct buckets of each text and their shares."""
    kinds, first = _features(data, offsets)
    ids, shares = [], []
    for a, b in zip(first[:-1], first[1:], strict=True):
        own = np.concatenate([k[a:b] for k in kinds])
        own, counts = np.unique(own[own >= 0], return_counts=True)
        ids.append(own)
        shares.append((counts / max(counts.sum(), 1)).astype(np.float32))
    lengths = np.array([len(i) for i in ids])
    return {"ids": lists(np.concatenate(ids) if ids else np.zeros(0, np.int32), lengths),
            "shares": lists(np.concatenate(shares) if shares else np.zeros(0, np.float32), lengths)}


def train(bags: list, labels: np.ndarray, dim: int = 8, epochs: int = 8, rate: float = 1.0, seed: int = 5):
    """(logit of each bucket, bias) from (ids, shares) pairs."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, shares = bags[i]
            lr = np.float32(rate * (1 - done / steps))
            done += 1
            rows = vectors[ids]
            mean = shares @ rows
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            step = lr * (p @ out)
            out -= lr * np.outer(p, mean)
            bias -= np.float32(0.1) * lr * p
            # each bucket moves by its share; the share of the strongest is one step
            vectors[ids] = rows - (shares / (shares.max() if len(shares) else 1))[:, None] * step[None]
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
        sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Learn from at most ``sample`` rows of ``labels``; labels other than 0 and 1 and texts without any are left."""
    ship(docs.sparkSession)
    order = F.xxhash64(F.col(f"`{key}`").cast("string"))
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(f"`{key}`").isNotNull())
        .select(F.col(f"`{key}`").alias("_key"), F.col(label).cast("int").alias("_label"), order.alias("_order"))
        .orderBy("_order", "_key", "_label").limit(sample)
    )
    texts = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    rows = texts.join(F.broadcast(stage(chosen)), "_key")
    fields = [("ids", T.ArrayType(T.IntegerType())), ("shares", T.ArrayType(T.FloatType()))]
    bags = map_texts(rows, _bags, fields, "_text", ["_order", "_label"])

    def learn(batches):
        seen = []
        for b in batches:
            parts = []
            for name in ("ids", "shares"):
                c = b.column(name)
                parts.append(np.split(c.values.to_numpy(), c.offsets.to_numpy()[1:-1]))
            seen += list(zip(b.column("_order").to_pylist(), b.column("_label").to_pylist(), *parts, strict=True))
        seen = sorted((s for s in seen if len(s[2])), key=lambda s: (s[0], s[1], s[2].tobytes()))
        logits, bias = train([s[2:] for s in seen], np.array([s[1] for s in seen], int))
        yield pa.RecordBatch.from_pydict({"logits": [logits.tobytes()], "bias": [bias]})

    row = bags.repartition(1).mapInArrow(learn, "logits binary, bias double").first()
    return np.frombuffer(row["logits"], np.float32), row["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "score",
          carry: list[str] | None = None) -> DataFrame:
    """Add the chance of label 1 to every document; a text without words gets that of the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(data, offsets):
        logits, bias = shared.value
        kinds, first = _features(data, offsets)
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for k in kinds:
            for into, values in ((total, np.where(k >= 0, logits[k], np.float32(0))), (count, k >= 0)):
                sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
                into += sums[first[1:]] - sums[first[:-1]]
        z = bias + total / np.maximum(count, 1)
        return {out: 1 / (1 + np.exp(-z))}

    return map_texts(docs, work, [(out, T.DoubleType())], text, carry)


def held_out(key: str):
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(f"`{key}`").cast("string")) % 3 == 1


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
                    label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """key, held_out, score, predicted of every document, in one pass over whole texts.

    Null text counts as empty, a null key is not held out, repeated rows are scored again, other columns are
    ignored; without any usable label all scores are a half.
    """
    learned = labels.where(~F.coalesce(held_out(key), F.lit(False)))
    model = fit(docs, learned, text, key, label, sample)
    plain = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(held_out(key), F.lit(False)).alias("_held"),
                        F.col(f"`{text}`").alias("_text"))
    return score(plain, model, "_text", "_score", ["_key", "_held"]).select(
        F.col("_key").alias(key), F.col("_held").alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"))
