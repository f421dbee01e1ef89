"""Quality rules with robust multivariate outliers.

Statistics of whole texts become a transformed vector. Per language and source a minimum-covariance-determinant
estimate is found by concentration steps, each one aggregation over all rows: the rows nearest to the present
centre give the next centre and covariance. Rows far from their group's final estimate are rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.records import stage
from .shipping import ship
from .texts import Words, map_texts, per_text

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper")
#: Least deviation of each feature: covariance gets its square on the diagonal, so a statistic that is the
#: same in nearly all texts neither makes it singular nor rejects for a trifle.
FLOORS = (0.5, 0.3, 0.05, 0.1, 0.05, 0.05)
FEATURES = tuple(f"z{i}" for i in range(len(FLOORS)))
#: Bins of ln(distance) for the exact choice of the nearest rows.
_BINS = 32


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict:
    """Counts of each text of a run."""
    w = Words(data, offsets)
    n_words = np.diff(w.first)
    heads = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & w.inside)])
    symbols = np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8))
    upper = (data >= 65) & (data <= 90)

    def total(mask):
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    # lines with a word; equal ones share a hash
    feeds = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], feeds + 1]))
    starts = starts[starts < len(data)]
    owner = np.searchsorted(offsets, starts, "right") - 1
    after = np.append(feeds, len(data))[np.searchsorted(feeds, starts)]
    ends = np.minimum(after, offsets[owner + 1])
    full = heads[ends] > heads[starts]
    starts, ends, owner = starts[full], ends[full], owner[full]
    n_lines = np.bincount(owner, minlength=len(n_words))
    keyed = w.rolling.of(starts, ends) ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, index = np.unique(keyed, return_index=True)
    n_dup = n_lines - np.bincount(owner[index], minlength=len(n_words))

    # words inside a window of eight that is found again
    doc = np.repeat(np.arange(len(n_words)), n_words)
    last = w.first[1:][doc] - 8
    at = np.flatnonzero(np.arange(len(doc)) <= last)
    keyed = w.windows(8)[at] ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, counts = np.unique(keyed, return_inverse=True, return_counts=True)
    again = at[counts[inverse] > 1]
    cover = np.zeros(len(doc) + 9, np.int32)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 8, -1)
    repeated = np.cumsum(cover)[: len(doc)] > 0
    return {
        "n_words": n_words, "word_chars": total((np.diff(heads) > 0)), "n_symbols": total(symbols),
        "n_dup_lines": n_dup, "n_repeat_words": per_text(repeated, w.first), "n_lines": n_lines,
        "n_upper": total(upper),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> list[Column]:
    """Transformed statistics; constants in the ratios draw short texts to the middle."""
    n, c = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    return [
        F.log(n + 1), (c + 250) / (n + 50), F.sqrt(F.col("n_symbols") / (c + 250)),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 10)), F.sqrt(F.col("n_repeat_words") / (n + 50)),
        F.sqrt(F.col("n_upper") / (c + 250)),
    ]


def _labels(stats: DataFrame, lang: str, source: str) -> DataFrame:
    label = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")) for c in (lang, source)]
    return stats.withColumn("_l", label[0]).withColumn("_s", label[1])


def groups(labelled: DataFrame, least: int) -> DataFrame:
    """Group of each language and source; where those are rare, their language's; else that of what is left."""
    names = labelled.groupBy("_l", "_s").agg(F.count("*").alias("_n")).withColumn("_small", F.col("_n") < least)
    by_lang = names.where("_small").groupBy("_l").agg((F.sum("_n") >= least).alias("_enough"))
    return stage(names.join(by_lang, "_l", "left").select("_l", "_s", F.when(
        ~F.col("_small"), F.concat_ws("\x01", "_l", "_s")).when(F.col("_enough"), F.col("_l")).otherwise(
        F.lit("\x02rest")).alias("_group")))


def _join_small(rows: DataFrame, small: DataFrame, on: list[str], bound: int = 20_000) -> DataFrame:
    """Left join to a table of one row per group, broadcast where it has at most ``bound`` rows."""
    small = stage(small)
    return rows.join(F.broadcast(small) if small.count() <= bound else small, on, "left")


def _distance() -> Column:
    """Squared distance from the centre; the inverse covariance comes as a flat array."""
    d = len(FEATURES)
    diff = [F.col(f) - F.col("_mean")[i] for i, f in enumerate(FEATURES)]
    terms = [F.col("_inverse")[i * d + j] * diff[i] * diff[j] * (1 if i == j else 2)
             for i in range(d) for j in range(i, d)]
    return sum(terms[1:], terms[0])


def _estimates(sums: DataFrame) -> DataFrame:
    """Centre and inverse covariance of each group from its counts, sums and products."""
    d = len(FEATURES)

    def solve(frames):
        for f in frames:
            rows = []
            for g, n, s, p in zip(f["_group"], f["_n"], f["_sums"], f["_products"], strict=True):
                mean = np.array(s) / n
                cov = np.zeros((d, d))
                cov[np.triu_indices(d)] = np.array(p) / n
                cov = cov + np.triu(cov, 1).T - np.outer(mean, mean) + np.diag(np.square(FLOORS))
                rows.append((g, mean.tolist(), np.linalg.inv(cov).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["_group", "_mean", "_inverse"])

    ship(sums.sparkSession)
    return sums.mapInPandas(solve, "_group string, _mean array<double>, _inverse array<double>")


def _totals(df: DataFrame, *keys: str) -> DataFrame:
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    return df.groupBy(*keys).agg(
        F.count("*").alias("_n"), *[F.sum(f).alias(f"_s{i}") for i, f in enumerate(FEATURES)],
        *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"_p{k}") for k, (i, j) in enumerate(pairs)])


def _packed(df: DataFrame) -> DataFrame:
    d = len(FEATURES)
    return df.select("_group", "_n", F.array(*[f"_s{i}" for i in range(d)]).alias("_sums"),
                     F.array(*[f"_p{k}" for k in range(d * (d + 1) // 2)]).alias("_products"))


def fit(stats: DataFrame, steps: int = 4, share: float = 0.6, least: int = 200) -> DataFrame:
    """One row per group: _group, _mean, _inverse and _scale, which makes the median distance a chi-square's.

    The start is each group's median and spread (feature by feature); every step takes at least ``share`` of
    the group's rows, nearest first, in bins of the distance's logarithm. Groups under ``least`` rows get none.
    """
    d = len(FEATURES)
    quartiles = stats.groupBy("_group").agg(
        F.count("*").alias("_n"),
        *[F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f"_q{i}") for i, f in enumerate(FEATURES)])
    spread = [F.pow((F.col(f"_q{i}")[2] - F.col(f"_q{i}")[0]) / 1.349, 2) + F.lit(FLOORS[i] ** 2) for i in range(d)]
    now = quartiles.where(F.col("_n") >= least).select(
        "_group", F.array(*[F.col(f"_q{i}")[1] for i in range(d)]).alias("_mean"),
        F.array(*[(1 / spread[i]) if i == j else F.lit(0.0) for i in range(d) for j in range(d)]).alias("_inverse"))
    order = W.partitionBy("_group").orderBy("_bin")
    for step in range(steps + 1):
        near = _join_small(stats, now, ["_group"]).where(F.col("_mean").isNotNull()).withColumn(
            "_bin", F.floor(F.log(F.greatest(_distance(), F.lit(1e-6))) * _BINS).cast("int"))
        bins = _totals(near, "_group", "_bin")
        total = F.sum("_n").over(W.partitionBy("_group"))
        before = F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        bins = bins.withColumn("_before", before).withColumn("_total", total)
        if step == steps:
            half = bins.where(F.col("_before") < 0.5 * F.col("_total")).groupBy("_group").agg(F.max("_bin").alias("_b"))
            scale = half.select("_group", (F.exp((F.col("_b") + 0.5) / _BINS) / (d - 2 / 3)).alias("_scale"))
            return now.join(scale, "_group")
        kept = bins.where(F.col("_before") < share * F.col("_total")).groupBy("_group").agg(
            *[F.sum(c).alias(c) for c in bins.columns if c not in ("_group", "_bin", "_before", "_total")])
        now = stage(_estimates(_packed(kept)))


def with_statistics(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    fields = [(c, T.LongType()) for c in (*BASE, *EXTRA)]
    return map_texts(docs, statistics, fields, text, carry)


def _judged(labelled: DataFrame, names: DataFrame, model: DataFrame, cutoff: float) -> DataFrame:
    """Add base_failed, distance and kept; rows of a group without an estimate only face the base rules."""
    z = labelled.select("*", *[c.alias(f) for f, c in zip(FEATURES, features(), strict=True)])
    rows = _join_small(_join_small(z, names, ["_l", "_s"]), model, ["_group"])
    return (
        rows.withColumn("base_failed", base_failed())
        .withColumn("distance", _distance() / F.greatest("_scale", F.lit(1.0)))
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance") > cutoff, F.lit(False)))
    )


def _learn(labelled: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    names = groups(labelled, least)
    z = labelled.select("_l", "_s", *[c.alias(f) for f, c in zip(FEATURES, features(), strict=True)])
    return names, stage(fit(_join_small(z, names, ["_l", "_s"]), least=least))


def rate(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source",
         cutoff: float = 90.0, least: int = 200) -> DataFrame:
    """One row per document: key, the five base statistics, base_failed, distance and kept.

    Estimates use all rows that pass the base rules. Null text has no words and fails; a null language or
    source is a group of its own; repeated rows each count; other columns are ignored; no rows give none.
    """
    plain = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{lang}`").alias("_lang"),
                        F.col(f"`{source}`").alias("_source"), F.col(text).alias("_text"))
    labelled = _labels(stage(with_statistics(plain, "_text", ["_key", "_lang", "_source"])), "_lang", "_source")
    names, model = _learn(labelled.where(~base_failed()), least)
    return _judged(labelled, names, model, cutoff).select(
        F.col("_key").alias(key), *BASE, "base_failed", "distance", "kept")


def keep_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                   cutoff: float = 90.0, least: int = 200) -> DataFrame:
    """The documents that ``rate`` keeps, with all their columns; texts are read twice and never shuffled."""
    plain = docs.select(F.col(f"`{lang}`").alias("_lang"), F.col(f"`{source}`").alias("_source"),
                        F.col(text).alias("_text"))
    first = _labels(stage(with_statistics(plain, "_text", ["_lang", "_source"])), "_lang", "_source")
    names, model = _learn(first.where(~base_failed()), least)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *[
        F.col(f"`{a}`").alias(b) for a, b in ((lang, "_lang"), (source, "_source"), (text, "_text"))])
    counted = with_statistics(whole, "_text", ["_doc", "_lang", "_source"])
    return _judged(_labels(counted, "_lang", "_source"), names, model, cutoff).where("kept").select("_doc.*")
