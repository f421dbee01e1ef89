"""Mixing sources to target weights with DataFrame functions alone.

Each source's words, its documents in pseudorandom order, are packed end to end into fixed-length blocks. Every
output shard draws how many of its slots each source gets; a source's slots are numbered on through the shards
and mapped through a pseudorandom permutation of its block indexes, a new one for each pass over the source.
Blocks join by index. The multinomial draw is systematic: a source has one random offset, and a shard's count is how
far the source's expected slots, counted on from that offset through the shards, pass whole numbers there. So every
count has its expectation and is at most one away from it, and a source's total is too, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.records import stage

WORD = "[^\\x20\\x09-\\x0D]+"
#: Weights by the rank of the source, in turn.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes, in halves, and most passes over one source.
HALVES, PASSES = 3, 2
_UNIT = 1 << 16
#: Multipliers of the index permutations: primes, so one of them has no factor in common with any block count.
_PRIMES = (1000003, 1000033, 1000037)


def _draw(*parts) -> Column:
    """32 pseudorandom bits of a label."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def running(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Total of ``value`` before each row of its keys, in the order of buckets and then of rows.

    Rows are summed inside their bucket and buckets among themselves, so no key is ordered in one task.
    """
    ahead = W.unboundedPreceding, -1
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(*ahead)
    across = W.partitionBy(*keys).orderBy(bucket).rowsBetween(*ahead)
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    sums = sums.select(*keys, bucket, F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_ahead"))
    own = df.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(sums, [*keys, bucket]).withColumn(out, F.col("_own") + F.col("_ahead")).drop("_own", "_ahead")


def sized(docs: DataFrame, key: str, text: str, source: str, keep: list[str] | None = None) -> DataFrame:
    """key, source, words of every document, with what tells rows apart."""
    return docs.select(
        *(keep or []),
        F.col(f"`{key}`").alias("_key"), F.col(f"`{source}`").alias("_source"),
        F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(f"`{text}`")).alias("_hash"))


def targets(sizes: DataFrame, block: int) -> DataFrame:
    """One row per source: rank, n (words), target, blocks and units (expected slots in fixed point).

    Sources rank by code point, null last. The water level is found in one ordered pass over the sources.
    """
    n = sizes.groupBy("_source").agg(F.sum("size").alias("n"))
    rank = F.row_number().over(W.orderBy(F.col("_source").asc_nulls_last()))
    n = n.withColumn("rank", rank)
    n = n.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1)
                                       .cast("int")).cast("long"))
    everything = W.partitionBy()
    by_level = W.orderBy(F.col("n") / F.col("w"), "rank").rowsBetween(W.unboundedPreceding, -1)
    n = n.withColumn("all_n", F.sum("n").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    before = [F.coalesce(F.sum(c).over(by_level), F.lit(0)) for c in ("n", "w")]
    # capped: the level without it lies above twice its size
    n = n.withColumn("capped", (HALVES * F.col("all_n") - 2 * PASSES * before[0]) * F.col("w")
                     > 2 * PASSES * F.col("n") * (F.col("all_w") - before[1]))
    cap = [F.sum(F.when(F.col("capped"), F.col(c)).otherwise(0)).over(everything) for c in ("n", "w")]
    n = n.withColumn("cap_n", cap[0]).withColumn("cap_w", cap[1])
    level = (F.col("w") * (HALVES * F.col("all_n") - 2 * PASSES * F.col("cap_n"))).cast("double") / (
        2 * (F.col("all_w") - F.col("cap_w")))
    n = n.withColumn("target", F.when(F.col("capped") | (F.col("n") == 0), (PASSES * F.col("n")).cast("double"))
                     .otherwise(level))
    n = n.withColumn("blocks", F.expr(f"(n + {block - 1}) div {block}"))
    units = F.when(F.col("n") > 0, F.floor(F.col("target") / F.col("n") * F.col("blocks") * _UNIT)).otherwise(0)
    return n.select("_source", "rank", "n", "target", "blocks", units.cast("long").alias("units"))


def _permuted(seed: int) -> dict[str, str]:
    """SQL steps to the block of slot number g: affine map, rotation inside rows of a square, affine map."""
    times = "CASE WHEN blocks % {0} <> 0 THEN {0} WHEN blocks % {1} <> 0 THEN {1} ELSE {2} END".format(*_PRIMES)
    draw = "cast(conv(substring(md5(concat_ws(':', '{seed}', '{tag}', rank, pass{more})), 1, 8), 16, 10) as bigint)"
    shift = [draw.format(seed=seed, tag=t, more="") for t in ("a", "b")]
    return {
        "pass": "g div blocks",
        "side": "cast(floor(sqrt(cast(blocks as double))) as bigint)",
        "j": f"(({times}) * (g % blocks) + {shift[0]}) % blocks",
        "row": "j div side",
        "turned": "CASE WHEN row < blocks div side THEN row * side + (j % side + "
                  + draw.format(seed=seed, tag="r", more=", row") + ") % side ELSE j END",
        "block": f"(({times}) * turned + {shift[1]}) % blocks",
    }


def slots(per_source: DataFrame, shard: int, seed: int, wide: int = 1 << 16) -> DataFrame:
    """rank, block, copies: how often the mix takes each block it takes at all.

    Runs of shards with about ``wide`` slots are dealt to tasks by number.
    """
    parts = per_source.where("units > 0")
    total = parts.agg(F.coalesce(F.sum("units"), F.lit(0))).first()[0]
    shards, run = max(1, -(-total // (shard * _UNIT))), max(1, wide // shard)
    lots = -(-shards // run)
    each = parts.withColumn("offset", _draw(seed, "s", F.col("rank")) % _UNIT).withColumn(
        "lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))))
    each = each.repartition(min(lots, 1 << 14), "lot", "rank").withColumn("shard", F.explode(F.expr(
        f"sequence(lot * {run}, least((lot + 1) * {run}, {shards}L) - 1)")))
    for name, at in (("ahead", "shard"), ("until", "(shard + 1)")):
        each = each.withColumn(name, F.expr(
            f"(units div {shards}L * {at} + units % {shards}L * {at} div {shards}L + offset) div {_UNIT}"))
    g = each.where("until > ahead").withColumn("g", F.explode(F.expr("sequence(ahead, until - 1)")))
    for name, sql in _permuted(seed).items():
        g = g.withColumn(name, F.expr(sql))
    return g.groupBy("rank", "block").agg(F.count("*").alias("copies"))


def _pieces(sizes: DataFrame, per_source: DataFrame, block: int, shard: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(documents with _row, rank and place; their parts: _row, start, length, copies)."""
    rows = sizes.count()
    buckets = max(64, -(-rows // 20_000))
    label = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("_key").cast("string"), F.lit("null"))))
    known = per_source.select(F.col("_source").alias("_s"), "rank", "n", "target")
    placed = sizes.join(known, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = placed.withColumn("_label", label).withColumn("_bucket", F.shiftright(
        F.conv(F.substring("_label", 1, 8), 16, 10).cast("long") * buckets, 32))
    placed = running(placed, ["rank"], "_bucket", ["_label", "size", "_hash"], "size", "begin")
    ends = F.col("begin") + F.col("size")
    parts = placed.where("size > 0").select("_row", "rank", "begin", ends.alias("end"), F.explode(F.sequence(
        F.expr(f"begin div {block}"), F.expr(f"(begin + size - 1) div {block}"))).alias("block"))
    taken = parts.join(slots(per_source, shard, seed), ["rank", "block"])
    start = F.greatest(F.col("begin"), F.col("block") * block)
    length = F.least(F.col("end"), (F.col("block") + 1) * block) - start
    return placed, taken.select("_row", (start - F.col("begin")).alias("start"), length.alias("length"), "copies")


def mix_taken(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", block: int = 256,
              shard: int = 1024, seed: int = 7) -> DataFrame:
    """Per document: key, size (words), source_size, target (its source's), taken (words the mix takes).

    Null text has no words; a null source is a source; repeated rows are placed one after the other; a source
    without words gets none; no rows give none. Draws depend on keys, sources and ``seed`` only.
    """
    sizes = stage(sized(docs, key, text, source).withColumn("_row", F.monotonically_increasing_id()))
    per_source = stage(targets(sizes, block))
    placed, parts = _pieces(sizes, per_source, block, shard, seed)
    taken = parts.groupBy("_row").agg(F.sum(F.col("length") * F.col("copies")).alias("taken"))
    return placed.join(taken, "_row", "left").select(
        F.col("_key").alias(key), "size", F.col("n").alias("source_size"), "target",
        F.coalesce("taken", F.lit(0)).alias("taken"))


def mix_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source",
                  n_chars: str = "n_chars", block: int = 256, shard: int = 1024, seed: int = 7) -> DataFrame:
    """The mix as documents: for each taken part of a block one row with its document's columns.

    The text is the part's words with the white space between them, as often as the mix takes the block;
    ``n_chars`` (if there) is its length. Rows are numbered in a written copy, so texts meet the plan in one shuffle.
    """
    held = stage(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
                             F.monotonically_increasing_id().alias("_row")))
    known = held.select("_row", *[F.col(f"_doc.`{c}`").alias(n) for c, n in ((key, "_k"), (text, "_t"), (source, "_s"))])
    sizes = stage(sized(known, "_k", "_t", "_s", ["_row"]))
    per_source = stage(targets(sizes, block))
    _, parts = _pieces(sizes, per_source, block, shard, seed)
    plan = parts.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "copies"))).alias("_plan"))
    joined = held.join(plan, "_row").withColumn("_text", F.col(f"_doc.`{text}`"))
    words = F.regexp_extract_all("_text", F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0))
    rows = joined.withColumn("_words", words).withColumn("_p", F.explode("_plan"))
    part = F.array_join(F.slice("_words", (F.col("_p.start") + 1).cast("int"), F.col("_p.length").cast("int")), "")
    rows = rows.select("_doc", part.alias("_part"), F.explode(F.sequence(F.lit(1), F.col("_p.copies"))).alias("_copy"))
    new = {text: F.col("_part"), n_chars: F.length("_part").cast("long")}
    return rows.select(*[new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def taken_sql(block: int = 256, shard: int = 1024, seed: int = 7) -> str:
    """DuckDB SQL for the rows of ``mix_taken`` over the table documents."""
    times = "CASE WHEN blocks % {0} <> 0 THEN {0} WHEN blocks % {1} <> 0 THEN {1} ELSE {2} END".format(*_PRIMES)

    def draw(*parts):
        return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(parts)})), 1, 8) AS BIGINT)"

    case = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    return f"""
WITH sizes AS (
  SELECT row_number() OVER () AS r, doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM sizes GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, CASE (rank - 1) % {len(WEIGHTS)} {case} END::BIGINT AS w FROM s1),
s3 AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS all_n, CAST(sum(w) OVER () AS BIGINT) AS all_w,
         CAST(coalesce(sum(n) OVER b, 0) AS BIGINT) AS b_n, CAST(coalesce(sum(w) OVER b, 0) AS BIGINT) AS b_w FROM s2
       WINDOW b AS (ORDER BY CAST(n AS DOUBLE) / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, ({HALVES} * all_n - {2 * PASSES} * b_n) * w > {2 * PASSES} * n * (all_w - b_w) AS capped FROM s3),
s5 AS (SELECT *, CAST(coalesce(sum(n) FILTER (capped) OVER (), 0) AS BIGINT) AS cap_n,
         CAST(coalesce(sum(w) FILTER (capped) OVER (), 0) AS BIGINT) AS cap_w FROM s4),
s6 AS (SELECT source, rank, n, (n + {block - 1}) // {block} AS blocks, CASE WHEN capped OR n = 0
         THEN CAST({PASSES} * n AS DOUBLE)
         ELSE CAST(w * ({HALVES} * all_n - {2 * PASSES} * cap_n) AS DOUBLE) / (2 * (all_w - cap_w)) END AS target FROM s5),
per AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(target / n * blocks * {_UNIT}) AS BIGINT) ELSE 0 END AS units FROM s6),
p0 AS (SELECT *, CAST(greatest(1, ceil(CAST(sum(units) OVER () AS DOUBLE) / {shard * _UNIT})) AS BIGINT) AS shards,
         {draw("'s'", 'rank')} % {_UNIT} AS "offset" FROM per WHERE units > 0),
c0 AS (SELECT *, unnest(range(0, shards)) AS shard FROM p0),
c1 AS (SELECT *, ((units // shards) * shard + ((units % shards) * shard) // shards + "offset") // {_UNIT} AS ahead,
         ((units // shards) * (shard + 1) + ((units % shards) * (shard + 1)) // shards + "offset") // {_UNIT} AS until
       FROM c0),
g0 AS (SELECT rank, blocks, unnest(range(ahead, until)) AS g FROM c1 WHERE until > ahead),
g1 AS (SELECT *, g // blocks AS pass, CAST(floor(sqrt(CAST(blocks AS DOUBLE))) AS BIGINT) AS side FROM g0),
g2 AS (SELECT *, (({times}) * (g % blocks) + {draw("'a'", 'rank', 'pass')}) % blocks AS j FROM g1),
g3 AS (SELECT *, CASE WHEN j // side < blocks // side THEN (j // side) * side
         + (j % side + {draw("'r'", 'rank', 'pass', 'j // side')}) % side ELSE j END AS turned FROM g2),
g4 AS (SELECT rank, (({times}) * turned + {draw("'b'", 'rank', 'pass')}) % blocks AS block FROM g3),
copies AS (SELECT rank, block, count(*) AS copies FROM g4 GROUP BY ALL),
placed AS (SELECT d.r, d.doc_id, d.size, p.rank, p.n, p.target, CAST(coalesce(sum(d.size) OVER (PARTITION BY p.rank
         ORDER BY md5(concat_ws(':', '{seed}', coalesce(CAST(d.doc_id AS VARCHAR), 'null'))), d.size, d.r
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b
       FROM sizes d JOIN per p ON d.source IS NOT DISTINCT FROM p.source),
parts AS (SELECT *, unnest(range(b // {block}, (b + size - 1) // {block} + 1)) AS block FROM placed WHERE size > 0),
taken AS (SELECT r, CAST(sum((least(b + size, (block + 1) * {block}) - greatest(b, block * {block})) * copies) AS BIGINT)
         AS taken FROM parts JOIN copies USING (rank, block) GROUP BY r)
SELECT doc_id, size, n AS source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN taken USING (r)"""
