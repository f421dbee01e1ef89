"""Size-aware heavy-light Jaccard self-join of word shingles, up to connected components.

Equal sets become one node. A node's shingles are ordered by hash, those that other sets are known to hold last
(a bit filter tells, the same for all), and two sets that link share at least k of the first ``n - need + k``.
Light nodes (small sets) enumerate all 2-subsets of those as keys; heavy ones post single shingles in inverted
lists, which are scanned. The boundary between them is the one with the least cost over the sizes found. Long
lists are cut by set size, and none is expanded into all pairs: members are first compared with one pivot each, and
only what is then still in different components meets again. Short lists do so pair by pair. In long ones each member
is reduced to its differences from the pivot: two members differ by the sum of theirs less twice what these have in
common, so members far from the pivot link only if they share enough differences, and these get a prefix filter of
their own.
Every link that could join two components is tried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.records import stage, unstage
from .components import components
from .shipping import ship
from .texts import Words, lists, map_texts, mix, signed, text_chunks

#: Longest list whose members meet pair by pair after the pivots; longer ones meet by differences.
_SHORT_LIST = 16
#: Most bits of a filter that tasks hold (128 MB); smaller tables get smaller filters.
_FILTER_BITS = 30


def _need(n, percent: int):
    """Least overlap that a set of n shingles has with any set it links to."""
    return (percent * n + 99) // 100


def _pack(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return lists(signed(flat), np.array([len(p) for p in parts], np.int64))


def _sets(size: int):
    def work(data, offsets):
        return list(Words(data, offsets, lower=True).shingles(size))
    return work


def _node(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _filter_places(c, bits: int):
    m = F.lit((1 << bits) - 1)
    return F.array(c.bitwiseAND(m), F.shiftrightunsigned(c, 30).bitwiseAND(m),
                   c.bitwiseXOR(F.shiftrightunsigned(c, 17)).bitwiseAND(m))


def _in_filter(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    m = np.uint64(len(words) * 64 - 1)
    hit = np.ones(len(values), bool)
    for place in (values & m, values >> np.uint64(30) & m, (values ^ (values >> np.uint64(17))) & m):
        hit &= (words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)) == 1
    return hit


def _filter_of(values: DataFrame) -> np.ndarray:
    """Bit filter of a column of longs: about 24 bits each up to a fixed size. A false hit only costs work."""
    bits = min(_FILTER_BITS, max(20, (24 * values.count()).bit_length()))
    place = F.explode(_filter_places(F.col(values.columns[0]), bits))
    words = (
        values.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def boundary(sizes: dict[int, int], per_list: float, percent: int) -> int:
    """Largest light size: least sum of subset keys and list entries times the members each of them meets."""
    def subsets(n):
        p = n - _need(n, percent) + 2
        return p * (p - 1) / 2

    def entries(n):
        return (n - _need(n, percent) + 1) * per_list

    best, least, light = 1, None, 0.0
    for x in range(1, 401):
        light += sizes.get(x, 0) * subsets(x) if x > 1 else 0
        heavy = sum(c * entries(n) for n, c in sizes.items() if 100 * n > percent * x)
        if least is None or light + heavy < least:
            best, least = x, light + heavy
    return best


def _keys_of(tokens: np.ndarray, shared: np.ndarray, percent: int, light: int) -> tuple[int, np.ndarray]:
    """Subset keys of a light set (their number comes first), then the first shingles of one that may meet a heavy
    set, in order; shingles known as shared go last."""
    n = len(tokens)
    often = _in_filter(shared, tokens)
    tokens = np.concatenate([tokens[~often], tokens[often]])
    spare, keys = n - _need(n, percent), []
    if 1 < n <= light:
        first = np.sort(tokens[: spare + 2])
        x, y = np.triu_indices(len(first), 1)
        keys.append(mix(first[x] * np.uint64(0x9E3779B97F4A7C15) + first[y]))
    if 100 * n > percent * light:
        keys.append(tokens[: spare + 1])
    subsets = len(keys[0]) if 1 < n <= light else 0
    return subsets, np.concatenate(keys) if keys else tokens[:0]


def _per_set(docs: DataFrame, text: str, shingle, wanted, made) -> DataFrame:
    """node, n and an array for each wanted set; a task gives equal sets once, other tasks may give them again."""
    def work(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                found = []
                for s in shingle(data, offsets):
                    node = _node(s) if len(s) else None
                    if node is not None and node not in seen and wanted(node, s):
                        seen.add(node)
                        found.append((node, len(s), *made(s)))
                yield pa.RecordBatch.from_arrays([
                    *[pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))],
                    _pack([f[3] for f in found])], ["node", "n", "skip", "values"])

    return docs.select(F.col(text).cast("string")).mapInArrow(work, "node long, n int, skip int, values array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) among candidate pairs (a, b): the exact test on whole sets."""
    side = sets.select(F.col("node").alias("a"), F.col("tokens").alias("_ta"))
    other = sets.select(F.col("node").alias("b"), F.col("tokens").alias("_tb"))
    both = pairs.join(side, "a").join(other, "b")
    inter = F.size(F.array_intersect("_ta", "_tb"))
    return both.where(100 * inter >= percent * (F.size("_ta") + F.size("_tb") - inter)).select("a", "b")


def _may_link(percent: int):
    """Whether two members of a list can link: what follows the common key in each still holds the least overlap.

    At a pair's first common key no shingle before it is common, so no link is lost; later ones only repeat it.
    """
    need = F.expr(f"({percent} * (n + _n) + {99 + percent}) div {100 + percent}")
    return (F.col("n") - F.col("pos") >= need) & (F.col("_n") - F.col("_pos") >= need)


def _by_size(percent: int):
    """Keys that take the place of a long list's. Sizes of linked sets differ by a factor of 100 / percent at most, so a
    set goes into the lists of its own class of sizes and of the next one, and linked sets share one."""
    size_class = F.floor(F.log("n") / float(np.log(100 / percent) * 1.0001)).cast("int")
    return F.array(*[F.xxhash64("key", size_class + i) for i in (0, 1)])


def _labelled(postings: DataFrame, comps: DataFrame) -> DataFrame:
    """Postings of keys whose members lie in different components, with component, its least one and the list's length."""
    own = postings.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    own = stage(own)
    mixed = own.groupBy("key").agg(
        F.min("comp").alias("c"), F.max("comp").alias("d"), F.count("*").alias("long")).where("c != d").drop("d")
    out = stage(own.join(mixed, "key"))
    unstage(own)
    return out


def _known(comps: DataFrame) -> DataFrame:
    """Edges (a, b) from each node to its component: as good as all those that it was found by."""
    return comps.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _meet(outside: DataFrame, rest: DataFrame, condition) -> DataFrame:
    """Pairs under a common key and in different components; ``outside`` has its columns with a leading _."""
    return outside.join(rest, (outside["key"] == rest["key"]) & (F.col("comp") != F.col("_comp")) & condition)


def _marked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("key", *[F.col(x).alias(f"_{x}") for x in columns])


def _by_differences(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Postings by difference of (pivot, node, comp) rows: two members of a pivot and of different components that link
    share one, unless both link to the pivot.

    A set's differences are its symmetric difference with the pivot's. Two sets of n and m shingles link when they
    differ in at most ``n + m - 2 * least overlap`` places, which asks for a least overlap of their differences.
    Differences are ordered by how many members of the pivot have them, the rarest first; those that members of one
    component alone have come before all others and are only counted, as no pair of two components has them in common.
    Of two members in different components one is outside the pivot's, hence far from it.
    """
    comp_of = members.where("node = pivot").select("pivot", F.col("comp").alias("home")).distinct()
    far = members.where("node != pivot").join(comp_of, "pivot")
    mine = sets.select("node", F.col("tokens").alias("_t"))
    other = sets.select(F.col("node").alias("pivot"), F.col("tokens").alias("_p"))
    apart = far.join(mine, "node").join(other, "pivot").select(
        "pivot", "node", "comp", (F.col("comp") != F.col("home")).alias("out"), F.size("_t").alias("n"),
        F.concat(F.array_except("_t", "_p"), F.array_except("_p", "_t")).alias("diff"))
    each = stage(apart.select("pivot", "node", "comp", "out", "n", F.size("diff").alias("size"),
                              F.explode("diff").alias("token")))
    often = each.groupBy("pivot", "token").agg(
        F.count("*").alias("often"), F.min("comp").alias("c"), F.max("comp").alias("d")).where("c != d").drop("c", "d")
    found = each.join(often, ["pivot", "token"])
    whole = ["pivot", "node", "comp", "out", "n", "size"]
    # a member's differences are as bounded as its set; the order is the same for all members of a pivot
    ranked = found.groupBy(*whole).agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("shared"))
    least = each.groupBy("pivot").agg(F.min(F.when(F.col("out"), F.col("size"))).alias("low_out"),
                                      F.min("size").alias("low"))
    # least common differences with any partner: from the other component only if this one is the pivot's own, and
    # partners' numbers of differences differ by no more than the most that linked sets differ by
    most = f"n * {100 - percent} div {percent}"
    bound = F.expr(f"(size + greatest(if(out, low, low_out), size - {most}) - {most} + 1) div 2")
    # a prefix of the differences, cut before it is dealt out: what stands behind a place must still hold the least overlap
    placed = F.transform("shared", lambda t, at: F.struct(
        t["token"].alias("token"), (F.col("size") - F.size("shared") + at).alias("pos")))
    prefix = F.filter(placed, lambda t: F.col("size") - t["pos"] >= F.col("need"))
    posts = stage(
        ranked.join(least, "pivot").withColumn("need", bound)
        .select(*whole, F.explode(prefix).alias("t"))
        .select(F.xxhash64("pivot", "t.token").alias("key"), "node", "comp", "out", "n", "size", "t.pos"))
    unstage(each)
    mixed = posts.groupBy("key").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).where("c != d").select("key")
    posts, every = stage(posts.join(mixed, "key")), posts
    unstage(every)
    return posts


def _may_differ(percent: int):
    """Whether two members of a pivot can link: what follows the common difference still holds the least number in common."""
    common = F.expr(f"(size + _size - (n + _n) + 2 * (({percent} * (n + _n) + {99 + percent}) div {100 + percent}) + 1) div 2")
    return (F.col("size") - F.col("pos") >= common) & (F.col("_size") - F.col("_pos") >= common)


def links(docs: DataFrame, text: str = "text", size: int = 4,
          percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(rows, comps): every input row with _row, n_shingles and node; node, component of the linked nodes."""
    ship(docs.sparkSession)
    spark, shingle = docs.sparkSession, _sets(size)

    def counted(s):
        """What a set counts: its first shingles by hash, and a third more to take the place of shared ones."""
        return s[: (len(s) - _need(len(s), percent) + 1) * 4 // 3 + 1]

    def first_pass(data, offsets):
        sets = shingle(data, offsets)
        n = np.array([len(s) for s in sets], np.int32)
        return {"n_shingles": n, "node": pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                "prefix": _pack([counted(s) for s in sets])}

    fields = [("n_shingles", T.IntegerType()), ("node", T.LongType()), ("prefix", T.ArrayType(T.LongType()))]
    base = stage(map_texts(docs, first_pass, fields, text, [c for c in docs.columns if c != text])
                 .withColumn("_row", F.monotonically_increasing_id()))
    counts = stage(
        base.where("n_shingles > 0").select("node", F.explode("prefix").alias("token"))
        .groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"))
        .where("low != high"))
    shared = spark.sparkContext.broadcast(_filter_of(counts.select("token")))
    sizes = {r["n"]: r["count"] for r in base.where("n_shingles > 0").groupBy(
        F.least("n_shingles", F.lit(1000)).alias("n")).count().collect()}
    met = counts.agg(F.sum("n") / F.count("*")).first()[0]
    light = boundary(sizes, met or 1.0, percent)

    # keys of the sets that share a shingle of their first ones; only sets under a common key can link
    keyed = stage(_per_set(
        docs, text, shingle,
        lambda node, s: _in_filter(shared.value, counted(s)).any(),
        lambda s: _keys_of(s, shared.value, percent, light)).dropDuplicates(["node"]))
    shared.destroy()
    every = keyed.select("node", "n", "skip", F.posexplode("values").alias("at", "key")).select(
        "key", "node", "n", F.greatest(F.col("at") - F.col("skip"), F.lit(0)).alias("pos"))
    # most keys stand alone: how often each occurs is counted first, by the key only, and the others go further
    often = every.groupBy("key").agg(F.count("*").alias("long")).where("long > 1")
    posted = stage(every.join(often, "key"))
    cut = F.when(F.col("long") > _SHORT_LIST, _by_size(percent)).otherwise(F.array("key"))
    postings = posted.select(F.explode(cut).alias("key"), "node", "n", "pos")
    # the pivot is the least member in all lists alike, so a pair that is near its pivot is left to pairs with that one
    member = F.struct("node", "pos", "n")
    pivots = postings.groupBy("key").agg(F.max("node").alias("_top"), F.min(member).alias("_p")).where("_p.node != _top")
    pivots = pivots.select("key", *[F.col(f"_p.{c}").alias(f"_{c}") for c in ("pos", "node", "n")])
    postings = stage(postings.join(pivots, "key"))
    unstage(counts, keyed, posted)
    meeting = spark.sparkContext.broadcast(_filter_of(postings.select("node").distinct()))
    sets = stage(_per_set(
        docs, text, shingle, lambda node, s: _in_filter(meeting.value, np.array([node]).view(np.uint64))[0],
        lambda s: (0, s)).select("node", F.col("values").alias("tokens")).dropDuplicates(["node"]))
    meeting.destroy()

    def pairs(met: DataFrame) -> DataFrame:
        return met.where(_may_link(percent)).select(
            F.greatest("node", "_node").alias("a"), F.least("node", "_node").alias("b")).distinct()

    edges = stage(_verified(pairs(postings.where("node != _node")), sets, percent))
    held, postings = postings, postings.select("key", "node", "n", "pos", F.col("_node").alias("pivot"))
    comps = components(edges)
    rest = _labelled(postings, comps)
    unstage(held)
    outside = rest.where("comp != c").groupBy("key").agg(F.min(F.struct("pos", "node", "n", "comp")).alias("_o"))
    outside = _marked(outside.select("key", "_o.*"), ["node", "n", "pos", "comp"])
    met = _meet(outside, rest, _may_link(percent))
    comps = components(_known(comps).unionAll(_verified(pairs(met), sets, percent)))
    held, rest = rest, _labelled(rest.select("key", "node", "n", "pos", "pivot"), comps)
    unstage(edges, held)
    short = rest.where(F.col("long") <= _SHORT_LIST)
    met = _meet(_marked(short.where("comp != c"), ["node", "n", "pos", "comp"]), short, _may_link(percent))
    long = stage(rest.where(F.col("long") > _SHORT_LIST).select("pivot", "node", "comp").distinct())
    posts = _by_differences(long, sets, percent)
    # in lists of differences too, members first meet the least one, and only those still apart meet each other
    columns = ["node", "n", "size", "pos", "comp", "out"]
    heads = posts.groupBy("key").agg(F.min(F.struct(*columns)).alias("_o")).select("key", "_o.*")
    apart = _meet(_marked(heads, columns), posts, _may_differ(percent)).select(
        F.greatest("node", "_node").alias("a"), F.least("node", "_node").alias("b"))
    tried = stage(pairs(met).unionAll(apart).distinct())
    unstage(rest, long)
    comps = components(_known(comps).unionAll(_verified(tried, sets, percent)))
    rest = _labelled(posts.drop("comp"), comps)
    unstage(posts, tried)
    # of two members in different components one is outside their pivot's; two outside members meet once
    met = _meet(_marked(rest.where("out"), columns), rest,
                _may_differ(percent) & (~F.col("out") | (F.col("_node") < F.col("node"))))
    tried = stage(met.select(F.greatest("node", "_node").alias("a"), F.least("node", "_node").alias("b")).distinct())
    unstage(rest)
    comps = components(_known(comps).unionAll(_verified(tried, sets, percent)))
    unstage(sets, tried)
    return base.drop("prefix"), comps


def link_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 4,
                   percent: int = 85) -> DataFrame:
    """One row per input row: key, n_shingles, component_id (least key reachable by links).

    Words are lower-cased (A-Z) runs outside ASCII white space; a shorter text is one shingle. Rows without
    words (null or empty text) link with nothing, repeated rows and equal texts share a component, a null key
    counts for nothing unless all keys of a component are null. Other columns are ignored.
    """
    plain = docs.select(F.col(f"`{key}`").alias("_key"), F.col(text).alias("_text"))
    rows, comps = links(plain, "_text", size, percent)
    return _with_component(rows, comps, F.min("_key")).select(
        F.col("_key").alias(key), F.col("n_shingles").cast("long").alias("n_shingles"),
        F.col("_least").alias("component_id"))


def _with_component(rows: DataFrame, comps: DataFrame, least) -> DataFrame:
    """Add _least: the aggregate over each row's component; rows without words are their own."""
    linked = rows.where("node is not null")
    of_node = _of_nodes(linked, comps, least)
    alone = rows.where("node is null").withColumn("_least", F.col("_key"))
    return linked.join(of_node, "node").select(*rows.columns, "_least").unionByName(alone)


def _of_nodes(linked: DataFrame, comps: DataFrame, least) -> DataFrame:
    """node, _least: the least value of the aggregate over the node's component."""
    nodes = linked.groupBy("node").agg(least.alias("_own")).join(comps, "node", "left")
    nodes = stage(nodes.withColumn("component", F.coalesce("component", "node")))
    best = nodes.groupBy("component").agg(F.min("_own").alias("_least"))
    return nodes.select("node", "component").join(best, "component").select("node", "_least")


def keep_one_each(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5,
                  percent: int = 80) -> DataFrame:
    """The documents without near duplicates: of each component the one with the least key (null last) stays.

    All columns stay. Of rows alike in key and shingles one stays; rows without words link with nothing and stay.
    """
    plain = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    rows, comps = links(plain, "_text", size, percent)
    first = F.min(F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("node")))
    kept = _of_nodes(rows.where("node is not null"), comps, first).select(
        F.col("_least.key").alias("_kept"), F.col("_least.node").alias("_node")).distinct()
    shingle = _sets(size)

    def node_of(data, offsets):
        return {"_n": pa.array([_node(s) if len(s) else None for s in shingle(data, offsets)], pa.int64())}

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
                        F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    whole = map_texts(whole, node_of, [("_n", T.LongType())], "_text", ["_doc", "_key"])
    found = whole.join(kept, (F.col("_n") == F.col("_node")) & F.col("_key").eqNullSafe(F.col("_kept")))
    one = F.row_number().over(W.partitionBy("_n", "_key").orderBy(F.xxhash64(f"_doc.`{text}`")))
    found = found.withColumn("_i", one).where("_i = 1")
    return found.select("_doc.*").unionByName(whole.where("_n is null").select("_doc.*"))
