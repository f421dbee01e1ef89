"""One registered query per operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bitslices, chat, jaccard, mixing, neighbours, packing, pii, prefix_trie, quality_model, quality_rules, substring,
    token_counts, turn_repair,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query
def op1_chat_formatting(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    formatted = chat.format_conversations(rows.unionByName(own))
    return chat.digests(chat.read_back(formatted))


def _escaped_length(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for control in chat.MarkedTemplate.controls:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return f"length({out})"


SQL["op1_chat_formatting"] = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || said || chr(10), '' ORDER BY turn NULLS FIRST, role, said) AS turns,
    coalesce(string_agg(said, '' ORDER BY turn NULLS FIRST, role, said) FILTER (role = 'assistant'), '') AS loss,
    CAST(sum(16 + {_escaped_length('role')} + {_escaped_length('said')}) AS BIGINT) AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars FROM c"""


@_query
def op2_substring_dedup(spark, sf_dir):
    return substring.repeated_passages(_read(spark, sf_dir, "documents"))


@_query
def op3_mixing(spark, sf_dir):
    return mixing.mix_taken(_read(spark, sf_dir, "documents"))


SQL["op3_mixing"] = mixing.taken_sql()


@_query
def op4_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"))


@_query
def op5_quality_classifier(spark, sf_dir):
    return quality_model.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@_query
def op6_personal_data(spark, sf_dir):
    return pii.find_personal_data(_read(spark, sf_dir, "documents"))


@_query
def op7_jaccard_join(spark, sf_dir):
    return jaccard.link_documents(_read(spark, sf_dir, "documents"))


SQL["op7_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE
    list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.r < b.r GROUP BY ALL),
pairs AS (
  SELECT a, b FROM shared JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
sides AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
least AS (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least.component_id
FROM d JOIN least USING (r) LEFT JOIN n USING (r)"""


@_query
def op8_packing(spark, sf_dir):
    return packing.pack(_read(spark, sf_dir, "documents"))


@_query
def op9_quality_rules(spark, sf_dir):
    return quality_rules.rate(_read(spark, sf_dir, "documents"))


@_query
def op10_token_counts(spark, sf_dir):
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"))


@_query
def op12_bit_sliced_top_k(spark, sf_dir):
    return bitslices.top_products(_read(spark, sf_dir, "embeddings"))


SQL["op12_bit_sliced_top_k"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64.0::DOUBLE * x::DOUBLE)) AS e
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER best AS INTEGER) AS rank, c.vec_id,
  CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.r <> q.r
WINDOW best AS (PARTITION BY q.r ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id NULLS LAST)
QUALIFY row_number() OVER best <= 20"""


def _crc32_sql(s: str) -> str:
    """Unsigned CRC-32 of a text of ASCII letters, a bit at a time."""
    bits = f"flatten(list_transform(range(1, length({s}) + 1), lambda i: [ascii(substr({s}, i, 1)), 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))"
    return f"xor(list_reduce(list_transform({bits}, lambda b: b::BIGINT), lambda c, x: {step}, 4294967295::BIGINT), 4294967295)"


@_query
def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.rebuilt_trie(_read(spark, sf_dir, "conversations"))


SQL["op13_prefix_trie"] = f"""
WITH t AS (
  SELECT conv_id, turn, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said,
    length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(said)) AS pos FROM t),
h AS (SELECT conv_id, {_crc32_sql('CAST(conv_id AS VARCHAR)')} % 6 AS h, conv_id - conv_id % 100 AS src
      FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT h.conv_id, 0 AS part, n.pos, said, chars FROM h JOIN n ON n.conv_id = h.src AND n.pos <= h.h
      UNION ALL SELECT h.conv_id, 1, n.pos, said, chars FROM h JOIN n ON n.conv_id = h.conv_id AND n.pos > h.h),
p AS (SELECT conv_id, chars, row_number() OVER w AS depth, list(said) OVER w AS path FROM r
      WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
m AS (SELECT conv_id, chars, depth, path FROM p UNION ALL SELECT conv_id, 0, 0, [] FROM h),
l AS (SELECT conv_id, max(depth) AS last FROM m GROUP BY conv_id),
node AS (
  SELECT path, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS spared,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last = depth), '')) AS ends_sha256
  FROM m JOIN l USING (conv_id) GROUP BY path),
kids AS (SELECT path[:-2] AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
known AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (path)),
up AS (SELECT path[:i] AS path, spared, n_children FROM (
  SELECT unnest(range(0, depth + 1)) AS i, path, spared, n_children FROM known)),
subs AS (SELECT path, CAST(sum(spared) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
        FROM up GROUP BY path)
SELECT k.conv_id, k.depth, parent.conv_id AS parent_conv_id, k.n_convs, k.n_children, subs.n_leaves, subs.saved_tokens,
  k.ends_sha256
FROM known k JOIN subs USING (path) LEFT JOIN node parent ON k.depth > 0 AND parent.path = k.path[:-2]"""


@_query
def op11_turn_repair(spark, sf_dir):
    rows = turn_repair.damage(_read(spark, sf_dir, "conversations"))
    return turn_repair.repair_report(rows, present=F.col("present"))


def _repair_sql() -> str:
    """The same repairs as a walk over the rows: of four states the least (cost, edits), every path written out."""
    def after(s, cost, edits, lines=()):
        out = f"list_concat({s}.o, [{', '.join(lines)}])" if lines else f"{s}.o"
        return f"struct_pack(c := {s}.c + {cost}, a := {s}.a || {edits}, o := {out})"

    def least(*paths):
        return f"list_sort([{', '.join(paths)}])[1]"

    keep = "CASE WHEN cut THEN 5 ELSE 0 END"
    step = {c: (f"{keep} + CASE WHEN gone THEN 1000000000 WHEN i = '{c}' THEN 0 ELSE 1 END",
                f"CASE WHEN i = '{c}' THEN 'K' ELSE 'R' END",
                f"CASE WHEN i = '{c}' THEN role ELSE '{name}' END || ':' || said")
            for c, name in (("u", "user"), ("a", "assistant"))}
    put = {"u": "'user:'", "a": "'assistant:'"}

    def said(s, c, *inserts):
        cost, edit, line = step[c]
        before = "".join("I" for _ in inserts)
        return after(s, f"{5 * len(inserts)} + {cost}", f"'{before}' || {edit}", [*[put[x] for x in inserts], line])

    gone = {s: after(s, 2, "'D'") for s in ("s0", "s1", "s2", "s3")}
    system = after("s0", f"{keep} + CASE WHEN gone OR i <> 's' THEN 1000000000 ELSE 0 END", "'K'", ["role || ':' || said"])
    new = {
        "s0": gone["s0"], "s1": least(gone["s1"], system),
        "s2": least(gone["s2"], *[said(s, "u") for s in ("s0", "s1", "s3")], said("s2", "u", "a"),
                    *[said(s, "u", "u", "a") for s in ("s0", "s1", "s3")]),
        "s3": least(gone["s3"], said("s2", "a"), *[said(s, "a", "u") for s in ("s0", "s1", "s3")],
                    said("s2", "a", "a", "u"))}
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    mark = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    none = "struct_pack(c := {}::BIGINT, a := '', o := []::VARCHAR[])"
    return f"""
WITH RECURSIVE b AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS g, conv_id, turn, {_crc32_sql('mark')} % 20 AS kind,
    coalesce(role, ' ') AS role, coalesce(text, ' ') AS said FROM (SELECT *, {mark} AS mark FROM conversations)),
d AS (
  SELECT g, turn, unnest(CASE kind WHEN 3 THEN [0, 1] WHEN 0 THEN []::INTEGER[] ELSE [0] END) AS copy,
    CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(said, '[.!?]', '', 'g') ELSE said END AS said FROM b),
f AS (
  SELECT *, substr(role, 1, 1) AS i, right(rtrim(said, {white}), 1) AS final,
    row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, said) AS nth FROM d),
f2 AS (SELECT *, row_number() OVER (PARTITION BY g, role, said ORDER BY nth) > 1 AS seen FROM f),
r AS (SELECT *, final = '' AS blank, final <> '' AND seen AS dup,
        final NOT IN ('', '.', '!', '?') AND NOT seen AS cut, final = '' OR seen AS gone,
        lag(i) OVER (PARTITION BY g ORDER BY nth) || i AS pair FROM f2),
w(g, nth, s0, s1, s2, s3) AS (
  SELECT DISTINCT g, 0::BIGINT, {none.format(0)}, {none.format(10**9)}, {none.format(10**9)}, {none.format(10**9)} FROM r
  UNION ALL
  SELECT w.g, r.nth, {new['s0']}, {new['s1']}, {new['s2']}, {new['s3']} FROM w JOIN r ON r.g = w.g AND r.nth = w.nth + 1),
e AS (
  SELECT g, list_sort([s0, s3, {after('s2', 5, "'I'", [put['a']])}, {after('s1', 10, "'II'", [put['u'], put['a']])}])[1] AS best
  FROM w JOIN (SELECT g, max(nth) AS nth FROM r GROUP BY g) USING (g, nth)),
n AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY g)
SELECT DISTINCT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256
FROM b LEFT JOIN n USING (g) LEFT JOIN e USING (g)"""


SQL["op11_turn_repair"] = _repair_sql()
