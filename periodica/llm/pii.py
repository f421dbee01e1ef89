"""Personal data by candidate gradient boosting, with DataFrame functions and MLlib trees alone.

High-recall patterns propose overlapping spans. Base spans that pass their kind's exact rule always count. Boosted
trees, fitted to that verdict on one half of all base spans from format and context (not from the rule's own
arithmetic), score all others; those above a threshold calibrated on the other half are added. The rule has
no verdict on wider spans, so they teach nothing; they are scored as written in base format, and those whose digits
pass need a half only, or no score if their kind's base spans all pass.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.records import stage

KINDS = ("email", "ip", "card", "phone")
#: (kind, whether the exact rule applies, pattern). Possessive forms and the look-behinds keep matching linear and
#: leave the leftmost non-overlapping matches as the plain forms find them.
PATTERNS = (
    ("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", True, r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", True, r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"),
    ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++"
                     r"(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?)[A-Za-z0-9-]++)++"),
    ("card", False, r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{1,2}[0-9]{3,6}){2,4}(?![0-9])"),
    ("phone", False, r"(?<![0-9+])(?:00[0-9]{1,3}[\x20./-])?\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3}[\x20./-][0-9]{3,4}(?![0-9])"),
)
_AROUND = 24
_HINTS = "(?i)(mail|phone|tel|call|fax|mobile|card|visa|pay|account|iban|host|server|address|contact|ip)"
FEATURES = ("f_length", "f_digits", "f_groups", "f_longest", "f_dots", "f_dashes", "f_blanks", "f_brackets", "f_letters",
            "f_hint", "f_before", "f_after", *(f"f_{k}" for k in KINDS))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i):
        d = F.substring(F.reverse(digits), i, 1).cast("int")
        return F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))
    values = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), value)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _exact(kind: Column, found: Column) -> Column:
    """Whether a match passes its kind's rule; of wider ones the digits alone."""
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    n = F.length(_digits(found))
    card = n.between(14, 19)
    return (
        F.when(kind == "email", True).when(kind == "ip", found.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
        .when(kind == "card", card & F.when(card, _luhn(_digits(found))).otherwise(False))
        .otherwise(n.between(10, 15))
    )


def _matches(text: Column, i: int, pattern: str) -> Column:
    """One pattern's matches: each with the length of the gap before it and the text around it."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    def item(m, k):
        return F.struct(
            F.lit(i).alias("rule"), k.alias("at"), m.alias("found"), F.length(F.get(gaps, k)).alias("gap"),
            F.right(F.get(gaps, k), F.lit(_AROUND)).alias("before"),
            F.left(F.get(gaps, k + 1), F.lit(2)).alias("after"))
    return F.transform(found, item)


def _plain(kind: Column, base: Column, found: Column) -> Column:
    """A match in the format of base spans, so that the trees know its features: of wider ones other marks replaced."""
    def written(*marks):
        out = found
        for mark, by in marks:
            out = F.regexp_replace(out, mark, by)
        return out
    return (
        F.when(base, found)
        .when(kind == "email", written((r"\x20?[(\[](?:at|AT)[)\]]\x20?", "@"), (r"\x20?[(\[](?:dot|DOT)[)\]]\x20?", ".")))
        .when(kind == "card", written((r"[\x20./_-]+", " "))).otherwise(written((r"[./]", "-")))
    )


def may_hold(text: Column) -> Column:
    """Whether any pattern can match at all."""
    return text.rlike("[0-9@]|[(\\[](?:at|AT)[)\\]]")


def candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, base, passes, exact, start, end (code points, end exclusive) and features of every proposed span."""
    c = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    none = F.array().cast("array<struct<rule:int,at:int,found:string,gap:int,before:string,after:string>>")
    parts = []
    for i, (kind, base, pattern) in enumerate(PATTERNS):
        need = c.contains("@") if kind == "email" and base else c.rlike("[(\\[](?:at|AT)[)\\]]") if kind == "email" else (
            c.rlike("\\+[0-9]") if kind == "phone" and base else c.rlike("[0-9]"))
        parts.append(F.when(need, _matches(c, i, pattern)).otherwise(none))
    found = docs.where(may_hold(c)).select(F.col(f"`{key}`").alias("_id"), F.flatten(F.array(*parts)).alias("_m"))
    rows = found.select("_id", F.explode("_m").alias("_x")).select("_id", "_x.*")
    rows = stage(rows)
    order = W.partitionBy("_id", "rule").orderBy("at")
    until = F.sum(F.col("gap") + F.length("found")).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("end", until.cast("int")).withColumn("start", (F.col("end") - F.length("found")).cast("int"))
    kind = F.element_at(F.array(*[F.lit(k) for k, _, _ in PATTERNS]), F.col("rule") + 1)
    base = F.element_at(F.array(*[F.lit(b) for _, b, _ in PATTERNS]), F.col("rule") + 1)
    rows = rows.withColumn("kind", kind).withColumn("base", base).withColumn(
        "passes", _exact(F.col("kind"), F.col("found"))).withColumn("exact", F.col("base") & F.col("passes"))
    f = _plain(F.col("kind"), F.col("base"), F.col("found"))
    groups = F.filter(F.split(f, "[^0-9]+"), lambda g: g != "")
    longest = F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0))
    values = [F.length(f), F.length(_digits(f)), F.size(groups), longest, *[
        F.regexp_count(f, F.lit(p)) for p in ("[.]", "-", "\\x20", "[()\\[\\]]", "[A-Za-z]")],
        F.col("before").rlike(_HINTS).cast("int"),
        *[F.when(c == "", 0).when(c.rlike("[A-Za-z]"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike("[\\s,;:]"), 3).otherwise(4)
          for c in (F.right("before", F.lit(1)), F.left("after", F.lit(1)))],
        *[(F.col("kind") == k).cast("int") for k in KINDS]]
    return rows.select("_id", "kind", "base", "passes", "exact", "start", "end", *[
        v.cast("double").alias(n) for n, v in zip(FEATURES, values, strict=True)])


def fit(found: DataFrame, precision: float = 0.98, least: int = 20):
    """(model, threshold, sure) from all base spans, or None without enough of both verdicts.

    One half (by hash) fits the trees. On the other the threshold is the lowest hundredth above which the share
    of exact spans is at least ``precision``; none is lower than a half, and it is above all scores if the share
    is never reached. Kinds whose base spans all pass are sure: trees cannot tell their spans apart.
    """
    mark = F.xxhash64("_id", "kind", "start", "end")
    # in one order, as equally good splits hinge on the order of addition
    rows = stage(found.where("base").withColumn("_mark", mark).orderBy("_mark", "start", "end").select(
        "*", F.col("exact").cast("double").alias("label"), (F.col("_mark") % 2 == 0).alias("_fit")))
    counts = {(r["_fit"], r["exact"]): r["count"] for r in rows.groupBy("_fit", "exact").count().collect()}
    if any(counts.get((f, e), 0) < least for f in (True, False) for e in (True, False)):
        return None
    sure = [r["kind"] for r in rows.groupBy("kind").agg(F.min("exact").alias("all")).where("all").collect()]
    model = GBTClassifier(maxIter=10, maxDepth=3, seed=11).fit(_vectors(rows.where("_fit")))
    tried = _scored(rows.where("NOT _fit"), model).groupBy(F.floor(F.col("p") * 100).alias("b")).agg(
        F.sum("label").alias("yes"), F.count("*").alias("n")).collect()
    yes = n = 0.0
    threshold = 2.0
    for r in sorted(tried, key=lambda r: -r["b"]):
        yes, n = yes + r["yes"], n + r["n"]
        if r["b"] >= 50 and yes >= precision * n:
            threshold = r["b"] / 100
    return model, threshold, sure


def _vectors(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


def _scored(df: DataFrame, model) -> DataFrame:
    out = model.transform(_vectors(df))
    return out.withColumn("p", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction")


def spans(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """_id, kind, start, end, exact of all chosen spans; an added span overlaps no other of its kind.

    Wider spans that an exact one of any kind covers (parts of addresses, say) are not scored, and a span whose digits
    fail its rule is not added where an added one whose digits pass covers it (a dotted card is no address).
    """
    found = stage(candidates(docs, key, text))
    got = fit(found)
    base = found.where("exact").select("_id", "kind", "start", "end", "exact")
    if got is None:
        return base
    model, threshold, sure = got
    so_far = W.partitionBy("_id").orderBy("start").rangeBetween(W.unboundedPreceding, 0)
    reach = F.coalesce(F.max(F.when(F.col("exact"), F.col("end"))).over(so_far), F.lit(0))
    rest = found.withColumn("_reach", reach).where("NOT exact AND (base OR _reach < end)").drop("_reach")
    least = F.when(F.col("base") | ~F.col("passes"), threshold).when(F.col("kind").isin(sure), 0.0).otherwise(0.5)
    more = _scored(rest, model).where(F.col("p") >= least)
    over = F.coalesce(F.max(F.when(F.col("passes"), F.col("end"))).over(so_far), F.lit(0))
    more = more.withColumn("_over", over).where("passes OR _over < end").select("_id", "kind", "start", "end", "exact")
    by_kind = W.partitionBy("_id", "kind").orderBy("start", F.desc("end"))
    both = base.unionByName(more.distinct())
    # an added span gives way to exact ones before or after it and to the added one before it
    before = by_kind.rowsBetween(W.unboundedPreceding, -1)
    after = by_kind.rowsBetween(1, W.unboundedFollowing)
    clear = (F.coalesce(F.max("end").over(before), F.lit(0)) <= F.col("start")) & (
        F.coalesce(F.min(F.when(F.col("exact"), F.col("start"))).over(after), F.col("end")) >= F.col("end"))
    return both.withColumn("_clear", F.col("exact") | clear).where("_clear").drop("_clear")


def _order() -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))


def find_personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: key, counts of base spans per kind, base_sha256 and spans (all of them).

    Null text counts as empty and has none, a null key stays null, repeated rows are searched again, other columns
    are ignored, no rows give none.
    """
    base = stage(docs.select(F.col(f"`{key}`").alias("_key"), F.when(
        may_hold(F.col(f"`{text}`")), F.col(f"`{text}`")).alias("_text")).withColumn(
        "_row", F.monotonically_increasing_id()))
    chosen = spans(base, "_row", "_text")
    label = F.concat_ws(":", "kind", "start", "end")
    item = F.struct(F.col("start").alias("start"), _order().alias("o"), F.col("end").alias("end"), label.alias("label"))
    def listed(c):
        return F.array_join(F.transform(F.sort_array(c), lambda x: x["label"]), ",")
    per = chosen.groupBy("_id").agg(
        *[F.sum((F.col("exact") & (F.col("kind") == k)).cast("long")).alias(f"n_{k}") for k in KINDS],
        listed(F.collect_list(F.when(F.col("exact"), item))).alias("_base"),
        listed(F.collect_list(item)).alias("spans"))
    joined = base.select("_row", "_key").join(per, F.col("_row") == F.col("_id"), "left")
    return joined.select(
        F.col("_key").alias(key), *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents with every chosen span replaced by its kind in brackets; ``n_chars`` (if there) follows.

    Overlapping spans become one, named by the first. Texts that cannot match any pattern are not shuffled; the
    others meet their spans by the digest of the text, so equal texts are redacted alike.
    """
    c = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    risky = docs.where(may_hold(c)).withColumn("_digest", F.md5(c))
    texts = risky.select("_digest", F.col(f"`{text}`").alias("_text"))
    firsts = texts.groupBy("_digest").agg(F.first("_text").alias("_text"))
    found = spans(firsts, "_digest", "_text")
    order = W.partitionBy("_id").orderBy("start", F.desc("end"), _order())
    new = F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1)) <= F.col("start")
    runs = found.withColumn("_run", F.sum(new.cast("int")).over(order))
    merged = runs.groupBy("_id", "_run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.min_by("kind", F.struct("start", -F.col("end"), _order())).alias("kind"))
    plan = merged.groupBy(F.col("_id").alias("_digest")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("_plan"))
    joined = risky.join(plan, "_digest", "left")
    zero = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("kind")))
    last = F.array(F.struct(F.length(c).alias("start"), F.length(c).alias("end"), F.lit("").alias("kind")))
    whole = F.concat(zero, "_plan")
    parts = F.zip_with(whole, F.concat("_plan", last), lambda a, b: F.concat(
        F.when(a["kind"] == "", "").otherwise(F.concat(F.lit("["), F.upper(a["kind"]), F.lit("]"))),
        F.substring(c, a["end"] + 1, b["start"] - a["end"])))
    out = F.when(F.col("_plan").isNull(), F.col(f"`{text}`")).otherwise(F.array_join(parts, ""))
    clean = joined.withColumn("_new", out)
    clean = clean.select(*[
        (F.col("_new") if x == text else F.when(F.col("_plan").isNull(), F.col(f"`{x}`")).otherwise(
            F.length("_new").cast("long")) if x == n_chars else F.col(f"`{x}`")).alias(x) for x in docs.columns])
    return docs.where(~may_hold(c)).unionByName(clean)
