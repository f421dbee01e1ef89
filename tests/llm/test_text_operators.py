"""Every text operator against a brute-force version, on edge cases and on the small tables."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from oracle_check import _KINDS, compare
from tokenizers import Tokenizer

import corpus_pipeline
from periodica.llm import (chat, components, jaccard, mixing, neighbours, packing, pii, pretokens, quality_model,
                           quality_rules, queries, substring, token_counts)

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, _key string, size long"
PASSAGE = " ".join(f"word{i} of" for i in range(40)) + "."
ODD = [None, "", " \n\t ", "One.", "a b c", "été <|endoftext|> x  y\n\n'll 's ''s", "x" * 50_000,
       "joe@mail.example.com, 10.0.0.1 and 4111 1111 1111 1111 or +1 (415) 555-2671.", PASSAGE, "Intro. " + PASSAGE,
       PASSAGE, "a@b.c_d@e.f 1.2.3.4.5 999.1.1.1 +12", "The same line\n" * 30]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, 0, 1, "k", 2)
            for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + rows[-1:], SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def con():
    _KINDS["INTEGER"] = "int"
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, con, name):
    message, rows = compare(spark, con, SF, name, queries.QUERIES[name], queries.SQL[name])
    assert message is None and rows > 0, message


def test_template_is_reversible_and_rewrites_show(spark):
    t = chat.MarkedTemplate()
    for s in ("</s>", "\\</s>\\", "<\\/s>", "[INST][/INST]\n", "a\nb", "\\\n."):
        assert t.unescape(t.escape(s)) == s and t.parse(t.render([(s, s)])) == (s, s)
        assert not any(c in t.escape(s) for c in t.controls)
    def only_last(turns):
        return f"{len(turns)}:{turns[-1][1]}"
    assert chat.locate(only_last, [("user", "a"), ("assistant", "b")], {"assistant"})[2] == 1
    rows = spark.createDataFrame([(None, None, None, None), (1, 0, "assistant", None), (1, 0, "assistant", "B</s>A")],
                                 "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(chat.format_conversations(rows))).collect()}
    assert got[1]["loss_chars"] == 6 and got[None]["n_turns"] == 1
    assert chat.format_conversations(rows.limit(0)).count() == 0


def test_passages(spark, odd, empty):
    got = substring.repeated_passages(odd).where("n_words >= 60").collect()
    assert {8, 9, 10} <= {r["doc_id"] for r in got} and not any(r["doc_id"] in (5, 7, 11) for r in got)
    data = np.frombuffer(PASSAGE.encode(), np.uint8)
    ends = substring.cuts(data).tolist()
    moved = substring.cuts(np.frombuffer(b"Zz, new start. " + data.tobytes(), np.uint8)) - 15
    assert ends[-1] == len(data) and len(set(ends) & set(moved.tolist())) >= len(ends) - 2
    cut = {r["doc_id"]: r["text"] for r in substring.cut_repeats(odd.where("doc_id IN (7, 8, 9)")).collect()}
    assert cut[8] == PASSAGE and cut[7] == ODD[7] and len(cut[9]) < 100
    assert substring.repeated_passages(empty).count() == 0


def test_words_that_a_power_of_two_confuses(spark):
    """A Thue-Morse word of two letters and its complement are different words, lines, shingles and pre-tokens."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = ("".join(x[b] for b in bits) for x in ("ab", "ba"))
    rows = spark.createDataFrame([(0, f"{one}\n{two}\nEnd"), (1, f"{one} x y z"), (2, f"{two} x y z"), (3, one), (4, two)],
                                 "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source")
    stats = {r["doc_id"]: r for r in quality_rules.rate(rows).collect()}
    assert stats[0]["n_dup_lines"] == 0
    assert {r["component_id"] for r in jaccard.link_documents(rows).collect()} == {0, 1, 2, 3, 4}
    tok = Tokenizer.from_file(pretokens.default_path())
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in ((3, one), (4, two))}
    for r in packing.pack(rows.where("doc_id > 2")).collect():
        piece = np.array(ids[r["doc_id"]][r["start"]: r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(piece.tobytes())
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(rows).collect()}
    assert all(counts[i] == len(x) - 1 for i, x in ids.items())


def test_mix(spark, odd, empty, docs):
    taken = {r["doc_id"]: r for r in mixing.mix_taken(odd).collect()}
    assert len(taken) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in taken.values())
    mixed = mixing.mix_documents(docs).collect()
    words = Counter()
    for r in mixed:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    rows = mixing.mix_taken(docs).collect()
    assert all(words[r["doc_id"]] == r["taken"] for r in rows)
    # one small source, one block and one word beside a large one and many shards: each within two blocks of its target
    many = spark.range(3000).selectExpr("id AS doc_id", "concat('s', least(id, 3)) AS source",
                                        "repeat('w ', CASE id WHEN 0 THEN 2000 WHEN 1 THEN 256 WHEN 2 THEN 1 ELSE 97 END) AS text")
    for rows in (mixing.mix_taken(docs).collect(), mixing.mix_taken(many, shard=8).collect()):
        got, want = Counter(), {}
        for r in rows:
            got[r["source_size"], r["target"]] += r["taken"]
        assert all(abs(n - target) <= 2 * 256 for (_, target), n in got.items())
    assert mixing.mix_taken(empty).count() == 0


def test_neighbours(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    bad = spark.createDataFrame([(0, None), (20, [0.0] * 64), (40, [float("nan")] * 64), (60, [None] * 64)],
                                "vec_id long, embedding array<float>")
    got = neighbours.nearest(e.select("vec_id", "embedding").unionByName(bad)).toPandas()
    p = e.toPandas()
    x, ids, hit = np.stack(p.embedding).astype(float), p.vec_id.to_numpy(), 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert len(mine) == 20 and np.allclose(mine.score, s[np.searchsorted(ids, mine.vec_id)])
        hit += len(set(mine.vec_id) & set(ids[np.lexsort((ids, -s))[:20]]))
    assert hit / len(got) >= 0.9
    assert neighbours.nearest(bad).count() == 0


def test_probes_hold_for_vectors_out_of_the_fit():
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((1024, 32)), rng.standard_normal((1024, 32))
    router = neighbours.fit(x, 32, 20)
    near = neighbours._nearest(y, y, 20, np.arange(len(y)))
    chances = router.chances(y)
    rank = np.argsort(np.argsort(-chances, axis=1), axis=1)
    assert (rank[np.arange(len(y))[:, None], chances.argmax(axis=1)[near]] < router.probes).mean() >= 0.93


def test_small_parts_are_not_the_end(spark, monkeypatch):
    """One query in a part of five rows, with one part to visit."""
    one = np.eye(8)
    monkeypatch.setattr(neighbours, "fit", lambda *a: neighbours.Router(one, np.zeros(8), 9 * one, np.zeros(8), 1))
    rng, part = np.random.default_rng(6), [1 if i < 5 else 0 if i < 150 else 2 for i in range(200)]
    rows = spark.createDataFrame([(i, (one[p] * 4 + rng.random(8)).tolist()) for i, p in enumerate(part)],
                                 "vec_id long, embedding array<double>")
    got = Counter(r["query_id"] for r in neighbours.nearest(rows).collect())
    assert got == {q: 20 for q in range(0, 200, 20)}


def test_quality_model(spark, odd, empty):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.score_documents(d, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9
    rest = quality_model.score_documents(odd, labels.limit(0)).collect()
    assert len(rest) == len(ODD) + 1 and all(abs(r["score"] - 0.5) < 1e-9 for r in rest)
    assert quality_model.score_documents(empty, labels.limit(0)).count() == 0


def _base_spans(text):
    forms = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "card": r"[0-9]([\x20-]?[0-9])+",
             "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for order, kind in enumerate(pii.KINDS):
        for m in re.finditer(forms[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(c) * 2 - 9 * (c > "4") if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
            ok = {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")),
                  "card": 14 <= len(digits) <= 19 and sum(double) % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_personal_data(odd, empty, docs):
    rows = odd.select("doc_id", "text").unionByName(docs.select((docs.doc_id + 1000).alias("doc_id"), "text"))
    got = pii.find_personal_data(rows).collect()
    want = Counter((r["doc_id"], hashlib.sha256(_base_spans(r["text"]).encode()).hexdigest()) for r in rows.collect())
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == want
    text = {r["doc_id"]: r["text"] for r in pii.redact(odd).collect()}
    assert text[7] == "[EMAIL], [IP] and [CARD] or [PHONE]." and text[0] is None and len(text) == len(ODD)
    assert pii.find_personal_data(empty).count() == 0


def test_wider_personal_data(spark):
    """Spans of the wider patterns are found next to base spans that pass and fail their rules."""
    def card(i, good):
        body = f"{4000 + i:04d}{i * 7919 % 10**8:08d}{i % 1000:03d}"
        double = [int(c) if k % 2 else int(c) * 2 - 9 * (c > "4") for k, c in enumerate(reversed(body))]
        n = body + str((-sum(double) + (0 if good else 3)) % 10)
        return " ".join(n[k: k + 4] for k in range(0, 16, 4))
    texts = []
    for i in range(300):
        phone = (f"+1 ({200 + i}) 555-{1000 + i}", f"+44 {200 + i} 555-{1000 + i}", f"+{2000000000 + i}")[i % 3]
        texts.append(f"Write to ann{i}@mail{i % 7}.example.com or call {phone} now.")
        texts.append(f"Host 10.{i % 250}.3.{i % 99} has {i + 10} rows in {1990 + i % 30}, code 300.{i}.2.1 or +44 {i + 100} 12.")
        texts.append(f"Paid by card {card(i, i % 4 > 0)} today.")
    wide = {"email": "joe (at) mail (dot) com", "phone": "(415) 555-2671", "card": "4111.1111.1111.1111"}
    says = {"email": "Write to {} or", "phone": "You may call {} now.", "card": "Paid by card {} today."}
    first = len(texts)
    texts += [says[k].format(wide[k]) for k in wide] + ["Paid by card 4111 1111 1111 1111 today.", "Host 10.218.129.44 is up."]
    rows = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(rows).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(rows).collect()}
    for i, k in enumerate(wide, first):
        at = texts[i].index(wide[k])
        assert got[i] == f"{k}:{at}:{at + len(wide[k])}" and clean[i] == says[k].format(f"[{k.upper()}]")
    assert got[first + 3] == "card:13:32" and got[first + 4] == "ip:5:18"


def test_near_duplicates(spark, odd, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(odd).collect()}
    assert got[8] == (77, 8) and got[10] == (77, 8) and got[9] == (78, 8) and got[0] == (0, 0) and got[4] == (1, 4)
    kept = jaccard.keep_one_each(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {0, 1, 2, 4, 8}
    assert jaccard.link_documents(empty).count() == 0
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert set(found[i] for i in range(1, 41)) == {1} and found[60] == 50


@pytest.mark.parametrize("short", [2, 16])
def test_near_duplicates_around_the_threshold(spark, monkeypatch, short):
    """A large group of edited copies, most a little too far apart to link, against all pairs."""
    monkeypatch.setattr(jaccard, "_SHORT_LIST", short)
    rng, base = np.random.default_rng(5), [f"w{i}" for i in range(60)]
    texts = [" ".join(base)]
    for i in range(250):
        words = list(base)
        for at in rng.choice(60, rng.integers(1, 5), replace=False):
            words[at] = f"e{i}x{at}" if rng.random() < 0.7 else f"e{at}"
        texts.append(" ".join(words[: 60 - int(rng.integers(0, 6))]))
    sets = [set(zip(*[t.split()[k:] for k in range(4)], strict=False)) for t in texts]
    least = list(range(len(sets)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    for _ in sets:
        before = list(least)
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
        if before == least:
            break
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link_documents(rows).collect()}
    assert got == dict(enumerate(least)) and 10 < len(set(least)) < 240


def test_differences_posted_per_member(spark, monkeypatch):
    """Members far from their pivot post no more differences than two linked sets may differ by, whoever is close to it."""
    rng, written = np.random.default_rng(3), []
    tokens = {0: list(range(100)), 1: [*range(2, 100), 900, 901]}
    for i in range(2, 62):
        tokens[i] = [*range(50), *(int(t) for t in rng.choice(np.arange(200, 300), 50, replace=False))]
    tokens[62] = [*tokens[61][:-2], 950, 951]
    sets = spark.createDataFrame(list(tokens.items()), "node long, tokens array<long>")
    members = spark.createDataFrame([(0, i, max(i, 1) - 1) for i in tokens], "pivot long, node long, comp long")
    kept = jaccard.stage

    def counted(df):
        out = kept(df)
        if {"pos", "size"} <= set(out.columns):
            written.append(out.groupBy("node").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(jaccard, "stage", counted)
    found = jaccard._by_differences(members, sets, 85)
    assert written and max(written) <= 18
    both = found.where("node IN (61, 62)").groupBy("key").count().where("count = 2")
    assert both.count() > 0


def test_components_end_at_stars(spark, monkeypatch):
    """Edges that already name their components are written once; others end without a round that changes nothing."""
    written, kept = [], components.stage
    monkeypatch.setattr(components, "stage", lambda df: written.append(1) or kept(df))
    stars = spark.createDataFrame([(i, i % 3) for i in range(3, 60)] + [(2, 2)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.components(stars).collect()}
    assert found == {i: i % 3 for i in range(60)} and len(written) == 1
    path = spark.createDataFrame([(4, 5), (5, 3), (3, 9)], "a long, b long")
    assert {r["component"] for r in components.components(path).collect()} == {3}
    assert components.components(stars.where("a < 0")).count() == 0


def test_packing_and_counts(odd, empty):
    tok = Tokenizer.from_file(pretokens.default_path())
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(ODD)}
    ids[None] = ids.pop(3)
    rows = packing.pack(odd, block=4096).collect()
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"]: r["start"] + r["length"]].tobytes())
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values())) + len(ids[12])
    length, at = Counter(), {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == length[r["sequence_id"]]
        length[r["sequence_id"]] += r["length"]
    assert max(length.values()) <= 2048
    counts = token_counts.count_tokens(odd, common=5).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_bytes"]) for r in counts) == Counter(
        (r["doc_id"], len(ids[r["doc_id"]]) - 1, len((r["text"] or "").encode())) for r in odd.collect())
    assert packing.pack(empty).count() == 0 and token_counts.count_tokens(empty).count() == 0


def test_cuts_are_best():
    rng = np.random.default_rng(1)
    for _ in range(20):
        bounds = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 9, 12))]))
        pen = np.concatenate([[0], rng.integers(0, 4, len(bounds) - 1)]).astype(float)
        def price(i, j):
            n = bounds[j] - bounds[i]
            return np.inf if n > 16 else (0 if n & (n - 1) == 0 else 16 - n) + pen[j] + 1
        best = [0.0]
        for j in range(1, len(bounds)):
            best.append(min(best[i] + price(i, j) for i in range(j)))
        cuts = [0, *packing.best_cuts(bounds, pen, 16, 1.0)]
        assert abs(sum(price(a, b) for a, b in zip(cuts, cuts[1:])) - best[-1]) < 1e-9


def test_quality_rules(odd, empty, docs):
    got = {r["doc_id"]: r for r in quality_rules.rate(docs, least=50).collect()}
    for d in docs.collect():
        words = WORD.findall(d["text"] or "")
        seen = Counter(tuple(words[i: i + 8]) for i in range(len(words) - 7))
        again = {k for i in range(len(words) - 7) if seen[tuple(words[i: i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in (d["text"] or "").split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", d["text"] or "")),
                len(lines) - len(set(lines)), len(again))
        assert tuple(got[d["doc_id"]][c] for c in quality_rules.BASE) == want
    rows = quality_rules.rate(odd).collect()
    assert len(rows) == len(ODD) + 1 and all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (0, 12))
    assert quality_rules.rate(empty).count() == 0


def test_pipeline(spark, docs):
    d = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, d, SF)
        assert out.columns == docs.columns, name
        d = corpus_pipeline.stage(out)
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and {"doc_id", "sequence_id"} <= set(rows.columns)
    none = docs.limit(0)
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, none, SF).count() == 0, name


def test_personal_data_learns_from_all_base_spans(spark):
    """Every base span counts in the fit, its threshold and the sure kinds, however many there are."""
    from pyspark.sql import functions as F

    some = spark.range(6000).select(
        F.col("id").alias("_id"), F.when(F.col("id") == 5999, "ip").otherwise("card").alias("kind"), F.lit(True).alias("base"),
        (F.col("id") % 2 == 0).alias("exact"), F.lit(0).alias("start"), F.lit(16).alias("end"),
        *[(F.col("id") % 3 if n == pii.FEATURES[0] else F.col("id") % 2 if n == pii.FEATURES[1] else F.lit(0)).cast(
            "double").alias(n) for n in pii.FEATURES])
    sure = some.unionByName(some.where("_id < 5000").withColumns({"kind": F.lit("email"), "exact": F.lit(True)}))
    one_fails = sure.unionByName(sure.where("kind = 'email' AND _id = 7").withColumn("exact", F.lit(False)))
    seen = []
    fit = pii.GBTClassifier.fit

    def watched(self, rows):
        seen.append(rows.count())
        return fit(self, rows)

    pii.GBTClassifier.fit = watched
    try:
        assert pii.fit(sure)[2] == ["email"] and pii.fit(one_fails)[2] == []
    finally:
        pii.GBTClassifier.fit = fit
    assert all(5000 < n < 6000 for n in seen)
