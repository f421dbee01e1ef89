"""Repair of turns, bit-sliced top k and the prefix trie against brute force and SQL."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from periodica.llm import bitslices, prefix_trie, queries, turn_repair

SF = "/root/testdata/sf0.01"
FILL = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", ["op11_turn_repair", "op12_bit_sliced_top_k", "op13_prefix_trie"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(queries.SQL[name]).project(", ".join(cols)).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(cols).collect())


# repair of turns

def _plain_repair(rows):
    """(cost, audit, repaired) from whole strings, every row and state; rows: role, gone, cut."""
    grow = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = {0: (0, "", ())}

    def inserted(best):
        for _ in range(3):
            for s, (c, a, o) in list(best.items()):
                for role in ("user", "assistant"):
                    t = grow[s].get(role[0])
                    if t and (t not in best or (c + turn_repair.INSERT, a + "I") < best[t][:2]):
                        best[t] = (c + turn_repair.INSERT, a + "I", (*o, f"{role}:"))
        return best

    for role, text, gone, cut in rows:
        new = {}
        for s, (c, a, o) in inserted(dict(best)).items():
            ways = [(s, c + 2, "D", ())]
            if not gone:
                extra = 5 * cut
                if role[:1] in grow[s]:
                    ways.append((grow[s][role[:1]], c + extra, "K", (f"{role}:{text}",)))
                ways += [(grow[s][r[0]], c + extra + 1, "R", (f"{r}:{text}",)) for r in ("user", "assistant") if r[0] in grow[s]]
            for t, cost, edit, line in ways:
                if t not in new or (cost, a + edit) < new[t][:2]:
                    new[t] = (cost, a + edit, (*o, *line))
        best = new
    best = inserted(best)
    return min(best[s] for s in (0, 3) if s in best)


def _reports(spark, convs):
    rows = [(c, t, r, x, "extra") for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gaps string")
    return {r["conv_id"]: r for r in turn_repair.repair_report(df).collect()}


@pytest.mark.parametrize("insert", [5, 1])
def test_least_repairs_by_price(monkeypatch, insert):
    """At the dealt price an insertion is never cheapest, as deleting its neighbour costs less; at 1 it often is."""
    monkeypatch.setattr(turn_repair, "INSERT", insert)
    rng, inserts = np.random.default_rng(5), 0
    for _ in range(3000):
        rows = [("suax"[rng.integers(0, 4)], str(i), bool(rng.random() < .2), bool(rng.random() < .3))
                for i in range(rng.integers(1, 11))]
        one, edits = turn_repair.Repair(), []
        for i, (role, text, gone, cut) in enumerate(rows):
            edits += one.take(i, role, text, "" if gone else "x" if cut else ".", False)
        cost, rest = one.finish()
        edits += rest
        got = cost, "".join(e for e, _, _ in edits), tuple(f"{r}:{t}" for e, r, t in edits if e != "D")
        rows = [(r, t, gone, cut and not gone) for r, t, gone, cut in rows]
        assert got == _plain_repair(rows), rows
        inserts += "I" in got[1]
    assert inserts == 0 if insert == 5 else inserts > 300


def test_repairs_are_least(spark):
    rng = np.random.default_rng(11)
    roles, texts = ["system", "user", "assistant", "tool", "us", ""], ["Yes.", "No!", "cut", "", " \t", "so?\n", "a b"]
    convs = {c: [(roles[i], texts[j]) for i, j in zip(rng.choice(6, n, p=[.1, .4, .3, .1, .05, .05]), rng.integers(0, 7, n))]
             for c, n in enumerate(rng.integers(1, 14, 600))}
    convs |= {1000 + c: [(roles[rng.integers(1, 3)], f"{i}{'.' if rng.random() < .7 else ''}") for i in range(n)]
              for c, n in enumerate(rng.integers(1, 40, 200))}
    got = _reports(spark, convs)
    for c, turns in convs.items():
        seen, rows, n = set(), [], [0, 0, 0]
        for role, text in turns:
            end = text.strip(FILL)[-1:]
            fault = 0 if not end else 1 if (role, text) in seen else 2 if end not in ".!?" else 3
            seen.add((role, text))
            rows.append((role, text, fault < 2, fault == 2))
            if fault < 3:
                n[fault] += 1
        cost, audit, lines = _plain_repair(rows)
        r = got[c]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        assert (r["cost"], r["audit"]) == (cost, audit), (c, turns)
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]) == (0, *n, illegal)


def test_repair_memory():
    """Rows and nodes held stay few where survivors meet; long ties that never do are still compared quickly."""
    one = turn_repair.Repair()
    most = 0
    for i in range(20_000):
        role = "user" if i % 2 == 0 and i % 97 else "assistant"
        assert all(len(e) == 3 for e in one.take(i, role, f"{i}.", ".", i % 31 == 0))
        most = max(most, len(one.survivors), len(one.waiting))
    assert most < 40
    tied = turn_repair.Survivors()
    for _ in range(20_000):
        tied.step("u", False, False)
    cost, edits = tied.finish()
    assert cost == 10_000 and "".join(e for e, _ in edits) == "KR" * 10_000


def test_repair_odd_rows(spark):
    rows = spark.createDataFrame([
        (1, None, "user", "Hi.", True, 5), (1, 3, "assistant", "Yes.", True, 5), (1, 3, "assistant", "Yes.", True, 5),
        (None, None, None, None, True, 5), (None, 4, "user", "a" * 300_000 + ".", True, 5), (2, 1, "user", "x", False, 5),
        (3, 7, "user", None, True, 5), (3, 2, "user", "Go.", True, 5), (3, 2, "assistant", "Ok.", True, 5),
    ], "conv_id long, turn long, role string, text string, present boolean, cost long")
    got = {r["conv_id"]: tuple(r)[1:8] for r in turn_repair.repair_report(rows, present=F.col("present")).collect()}
    assert got == {1: (0, 0, 1, 0, 1, 2, "KKD"), None: (0, 1, 0, 0, 1, 4, "DD"), 2: (0, 0, 0, 0, 0, 0, ""),
                   3: (4, 1, 0, 0, 1, 4, "RRD")}
    turns = turn_repair.repaired_turns(rows.where("conv_id = 1"))
    assert [tuple(r) for r in turns.orderBy("turn").collect()] == [
        (1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "Yes.", "K")]
    assert turn_repair.repair_report(rows.limit(0)).count() == 0 == turn_repair.repaired_turns(rows.limit(0)).count()
    broken = turn_repair.damage(rows)
    for r in broken.collect():
        kind = zlib.crc32(f"{' ' if r['conv_id'] is None else r['conv_id']}:{' ' if r['turn'] is None else r['turn']}".encode()) % 20
        assert r["present"] == (kind != 0) and (kind != 4 or r["role"] == "user")


# bit-sliced top k

def test_top_products(spark):
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(0, 1, 9).round(2).tolist(), "x") for i in range(700)]
    rows += [(20, [0.5] * 9, "x"), (20, [0.5] * 9, "x"), (41, [0.25] * 9, "x"), (None, [3.0] * 9, "x"), (60, None, "x"),
             (80, [1.0, None, 2.0], "x"), (100, [float("nan")] * 9, "x"), (120, [float("-inf")] + [1.0] * 8, "x"),
             (140, [1.0, -2.0], "x"), (141, [-1.5, 3.0], "x"), (160, [], "x"), (161, [], "x"), (180, [1e30, -3e4] + [0.0] * 7, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    good = [(i, [int(np.floor(max(min(64 * x, 2.0**53), -2.0**53))) for x in v]) for i, v, _ in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (i, v) in enumerate(good):
        if i is not None and i % 20 == 0:
            near = [(-sum(x * y for x, y in zip(v, w)), j is None, j or 0)
                    for b, (j, w) in enumerate(good) if b != a and len(w) == len(v)]
            want += [(i, r + 1, None if none else j, max(min(-s, 2**63 - 1), -2**63))
                     for r, (s, none, j) in enumerate(sorted(near)[:20])]
    got = [tuple(r) for r in bitslices.top_products(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert bitslices.top_products(df.limit(0)).count() == 0


def test_blocks_and_shelves(spark):
    """Many blocks a shelf, a third of all rows alike."""
    rng = np.random.default_rng(3)
    codes = rng.integers(-40, 40, (900, 5))
    codes[::3] = codes[0]
    df = spark.createDataFrame([(i, v.tolist(), i) for i, v in enumerate(codes)], "_key long, codes array<long>, _row long")
    found = bitslices.search(bitslices.build_index(df, 64), df.where("_key % 20 = 0"), 20, shelves=4)
    for r in found.where("rank = 20 or rank = 1").collect():
        s = codes @ codes[r["key"]]
        best = [j for j in np.lexsort((np.arange(900), -s)) if j != r["key"]][r["rank"] - 1]
        assert (r["found"], r["score"]) == (best, s[best])


# prefix trie

def _plain_trie(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        sub = [p for p in nodes if p[: len(path)] == path]
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(path))))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
            sum(p[:-1] == path and len(p) > len(path) for p in nodes),
            sum(not any(q[:-1] == p for q in nodes if q) for p in sub),
            sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in sub if p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("per_shard", [None, 7, 40])
def test_prefix_trie(spark, per_shard):
    rng = np.random.default_rng(13)
    convs = {int(c): [(("user", "assistant")[t % 2], "ab"[rng.integers(0, 2)] * int(rng.integers(1, 3))) for t in range(n)]
             for c, n in zip(rng.permutation(150), rng.integers(1, 8, 150))}
    same = [("user", "hi"), ("assistant", "ho"), ("user", "hi")]
    convs |= {1000 + c: same for c in range(60)} | {2000: same + same * 4, 2001: same + same * 4 + [("", "")]}
    convs |= {3000 + c: same[:1] for c in range(1, 12)}
    rows = [(c, t, None if not r else r, None if not x else x, "z") for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string")
    got = prefix_trie.prefix_trie(df, turns_per_shard=per_shard)
    assert sorted(repr(tuple(r)) for r in got.collect()) == _plain_trie(convs)
    built = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    assert any(not t for t in built.values())
    got = prefix_trie.rebuilt_trie(df, turns_per_shard=per_shard)
    assert sorted(repr(tuple(r)) for r in got.collect()) == _plain_trie(built)


def test_order_in_narrow_matrices(monkeypatch):
    monkeypatch.setattr(prefix_trie, "WIDTH", 3)
    rng = np.random.default_rng(2)
    for _ in range(200):
        rows = [rng.integers(0, 2, rng.integers(0, 11)).tolist() for _ in range(rng.integers(1, 40))]
        size, conv = np.array([len(r) for r in rows]), rng.permutation(len(rows))
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        order, shared = prefix_trie.ordered(np.array(sum(rows, []), np.int64), first, size, conv)
        want = sorted(range(len(rows)), key=lambda i: (rows[i], conv[i]))
        assert order.tolist() == want
        for i in range(1, len(rows)):
            a, b = rows[want[i - 1]], rows[want[i]]
            assert shared[i] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_trie_odd_rows(spark):
    kind = "conv_id long, turn long, role string, text string"
    rows = spark.createDataFrame([
        (None, 0, "user", "x"), (5, None, "user", "first"), (5, 1, "user", None), (5, 1, "user", None),
        (7, 0, "user", "first"), (7, 2, "", "a" * 200_000)], kind)
    got = {(r["conv_id"], r["depth"]): tuple(r)[2:7] for r in prefix_trie.prefix_trie(rows, turns_per_shard=2).collect()}
    assert got == {(5, 0): (None, 2, 1, 2, 5), (5, 1): (5, 2, 2, 2, 5), (5, 2): (5, 1, 1, 1, 0), (5, 3): (5, 1, 0, 1, 0),
                   (7, 2): (5, 1, 0, 1, 0)}
    assert prefix_trie.rebuilt_trie(rows.limit(0)).count() == 0
