"""Cheapest repair of conversation structure by survivor-coalescence Viterbi.

A repaired conversation's roles are nothing, or ``s?(ua)+`` by their initials. Four states say how far that pattern
has come; of every state the cheapest edits so far survive, among equals the least by their initials. Survivors are
tips of one backpointer tree. Nodes count their references, so a tip that is outrun frees what it alone used, and as
soon as all survivors share an ancestor the edits down to it are emitted and forgotten: a task holds the rows since
that ancestor, not the conversation. Survivors of equal cost are compared over all of their unresolved edits, at the
first edit behind their last common node.

Survivors that another one beats whatever follows are dropped; without that, deleting everything would keep a path
from the first row alive to the end.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shipping import ship

SPACE = " \t\n\x0b\x0c\r"
STOPS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: (state, other, c): the state needs no look beyond ``c`` above the other's cost, as the other can do what it can for c.
_BEATEN = ((START, ASSISTANT, 2), (SYSTEM, ASSISTANT, 0), (USER, ASSISTANT, INSERT), (START, USER, 2 + INSERT),
           (SYSTEM, USER, INSERT), (ASSISTANT, USER, INSERT))


class _Node:
    __slots__ = ("parent", "edit", "state", "depth", "jump", "refs", "kids")

    def __init__(self, parent, edit, state, depth, jump):
        self.parent, self.edit, self.state, self.depth, self.jump = parent, edit, state, depth, jump
        self.refs, self.kids = 0, 0


class Survivors:
    """The backpointer tree of one conversation. ``step`` takes rows, ``emitted`` gives edits that are settled.

    Nodes go by number, so a pointer to a forgotten node holds no memory. ``kids`` is the exclusive or of a node's
    children, which is its child where it has one. ``jump`` is a farther ancestor and its depth; nodes of one depth
    mostly jump equally far, so common ancestors are found in logarithmic time.
    """

    def __init__(self):
        self.nodes = {1: _Node(0, "", START, 0, (1, 0))}
        self.root, self.next = 1, 2
        self.nodes[1].refs = 1
        self.best: dict[int, tuple[int, int]] = {START: (0, 1)}

    def __len__(self) -> int:
        return len(self.nodes)

    def _grown(self, tip: int, edits: str, states: tuple[int, ...]) -> int:
        for edit, state in zip(edits, states, strict=True):
            p = self.nodes[tip]
            far, far_depth = p.jump
            again = self.nodes.get(far)
            # skew-binary jumps: as far again where the two before were alike
            jump = again.jump if again and p.depth - far_depth == far_depth - again.jump[1] else (tip, p.depth)
            self.nodes[self.next] = _Node(tip, edit, state, p.depth + 1, jump)
            p.refs, p.kids = p.refs + 1, p.kids ^ self.next
            tip, self.next = self.next, self.next + 1
        return tip

    def _release(self, tip: int) -> None:
        while True:
            node = self.nodes[tip]
            node.refs -= 1
            if node.refs or tip == self.root:
                return
            del self.nodes[tip]
            self.nodes[node.parent].kids ^= tip
            tip = node.parent

    def _at_depth(self, tip: int, depth: int) -> int:
        while self.nodes[tip].depth > depth:
            far, far_depth = self.nodes[tip].jump
            tip = far if far_depth >= depth and far in self.nodes else self.nodes[tip].parent
        return tip

    def _before(self, one: tuple[int, str], two: tuple[int, str]) -> bool:
        """Whether the first edits (a tip and what follows it) come before the others."""
        (a, x), (b, y) = one, two
        if a == b:
            return x < y
        depth = min(self.nodes[a].depth, self.nodes[b].depth)
        # tips have used up the same rows and end on one, so none lies on another's path
        a, b = self._at_depth(a, depth), self._at_depth(b, depth)
        while self.nodes[a].parent != self.nodes[b].parent:
            p, q = self.nodes[a].jump, self.nodes[b].jump
            if p[1] == q[1] and p[0] != q[0]:
                a, b = p[0], q[0]
            else:
                a, b = self.nodes[a].parent, self.nodes[b].parent
        return self.nodes[a].edit < self.nodes[b].edit

    def _least(self, found: list[tuple[int, int, str, tuple[int, ...]]]):
        best = None
        for f in found:
            if best is None or f[0] < best[0] or f[0] == best[0] and self._before((f[1], f[2]), (best[1], best[2])):
                best = f
        return best

    def step(self, initial: str, delete: bool, truncated: bool) -> None:
        """One more row: its role's initial, whether it must go, whether keeping it costs extra."""
        found: dict[int, list] = {s: [] for s in range(4)}
        for s, (cost, tip) in self.best.items():
            found[s].append((cost + DELETE, tip, "D", (s,)))
            if delete:
                continue
            kept = cost + (TRUNCATED if truncated else 0)
            user, assistant = [("K", kept) if initial == c else ("R", kept + REROLE) for c in "ua"]
            if s == START and initial == "s":
                found[SYSTEM].append((kept, tip, "K", (SYSTEM,)))
            if s == USER:
                found[ASSISTANT].append((assistant[1], tip, assistant[0], (ASSISTANT,)))
                found[USER].append((user[1] + INSERT, tip, "I" + user[0], (ASSISTANT, USER)))
            else:
                found[USER].append((user[1], tip, user[0], (USER,)))
                found[ASSISTANT].append((assistant[1] + INSERT, tip, "I" + assistant[0], (USER, ASSISTANT)))
        costs = {s: min(f[0] for f in fs) for s, fs in found.items() if fs}
        beaten = {s for s, o, c in _BEATEN if s in costs and o in costs and costs[s] > costs[o] + c}
        winners = {s: self._least(fs) for s, fs in found.items() if fs and s not in beaten}
        before, self.best = self.best, {}
        for s, (cost, tip, edits, states) in winners.items():
            new = self._grown(tip, edits, states)
            self.nodes[new].refs += 1
            self.best[s] = (cost, new)
        for _, tip in before.values():
            self._release(tip)

    def emitted(self) -> Iterator[tuple[str, int]]:
        """(edit, state after it) of what all survivors share, once."""
        while True:
            root = self.nodes[self.root]
            if root.refs != 1 or not root.kids:
                return
            del self.nodes[self.root]
            self.root = root.kids
            yield self.nodes[self.root].edit, self.nodes[self.root].state

    def finish(self) -> tuple[int, list[tuple[str, int]]]:
        """(cost of the whole repair, edits not emitted so far)."""
        ends = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
        found = [(cost + INSERT * len(ends[s]), tip, ends[s], (USER, ASSISTANT)[2 - len(ends[s]):])
                 for s, (cost, tip) in self.best.items()]
        cost, tip, edits, states = self._least(found)
        tip = self._grown(tip, edits, states)
        out = []
        while tip != self.root:
            out.append((self.nodes[tip].edit, self.nodes[tip].state))
            tip = self.nodes[tip].parent
        return cost, out[::-1]


class Repair:
    """One conversation as its rows come: counts of faults, edits as they are settled."""

    def __init__(self):
        self.survivors, self.waiting = Survivors(), deque()
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.initial = None

    def take(self, turn, role: str, text: str, last: str, seen: bool) -> Iterator[tuple[str, str, str]]:
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in LEGAL
        self.initial = initial
        truncated = False
        if not last:
            self.blank += 1
        elif seen:
            self.duplicate += 1
        elif last not in STOPS:
            truncated = True
            self.truncated += 1
        self.waiting.append((role, text))
        self.survivors.step(initial, not last or seen, truncated)
        yield from map(self._done, self.survivors.emitted())

    def _done(self, edit: tuple[str, int]) -> tuple[str, str, str]:
        """(edit, role and text after it); a deleted row as it was."""
        if edit[0] == "I":
            return "I", ROLES[edit[1]], ""
        role, text = self.waiting.popleft()
        return edit[0], ROLES[edit[1]] if edit[0] == "R" else role, text

    def finish(self) -> tuple[int, Iterator[tuple[str, str, str]]]:
        cost, rest = self.survivors.finish()
        return cost, map(self._done, rest)

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


def _faults(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """Rows of each conversation in order, in one partition: _conv, _there, _turn, _role, _text, _last, _seen.

    One shuffle of the rows; that a role and text were seen before is found by a window inside it.
    """
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    known = rows.select(
        F.col(f"`{conv}`").alias("_conv"), there.alias("_there"), F.col(f"`{turn}`").cast("long").alias("_turn"),
        *[F.when(there, F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))).otherwise("").alias(f"_{n}")
          for c, n in ((role, "role"), (text, "text"))])
    last = F.right(F.rtrim(F.col("_text"), F.lit(SPACE)), F.lit(1))
    dealt = known.repartition("_conv").withColumn("_last", last)
    alike = W.partitionBy("_conv", "_there", "_role", "_text").orderBy(F.asc_nulls_first("_turn"))
    dealt = dealt.withColumn("_seen", F.row_number().over(alike) > 1)
    return dealt.sortWithinPartitions(
        F.asc_nulls_first("_conv"), F.desc("_there"), F.asc_nulls_first("_turn"), "_role", "_text", "_seen")


def _conversations(batches, opened, took, closed):
    """Run conversations through: ``opened(conv)``, ``took(row)``, ``closed()``; what the last two yield goes out."""
    now, begun = None, False
    for batch in batches:
        for conv, there, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not begun or conv != now:
                if begun:
                    yield from closed()
                opened(conv)
                now, begun = conv, True
            if there:
                yield from took(*row)
    if begun:
        yield from closed()


def _batches(rows, names: list[str], types: list[pa.DataType], size: int = 4096):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names)


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                  present: Column | None = None) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows go by turn (whole numbers, null first), ties by role and text. Null roles and texts count as one space, a
    null conversation is one of its own, other columns are ignored, no rows give none. Rows that are not ``present``
    only name their conversation; one without others has zeros, an empty audit and the hash of nothing. A
    conversation streams through one task, sorted, and is never held; its hash has to be taken in order.
    """
    ship(rows.sparkSession)
    ordered = _faults(rows, conv, turn, role, text, present)
    kind = ordered.schema["_conv"].dataType.simpleString()

    def work(batches):
        own = {}

        def opened(c):
            own.update(conv=c, repair=Repair(), audit=[], sha=hashlib.sha256(), first=True)

        def written(edits):
            for edit, by, said in edits:
                own["audit"].append(edit)
                if edit != "D":
                    own["sha"].update(f"{'' if own['first'] else chr(10)}{by}:{said}".encode())
                    own["first"] = False

        def took(*row):
            written(own["repair"].take(*row))
            return ()

        def closed():
            r = own["repair"]
            cost, rest = r.finish()
            written(rest)
            yield (own["conv"], r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, cost, "".join(own["audit"]),
                   own["sha"].hexdigest())

        key = pa_type
        yield from _batches(_conversations(batches, opened, took, closed), ["_conv", *REPORT, "audit", "repaired_sha256"],
                            [key, *[pa.int64()] * len(REPORT), pa.string(), pa.string()])

    pa_type = _arrow_type(ordered)
    numbers = ", ".join(f"{c} long" for c in REPORT)
    out = ordered.mapInArrow(work, f"_conv {kind}, {numbers}, audit string, repaired_sha256 string")
    return out.withColumnRenamed("_conv", conv)


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   present: Column | None = None) -> DataFrame:
    """The repaired conversations: conv, turn (counted from 0), role, text and edit (K, R or I); as ``repair_report``."""
    ship(rows.sparkSession)
    ordered = _faults(rows, conv, turn, role, text, present)
    kind = ordered.schema["_conv"].dataType.simpleString()
    pa_type = _arrow_type(ordered)

    def work(batches):
        own = {}

        def opened(c):
            own.update(conv=c, repair=Repair(), n=0)

        def written(edits):
            for edit, by, said in edits:
                if edit != "D":
                    yield own["conv"], own["n"], by, said, edit
                    own["n"] += 1

        def closed():
            yield from written(own["repair"].finish()[1])

        done = _conversations(batches, opened, lambda *row: written(own["repair"].take(*row)), closed)
        yield from _batches(done, ["_conv", "_turn", "_role", "_text", "edit"],
                            [pa_type, pa.int64(), pa.string(), pa.string(), pa.string()])

    out = ordered.mapInArrow(work, f"_conv {kind}, _turn long, _role string, _text string, edit string")
    return out.select(F.col("_conv").alias(conv), F.col("_turn").alias(turn), F.col("_role").alias(role),
                      F.col("_text").alias(text), "edit")


def _arrow_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["_conv"].dataType)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """conv, turn, role, text and present of conversations with faults put in by ``crc32(conv:turn) % 20``.

    0 drops a row (it stays, not present), 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 has the user
    say it. Nulls count as one space, in the checksum too; turns stay null.
    """
    one = F.lit(" ")
    mark = [F.coalesce(F.col(f"`{c}`").cast("string"), one) for c in (conv, turn)]
    kind = F.crc32(F.concat(mark[0], F.lit(":"), mark[1])) % 20
    by, said = (F.coalesce(F.col(f"`{c}`").cast("string"), one) for c in (role, text))
    said = F.when(kind == 1, "").when(kind == 2, F.translate(said, STOPS, "")).otherwise(said)
    return rows.select(
        F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.when(kind == 4, "user").otherwise(by).alias("role"), said.alias("text"), (kind != 0).alias("present"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
