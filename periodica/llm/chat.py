"""Incremental black-box chat formatting.

A template is any function from turns to text. Successive prefixes of a conversation are rendered and compared:
what a prefix adds to the one before is the span of its last turn, and a template whose output does not begin
with the output before rewrites history. Where in its span a turn's text lies shows from two renderings that
differ in that text alone.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shipping import ship

Turns = list[tuple[str, str]]


class MarkedTemplate:
    """``<s>[ROLE] role\\n`` text ``</s>\\n`` per turn, control strings inside roles and texts escaped.

    A backslash goes after the first character of each control string and before each backslash; undoing it is
    exact. Line feeds in roles are escaped as well.
    """

    controls = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "<|endoftext|>",
                "<|im_start|>", "<|im_end|>")

    def __init__(self):
        heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)
        self._risky = re.compile(rf"\\|{heads}")
        self._undo = re.compile(r"\\(.)", re.S)

    def escape(self, s: str) -> str:
        return self._risky.sub(lambda m: m[0] + "\\", s)

    def unescape(self, s: str) -> str:
        return self._undo.sub(r"\1", s)

    def render(self, turns: Turns) -> str:
        return "".join(
            f"<s>[ROLE] {self.escape(role).replace(chr(10), chr(92) + chr(10) + '.')}\n{self.escape(text)}</s>\n"
            for role, text in turns)

    def parse(self, span: str) -> tuple[str, str]:
        """Role and text of a turn from its span of the output."""
        end = re.search(r"(?<!\\)(?:\\\\)*\n", span).end() - 1
        role = span[len("<s>[ROLE] "): end].replace("\\\n.", "\n")
        return self.unescape(role), self.unescape(span[end + 1: -len("</s>\n")])


def _common(a: str, b: str) -> int:
    return len(os.path.commonprefix([a, b]))


def locate(render: Callable[[Turns], str], turns: Turns, supervised: Iterable[str]) -> tuple[str, list[dict], int]:
    """(output, spans, rewrites): spans have start, end, text_start, text_end (of supervised turns) and rewritten."""
    before, spans, rewrites = "", [], 0
    for k, (role, _) in enumerate(turns):
        now = render(turns[: k + 1])
        rewritten = not now.startswith(before)
        start = _common(before, now) if rewritten else len(before)
        rewrites += rewritten
        span = {"start": start, "end": len(now), "text_start": None, "text_end": None, "rewritten": rewritten}
        if role in supervised and not rewritten:
            one, two = (render([*turns[:k], (role, probe)]) for probe in ("A", "B"))
            head = _common(one, two)
            foot = _common(one[::-1], two[::-1])
            span["text_start"], span["text_end"] = head, len(now) - foot
        spans.append(span)
        before = now
    return before, spans, rewrites


SCHEMA = ("conv_id {kind}, formatted string, n_turns int, rewrites int, spans array<struct<start:int, end:int, "
          "text_start:int, text_end:int, rewritten:boolean>>")


def format_conversations(rows: DataFrame, template=None, conv: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text", supervised: tuple[str, ...] = ("assistant",),
                         ) -> DataFrame:
    """One row per conversation: conv_id, formatted, n_turns, rewrites (turns that changed history) and spans.

    Turns go by number, null first, ties by role and text. Null roles and texts count as empty; a null
    conversation is one of its own; repeated rows are repeated turns; other columns are ignored. Sorted turns
    stream through the task one conversation at a time; rendering every prefix costs the square of its length.
    """
    template = template or MarkedTemplate()
    ship(rows.sparkSession)
    kind = rows.schema[conv].dataType.simpleString()
    empty = F.lit("")
    turns = rows.select(
        F.col(f"`{conv}`").alias("_conv"), F.col(f"`{turn}`").alias("_turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), empty).alias("_role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), empty).alias("_said"))
    sorted_turns = turns.repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_said")

    def work(batches):
        def done():
            out, spans, rewrites = locate(template.render, held, supervised)
            return now, out, len(held), rewrites, spans

        def batch_of(found):
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)],
                ["conv_id", "formatted", "n_turns", "rewrites", "spans"])

        now, held, found, size, key_type, types = None, [], [], 0, None, None
        for batch in batches:
            key_type = key_type or batch.schema.field(0).type
            types = [key_type, pa.string(), pa.int32(), pa.int32(), pa.list_(pa.struct([
                ("start", pa.int32()), ("end", pa.int32()), ("text_start", pa.int32()), ("text_end", pa.int32()),
                ("rewritten", pa.bool_())]))]
            for c, r, s in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if held and c != now:
                    found.append(done())
                    size += len(found[-1][1])
                    held = []
                    if size > 1 << 22:
                        yield batch_of(found)
                        found, size = [], 0
                now = c
                held.append((r, s))
        if held:
            found.append(done())
            yield batch_of(found)

    return sorted_turns.mapInArrow(work, SCHEMA.format(kind=kind)).withColumnRenamed("conv_id", conv)


def read_back(formatted: DataFrame, template=None, conv: str = "conv_id") -> DataFrame:
    """conv, turns (role and text of each span) and loss (unescaped text under the mask), from the output alone."""
    template = template or MarkedTemplate()
    ship(formatted.sparkSession)
    kind = formatted.schema[conv].dataType.simpleString()

    def work(batches):
        for b in batches:
            turns, loss = [], []
            for out, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns.append([dict(zip(("role", "text"), template.parse(out[s["start"]: s["end"]]), strict=True))
                              for s in spans])
                loss.append("".join(template.unescape(out[s["text_start"]: s["text_end"]]) for s in spans
                                    if s["text_start"] is not None))
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
                pa.array(loss, pa.string()), b.column(1)], ["_conv", "turns", "loss", "formatted"])

    source = formatted.select(F.col(f"`{conv}`").alias("_conv"), "formatted", "spans")
    out = source.mapInArrow(
        work, f"_conv {kind}, turns array<struct<role:string, text:string>>, loss string, formatted string")
    return out.withColumnRenamed("_conv", conv)


def digests(read: DataFrame, conv: str = "conv_id") -> DataFrame:
    turn = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(turn, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
