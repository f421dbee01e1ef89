"""Registry of runnable queries and the SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CTES: dict[str, str] = {}

# l whole number, d double, s text, b boolean, t date
_TYPES = {"l": "bigint", "s": "string", "b": "boolean", "t": "date"}
_SQL_TYPES = {"l": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN", "t": "DATE"}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in spec.split()]


def shaped(df: DataFrame, spec: str) -> DataFrame:
    """Select the declared columns; doubles to four places, boundary moved off exact ties."""
    out = []
    for name, kind in _columns(spec):
        c = F.col(f"`{name}`")
        if kind == "d":
            c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
            c = F.floor(c * 10000 + 0.500001) / F.lit(10000.0)
        else:
            c = c.cast(_TYPES[kind])
        out.append(c.alias(name))
    return df.select(*out)


def _sql_shaped(body: str, spec: str) -> str:
    out = []
    for name, kind in _columns(spec):
        if kind == "d":
            v = f'CAST("{name}" AS DOUBLE)'
            c = f"CASE WHEN isnan({v}) THEN NULL ELSE floor({v} * 10000 + 0.500001) / 10000.0 END"
        else:
            c = f'CAST("{name}" AS {_SQL_TYPES[kind]})'
        out.append(f'{c} AS "{name}"')
    return f"SELECT {', '.join(out)} FROM (\n{body}\n) q_"


def _with(body: str) -> str:
    """Prefix the common table expressions the text names, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"\b[a-z]\w*\b", text):
            if word in CTES and word not in order:
                if CTES[word] == text:
                    continue
                visit(CTES[word])
                if word not in order:
                    order.append(word)

    visit(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS (\n{CTES[n].strip()}\n)" for n in order) + "\n" + body


def cte(name: str, body: str) -> None:
    CTES[name] = body


def query(name: str, spec: str, sql: str | None = None):
    """Register a query under its operator name, with its output columns and oracle."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: shaped(fn(spark, sf_dir), spec)
        if sql is not None:
            SQL[name] = _with(_sql_shaped(sql.strip(), spec))
        return fn

    return register


def settings_rows(mapping: dict, columns: str) -> str:
    """A settings map as a SQL VALUES relation."""
    rows = []
    for k, v in mapping.items():
        vals = v if isinstance(v, tuple) else (v,)
        rows.append("('" + str(k) + "', " + ", ".join(str(x) for x in vals) + ")")
    return f"(VALUES {', '.join(rows)}) {columns}"
