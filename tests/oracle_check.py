"""Run registered queries in Spark and their SQL in DuckDB and compare the results.

    python tests/oracle_check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events".split()


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]").appName("periodica")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


SPENT: dict[str, float] = {}

_KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date",
          "DOUBLE": "double"}


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, sf_dir, name, fn, sql):
    """None when equal, else a message; also the row count."""
    start = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = _sorted(df.select(*[f"`{c}`" for c in cols]).collect())
    SPENT["spark"] = time.time() - start
    if sql is None:
        return None, len(got)
    start = time.time()
    rel = con.sql(sql)
    types = dict(zip(rel.columns, [_KINDS.get(str(t), str(t)) for t in rel.types]))
    if sorted(rel.columns) != cols:
        return f"columns {cols} against {sorted(rel.columns)}", len(got)
    bad = {c: (t, types[c]) for c, t in df.dtypes if types[c] != t}
    if bad:
        return f"types {bad}", len(got)
    want = _sorted(rel.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    SPENT["sql"] = time.time() - start
    if got == want:
        return None, len(got)
    diff = [(c, a, b) for g, w in zip(got, want) for c, a, b in zip(cols, g, w) if a != b][:6]
    return f"rows {len(got)} against {len(want)}; {diff}", len(got)


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf_dir, args = args[1], args[2:]
    import __spark_entry__ as entry

    spark, con = session(), connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args or any(a == n or n.startswith(a) and a.endswith("_") for a in args)]
    failed = []
    for n in names:
        t = time.time()
        try:
            message, rows = compare(spark, con, sf_dir, n, queries[n], sqls.get(n))
        except Exception as e:  # noqa: BLE001
            message, rows = f"{type(e).__name__}: {str(e)[:500]}", -1
        mark = "ok  " if message is None else "FAIL"
        print(f"{mark} {n} rows={rows} {time.time() - t:.1f}s spark={SPENT.get('spark', 0):.1f} sql={SPENT.get('sql', 0):.1f}{'' if n in sqls else ' (no sql)'}"
              + (f"\n     {message}" if message else ""), flush=True)
        spark.catalog.clearCache()
        if message:
            failed.append(n)
    print(f"{len(names) - len(failed)} of {len(names)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
