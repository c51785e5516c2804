"""Run a query on Spark and its SQL twin on DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def spark_session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("presage-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def _key(row):
    row = [x for x in row if not isinstance(x, float)] + [x for x in row if isinstance(x, float)]
    return tuple((x is not None, type(x).__name__ if not isinstance(x, (int, float)) else "n", (round(x, 6) if isinstance(x, float) else x) if x is not None else 0) for x in row)


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, else a short description of the first difference."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} vs {sorted(rel.columns)}"
    order = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in order) for r in rel.fetchall()), key=_key)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    types = {c: t for c, t in zip(rel.columns, rel.types)}
    for c, t in df.dtypes:
        want_t = str(types[c])
        if t in ("bigint", "int", "double", "string", "boolean", "date") and {
            "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}[t] != want_t:
            return f"type of {c}: {t} vs {want_t}"
    bad = [(g, w) for g, w in zip(got, want) if not _close(g, w)]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {dict(zip(cols, zip(*bad[0])))}"
    return None


def _close(g, w):
    for a, b in zip(g, w):
        if isinstance(a, float) and isinstance(b, float):
            if abs(a - b) > 1e-9 * max(1.0, abs(a)):
                return False
        elif a != b:
            return False
    return True


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:]
    q, s = entry.queries(), entry.oracle_sql()
    spark, con = spark_session(), duck(sf_dir)
    bad = 0
    for name, fn in q.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            if name in s:
                msg = compare(spark, con, sf_dir, fn, s[name])
            else:
                msg = None if fn(spark, sf_dir).count() >= 0 else "no rows"
        except Exception as exc:  # noqa: BLE001
            msg = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += msg is not None
        print(f"{'ok  ' if msg is None else 'BAD '} {name} {time.time() - t:.1f}s {'' if name in s else '(no twin) '}{msg or ''}", flush=True)
    print("bad:", bad)
    spark.stop()
