"""Run a registered query in Spark and its SQL in DuckDB over the same parquet files; report the first difference."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)), v) if not isinstance(v, float) else (True, "f", v) for v in row)


def compare(spark, con, name: str, sf_dir: str, queries, oracles) -> str | None:
    df = queries[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    if name not in oracles:
        return None if got else "no rows"
    rel = con.sql(oracles[name])
    if sorted(rel.columns) != cols:
        return f"columns {cols} vs {sorted(rel.columns)}"
    want = rel.select(*[f'"{c}"' for c in cols]).fetchall()
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    got.sort(key=repr)
    want.sort(key=repr)
    for g, w in zip(got, want):
        if g != w:
            return f"{dict(zip(cols, g))}\n  vs {dict(zip(cols, w))}"
    return None if got else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from runlens import session

    sf = sys.argv[1]
    q, o = entry.queries(), entry.oracle_sql()
    chosen = sys.argv[2:] or list(q)
    spark = session.build("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                   "spark.driver.memory": "10g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for n in chosen:
        t = time.time()
        try:
            diff = compare(spark, con, n, sf, q, o)
        except Exception as exc:  # report and go on with the next query
            diff = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {n:28s} {time.time() - t:6.2f}s {'' if n in o else '(rows only)'} {diff or ''}",
              flush=True)
    print(f"{len(chosen) - bad}/{len(chosen)} agree")
