"""Run registered queries on Spark and their SQL twins on DuckDB; compare rows, columns and values.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time
from collections import Counter

import duckdb


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
               "embeddings", "pages", "benchmark", "labels", "conversations")

_SPARK_TO_DUCK = {
    "IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE", "StringType()": "VARCHAR",
    "BooleanType()": "BOOLEAN",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"temp_directory": tempfile.mkdtemp(prefix="marquee-duck-")})
    for t in STAR_TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, float) and v == 0.0:
        return 0.0
    return v


def compare(spark, con, name: str, query, statement: str, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = query(spark, sf_dir)
    s_cols = [f.name for f in df.schema.fields]
    s_types = {f.name: _SPARK_TO_DUCK.get(repr(f.dataType), repr(f.dataType)) for f in df.schema.fields}
    s_rows = df.collect()
    t_spark = time.time() - t0
    rel = con.execute(statement)
    d_cols = [d[0] for d in rel.description]
    d_types = {d[0]: str(d[1]) for d in rel.description}
    d_rows = rel.fetchall()
    order = sorted(s_cols)
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={s_cols} duck={d_cols}")
    else:
        bad = {c: (s_types[c], d_types[c]) for c in order if s_types[c] != d_types[c]}
        if bad:
            problems.append(f"types {bad}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        si = [s_cols.index(c) for c in order]
        di = [d_cols.index(c) for c in order]
        sc = Counter(tuple(_norm(r[i]) for i in si) for r in s_rows)
        dc = Counter(tuple(_norm(r[i]) for i in di) for r in d_rows)
        if sc != dc:
            only_s = list((sc - dc).elements())[:3]
            only_d = list((dc - sc).elements())[:3]
            problems.append(f"values differ; cols={order}\n   spark-only={only_s}\n   duck-only={only_d}")
    status = "OK " if not problems else "BAD"
    return not problems, f"{status} {name:28s} rows={len(s_rows):6d} spark={t_spark:5.1f}s " + "; ".join(problems)


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as entry
    from marquee.session import get_spark

    spark = get_spark("local[8]", conf={"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    failures = 0
    for name in names or list(qs):
        if name not in sqls:
            print(f"--- {name}: no SQL twin")
            continue
        try:
            ok, msg = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as exc:  # report and continue with the next query
            ok, msg = False, f"ERR {name}: {type(exc).__name__}: {str(exc)[:600]}"
        failures += not ok
        print(msg, flush=True)
    print(f"{failures} failing")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
