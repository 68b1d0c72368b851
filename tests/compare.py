"""Runs queries and their SQL side by side: python tests/compare.py SF_DIR [NAME...]"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent.parent))


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.sql(f"create view {p.stem} as select * from '{source}'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return str(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def same(spark, name, query, sql, sf_dir) -> tuple[bool, str]:
    began = time.time()
    df = query(spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    took = time.time() - began
    rel = duck(sf_dir).sql(sql)
    want = canonical(rel.fetchall(), rel.columns)
    ok = sorted(df.columns) == sorted(rel.columns) and got == want
    detail = "" if ok else f" columns {sorted(df.columns)} {sorted(rel.columns)}; first differences {[x for x in zip(got, want) if x[0] != x[1]][:3]}"
    return ok, f"{name}: {len(got)} and {len(want)} rows, {took:.1f} s{detail}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from tests.conftest import session

    spark, queries, sql = session(), e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or sorted(queries):
        if name in sql:
            ok, said = same(spark, name, queries[name], sql[name], sys.argv[1])
            print("same" if ok else "DIFFERENT", said, flush=True)
        else:
            began = time.time()
            n = queries[name](spark, sys.argv[1]).count()
            print("rows", f"{name}: {n} rows, {time.time() - began:.1f} s", flush=True)
