"""Run registered queries next to their SQL in DuckDB and compare.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from trafficlens.sources.driver_views import BASE_TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def kind(type_name: str) -> str:
    t = type_name.lower()
    table = {"string": "varchar", "timestamp_ntz": "timestamp", "int": "integer"}
    return table.get(t, t)


def compare(spark_df, relation) -> str | None:
    """None when equal, else what differs."""
    cols = sorted(spark_df.columns)
    dcols = sorted(relation.columns)
    if cols != dcols:
        return f"columns {cols} <> {dcols}"
    stypes = {n: kind(t) for n, t in spark_df.dtypes}
    dtypes = {n: str(t).lower() for n, t in zip(relation.columns, relation.types)}
    bad = {c: (stypes[c], dtypes[c]) for c in cols if stypes[c] != dtypes[c]}
    if bad:
        return f"types {bad}"
    left = sorted((tuple(norm(r[c]) for c in cols) for r in spark_df.collect()), key=repr)
    order = [relation.columns.index(c) for c in cols]
    right = sorted((tuple(norm(r[i]) for i in order) for r in relation.fetchall()), key=repr)
    if len(left) != len(right):
        return f"rows {len(left)} <> {len(right)}"
    if left != right:
        diff = [(a, b) for a, b in zip(left, right) if a != b]
        return f"{len(diff)} rows differ, e.g. {diff[0]}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from trafficlens.session import build_session

    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i : i + 2]
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv or list(queries)
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    for name in names:
        t = time.time()
        try:
            df = queries[name](spark, sf)
            if name in oracles:
                problem = compare(df, con.sql(oracles[name]))
                note = "ok" if problem is None else f"DIFF {problem}"
            else:
                rows = df.count()
                problem, note = None, f"rows only: {rows}"
        except Exception as e:
            problem = note = "ERROR " + "".join(traceback.format_exception_only(e))[:1500]
        failed += problem is not None
        print(f"{name:32s} {time.time() - t:6.2f}s {note}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
