"""Run registered queries and compare them with their SQL in DuckDB.

    python -m checks.runall [sf_dir] [name prefix ...]
"""

import math
import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

from checks import oracle
from checks.queries import QUERIES
from checks.roles import RAW


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shopfloor-")).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in RAW:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-9)
    return a == b and type(a) is type(b)


def key(row):
    return [(v is None, type(v).__name__, f"{v:.6f}" if isinstance(v, float) else str(v)) for v in row]


def compare(df, con, sql: str) -> tuple[bool, str]:
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return False, f"columns: only spark {sorted(set(cols) - set(names))}, only sql {sorted(set(names) - set(cols))}"
    pos = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in pos) for r in cur.fetchall()]
    if len(got) != len(want):
        return False, f"rows: spark {len(got)}, sql {len(want)}"
    got.sort(key=key)
    want.sort(key=key)
    bad, exact = {}, True
    for g, w in zip(got, want):
        for c, a, b in zip(cols, g, w):
            if not same(a, b):
                bad.setdefault(c, (a, b))
            elif a != b:
                exact = False
    if bad:
        return False, f"{len(got)} rows, differing columns: {bad}"
    return True, f"{len(got)} rows" + ("" if exact else " (last-bit differences)")


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    prefixes = argv[1:]
    spark, con, sqls, failed = session(), connect(sf_dir), oracle.all_sql(), []
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                ok, note = compare(df, con, sqls[name])
            else:
                ok, note = True, f"{df.count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - t0:6.2f}s {note}", flush=True)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
