"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Mirrors the driver's check: row count, column names, order-insensitive values
(floats compared after rounding to 6 significant digits).

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.6g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return str(v)


def canon(df: pd.DataFrame):
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df[cols].to_dict("records")]
    return cols, sorted(rows, key=repr)


def compare(spark_df: pd.DataFrame, duck_df: pd.DataFrame):
    c1, r1 = canon(spark_df)
    c2, r2 = canon(duck_df)
    if c1 != c2:
        return False, f"columns {c1} vs {c2}"
    if len(r1) != len(r2):
        return False, f"rows {len(r1)} vs {len(r2)}"
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    if bad:
        return False, f"{len(bad)} value diffs, first {bad[0]}"
    return True, f"{len(r1)} rows"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from canopy.session import get_session
    spark = get_session()
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    ok_all = True
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:300]}")
            ok_all = False
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"ROWS {name}: {len(sdf)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            ddf = con.sql(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:300]}")
            ok_all = False
            continue
        ok, msg = compare(sdf, ddf)
        ok_all &= ok
        print(f"{'OK  ' if ok else 'FAIL'} {name}: {msg} {ts:.1f}s")
    return 0 if ok_all else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv))
