"""Compare registered queries with their SQL: python tools/check_oracle.py [folder] [name …]."""

from __future__ import annotations

import sys
import time
import warnings
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
warnings.filterwarnings("ignore")

from docloom.plans import registry  # noqa: E402
from docloom.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for col in df.columns:
        if pd.api.types.is_float_dtype(df[col]):
            df[col] = df[col].map(lambda x: None if pd.isna(x) else format(x + 0.0, ".6f"))
        else:
            df[col] = df[col].map(lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and pd.isna(x)) or x is pd.NaT else str(x))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True) if len(df.columns) else df


def compare(left: pd.DataFrame, right: pd.DataFrame) -> str:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} vs {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    a, b = canonical(left), canonical(right)
    if a.equals(b):
        return "ok"
    diff = (a != b) & ~(a.isna() & b.isna())
    rows = diff.any(axis=1)
    return f"{rows.sum()} rows differ in {list(a.columns[diff.any()])}\n{a[rows].head(3)}\n{b[rows].head(3)}"


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    runnable, sql = registry.runnable(), registry.oracles()
    bad = 0
    for name in names or runnable:
        start = time.time()
        try:
            frame = runnable[name](spark, folder)
            types = dict(frame.dtypes)
            left = frame.toPandas()
            took = time.time() - start
            if name in sql:
                start = time.time()
                rel = con.execute(sql[name])
                kinds = {d[0]: str(d[1]) for d in rel.description}
                right = rel.df()
                verdict = compare(left, right)
                names_of = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT", "date": "DATE", "timestamp": "TIMESTAMP"}
                odd = {k: (v, kinds.get(k)) for k, v in types.items() if names_of.get(v, v) != kinds.get(k)}
                verdict += f"  types differ {odd}" if odd else ""
                verdict += f"  [sql {time.time() - start:.1f}s]"
            else:
                verdict = "no sql"
        except Exception as e:  # noqa: BLE001
            left, took, verdict = [], time.time() - start, f"ERROR {type(e).__name__} {str(e)[:1500]}"
        ok = verdict.startswith(("ok", "no sql"))
        bad += not ok
        print(f"{'PASS' if ok else 'FAIL'} {name:32s} rows={len(left):7d} {took:6.1f}s {verdict}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
