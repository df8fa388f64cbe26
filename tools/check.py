"""Run queries and their check SQL side by side and compare rows.

usage: python tools/check.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import tempfile
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from gridevents import catalog  # noqa: E402


def session() -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").appName("check")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir", os.environ.get("SHARED_DIR") or tempfile.mkdtemp(prefix="shared-"))
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows sorted, values comparable."""
    out = frame[sorted(frame.columns)].copy()
    for name in out.columns:
        col = out[name]
        if str(col.dtype).startswith("datetime"):
            out[name] = col.astype("datetime64[us]").astype(str)
        elif col.dtype == object or str(col.dtype) in ("string", "str", "boolean", "bool"):
            out[name] = col.astype(str).replace({"None": "", "nan": "", "<NA>": ""})
        else:
            out[name] = col.astype(float)
    return out.sort_values(list(out.columns), ignore_index=True)


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = session()
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    oracles, bad = catalog.oracles(), []
    for name, fn in catalog.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            got = fn(spark, folder).toPandas()
            took = time.time() - start
            if name not in oracles:
                print(f"rows  {name:32s} {len(got):8d} rows {took:6.1f}s", flush=True)
                continue
            want = con.execute(oracles[name]).df()
            if sorted(got.columns) != sorted(want.columns):
                raise AssertionError(f"columns {sorted(got.columns)} != {sorted(want.columns)}")
            if len(got) != len(want):
                raise AssertionError(f"rows {len(got)} != {len(want)}")
            types = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns
                     if str(got[c].dtype).split('[')[0] != str(want[c].dtype).split('[')[0]}
            a, b = canonical(got), canonical(want)
            diff = [c for c in a.columns if not a[c].equals(b[c])]
            if diff:
                i = (a[diff[0]].ne(b[diff[0]]) & ~(a[diff[0]].isna() & b[diff[0]].isna())).idxmax()
                raise AssertionError(f"values differ in {diff}: {a.loc[i].to_dict()} != {b.loc[i].to_dict()}")
            note = f" types {types}" if types else ""
            print(f"ok    {name:32s} {len(got):8d} rows {took:6.1f}s{note}", flush=True)
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL  {name:32s} {str(error)[:900]}", flush=True)
    print(f"{len(bad)} failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
