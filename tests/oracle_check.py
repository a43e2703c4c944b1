"""Runs registered queries next to their SQL: ``python tests/oracle_check.py SF_DIR [name ...]``."""

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bytes | bytearray):
            return bytes(v).hex()
        return round(float(v), 6) if isinstance(v, float) else v

    rows = [tuple(cell(v) for v in r) for r in frame.astype(object).itertuples(index=False)]
    rows.sort(key=lambda r: tuple((v is not None, str(v)) for v in r))
    return pd.DataFrame(rows, columns=frame.columns, dtype=object)


def compare(df, con, sql):
    """None when equal, otherwise what differs."""
    relation = con.sql(sql)
    kinds = {c: TYPES.get(str(t), str(t)) for c, t in zip(relation.columns, relation.types)}
    if dict(df.dtypes) != kinds:
        return f"types {sorted(set(dict(df.dtypes).items()) ^ set(kinds.items()))}"
    got, want = canonical(df.toPandas()), canonical(relation.df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} != {list(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for a, b in zip(got.itertuples(index=False), want.itertuples(index=False)):
        if tuple(a) != tuple(b):
            return f"{tuple(a)} != {tuple(b)}"[:600]
    return None


def main(sf_dir, names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        df = queries[name](spark, sf_dir)
        if name in oracles:
            verdict = compare(df, con, oracles[name]) or "ok"
        else:
            verdict = f"{df.count()} rows, no SQL"
        print(f"{name:24s} {time.time() - start:6.2f}s  {verdict}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
