"""Run a named query on Spark and its SQL oracle on DuckDB; compare results."""

from __future__ import annotations

import math
from collections import Counter

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

SPARK_TO_DUCK = {"LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE",
                 "StringType": "VARCHAR", "BooleanType": "BOOLEAN", "FloatType": "FLOAT",
                 "ShortType": "SMALLINT", "ByteType": "TINYINT"}


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(float(v))  # strict: -0.0 differs from 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def compare(spark, name: str, sf_dir: str, queries: dict, oracle: dict, con=None) -> dict:
    sdf = queries[name](spark, sf_dir)
    scols = sdf.columns
    stypes = {f.name: type(f.dataType).__name__ for f in sdf.schema.fields}
    srows = sdf.collect()
    con = con or duck(sf_dir)
    rel = con.sql(oracle[name])
    dcols = rel.columns
    dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    drows = rel.fetchall()
    out = {"name": name, "spark_rows": len(srows), "oracle_rows": len(drows)}
    if sorted(scols) != sorted(dcols):
        out["error"] = f"columns differ: spark={scols} oracle={dcols}"
        return out
    order = sorted(scols)
    bad_types = {c: (stypes[c], dtypes[c]) for c in order
                 if SPARK_TO_DUCK.get(stypes[c], stypes[c]) != dtypes[c]}
    if bad_types:
        out["type_mismatch"] = bad_types
    sidx = [scols.index(c) for c in order]
    didx = [dcols.index(c) for c in order]
    sc = Counter(tuple(_norm(r[i]) for i in sidx) for r in srows)
    dc = Counter(tuple(_norm(r[i]) for i in didx) for r in drows)
    out["match"] = sc == dc
    if not out["match"]:
        only_s = list((sc - dc).elements())[:5]
        only_d = list((dc - sc).elements())[:5]
        out["only_spark"] = only_s
        out["only_oracle"] = only_d
        out["columns"] = order
    return out
