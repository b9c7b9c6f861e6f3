"""Every core query against its SQL on the smallest tables; without SQL it must run."""

import datetime as dt
import glob
import importlib
import math
import os
from collections import Counter

import pytest

import __spark_entry__

CORE = {k: (f, r.sql.get(k)) for m in __spark_entry__.CORE for r in [importlib.import_module(m).R] for k, f in r.queries.items()}


def norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.date):
        return str(v)[:19].replace(" 00:00:00", "")
    return v


@pytest.fixture(scope="module")
def oracle(small):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, small, oracle, name):
    query, sql = CORE[name]
    df = query(spark, small)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    if sql is None:
        return
    res = oracle.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    want = Counter(tuple(norm(v) for v in r) for r in res)
    assert got == want


def test_entry(spark, small):
    assert __spark_entry__.entry(spark).columns == ["record_id", "title", "day", "venue", "address"]
