"""Every registered query of the core against its SQL over the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import numpy as np
import pytest

from quillmill.plans import catalogue
from tests.conftest import DATA

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(canon(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = duck.sql(ORACLES[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    want = Counter(tuple(canon(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    got = Counter(tuple(canon(r[c]) for c in cols) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
