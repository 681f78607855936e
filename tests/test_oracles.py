"""Every query with an SQL oracle, on the small tables."""

import os
from collections import Counter

import duckdb
import pytest

from ledgerloom.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for name in ("orders", "customer", "supplier", "part"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(name, spark, sf_dir, duck):
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables here")
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert df.columns
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    assert Counter(map(tuple, rows)) == Counter(tuple(r[i] for i in at) for r in found.fetchall())
