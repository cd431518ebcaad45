"""Every registered query of the core against its oracle SQL on the smallest tables."""

import glob
import math
import os

import pytest

from factweave.plans import REGISTRIES

DATA = "/root/testdata/sf0.001"
QUERIES = {n: f for r in REGISTRIES for n, f in r.queries.items()}
SQL = {n: s for r in REGISTRIES for n, s in r.sql.items()}


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    if name in SQL:
        r = duck.execute(SQL[name])
        names = [d[0] for d in r.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        assert sorted(names) == cols
        want = sorted((tuple(plain(x[i]) for i in order) for x in r.fetchall()), key=repr)
        assert got == want
