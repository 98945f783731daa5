"""Every query with a SQL twin gives the twin's rows; every other one runs."""

import math
from pathlib import Path

import duckdb
import pytest

from newsgrain.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, int):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else format(v + 0.0, ".9g")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    if name not in registry.SQL:
        assert rows
        return
    found = duck.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    at = [names.index(c) for c in sorted(names)]
    assert sorted(names) == columns
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_names_match():
    assert set(registry.SQL) <= set(registry.QUERIES)
