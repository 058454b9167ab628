"""Every core query against its oracle on the smallest tables; the others run and give rows."""

import math

import duckdb
import pytest

from ledgerleaf.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canon(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "-"
        if isinstance(v, bool):
            return str(int(v))
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) or hasattr(v, "__float__") else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*(f"`{c}`" for c in cols)).collect()]
    if name not in registry.ORACLES:
        assert rows
        return
    got = duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == cols
    want = got.select(*(f'"{c}"' for c in cols)).fetchall() if hasattr(got, "fetchall") else []
    assert canon(rows) == canon(want)
