"""Every query of the library against its SQL counterpart on the smallest tables."""

import math

import duckdb
import pytest

from rationale.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return None if math.isnan(float(v)) else float(v)
    return str(v)


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-5 * max(1, abs(a)))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        again = [tuple(plain(r[c]) for c in columns) for r in registry.queries()[name](spark, DATA).collect()]
        order = lambda row: tuple(map(str, row))
        assert got, "rows, and the same ones on a second run; brute-force versions are in test_operators"
        assert len(got) == len(again) and all(close(x, y) for a, b in zip(sorted(got, key=order), sorted(again, key=order), strict=True) for x, y in zip(a, b, strict=True))
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    wanted = [tuple(plain(dict(zip(names, row, strict=True))[c]) for c in columns) for row in result.fetchall()]
    order = lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) if not isinstance(v, float) else (False, "n", round(v, 3)) for v in row)
    assert len(got) == len(wanted)
    for a, b in zip(sorted(got, key=order), sorted(wanted, key=order), strict=True):
        assert all(close(x, y) for x, y in zip(a, b, strict=True)), (a, b)
