"""Every registered query of the registry against its SQL in DuckDB."""

import math

import duckdb
import pytest

from wayleave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return (1, "")
        if isinstance(x, bool):
            return (0, str(x))
        if isinstance(x, (int, float)):
            return (0, f"{float(x):.6f}")
        return (0, str(x))

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*(f"`{c}`" for c in names)).collect())
    if name in registry.ORACLE_SQL:
        want = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in names)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
        assert got == plain(want)
