"""Registered queries on tables whose keys are as large as those of larger copies, against their SQL."""

import os

import duckdb
import pytest
from test_queries import SF, TABLES, plain

from wayleave.plans import registry

PARTS = 1_000_000


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """The small tables with part keys from PARTS on."""
    d = tmp_path_factory.mktemp("shifted")
    con = duckdb.connect()
    for t in TABLES:
        if t in ("part", "lineitem"):
            key = f"{t[0]}_partkey"
            con.execute(f"COPY (SELECT * REPLACE ({key} + {PARTS} AS {key}) FROM '{SF}/{t}.parquet') TO '{d}/{t}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{d}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return str(d), con


@pytest.mark.parametrize("name", ["S12_cad_rights", "O01_newest_rights", "S03_cad_sections", "A22_register_summary", "S13_cad_warnings"])
def test_rights_stay_in_their_section(name, spark, shifted):
    d, con = shifted
    df = registry.QUERIES[name](spark, d)
    names = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in names)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert want and plain(tuple(r) for r in df.select(*(f"`{c}`" for c in names)).collect()) == plain(want)
