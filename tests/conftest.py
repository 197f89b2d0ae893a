"""One local session for all tests, and a DuckDB connection over the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from broadsheet.session import TABLES, local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", shuffle=4)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def sf() -> str:
    return SF
