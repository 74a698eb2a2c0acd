"""Every query with SQL gives DuckDB's rows at sf0.001."""

import os

import duckdb
import pandas as pd
import pytest

from mediaspan.plans import choices, editing, headlines, pixels, scripts, sound  # noqa: F401
from mediaspan.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda x: None if x is None or x is pd.NA or x != x else x.item() if hasattr(x, "item") else x
    return list(frame.columns), sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(SQL[name]).df())
