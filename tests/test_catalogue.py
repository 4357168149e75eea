"""Every catalogue query against its DuckDB counterpart on the smallest tables."""

import numbers
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from lamina.plans import files  # noqa: F401
from lamina.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(value):
    """One form for values that pandas types differently on both sides (nullable integers, numpy scalars)."""
    if pd.isna(value):
        return None
    if isinstance(value, numbers.Number) and not isinstance(value, bool):
        return round(float(value), 6)
    return str(value)


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, oracle, name):
    mine = QUERIES[name](spark, DATA).toPandas()
    theirs = oracle.execute(ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert canonical(mine) == canonical(theirs)
