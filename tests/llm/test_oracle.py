"""Corpus queries against their DuckDB counterparts."""

from pathlib import Path

import duckdb
import pytest

oracle = pytest.importorskip("lamina.llm.oracle")


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_matches_oracle(spark, name):
    from lamina.llm.queries import QUERIES

    data = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    wanted = connection.execute(oracle.ORACLE_SQL[name]).df()
    mine = QUERIES[name](spark, data).toPandas()
    assert sorted(mine.columns) == sorted(wanted.columns)
    columns = sorted(mine.columns)
    assert sorted(map(tuple, mine[columns].to_numpy().tolist())) == sorted(map(tuple, wanted[columns].to_numpy().tolist()))
