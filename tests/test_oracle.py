"""Every query that has SQL, against DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from pagewright import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(table):
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(value, r)) for r in zip(*[table.column(c).to_pylist() for c in sorted(table.column_names)], strict=True)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    ours, theirs = catalog.QUERIES[name](spark, SF).toArrow(), con.execute(catalog.ORACLE[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert _rows(ours) == _rows(theirs)
