"""Every registered query of the engine against DuckDB on the smallest sample."""

import os

import duckdb
import pytest

from odarel import workload

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        return float(f"{v:.9g}") if isinstance(v, float) else str(v) if v is not None and not isinstance(v, (int, str)) else v

    return sorted(repr([value(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(workload.queries()))
def test_same(spark, con, name):
    df = workload.queries()[name](spark, SF)
    want = con.execute(workload.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert norm(df.collect(), df.columns) == norm(want.fetchall(), columns)


def test_entry_imports_alone():
    import __spark_entry__ as entry

    assert set(workload.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
