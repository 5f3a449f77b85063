"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from check import TABLES, compare
from regweave.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, small_dir, con, name):
    verdict = compare(QUERIES[name](spark, small_dir).toPandas(), con.execute(ORACLES[name]).df())
    assert verdict.startswith("ok"), verdict


def test_entry_is_lazy_and_stable(spark, small_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["regulator", "target", "gain"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
