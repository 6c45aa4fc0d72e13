"""Registered queries on tables larger, later or odder than the driver's, against their SQL."""

from collections import Counter

import duckdb
import pytest

from alertlake.plans.catalog import ORACLE, QUERIES


def agree(spark, folder, name):
    """The query's rows are those of its SQL over the Parquet tables of a folder; returns how many there are."""
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    found = Counter(tuple(r[c] for c in columns) for r in QUERIES[name](spark, str(folder)).collect())
    assert found == Counter(want.fetchall())
    return sum(found.values())


@pytest.fixture(scope="module")
def late_suppliers(spark, tmp_path_factory):
    """Suppliers whose days go on for more than 5,000 days."""
    folder = tmp_path_factory.mktemp("late")
    rows = [(k, f"Supplier {k}", k % 25, 1.0) for k in (0, 1, 4999, 5000, 5001, 30_000)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(str(folder / "supplier.parquet"))
    return folder


@pytest.mark.parametrize(("name", "rows"), [("job_events", 12), ("job_reports", 42), ("job_archive_twice", 1), ("archive_purged", 1)])
def test_the_job_takes_every_suppliers_days(spark, late_suppliers, name, rows):
    assert agree(spark, late_suppliers, name) == rows
