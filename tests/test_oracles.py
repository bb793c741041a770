"""Every registered query with SQL gives the same rows as DuckDB on the smallest data."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check  # noqa: E402

import __spark_entry__ as entry_points  # noqa: E402


@pytest.fixture(scope="module")
def con(folder):
    return check.connect(folder)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_sql(spark, con, folder, name):
    rows, _, _, difference = check.compare(spark, con, name, folder)
    assert difference is None


def test_entry_has_rows_and_hotspots(spark):
    out = entry_points.entry(spark)
    assert out.count() == 25 and "is_hotspot" in out.columns


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
