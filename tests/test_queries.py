"""Every query against its statement in DuckDB, on the smallest tables."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from lakemill.plans.catalogue import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(value: object) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value.normalize()) if isinstance(value, Decimal) else repr(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    assert name in ORACLES
    told = duck.execute(ORACLES[name])
    names = [x[0] for x in told.description]
    assert sorted(names) == columns
    expected = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in told.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in found.collect()) == expected


def test_entry_points():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def same_day(tmp_path_factory):
    """Customers whose first change comes on the day that their seed starts, and orders from before that day."""
    folder = str(tmp_path_factory.mktemp("same_day"))
    con = duckdb.connect()
    changed = {"customer": "c_custkey + 200 AS c_custkey", "orders": "o_custkey % 150 + 200 AS o_custkey", "events": "214 + event_id % 30 AS user_id, TIMESTAMP '2024-01-01 08:00:00' + to_days(CAST(event_id % 30 + event_id // 300 AS INTEGER)) AS ts"}
    for name in ("customer", "orders", "events", "part", "supplier"):
        replaced = f" REPLACE ({changed[name]})" if name in changed else ""
        con.execute(f"COPY (SELECT *{replaced} FROM '{SF_DIR}/{name}.parquet') TO '{folder}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["pit_fact_full", "fact_quarantine", "fact_segment_sales"])
def test_earliest_version_of_two_that_start_on_one_day(spark, same_day, name):
    folder, con = same_day
    found = QUERIES[name](spark, folder)
    told = con.execute(ORACLES[name])
    names = [x[0] for x in told.description]
    expected = sorted(tuple(map(plain, row)) for row in told.fetchall())
    assert sorted(tuple(plain(row[c]) for c in names) for row in found.collect()) == expected
