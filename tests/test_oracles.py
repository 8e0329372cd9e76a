"""Every query with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import pathlib

import duckdb
import pytest

from lakeprobe.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in pathlib.Path(SF).iterdir():
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def text(value):
    value = value.tolist() if hasattr(value, "tolist") else value
    if isinstance(value, list):
        return str([text(v) for v in value])
    if value is None or str(value) in ("nan", "NaT", "<NA>"):
        return "None"
    if isinstance(value, (int, float)) and not isinstance(value, bool) and float(value).is_integer():
        return str(int(value))
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, db, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), db.execute(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda t: sorted(tuple(map(text, r)) for r in t[columns].itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0
