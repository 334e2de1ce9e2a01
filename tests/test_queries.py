"""Every registered raster query against its DuckDB SQL."""

from __future__ import annotations

import pytest
from conftest import SMALL

import __spark_entry__ as entry
from scanloom.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    ours = QUERIES[name](spark, SMALL).toPandas()
    if name not in ORACLES:
        assert len(ours)
        return
    theirs = duck.execute(ORACLES[name]).fetch_df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = (t[columns].sort_values(columns).reset_index(drop=True) for t in (ours, theirs))
    assert [str(t) for t in a.dtypes] == [str(t) for t in b.dtypes]
    assert a.equals(b)


def test_entry(spark):
    assert entry.entry(spark).count() == 64 * 48
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_seamless_paste_takes_the_whole_page(spark):
    out = QUERIES["seamless_paste"](spark, SMALL)
    assert {(r.x, r.y) for r in out.select("x", "y").distinct().collect()} == {(x, y) for x in range(64) for y in range(48)}
