import os

import duckdb
import pytest

from ionquarry.plans import catalog

SF = "/root/testdata/sf0.001"
#: Queries whose kernels give no rows on the smallest tables, if any.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    out = duckdb.connect()
    out.sql("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        out.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return out


def plain(rows):
    cell = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted(repr([cell(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLES])
def test_query_equals_its_sql(spark, duck, name):
    found, expected = catalog.QUERIES[name](spark, SF), duck.sql(catalog.ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert plain(found.collect()) == plain(expected.select(*[f'"{c}"' for c in found.columns]).fetchall())


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLES])
def test_query_without_sql_runs(spark, name):
    found = catalog.QUERIES[name](spark, SF)
    rows = found.collect()
    assert rows or name in MAY_BE_EMPTY
    assert len(set(found.columns)) == len(found.columns)


JOINS = ["library_ppm_join", "srm_transition_join", "precursor_purity", "slice_lookup", "fragmentation_events", "srm_amu", "background_subtracted", "best_windows", "ms3_search", "sec_near_peaks", "rt_segment_table", "precursor_highest"]


@pytest.mark.parametrize("name", JOINS)
def test_tolerance_joins_have_no_nested_loop(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
