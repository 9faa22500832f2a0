"""Work that rows share is done once: windows, distributions, spectra as arrays, frames read from one end."""

import contextlib
import io
import random

import numpy as np

from ionquarry.operators import alignment, envelopes, matching
from ionquarry.plans import catalog, queries
from ionquarry.sources import views

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_no_frame_is_read_again_for_each_row(spark):
    rows = [("a", s, float(s * s) if s in (2, 5, 6) else None) for s in range(9)] + [("b", 1, None)]
    got = alignment.between_samples(spark.createDataFrame(rows, "anchor_id string, sample_id long, rt double"))
    assert "unboundedfollowing" not in plan(got).lower()
    found = {(x.anchor_id, x.sample_id): x.rt_filled for x in got.collect()}
    assert [found["a", s] for s in range(9)] == [4.0, 4.0, 4.0, 11.0, 18.0, 25.0, 36.0, 36.0, 36.0] and found["b", 1] is None


def test_distributions_are_those_of_distinct_numbers(spark):
    assert "Join" in plan(queries.QUERIES["c13_all_distribution"](spark, SF))


def test_compounds_of_one_mz_are_joined_together(spark):
    assert "collect_list" in plan(queries.QUERIES["library_ppm_join"](spark, SF))


def test_equal_windows_are_looked_up_once(spark):
    r = random.Random(5)
    windows = [(g, i, 100.0 + i, 99.9 + i, 100.1 + i, 1.0, 0.0, 50.0) for g in range(30) for i in range(3)]
    points = [(s, c, float(c), 100.0 + r.randrange(4) + r.random() * 0.3 - 0.15, r.random()) for s in range(2) for c in range(60)]
    a = spark.createDataFrame(windows, "group_id long, isotope long, mz double, mzmin double, mzmax double, proportion double, rtmin double, rtmax double")
    b = spark.createDataFrame(points, "sample_id long, scan_id long, rt double, mz double, intensity double")
    want = {}
    for g, i, _, low, high, _, _, last in windows:
        for s, c, rt, mz, y in points:
            if low <= mz <= high and rt <= last:
                want[g, i, s, c] = max(y, want.get((g, i, s, c), 0.0))
    assert {(x.group_id, x.isotope, x.sample_id, x.scan_id): x._y for x in envelopes._scans(a, b).collect()} == want


def test_every_compound_has_its_isotope_children(spark):
    found = catalog.QUERIES["isotope_children"](spark, SF)
    parents = {x.child_id.split("/")[0] for x in found.filter("isotope = 'C12 PARENT'").collect()}
    assert parents == {str(x.compound_id) for x in views.library(spark, SF).select("compound_id").collect()} and len(parents) > 100
    assert found.filter("parent_group_id IS NOT NULL AND samples > 0").select("parent_group_id").distinct().count() == len(parents)


def test_spectra_are_arrays_as_well_as_rows():
    rows = [{"mz": 3.0, "intensity": 1.0}, {"mz": 1.0, "intensity": 2.0}, {"mz": 2.0, "intensity": 5.0}]
    sides = ([3.0, 1.0, 2.0], [1.0, 2.0, 5.0])
    assert all(np.array_equal(x, y) for x, y in zip(matching._arrays(rows), matching._arrays(sides), strict=True))
    assert matching.score(rows, rows[:2], 700.0, 700.0, 5) == matching.score(sides, (sides[0][:2], sides[1][:2]), 700.0, 700.0, 5)
    assert matching.consensus([rows, rows[1:]], [700.0, 700.0], 5) == matching.consensus([sides, (sides[0][1:], sides[1][1:])], [700.0, 700.0], 5)
    assert all(len(x) == 0 for x in matching._arrays((None, None)))
