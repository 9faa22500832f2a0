import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionquarry.operators import alignment, envelopes, neural
from ionquarry.operators import trace_kernels as K


def test_alignment_brings_shifted_samples_together(spark):
    r = random.Random(1)
    rows = []
    for g in range(40):
        rt = 1 + g * 0.5
        for s, shift in enumerate((0.0, 0.0, 0.0, 0.4)):
            rows.append((g, s, rt + shift + 0.02 * (s == 3) * rt + r.gauss(0, 0.005)))
    peaks = spark.createDataFrame(rows, "group_id long, sample_id long, rt double")
    before = {x.sample_id: x.error for x in alignment.fit_error(peaks, ["group_id"]).collect()}
    out = alignment.aligned(peaks, ["group_id"], rounds=2)
    after = {x.sample_id: x.error for x in alignment.fit_error(out.select("group_id", "sample_id", "rt"), ["group_id"]).collect()}
    assert after[3] < 0.1 * before[3] and out.count() == 160
    back = {(x.group_id, x.sample_id): x.rt for x in alignment.restored(out).collect()}
    assert all(back[g, s] == rt for g, s, rt in rows)


def plain_points(rows):
    """Points of each sample that count for its fit, as (rt, median), by plain loops and numpy."""
    groups, of = {}, {}
    for g, s, rt in rows:
        groups.setdefault(g, []).append(rt)
    for g, s, rt in rows:
        if len(groups[g]) > 1:
            of.setdefault(s, {}).setdefault(rt, []).append(float(np.median(groups[g])))
    out = {}
    for s, at in of.items():
        x, y = np.array([(rt, m) for rt, ms in at.items() for m in sorted(ms)[:5]]).T
        if len(x) >= 10:
            u, d = (x - x.mean()) / (x.std() or 1), (y - x) / (x.std() or 1)
            r = (np.polyval(np.polyfit(u, d, 3), u) - d) ** 2
            keep = (r - r.mean()) / r.std() <= 1.5 if r.std() > 1e-15 else np.ones(len(x), bool)
            out[s] = sorted(zip(x[keep].tolist(), y[keep].tolist(), strict=True))
    return out


def bent(seed, groups=60):
    """Peaks of samples that are bent, shifted, or have outliers and repeated rts; one sample has few."""
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        rt = 1 + g * 0.5
        for s in range(5):
            moved = rt + (0.0, 0.3, 0.02 * rt, 0.001 * rt * rt, 0.0)[s] + r.gauss(0, 0.01) + (3.0 if r.random() < 0.03 else 0.0)
            rows.append((g, s, round(moved, 1) if s == 4 else moved))
        if g < 5:
            rows.append((g, 9, rt + 0.5))
    return rows + [(1000 + k, 4, 2.0) for k in range(9)] + [(1000 + k, 1, 2.1 + k) for k in range(9)] + [(5000, 0, 1.0)]


PEAKS = "group_id long, sample_id long, rt double"


def test_fits_by_sums_equal_fits_on_points(spark):
    rows = bent(3)
    table = spark.createDataFrame(rows + [(0, 1, None), (0, None, 1.0)], PEAKS)
    points = alignment.fit_points(table, ["group_id"]).checkpoint()
    held = {}
    for x in points.collect():
        held.setdefault(x.sample_id, []).append((x.rt, x._median))
    expected = plain_points(rows)
    assert set(held) == set(expected) == {0, 1, 2, 3, 4}
    assert all(np.allclose(sorted(held[s]), expected[s]) for s in held)
    tried = points.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(11)))).filter(alignment.in_half(F.col("_k"), 7)).collect()
    found = {x.sample_id: x.coefficients for x in alignment.polynomial_fits(table, ["group_id"], seed=7).collect()}
    for s, every in expected.items():
        x, y = np.array(every).T
        best, least = None, np.sqrt(((x - y) ** 2).mean())
        for degree in (1, 2, 3):
            for k in range(1, 12):
                some = [(t.rt, t._median) for t in tried if t.sample_id == s and t._k == k]
                fit = np.polyfit(*np.array(some).T, degree)
                error = np.sqrt(((np.polyval(fit, x) - y) ** 2).mean())
                assert 0.2 * len(x) < len(some) < 0.8 * len(x)
                if error < least - 1e-9:
                    best, least = fit, error
        if best is None:
            assert found[s] is None
        else:
            assert np.polyval(found[s], x) == pytest.approx(np.polyval(best, x), abs=1e-6)


def test_errors_fall_round_by_round(spark):
    rows = bent(4)
    table = spark.createDataFrame(rows + rows[:7] + [(0, 1, None)], PEAKS)
    out, errors = alignment.aligned_rounds(table, ["group_id"], rounds=4)
    assert len(errors) > 1 and all(b < a for a, b in zip(errors, errors[1:], strict=False)) and errors[-1] < 0.8 * errors[0]
    assert out.count() == len(rows) + 8 and sorted(x.rt_original for x in out.collect() if x.rt is not None) == sorted(r[2] for r in rows + rows[:7])
    few = spark.createDataFrame(rows[:9], PEAKS)
    same, none = alignment.aligned_rounds(few, ["group_id"])
    assert len(none) == 1 and all(x.rt == x.rt_original for x in same.collect())
    assert alignment.aligned(spark.createDataFrame([], PEAKS), ["group_id"]).count() == 0


def test_segments_need_rising_updates(spark):
    anchors = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 1.5), ("a", 3.0, 4.0), ("a", 3.0, 5.0)], "sample_id string, rt double, rt_update double")
    segs = alignment.segments(anchors)
    points = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 9.0), ("b", 1.0)], "sample_id string, rt double")
    got = {(x.sample_id, x.rt): x.rt_update for x in alignment.updated(points, segs).collect()}
    assert got == {("a", 0.0): 1.0, ("a", 1.0): 2.0, ("a", 2.0): 3.0, ("a", 3.0): 4.0, ("a", 9.0): 10.0, ("b", 1.0): 1.0}


def test_isotopes_are_pulled_and_corrected(spark):
    groups = spark.createDataFrame([(7, "C6H12O6", "[M+H]+", 181.071, 1.0, 2.0)], "group_id long, formula string, adduct string, mz double, rtmin double, rtmax double")
    windows = envelopes.isotope_windows(groups, 10.0, {"C": 2})
    listed = {x.isotope: x for x in windows.collect()}
    parent = listed["C12 PARENT"]
    assert parent.mz == pytest.approx(181.071) and len(listed) == 3
    one = next(x for k, x in listed.items() if k.startswith("[13C]1"))
    assert one.mz - parent.mz == pytest.approx(1.00335483521) and one.proportion == pytest.approx(6 * 0.0107 / 0.9893, rel=1e-3)
    rows = [(1, k, 1.0 + k / 10, parent.mz, 100.0 * (k + 1)) for k in range(3)] + [(1, k, 1.0 + k / 10, one.mz, 20.0 * (k + 1)) for k in range(3)] + [(1, 9, 5.0, parent.mz, 1e6), (1, 1, 1.1, parent.mz + 1e-4, 1.0)]
    points = spark.createDataFrame(rows, "sample_id long, scan_id long, rt double, mz double, intensity double")
    quant = envelopes.extracted(windows, points)
    got = {x.isotope: x for x in envelopes.corrected(quant, windows).collect()}
    assert got["C12 PARENT"].intensity == 600 and got["C12 PARENT"].corrected == 600 and got["C12 PARENT"].apex_rt == 1.2
    assert got[one.isotope].intensity == 120 and got[one.isotope].corrected == pytest.approx(120 - 600 * one.proportion)
    assert envelopes.correlated_extraction(windows, points).count() == 2 and envelopes.enough_isotopes(quant, 3).count() == 0


def test_network_learns_and_is_saved():
    import numpy as np

    x = np.array([[0, 0], [0, 1], [1, 0], [1, 1.0]])
    y = np.array([[0], [1], [1], [1.0]])
    w = neural.train(x, y, hidden=4, rounds=8000, rate=2.0)
    assert (neural.forward(w, x) > 0.5).astype(int).ravel().tolist() == [0, 1, 1, 1]
    assert all((a == b).all() for a, b in zip(neural.loaded(neural.saved(w)), w, strict=True))
    with pytest.raises(ValueError):
        neural.loaded("2 1\n0.5\n")


def test_centroids_of_a_table(spark):
    from ionquarry.operators import peaks

    rows = [("s", 500 + k / 100, 100 * 2.718281828 ** (-0.5 * ((k - 40) / 4) ** 2)) for k in range(100)]
    got = peaks.centroids(spark.createDataFrame(rows, "id string, mz double, intensity double"), ["id"]).filter(F.col("intensity") > 1).collect()
    assert [(x.mz, round(x.intensity)) for x in got] == [(500.4, 100)] and K.centroided is not None


def test_isotopes_near_the_apex(spark):
    windows = spark.createDataFrame([(1, "C12 PARENT", 100.0, 99.99, 100.01, 0.9, 1.0), (1, "x", 101.0, 100.99, 101.01, 0.1, 0.11), (1, "rare", 102.0, 101.99, 102.01, 1e-9, 1e-9)], "group_id long, isotope string, mz double, mzmin double, mzmax double, abundance double, proportion double").withColumns({"rtmin": F.lit(0.0), "rtmax": F.lit(9.0)})
    parents = spark.createDataFrame([(1, 5, 10, 100.0)], "group_id long, sample_id long, scan_id long, intensity double")
    rows = [(5, 10, 1.0, 100.0, 100.0), (5, 9, 0.9, 101.0, 11.0), (5, 12, 1.2, 101.0, 10.0), (5, 13, 1.3, 101.0, 99.0), (5, 10, 1.0, 102.0, 1.0), (6, 10, 1.0, 101.0, 500.0)]
    points = spark.createDataFrame(rows, "sample_id long, scan_id long, rt double, mz double, intensity double")
    got = {x.isotope: (x.rt, x.intensity) for x in envelopes.near_apex(windows, parents, points).collect()}
    assert got == {"C12 PARENT": (1.0, 100.0), "x": (0.9, 11.0), "rare": (1.0, 1.0)}
    strict = envelopes.near_apex(windows, parents, points, 20.0)
    assert {x.isotope for x in strict.collect()} == {"C12 PARENT", "x"} and {x.isotope for x in envelopes.near_apex(windows, parents, points, 0.1).collect()} == {"C12 PARENT"}
    peaks = spark.createDataFrame([(1, "x", 5, 0.8, 7.0), (1, "x", 5, 0.95, 9.0), (1, "x", 5, 5.0, 1.0)], "group_id long, isotope string, sample_id long, rt double, area double")
    assert [x.area for x in envelopes.nearest_peaks(strict, peaks, 0.2).collect()] == [9.0] and envelopes.nearest_peaks(strict, peaks, 0.01).count() == 0
