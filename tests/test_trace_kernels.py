"""Traces with known peaks, and plain versions of what the kernels compute."""

import math
import random

import numpy as np
import pytest

from ionquarry.operators import peaks as P
from ionquarry.operators import trace_kernels as K


def bumps(*centres, n=60, height=100.0, width=2.0):
    x = np.arange(n, dtype=float)
    return x / 10, np.full(n, 150.0), sum(height * np.exp(-0.5 * ((x - c) / width) ** 2) for c in centres)


def test_smoothing_against_sums():
    r = random.Random(1)
    for n in (1, 2, 5, 12, 40):
        y = np.array([r.random() * 100 for _ in range(n)])
        for window in (0, 3, 4, 5, 9):
            w = 3 if window <= 0 else window + 1 - window % 2
            step = 1.17741 / ((w - 1) / 2)
            reach = int(3 / step) + 1
            for i in range(n):
                near = [(math.exp(-0.5 * ((j - i) * step) ** 2), y[j]) for j in range(n) if abs(j - i) <= reach]
                assert K.gaussian(y, window)[i] == pytest.approx(sum(a * b for a, b in near) / sum(a for a, _ in near))
        assert K.moving_average(y, 5) == pytest.approx([y[max(0, i - 2) : i + 3].mean() for i in range(n)])
    assert K.savgol(np.arange(20.0) ** 3, 3) == pytest.approx(np.arange(20.0) ** 3)
    assert list(K.smoothed(np.array([1.0, 5.0, 1.0]), 5)) == [1, 5, 1]


def test_baseline_clips_at_a_quantile():
    y = np.r_[np.ones(90), np.full(10, 1000.0)]
    base, cut = K.baseline(y, 5, 20)
    assert cut == 1 and base == pytest.approx(np.ones(100))
    base, cut = K.baseline(y, 5, 101)
    assert cut == -1 and base.max() > 100
    assert len(K.baseline(np.zeros(0), 5, 20)[0]) == 0


def test_maxima_and_plateaus():
    s = np.array([0, 2, 1, 3, 3, 3, 1, 4, 4, 5, 5.0])
    assert K.maxima(s) == [1, 5] and K.maxima(s, plateaus=False) == [1]
    assert K.maxima(np.zeros(5)) == [] and K.maxima(np.array([])) == []
    assert K.global_maximum(np.array([0, 2, 0, 5, 0, 5, 0.0])) == [3] and K.global_maximum(np.array([9, 2, 3, 1.0])) == []


def test_two_peaks_with_one_minimum_between():
    rt, mz, y = bumps(20, 32)
    found = K.pick(rt, mz, y, K.Picking(drop_top=60))
    assert [p["pos"] for p in found] == [20, 32] and found[0]["maxpos"] == found[1]["minpos"] == 26
    assert found[0]["rank"] + found[1]["rank"] == 1
    one = found[0]
    lo, hi = one["minpos"], one["maxpos"]
    assert one["area"] == pytest.approx(y[lo : hi + 1].sum()) and one["area_top"] == pytest.approx(y[19:22].mean())
    assert one["half_left"] < 20 < one["half_right"] and one["area_fwhm"] == pytest.approx(y[one["half_left"] : one["half_right"] + 1].sum())
    assert one["mz_median"] == 150 and one["rt"] == 2.0 and one["sigma"] > 0


def test_edges_flat_and_empty_traces():
    x = np.arange(30.0)
    falling = 100 * np.exp(-x / 5)
    assert K.pick(x, x, falling) == [] and [p["pos"] for p in K.pick(x, x, falling, K.Picking(edges=True))] == [0]
    assert [p["pos"] for p in K.pick(x, x, falling[::-1].copy(), K.Picking(edges=True))] == [29]
    for y in (np.zeros(30), np.full(30, 7.0)):
        assert K.pick(x, x, y, K.Picking(edges=True)) == [] and K.simple_peaks(x, x, y) == []
    for n in (0, 1, 2):
        assert K.pick(x[:n], x[:n], x[:n]) == []
    rt, mz, y = bumps(20)
    assert K.pick(rt, mz, y, K.Picking(bounds=False)) == [{"pos": 20, "rt": 2.0}]


def test_bounds_stop_at_fraction_and_slope():
    rt, mz, y = bumps(30)
    wide, cut, steep = (K.pick(rt, mz, y, K.Picking(drop_top=90, **o))[0] for o in ({}, {"rt_fraction": 0.5}, {"slope": 1.0}))
    assert wide["minpos"] < cut["minpos"] and wide["minpos"] < steep["minpos"]
    assert all(y[i] >= 0.5 * y[30] for i in range(cut["minpos"], cut["maxpos"] + 1))


def test_non_peak_baseline():
    rt, mz, y = bumps(30)
    y = y + 5
    found = K.pick(rt, mz, y, K.Picking(drop_top=90, rt_fraction=0.1, baseline="non_peak_max"))[0]
    s = K.smoothed(y, 5)
    outside = np.r_[s[: found["minpos"]], s[found["maxpos"] + 1 :]].max()
    assert found["baseline"] == pytest.approx(outside, rel=0.02) and found["baseline"] > 5


def test_patterns():
    assert K.pattern(np.array([0, 1, 2, 2, 1, 0.0]), np.zeros(6)) == "0+++-0"
    assert K.longest_symmetry("0++--+-") == 4 and K.longest_stretch("0++--+++", "+") == 3 and K.switches("+-+0") == 3 and K.switches("+-+-", "+", "-") == 2
    assert K.noisiness("00+-+-00") == 0.25 and K.noisiness("000") == 0


def test_gaussian_fit_finds_the_width():
    x = np.arange(-10, 11)
    sigma, error = K.gaussian_fit(np.exp(-0.5 * (x / 4) ** 2))
    assert 3 < sigma < 5.5 and error < 0.001
    assert K.gaussian_fit(np.ones(9)) == (0.0, 0.03)


def test_overlap_and_covered_peaks():
    assert K.overlap(0, 2, 1, 3) == pytest.approx(1 / 3) and K.overlap(0, 5, 1, 2) == 1 and K.overlap(0, 1, 2, 3) == 0
    spans = [(0, 10, 5), (0.1, 9.9, 7), (20, 30, 1)]
    held = [{"rtmin": a, "rtmax": b, "area": c} for a, b, c in spans]
    assert [p["area"] for p in K.without_covered(held)] == [7, 1]


def test_numeric_kernels():
    assert list(K.interpolated(np.array([0, 2, 0, 0, 8, 0.0]))) == [0, 2, 4, 6, 8, 0]
    x = np.array([0, 1, 2.5, 4.0])
    assert K.cubic_spline(x, 3 * x + 1, np.array([0.5, 3.0])) == pytest.approx([2.5, 10.0])
    assert K.cubic_spline(x, x**2, x) == pytest.approx(x**2)
    assert K.power_spectrum(np.array([1.0, -1.0, 1.0, -1.0])) == pytest.approx([0, 0, 16])
    y = np.array([0, 0, 1, 5, 1, 0, 0, 0.0])
    assert K.shifted_correlation_z(y, y) > 5 and K.shifted_correlation_z(np.zeros(0), y) == 0
    profile = 100 * np.exp(-0.5 * ((np.arange(100) - 40) / 4) ** 2)
    assert [c for c in K.centroided(profile, 500 + np.arange(100) / 100) if c[1] > 1] == [(500.4, pytest.approx(100))]
    assert K.centroided(np.ones(4), np.ones(4)) == []


def test_picking_by_trace_equals_the_kernel(spark):
    r = random.Random(3)
    rows, expected = [], []
    for s in range(4):
        y = [r.random() * 50 for _ in range(40)] if s else []
        rows += [(s, float(k), 100.0, v) for k, v in enumerate(y)]
        expected += [(s, p["pos"], p["rank"], round(p["area"], 6)) for p in K.pick(np.arange(float(len(y))), np.full(len(y), 100.0), np.array(y))]
    rows += [(9, None, 1.0, 5.0), (9, 1.0, None, 5.0), (9, 2.0, None, None)]
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "sample_id long, rt double, mz double, intensity double").repartition(3)
    got = P.pick_peaks(table, ["sample_id"]).collect()
    assert sorted((x.sample_id, x.pos, x["rank"], round(x.area, 6)) for x in got) == sorted(expected)
    assert P.pick_peaks(table.limit(0), ["sample_id"]).collect() == []
