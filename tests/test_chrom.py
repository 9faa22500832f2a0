import numpy as np
import pytest

from ionquarry.operators import chrom


@pytest.mark.parametrize(("left", "right", "order"), [(2, 2, 2), (3, 3, 2), (5, 5, 4), (20, 20, 4), (4, 1, 2), (2, 2, 4), (0, 3, 1)])
def test_savgol_is_the_least_squares_fit(spark, left, right, order):
    y = [float(v) for v in np.random.default_rng(7).integers(50, 99, 50)]
    trace = spark.createDataFrame([(1, k, v) for k, v in enumerate(y)], "s int, k int, v double")
    got = [x.smoothed for x in chrom.savgol_smooth(trace, "v", "s", "k", left, right, order).orderBy("k").collect()]
    at = np.arange(-left, right + 1)
    fit = lambda i: max(np.polyval(np.polyfit(at, y[i - left : i + right + 1], order), 0), 0)
    assert got == pytest.approx([fit(i) if left <= i < len(y) - right else y[i] for i in range(len(y))], rel=1e-7)


def test_savgol_needs_enough_points():
    with pytest.raises(ValueError):
        chrom.savgol_weights(1, 1, 4)


def test_few_windows_and_many_give_the_same(spark, monkeypatch):
    import random

    from ionquarry.operators import chrom

    r = random.Random(4)
    rows = [(r.randrange(3), r.randrange(9), r.choice([1, 2]), r.random() * 10, round(100 + r.random() * 9, 2), r.choice([None, float(r.randrange(5))])) for _ in range(300)] + [(0, 3, 1, 1.0, None, 2.0)]
    points = spark.createDataFrame(rows, "sample_id int, scan_id int, mslevel int, rt double, mz double, intensity double")
    windows = spark.createDataFrame([(i, 99.0 + i, 100.5 + i) for i in range(11)], "window_id int, mzmin double, mzmax double")
    for options in ({}, {"mslevel": 1, "rt": (2.0, 9.0)}, {"mslevel": 2, "scale": {1: 3.0}}):
        found = []
        for few in (64, 0):
            monkeypatch.setattr(chrom, "FEW_WINDOWS", few)
            found.append(sorted(map(repr, chrom.extracted_ions(points, windows, **options).collect())))
        assert found[0] == found[1] and found[0]
        assert chrom.extracted_ions(points.limit(0), windows, **options).collect() == []
