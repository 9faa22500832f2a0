import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionquarry.operators import grouping as G
from ionquarry.operators import infusion, slicing


def peak(sample, rt, y, width=0.1):
    return {"sample_id": sample, "rt": rt, "rtmin": rt - width, "rtmax": rt + width, "intensity": y}


def test_assignment_takes_the_nearest_free_group():
    tops = [peak(0, 1.0, 0), peak(0, 1.3, 0), peak(0, 5.0, 0)]
    own = [peak(1, 1.05, 9), peak(1, 1.1, 8), peak(1, 1.2, 7), peak(2, 4.8, 6), peak(2, 9.0, 5)]
    assert G.assigned(tops, own, 0.25) == [0, 1, None, 2, None]


def test_overlapping_groups_merge_and_keep_the_more_intense_peak():
    groups = [[peak(1, 1.0, 5), peak(2, 1.0, 5)], [peak(1, 1.02, 9)], [peak(3, 4.0, 1)], []]
    merged = G.merge_overlapping(groups, 0.5)
    assert [sorted((p["sample_id"], p["intensity"]) for p in g) for g in merged] == [[(1, 9), (2, 5)], [(3, 1)]]
    assert len(G.merge_overlapping(groups, 1.1)) == 3


def test_clusters_hold_one_peak_of_a_sample():
    r = random.Random(2)
    own = [peak(r.randrange(4), r.random() * 3, 1) for _ in range(30)]
    found = G.clustered(own, 0.3)
    for c in set(found):
        samples = [p["sample_id"] for p, f in zip(own, found, strict=True) if f == c]
        assert len(samples) == len(set(samples))
    near = [peak(1, 1.0, 1), peak(2, 1.1, 1), peak(3, 9.0, 1)]
    assert G.clustered(near, 0.3) == [0, 0, 2]


def test_parsimony_against_the_definition(spark):
    r = random.Random(4)
    sets = {i: {r.randrange(12) for _ in range(r.randrange(1, 6))} for i in range(40)}
    rows = [(i, x) for i, s in sets.items() for x in s]
    larger = lambda i: set().union(*[s for s in sets.values() if len(s) > len(sets[i])])
    expected = sorted(i for i, s in sets.items() if not s <= larger(i))
    got = infusion.parsimonious(spark.createDataFrame(rows, "compound long, fragment long"))
    assert sorted(x.compound for x in got.collect()) == expected


def test_transitive_classes(spark):
    pairs = [(1, 2), (2, 3), (4, 5), (9, 8), (8, 7), (7, 6), (6, 5)]
    got = {x.node: x.root for x in G.transitive_sets(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, **dict.fromkeys(range(4, 10), 4)}


def test_every_point_has_a_slice(spark):
    r = random.Random(8)
    rows = [(100 + r.random() * 5, r.random() * 50, r.random()) for _ in range(200)]
    points = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id long, mz double, rt double, intensity double")
    held = slicing.slice_points(points, 50, 1.0)
    assert slicing.slices_at(held, points.select("id", "mz", "rt"), ["id"]).select("id").distinct().count() == 200


def test_statistics_of_groups(spark):
    rows = [(0, 1, 1, 1.0, 0.9, 1.1, 100.0, 10.0, 3, 0.5, 4.0), (0, 2, 0, 1.2, 1.0, 1.4, 100.2, 30.0, 5, 0.6, 9.0), (0, 5, 2, 1.1, 1.0, 1.3, 100.1, 20.0, 4, 0.1, 2.0)]
    names = "group_id long, sample_id long, pos long, rt double, rtmin double, rtmax double, mz double, intensity double, no_noise long, area_fractional double, signal_to_noise double"
    table = spark.createDataFrame(rows, names).withColumn("channel", F.lit("a"))
    got = G.group_statistics(table, ["channel"], F.col("sample_id") == 5).collect()[0]
    assert (got.max_intensity, got.rt, got.mz, got.peaks, got.blank_max, got.sample_max, got.sample_count) == (30, 1.2, 100.2, 3, 20, 30, 2)
    assert got.mean_rt == pytest.approx(1.05) and got.weighted_rt == pytest.approx((10 + 36 + 22) / 60) and got.rtmin == 0.9 and got.rtmax == 1.4


def by_all_pairs(peaks, most):
    """Clusters from every pair of peaks, the closest first."""
    of = list(range(len(peaks)))
    pairs = sorted((round(abs(a["rt"] - b["rt"]), 6), i, j) for i, a in enumerate(peaks) for j, b in enumerate(peaks) if i < j and a["sample_id"] != b["sample_id"] and abs(a["rt"] - b["rt"]) <= most)
    for _, i, j in pairs:
        one, other = ({k for k, c in enumerate(of) if c == of[x]} for x in (i, j))
        if of[i] != of[j] and not {peaks[k]["sample_id"] for k in one} & {peaks[k]["sample_id"] for k in other}:
            low = min(of[i], of[j])
            for k in one | other:
                of[k] = low
    return of


def test_clusters_of_neighbours_equal_those_of_all_pairs():
    r = random.Random(8)
    for n in (0, 1, 5, 60):
        for most in (0.0, 0.2, 3.0):
            own = [{"rt": round(r.uniform(0, 6), r.choice([1, 6])), "sample_id": r.randrange(5)} for _ in range(n)]
            assert G.clustered(own, most) == by_all_pairs(own, most)
    assert G.clustered([{"rt": float("nan"), "sample_id": 1}, {"rt": 1.0, "sample_id": 2}, {"rt": 1.0, "sample_id": 3}], 1.0) == [0, 1, 1]


def many_peaks(r, n):
    return [(f"c{r.randrange(2)}", r.randrange(8), float(r.randrange(40)), float(r.randrange(1, 9))) for _ in range(n)]


PEAK = "channel string, sample_id long, rt double, rtmin double, rtmax double, intensity double, area double, area_top double, area_corrected double"


def test_units_of_one_rt_are_clustered_as_pairs_are():
    r = random.Random(12)
    for most in (1.0, 2.0, 0.5):
        own = [{"sample_id": r.randrange(9), "rt": float(r.randrange(12))} for _ in range(60)]
        assert G.clustered_units(np.array([p["rt"] for p in own]), np.array([p["sample_id"] for p in own]), most) == G.clustered(own, most)
    one_rt = np.zeros(20_000)
    assert set(G.clustered_units(one_rt, np.arange(20_000), 1.0)) == {0}  # 200 million pairs


def test_groups_of_merged_peaks_equal_the_plain_lists(spark):
    r = random.Random(13)
    rows = sorted({(c, s, t): (c, s, t, t - w, t + w, 1000.0 * w + r.random(), 1.0, 1.0, 1.0) for c, s, t, w in many_peaks(r, 300)}.values())
    tops = [("c0", float(t)) for t in (3, 6, 12, 30)] + [("c1", float(t)) for t in (1, 2, 3, 20)]
    a, b = spark.createDataFrame(rows, PEAK), spark.createDataFrame(tops, "channel string, rt double")
    names = [c.split()[0] for c in PEAK.split(", ")]
    for least in (-1.0, 0.3, 0.8):
        want = {}
        for channel in ("c0", "c1"):
            own = sorted((dict(zip(names, x, strict=True)) for x in rows if x[0] == channel), key=lambda p: (-p["intensity"], p["sample_id"], p["rt"]))
            merged = [{"rt": t} for c, t in tops if c == channel]
            of = G.assigned(merged, own, 4.0)
            groups = [[p for p, g in zip(own, of, strict=True) if g == k] for k in range(len(merged))]
            groups = [g for g in groups if g] if least < 0 else G.merge_overlapping(groups, least)
            want |= {(channel, p["sample_id"], p["rt"]): k for k, g in enumerate(groups) for p in g}
        got = {(x.channel, x.sample_id, x.rt): x.group_id for x in G.group_by_merged(a, b, ["channel"], 4.0, least).collect()}
        assert got == want and got


def test_overlap_score_counts_ranges_together(spark):
    import math

    r = random.Random(14)
    rows = [(c, r.randrange(3), s, t - w, t + w) for c, s, t, w in many_peaks(r, 120)] + [("c9", 0, 1, 0.0, 1.0), ("c9", 0, 2, 5.0, 6.0), ("c9", 1, 1, 5.0, 6.0)]
    held = spark.createDataFrame(rows, "channel string, group_id long, sample_id long, rtmin double, rtmax double")
    want = {}
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            if x[:2] == y[:2] and x[2] != y[2]:
                overlap = G.K.overlap(*x[3:], *y[3:])
                want.setdefault(x[:2], []).append(math.log(overlap) if overlap > 0 else None)
    got = {(x.channel, x.group_id): x.overlap_score for x in G.overlap_score(held, ["channel"]).collect()}
    assert set(got) == set(want)
    for key, logs in want.items():
        known = [v for v in logs if v is not None]
        assert got[key] == (pytest.approx(sum(known) / len(logs)) if known else None)
