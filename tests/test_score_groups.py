"""Peaks grouped by score against plain Python, without windows over groups."""

import random
from collections import Counter

from ionquarry.operators import grouping
from ionquarry.operators.trace_kernels import overlap


def test_best_scores_and_groups_of_several(spark):
    r = random.Random(4)
    span = lambda: (lambda c, a, b: (c, c - a, c + b, float(r.randrange(1, 9))))(float(r.randrange(40)), r.randrange(4), r.randrange(4))
    tops = [(c, k, *span()) for c in "abc" for k in range(0 if c == "c" else 9)]
    peaks = [(c, s, k, *span()) for c in "abcd" for s in range(12) for k in range(5)]
    columns = "rt double, rtmin double, rtmax double, intensity double"
    tops_df, peaks_df = spark.createDataFrame(tops, f"channel string, pos long, {columns}"), spark.createDataFrame(peaks, f"channel string, sample_id long, pos long, {columns}")
    best = {}
    for channel, sample, pos, rt, low, high, y in peaks:
        near = [(-overlap(low, high, t0, t1) / (abs(rt - t) + 0.01) / (abs(y - v) + 0.01), k) for c, k, t, t0, t1, v in tops if c == channel and low <= t1 and high >= t0]
        if near:
            best[channel, sample, pos] = min(near)[1]
    count = Counter((key[0], k) for key, k in best.items())
    expected = {key: k for key, k in best.items() if count[key[0], k] > 1}
    found = grouping.group_by_score(peaks_df, tops_df, ["channel"])
    assert {(x.channel, x.sample_id, x["pos"]): x.group_id for x in found.collect()} == expected
    assert 1 in count.values() and found.count() == len(expected) < len(best) < len(peaks)
    plan = found._jdf.queryExecution().toString()
    assert "Window" not in plan and "NestedLoop" not in plan
