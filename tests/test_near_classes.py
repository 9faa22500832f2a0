"""Classes of near peaks against all pairs of peaks."""

import random
from collections import Counter

from ionquarry.operators import fractionation
from ionquarry.plans import catalog


def test_classes_and_members_give_back_every_pair(spark):
    r = random.Random(5)
    rows = []
    for trace in range(60):
        for pos in sorted(r.sample(range(0, 12), r.randrange(0, 4))):
            rows.append((trace % 55, pos + 20 * (trace // 55), pos / 2 if trace % 3 else float(pos), float(pos - r.randrange(2)), float(pos + r.randrange(2))))
    peaks = spark.createDataFrame([*rows, (None, 1, 2.0, 1.0, 3.0)], "trace long, pos long, rt double, rtmin double, rtmax double")
    held = fractionation.near_classes(peaks, "trace", 1.0).collect()
    of = {(x.trace, x["pos"]): x["class"] for x in held if x.kind == "peak"}
    pairs = {(x["class"], x.other_class): x for x in held if x.kind == "pair"}
    every = fractionation.near_peaks(peaks, "trace", 1.0).collect()
    assert len(of) == len(rows) and every
    links, by_class = Counter(), Counter()
    for x in every:
        a, b = of[x.one, x.one_pos], of[x.other, x.other_pos]
        pair = pairs[min(a, b), max(a, b)]
        assert (pair.distance, pair.overlap, pair.jaccard) == (x.distance, x.overlap, x.jaccard)
        by_class[min(a, b), max(a, b)] += 1
        links[x.one, x.one_pos] += 1
        links[x.other, x.other_pos] += 1
    assert by_class == Counter({k: x.links for k, x in pairs.items()})
    assert all(links[x.trace, x["pos"]] == x.links for x in held if x.kind == "peak")


def test_copies_of_traces_make_no_more_pairs(spark):
    peaks = lambda n: spark.range(n).selectExpr("id AS trace", "4 AS pos", "4.0D AS rt", "3.0D AS rtmin", "6.0D AS rtmax")
    for n in (10, 400):
        held = fractionation.near_classes(peaks(n), "trace", 1.0).collect()
        assert len(held) == n + 1 and {x.links for x in held} == {n - 1, n * (n - 1) // 2}


def test_query_has_as_many_members_as_peaks(spark):
    held = catalog.QUERIES["sec_near_peaks"](spark, "/root/testdata/sf0.001").groupBy("kind").count().collect()
    assert {x.kind for x in held} == {"peak", "pair"}
