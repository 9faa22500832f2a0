"""Classes of equal profiles, and pairs of them, against all pairs of profiles."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_fractionation import SCHEMA, profiles

from ionquarry.operators import fractionation
from ionquarry.operators.trace_kernels import Picking
from ionquarry.plans import catalog
from ionquarry.plans.chromatography_queries import sec_profiles
from ionquarry.sources import views


@pytest.mark.parametrize("tile", [7, 1024])
def test_classes_and_members_give_back_every_pair(spark, monkeypatch, tile):
    monkeypatch.setattr(fractionation, "TILE", tile)
    rows = profiles(60, 2, 3)
    copies = [(f"c{k}{x[0]}", *x[1:]) for k in range(3) for x in rows[: 10 + k]]
    edges = [("e1", "b0", 0, [], [], []), ("e2", "b0", 0, [], [], []), ("e3", "b1", 0, [1.0], [3.0], [0.0]), (None, "b0", 0, [1.0], [3.0], [1.0]), ("n1", None, 0, [1.0], [3.0], [1.0])]
    held = spark.createDataFrame(rows + copies + edges, SCHEMA).cache()
    every = fractionation.similar_traces(held, "trace", "block").filter(F.col("cosine") >= 0.8).collect()
    found = fractionation.similar_classes(held, "trace", "block", 0.8).collect()
    of = {x.trace: x["class"] for x in found if x.kind == "trace"}
    pairs = {(x["class"], x.other_class): x for x in found if x.kind == "pair"}
    assert set(of) == {x[0] for x in rows + copies + edges if x[0] and x[1]} and every
    links, by_class = Counter(), Counter()
    for x in every:
        pair = pairs[tuple(sorted((of[x.one], of[x.other])))]
        assert (pair.cosine, pair.pearson, pair.matches) == (pytest.approx(x.cosine), pytest.approx(x.pearson), x.matches)
        by_class[pair["class"], pair.other_class] += 1
        links[x.one] += 1
        links[x.other] += 1
    assert by_class == Counter({k: x.links for k, x in pairs.items()}) and any(a == b for a, b in pairs)
    assert all(links[x.trace] == x.links for x in found if x.kind == "trace")


def test_copies_of_profiles_make_no_more_pairs(spark):
    alike = lambda n: spark.range(n).selectExpr("format_string('t%04d', id) AS trace", "'b' AS block", "0 AS first", "array(1.0D, 5.0D, 2.0D) AS values", "array(1.0D) AS centres", "array(5.0D) AS tops")
    for n in (10, 400):
        found = fractionation.similar_classes(alike(n), "trace", "block", 0.9).collect()
        assert len(found) == n + 1 and {x.links for x in found} == {n - 1, n * (n - 1) // 2}


def test_query_has_as_many_members_as_traces(spark):
    found = catalog.QUERIES["sec_pairs"](spark, "/root/testdata/sf0.001").groupBy("kind").count().collect()
    assert {x.kind for x in found} == {"trace", "pair"}


def test_profiles_are_made_where_their_points_lie(spark):
    points = views.signal(spark, "/root/testdata/sf0.001").select(F.concat_ws("-", "channel", "sample_id").alias("trace"), F.floor(F.col("scan_id") / 12).alias("fraction"), "intensity")
    dense = fractionation.densified(points, ["trace"]).cache()
    want = fractionation.profiles(dense, fractionation.picked(dense, ["trace"], Picking(drop_top=60)), "trace")
    got = sec_profiles(views.signal(spark, "/root/testdata/sf0.001"))
    rounded = lambda df: {x.trace: (x["first"], *[[round(v, 6) for v in x[c]] for c in ("values", "centres", "tops")]) for x in df.collect()}
    assert rounded(got) == rounded(want) and rounded(want)
    assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 1
