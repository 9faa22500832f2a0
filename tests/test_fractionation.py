"""Pairs of profiles found by bounds against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from ionquarry.operators import fractionation
from ionquarry.plans.chromatography_queries import sec_profiles
from ionquarry.sources import views

SCHEMA = "trace string, block string, first int, values array<double>, centres array<double>, tops array<double>"


def profiles(n, blocks, seed):
    r = random.Random(seed)
    shapes = [sorted((r.uniform(0, 60), r.lognormvariate(0, 1.2)) for _ in range(r.randrange(1, 7))) for _ in range(max(n // 8, 1))]
    out = []
    for k in range(n):
        shape = sorted((c + r.gauss(0, 0.4), y * r.lognormvariate(0, 0.25)) for c, y in r.choice(shapes))
        out.append((f"t{k:04}", f"b{k % blocks}", r.randrange(3), [r.random() for _ in range(20)], [c for c, _ in shape], [y for _, y in shape]))
    return out


def rows_of(df):
    return sorted((x.one, x.other, round(x.cosine, 9), round(x.pearson, 9), x.matches) for x in df.collect())


@pytest.mark.parametrize("least", [0.3, 0.8, 0.95, 1.0])
def test_bounds_lose_no_pair(spark, least):
    edges = [("e1", "b0", 0, [], [], []), ("e2", "b0", 0, [1.0], [3.0], [0.0]), ("x1", "b0", 0, [1.0, 2.0], [5.0], [2.0]), ("x2", "b0", 0, [1.0, 2.0], [6.0], [7.0]), ("x3", "b0", 0, [1.0, 2.0], [5.0, 5.5], [2.0, 2.0])]
    held = spark.createDataFrame(profiles(160, 2, 11) + edges, SCHEMA).cache()
    every = fractionation.similar_traces(held, "trace", "block").filter(F.col("cosine") >= least)
    expected, candidates = rows_of(every), fractionation.candidate_pairs(held, "trace", "block", least).count()
    assert rows_of(fractionation.similar_above(held, "trace", "block", least)) == expected and any(x[:2] == ("x1", "x2") for x in expected)
    assert len(expected) <= candidates and (least < 0.8 or candidates < 0.35 * 2 * 83 * 82 / 2)


def test_profiles_of_the_table(spark):
    held = sec_profiles(views.signal(spark, "/root/testdata/sf0.001")).filter("size(centres) > 0").checkpoint()
    every = fractionation.similar_traces(held, "trace", "block", 1.5).filter("cosine >= 0.9")
    found = fractionation.similar_above(held, "trace", "block", 0.9, 1.5)
    assert rows_of(found) == rows_of(every) != []
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_profiles_and_wrong_bounds(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fractionation.similar_above(none, "trace", "block", 0.9).count() == 0
    with pytest.raises(ValueError):
        fractionation.similar_above(none, "trace", "block", 0.0)
