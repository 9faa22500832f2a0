from math import comb

import pytest
from pyspark.sql import functions as F

from ionquarry.functions import chem
from ionquarry.plans import queries


@pytest.mark.parametrize("threshold", [0.0, 1e-6])
def test_c13_distribution_has_every_isotope(spark, threshold):
    rows = spark.createDataFrame([(0,), (1,), (3,), (50,), (200,), (5000,), (None,), (-1,)], "n int")
    got = rows.select("n", F.explode(chem.c13_distribution(F.col("n"), threshold)).alias("c")).select("n", "c.k", "c.abundance").collect()
    for n in (0, 1, 3, 50, 200):
        true = {k: comb(n, k) * 0.0107**k * 0.9893 ** (n - k) for k in range(n + 1)}
        kept = {k: p for k, p in true.items() if p >= threshold * max(true.values())}
        assert {x.k: x.abundance for x in got if x.n == n} == pytest.approx(kept, rel=1e-9)
    assert sum(x.abundance for x in got if x.n == 5000) == pytest.approx(1, abs=2e-6)
    assert {x.n for x in got} == {0, 1, 3, 50, 200, 5000}


def test_c13_query_adds_up_to_one(spark):
    sums = queries.QUERIES["c13_all_distribution"](spark, "/root/testdata/sf0.001").groupBy("compound_id").agg(F.sum("abundance").alias("s"), F.max("k").alias("k")).collect()
    assert max(x.k for x in sums) > 2 and all(x.s == pytest.approx(1, abs=1e-7) for x in sums)
