import random

from pyspark.sql import functions as F

from ionquarry.operators import ranking
from ionquarry.plans import catalog


def test_ranks_equal_sorting(spark):
    r = random.Random(2)
    rows = [(i, r.choice([1.0, 2.0, r.random(), None])) for i in range(3000)]
    got = ranking.ranked(spark.createDataFrame(rows, "id long, y double").repartition(5), [F.desc("y"), F.col("id")]).collect()
    want = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert [(x.id, x.y) for x in sorted(got, key=lambda x: x["rank"])] == want and sorted(x["rank"] for x in got) == list(range(1, 3001))
    ties = ranking.ranked(spark.createDataFrame([(1.0,)] * 50, "y double"), [F.col("y")])
    assert sorted(x["rank"] for x in ties.collect()) == list(range(1, 51))
    assert ranking.ranked(spark.createDataFrame([], "y double"), [F.col("y")]).collect() == []


def test_no_row_of_the_table_goes_to_one_task(spark):
    plan = catalog.QUERIES["group_rank"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert len(windows) == 2 and "[_range" in windows[0]
    assert any("[_range" in x.partition("windowspecdefinition")[2] for x in windows)
