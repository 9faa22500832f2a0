"""Many short traces go to Python in batches, not one by one."""

from pyspark.sql import types as T

from ionquarry.operators import peaks


def test_batches_of_traces_equal_one_group_each(spark):
    kernel = lambda rt, mz, y: [{"n": len(rt), "first": float(rt[0]), "masses": float(mz @ (1 + mz)), "sum": float(y.sum()) if len(y) > 1 else float("nan")}] * (len(rt) % 3)
    rows = [(f"s{i % 37}" if i % 37 else None, i % 4, float(i * 7 % 11), None if i % 5 == 0 else float(i % 3), float(i)) for i in range(900)]
    rows += [("only", 1, 2.0, 3.0, 4.0), ("gone", 1, None, 3.0, 4.0), ("gone", 1, 1.0, 3.0, None)]
    table = spark.createDataFrame(rows, "sample string, part int, rt double, mz double, intensity double")
    columns = {"n": T.LongType(), "first": T.DoubleType(), "masses": T.DoubleType(), "sum": T.DoubleType(), "none": T.LongType()}
    own, each = (f(table, ["sample", "part"], kernel, **columns) for f in (peaks.by_trace, peaks.by_long_trace))
    assert own.schema == each.schema
    assert sorted(map(repr, own.collect())) == sorted(map(repr, each.collect())) != []
    assert "FlatMapGroups" not in own._jdf.queryExecution().toString()
    assert peaks.by_trace(table.limit(0), ["sample"], kernel, **columns).collect() == []
