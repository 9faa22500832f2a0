"""Representatives of categories whose groups tie."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from ionquarry.operators import targeted
from ionquarry.plans import catalog


@pytest.mark.parametrize("turn", [1, -1])
def test_equal_groups_go_by_rt_not_by_place(spark, turn):
    rows = [(1, "a", "quant", 10.0, 5.0), (1, "a", "quant", 90.0, 5.0), (2, "a", "other", 12.0, 1.0), (3, "a", "other", 88.0, 1.0)]
    groups = spark.createDataFrame(rows[::turn], "group_id long, category string, transition_kind string, rt double, intensity double").coalesce(1)
    found = sorted((x.group_id, x.representative, x.label, x.parent) for x in targeted.rolled_up(groups, 5.0).collect() if x.group_id > 1)
    assert found == [(2, False, "", 1), (3, False, "", None)]


@pytest.mark.parametrize("turn", ["rt", "rt DESC"])
def test_query_takes_ties_in_the_order_of_the_table(spark, tmp_path, turn):
    row = lambda n, day, order=1, quantity=5.0: (order, n, 0, day, quantity)
    values = ", ".join(f"({o}, {n}, {s}, DATE '1992-01-01' + INTERVAL ({d}) DAY, {q}::DOUBLE)" for o, n, s, d, q in [row(1, 10), row(1, 90), row(2, 12, quantity=1.0), row(3, 88, quantity=1.0), row(1, 400, 2)])
    at = f"{tmp_path}/lineitem.parquet"
    with duckdb.connect() as db:
        db.sql(f"COPY (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(rt AS TIMESTAMP) AS l_shipdate, l_quantity, 1.0::DOUBLE AS l_extendedprice FROM (VALUES {values}) v(l_orderkey, l_linenumber, l_suppkey, rt, l_quantity) ORDER BY {turn}) TO '{at}'")
        sql = catalog.ORACLES["qqq_rollup_groups"]
        for name in ("events", "part", "embeddings", "documents"):
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
        db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{at}'")
        expected = db.sql(sql).fetchall()
    found = catalog.QUERIES["qqq_rollup_groups"](spark, str(tmp_path))
    assert Counter(map(tuple, found.collect())) == Counter(expected)
    assert {x.parent for x in found.filter(F.col("group_id").isin(12, 13)).collect()} == {None, 11}
