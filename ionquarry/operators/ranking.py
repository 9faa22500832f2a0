"""Ranks over a whole table without one task for all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionquarry.operators.written import written


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place in ``order``, from 1; rows that tie there get different places in any order.

    The table is dealt to ranges of the order and written; each range is numbered by itself, and starts where the rows of
    the ranges before it end. Only the numbers of rows of the ranges, as many as tasks, are summed in one place. Ties stay in one
    range: many of them make it long, but it is sorted on disk and not held.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = sizes.select("_range", F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return own.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_before", "_own")
