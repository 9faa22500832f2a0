"""Tolerance and interval joins as equi-joins on bins, with the exact test after them; no nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ppm(one: Column, other: Column) -> Column:
    """Distance in parts per million of the first."""
    return F.abs(one - other) / one * 1e6


def ppm_join(left: DataFrame, right: DataFrame, left_mz: str, right_mz: str, tolerance: float, tasks: int | None = None) -> DataFrame:
    """Pairs with ``ppm(right_mz, left_mz) <= tolerance``; positive m/z only.

    The left side falls into bins of the logarithm as wide as the tolerance, the right side (the library) is put into
    its own bin and both neighbours, so a pair meets in exactly one bin. With ``tasks``, that many share the bins, however few bytes they have.
    """
    width = tolerance * 1.5e-6
    own = left.filter(F.col(left_mz) > 0).withColumn("_bin", F.floor(F.log(left_mz) / width))
    home = F.floor(F.log(right_mz) / width)
    spread = right.filter(F.col(right_mz) > 0).withColumn("_bin", F.explode(F.array(home - 1, home, home + 1)))
    if tasks:
        own, spread = own.repartition(tasks, "_bin"), spread.repartition(tasks, "_bin").hint("shuffle_merge")
    return own.join(spread, "_bin").filter(ppm(F.col(right_mz), F.col(left_mz)) <= tolerance).drop("_bin")


def near_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, tolerance: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs, equal in ``keys``, with ``abs(left_col - right_col) <= tolerance``."""
    own = left.withColumn("_bin", F.floor(F.col(left_col) / tolerance))
    home = F.floor(F.col(right_col) / tolerance)
    spread = right.withColumn("_bin", F.explode(F.array(home - 1, home, home + 1)))
    return own.join(spread, [*(keys or []), "_bin"]).filter(F.abs(F.col(left_col) - F.col(right_col)) <= tolerance).drop("_bin")


def overlap_fraction(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length over the joint length; 1 where one interval contains the other; 0 without overlap."""
    shared = F.least(a1, b1) - F.greatest(a0, b0)
    contains = ((a0 <= b0) & (a1 >= b1)) | ((b0 <= a0) & (b1 >= a1))
    return F.when(shared <= 0, 0.0).when(contains, 1.0).otherwise(shared / (F.greatest(a1, b1) - F.least(a0, b0)))
