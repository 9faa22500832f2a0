"""Targeted (SRM, QQQ) quantification: transitions, extraction by filter line, roll-up, backgrounds, filters.

Groups are rows with compound, category, transition_kind (quant, qq or another), rt, intensity and per-sample columns as named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionquarry.functions import text
from ionquarry.operators import ranges


def transitions(scans: DataFrame) -> DataFrame:
    """Distinct (filter_line, precursor, product, name, energy) of the scans' filter lines, and their number of scans."""
    line = F.col("filter_line")
    found = scans.filter(line.isNotNull()).groupBy("filter_line").agg(F.count(F.lit(1)).alias("scans"))
    return found.select("filter_line", "scans", text.srm_precursor(line).alias("precursor"), text.srm_product(line).alias("product"), text.srm_name(line).alias("name"), text.srm_energy(line).alias("energy"))


def transition_compounds(found: DataFrame, compounds: DataFrame, amu_q1: float, amu_q3: float) -> DataFrame:
    """Transitions and compounds whose precursors and products lie within tolerances; names must agree where a compound has an id.

    Names are compared without (+), (-) and blanks. An equi-join on bins of the precursor, the rest after it.
    """
    plain = lambda c: F.lower(F.regexp_replace(F.col(c), r"\([+-]\)|\s", ""))
    other = compounds.select("compound_id", F.col("name").alias("compound_name"), F.col("precursor_mz").alias("q1"), F.col("product_mz").alias("q3"))
    near = ranges.near_join(found, other, "precursor", "q1", amu_q1).filter(F.abs(F.col("product") - F.col("q3")) <= amu_q3)
    return near.filter(F.col("compound_id").isNull() | (F.coalesce(F.col("name"), F.lit("")) == "") | (plain("name") == plain("compound_name")))


def extracted_line(points: DataFrame, keys: list[str]) -> DataFrame:
    """For each scan of a filter line the largest intensity and its m/z (the smaller of equal ones)."""
    rank = F.row_number().over(Window.partitionBy(*keys, "scan_id").orderBy(F.desc("intensity"), "mz"))
    return points.withColumn("_r", rank).filter("_r = 1").drop("_r")


def extracted_transition(points: DataFrame, keys: list[str], how: str = "mean") -> DataFrame:
    """For each rt of a transition the mean, median or sum of its scans' intensities, whatever lines they come from."""
    f = {"mean": F.avg, "median": F.median, "sum": F.sum}[how]
    return points.groupBy(*keys, "rt").agg(f("intensity").alias("intensity"), F.max("mz").alias("mz"))


def extracted_amu(points: DataFrame, targets: DataFrame, amu_q1: float, amu_q3: float) -> DataFrame:
    """MS2 points whose precursor and m/z lie within tolerances of a target's (target_id, precursor, product): the largest of each scan."""
    near = ranges.near_join(points.filter("mslevel >= 2"), targets.withColumnRenamed("precursor", "q1"), "precursor_mz", "q1", amu_q1)
    inside = near.filter(F.abs(F.col("mz") - F.col("product")) <= amu_q3)
    return inside.groupBy("target_id", "sample_id", "scan_id").agg(F.max("intensity").alias("intensity"))


def rolled_up(groups: DataFrame, tolerance: float, place: tuple[str, ...] = ()) -> DataFrame:
    """Groups with representative, label and parent: of each category, the most intense quant (else qq) group stands for those near it.

    Candidates are groups of kind quant or qq; the representative gets label q; other groups of the category within
    ``tolerance`` of its rt are its children, the rest stay by themselves. Ties go to the smaller group_id, then to the first by
    the columns ``place`` (left out of the result), then to the earlier rt.
    """
    candidate = F.col("transition_kind").isin("quant", "qq")
    order = Window.partitionBy("category").orderBy(F.when(candidate, 0).otherwise(1), F.desc("intensity"), "group_id", *place, "rt")
    first = lambda c: F.first(F.when(candidate, F.struct("group_id", "rt")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))[c]
    held = groups.withColumns({"_top": first("group_id"), "_rt": first("rt")})
    representative = F.coalesce(F.col("group_id") == F.col("_top"), F.lit(False))
    child = ~representative & F.coalesce(F.abs(F.col("rt") - F.col("_rt")) <= tolerance, F.lit(False))
    return held.withColumns({"representative": representative, "label": F.when(representative, "q").otherwise(""), "parent": F.when(child, F.col("_top"))}).drop("_top", "_rt", *place)


def background(baseline: Column, blank: Column, kind: str) -> Column:
    """The level to compare with: none, the merged trace's baseline, the blanks' maximum, or the larger of both."""
    return {"none": F.lit(0.0), "baseline": baseline, "blank": blank, "max": F.greatest(F.coalesce(baseline, F.lit(0.0)), F.coalesce(blank, F.lit(0.0)))}[kind]


def passes_background(value: Column, level: Column, ratio: float) -> Column:
    """Whether a value exceeds its background by a factor; without a background above 0 it does."""
    return F.when(F.coalesce(level, F.lit(0.0)) <= 0, F.lit(True)).otherwise(value / level >= ratio)


def filtered_groups(peaks: DataFrame, keys: list[str], ratio: float, standards: list[str], drop_failing: bool = False) -> DataFrame:
    """Peaks of groups whose largest sample peak exceeds ``ratio`` times their largest blank peak; internal standards always stay.

    Columns: compound, is_blank, intensity. ``drop_failing`` also leaves out the sample peaks that don't exceed it.
    """
    w = Window.partitionBy(*keys)
    blank = F.max(F.when(F.col("is_blank"), F.col("intensity"))).over(w)
    sample = F.max(F.when(~F.col("is_blank"), F.col("intensity"))).over(w)
    held = peaks.withColumns({"_blank": F.coalesce(blank, F.lit(0.0)), "_sample": F.coalesce(sample, F.lit(0.0))})
    standard = F.col("compound").isin(standards)
    kept = held.filter(standard | (F.col("_sample") >= ratio * F.col("_blank")) & (F.col("_sample") > 0))
    if drop_failing:
        kept = kept.filter(standard | F.col("is_blank") | (F.col("intensity") >= ratio * F.col("_blank")))
    return kept.drop("_blank", "_sample")


def standard_labels(labels: Column, compound: Column, standards: list[str]) -> Column:
    """``labels`` (an array) with i for an internal standard, and l too if it has q; sorted."""
    added = F.when(F.array_contains(labels, "q"), F.array(F.lit("i"), F.lit("l"))).otherwise(F.array(F.lit("i")))
    return F.when(compound.isin(standards), F.array_sort(F.array_union(labels, added))).otherwise(labels)


def blank_in_window(points: DataFrame, groups: DataFrame, keys: list[str], margin: float = 0.0) -> DataFrame:
    """(keys, group_id, blank_max, blank_median, blank_mean): of the blanks' largest intensities in each group's rt range."""
    held = points.filter("is_blank AND intensity > 0").select(*keys, "sample_id", "rt", "intensity")
    near = held.join(groups.select(*keys, "group_id", "rtmin", "rtmax"), keys).filter((F.col("rt") >= F.col("rtmin") - margin) & (F.col("rt") <= F.col("rtmax") + margin))
    per = near.groupBy(*keys, "group_id", "sample_id").agg(F.max("intensity").alias("most"), F.avg("intensity").alias("mean"))
    return per.groupBy(*keys, "group_id").agg(F.max("most").alias("blank_max"), F.median("most").alias("blank_median"), F.avg("mean").alias("blank_mean"))


def analogous_blank(points: DataFrame, groups: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """(keys, group_id, blank): the largest sum, over the blanks, of the ``n`` points around the one nearest to the group's rt."""
    order = Window.partitionBy(*keys, "sample_id").orderBy("rt")
    around = F.sum("intensity").over(order.rowsBetween(-(n // 2), n // 2))
    summed = points.filter("is_blank").withColumn("_sum", around)
    near = summed.join(groups.select(*keys, "group_id", F.col("rt").alias("_rt")), keys)
    nearest = Window.partitionBy(*keys, "group_id", "sample_id").orderBy(F.abs(F.col("rt") - F.col("_rt")), "rt")
    return near.withColumn("_r", F.row_number().over(nearest)).filter("_r = 1").groupBy(*keys, "group_id").agg(F.max("_sum").alias("blank"))


def baseline_summary(points: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, group_id, whole, top3, apex): the merged trace's baseline summed over a group's range, its top three points, its apex.

    ``points``: keys, rt, baseline; ``groups``: rtmin, rtmax, rt of the apex.
    """
    order = Window.partitionBy(*keys).orderBy("rt")
    three = points.withColumn("_three", F.sum("baseline").over(order.rowsBetween(-1, 1))).withColumnRenamed("rt", "_rt")
    near = three.join(groups.select(*keys, "group_id", "rtmin", "rtmax", "rt"), keys).filter("_rt BETWEEN rtmin AND rtmax")
    at_apex = F.col("_rt") == F.col("rt")
    return near.groupBy(*keys, "group_id").agg(F.sum("baseline").alias("whole"), F.max(F.when(at_apex, F.col("_three"))).alias("top3"), F.max(F.when(at_apex, F.col("baseline"))).alias("apex"))
