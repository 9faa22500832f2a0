"""Slices of m/z and retention time: made of points or precursors, merged, looked up."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionquarry.operators.boxes import BOX as SLICE
from ionquarry.operators.boxes import merge_boxes

_SLICE = [c.split()[0] for c in SLICE.split(", ")]


def overlaps(a: str = "a", b: str = "b") -> Column:
    """Whether two slices share more than a border on both axes."""
    both = lambda x: F.least(f"{a}.{x}max", f"{b}.{x}max") > F.greatest(f"{a}.{x}min", f"{b}.{x}min")
    return both("mz") & both("rt")


def same_bounds(a: str = "a", b: str = "b", error: float = 1e-6) -> Column:
    out = F.lit(True)
    for c in ("mzmin", "mzmax", "rtmin", "rtmax"):
        out &= F.abs(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) < error
    return out


def merge_slices(slices: DataFrame) -> DataFrame:
    """Slices of which no two overlap: those that do become their common bounds, again and again; see ``boxes.merge_boxes``."""
    return merge_boxes(slices)


def around_points(points: DataFrame, ppm: float, rt_window: float) -> DataFrame:
    """One slice for each point: its m/z within the tolerance, its rt within twice the window."""
    width = F.col("mz") * ppm / 1e6
    return points.select((F.col("mz") - width).alias("mzmin"), (F.col("mz") + width).alias("mzmax"), (F.col("rt") - 2 * rt_window).alias("rtmin"), (F.col("rt") + 2 * rt_window).alias("rtmax"), "mz", "rt", F.col("intensity").cast("double").alias("ion_count"))


class _Open:
    """The slices of a tenth of a Da that points to come, by rising rt, can still fall into."""

    def __init__(self, ppm: float, rt_window: float, first_wins: bool) -> None:
        self.ppm, self.reach, self.first_wins, self.held = ppm / 1e6, 2 * rt_window, first_wins, []

    def add(self, mz: float, rt: float, y: float) -> list[dict]:
        """Takes a point in; returns the slices that end before it."""
        gone = [s for s in self.held if s["rtmax"] < rt]
        if gone:
            self.held = [s for s in self.held if s["rtmax"] >= rt]
        inside = [s for s in self.held if s["mzmin"] <= mz <= s["mzmax"] and s["rtmin"] <= rt]
        low, high = mz * (1 - self.ppm), mz * (1 + self.ppm)
        if not inside:
            self.held.append({"mzmin": low, "mzmax": high, "rtmin": rt - self.reach, "rtmax": rt + self.reach, "mz": mz, "rt": rt, "ion_count": y})
        elif not self.first_wins:
            s = min(inside, key=lambda s: (abs(s["mz"] - mz), abs(s["rt"] - rt)))
            s |= {"rtmin": min(s["rtmin"], rt - self.reach), "rtmax": max(s["rtmax"], rt + self.reach), "ion_count": max(s["ion_count"], y)}
            s |= {"mzmin": max(min(s["mzmin"], low), low), "mzmax": min(max(s["mzmax"], high), high)}
            s |= {"mz": (s["mzmin"] + s["mzmax"]) / 2, "rt": (s["rtmin"] + s["rtmax"]) / 2}
        return gone


def slice_points(points: DataFrame, ppm: float, rt_window: float = 2.0, first_wins: bool = False) -> DataFrame:
    """Slices that cover all ``points`` (mz, rt, intensity), made in order of rt, then m/z, then intensity.

    A point inside slices that were opened in its tenth of a Da widens the closest one, whose m/z bounds then follow the
    point; with ``first_wins`` it adds nothing. Other points open a slice. Points without m/z or rt are left out.

    Tenths of a Da don't touch each other. Each is read as a stream sorted by rt, in which a slice is sent on as soon as its
    rt has passed: a task holds the open slices of one tenth, however many points that has. Their order makes the points of one tenth one
    task's work.
    """
    usable = points.filter("mz IS NOT NULL AND rt IS NOT NULL AND NOT isnan(mz) AND NOT isnan(rt)")
    keyed = usable.select(F.floor(F.col("mz") * 10).alias("tenth"), F.col("mz").cast("double").alias("mz"), F.col("rt").cast("double").alias("rt"), F.coalesce(F.col("intensity").cast("double"), F.lit(0.0)).alias("intensity"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenth, held, out = None, _Open(ppm, rt_window, first_wins), []
        for batch in batches:
            for key, mz, rt, y in batch.itertuples(index=False, name=None):
                if key != tenth:
                    out += held.held
                    tenth, held = key, _Open(ppm, rt_window, first_wins)
                out += held.add(mz, rt, y)
            yield pd.DataFrame(out, columns=_SLICE)
            out = []
        yield pd.DataFrame(held.held, columns=_SLICE)

    return keyed.repartition("tenth").sortWithinPartitions("tenth", "rt", "mz", "intensity").mapInPandas(run, SLICE)


def slice_precursors(scans: DataFrame, ppm: float, rt_window: float, merge: bool = True) -> DataFrame:
    """Slices around MS2 precursors (mz, rt, intensity): all merged to those that don't overlap, or the first of each place."""
    return merge_slices(around_points(scans, ppm, rt_window)) if merge else slice_points(scans, ppm, rt_window, first_wins=True)


def slice_filter_lines(scans: DataFrame) -> DataFrame:
    """One slice for each filter line: its name and its range of rt."""
    return scans.filter("filter_line IS NOT NULL").groupBy("filter_line").agg(F.min("rt").alias("rtmin"), F.max("rt").alias("rtmax"), F.count(F.lit(1)).alias("scans"))


def slices_at(slices: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """For each point (keys, mz, rt) the slice that holds it; of several the one whose centre is closest. Points without one are left out.

    Slices are put into all tenths of a Da that they reach, points into their own: an equi-join.
    """
    listed = slices.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("mzmin") * 10), F.floor(F.col("mzmax") * 10)))).withColumnsRenamed({"mz": "slice_mz", "rt": "slice_rt"})
    found = points.withColumn("_bin", F.floor(F.col("mz") * 10)).join(listed, "_bin").filter("mz BETWEEN mzmin AND mzmax AND rt BETWEEN rtmin AND rtmax")
    nearest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.abs(F.col("slice_mz") - F.col("mz")), F.abs(F.col("slice_rt") - F.col("rt")), "slice_mz", "slice_rt"))
    return found.withColumn("_r", nearest).filter("_r = 1").drop("_bin", "_r")


def fragmentation_events(scans: DataFrame, slices: DataFrame) -> DataFrame:
    """MS2 scans (scan_id, mslevel, precursor_mz, rt) in each slice: a range join on tenths of a Da."""
    listed = slices.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("mzmin") * 10), F.floor(F.col("mzmax") * 10))))
    ms2 = scans.filter("mslevel > 1").withColumnRenamed("rt", "scan_rt").withColumn("_bin", F.floor(F.col("precursor_mz") * 10))
    return ms2.join(listed, "_bin").filter("precursor_mz BETWEEN mzmin AND mzmax AND scan_rt BETWEEN rtmin AND rtmax").drop("_bin")
