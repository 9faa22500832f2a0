"""Chromatogram operators: scan traces, extracted ions, smoothing, baselines, maxima, islands."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Windows that are tested point by point.
FEW_WINDOWS = 64


def tic_trace(points: DataFrame) -> DataFrame:
    """Total ion current of each scan."""
    return points.groupBy("sample_id", "scan_id").agg(F.sum("intensity").alias("tic"))


def base_peak_trace(points: DataFrame) -> DataFrame:
    """The most intense point of each scan; of equal ones that of the smallest m/z."""
    best = F.max(F.struct("intensity", (-F.col("mz")).alias("neg")))
    return points.groupBy("sample_id", "scan_id").agg(best.alias("b")).select("sample_id", "scan_id", F.col("b.intensity").alias("base_intensity"), (-F.col("b.neg")).alias("base_mz"))


def extracted_ions(points: DataFrame, windows: DataFrame, mslevel: int | None = None, rt: tuple[float, float] | None = None, scale: dict | None = None, bin_width: float = 1.0) -> DataFrame:
    """For each window and scan of a sample, the largest intensity in the window, or 0, and its m/z (the smaller of equal ones).

    ``windows``: window_id, mzmin, mzmax. Scans of another ``mslevel``, or outside ``rt``, are left out, and so are full scans
    (mslevel 1) whose own range of m/z misses the window, when the points have these columns. ``scale``: sample_id to a factor
    on intensities. Scans without points have no row; an empty table gives an empty one.

    The points are read once. Up to ``FEW_WINDOWS`` windows are tested point by point, and a scan's points in any of them
    meet; more windows are put into all bins of m/z that they reach and points into their own, an equi-join of which only
    matches are aggregated. Each scan is then filled in for all windows.
    """
    if mslevel is not None:
        points = points.filter(F.col("mslevel") == mslevel)
    if rt is not None:
        points = points.filter(F.col("rt").between(*rt))
    by, rows = ["sample_id", "scan_id"], small_rows(windows)
    ranges = F.array(*[F.struct(F.lit(w["window_id"]).alias("window_id"), F.lit(float(w["mzmin"])).alias("a"), F.lit(float(w["mzmax"])).alias("b")) for w in rows])
    bounds = [F.min("mz").alias("_lo"), F.max("mz").alias("_hi")] if mslevel == 1 else []
    point = F.struct("intensity", (-F.col("mz")).alias("neg"))
    if 0 < len(rows) <= FEW_WINDOWS:
        inside = reduce(lambda x, y: x | y, [F.col("mz").between(float(w["mzmin"]), float(w["mzmax"])) for w in rows])
        scans = points.groupBy(*by).agg(F.collect_list(F.when(inside, point)).alias("_p"), *bounds)
        own = F.array_max(F.filter("_p", lambda p: (-p["neg"]).between(F.col("_w.a"), F.col("_w.b"))))
    else:
        listed = windows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("mzmin") / bin_width), F.floor(F.col("mzmax") / bin_width))))
        found = points.select(*by, "mz", "intensity", F.floor(F.col("mz") / bin_width).alias("_bin")).join(listed, "_bin").filter("mz BETWEEN mzmin AND mzmax")
        # dealt out by scan once: the windows of a scan, and the scan itself, meet without a further shuffle
        best = found.select(*by, "window_id", "mz", "intensity").repartition(*by).groupBy(*by, "window_id").agg(F.max(point).alias("b"))
        held = best.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("window_id", "b"))).alias("_m"))
        scans = (points.groupBy(*by).agg(*bounds) if bounds else points.select(*by).distinct()).join(held, by, "left")
        own = F.try_element_at("_m", F.col("_w.window_id"))
    grid = scans.withColumn("_w", F.explode(ranges))
    if mslevel == 1:
        grid = grid.filter("_hi >= _w.a AND _lo <= _w.b")
    factor = F.lit(1.0) if not scale else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in scale.items() for x in pair]), F.col("sample_id")), F.lit(1.0))
    out = grid.select(*by, F.col("_w.window_id").alias("window_id"), own.alias("_b"))
    return out.select(*by, "window_id", (F.coalesce(F.col("_b.intensity"), F.lit(0.0)) * factor).alias("intensity"), (-F.col("_b.neg")).alias("mz"))


def extracted_top(points: DataFrame, by: list[str]) -> DataFrame:
    """The most intense row of each group, of equal ones the earliest."""
    return points.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("intensity"), "rt"))).filter("_r = 1").drop("_r")


def small_rows(table: DataFrame, most: int = 10_000) -> list:
    """The rows of a table of parameters; more than ``most`` raise."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of parameters has at most {most} rows")
    return rows


def gaussian_weights(window: int) -> list[float]:
    """One half of the kernel, from the centre on, for a smoothing window of so many points."""
    window = 3 if window <= 0 else window + 1 - window % 2
    step = 1.17741 / ((window - 1) / 2)
    return [math.exp(-0.5 * (k * step) ** 2) for k in range(int(3 / step) + 2)]


def weighted(col: str, order: Window, taps: dict[int, float]) -> Column:
    """Weighted mean over neighbours in order; weights of missing ones are left out."""
    near = {k: F.lag(col, -k).over(order) for k in taps}
    total = reduce(Column.__add__, [F.coalesce(near[k] * w, F.lit(0.0)) for k, w in taps.items()])
    weight = reduce(Column.__add__, [F.when(near[k].isNotNull(), w).otherwise(0.0) for k, w in taps.items()])
    return total / weight


def gaussian_smooth(trace: DataFrame, col: str, by: str, order: str, window: int = 5) -> DataFrame:
    half = gaussian_weights(window)
    taps = {k: half[abs(k)] for k in range(1 - len(half), len(half))}
    return trace.withColumn("smoothed", weighted(col, Window.partitionBy(by).orderBy(order), taps))


def moving_average(trace: DataFrame, col: str, by: str, order: str, half: int = 2) -> DataFrame:
    return trace.withColumn("smoothed", F.avg(col).over(Window.partitionBy(by).orderBy(order).rowsBetween(-half, half)))


#: Second-order least-squares weights of five points.
SAVGOL_5 = {-2: -3 / 35, -1: 12 / 35, 0: 17 / 35, 1: 12 / 35, 2: -3 / 35}


def savgol_weights(left: int, right: int, order: int) -> dict[int, float]:
    """Weight of each neighbour in the value at 0 of the least-squares polynomial of ``order`` through a window of them."""
    if left < 0 or right < 0 or order < 0 or left + right < order:
        raise ValueError(f"no polynomial of order {order} through {left} + 1 + {right} points")
    if (left, right, order) == (2, 2, 2):
        return SAVGOL_5
    at = np.arange(-left, right + 1)
    # scaled to at most 1, high powers of wide windows stay in range; the value at 0 is the same
    fit = np.linalg.pinv(np.vander(at / max(left, right, 1), order + 1, increasing=True))[0]
    return {int(k): float(w) for k, w in zip(at, fit, strict=True)}


def savgol_smooth(trace: DataFrame, col: str, by: str, order: str, left: int = 2, right: int = 2, degree: int = 2) -> DataFrame:
    """Least-squares smoothing by a polynomial of ``degree``; points without ``left`` and ``right`` neighbours are copied,
    negative results become 0. The reference also copies the last point that has just ``right`` neighbours."""
    w = Window.partitionBy(by).orderBy(order)
    inner = F.lag(col, left).over(w).isNotNull() & F.lead(col, right).over(w).isNotNull()
    return trace.withColumn("smoothed", F.when(inner, F.greatest(weighted(col, w, savgol_weights(left, right, degree)), F.lit(0.0))).otherwise(F.col(col)))


def middle(values: DataFrame, by: list[str], col: str, name: str) -> DataFrame:
    """(by, name): the exact median of a column, by ranks; a group's values are sorted, with spills, and never held at once."""
    w = Window.partitionBy(*by)
    ranked = values.filter(F.col(col).isNotNull()).select(*by, col, F.row_number().over(w.orderBy(col)).alias("_r"), F.count(F.lit(1)).over(w).alias("_n"))
    return ranked.filter("_r = floor((_n + 1) / 2) OR _r = floor(_n / 2) + 1").groupBy(*by).agg(F.avg(col).alias(name))


def quantile_points(points: DataFrame, by: list[str], col: str) -> DataFrame:
    """(by, q, col): the 101 nearest-rank points, place q / 100 * n, the last one at most.

    Equal values are counted first; each distinct value answers the range of percentiles that falls on it.
    """
    counts = points.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by)
    held = counts.withColumns({"_hi": F.sum("_c").over(w.orderBy(col).rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_c").over(w)})
    up = lambda rank: F.floor((100 * rank + F.col("_n") - 1) / F.col("_n"))
    first, last = up(F.col("_hi") - F.col("_c")), F.when(F.col("_hi") == F.col("_n"), F.lit(100).cast("long")).otherwise(up(F.col("_hi")) - 1)
    return held.withColumns({"_a": first, "_b": last}).filter("_a <= _b").select(*by, F.explode(F.sequence("_a", "_b")).alias("q"), col)


def baseline_cut(trace: DataFrame, col: str, by: str, drop_top: float = 60.0) -> DataFrame:
    """``trace`` with cut, the intensity below which (100 - drop_top) of 101 parts lie, and the trace clipped to it."""
    ranked = trace.withColumns({"_rank": F.row_number().over(Window.partitionBy(by).orderBy(col)) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(by))})
    cut = F.max(F.when(F.col("_rank") == F.floor(F.col("_n") * (100 - drop_top) / 101), F.col(col))).over(Window.partitionBy(by))
    return ranked.withColumn("cut", cut).withColumn("clipped", F.least(col, "cut")).drop("_rank", "_n")


def local_maxima(trace: DataFrame, col: str, by: str, order: str) -> DataFrame:
    """Points strictly above both neighbours."""
    w = Window.partitionBy(by).orderBy(order)
    return trace.withColumns({"_l": F.lag(col).over(w), "_r": F.lead(col).over(w)}).filter((F.col(col) > F.col("_l")) & (F.col(col) > F.col("_r"))).drop("_l", "_r")


def islands(rows: DataFrame, by: list[str], order: str, gap: float) -> DataFrame:
    """``rows`` with island: a number that grows where the next row is more than ``gap`` further on."""
    w = Window.partitionBy(*by).orderBy(order)
    fresh = F.when(F.col(order) - F.lag(order).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def interpolate_at(rt: Column, anchors: list[tuple[float, float]]) -> Column:
    """Piecewise linear map of retention time through (rt, updated) anchors, constant shift outside."""
    out = rt + (anchors[-1][1] - anchors[-1][0])
    for (x0, y0), (x1, y1) in reversed(list(zip(anchors[:-1], anchors[1:], strict=True))):
        out = F.when(rt < x1, F.lit(y0) + (rt - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(rt < anchors[0][0], rt + (anchors[0][1] - anchors[0][0])).otherwise(out)
