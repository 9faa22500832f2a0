"""Retention-time alignment: segment tables, interpolation between samples, polynomial fits, errors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionquarry.operators.chrom import middle, small_rows


def segments(anchors: DataFrame) -> DataFrame:
    """Contiguous segments (sample_id, rt0, rt1, new0, new1) of each sample from its anchors (sample_id, rt, rt_update).

    The first one starts at -inf and the last one ends at inf, with the shift of the nearest anchor. Anchors whose update
    does not grow beyond all before it are left out; of equal rts the smallest update counts.
    """
    w = Window.partitionBy("sample_id").orderBy("rt")
    single = anchors.groupBy("sample_id", "rt").agg(F.min("rt_update").alias("rt_update"))
    rising = single.withColumn("_most", F.max("rt_update").over(w.rowsBetween(Window.unboundedPreceding, -1))).filter("_most IS NULL OR rt_update > _most").drop("_most")
    both = rising.withColumns({"rt1": F.lead("rt").over(w), "new1": F.lead("rt_update").over(w), "_first": F.row_number().over(w) == 1})
    inner = both.select("sample_id", F.col("rt").alias("rt0"), F.coalesce("rt1", F.lit(float("inf"))).alias("rt1"), F.col("rt_update").alias("new0"), "new1")
    head = both.filter("_first").select("sample_id", F.lit(float("-inf")).alias("rt0"), F.col("rt").alias("rt1"), F.lit(None).cast("double").alias("new0"), F.col("rt_update").alias("new1"))
    return inner.unionByName(head)


def updated(points: DataFrame, segs: DataFrame) -> DataFrame:
    """``points`` (sample_id, rt, ...) with rt_update: linear within its segment, a shift in the outer ones; without segments the rt.

    Each sample's few segments are an array beside its points, and a point looks its own up: no range join.
    """
    listed = segs.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("rt0", "rt1", "new0", "new1"))).alias("_segs"))
    held = points.join(listed, "sample_id", "left")
    own = F.get(F.filter("_segs", lambda s: (F.col("rt") >= s["rt0"]) & (F.col("rt") < s["rt1"])), F.lit(0))
    inside = own["new0"] + (F.col("rt") - own["rt0"]) * (own["new1"] - own["new0"]) / (own["rt1"] - own["rt0"])
    moved = F.when(own.isNull(), F.col("rt")).when(own["new0"].isNull(), F.col("rt") + own["new1"] - own["rt1"]).when(own["new1"].isNull(), F.col("rt") + own["new0"] - own["rt0"]).otherwise(inside)
    return held.withColumn("rt_update", moved).drop("_segs")


def between_samples(anchors: DataFrame) -> DataFrame:
    """``anchors`` (anchor_id, sample_id, rt or null) with rt filled: linear in sample_id between those that have one, constant outside."""
    w = Window.partitionBy("anchor_id").orderBy("sample_id")
    known = F.when(F.col("rt").isNotNull(), F.struct(F.col("sample_id").alias("s"), "rt"))
    last = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # from the other end, since a frame that ends at the last row is read again for each row
    back = Window.partitionBy("anchor_id").orderBy(F.desc("sample_id"))
    following = F.last(known, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    held = anchors.withColumns({"_l": last, "_n": following})
    inside = F.col("_l.rt") + (F.col("sample_id") - F.col("_l.s")) * (F.col("_n.rt") - F.col("_l.rt")) / (F.col("_n.s") - F.col("_l.s"))
    filled = F.when(F.col("rt").isNotNull(), F.col("rt")).when(F.col("_l").isNull(), F.col("_n.rt")).when(F.col("_n").isNull(), F.col("_l.rt")).otherwise(inside)
    return held.withColumn("rt_filled", filled).drop("_l", "_n")


def fit_error(peaks: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over each sample's peaks of the squared distance to their group's median rt."""
    medians = peaks.groupBy(*keys).agg(F.median("rt").alias("_median"))
    return peaks.join(medians, keys).groupBy("sample_id").agg(F.sum(F.pow(F.col("_median") - F.col("rt"), 2)).alias("error"), F.count(F.lit(1)).alias("peaks"))


def _moments(most: int) -> list[Column]:
    """s0.. = sums of u^k up to twice the degree, t0.. = sums of u^k d, and the sum of d^2: all that least squares of d on u need."""
    power = lambda k: F.lit(1.0) if k == 0 else F.pow(F.col("_u"), F.lit(float(k)))
    return [F.array(*[F.sum(power(k)) for k in range(2 * most + 1)]).alias("s"), F.array(*[F.sum(power(k) * F.col("_d")) for k in range(most + 1)]).alias("t"), F.sum(F.col("_d") * F.col("_d")).alias("dd")]


def solved(s: np.ndarray, t: np.ndarray, degree: int) -> np.ndarray | None:
    """Coefficients, lowest power first, of least squares from moments; null where the points don't determine them."""
    at = np.arange(degree + 1)
    normal = s[at[:, None] + at[None, :]]
    if np.linalg.matrix_rank(normal, tol=1e-9 * max(abs(normal).max(), 1e-300)) <= degree:
        return None
    return np.linalg.solve(normal, t[: degree + 1])


def _squares(c: np.ndarray, s: np.ndarray, t: np.ndarray, dd: float) -> float:
    """Sum of squared residuals of a polynomial ``c``, lowest power first, from the moments of the points."""
    at = np.arange(len(c))
    return max(float(c @ s[at[:, None] + at[None, :]] @ c - 2 * c @ t[: len(c)] + dd), 0.0)


def best_of(every: tuple, halves: list[tuple], most_degree: int) -> np.ndarray | None:
    """The fit on one of ``halves`` with the smallest root mean square over ``every`` point; null if none is below that of no change.

    Moments are (s, t, dd). Of equal fits the one of the lower degree, then of the earlier half, wins.
    """
    s, t, dd = every
    best, least = None, math.sqrt(dd / s[0])
    for degree in range(1, most_degree):
        for half in halves:
            fit = solved(half[0], half[1], degree)
            if fit is None:
                continue
            error = math.sqrt(_squares(fit, s, t, dd) / s[0])
            if error < least - 1e-9:
                best, least = fit, error
    return best


def fit_points(peaks: DataFrame, keys: list[str]) -> DataFrame:
    """The points that count for a sample's fit: sample_id, rt, _median, _copy, _u and _d (rt, and the way to the median, in deviations), _centre, _scale.

    Groups of two peaks or more; at most five points of one rt; samples of ten points or more; without outliers, whose
    squared residuals of a cubic lie over 1.5 deviations from their mean. Peaks with a null rt don't count. All by sums for
    each sample, combined before they are shuffled: no sample's points are held at once.
    """
    known = peaks.filter("rt IS NOT NULL AND sample_id IS NOT NULL").select(*keys, "sample_id", "rt")
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").drop("_n")
    medians = middle(known, keys, "rt", "_median").join(sizes, keys, "left_semi")
    pairs = known.join(medians, keys).select("sample_id", "rt", "_median")
    five = pairs.withColumn("_copy", F.row_number().over(Window.partitionBy("sample_id", "rt").orderBy("_median"))).filter("_copy <= 5")
    about = five.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n"), F.avg("rt").alias("_centre"), F.stddev_pop("rt").alias("_scale")).filter("_n >= 10").drop("_n")
    about = about.withColumn("_scale", F.when(F.col("_scale") > 0, F.col("_scale")).otherwise(1.0))
    placed = five.join(about, "sample_id").withColumns({"_u": (F.col("rt") - F.col("_centre")) / F.col("_scale"), "_d": (F.col("_median") - F.col("rt")) / F.col("_scale")})
    sums = placed.groupBy("sample_id").agg(*_moments(3))

    def cubic(batches):
        for batch in batches:
            rows = [(np.array(s), np.array(t)) for s, t in zip(batch["s"], batch["t"], strict=True)]
            fits = [next((f for f in (solved(s, t, d) for d in (3, 2, 1, 0)) if f is not None), np.zeros(1)) for s, t in rows]
            yield pd.DataFrame({"sample_id": batch["sample_id"], "_cubic": [f[::-1].tolist() for f in fits]})

    schema = T.StructType([peaks.schema["sample_id"], T.StructField("_cubic", T.ArrayType(T.DoubleType()))])
    value = F.aggregate("_cubic", F.lit(0.0), lambda a, c: a * F.col("_u") + c)
    off = placed.join(sums.select("sample_id", "s", "t").mapInPandas(cubic, schema), "sample_id").withColumn("_r", F.pow(value - F.col("_d"), F.lit(2.0)))
    spread = off.groupBy("sample_id").agg(F.avg("_r").alias("_mean"), F.stddev_pop("_r").alias("_dev"))
    near = (F.col("_dev") <= 1e-15) | ((F.col("_r") - F.col("_mean")) / F.col("_dev") <= 1.5)
    return off.join(spread, "sample_id").filter(near).select("sample_id", "rt", "_median", "_copy", "_u", "_d", "_centre", "_scale")


def in_half(attempt: Column, seed: int) -> Column:
    """Whether a point is in the random half of an ``attempt``; attempt 0 takes all. Points of one rt and median fall apart by their number.

    It goes by values that were read, not by sums, so that a task that runs again draws the same half.
    """
    return (attempt == 0) | (F.pmod(F.xxhash64(F.lit(seed), attempt, "rt", "_median", "_copy"), F.lit(2)) == 0)


def polynomial_fits(peaks: DataFrame, keys: list[str], most_degree: int = 4, seed: int = 0, attempts: int = 11) -> DataFrame:
    """(sample_id, coefficients, highest power first): the map of each sample's rt onto its groups' medians; null without a better one.

    Of ``fit_points``, all degrees below ``most_degree`` are fitted to several random halves, and judged on all points, by
    sums of powers for each sample and attempt; a row of sums for each is all that Python sees. Samples with fewer than ten points are not listed
    or have none.
    """
    points = fit_points(peaks, keys)
    tried = points.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(attempts)))).filter(in_half(F.col("_k"), seed))
    sums = tried.groupBy("sample_id", "_k").agg(*_moments(max(most_degree - 1, 1)), F.first("_centre").alias("_centre"), F.first("_scale").alias("_scale"))
    listed = sums.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("_k", "s", "t", "dd"))).alias("m"), F.first("_centre").alias("_centre"), F.first("_scale").alias("_scale"))
    schema = T.StructType([peaks.schema["sample_id"], T.StructField("coefficients", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            out = []
            for m, centre, scale in zip(batch["m"], batch["_centre"], batch["_scale"], strict=True):
                every, *halves = [(np.array(x["s"]), np.array(x["t"]), x["dd"]) for x in m]
                fit = best_of(every, halves, most_degree)
                if fit is None:
                    out.append(None)
                else:
                    moved = np.poly1d(fit[::-1])(np.poly1d([1 / scale, -centre / scale])) * scale + np.poly1d([1.0, 0.0])
                    out.append(np.atleast_1d(moved.coeffs).tolist())
            yield pd.DataFrame({"sample_id": batch["sample_id"], "coefficients": out})

    return listed.mapInPandas(run, schema)


def moved_by(points: DataFrame, fits: DataFrame) -> DataFrame:
    """``points`` with the rt that its sample's polynomial gives; without one the rt stays."""
    value = F.aggregate("coefficients", F.lit(0.0), lambda s, c: s * F.col("rt") + c)
    held = points.join(fits, "sample_id", "left")
    return held.withColumn("rt", F.when(F.col("coefficients").isNull(), F.col("rt")).otherwise(value)).select(*points.columns)


def apply_polynomial(points: DataFrame, fits: DataFrame) -> DataFrame:
    """``moved_by`` that keeps the rt a point had as rt_original."""
    return moved_by(points.withColumn("rt_original", F.col("rt")), fits)


def restored(points: DataFrame) -> DataFrame:
    """``points`` with the rt they had."""
    return points.drop("rt").withColumnRenamed("rt_original", "rt")


def aligned(peaks: DataFrame, keys: list[str], rounds: int = 5, most_degree: int = 4, seed: int = 0) -> DataFrame:
    """``peaks`` with rt aligned by repeated polynomial fits, and rt_original; stops, and goes back, when the total error no longer falls.

    The driver holds one number a round. Peaks have the group's keys, sample_id and rt; several of one sample in a group, and
    repeated rows, stay as they are; peaks with a null rt keep it.
    """
    return aligned_rounds(peaks, keys, rounds, most_degree, seed)[0]


def aligned_rounds(peaks: DataFrame, keys: list[str], rounds: int = 5, most_degree: int = 4, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """What ``aligned`` gives, and the total error before the first round and after each that was kept."""
    total = lambda df: fit_error(df, keys).agg(F.sum("error")).first()[0] or 0.0
    held = peaks.withColumn("rt_original", F.col("rt"))
    errors = [total(held)]
    for k in range(rounds):
        moved = moved_by(held, polynomial_fits(held, keys, most_degree, seed + k)).checkpoint()
        now = total(moved)
        if now >= errors[-1]:
            break
        held = moved
        errors.append(now)
    return held, errors


def anchors_from_traces(traces: DataFrame, anchors: DataFrame, ppm: float, rt_window: float) -> DataFrame:
    """(anchor_id, sample_id, rt): the rt of the most intense point of each sample around each anchor (anchor_id, mz, expected_rt), or null.

    Points are put into bins of m/z as wide as the tolerance at 100 Da, anchors into all bins they reach. Anchors are at most
    10,000, checked, before they are broadcast to make a row for each with each sample, which is the result's size.
    """
    width = 100 * ppm / 1e6 * 2
    own = traces.withColumn("_bin", F.floor(F.col("mz") / width))
    reach = F.col("anchor_mz") * ppm / 1e6
    spread = anchors.withColumnRenamed("mz", "anchor_mz").withColumn("_bin", F.explode(F.sequence(F.floor((F.col("anchor_mz") - reach) / width), F.floor((F.col("anchor_mz") + reach) / width))))
    near = own.join(spread, "_bin").filter((F.abs(F.col("mz") - F.col("anchor_mz")) <= reach) & (F.abs(F.col("rt") - F.col("expected_rt")) <= rt_window))
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy("anchor_id", "sample_id").orderBy(F.desc("intensity"), "rt"))).filter("_r = 1")
    small_rows(anchors.select("anchor_id"))
    grid = traces.select("sample_id").distinct().crossJoin(F.broadcast(anchors.select("anchor_id")))
    return grid.join(best.select("anchor_id", "sample_id", "rt"), ["anchor_id", "sample_id"], "left")
