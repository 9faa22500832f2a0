"""Peak operators over tables of traces: a row of arrays for each trace (a slice of a sample), many traces in an Arrow batch.

A trace table has the key columns, ``rt``, ``mz`` and ``intensity``; a trace is bounded by the scans of its sample. Rows with
a null rt or intensity are left out; a null m/z counts as 0. Equal rts keep the order of m/z. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ionquarry.operators import trace_kernels as K

_INTS = ("pos", "minpos", "maxpos", "half_left", "half_right", "no_noise", "width", "symmetry", "rank")
_DOUBLES = (
    "rt", "rtmin", "rtmax", "mz", "intensity", "smoothed", "area", "smoothed_area", "area_corrected", "area_fractional", "area_top", "smoothed_area_top", "area_fwhm",
    "smoothed_area_fwhm", "baseline", "signal_to_noise", "smoothed_signal_to_noise", "no_noise_fraction", "mz_median", "mz_mean", "mz_min", "mz_max", "sigma", "fit_error",
)


def _schema(table: DataFrame, keys: list[str], **columns: T.DataType) -> T.StructType:
    return T.StructType([*(table.schema[k] for k in keys), *(T.StructField(n, t) for n, t in columns.items())])


def by_trace(table: DataFrame, keys: list[str], kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], list[dict]], **columns: T.DataType) -> DataFrame:
    """The rows that ``kernel``(rt, mz, intensity) gives for each trace, beside its keys; columns it leaves out are null.

    A group in Python costs many times what a short trace's kernel does, so traces go there as rows of arrays. They are dealt to
    a fixed number of partitions: their bytes are few and their work is not.
    """
    schema = _schema(table, keys, **columns)

    def run(batches):
        for batch in batches:
            lists = [batch.column(c) for c in ("_rt", "_mz", "_y")]
            at = lists[0].offsets.to_numpy()
            rt, mz, y = (x.values.to_numpy(zero_copy_only=False) for x in lists)
            found = [kernel(rt[a:b], mz[a:b], y[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            of = pa.array(np.repeat(np.arange(len(found)), [len(rows) for rows in found]))
            own = [pa.array([row.get(f.name) for rows in found for row in rows], to_arrow_type(f.dataType), from_pandas=True) for f in schema.fields[len(keys) :]]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"_k{i}").take(of) for i in range(len(keys))), *own], names=schema.names)

    held = table.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "rt", "mz", "intensity").filter("rt IS NOT NULL AND intensity IS NOT NULL")
    number = [f"_k{i}" for i in range(len(keys))]
    dealt = held.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), *number)
    point = F.struct(F.col("rt").cast("double").alias("rt"), F.col("mz").isNull().alias("none"), F.coalesce(F.col("mz").cast("double"), F.lit(0.0)).alias("mz"), F.col("intensity").cast("double").alias("y"))
    whole = dealt.groupBy(*number).agg(F.array_sort(F.collect_list(point)).alias("_p"))
    return whole.select(*number, *[F.col(f"_p.{c}").alias(f"_{c}") for c in ("rt", "mz", "y")]).mapInArrow(run, schema)


def by_long_trace(table: DataFrame, keys: list[str], kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], list[dict]], **columns: T.DataType) -> DataFrame:
    """``by_trace`` for few traces of many points: an Arrow group each."""
    schema = _schema(table, keys, **columns)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rt", "mz"], kind="stable")
        found = kernel(group["rt"].to_numpy(float), group["mz"].fillna(0.0).to_numpy(float), group["intensity"].to_numpy(float))
        rows = [dict(zip(keys, key, strict=True)) | row for row in found]
        return pd.DataFrame(rows, columns=schema.names)

    held = table.select(*keys, "rt", "mz", "intensity").filter("rt IS NOT NULL AND intensity IS NOT NULL")
    return held.groupBy(*keys).applyInPandas(run, schema)


_PEAK = {n: T.LongType() for n in _INTS} | {n: T.DoubleType() for n in _DOUBLES}


def pick_peaks(traces: DataFrame, keys: list[str], options: K.Picking = K.Picking()) -> DataFrame:
    """Peaks with bounds by descent, their details and ranks; without bounds, only pos and rt are set."""
    return by_trace(traces, keys, lambda rt, mz, y: K.pick(rt, mz, y, options), **_PEAK)


def pick_simple(traces: DataFrame, keys: list[str], options: K.Picking = K.Picking(), least: float = 0.0, single: bool = False) -> DataFrame:
    """Maxima and plateaus of the smoothed trace with walked bounds; only those of ``least`` or, if ``single``, the highest."""
    return by_trace(traces, keys, lambda rt, mz, y: K.simple_peaks(rt, mz, y, options, least, single), **_PEAK)


def smooth(traces: DataFrame, keys: list[str], options: K.Picking = K.Picking()) -> DataFrame:
    """(keys, rt, intensity, smoothed, baseline, subtracted) of each point."""

    def kernel(rt, mz, y):
        s, (base, _) = K.smoothed(y, options.smoothing, options.smoother), K.baseline(y, options.baseline_smoothing, options.drop_top)
        return [{"rt": a, "intensity": b, "smoothed": c, "baseline": d, "subtracted": max(b - d, 0.0)} for a, b, c, d in zip(rt.tolist(), y.tolist(), s.tolist(), base.tolist(), strict=True)]

    return by_trace(traces, keys, kernel, **{n: T.DoubleType() for n in ("rt", "intensity", "smoothed", "baseline", "subtracted")})


def peak_points(traces: DataFrame, peaks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, rt, mz, intensity): the points within each peak's bounds."""
    bounds = peaks.select(*keys, "pos", "rtmin", "rtmax")
    return traces.join(bounds, keys).filter("rt >= rtmin AND rt <= rtmax").select(*keys, "pos", "rt", "mz", "intensity")


def shape_patterns(traces: DataFrame, keys: list[str], options: K.Picking = K.Picking()) -> DataFrame:
    """The whole trace as a pattern of rises and falls, and its measures."""

    def kernel(rt, mz, y):
        text = K.pattern(y, K.baseline(y, options.baseline_smoothing, options.drop_top)[0])
        return [{"pattern": text, "symmetry": K.longest_symmetry(text), "switches": K.switches(text), "rises": K.switches(text, "-", "+"), "stretch": K.longest_stretch(text, "+"), "noisiness": K.noisiness(text)}]

    ints = {n: T.LongType() for n in ("symmetry", "switches", "rises", "stretch")}
    return by_trace(traces, keys, kernel, pattern=T.StringType(), **ints, noisiness=T.DoubleType())


def interpolate_gaps(traces: DataFrame, keys: list[str]) -> DataFrame:
    kernel = lambda rt, mz, y: [{"rt": a, "intensity": b} for a, b in zip(rt.tolist(), K.interpolated(y).tolist(), strict=True)]
    return by_trace(traces, keys, kernel, rt=T.DoubleType(), intensity=T.DoubleType())


def centroids(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mz, intensity): the peaks of profile spectra, whose points (mz, intensity) are taken in order of m/z."""
    kernel = lambda rt, mz, y: [{"mz": m, "intensity": v} for m, v in K.centroided(y, mz)]
    return by_trace(profiles.withColumn("rt", profiles["mz"]), keys, kernel, mz=T.DoubleType(), intensity=T.DoubleType())


def cross_correlations(traces: DataFrame, keys: list[str], one: float, other: float) -> DataFrame:
    """(keys, z): how far the correlation of a trace's parts before and behind two rts, of one length, exceeds that of shifts."""

    def kernel(rt, mz, y):
        n = min(int((rt >= one).sum()), int((rt >= other).sum()))
        a, b = y[rt >= one][:n], y[rt >= other][:n]
        return [{"z": K.shifted_correlation_z(a, b)}]

    return by_long_trace(traces, keys, kernel, z=T.DoubleType())


def power_spectra(traces: DataFrame, keys: list[str]) -> DataFrame:
    kernel = lambda rt, mz, y: [{"frequency": k, "power": p} for k, p in enumerate(K.power_spectrum(y).tolist())]
    return by_trace(traces, keys, kernel, frequency=T.LongType(), power=T.DoubleType())


def spline_at(traces: DataFrame, keys: list[str], points: int) -> DataFrame:
    """The natural cubic spline through each trace at so many even steps; rts that repeat count once, by their mean."""

    def kernel(rt, mz, y):
        x, inverse = np.unique(rt, return_inverse=True)
        at = np.linspace(x[0], x[-1], points)
        held = np.bincount(inverse, y) / np.bincount(inverse)
        return [{"rt": a, "intensity": b} for a, b in zip(at.tolist(), K.cubic_spline(x, held, at).tolist(), strict=True)]

    return by_trace(traces, keys, kernel, rt=T.DoubleType(), intensity=T.DoubleType())
