"""Delta mining: pairs of m/z that rise and fall together over the last full scans, and their sessions.

``scans`` points are rows sample_id, scan_id, mz, intensity of full scans.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def correlated_pairs(points: DataFrame, top: int = 1000, history: int = 10, least: float = 1e3, correlation: float = 0.9, ppm: float = 1.0) -> DataFrame:
    """(sample_id, scan_id, mz1, mz2, correlation): pairs of a scan's ``top`` peaks whose traces over the last scans correlate.

    From the ``history``-th scan on. A peak's trace is the largest intensity within ``ppm`` of its m/z in each of the last
    ``history`` scans, 0 where there is none. Only a scan's own top peaks are paired, so pairs grow with scans, not with
    points squared. Peaks meet the history in bins of log m/z, an equi-join.
    """
    number = F.dense_rank().over(Window.partitionBy("sample_id").orderBy("scan_id"))
    held = points.withColumn("n", number)
    ranked = held.filter(F.col("intensity") > least).withColumn("_r", F.row_number().over(Window.partitionBy("sample_id", "n").orderBy(F.desc("intensity"), "mz")))
    tops = ranked.filter((F.col("_r") <= top) & (F.col("n") >= history)).select("sample_id", "scan_id", "n", "mz").distinct()
    width = max(ppm, 0.01) * 1.5e-6
    own = tops.withColumn("_bin", F.floor(F.log("mz") / width)).withColumn("_back", F.explode(F.sequence(F.lit(0), F.lit(history - 1)))).withColumn("_at", F.col("n") - F.col("_back"))
    home = F.floor(F.log("mz") / width)
    spread = held.select("sample_id", F.col("n").alias("_at"), F.col("mz").alias("_mz"), "intensity", F.explode(F.array(home - 1, home, home + 1)).alias("_bin"))
    near = F.abs(F.col("_mz") - F.col("mz")) <= F.col("mz") * ppm / 1e6
    seen = own.join(spread, ["sample_id", "_at", "_bin"], "left").groupBy("sample_id", "scan_id", "n", "mz", "_back").agg(F.coalesce(F.max(F.when(near, F.col("intensity"))), F.lit(0.0)).alias("_y"))
    traces = seen.groupBy("sample_id", "scan_id", "n", "mz").agg(F.array_sort(F.collect_list(F.struct("_back", "_y"))).alias("_t")).withColumn("_t", F.transform("_t", lambda x: x["_y"]))
    a, b = traces, traces.select("sample_id", "scan_id", F.col("mz").alias("mz2"), F.col("_t").alias("_u"))
    pairs = a.join(b, ["sample_id", "scan_id"]).filter("mz < mz2")
    total = lambda t: F.aggregate(t, F.lit(0.0), lambda s, x: s + x)
    mean_t, mean_u = total(F.col("_t")) / history, total(F.col("_u")) / history
    joint = total(F.zip_with("_t", "_u", lambda x, y: x * y)) / history - mean_t * mean_u
    spread_of = lambda t, m: F.sqrt(total(F.transform(t, lambda x: (x - m) * (x - m))) / history)
    scale = spread_of(F.col("_t"), mean_t) * spread_of(F.col("_u"), mean_u)
    found = pairs.withColumn("correlation", F.when(F.col("_t") == F.col("_u"), 1.0).when(scale > 0, joint / scale).otherwise(0.0))
    return found.filter(F.col("correlation") > correlation).select("sample_id", "scan_id", "n", F.col("mz").alias("mz1"), "mz2", "correlation")


def _chains(pairs: DataFrame, ppm: float) -> DataFrame:
    """``pairs`` with _a and _b: numbers of chains of mz1 in a sample, and of mz2 in those, without a gap of ``ppm``."""
    chained = pairs
    for col, name, by in (("mz1", "_a", ["sample_id"]), ("mz2", "_b", ["sample_id", "_a"])):
        w = Window.partitionBy(*by).orderBy(col, "n")
        fresh = F.coalesce((F.col(col) - F.lag(col).over(w) >= F.col(col) * ppm / 1e6).cast("int"), F.lit(0))
        chained = chained.withColumn("_f", fresh).withColumn(name, F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")
    return chained


def sessions(pairs: DataFrame, ppm: float = 3.0, gap: int = 5) -> DataFrame:
    """Pairs seen again within ``ppm`` on both sides and fewer than ``gap`` scans later, as one: first and last scan, hits, first correlation.

    Chains of m/z without a gap of ``ppm`` are one pair; columns: sample_id, n (the scan's number), mz1, mz2, correlation.
    """
    chained = _chains(pairs, ppm)
    w = Window.partitionBy("sample_id", "_a", "_b").orderBy("n", "mz1", "mz2")
    fresh = F.coalesce((F.col("n") - F.lag("n").over(w) >= gap).cast("int"), F.lit(0))
    held = chained.withColumn("_f", fresh).withColumn("_s", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = held.groupBy("sample_id", "_a", "_b", "_s").agg(F.min("n").alias("first_scan"), F.max("n").alias("last_scan"), F.count(F.lit(1)).alias("hits"), F.avg("mz1").alias("mz1"), F.avg("mz2").alias("mz2"), F.min_by("correlation", F.struct("n", "mz1", "mz2")).alias("correlation"))
    return out.withColumn("delta", F.col("mz2") - F.col("mz1")).drop("_a", "_b", "_s")


class PairCache:
    """Pairs of m/z in the order in which they came; a later one within ``ppm`` of both and fewer than ``gap`` scans on extends the first that fits.

    An entry keeps the m/z and the correlation it began with, and one scan extends it once at most. Entries lie under bins
    of log m/z wider than the tolerance, so a pair looks at its own bin of either m/z and their neighbours.
    """

    def __init__(self, ppm: float = 3.0, gap: int = 5) -> None:
        self.ppm, self.gap, self.count = ppm, gap, 0
        self.held: dict[int, dict[int, list[list]]] = {}

    def bin(self, mz: float) -> int:
        return math.floor(math.log(mz) / (max(self.ppm, 0.01) * 1.5e-6))

    def put(self, entry: list) -> None:
        """``entry``: number, mz1, mz2, correlation, first scan, last scan, hits."""
        self.held.setdefault(self.bin(entry[1]), {}).setdefault(self.bin(entry[2]), []).append(entry)

    def add(self, n: int, mz1: float, mz2: float, correlation: float) -> None:
        i, j = self.bin(mz1), self.bin(mz2)
        near = [e for a in (i - 1, i, i + 1) if a in self.held for b in (j - 1, j, j + 1) for e in self.held[a].get(b, ())]
        fits = [e for e in near if 0 < n - e[5] < self.gap and abs(mz1 - e[1]) / (e[1] / 1e6) < self.ppm and abs(mz2 - e[2]) / (e[2] / 1e6) < self.ppm]
        if fits:
            first = min(fits)
            first[5:] = n, first[6] + 1
        else:
            self.put([self.count, mz1, mz2, correlation, n, n, 1])
            self.count += 1

    def entries(self) -> list[list]:
        return [e for of in self.held.values() for some in of.values() for e in some]


CACHED = "first_scan long, last_scan long, hits long, mz1 double, mz2 double, correlation double, delta double"


def cached_rows(sample: object, entries: list[list]) -> list[tuple]:
    """Rows of sample_id and ``CACHED``."""
    return [(sample, first, last, hits, a, b, r, b - a) for _, a, b, r, first, last, hits in entries]


def cached_sessions(pairs: DataFrame, ppm: float = 3.0, gap: int = 5) -> DataFrame:
    """Pairs (sample_id, n, mz1, mz2, correlation) as a ``PairCache`` of each sample holds them, in order of n, mz1, mz2.

    Unlike ``sessions``, nearness is to the pair that began an entry, so entries do not drift. Only pairs of one chain of
    either m/z can meet, so each chain is a group of its own, not each sample. Pairs with a null or an m/z of 0 or less are left out.
    """
    sample = pairs.schema["sample_id"].dataType.simpleString()
    kept = pairs.select("sample_id", "n", "mz1", "mz2", "correlation").filter("mz1 > 0 AND mz2 > 0 AND n IS NOT NULL")
    names = ["sample_id", *[c.split()[0] for c in CACHED.split(", ")]]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        cache = PairCache(ppm, gap)
        for row in group.sort_values(["n", "mz1", "mz2", "correlation"])[["n", "mz1", "mz2", "correlation"]].itertuples(index=False):
            cache.add(*row)
        return pd.DataFrame(cached_rows(key[0], cache.entries()), columns=names)

    return _chains(kept, ppm).groupBy("sample_id", "_a", "_b").applyInPandas(run, f"sample_id {sample}, {CACHED}")


def mine(points: DataFrame, least_hits: int = 2, **options) -> DataFrame:
    """Deltas of pairs seen in ``least_hits`` scans or more, the job of the reference's command line."""
    return sessions(correlated_pairs(points, **options)).filter(F.col("hits") >= least_hits)
