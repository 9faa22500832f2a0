"""Peaks of several samples brought together as groups: merged traces, assignment, clustering, merging, group tables.

Peaks are rows with the slice's key columns, sample_id, pos, rt, rtmin, rtmax, intensity and areas. Picking runs trace by
trace; what one task gathers of a slice is its peaks alone, never its points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionquarry.operators import trace_kernels as K
from ionquarry.operators.written import written

#: Order in which peaks choose their group: the most intense first; sample and rt settle what is left.
PEAK_ORDER = ("-intensity", "-area_top", "-area_corrected", "-area", "sample_id", "rt")
#: The older order: the most intense first, then by sample.
OLDER_ORDER = ("-intensity", "sample_id", "rt")


def peak_order() -> list[Column]:
    return [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in PEAK_ORDER]


def merged_eic(traces: DataFrame, keys: list[str], value: str = "intensity") -> DataFrame:
    """(keys, bin, rt, mz, intensity): all samples' traces of a slice on one grid, as long as the longest of them and one more.

    Intensity is the sum over the number of traces (``value`` where it is above 0, else the intensity), m/z the mean of
    those above 0. Bins without points are 0. Rows with a null rt count nothing.
    """
    points = traces.filter("rt IS NOT NULL")
    sizes = points.groupBy(*keys, "sample_id").agg(F.count(F.lit(1)).alias("n"), F.min("rt").alias("r0"), F.max("rt").alias("r1"))
    # written, its size is known, so that points of few slices are not shuffled to as few tasks to meet it
    grid = written(sizes.groupBy(*keys).agg((F.max("n") + 1).alias("length"), F.count(F.lit(1)).alias("traces"), F.min("r0").alias("r0"), F.max("r1").alias("r1")))
    held = points.join(grid, keys)
    place = F.when(F.col("r1") > F.col("r0"), F.least(F.col("length") - 1, F.floor((F.col("rt") - F.col("r0")) / (F.col("r1") - F.col("r0")) * F.col("length")))).otherwise(F.lit(0))
    used = F.when(F.col(value) > 0, F.col(value)).otherwise(F.col("intensity"))
    summed = held.groupBy(*keys, place.cast("long").alias("bin")).agg(F.sum(used / F.col("traces")).alias("sum"), F.avg(F.when(F.col("mz") > 0, F.col("mz"))).alias("mean_mz"))
    bins = grid.select(*keys, "length", "r0", "r1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("bin"))
    rt = F.col("r0") + F.col("bin") * (F.col("r1") - F.col("r0")) / F.col("length")
    return bins.join(summed, [*keys, "bin"], "left").select(*keys, "bin", rt.alias("rt"), F.coalesce("mean_mz", F.lit(0.0)).alias("mz"), F.coalesce("sum", F.lit(0.0)).alias("intensity"))


def bounds_ratio(peaks: DataFrame, points: DataFrame, keys: list[str], least: float, policy: str = "median") -> DataFrame:
    """``peaks`` whose smoothed top exceeds its bounds (their minimum, maximum or median) by a factor; bounds of 0 always pass.

    ``points``: keys, rt, smoothed.
    """
    at = lambda c: points.select(*keys, F.col("rt").alias(c), F.col("smoothed").alias(f"at_{c}"))
    both = peaks.join(at("rtmin"), [*keys, "rtmin"]).join(at("rtmax"), [*keys, "rtmax"])
    edge = {"minimum": F.least("at_rtmin", "at_rtmax"), "maximum": F.greatest("at_rtmin", "at_rtmax"), "median": (F.col("at_rtmin") + F.col("at_rtmax")) / 2}[policy]
    return both.filter((edge <= 0) | (F.col("smoothed") / edge >= least)).select(*peaks.columns)


def assigned(tops: list[dict], peaks: list[dict], most: float) -> list[int | None]:
    """Of each sample peak, in their order, the nearest merged peak within ``most`` that no peak of its sample has yet."""
    taken: set[tuple[int, object]] = set()
    out: list[int | None] = []
    for p in peaks:
        near = [(abs(t["rt"] - p["rt"]), k) for k, t in enumerate(tops) if abs(t["rt"] - p["rt"]) <= most and (k, p["sample_id"]) not in taken]
        best = min(near)[1] if near else None
        taken.add((best, p["sample_id"]))
        out.append(best)
    return out


def joined_spans(span: list[tuple[float, float]], least: float) -> list[int]:
    """Of each group the first one it is joined to by overlaps of ``least`` or more in rt."""
    root = list(range(len(span)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(span)):
        for j in range(i + 1, len(span)):
            if span[j][0] > span[i][1]:
                break
            if K.overlap(*span[i], *span[j]) >= least:
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(span))]


def merge_overlapping(groups: list[list[dict]], least: float) -> list[list[dict]]:
    """Groups of which two overlap in rt by ``least`` or more are one, until none do; of each sample, the more intense peak stays."""
    groups = [g for g in groups if g]
    while True:
        root = joined_spans([(min(p["rtmin"] for p in g), max(p["rtmax"] for p in g)) for g in groups], least)
        if root == list(range(len(groups))):
            return groups
        merged: dict[int, dict] = {}
        for i, g in enumerate(groups):
            own = merged.setdefault(root[i], {})
            for p in g:
                if p["sample_id"] not in own or p["intensity"] > own[p["sample_id"]]["intensity"]:
                    own[p["sample_id"]] = p
        groups = [list(own.values()) for _, own in sorted(merged.items())]


def clustered(peaks: list[dict], most: float) -> list[int]:
    """Cluster of each peak: pairs of unlike samples within ``most``, the closest first, join clusters that share no sample."""
    root = list(range(len(peaks)))
    held = [{p["sample_id"]} for p in peaks]
    by_rt = sorted((i for i, p in enumerate(peaks) if p["rt"] == p["rt"]), key=lambda i: peaks[i]["rt"])
    pairs = []
    for k, i in enumerate(by_rt):
        for j in by_rt[k + 1 :]:
            apart = peaks[j]["rt"] - peaks[i]["rt"]
            if apart > most:
                break
            if peaks[i]["sample_id"] != peaks[j]["sample_id"]:
                pairs.append((round(apart, 6), min(i, j), max(i, j)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for _, i, j in sorted(pairs):
        a, b = sorted((top(i), top(j)))
        if a != b and not held[a] & held[b]:
            root[b], held[a] = a, held[a] | held[b]
    return [top(i) for i in range(len(peaks))]


def clustered_units(rt: np.ndarray, sample: np.ndarray, most: float) -> list[int]:
    """``clustered`` for many peaks at few rts: what pairs of one rt join at once is a unit, and units are paired.

    At one rt the pairs put the k-th peak of each sample into the k-th cluster. Two clusters that share a sample do so for good, so
    the first pair of two units decides on them, and it is that of their first peaks. Rts closer than the pairs' six decimals
    can tell are left to ``clustered``.
    """
    peaks = pd.DataFrame({"rt": rt, "sample": pd.factorize(sample)[0]})
    times = np.unique(rt[~np.isnan(rt)])
    if (np.diff(times) < 2e-6).any():
        return clustered([{"rt": t, "sample_id": s} for t, s in zip(rt.tolist(), peaks["sample"].tolist(), strict=True)], most)
    known = peaks[peaks["rt"].notna()]
    rank = known.groupby(["rt", "sample"]).cumcount()
    root, held, at = np.arange(len(peaks)).tolist(), {}, {}
    for (t, _), index in known.groupby([known["rt"], rank]).groups.items():
        first = int(index.min())
        held[first] = set(known["sample"].loc[index])
        at.setdefault(t, []).append(first)
        for i in index:
            root[i] = first
    ends = np.searchsorted(times, times + most, "right")
    pairs = []
    for k, t in enumerate(times):
        for u in times[k + 1 : ends[k] + 1]:
            if u - t <= most:
                pairs += [(round(float(u - t), 6), min(i, j), max(i, j)) for i in at[t] for j in at[u]]

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for _, i, j in sorted(pairs):
        a, b = sorted((top(i), top(j)))
        if a != b and held[a].isdisjoint(held[b]):
            root[b] = a
            held[a] |= held[b]
    return [top(i) for i in range(len(peaks))]


def _nearest_free(peaks: Column, tops: Column, most: float) -> Column:
    """Of a sample's peaks' rts, in order, the place of their merged peak as ``assigned`` says, or null."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(own: pd.Series, merged: pd.Series) -> pd.Series:
        out = []
        for rts, times in zip(own, merged, strict=True):
            times, free, found = np.asarray(times, float), np.ones(len(times), bool), []
            for rt in np.asarray(rts, float):
                apart = np.abs(times - rt)
                near = np.flatnonzero((apart <= most) & free)
                best = int(near[apart[near].argmin()]) if len(near) else None
                if best is not None:
                    free[best] = False
                found.append(best)
            out.append(found)
        return pd.Series(out)

    return run(peaks, tops)


def _merged_groups(held: DataFrame, keys: list[str], least: float) -> DataFrame:
    """``held`` (peaks with _g) by ``merge_overlapping``, round after round: spans alone meet, peaks are told their group's new number."""
    names = [*keys, "_g", "_root"]
    schema = T.StructType([*(held.schema[k] for k in keys), T.StructField("_g", T.LongType()), T.StructField("_root", T.LongType())])

    def moved(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_g").reset_index(drop=True)
        root = joined_spans(list(zip(group["_a"].tolist(), group["_b"].tolist(), strict=True)), least)
        out = group.assign(_root=group["_g"].to_numpy()[root])
        return out[out["_root"] != out["_g"]][names]

    while True:
        spans = held.groupBy(*keys, "_g").agg(F.min("rtmin").alias("_a"), F.max("rtmax").alias("_b"))
        moves = written(spans.groupBy(*keys).applyInPandas(moved, schema))
        if moves.isEmpty():
            return held
        told = held.join(F.broadcast(moves), [*keys, "_g"], "left").withColumn("_new", F.coalesce("_root", "_g"))
        best = F.row_number().over(Window.partitionBy(*keys, "_new", "sample_id").orderBy(F.desc("intensity"), "_g"))
        kept = told.withColumn("_r", best).filter("_r = 1").withColumn("_g", F.col("_new"))
        held = written(kept.select(*held.columns))


def group_by_merged(peaks: DataFrame, tops: DataFrame, keys: list[str], most: float = 0.25, least_overlap: float = 0.8, order: tuple[str, ...] = PEAK_ORDER) -> DataFrame:
    """``peaks`` with group_id: each, in ``order``, goes to the nearest peak of the slice's merged trace (``tops``); then overlapping groups merge.

    A sample has one peak in a group; peaks without a group are dropped; ``least_overlap`` below 0 leaves groups unmerged.
    Groups count from 0 in order of the merged peaks. Samples don't compete for a merged peak, so each is a row of its own;
    what a slice's groups share is the spans of their peaks alone.
    """
    ordered = [c for name in order for c in (F.col(name.lstrip("-")).isNull(), -F.col(name[1:]) if name[0] == "-" else F.col(name))]
    ranked = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(ordered)], F.struct(*peaks.columns).alias("_p"))
    mine = peaks.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "sample_id"])]).agg(F.array_sort(F.collect_list(ranked)).alias("_rows"))
    times = tops.filter("rt IS NOT NULL").groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.array_sort(F.collect_list(F.col("rt").cast("double"))).alias("_tops"))
    both = mine.join(times, [f"_k{i}" for i in range(len(keys))])
    found = both.select(F.arrays_zip(F.col("_rows._p").alias("p"), _nearest_free(F.col("_rows._p.rt"), F.col("_tops"), most).alias("g")).alias("_z"))
    each = found.select(F.explode("_z").alias("_z")).select("_z.p.*", F.col("_z.g").alias("_g")).filter("_g IS NOT NULL")
    held = written(each)
    if least_overlap >= 0:
        held = _merged_groups(held, keys, least_overlap)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_g")).cast("long") - 1
    numbered = held.select(*keys, "_g").distinct().withColumn("group_id", number)
    return held.join(F.broadcast(numbered), [*keys, "_g"]).select(*peaks.columns, "group_id")


def group_by_distance(peaks: DataFrame, keys: list[str], most: float = 0.25) -> DataFrame:
    """``peaks`` with group_id by constrained single linkage: the closest pairs first, one peak of a sample in a group."""
    schema = T.StructType([*peaks.schema.fields, T.StructField("group_id", T.LongType())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values([c.lstrip("-") for c in PEAK_ORDER], ascending=[c[0] != "-" for c in PEAK_ORDER], kind="stable")
        found = clustered_units(own["rt"].to_numpy(float), own["sample_id"].to_numpy(), most)
        return own.assign(group_id=np.unique(found, return_inverse=True)[1])[schema.names]

    return peaks.groupBy(*keys).applyInPandas(run, schema)


def group_by_score(peaks: DataFrame, tops: DataFrame, keys: list[str]) -> DataFrame:
    """``peaks`` with group_id, the pos of the merged peak of the best 1 / (rt distance + 0.01) / (intensity distance + 0.01) x overlap.

    Peaks that overlap no merged peak, and groups of a single one, are dropped. A slice's merged peaks come to its peaks as one
    array, so that no peak is shuffled to choose its group, and groups, which may hold a part of all peaks, are only counted.
    """
    merged = F.struct(F.col("pos").alias("group_id"), F.col("rt").alias("t_rt"), F.col("rtmin").alias("t0"), F.col("rtmax").alias("t1"), F.col("intensity").alias("t_intensity"))
    top = written(tops.groupBy(*keys).agg(F.collect_list(merged).alias("_tops")))

    def scored(t: Column) -> Column:
        shared = F.least("rtmax", t["t1"]) - F.greatest("rtmin", t["t0"])
        inside = ((F.col("rtmin") <= t["t0"]) & (F.col("rtmax") >= t["t1"])) | ((t["t0"] <= F.col("rtmin")) & (t["t1"] >= F.col("rtmax")))
        overlap = F.when(inside, 1.0).otherwise(shared / (F.greatest("rtmax", t["t1"]) - F.least("rtmin", t["t0"])))
        score = overlap / (F.abs(F.col("rt") - t["t_rt"]) + 0.01) / (F.abs(F.col("intensity") - t["t_intensity"]) + 0.01)
        return F.struct(score.alias("score"), (-t["group_id"]).alias("last"))

    near = F.filter("_tops", lambda t: (F.col("rtmin") <= t["t1"]) & (F.col("rtmax") >= t["t0"]))
    best = -F.array_max(F.transform(near, scored))["last"]
    chosen = written(peaks.join(top, keys).withColumn("group_id", best).filter("group_id IS NOT NULL").select(*peaks.columns, "group_id"))
    several = chosen.groupBy(*keys, "group_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return chosen.join(several, [*keys, "group_id"], "left_semi").select(*peaks.columns, "group_id")


def lowest_ranks(groups: DataFrame, keys: list[str], limit: int, by: str = "max_intensity") -> DataFrame:
    """The ``limit`` best groups of each slice."""
    return groups.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by), "group_id"))).filter(F.col("_r") <= limit).drop("_r")


def group_statistics(peaks: DataFrame, keys: list[str], blank: Column | None = None) -> DataFrame:
    """Measures of each group (keys, group_id) of peaks: tops, means, bounds, quality counts, blank and sample summaries."""
    blank = F.lit(False) if blank is None else blank
    own = peaks.withColumn("_blank", blank)
    at_top = F.struct("intensity", (-F.col("sample_id")).alias("neg"), "rt", "mz")
    some = F.when(F.col("pos") != 0, F.col("rt")), F.when(F.col("pos") != 0, F.col("mz"))
    out = own.groupBy(*keys, "group_id").agg(
        F.max(at_top).alias("top"), F.avg(some[0]).alias("mean_rt"), F.avg(some[1]).alias("mean_mz"), F.min("rtmin").alias("rtmin"), F.max("rtmax").alias("rtmax"),
        F.count(F.lit(1)).alias("peaks"), F.max("no_noise").alias("max_no_noise"), F.max("area_fractional").alias("max_fraction"), F.max("signal_to_noise").alias("max_signal_to_noise"),
        F.sum(F.col("intensity") * F.col("rt")).alias("weighted"), F.sum("intensity").alias("weight"),
        *[f(F.when(F.col("_blank") == side, F.col("intensity"))).alias(f"{name}_{what}") for side, name in ((True, "blank"), (False, "sample")) for f, what in ((F.max, "max"), (F.avg, "mean"), (F.count, "count"))],
    )
    named = out.withColumns({"max_intensity": F.col("top.intensity"), "rt": F.col("top.rt"), "mz": F.col("top.mz"), "weighted_rt": F.when(F.col("weight") > 0, F.col("weighted") / F.col("weight"))})
    return named.drop("top", "weighted", "weight")


def overlap_score(peaks: DataFrame, keys: list[str]) -> DataFrame:
    """For each group the sum of log overlap over its pairs of peaks of unlike samples, over their number; pairs that lie apart count nothing.

    Peaks of one range are counted together: pairs are those of a group's distinct ranges, less the few of one sample.
    """
    by = [*keys, "group_id"]
    shared = F.least("rtmax", "b_rtmax") - F.greatest("rtmin", "b_rtmin")
    inside = ((F.col("rtmin") <= F.col("b_rtmin")) & (F.col("rtmax") >= F.col("b_rtmax"))) | ((F.col("b_rtmin") <= F.col("rtmin")) & (F.col("b_rtmax") >= F.col("rtmax")))
    log = F.log(F.when(inside, 1.0).when(shared > 0, shared / (F.greatest("rtmax", "b_rtmax") - F.least("rtmin", "b_rtmin"))))

    def sums(rows: DataFrame, on: list[str], sign: int) -> DataFrame:
        other = rows.select(*on, F.col("rtmin").alias("b_rtmin"), F.col("rtmax").alias("b_rtmax"), F.col("_n").alias("b_n"))
        pairs = rows.join(other, on).withColumns({"_log": log, "_pairs": sign * F.col("_n") * F.col("b_n")})
        return pairs.groupBy(*by).agg(F.sum(F.col("_log") * F.col("_pairs")).alias("_s"), F.sum("_pairs").alias("_c"), F.sum(F.when(F.col("_log").isNotNull(), F.col("_pairs"))).alias("_known"))

    counted = lambda on: peaks.groupBy(*on, "rtmin", "rtmax").agg(F.count(F.lit(1)).alias("_n"))
    both = sums(counted(by), by, 1).unionByName(sums(counted([*by, "sample_id"]), [*by, "sample_id"], -1))
    total = both.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("_s", "_c", "_known")]).filter("_c > 0")
    return total.select(*by, F.when(F.col("_known") > 0, F.col("_s") / F.col("_c")).alias("overlap_score"))


def quant_matrix(peaks: DataFrame, keys: list[str], samples: list, value: str = "intensity") -> DataFrame:
    """One row for each group, one column for each of ``samples``: the largest ``value`` of its peaks, or 0."""
    wide = peaks.groupBy(*keys, "group_id").pivot("sample_id", samples).agg(F.max(value))
    return wide.fillna(0.0, [str(s) for s in samples])


def transitive_sets(pairs: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of the classes that ``pairs`` (a, b) join, root the smallest node; by pointer jumping, in logarithmically many rounds."""
    both = pairs.select("a", "b").union(pairs.select("b", "a")).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root"))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("root"))
        merged = near.unionByName(labels).groupBy("node").agg(F.min("root").alias("root"))
        jumped = merged.alias("m").join(merged.alias("r"), F.col("m.root") == F.col("r.node")).select(F.col("m.node"), F.col("r.root").alias("root"))
        jumped = jumped.checkpoint()
        if not jumped.exceptAll(labels).limit(1).count():
            return jumped
        labels = jumped
    raise RuntimeError(f"classes are not complete after {rounds} rounds")
