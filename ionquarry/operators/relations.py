"""Relations between groups, peaks and compounds: clusters of groups, covariant m/z, correlation of two windows, scores of hits, helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionquarry.functions.maths import C13_STEP, PROTON
from ionquarry.operators import chrom, matching, ranges

# Names of the identifier keys of a compound
IDENTIFIERS = {"HMDB": "hmdb_id", "KEGG": "kegg_id", "PubChem": "pubchem_id", "ChEBI": "chebi_id", "InChIKey": "inchikey", "SMILES": "smiles"}


def related_groups(groups: DataFrame, peaks: DataFrame, most_rt: float, least_overlap: float = 0.1, least_correlation: float = 0.5) -> DataFrame:
    """Pairs (one, other, correlation) of groups whose rt lies within twice ``most_rt``, that overlap, and whose samples' intensities correlate.

    ``groups``: group_id, rt, rtmin, rtmax; ``peaks``: group_id, sample_id, intensity. Samples that one group lacks count as
    0. Groups meet in bins of rt, an equi-join; without variance the correlation is 0.
    """
    width = 2 * most_rt
    a = groups.select(F.col("group_id").alias("one"), F.col("rt").alias("r1"), F.col("rtmin").alias("a0"), F.col("rtmax").alias("a1"), F.floor(F.col("rt") / width).alias("_bin"))
    home = F.floor(F.col("rt") / width)
    b = groups.select(F.col("group_id").alias("other"), F.col("rt").alias("r2"), F.col("rtmin").alias("b0"), F.col("rtmax").alias("b1"), F.explode(F.array(home - 1, home, home + 1)).alias("_bin"))
    shared = F.least("a1", "b1") - F.greatest("a0", "b0")
    near = a.join(b, "_bin").filter((F.col("one") < F.col("other")) & (F.abs(F.col("r1") - F.col("r2")) <= width) & (shared >= least_overlap * (F.greatest("a1", "b1") - F.least("a0", "b0")))).select("one", "other")
    top = peaks.groupBy("group_id", "sample_id").agg(F.max("intensity").alias("y"))
    n = peaks.agg(F.count_distinct("sample_id")).scalar()  # one number, as a subquery
    sums = top.groupBy("group_id").agg(F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    x, y = top.select(F.col("group_id").alias("one"), "sample_id", F.col("y").alias("x")), top.select(F.col("group_id").alias("other"), "sample_id", F.col("y").alias("z"))
    joint = near.join(x, "one").join(y, ["other", "sample_id"]).groupBy("one", "other").agg(F.sum(F.col("x") * F.col("z")).alias("p"))
    of = lambda c, k: sums.select(F.col("group_id").alias(c), F.col("s").alias(f"s{k}"), F.col("q").alias(f"q{k}"))
    held = joint.join(of("one", 1), "one").join(of("other", 2), "other")
    spread = F.sqrt(F.greatest(F.col("q1") * n - F.col("s1") * F.col("s1"), F.lit(0.0)) * F.greatest(F.col("q2") * n - F.col("s2") * F.col("s2"), F.lit(0.0)))
    r = F.when(spread > 1e-9, (F.col("p") * n - F.col("s1") * F.col("s2")) / spread).otherwise(0.0)
    return held.select("one", "other", r.alias("correlation")).filter(F.col("correlation") >= least_correlation)


def covariants(points: DataFrame, peaks: DataFrame, window: float = 0.1, least: float = 0.5, width: float = 0.001) -> DataFrame:
    """(peak_id, mz, correlation): bins of m/z, 1 mDa wide, that rise and fall with a peak within ``window`` of its apex.

    ``points``: sample_id, scan_id, rt, mz, intensity; ``peaks``: peak_id, sample_id, rt, mz. Neighbouring bins are one, with
    their mean m/z and best correlation. Scans without a bin's points count as 0; fewer than three scans give nothing. Points and
    peaks meet by sample and stretch of rt as wide as the window, so what is read grows with the window, not with the run.
    """
    near = ranges.near_join(points, peaks.select("peak_id", "sample_id", F.col("rt").alias("_rt"), F.col("mz").alias("_mz")), "rt", "_rt", window, ["sample_id"])
    binned = near.groupBy("peak_id", "_mz", F.floor(F.col("mz") / width).alias("_bin"), "scan_id").agg(F.max("intensity").alias("y"))
    own = binned.filter(F.abs(F.col("_bin") * width - F.col("_mz")) <= width).groupBy("peak_id", "scan_id").agg(F.max("y").alias("x"))
    scans = near.groupBy("peak_id").agg(F.count_distinct("scan_id").alias("n"))
    base = own.groupBy("peak_id").agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("qx")).join(scans, "peak_id").filter("n >= 3")
    joint = binned.join(own, ["peak_id", "scan_id"], "left").groupBy("peak_id", "_bin").agg(F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("qy"), F.sum(F.col("y") * F.coalesce("x", F.lit(0.0))).alias("p"))
    held = joint.join(base, "peak_id")
    n = F.col("n")
    spread = F.sqrt(F.greatest(F.col("qx") * n - F.col("sx") * F.col("sx"), F.lit(0.0)) * F.greatest(F.col("qy") * n - F.col("sy") * F.col("sy"), F.lit(0.0)))
    kept = held.withColumn("r", F.when(spread > 1e-9, (F.col("p") * n - F.col("sx") * F.col("sy")) / spread).otherwise(0.0)).filter(F.col("r") >= least)
    merged = chrom.islands(kept, ["peak_id"], "_bin", 1)
    return merged.groupBy("peak_id", "island").agg((F.avg("_bin") * width).alias("mz"), F.max("r").alias("correlation")).drop("island")


def window_correlation(points: DataFrame, one: tuple[float, float], other: tuple[float, float], rt: tuple[float, float]) -> DataFrame:
    """(sample_id, correlation): of the largest intensities in two m/z windows over all scans of a range of rt; 0 without variance."""
    held = points.filter(F.col("rt").between(*rt))
    most = lambda w: F.coalesce(F.max(F.when(F.col("mz").between(*w), F.col("intensity"))), F.lit(0.0))
    scans = held.groupBy("sample_id", "scan_id").agg(most(one).alias("a"), most(other).alias("b"))
    spread = F.stddev_pop("a") * F.stddev_pop("b")
    return scans.groupBy("sample_id").agg(F.when(spread > 0, F.covar_pop("a", "b") / spread).otherwise(0.0).alias("correlation"))


def with_proton_shifts(library: Column) -> Column:
    """A library spectrum with each peak also a proton up and down, for spectra of uncertain protonation."""
    shifted = lambda d: F.transform(library, lambda p: F.struct((p["mz"] + d).alias("mz"), p["intensity"].alias("intensity")))
    return F.array_sort(F.concat(library, shifted(PROTON), shifted(-PROTON)), lambda x, y: F.when(x["mz"] < y["mz"], -1).when(x["mz"] > y["mz"], 1).otherwise(0))


def score_named(scores: Column, name: str) -> Column:
    """One of a struct of scores by its name; unknown names, and the two that no one computes, are 0."""
    return scores[name] if name in (*matching.SCORES, "matches") else F.lit(0.0)


def quant_precursor(override: Column, library: Column, computed: Column) -> Column:
    """The m/z to quantify: what the metadata says, else the library's, else the computed one; values not above 0 say nothing."""
    some = lambda c: F.when(c > 0, c)
    return F.coalesce(some(override), some(library), some(computed))


def identifier_key(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in IDENTIFIERS.items() for x in pair])
    return F.try_element_at(table, name)


def with_offset(isotopes: DataFrame, observed: Column) -> DataFrame:
    """Isotopes (group_id, neutrons, mz) moved so that the lightest one stands at its group's ``observed`` m/z."""
    first = F.first("mz").over(Window.partitionBy("group_id").orderBy("neutrons", "mz").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return isotopes.withColumn("mz", F.col("mz") + F.coalesce(observed - first, F.lit(0.0)))


def best_peak(peaks: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group the most intense peak, of equal ones that of the smallest sample, with its charge by its isotope step, if named.

    ``peaks`` may have isotope_mz, the m/z of the next isotope.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("intensity"), "sample_id")
    out = peaks.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
    return out.withColumn("charge", F.round(C13_STEP / (F.col("isotope_mz") - F.col("mz"))).cast("int")) if "isotope_mz" in peaks.columns else out


def shuffled(values: Column, seed: int) -> Column:
    """The array in an order that the seed and the values decide."""
    keyed = F.transform(values, lambda v, i: F.struct(F.xxhash64(F.lit(seed), v, i).alias("k"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def without_places(values: Column, places: list[int]) -> Column:
    """The array without the values at some places, from 0."""
    return F.filter(values, lambda v, i: ~i.isin(places)) if places else values


def load_filters(scans: DataFrame, mslevel: int | None = None, polarity: int | None = None, quantile: float = 0.0, least: float = 0.0) -> DataFrame:
    """``scans`` (sample, scan_id, mslevel, polarity, mz, intensity arrays) as they are loaded: filtered, numbered from 0 by sample.

    Points stay that exceed both the quantile (in percent, by rank) and ``least`` where those are above 0.
    """
    out = scans if mslevel is None else scans.filter(F.col("mslevel") == mslevel)
    out = out if polarity is None else out.filter(F.col("polarity") == polarity)
    paired = F.arrays_zip("mz", "intensity")
    if quantile > 0:
        n = F.size("intensity")
        cut = F.get(F.array_sort("intensity"), F.least((n * (quantile / 100)).cast("int"), n - 1))
        out = out.withColumn("_p", F.filter(paired, lambda p: p["intensity"] > cut)).withColumns({c: F.col(f"_p.{c}") for c in ("mz", "intensity")}).drop("_p")
    if least > 0:
        out = out.withColumn("_p", F.filter(F.arrays_zip("mz", "intensity"), lambda p: p["intensity"] > least)).withColumns({c: F.col(f"_p.{c}") for c in ("mz", "intensity")}).drop("_p")
    return out.withColumn("scan_id", F.row_number().over(Window.partitionBy("sample").orderBy("scan_id")) - 1)


def missing_peaks(groups: DataFrame, samples: DataFrame, peaks: DataFrame, traces: DataFrame, keys: list[str]) -> DataFrame:
    """For each group and sample without a peak, the sum and top of the trace in the group's range of rt; without points no row.

    ``groups``: keys, group_id, rtmin, rtmax; ``samples``: sample_id; ``traces``: keys, sample_id, rt, intensity.
    """
    listed = [r["sample_id"] for r in chrom.small_rows(samples.select("sample_id"))]
    wanted = groups.withColumn("sample_id", F.explode(F.array(*[F.lit(s).cast(samples.schema["sample_id"].dataType) for s in listed])))
    lacking = wanted.join(peaks.select(*keys, "group_id", "sample_id"), [*keys, "group_id", "sample_id"], "left_anti")
    near = traces.join(lacking, [*keys, "sample_id"]).filter("rt BETWEEN rtmin AND rtmax")
    return near.groupBy(*keys, "group_id", "sample_id").agg(F.sum("intensity").alias("area"), F.max("intensity").alias("intensity"))


def network_features(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a dense feature array; nulls are 0."""
    return rows.withColumn("features", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]))
