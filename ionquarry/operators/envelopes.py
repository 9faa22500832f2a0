"""Isotope quantities of peak groups: extraction windows, sums, matrices, corrections, children, differential labelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionquarry.operators.ranking import ranked

from ionquarry.functions import isotopes as I


def isotope_windows(groups: DataFrame, ppm: float, labels: dict[str, int] | None = None, least: float = 1e-4) -> DataFrame:
    """(group_id, isotope, mz, mzmin, mzmax, proportion): a window around each isotope of a group's (formula, adduct).

    Distributions are computed once for each distinct formula and adduct; the group's m/z offset to its lightest isotope moves all.
    """
    distinct = groups.select("formula", "adduct").distinct().withColumn("_i", I.isotopes_of(F.col("formula"), F.col("adduct"), labels, least))
    held = groups.join(distinct, ["formula", "adduct"]).withColumn("_first", F.get("_i", F.lit(0))["mz"])
    each = held.withColumn("_e", F.explode("_i"))
    mz = F.col("_e.mz") + F.coalesce(F.col("mz") - F.col("_first"), F.lit(0.0))
    return each.select("group_id", F.col("_e.name").alias("isotope"), mz.alias("mz"), (mz * (1 - ppm / 1e6)).alias("mzmin"), (mz * (1 + ppm / 1e6)).alias("mzmax"), F.col("_e.proportion").alias("proportion"), "rtmin", "rtmax")


def led(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaders, members): groups alike in formula, adduct, m/z and rt range have the same isotopes in all samples; the smallest group_id of them leads.

    ``leaders`` has the columns of ``groups``, ``members`` group_id and leader of each group.
    """
    alike = ["formula", "adduct", "mz", "rtmin", "rtmax"]
    leaders = groups.groupBy(*alike).agg(F.min("group_id").alias("group_id")).select("group_id", *alike)
    # few bytes make many children, so they are dealt to a fixed number of partitions
    number = max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups.sparkSession.sparkContext.defaultParallelism)
    a, b = groups.repartition(number, "group_id").alias("a"), leaders.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in alike]
    return leaders, a.join(b, same).select("a.group_id", F.col("b.group_id").alias("leader"))


def _scans(windows: DataFrame, points: DataFrame) -> DataFrame:
    """(group_id, isotope, sample_id, scan_id, _y, _rt): the largest intensity and the first rt of each scan in a group's windows.

    Windows are put into all tenths of a Da that they reach, points into their own: an equi-join. Groups of one formula have
    the same windows, which are looked up once.
    """
    window = ["mzmin", "mzmax", "rtmin", "rtmax"]
    listed = windows.select(*window).distinct().withColumn("_bin", F.explode(F.sequence(F.floor(F.col("mzmin") * 10), F.floor(F.col("mzmax") * 10))))
    near = points.withColumn("_bin", F.floor(F.col("mz") * 10)).join(listed, "_bin").filter("mz BETWEEN mzmin AND mzmax AND rt BETWEEN rtmin AND rtmax")
    found = near.groupBy(*window, "sample_id", "scan_id").agg(F.max("intensity").alias("_y"), F.min("rt").alias("_rt"))
    own = windows.select("group_id", "isotope", *window).join(found, window)
    return own.groupBy("group_id", "isotope", "sample_id", "scan_id").agg(F.max("_y").alias("_y"), F.min("_rt").alias("_rt"))


def extracted(windows: DataFrame, points: DataFrame) -> DataFrame:
    """(group_id, isotope, sample_id, intensity, apex_rt, scans): the sum over a group's rt range of each scan's largest point in the window."""
    scans = _scans(windows, points)
    out = scans.groupBy("group_id", "isotope", "sample_id").agg(F.sum("_y").alias("intensity"), F.max(F.struct("_y", (-F.col("_rt")).alias("neg"))).alias("_b"), F.count(F.lit(1)).alias("scans"))
    return out.withColumn("apex_rt", -F.col("_b.neg")).drop("_b")


def correlated_extraction(windows: DataFrame, points: DataFrame, parent: str = "C12 PARENT", least: float = 0.9) -> DataFrame:
    """``extracted`` for the isotopes whose trace correlates with the parent's over shared scans; the parent always stays.

    An isotope or parent without variance over the shared scans correlates by 0.
    """
    scans = _scans(windows, points)
    own = scans.filter(F.col("isotope") == parent).select("group_id", "sample_id", "scan_id", F.col("_y").alias("_p"))
    both = scans.join(own, ["group_id", "sample_id", "scan_id"])
    spread = F.stddev_pop("_y") * F.stddev_pop("_p")
    r = F.when(spread > 0, F.covar_pop("_y", "_p") / spread).otherwise(0.0)
    kept = both.groupBy("group_id", "isotope", "sample_id").agg(r.alias("_r")).filter((F.col("_r") >= least) | (F.col("isotope") == parent))
    return extracted(windows, points).join(kept.drop("_r"), ["group_id", "isotope", "sample_id"], "left_semi")


def near_apex(windows: DataFrame, parents: DataFrame, points: DataFrame, most_error: float | None = None, parent: str = "C12 PARENT", scans: int = 3) -> DataFrame:
    """(group_id, isotope, sample_id, rt, intensity): of each parent peak's isotopes the highest point within ``scans`` scans of its apex.

    ``parents``: group_id, sample_id, scan_id, intensity; ``windows`` has abundance beside proportion where ``most_error`` is
    given: then isotopes too rare to see (abundance below 1e-8, or less than 1 of the parent's intensity), and those whose
    observed share is off by more than so many percent, are left out, but for the parent. The last scan does not count.
    """
    listed = windows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("mzmin") * 10), F.floor(F.col("mzmax") * 10)))).drop("mz", "rtmin", "rtmax")
    apex = parents.select("group_id", "sample_id", F.col("scan_id").alias("_apex"), F.col("intensity").alias("_parent"))
    wanted = apex.join(listed, "group_id")
    own = points.withColumn("_bin", F.floor(F.col("mz") * 10))
    near = own.join(wanted, ["sample_id", "_bin"]).filter(f"mz BETWEEN mzmin AND mzmax AND scan_id >= _apex - {scans} AND scan_id < _apex + {scans}")
    order = Window.partitionBy("group_id", "isotope", "sample_id", "_apex").orderBy(F.desc("intensity"), "scan_id", "mz")
    best = near.withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    if most_error is not None:
        seen = F.col("intensity") / (F.col("_parent") + F.col("intensity"))
        error = F.abs(seen - F.col("abundance")) / F.col("abundance") * 100
        rare = (F.col("abundance") < 1e-8) | (F.col("abundance") * F.col("_parent") < 1)
        best = best.filter((F.col("isotope") == parent) | (~rare & (error <= most_error)))
    return best.select("group_id", "isotope", "sample_id", "rt", "intensity")


def nearest_peaks(found: DataFrame, peaks: DataFrame, most: float) -> DataFrame:
    """Of each isotope found (group_id, isotope, sample_id, rt) the closest of its trace's picked ``peaks``, at most ``most`` away."""
    keys = ["group_id", "isotope", "sample_id"]
    near = found.select(*keys, F.col("rt").alias("_rt")).join(peaks, keys).filter(F.abs(F.col("rt") - F.col("_rt")) <= most)
    order = Window.partitionBy(*keys).orderBy(F.abs(F.col("rt") - F.col("_rt")), "rt")
    return near.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r", "_rt")


def corrected(quant: DataFrame, windows: DataFrame, parent: str = "C12 PARENT") -> DataFrame:
    """``quant`` with corrected: intensity less what the parent's natural abundance explains, 0 at least."""
    share = windows.select("group_id", "isotope", "proportion")
    base = F.max(F.when(F.col("isotope") == parent, F.col("intensity"))).over(Window.partitionBy("group_id", "sample_id"))
    held = quant.join(share, ["group_id", "isotope"]).withColumn("_m0", base)
    return held.withColumn("corrected", F.when((F.col("isotope") != parent) & (F.col("_m0") > 0) & (F.col("proportion") > 0), F.greatest(F.lit(0.0), F.col("intensity") - F.col("proportion") * F.col("_m0"))).otherwise(F.col("intensity"))).drop("_m0")


def matrix(quant: DataFrame, isotopes: list[str], value: str = "intensity", share: bool = False) -> DataFrame:
    """One row for each group and sample, one column for each isotope, 0 where missing; as shares of the row's sum if asked."""
    wide = quant.groupBy("group_id", "sample_id").pivot("isotope", isotopes).agg(F.sum(value)).fillna(0.0, isotopes)
    if not share:
        return wide
    total = sum((F.col(f"`{i}`") for i in isotopes), F.lit(0.0))
    return wide.select("group_id", "sample_id", *[F.when(total > 0, F.col(f"`{i}`") / total).otherwise(0.0).alias(i) for i in isotopes])


def children(quant: DataFrame, parent: str = "C12 PARENT", members: DataFrame | None = None) -> DataFrame:
    """Isotope groups: child_id, parent_group_id, isotope, samples, max_intensity; the parent isotope has no parent.

    Where ``quant`` is of leaders, each of their ``members`` (group_id, leader) has the leader's.
    """
    out = quant.groupBy("group_id", "isotope").agg(F.count_distinct("sample_id").alias("samples"), F.max("intensity").alias("max_intensity"))
    if members is not None:
        out = members.join(out.withColumnRenamed("group_id", "leader"), "leader")
    return out.select(F.concat_ws("/", "group_id", "isotope").alias("child_id"), F.when(F.col("isotope") != parent, F.col("group_id")).alias("parent_group_id"), "isotope", "samples", "max_intensity")


def enough_isotopes(quant: DataFrame, least: int) -> DataFrame:
    """``quant`` of the groups of which some sample has ``least`` isotopes above 0, with group_rank by their largest intensity."""
    seen = quant.filter("intensity > 0").groupBy("group_id", "sample_id").agg(F.count_distinct("isotope").alias("_n"))
    kept = seen.groupBy("group_id").agg(F.max("_n").alias("_n")).filter(F.col("_n") >= least).select("group_id")
    held = quant.join(kept, "group_id", "left_semi")
    tops = held.groupBy("group_id").agg(F.max("intensity").alias("_top"))
    ranks = ranked(tops, [F.desc("_top"), F.col("group_id")], "group_rank").drop("_top")
    return held.join(ranks, "group_id")


def differential(quant: DataFrame, reproducible: int, how: str = "mean", drop_double_zero: bool = True) -> DataFrame:
    """(group_id, isotopes, score): 1 - r squared of unlabelled and labelled envelopes of each group.

    ``quant``: is_labelled. Of each side an isotope counts by the mean or median of its values above 0, if there are
    ``reproducible`` of them, else by 0; isotopes of 0 on both sides are left out if asked. Fewer than two isotopes, or an
    envelope without variance, score 0.
    """
    f = {"mean": F.avg, "median": F.median}[how]
    sides = []
    for side in (False, True):
        value = F.when((F.col("is_labelled") == side) & (F.col("intensity") > 0), F.col("intensity"))
        sides.append(F.when(F.count(value) >= reproducible, f(value)).otherwise(0.0))
    per = quant.groupBy("group_id", "isotope").agg(sides[0].alias("a"), sides[1].alias("b"))
    if drop_double_zero:
        per = per.filter("a > 0 OR b > 0")
    spread = F.stddev_pop("a") * F.stddev_pop("b")
    r = F.when(spread > 0, F.covar_pop("a", "b") / spread)
    return per.groupBy("group_id").agg(F.count(F.lit(1)).alias("isotopes"), r.alias("_r")).select("group_id", "isotopes", F.when((F.col("isotopes") >= 2) & F.col("_r").isNotNull(), 1 - F.col("_r") * F.col("_r")).otherwise(0.0).alias("score"))


def differential_f(quant: DataFrame) -> DataFrame:
    """(group_id, score): the sum over isotopes of variance between the sides over variance within, on values normalised by sample.

    As the score is defined, the number of values is squared in the variance between. Isotopes without variance on a side,
    or with fewer than two values there, are skipped.
    """
    total = F.sum("intensity").over(Window.partitionBy("group_id", "sample_id"))
    held = quant.filter("intensity > 0").withColumn("_x", F.col("intensity") / total)
    on = lambda side: F.when(F.col("is_labelled") == side, F.col("_x"))
    per = held.groupBy("group_id", "isotope").agg(*[f(on(s)).alias(f"{n}{int(s)}") for s in (False, True) for f, n in ((F.avg, "m"), (F.var_samp, "v"), (F.count, "n"))], F.avg("_x").alias("m"))
    usable = per.filter("n0 > 1 AND n1 > 1 AND v0 > 0 AND v1 > 0")
    between = F.pow(F.col("n0") * (F.col("m0") - F.col("m")), 2) + F.pow(F.col("n1") * (F.col("m1") - F.col("m")), 2)
    within = (F.col("v0") * (F.col("n0") - 1) + F.col("v1") * (F.col("n1") - 1)) / (F.col("n0") + F.col("n1") - 2)
    return usable.groupBy("group_id").agg(F.sum(between / within).alias("score"))
