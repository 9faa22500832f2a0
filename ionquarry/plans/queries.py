"""Named queries over the domain views, each beside the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionquarry.functions import chem
from ionquarry.operators import chrom, ranges
from ionquarry.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_WITH = "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in views.SQL.items())
_TRACE = ", trace AS (SELECT sample_id, scan_id, sum(intensity) AS tic FROM signal GROUP BY ALL)"


def query(view: str, sql: str | None = None, extra: str = ""):
    """Registers a function of the view's DataFrame under its name, with its SQL over the views, if SQL can say it."""

    def wrap(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(getattr(views, view)(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = _WITH + extra + (sql if sql.startswith(",") else " " + sql)
        return f

    return wrap


def _r(col, digits: int = 6):
    return F.round(col, digits)


WINDOWS = [(k, 100.0 + 10 * k, 104.0 + 10 * k) for k in range(10)]
_WINDOW_ROWS = ", ".join(f"({k}, {lo}, {hi})" for k, lo, hi in WINDOWS)


@query("signal", f"""SELECT s.sample_id, s.scan_id, w.k AS window_id, coalesce(max(p.intensity), 0) AS intensity, arg_max(p.mz, (p.intensity, -p.mz)) AS mz
  FROM (SELECT DISTINCT sample_id, scan_id FROM signal) s CROSS JOIN (VALUES {_WINDOW_ROWS}) w(k, lo, hi)
  LEFT JOIN signal p ON p.sample_id = s.sample_id AND p.scan_id = s.scan_id AND p.mz BETWEEN w.lo AND w.hi GROUP BY 1, 2, 3""")
def eic_extract(points):
    windows = points.sparkSession.createDataFrame(WINDOWS, "window_id int, mzmin double, mzmax double")
    return chrom.extracted_ions(points, windows)


@query("signal", "SELECT sample_id, scan_id, round(sum(intensity), 6) AS tic FROM signal GROUP BY 1, 2")
def tic_trace(points):
    return chrom.tic_trace(points).withColumn("tic", _r("tic"))


@query("signal", "SELECT sample_id, scan_id, max(intensity) AS base_intensity, arg_max(mz, (intensity, -mz)) AS base_mz FROM signal GROUP BY 1, 2")
def base_peak_trace(points):
    return chrom.base_peak_trace(points)


@query("signal", "SELECT sample_id, min(mz) AS min_mz, max(mz) AS max_mz, round(min(rt), 6) AS min_rt, round(max(rt), 6) AS max_rt, min(intensity) AS min_intensity, max(intensity) AS max_intensity, round(sum(intensity), 6) AS total FROM signal GROUP BY 1")
def sample_ranges(points):
    return points.groupBy("sample_id").agg(*[f(F.when((F.col("mz") > 0) & (F.col("mz") < 1e9), F.col("mz"))).alias(n) for f, n in ((F.min, "min_mz"), (F.max, "max_mz"))], _r(F.min("rt")).alias("min_rt"), _r(F.max("rt")).alias("max_rt"), F.min("intensity").alias("min_intensity"), F.max("intensity").alias("max_intensity"), _r(F.sum("intensity")).alias("total"))


@query("signal", "SELECT sample_id, round(avg(gap), 6) AS mean_gap FROM (SELECT sample_id, scan_id - lag(scan_id) OVER (PARTITION BY sample_id ORDER BY scan_id) AS gap FROM (SELECT DISTINCT sample_id, scan_id FROM signal)) GROUP BY 1")
def scan_gap_mean(points):
    gap = F.col("scan_id") - F.lag("scan_id").over(Window.partitionBy("sample_id").orderBy("scan_id"))
    return points.select("sample_id", "scan_id").distinct().withColumn("gap", gap).groupBy("sample_id").agg(_r(F.avg("gap")).alias("mean_gap"))


def _taps_sql(taps: dict[int, float]) -> str:
    near = {k: f"lag(tic, {-k}) OVER w" if k <= 0 else f"lead(tic, {k}) OVER w" for k in taps}
    return f"({' + '.join(f'coalesce({near[k]} * {w!r}, 0)' for k, w in taps.items())}) / ({' + '.join(f'CASE WHEN {near[k]} IS NULL THEN 0 ELSE {w!r} END' for k, w in taps.items())})"


_HALF = chrom.gaussian_weights(5)


@query("signal", f"SELECT sample_id, scan_id, round({_taps_sql({k: _HALF[abs(k)] for k in range(1 - len(_HALF), len(_HALF))})}, 6) AS smoothed FROM trace WINDOW w AS (PARTITION BY sample_id ORDER BY scan_id)", _TRACE)
def gaussian_smooth(points):
    return chrom.gaussian_smooth(chrom.tic_trace(points), "tic", "sample_id", "scan_id").select("sample_id", "scan_id", _r("smoothed").alias("smoothed"))


@query("signal", "SELECT sample_id, scan_id, round(avg(tic) OVER (PARTITION BY sample_id ORDER BY scan_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smoothed FROM trace", _TRACE)
def moving_average(points):
    return chrom.moving_average(chrom.tic_trace(points), "tic", "sample_id", "scan_id").select("sample_id", "scan_id", _r("smoothed").alias("smoothed"))


@query("signal", f"SELECT sample_id, scan_id, round(CASE WHEN lag(tic, 2) OVER w IS NOT NULL AND lead(tic, 2) OVER w IS NOT NULL THEN greatest({_taps_sql(chrom.SAVGOL_5)}, 0) ELSE tic END, 6) AS smoothed FROM trace WINDOW w AS (PARTITION BY sample_id ORDER BY scan_id)", _TRACE)
def savgol_smooth(points):
    return chrom.savgol_smooth(chrom.tic_trace(points), "tic", "sample_id", "scan_id").select("sample_id", "scan_id", _r("smoothed").alias("smoothed"))


@query("signal", "SELECT t.sample_id, scan_id, round(c.cut, 6) AS cut, round(least(tic, c.cut), 6) AS clipped FROM trace t JOIN (SELECT sample_id, list_sort(list(tic))[1 + CAST(floor(count(*) * 40 / 101) AS INT)] AS cut FROM trace GROUP BY 1) c USING (sample_id)", _TRACE)
def baseline_cut(points):
    return chrom.baseline_cut(chrom.tic_trace(points), "tic", "sample_id").select("sample_id", "scan_id", _r("cut").alias("cut"), _r("clipped").alias("clipped"))


@query("signal", "SELECT sample_id, scan_id, round(tic, 6) AS tic FROM (SELECT *, lag(tic) OVER w AS l, lead(tic) OVER w AS r FROM trace WINDOW w AS (PARTITION BY sample_id ORDER BY scan_id)) WHERE tic > l AND tic > r", _TRACE)
def local_maxima(points):
    return chrom.local_maxima(chrom.tic_trace(points), "tic", "sample_id", "scan_id").withColumn("tic", _r("tic"))


@query("signal", """SELECT sample_id, island, min(scan_id) AS first_scan, max(scan_id) AS last_scan, count(*) AS points, round(sum(tic), 6) AS area FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY sample_id ORDER BY scan_id ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN scan_id - lag(scan_id) OVER (PARTITION BY sample_id ORDER BY scan_id) > 1 THEN 1 ELSE 0 END AS fresh FROM trace WHERE tic > 50)) GROUP BY 1, 2""", _TRACE)
def peak_islands(points):
    above = chrom.tic_trace(points).filter("tic > 50")
    return chrom.islands(above, ["sample_id"], "scan_id", 1).groupBy("sample_id", "island").agg(F.min("scan_id").alias("first_scan"), F.max("scan_id").alias("last_scan"), F.count(F.lit(1)).alias("points"), _r(F.sum("tic")).alias("area"))


@query("signal", "SELECT CAST(floor(scan_id / 4) AS BIGINT) AS rt_bin, channel, round(sum(intensity) / (SELECT count(DISTINCT sample_id) FROM signal), 6) AS intensity, round(avg(mz), 6) AS mz FROM signal GROUP BY 1, 2")
def merged_eic(points):
    samples = points.select(F.count_distinct("sample_id").alias("samples"))  # one row
    merged = points.groupBy(F.floor(F.col("scan_id") / 4).alias("rt_bin"), "channel").agg(F.sum("intensity").alias("total"), F.avg("mz").alias("mz"))
    return merged.join(F.broadcast(samples)).select("rt_bin", "channel", _r(F.col("total") / F.col("samples")).alias("intensity"), _r("mz").alias("mz"))


@query("signal", "SELECT sample_id, floor(mz * 0.5 + 0.5) / 0.5 AS mz_bin, round(sum(intensity * mz) / sum(intensity), 6) AS mz, round(avg(intensity), 6) AS intensity FROM signal WHERE intensity > 0 GROUP BY 1, 2")
def average_scan(points):
    mean_mz = F.sum(F.col("intensity") * F.col("mz")) / F.sum("intensity")
    return points.filter("intensity > 0").groupBy("sample_id", (F.floor(F.col("mz") * 0.5 + 0.5) / 0.5).alias("mz_bin")).agg(_r(mean_mz).alias("mz"), _r(F.avg("intensity")).alias("intensity"))


@query("signal", "SELECT sample_id, lo + 7 * ceil((mz - lo) / 7 - 0.5) AS node, round(sum(intensity), 6) AS sum_intensity, max(intensity) AS max_intensity, round(avg(intensity), 6) AS mean_intensity, round(median(intensity), 6) AS median_intensity FROM (SELECT *, min(mz) OVER (PARTITION BY sample_id) AS lo FROM signal) GROUP BY 1, 2")
def snap_to_grid(points):
    low = points.withColumn("lo", F.min("mz").over(Window.partitionBy("sample_id")))
    return low.groupBy("sample_id", (F.col("lo") + 7 * F.ceil((F.col("mz") - F.col("lo")) / 7 - 0.5)).alias("node")).agg(_r(F.sum("intensity")).alias("sum_intensity"), F.max("intensity").alias("max_intensity"), _r(F.avg("intensity")).alias("mean_intensity"), _r(F.median("intensity")).alias("median_intensity"))


@query("signal", "SELECT sample_id, q, v[1 + least(CAST(floor(q * n / 100) AS INT), n - 1)] AS intensity FROM (SELECT sample_id, list_sort(list(intensity)) AS v, CAST(count(*) AS INT) AS n FROM signal GROUP BY 1), (SELECT unnest(range(101)) AS q)")
def quantile_table(points):
    return chrom.quantile_points(points, ["sample_id"], "intensity")


@query("signal", "SELECT sample_id, scan_id, point_id, intensity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, scan_id ORDER BY intensity DESC, point_id) AS rank FROM signal) WHERE rank <= 3")
def top_n_per_scan(points):
    rank = F.row_number().over(Window.partitionBy("sample_id", "scan_id").orderBy(F.desc("intensity"), "point_id"))
    return points.withColumn("rank", rank).filter("rank <= 3").select("sample_id", "scan_id", "point_id", "intensity", "rank")


@query("signal", """SELECT channel, mz, count(*) AS peaks, count(DISTINCT sample_id) AS samples, max(intensity) AS max_intensity, round(avg(rt), 6) AS mean_rt, round(min(rt), 6) AS min_rt, round(max(rt), 6) AS max_rt,
  round(sum(intensity * rt) / sum(intensity), 6) AS weighted_rt, round(median(rt), 6) AS median_rt, count(*) FILTER (intensity > 50) AS good FROM signal WHERE intensity > 0 GROUP BY 1, 2""")
def group_statistics(points):
    held, by = points.filter("intensity > 0"), ["channel", "mz"]
    # one row for each sample first, so that distinct samples are counted rows
    per = held.groupBy(*by, "sample_id").agg(F.count(F.lit(1)).alias("n"), F.max("intensity").alias("top"), F.sum("rt").alias("rts"), F.min("rt").alias("r0"), F.max("rt").alias("r1"), F.sum(F.col("intensity") * F.col("rt")).alias("w"), F.sum("intensity").alias("i"), F.count_if(F.col("intensity") > 50).alias("good"))
    mean, weighted = F.sum("rts") / F.sum("n"), F.sum("w") / F.sum("i")
    out = per.groupBy(*by).agg(F.sum("n").alias("peaks"), F.count(F.lit(1)).alias("samples"), F.max("top").alias("max_intensity"), _r(mean).alias("mean_rt"), _r(F.min("r0")).alias("min_rt"), _r(F.max("r1")).alias("max_rt"), _r(weighted).alias("weighted_rt"), F.sum("good").alias("good"))
    return out.join(chrom.middle(held, by, "rt", "m").select(*by, _r("m").alias("median_rt")), by)


@query("signal", "SELECT channel, mz, sample_id, max(intensity) AS intensity, arg_max(point_id, (intensity, -point_id)) AS point_id FROM signal GROUP BY 1, 2, 3")
def one_peak_per_sample(points):
    best = F.max(F.struct("intensity", (-F.col("point_id")).alias("neg")))
    return points.groupBy("channel", "mz", "sample_id").agg(best.alias("b")).select("channel", "mz", "sample_id", "b.intensity", (-F.col("b.neg")).alias("point_id"))


@query("signal", "SELECT channel, max(m) AS blank_max, round(median(m), 6) AS blank_median FROM (SELECT channel, sample_id, max(intensity) AS m FROM signal WHERE sample_id % 5 = 0 GROUP BY 1, 2) GROUP BY 1")
def blank_background(points):
    per = points.filter("sample_id % 5 = 0").groupBy("channel", "sample_id").agg(F.max("intensity").alias("m"))
    return per.groupBy("channel").agg(F.max("m").alias("blank_max"), _r(F.median("m")).alias("blank_median"))


@query("signal", "SELECT point_id, sample_id, last_value(CASE WHEN channel = 'view' THEN point_id END IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY rt, point_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS full_scan FROM signal")
def last_full_scan(points):
    w = Window.partitionBy("sample_id").orderBy("rt", "point_id").rowsBetween(-49, 0)
    return points.select("point_id", "sample_id", F.last(F.when(F.col("channel") == "view", F.col("point_id")), ignorenulls=True).over(w).alias("full_scan"))


@query("signal", "SELECT p.point_id, round(max(p.intensity) / sum(q.intensity), 6) AS purity FROM signal p JOIN signal q ON p.sample_id = q.sample_id AND p.scan_id = q.scan_id AND abs(p.mz - q.mz) <= 5 WHERE p.intensity > 0 GROUP BY 1")
def precursor_purity(points):
    around = Window.partitionBy("sample_id", "scan_id").orderBy("mz").rangeBetween(-5, 5)
    return points.withColumn("all", F.sum("intensity").over(around)).filter("intensity > 0").select("point_id", _r(F.col("intensity") / F.col("all")).alias("purity"))


@query("signal", """SELECT sample_id, channel, island, count(*) AS peaks, round(avg(mz), 6) AS mz, max(intensity) AS intensity FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY sample_id, channel ORDER BY mz, point_id ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN mz - lag(mz) OVER (PARTITION BY sample_id, channel ORDER BY mz, point_id) > 1.5 THEN 1 ELSE 0 END AS fresh FROM signal)) GROUP BY 1, 2, 3""")
def mz_agglomerate(points):
    return chrom.islands(points, ["sample_id", "channel"], "mz", 1.5).groupBy("sample_id", "channel", "island").agg(F.count(F.lit(1)).alias("peaks"), _r(F.avg("mz")).alias("mz"), F.max("intensity").alias("intensity"))


@query("signal", """SELECT a.channel AS one, b.channel AS other, count(*) AS scans, round(corr(a.i, b.i), 6) AS correlation
  FROM (SELECT channel, scan_id, sum(intensity) AS i FROM signal GROUP BY 1, 2) a JOIN (SELECT channel, scan_id, sum(intensity) AS i FROM signal GROUP BY 1, 2) b ON a.scan_id = b.scan_id AND a.channel < b.channel GROUP BY 1, 2""")
def trace_correlation(points):
    trace = points.groupBy("channel", "scan_id").agg(F.sum("intensity").alias("i"))
    a, b = trace.alias("a"), trace.alias("b")
    pairs = a.join(b, (F.col("a.scan_id") == F.col("b.scan_id")) & (F.col("a.channel") < F.col("b.channel")))
    # as in the reference, identical traces have 1 and traces without variance 0; its SQL has no such cases
    spread = F.stddev_pop("a.i") * F.stddev_pop("b.i")  # not corr, which divides by zero before a guard is asked
    correlation = F.when(F.count_if(F.col("a.i") != F.col("b.i")) == 0, 1.0).when(spread == 0, 0.0).otherwise(F.covar_pop("a.i", "b.i") / spread)
    return pairs.groupBy(F.col("a.channel").alias("one"), F.col("b.channel").alias("other")).agg(F.count(F.lit(1)).alias("scans"), _r(correlation).alias("correlation"))


@query("signal", "SELECT mz, scan_id, min(sample_id) AS sample_id FROM signal GROUP BY 1, 2 HAVING count(DISTINCT sample_id) = 1")
def unique_fragments(points):
    return points.groupBy("mz", "scan_id").agg(F.min("sample_id").alias("sample_id"), F.count_distinct("sample_id").alias("n")).filter("n = 1").drop("n")


@query("signal", "SELECT fragments, count(*) AS members, min(id) AS first_member FROM (SELECT scan_id * 100000 + sample_id AS id, array_to_string(list_sort(list(DISTINCT channel)), ',') AS fragments FROM signal GROUP BY scan_id, sample_id) GROUP BY 1")
def identical_sets(points):
    sets = points.groupBy("scan_id", "sample_id").agg(F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("fragments"))
    return sets.groupBy("fragments").agg(F.count(F.lit(1)).alias("members"), F.min(F.col("scan_id") * 100000 + F.col("sample_id")).alias("first_member"))


@query("signal", """SELECT sample_id, island AS session, count(*) AS points, min(scan_id) AS first_scan, max(scan_id) AS last_scan FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY sample_id ORDER BY scan_id, point_id ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN scan_id - lag(scan_id) OVER (PARTITION BY sample_id ORDER BY scan_id, point_id) >= 5 THEN 1 ELSE 0 END AS fresh FROM signal)) GROUP BY 1, 2""")
def delta_sessions(points):
    return chrom.islands(points, ["sample_id"], "scan_id", 4).groupBy("sample_id", F.col("island").alias("session")).agg(F.count(F.lit(1)).alias("points"), F.min("scan_id").alias("first_scan"), F.max("scan_id").alias("last_scan"))


ANCHORS = [(1000.0, 1010.0), (20000.0, 19900.0), (40000.0, 40200.0)]


@query("signal", "SELECT point_id, round(CASE WHEN rt < 1000 THEN rt + 10 WHEN rt < 20000 THEN 1010 + (rt - 1000) * (18890.0::DOUBLE / 19000) WHEN rt < 40000 THEN 19900 + (rt - 20000) * (20300.0::DOUBLE / 20000) ELSE rt + 200 END, 4) AS rt FROM signal")
def rt_segment_update(points):
    return points.select("point_id", _r(chrom.interpolate_at(F.col("rt"), ANCHORS), 4).alias("rt"))


@query("signal", "SELECT s.sample_id, s.fraction, coalesce(round(t.v / sum(t.v) OVER (PARTITION BY s.sample_id), 6), 0) AS share FROM (SELECT sample_id, unnest(range(min(scan_id), max(scan_id) + 1)) AS fraction FROM signal GROUP BY 1) s LEFT JOIN (SELECT sample_id, scan_id AS fraction, sum(intensity) AS v FROM signal GROUP BY 1, 2) t USING (sample_id, fraction)")
def sec_densify(points):
    sums = points.groupBy("sample_id", F.col("scan_id").alias("fraction")).agg(F.sum("intensity").alias("v"))
    grid = points.groupBy("sample_id").agg(F.explode(F.sequence(F.min("scan_id"), F.max("scan_id"))).alias("fraction"))
    total = F.sum("v").over(Window.partitionBy("sample_id"))
    return grid.join(sums, ["sample_id", "fraction"], "left").select("sample_id", "fraction", F.coalesce(_r(F.col("v") / total), F.lit(0.0)).alias("share"))


@query("signal", "SELECT channel, round((avg(intensity) FILTER (sample_id % 2 = 0) - avg(intensity) FILTER (sample_id % 2 = 1)) / sqrt(var_samp(intensity) FILTER (sample_id % 2 = 0) / count(*) FILTER (sample_id % 2 = 0) + var_samp(intensity) FILTER (sample_id % 2 = 1) / count(*) FILTER (sample_id % 2 = 1)), 6) AS t FROM signal GROUP BY 1")
def welch_t(points):
    side = [F.when(F.col("sample_id") % 2 == k, F.col("intensity")) for k in (0, 1)]
    # as in the reference, no variance counts as 1; its SQL has no such cases
    spread = [F.when(F.coalesce(F.var_samp(x), F.lit(0.0)) == 0, 1.0).otherwise(F.var_samp(x)) / F.count(x) for x in side]
    empty = [F.count(x) == 0 for x in side]
    t = F.when(empty[0] & empty[1], 0.0).when(empty[0] | empty[1], 1000.0).otherwise((F.avg(side[0]) - F.avg(side[1])) / F.sqrt(spread[0] + spread[1]))
    return points.groupBy("channel").agg(_r(t).alias("t"))


def library_ppm_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # compounds of one m/z meet a peak together
    library = views.library(spark, sf_dir).groupBy("precursor_mz").agg(F.collect_list("compound_id").alias("compounds"))
    pairs = ranges.ppm_join(views.observed(spark, sf_dir), library, "mz", "precursor_mz", 50.0)
    return pairs.select("order_id", "line", F.explode("compounds").alias("compound_id"), _r(ranges.ppm(F.col("precursor_mz"), F.col("mz")), 3).alias("ppm"))


QUERIES["library_ppm_join"] = library_ppm_join
ORACLES["library_ppm_join"] = _WITH + " SELECT o.order_id, o.line, l.compound_id, round(abs(l.precursor_mz - o.mz) / l.precursor_mz * 1e6, 3) AS ppm FROM observed o JOIN library l ON o.mz BETWEEN l.precursor_mz * 0.999 AND l.precursor_mz * 1.001 AND abs(l.precursor_mz - o.mz) / l.precursor_mz * 1e6 <= 50"


@query("observed", "SELECT order_id, line, intensity, sample FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY intensity DESC, line, sample, mz) AS r FROM observed) WHERE r = 1")
def qqq_rollup(rows):
    rank = F.row_number().over(Window.partitionBy("order_id").orderBy(F.desc("intensity"), "line", "sample", "mz"))
    return rows.withColumn("r", rank).filter("r = 1").select("order_id", "line", "intensity", "sample")


@query("library", "SELECT a.compound_id AS one, b.compound_id AS other FROM library a JOIN library b ON a.category = b.category AND a.name = b.name AND a.compound_id < b.compound_id AND abs(a.precursor_mz - b.precursor_mz) <= 0.5 AND abs(a.expected_rt - b.expected_rt) <= 10")
def srm_transition_join(compounds):
    other = compounds.select(F.col("compound_id").alias("other"), F.col("precursor_mz").alias("other_mz"), F.col("expected_rt").alias("other_rt"), F.col("category").alias("other_category"), F.col("name").alias("other_name"))
    near = ranges.near_join(compounds, other, "precursor_mz", "other_mz", 0.5)
    same = (F.col("category") == F.col("other_category")) & (F.col("name") == F.col("other_name")) & (F.col("compound_id") < F.col("other")) & (F.abs(F.col("expected_rt") - F.col("other_rt")) <= 10)
    return near.filter(same).select(F.col("compound_id").alias("one"), "other")


_ADDUCT_ROWS = ", ".join(f"('{n}', {m}, {z}, {a!r})" for n, m, z, a in chem.ADDUCTS)


@query("library", f"SELECT compound_id, adduct, round((precursor_mz * nmol + added) / abs(charge), 6) AS mz FROM library, (VALUES {_ADDUCT_ROWS}) a(adduct, nmol, charge, added)")
def adduct_ions(compounds):
    listed = F.array(*[F.struct(F.lit(n).alias("adduct"), F.lit(m).alias("nmol"), F.lit(z).alias("charge"), F.lit(a).alias("added")) for n, m, z, a in chem.ADDUCTS])
    return compounds.withColumn("a", F.explode(listed)).select("compound_id", "a.adduct", _r(chem.adduct_mz(F.col("precursor_mz"), F.col("a.nmol"), F.col("a.charge"), F.col("a.added"))).alias("mz"))


@query("library", f"SELECT compound_id, formula, round(CAST(c * 12.0 + (2 * c + 2) * {chem.ELEMENTS['H']!r} + {chem.ELEMENTS['O']!r} AS DOUBLE), 6) AS mass FROM (SELECT compound_id, CAST(expected_rt AS INT) AS c, 'C' || CAST(expected_rt AS INT) || 'H' || (2 * CAST(expected_rt AS INT) + 2) || 'O' AS formula FROM library)")
def formula_mass(compounds):
    c = F.col("expected_rt").cast("int")
    formula = F.concat(F.lit("C"), c.cast("string"), F.lit("H"), (2 * c + 2).cast("string"), F.lit("O"))
    return compounds.select("compound_id", formula.alias("formula")).withColumn("mass", _r(chem.formula_mass(F.col("formula"))))


@query("library", "SELECT compound_id, k, round(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)) * pow(0.0107, k) * pow(0.9893, n - k), 9) AS abundance FROM (SELECT compound_id, CAST(expected_rt AS INT) AS n FROM library), (SELECT CAST(unnest(range(3)) AS INT) AS k) WHERE k <= n")
def c13_distribution(compounds):
    """Binomial abundance of the first three heavy-carbon isotopes, as its SQL has it; c13_all_distribution has all."""
    return _c13_rows(compounds).filter("k < 3")


_C13_SQL = "SELECT compound_id, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)) * pow(0.0107, k) * pow(0.9893, n - k) AS a FROM (SELECT compound_id, n, CAST(unnest(range(n + 1)) AS INT) AS k FROM (SELECT compound_id, CAST(expected_rt AS INT) AS n FROM library))"


def _c13_rows(compounds: DataFrame, threshold: float = 0.0) -> DataFrame:
    # distributions are computed once for each number of carbons
    held = compounds.select("compound_id", F.col("expected_rt").cast("int").alias("n"))
    each = held.select("n").distinct().withColumn("_c", chem.c13_distribution(F.col("n"), threshold))
    listed = held.join(each, "n").select("compound_id", F.explode("_c").alias("c"))
    return listed.select("compound_id", "c.k", _r("c.abundance", 9).alias("abundance"))


@query("library", f"SELECT compound_id, k, round(a, 9) AS abundance FROM ({_C13_SQL})")
def c13_all_distribution(compounds):
    """Binomial abundance of every number of heavy carbons, from none to all."""
    return _c13_rows(compounds)


@query("library", f"SELECT compound_id, k, round(a, 9) AS abundance FROM (SELECT *, max(a) OVER (PARTITION BY compound_id) AS most FROM ({_C13_SQL})) WHERE a >= most * 1e-6")
def c13_top_distribution(compounds):
    """Those of at least 1e-6 of the largest abundance, the reference's default threshold."""
    return _c13_rows(compounds, 1e-6)


@query("spectra", "SELECT a.spectrum_id, round(list_dot_product(a.intensity, b.intensity) / sqrt(list_dot_product(a.intensity, a.intensity) * list_dot_product(b.intensity, b.intensity)), 6) AS cosine FROM spectra a JOIN spectra b ON b.spectrum_id = a.spectrum_id + 1")
def spectrum_cosine(rows):
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    follow = rows.select((F.col("spectrum_id") - 1).alias("spectrum_id"), F.col("intensity").alias("next"))
    cosine = dot("intensity", "next") / F.sqrt(dot("intensity", "intensity") * dot("next", "next"))
    return rows.join(follow, "spectrum_id").select("spectrum_id", _r(cosine).alias("cosine"))


@query("spectra", "SELECT spectrum_id, round(list_sum(intensity), 6) AS tic, list_max(intensity) AS base, len(list_filter(intensity, lambda x: x > 0.1)) AS above, round(list_sum(list_transform(intensity, lambda x: CASE WHEN x > 0 THEN log10(x) ELSE x END)), 6) AS log_sum FROM spectra")
def spectrum_summary(rows):
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    log = F.transform("intensity", lambda x: F.when(x > 0, F.log10(x)).otherwise(x))
    return rows.select("spectrum_id", _r(total("intensity")).alias("tic"), F.array_max("intensity").alias("base"), F.size(F.filter("intensity", lambda x: x > 0.1)).cast("long").alias("above"), _r(total(log)).alias("log_sum"))


_RESIDUE_SUM = " + ".join(f"(length(residues) - length(replace(residues, '{r}', ''))) * {m!r}" for r, m in chem.RESIDUES.items())


@query("sequences", f"SELECT sequence_id, round(CAST({_RESIDUE_SUM} + {chem.WATER!r} AS DOUBLE), 5) AS mass FROM sequences")
def protein_mass(rows):
    return rows.select("sequence_id", _r(chem.residue_mass(F.col("residues")), 5).alias("mass"))


@query("library", "SELECT compound_id, CASE WHEN least(b1, a1) - greatest(a0, b0) <= 0 THEN 0 WHEN (a0 <= b0 AND a1 >= b1) OR (b0 <= a0 AND b1 >= a1) THEN 1 ELSE round((least(a1, b1) - greatest(a0, b0)) / (greatest(a1, b1) - least(a0, b0)), 6) END AS overlap FROM (SELECT compound_id, expected_rt AS a0, expected_rt + 10 AS a1, 20.0::DOUBLE AS b0, 35.0::DOUBLE AS b1 FROM library)")
def interval_overlap(rows):
    return rows.select("compound_id", _r(ranges.overlap_fraction(F.col("expected_rt"), F.col("expected_rt") + 10, F.lit(20.0), F.lit(35.0))).alias("overlap"))
