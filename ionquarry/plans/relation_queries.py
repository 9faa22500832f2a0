"""Queries of relations between groups and peaks, of helpers, SMILES and generated isotopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionquarry.functions import smiles
from ionquarry.functions import spectrum as S
from ionquarry.operators import chrom, grouping, infusion, ranking, relations, targeted
from ionquarry.plans.queries import _r, query
from ionquarry.plans.spectrum_queries import with_peaks


@query("signal", """, g AS (SELECT CAST(mz AS BIGINT) AS group_id, avg(rt) AS rt, min(rt) AS a, max(rt) AS b FROM signal GROUP BY 1), p AS (SELECT CAST(mz AS BIGINT) AS group_id, sample_id, max(intensity) AS y FROM signal GROUP BY 1, 2), n AS (SELECT count(DISTINCT sample_id) AS n FROM signal),
  s AS (SELECT group_id, sum(y) AS s, sum(y * y) AS q FROM p GROUP BY 1)
  SELECT one, other, round(r, 6) AS correlation FROM (SELECT x.one, x.other, (p12 * n - s1.s * s2.s) / sqrt((s1.q * n - s1.s * s1.s) * (s2.q * n - s2.s * s2.s)) AS r FROM (SELECT g.group_id AS one, h.group_id AS other, sum(p.y * o.y) AS p12 FROM g JOIN g h ON g.group_id < h.group_id AND abs(g.rt - h.rt) <= 200 AND least(g.b, h.b) - greatest(g.a, h.a) >= 0.1 * (greatest(g.b, h.b) - least(g.a, h.a))
    JOIN p ON p.group_id = g.group_id JOIN p o ON o.group_id = h.group_id AND o.sample_id = p.sample_id GROUP BY 1, 2) x JOIN s s1 ON s1.group_id = one JOIN s s2 ON s2.group_id = other, n) WHERE r >= 0.3""")
def related_groups(points):
    """Groups that elute together and whose samples correlate."""
    held = points.withColumn("group_id", F.col("mz").cast("long"))
    groups = held.groupBy("group_id").agg(F.avg("rt").alias("rt"), F.min("rt").alias("rtmin"), F.max("rt").alias("rtmax"))
    return relations.related_groups(groups, held, 100.0, 0.1, 0.3).withColumn("correlation", _r("correlation"))


@query("signal", "SELECT sample_id, round(coalesce(CASE WHEN stddev_pop(a) * stddev_pop(b) > 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END, 0), 6) AS correlation FROM (SELECT sample_id, scan_id, coalesce(max(intensity) FILTER (mz BETWEEN 100 AND 130), 0) AS a, coalesce(max(intensity) FILTER (mz BETWEEN 150 AND 190), 0) AS b FROM signal WHERE rt BETWEEN 0 AND 30000 GROUP BY 1, 2) GROUP BY 1")
def window_correlation(points):
    """Correlation of two m/z windows over the scans of each sample."""
    return relations.window_correlation(points, (100.0, 130.0), (150.0, 190.0), (0.0, 30000.0)).withColumn("correlation", _r("correlation"))


_COVARIANTS = """, peak AS (SELECT point_id AS peak_id, sample_id, rt AS prt, mz AS pmz FROM signal WHERE intensity > 250),
near AS (SELECT peak_id, pmz, CAST(floor(mz / 1.0) AS BIGINT) AS bin, scan_id, max(intensity) AS y FROM signal JOIN peak USING (sample_id) WHERE abs(rt - prt) <= 3000 GROUP BY ALL),
own AS (SELECT peak_id, scan_id, max(y) AS x FROM near WHERE abs(bin - pmz) <= 1 GROUP BY ALL),
base AS (SELECT peak_id, sx, qx, n FROM (SELECT peak_id, sum(x) AS sx, sum(x * x) AS qx FROM own GROUP BY 1) JOIN (SELECT peak_id, count(DISTINCT scan_id) AS n FROM near GROUP BY 1) USING (peak_id) WHERE n >= 3),
joint AS (SELECT peak_id, bin, sum(y) AS sy, sum(y * y) AS qy, sum(y * coalesce(x, 0)) AS p FROM near LEFT JOIN own USING (peak_id, scan_id) GROUP BY 1, 2),
spread AS (SELECT peak_id, bin, sqrt(greatest(qx * n - sx * sx, 0) * greatest(qy * n - sy * sy, 0)) AS s, p * n - sx * sy AS c FROM joint JOIN base USING (peak_id)),
kept AS (SELECT peak_id, bin, CASE WHEN s > 1e-9 THEN c / s ELSE 0.0 END AS r FROM spread),
island AS (SELECT *, bin - row_number() OVER (PARTITION BY peak_id ORDER BY bin) AS k FROM kept WHERE r >= 0.5)
SELECT peak_id, round(avg(bin), 6) AS mz, round(max(r), 6) AS correlation FROM island GROUP BY peak_id, k"""


@query("signal", _COVARIANTS)
def covariants(points):
    """Bins of m/z that rise and fall with the most intense peaks."""
    peaks = points.filter("intensity > 250").select(F.col("point_id").alias("peak_id"), "sample_id", "rt", "mz")
    return relations.covariants(points, peaks, 3000.0, 0.5, 1.0).withColumns({"mz": _r("mz"), "correlation": _r("correlation")})


@query("signal", "SELECT point_id, channel, intensity, row_number() OVER (ORDER BY intensity DESC NULLS LAST, point_id) AS place FROM signal")
def group_rank(points):
    """The place of each point by intensity over the whole table."""
    return ranking.ranked(points.select("point_id", "channel", "intensity"), [F.desc("intensity"), F.col("point_id")], "place")


@query("signal", "SELECT channel, mz, sample_id, intensity, point_id FROM (SELECT *, row_number() OVER (PARTITION BY channel, mz ORDER BY intensity DESC, sample_id, point_id) AS r FROM signal) WHERE r = 1")
def representative_peaks(points):
    """The best peak of each group."""
    one = points.groupBy("channel", "mz", "sample_id", "intensity").agg(F.min("point_id").alias("point_id"))
    return relations.best_peak(one, ["channel", "mz"]).select("channel", "mz", "sample_id", "intensity", "point_id")


@query("signal", "SELECT channel, group_id, sample_id, round(sum(intensity), 6) AS area, max(intensity) AS intensity FROM signal, (SELECT CAST(unnest(range(4)) AS BIGINT) AS group_id) WHERE rt BETWEEN group_id * 10000 AND group_id * 10000 + 9000 AND sample_id IN (1, 2, 3) AND NOT (sample_id = 2 AND group_id = 1) GROUP BY 1, 2, 3")
def missing_peaks(points):
    """What samples without a peak have in a group's range."""
    groups = points.select("channel").distinct().withColumn("group_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumns({"rtmin": F.col("group_id") * 10000.0, "rtmax": F.col("group_id") * 10000.0 + 9000})
    have = groups.filter("group_id = 1").select("channel", "group_id", F.lit(2).cast("long").alias("sample_id"))
    samples = points.filter("sample_id IN (1, 2, 3)").select("sample_id").distinct()
    found = relations.missing_peaks(groups, samples, have, points, ["channel"])
    return found.select("channel", "group_id", F.col("sample_id").cast("long").alias("sample_id"), _r("area").alias("area"), "intensity")


@query("spectra", "SELECT spectrum_id, 3 * len(intensity) AS doubled, 100.0::DOUBLE - 1.00727646688 AS first_mz, len(intensity) - 2 AS kept, true AS permuted, 0.0::DOUBLE AS unknown FROM spectra")
def spectrum_helpers(rows):
    """Proton shifts, places left out, a seeded shuffle, a score no one computes."""
    s = F.col("s")
    mixed = relations.shuffled(S.intensities(s), 3)
    held = with_peaks(rows)
    wide = relations.with_proton_shifts(s)
    return held.select("spectrum_id", F.size(wide).cast("long").alias("doubled"), F.get(wide, F.lit(0))["mz"].alias("first_mz"), F.size(relations.without_places(s, [0, 5])).cast("long").alias("kept"), (F.array_sort(mixed) == F.array_sort(S.intensities(s))).alias("permuted"), relations.score_named(s, "SpectralEntropy").alias("unknown"))


@query("library", "SELECT compound_id, CASE WHEN compound_id % 3 = 0 THEN 500.0 WHEN compound_id % 3 = 1 THEN precursor_mz ELSE 1.0 END::DOUBLE AS mz, CASE WHEN compound_id % 2 = 0 THEN 'kegg_id' END AS key FROM library")
def quant_precursors(rows):
    """The m/z to quantify, by rank of its sources; keys of identifiers."""
    c = F.col("compound_id")
    mz = relations.quant_precursor(F.when(c % 3 == 0, 500.0), F.when(c % 3 == 1, F.col("precursor_mz")).otherwise(0.0), F.lit(1.0))
    return rows.select("compound_id", mz.alias("mz"), relations.identifier_key(F.when(c % 2 == 0, "KEGG").otherwise("other")).alias("key"))


@query("library")
def smiles_formulas(rows):
    """Formulas and fragments of chain acids written as SMILES."""
    n = F.col("expected_rt").cast("int")
    text = F.concat(F.repeat(F.lit("C"), n), F.lit("C(=O)O"))
    held = rows.select(text.alias("smiles")).distinct()
    return held.select("smiles", smiles.formula_of(F.col("smiles")).alias("f"), F.size(smiles.fragments_of(F.col("smiles"), 1)).alias("fragments")).select("smiles", "f.formula", _r("f.mass").alias("mass"), "f.rings", "fragments")


@query("signal", """SELECT sample_id, scan_id, CAST(count(*) AS BIGINT) AS points FROM (SELECT *, dense_rank() OVER (PARTITION BY sample_id ORDER BY hour) - 1 AS scan_id, quantile FROM (SELECT sample_id, scan_id AS hour, intensity, max(CASE WHEN r = least(CAST(floor(n * 0.25) AS INT), n - 1) THEN intensity END) OVER (PARTITION BY sample_id, scan_id) AS quantile FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, scan_id ORDER BY intensity) - 1 AS r, count(*) OVER (PARTITION BY sample_id, scan_id) AS n FROM signal))) WHERE intensity > quantile AND intensity > 5 GROUP BY 1, 2""")
def loaded_scans(points):
    """Scans with load-time filters: quantile, least intensity, numbers."""
    scans = points.groupBy(F.col("sample_id").alias("sample"), "scan_id").agg(F.collect_list("mz").alias("mz"), F.collect_list("intensity").alias("intensity"))
    held = relations.load_filters(scans.withColumns({"mslevel": F.lit(1), "polarity": F.lit(1)}), 1, 1, 25.0, 5.0)
    return held.select(F.col("sample").alias("sample_id"), F.col("scan_id").cast("long").alias("scan_id"), F.size("intensity").cast("long").alias("points")).filter("points > 0")


@query("signal", "SELECT channel, CAST(floor(mz / 10) AS BIGINT) AS group_id, round(sum(b), 6) AS whole, round(max(CASE WHEN r = 1 THEN b END), 6) AS apex FROM (SELECT channel, mz, intensity / 2 AS b, row_number() OVER (PARTITION BY channel, CAST(floor(mz / 10) AS BIGINT) ORDER BY intensity DESC, rt) AS r FROM signal) GROUP BY 1, 2")
def baseline_summaries(points):
    """The baseline over a group's range and at its apex."""
    held = points.withColumns({"group_id": F.floor(F.col("mz") / 10), "baseline": F.col("intensity") / 2})
    top = chrom.extracted_top(held, ["channel", "group_id"]).select("channel", "group_id", "rt")
    ranges = held.groupBy("channel", "group_id").agg(F.min("rt").alias("rtmin"), F.max("rt").alias("rtmax")).join(top, ["channel", "group_id"])
    keyed = held.withColumn("channel", F.concat_ws("/", "channel", "group_id")).select("channel", "rt", "baseline")
    out = targeted.baseline_summary(keyed, ranges.withColumn("channel", F.concat_ws("/", "channel", "group_id")), ["channel"])
    return out.select(F.substring_index("channel", "/", 1).alias("channel"), "group_id", _r("whole").alias("whole"), _r("apex").alias("apex"))


@query("signal", "SELECT channel, isotopes, CAST(len(s) AS INT) AS samples FROM (SELECT channel, s, array_to_string(list_sort(list(mz)), ',') AS isotopes FROM (SELECT channel, CAST(mz AS INT) % 4 AS mz, list_sort(list(DISTINCT sample_id % 2)) AS s FROM signal GROUP BY 1, 2) GROUP BY 1, 2)")
def equal_isotopes(points):
    """Isotopes with the same profile over samples as one."""
    held = points.select(F.col("channel").alias("group_id"), (F.col("mz").cast("int") % 4).cast("string").alias("isotope"), (F.col("sample_id") % 2).alias("sample_id"), F.lit(1.0).alias("intensity")).distinct()
    return infusion.combine_equal(held).select(F.col("group_id").alias("channel"), F.array_join("isotopes", ",").alias("isotopes"), "samples")


@query("signal")
def transitive_groups(points):
    """Points of one scan and of neighbouring m/z joined into classes."""
    held = points.filter("intensity > 5").select("sample_id", "scan_id", "mz", "point_id")
    a, b = held.alias("a"), held.alias("b")
    pairs = a.join(b, (F.col("a.sample_id") == F.col("b.sample_id")) & (F.col("a.scan_id") == F.col("b.scan_id")) & (F.col("a.point_id") < F.col("b.point_id"))).select(F.col("a.point_id").alias("a"), F.col("b.point_id").alias("b"))
    return grouping.transitive_sets(pairs)
