"""Library identification of peak groups: tolerance join, retention-time agreement, scores, best match; ion lists and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionquarry.operators import matching, ranges


def rt_agreement(rt: Column, expected: Column, low: Column, high: Column, tolerance: float, use_range: bool = False) -> Column:
    """none (no expected time), agrees, or differs: by the library's range if asked and both ends are above 0, else by the tolerance."""
    ranged = F.lit(use_range) & (F.coalesce(low, F.lit(0.0)) > 0) & (F.coalesce(high, F.lit(0.0)) > 0)
    inside = F.when(ranged, rt.between(low, high)).otherwise(F.abs(rt - expected) <= tolerance)
    known = ranged | (F.coalesce(expected, F.lit(0.0)) > 0)
    kind = F.when(ranged, "range").otherwise("time")
    return F.when(~known, F.lit("none")).otherwise(F.concat(F.when(inside, F.lit("agrees_")).otherwise(F.lit("differs_")), kind))


def with_thresholds(rows: DataFrame, thresholds: DataFrame, columns: list[str], defaults: dict[str, float]) -> DataFrame:
    """``rows`` with each threshold by (lipid_class, adduct), else by (lipid_class, *), else the default."""
    own = thresholds.filter("adduct <> '*'").select("lipid_class", "adduct", *[F.col(c).alias(f"_a_{c}") for c in columns])
    general = thresholds.filter("adduct = '*'").select("lipid_class", *[F.col(c).alias(f"_g_{c}") for c in columns])
    held = rows.join(own, ["lipid_class", "adduct"], "left").join(general, "lipid_class", "left")
    return held.withColumns({c: F.coalesce(f"_a_{c}", f"_g_{c}", F.lit(defaults[c])) for c in columns}).drop(*[f"_{k}_{c}" for c in columns for k in "ag"])


def candidates(groups: DataFrame, library: DataFrame, ppm: float, fragment_ppm: float) -> DataFrame:
    """Groups (group_id, mz, rt, spectrum) and compounds (compound_id, name, precursor_mz, library_spectrum) within ``ppm``, with all scores."""
    near = ranges.ppm_join(groups, library, "mz", "precursor_mz", ppm)
    scored = matching.scored(F.col("library_spectrum"), F.col("spectrum"), F.col("precursor_mz"), F.col("mz"), fragment_ppm)
    return near.withColumn("scores", scored)


def lipid_search(groups: DataFrame, library: DataFrame, ppm: float, fragment_ppm: float, least_score: float, allowed: list[tuple[str, str]] | None = None, tolerance: float = 0.5) -> DataFrame:
    """Candidates with lipid_class and adduct allowed and a hypergeometric score (without its intensity term) of ``least_score``.

    rank 1 is the best: score, then cosine, then name; label is l where rt agrees. All passing candidates stay.
    """
    found = candidates(groups, library, ppm, fragment_ppm)
    if allowed is not None:
        pair = F.struct("lipid_class", "adduct")
        found = found.filter(pair.isin([F.struct(F.lit(c), F.lit(a)) for c, a in allowed]))
    plain = F.col("scores.hypergeometric") - F.col("scores.tic_matched")
    held = found.withColumn("score", plain).filter(F.col("score") >= least_score)
    return _ranked(held, [F.desc("score"), F.desc("scores.cosine"), F.asc("name")], tolerance)


def metabolite_search(groups: DataFrame, library: DataFrame, ppm: float, fragment_ppm: float, least_cosine: float, least_matches: int, tolerance: float = 0.5) -> DataFrame:
    """Candidates with enough matches and a cosine of ``least_cosine``; rank 1 has the best cosine, then the first name."""
    held = candidates(groups, library, ppm, fragment_ppm).withColumn("score", F.col("scores.cosine")).filter((F.col("score") >= least_cosine) & (F.col("scores.matches") >= least_matches))
    return _ranked(held, [F.desc("score"), F.asc("name")], tolerance)


def best_of(groups: DataFrame, library: DataFrame, ppm: float, fragment_ppm: float, score: str, least_score: float, least_matches: int = 0, tolerance: float = 0.5) -> DataFrame:
    """The rows of rank 1 of ``lipid_search`` (``score`` plain, ordered by it, cosine, name) or ``metabolite_search`` (cosine, name): group columns, score, cosine, compound_id, name, label.

    Compounds of equal m/z and spectrum are a class, led by its first name, then compound_id; so are groups of equal m/z and
    spectrum. Pairs of classes are scored, by what decides alone; a class's best then goes to its groups.
    """
    first = F.min(F.struct("name", "compound_id", "expected_rt")).alias("lead")
    led = library.groupBy("precursor_mz", "library_spectrum").agg(first)
    held = groups.groupBy("mz", "spectrum").agg(F.min("group_id").alias("_class"))
    # few bytes make many pairs, which are scored where they meet
    number = max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups.sparkSession.sparkContext.defaultParallelism)
    near = ranges.ppm_join(held, led, "mz", "precursor_mz", ppm, number)
    light = matching.scored_light(F.col("library_spectrum"), F.col("spectrum"), F.col("precursor_mz"), F.col("mz"), fragment_ppm)
    scores = near.select("_class", "lead", light.alias("s")).select("_class", "lead", "s.matches", F.col("s.plain").alias("plain"), F.col("s.cosine").alias("cosine"))
    own = scores.withColumn("score", F.col(score)).filter((F.col("score") >= least_score) & (F.col("matches") >= least_matches))
    order = F.struct((-F.col("score")).alias("a"), (-F.col("cosine")).alias("b"), "lead")
    best = own.groupBy("_class").agg(F.min_by(F.struct("score", "cosine", "lead"), order).alias("_b"))
    members = groups.join(held, ["mz", "spectrum"]).join(best, "_class")
    agreement = rt_agreement(F.col("rt"), F.col("_b.lead.expected_rt"), F.lit(None).cast("double"), F.lit(None).cast("double"), tolerance)
    return members.select(*groups.columns, "_b.score", "_b.cosine", "_b.lead.compound_id", "_b.lead.name", F.when(agreement.startswith("agrees"), "l").otherwise("").alias("label"))


def _ranked(held: DataFrame, order: list[Column], tolerance: float) -> DataFrame:
    agreement = rt_agreement(F.col("rt"), F.col("expected_rt"), F.lit(None).cast("double"), F.lit(None).cast("double"), tolerance)
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(*order, "compound_id"))
    return held.withColumns({"rank": rank, "label": F.when(agreement.startswith("agrees"), "l").otherwise("")})


def peptide_ligand_ions(peptides: DataFrame, ligands: DataFrame, adducts: list[tuple[str, int, int, float]], most_c13: int) -> DataFrame:
    """(peptide, ligand, adduct, c13, mz): peptides (peptide, mass) with each ligand (ligand, mass) or none, 13C count and adduct.

    Ligands are a small table, checked to hold at most 10,000 rows.
    """
    listed = ligands.limit(10_001).collect()
    if len(listed) > 10_000:
        raise ValueError("ligands are a table of at most 10,000 rows")
    added = F.array(F.struct(F.lit("").alias("ligand"), F.lit(0.0).alias("mass")), *[F.struct(F.lit(x["ligand"]).alias("ligand"), F.lit(float(x["mass"])).alias("mass")) for x in listed])
    forms = F.array(*[F.struct(F.lit(n).alias("adduct"), F.lit(m).alias("molecules"), F.lit(z).alias("charge"), F.lit(a).alias("added")) for n, m, z, a in adducts])
    each = peptides.withColumn("_l", F.explode(added)).withColumn("c13", F.explode(F.sequence(F.lit(0), F.lit(most_c13)))).withColumn("_a", F.explode(forms))
    neutral = F.col("mass") + F.col("_l.mass") + F.col("c13") * 1.00335483521
    return each.select("peptide", "_l.ligand", "_a.adduct", "c13", ((neutral * F.col("_a.molecules") + F.col("_a.added")) / F.abs("_a.charge")).alias("mz"))


def collected_ms2(groups: DataFrame, scans: DataFrame, apex: float, most: int | None = None, least_purity: float = 0.0) -> DataFrame:
    """MS2 ``scans`` (scan_id, sample_id, precursor_mz, rt, purity, peaks) of each group (group_id, mzmin, mzmax, rtmin, rtmax, rt).

    In the group's ranges, and within ``apex`` of its rt; of a purity of ``least_purity``, at most the ``most`` best by purity times log10(peaks + 1).
    """
    listed = groups.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("mzmin") * 10), F.floor(F.col("mzmax") * 10)))).withColumnRenamed("rt", "group_rt")
    near = scans.withColumn("_bin", F.floor(F.col("precursor_mz") * 10)).join(listed, "_bin")
    inside = near.filter((F.col("precursor_mz").between(F.col("mzmin"), F.col("mzmax"))) & F.col("rt").between(F.col("rtmin"), F.col("rtmax")) & (F.abs(F.col("rt") - F.col("group_rt")) <= apex) & (F.col("purity") >= least_purity)).drop("_bin")
    ranked = inside.withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc(F.col("purity") * F.log10(F.col("peaks") + 1)), "scan_id")))
    return ranked if most is None else ranked.filter(F.col("rank") <= most)


def closest_ms2(collected: DataFrame) -> DataFrame:
    """Of the collected scans, the one closest to the group's rt of each sample."""
    order = Window.partitionBy("group_id", "sample_id").orderBy(F.abs(F.col("rt") - F.col("group_rt")), "scan_id")
    return collected.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def subtract_background(spectrum_points: DataFrame, background: DataFrame, ppm: float, zero: bool = False) -> DataFrame:
    """Points (scan_id, mz, intensity) less the largest background intensity (mz, intensity) within ``ppm``, 0 at least; or 0 where any is."""
    width = ppm * 1.5e-6
    home = F.floor(F.log("mz") / width)
    spread = background.select(F.col("mz").alias("_mz"), F.col("intensity").alias("_y"), F.explode(F.array(home - 1, home, home + 1)).alias("_bin"))
    own = spectrum_points.withColumns({"_bin": F.floor(F.log("mz") / width)})
    near = F.abs(F.col("_mz") - F.col("mz")) <= F.col("mz") * ppm / 1e6
    keys = spectrum_points.columns
    most = own.join(spread, "_bin", "left").groupBy(*keys).agg(F.max(F.when(near, F.col("_y"))).alias("_b"), F.count(F.lit(1)).alias("_n"))
    left = F.when(F.col("_b").isNotNull(), F.lit(0.0)).otherwise(F.col("intensity")) if zero else F.greatest(F.lit(0.0), F.col("intensity") - F.coalesce("_b", F.lit(0.0)))
    return most.withColumn("subtracted", left).drop("_b", "_n")


def isolation_purity(scans: DataFrame, width: float, ppm: float, look_back: int = 50) -> DataFrame:
    """(sample_id, scan_id, full_scan, purity) of each MS2 scan: the precursor's share of what the last full scan holds around it.

    ``scans``: sample_id, scan_id, mslevel, precursor_mz and spectrum, an array of (mz, intensity). The full scan is the last
    one among the ``look_back`` scans before; the region is ``width`` Da on either side, the precursor its highest peak
    within ``ppm``. Without a full scan there is no purity; an empty region or no precursor gives 0.
    """
    order = Window.partitionBy("sample_id").orderBy("scan_id").rowsBetween(-look_back, -1)
    last = F.last(F.when(F.col("mslevel") == 1, F.struct("scan_id", "spectrum")), ignorenulls=True).over(order)
    held = scans.withColumn("_full", last).filter("mslevel = 2")
    near = F.filter("_full.spectrum", lambda p: F.abs(p["mz"] - F.col("precursor_mz")) <= width)
    own = F.filter(near, lambda p: F.abs(p["mz"] - F.col("precursor_mz")) <= F.col("precursor_mz") * ppm / 1e6)
    total = F.aggregate(near, F.lit(0.0), lambda s, p: s + p["intensity"])
    share = F.when(total > 0, F.coalesce(F.array_max(F.transform(own, lambda p: p["intensity"])), F.lit(0.0)) / total).otherwise(0.0)
    return held.select("sample_id", "scan_id", F.col("_full.scan_id").alias("full_scan"), F.when(F.col("_full").isNotNull(), share).alias("purity"))


#: m/z of the ten TMT reporter ions
TMT = {"126": 126.127726, "127N": 127.124761, "127C": 127.131081, "128N": 128.128116, "128C": 128.134436, "129N": 129.131471, "129C": 129.13779, "130N": 130.134825, "130C": 130.141145, "131": 131.13818}


def reporter_ions(points: DataFrame, keys: list[str], ppm: float = 20.0) -> DataFrame:
    """(keys, one column for each TMT channel, noise): the largest intensity at each reporter, and the sum in 126 to 131.2 outside them."""
    near = {c: F.abs(F.col("mz") - m) <= m * ppm / 1e6 for c, m in TMT.items()}
    other = F.col("mz").between(126.0, 131.2)
    for test in near.values():
        other &= ~test
    return points.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(test, F.col("intensity"))), F.lit(0.0)).alias(f"tmt_{c}") for c, test in near.items()], F.coalesce(F.sum(F.when(other, F.col("intensity"))), F.lit(0.0)).alias("noise"))
