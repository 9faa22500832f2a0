"""Direct infusion: search sets, fragment evidence, parsimony and summaries, partition fractions, scan-paired quantities, MS3.

Matches are rows compound, adduct, fragment (a place or m/z of a fragment) and what else is named. Every step is a grouped
aggregation or an equi-join; a null key matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionquarry.functions import text
from ionquarry.operators.block_search import first_window


def search_set(compounds: DataFrame, adducts: DataFrame, windows: DataFrame, matching_adduct: bool = False) -> DataFrame:
    """Ions (compound_id, adduct, mz, window_id): compounds (exact_mass, charge) by adducts of the same sign of charge.

    ``windows`` (window_id, low, high) are isolation windows; an ion goes to the one with the lowest id that holds it, or to
    -1. Adducts are a table of 10,000 rows at most.
    """
    listed = adducts.limit(10_001).collect()
    if len(listed) > 10_000:
        raise ValueError("adducts are a table of at most 10,000 rows")
    ions = F.array(*[F.struct(F.lit(a["name"]).alias("adduct"), F.lit(int(a["molecules"])).alias("molecules"), F.lit(int(a["charge"])).alias("z"), F.lit(float(a["added"])).alias("added")) for a in listed])
    both = compounds.withColumn("_a", F.explode(ions)).filter(F.signum("charge") == F.signum("_a.z"))
    if matching_adduct:
        both = both.filter(F.col("adduct_name").isNull() | (F.col("adduct_name") == F.col("_a.adduct")))
    mz = (F.col("exact_mass") * F.col("_a.molecules") + F.col("_a.added")) / F.abs("_a.z")
    held = both.select("compound_id", "_a.adduct", mz.alias("mz"))
    return first_window(held, windows, "window_id", inclusive=True, name="window_id").withColumn("window_id", F.col("window_id").cast("int"))


def unique_evidence(matches: DataFrame) -> DataFrame:
    """``matches`` with compounds, the number of compounds of each fragment, and is_unique."""
    counted = matches.groupBy("fragment").agg(F.count_distinct("compound").alias("compounds"))
    return matches.join(counted, "fragment").withColumn("is_unique", F.col("compounds") == 1)


def with_unique_matches(matches: DataFrame, least: int) -> DataFrame:
    """Matches of compounds that have ``least`` unique fragments or more."""
    own = unique_evidence(matches)
    enough = own.groupBy("compound").agg(F.sum(F.col("is_unique").cast("int")).alias("_n")).filter(F.col("_n") >= least)
    return own.join(enough.select("compound"), "compound", "left_semi").select(*matches.columns)


def fragment_sets(matches: DataFrame) -> DataFrame:
    """(fragments, members): compounds of identical fragment sets, both sorted."""
    sets = matches.groupBy("compound").agg(F.array_sort(F.collect_set("fragment")).alias("fragments"))
    return sets.groupBy("fragments").agg(F.array_sort(F.collect_list("compound")).alias("members"))


def parsimonious(matches: DataFrame) -> DataFrame:
    """Compounds whose fragments are not all held by strictly larger sets.

    A compound goes if each of its fragments also stands in a compound of more fragments: then the union of its
    intersections with those covers it. So one count for each fragment, its largest holder, decides; no pairs are made.
    """
    sizes = matches.select("compound", "fragment").distinct().withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("compound")))
    largest = sizes.groupBy("fragment").agg(F.max("size").alias("_largest"))
    judged = sizes.join(largest, "fragment").groupBy("compound").agg(F.max((F.col("_largest") <= F.col("size")).cast("int")).alias("_own"))
    return judged.filter("_own = 1").select("compound")


def summarised(matches: DataFrame, compounds: DataFrame) -> DataFrame:
    """One row for each identical fragment set: name, type, members, precursor_mz, charge.

    ``compounds``: compound, adduct, acyl_summary, composition_summary, precursor_mz, charge. A single member keeps its name.
    Several are named by their one acyl-chain summary, else their one composition, else all their names; means of precursor
    and integer means of charge.
    """
    sets = matches.groupBy("compound").agg(F.array_sort(F.collect_set("fragment")).alias("_fragments"))
    held = sets.join(compounds, "compound")
    one = lambda c: F.when((F.count_distinct(c) == 1) & (F.count(c) == F.count(F.lit(1))), F.min(c))
    grouped = held.groupBy("_fragments").agg(
        F.array_sort(F.collect_set("compound")).alias("members"), one("acyl_summary").alias("_acyl"), one("composition_summary").alias("_composition"),
        F.array_sort(F.collect_set(F.concat("compound", F.lit("|"), "adduct"))).alias("_ids"), F.avg("precursor_mz").alias("precursor_mz"), F.avg("charge").cast("int").alias("charge"),
    )
    single = F.size("members") == 1
    name = F.when(single, F.get("members", F.lit(0))).otherwise(F.coalesce("_acyl", "_composition", F.concat(F.lit("{"), F.array_join("_ids", ";"), F.lit("}"))))
    kind = F.when(single, "COMPOUND").when(F.col("_acyl").isNotNull(), "ACYL_CHAIN").when(F.col("_composition").isNotNull(), "SUM_COMPOSITION").otherwise("IDENTICAL_FRAGMENTS")
    return grouped.select(name.alias("name"), kind.alias("type"), "members", "precursor_mz", "charge")


def partition_fractions(matches: DataFrame, tag: str, least: float = 0.0, adjusted: bool = True) -> DataFrame:
    """(ms1_id, compound, fraction): the share of each compound in the intensity of the fragments its MS1 id has.

    ``matches``: ms1_id, ms1_intensity, compound, fragment, label, intensity. Fragments of a label of kind ``tag`` and an
    intensity of ``least`` count. One that several compounds hold counts by the share of its MS1 id's intensity among those
    involved, over the number of that id's compounds with it (``adjusted``), else whole. Where a total is 0, compounds share evenly.
    """
    w = Window.partitionBy
    every = matches.select("ms1_id", "compound").distinct().withColumn("_compounds", F.count(F.lit(1)).over(w("ms1_id")))
    used = matches.filter(text.has_tag(F.col("label"), tag) & (F.col("intensity") >= least)).select("ms1_id", "ms1_intensity", "compound", "fragment", "intensity").distinct()
    ids = used.groupBy("fragment", "ms1_id").agg(F.max("ms1_intensity").alias("_own"), F.count_distinct("compound").alias("_holders"))
    shares = ids.withColumns({"_all": F.sum("_own").over(w("fragment")), "_n": F.sum("_holders").over(w("fragment"))})
    factor = F.when((F.col("_n") <= 1) | F.lit(not adjusted), 1.0).when(F.col("_all") > 0, F.col("_own") / F.col("_all") / F.col("_holders")).otherwise(0.0)
    weighed = used.join(shares.select("fragment", "ms1_id", factor.alias("_factor")), ["fragment", "ms1_id"])
    per = weighed.groupBy("ms1_id", "compound").agg(F.sum(F.col("intensity") * F.col("_factor")).alias("_sum"))
    held = every.join(per, ["ms1_id", "compound"], "left").withColumn("_total", F.coalesce(F.sum("_sum").over(w("ms1_id")), F.lit(0.0)))
    return held.select("ms1_id", "compound", F.when(F.col("_total") > 0, F.coalesce("_sum", F.lit(0.0)) / F.col("_total")).otherwise(1 / F.col("_compounds")).alias("fraction"))


def apply_fractions(quant: DataFrame, fractions: DataFrame) -> DataFrame:
    """``quant`` (ms1_id, compound, intensity, ...) with fraction and partitioned intensity; without a fraction all of it."""
    share = F.coalesce("fraction", F.lit(1.0))
    return quant.join(fractions, ["ms1_id", "compound"], "left").withColumns({"fraction": share, "partitioned": F.col("intensity") * share})


def scan_fractions(scans: DataFrame, how: str = "mean") -> DataFrame:
    """(ms1_id, compound, fraction): mean or median of the scans' fractions, over scans of a total above 0. ``scans``: scan_id, intensity."""
    f = {"mean": F.avg, "median": F.median}[how]
    total = F.sum("intensity").over(Window.partitionBy("ms1_id", "scan_id"))
    return scans.withColumn("_t", total).filter("_t > 0").groupBy("ms1_id", "compound").agg(f(F.col("intensity") / F.col("_t")).alias("fraction"))


def fragment_ms1(matches: DataFrame) -> DataFrame:
    """(fragment, ms1_sum): the sum of the distinct MS1 intensities of a fragment's compounds."""
    return matches.select("fragment", "precursor_mz", "ms1_intensity").distinct().groupBy("fragment").agg(F.sum("ms1_intensity").alias("ms1_sum"))


def average_proportions(samples: DataFrame) -> DataFrame:
    """(compound, adduct, proportion, samples, best_sample): each sample's share of its total, over the samples that have it.

    ``samples``: sample_id, compound, adduct, intensity, score; the best sample has the largest score, then the smallest id.
    """
    share = F.col("intensity") / F.sum("intensity").over(Window.partitionBy("sample_id"))
    held = samples.withColumn("_p", share)
    out = held.groupBy("compound", "adduct").agg(F.avg("_p").alias("proportion"), F.count(F.lit(1)).alias("samples"), F.max(F.struct("score", (-F.col("sample_id")).alias("neg"))).alias("_b"))
    return out.select("compound", "adduct", "proportion", "samples", (-F.col("_b.neg")).alias("best_sample"))


def paired_scans(scans: DataFrame, most: int) -> DataFrame:
    """(width, query_scan, standard_scan, distance): query scans with an adjacent standard scan of the same width, each scan used once.

    ``scans``: width, scan_id, is_standard. Neighbours in order of scan are candidates, the closer one (of equal ones the
    earlier) for a query; pairs are taken from the closest on, at most ``most`` apart.
    """
    w = Window.partitionBy("width").orderBy("scan_id")
    side = lambda f: F.when(f("is_standard").over(w), f("scan_id").over(w))
    held = scans.withColumns({"_l": side(F.lag), "_n": side(F.lead)}).filter("NOT is_standard")
    left, right = F.col("scan_id") - F.col("_l"), F.col("_n") - F.col("scan_id")
    nearer = F.when(F.col("_l").isNotNull() & (F.col("_n").isNull() | (left <= right)), F.col("_l")).otherwise(F.col("_n"))
    pairs = held.withColumn("standard_scan", nearer).filter("standard_scan IS NOT NULL").select("width", F.col("scan_id").alias("query_scan"), "standard_scan", F.abs(F.col("scan_id") - F.col("standard_scan")).alias("distance"))
    # a standard has two neighbours at most, so its closest query, of equal ones the earlier, is all that can claim it first
    first = F.row_number().over(Window.partitionBy("width", "standard_scan").orderBy("distance", "query_scan"))
    return pairs.withColumn("_r", first).filter((F.col("_r") == 1) & (F.col("distance") <= most)).drop("_r")


def normalised_quant(pairs: DataFrame) -> DataFrame:
    """(compound, normalised, deviation, scans): median ratio of query to standard over paired scans, and its median absolute deviation.

    ``pairs``: compound, width, distance, query, standard; the smallest distance, then the narrowest width of a compound counts.
    """
    rank = F.dense_rank().over(Window.partitionBy("compound").orderBy("distance", "width"))
    held = pairs.filter("standard > 0 AND query > 0").withColumn("_r", rank).filter("_r = 1").withColumn("_x", F.col("query") / F.col("standard"))
    medians = held.groupBy("compound").agg(F.median("_x").alias("normalised"), F.count(F.lit(1)).alias("scans"))
    off = held.join(medians, "compound").groupBy("compound").agg(F.median(F.abs(F.col("_x") - F.col("normalised"))).alias("deviation"))
    return medians.join(off, "compound")


def narrowest_scans(scans: DataFrame, keys: list[str], how: str = "median") -> DataFrame:
    """(keys, intensity, scans): mean or median over the scans of the narrowest m/z window that has any. ``scans``: width, intensity."""
    f = {"mean": F.avg, "median": F.median}[how]
    ranked = scans.filter("intensity > 0").withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy("width")))
    return ranked.filter("_r = 1").groupBy(*keys).agg(f("intensity").alias("intensity"), F.count(F.lit(1)).alias("scans"))


def best_windows(queries: DataFrame, windows: DataFrame) -> DataFrame:
    """Of the windows (window_id, low, high) that hold each query (query_id, mz), the narrowest, then the most central.

    Windows are put into all bins of 10 Da that they reach: an equi-join.
    """
    listed = windows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("low") / 10), F.floor(F.col("high") / 10))))
    found = queries.withColumn("_bin", F.floor(F.col("mz") / 10)).join(listed, "_bin").filter("mz BETWEEN low AND high")
    order = Window.partitionBy("query_id").orderBy(F.col("high") - F.col("low"), F.abs((F.col("high") + F.col("low")) / 2 - F.col("mz")), "window_id")
    return found.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r", "_bin")


def required_tags(found: Column, required: Column) -> Column:
    """Whether a map of tag counts holds at least the required count of each tag."""
    return F.forall(F.map_entries(required), lambda e: F.coalesce(F.try_element_at(found, e["key"]), F.lit(0)) >= e["value"])


def tag_counts(label: Column) -> Column:
    """Map of the kinds of tags of an array of matched labels to their number."""
    kinds = F.flatten(F.transform(label, text.label_tags))
    return F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))


def ms3_groups(scans: DataFrame, ppm: float) -> DataFrame:
    """MS3 ``scans`` (scan_id, ms1_mz, ms2_mz) with group_id of equal precursors: islands of ms1, and of ms2 within them."""

    def islands(df: DataFrame, by: list[str], col: str, name: str) -> DataFrame:
        w = Window.partitionBy(*by, F.floor(F.log(col) / 0.01)).orderBy(col, "scan_id")
        fresh = (F.col(col) - F.lag(col).over(w) > F.col(col) * ppm / 1e6).cast("int")
        own = F.sum(F.coalesce(fresh, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return df.withColumn(name, F.concat_ws("-", F.floor(F.log(col) / 0.01), own))

    one = islands(scans, [], "ms1_mz", "_one")
    return islands(one, ["_one"], "ms2_mz", "_two").withColumn("group_id", F.concat_ws("/", "_one", "_two")).drop("_one", "_two")


def ms3_matches(library: DataFrame, peaks: DataFrame, ppm1: float, ppm2: float, da3: float, how: str = "max") -> DataFrame:
    """(compound, scan_id, fragment, intensity): library fragments (compound, ms1_mz, ms2_mz, fragment) in MS3 peaks (scan_id, ms1_mz, ms2_mz, mz).

    Precursors agree within ``ppm1`` and ``ppm2`` of the library's, m/z within ``da3``; of several peaks the most intense
    (max), the closest, or the sum (all). Bins of m/z make it an equi-join.
    """
    own = peaks.withColumn("_bin", F.floor(F.col("mz") / da3))
    home = F.floor(F.col("fragment") / da3)
    spread = library.withColumnsRenamed({"ms1_mz": "l1", "ms2_mz": "l2"}).withColumn("_bin", F.explode(F.array(home - 1, home, home + 1)))
    near = own.join(spread, "_bin").filter((F.abs(F.col("mz") - F.col("fragment")) <= da3) & (F.abs(F.col("ms1_mz") - F.col("l1")) <= F.col("l1") * ppm1 / 1e6) & (F.abs(F.col("ms2_mz") - F.col("l2")) <= F.col("l2") * ppm2 / 1e6))
    single = {"max": F.max("intensity"), "all": F.sum("intensity"), "closest": F.min_by("intensity", F.struct(F.abs(F.col("mz") - F.col("fragment")), -F.col("intensity")))}[how]
    return near.groupBy("compound", "scan_id", "fragment").agg(single.alias("intensity"))


def ms3_summary(matches: DataFrame, scans: DataFrame, least_scans: int, least_fraction: float, how: str = "median") -> DataFrame:
    """(compound, fragments, intensity): the fragments that enough of a group's scans hold, and the sum of their mean or median intensity."""
    f = {"mean": F.avg, "median": F.median}[how]
    total = scans.agg(F.count_distinct("scan_id")).scalar()  # one number, as a subquery
    per = matches.groupBy("compound", "fragment").agg(F.count_distinct("scan_id").alias("_n"), f("intensity").alias("_i"))
    kept = per.filter((F.col("_n") >= least_scans) & (F.col("_n") >= least_fraction * total))
    return kept.groupBy("compound").agg(F.count(F.lit(1)).alias("fragments"), F.sum("_i").alias("intensity"))


def combine_equal(peaks: DataFrame) -> DataFrame:
    """Isotopes of a group whose peaks are the same in every sample, as one: (group_id, isotopes, samples, total).

    ``peaks``: group_id, isotope, sample_id, intensity.
    """
    profile = peaks.groupBy("group_id", "isotope").agg(F.array_sort(F.collect_list(F.struct("sample_id", "intensity"))).alias("_p"))
    return profile.groupBy("group_id", "_p").agg(F.array_sort(F.collect_list("isotope")).alias("isotopes")).select("group_id", "isotopes", F.size("_p").alias("samples"), F.aggregate("_p", F.lit(0.0), lambda s, x: s + x["intensity"]).alias("total"))


def best_matches(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One candidate for each key: the largest hypergeometric score, then dot product, then the first name."""
    order = Window.partitionBy(*keys).orderBy(F.desc("hypergeometric"), F.desc("dot_product"), "name")
    return candidates.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def summed_compound(children: DataFrame) -> DataFrame:
    """One summary spectrum (parent, mz, intensity, labels) of children's fragments (parent, child, mz, intensity, label) that all have.

    m/z agree to six decimals; intensity is the mean, labels are sorted and joined by slashes.
    """
    number = children.groupBy("parent").agg(F.count_distinct("child").alias("_n"))
    key = F.round(F.col("mz") * 1e6).cast("long")
    per = children.groupBy("parent", key.alias("_key")).agg(F.avg("mz").alias("mz"), F.avg("intensity").alias("intensity"), F.count_distinct("child").alias("_c"), F.array_join(F.array_sort(F.collect_set("label")), "/").alias("labels"))
    return per.join(number, "parent").filter("_c = _n").select("parent", "mz", "intensity", "labels")
