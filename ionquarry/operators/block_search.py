"""Direct-infusion search: library entries against the spectra of isolation blocks, by an inverted index of fragments.

A block is an isolation window, numbered by its rounded precursor m/z. Library ions go to the first block that holds them;
a block's fragments meet the peaks of its spectra in chunks of m/z, and only ions that enough of them lead to are matched
one to one. Ions alike but for their names are searched once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionquarry.functions import text
from ionquarry.functions.maths import C13_STEP
from ionquarry.operators import matching
from ionquarry.operators.written import written

#: The block of ions that no isolation window holds, the width of the index's bins (Da), and the highest m/z that windows reach.
NO_BLOCK, BIN, HIGHEST = -1, 0.05, 100_000
_KEYS = ["sample", "block", "compound_id", "adduct"]
#: For tables with rows of a library: its file's size says little of how many there are, so that they would be broadcast through the driver.
_SHUFFLED = "shuffle_merge"


def block_of(precursor_mz: Column) -> Column:
    """Number of the block of an MS2 scan."""
    return F.round(precursor_mz + 0.001).cast("long")


def isolation_blocks(scans: DataFrame) -> DataFrame:
    """(block, low, high) of MS2 ``scans`` (sample, scan_id, precursor_mz, low, high): the window of each block's first scan."""
    held = scans.filter("precursor_mz IS NOT NULL").withColumn("block", block_of(F.col("precursor_mz")))
    first = held.groupBy("block").agg(F.min(F.struct("sample", "scan_id", "low", "high")).alias("_s"))
    return first.select("block", F.col("_s.low").alias("low"), F.col("_s.high").alias("high"))


def first_window(ions: DataFrame, windows: DataFrame, number: str, inclusive: bool = False, name: str = "block") -> DataFrame:
    """``ions`` (mz, ...) with the lowest ``number`` of the windows (number, low, high) that hold their m/z, else -1.

    Windows are listed under each whole m/z they reach, so that an ion looks at those of its own alone: an equi-join, however
    many windows there are.
    """
    reach = F.sequence(F.floor(F.greatest("low", F.lit(0.0))), F.floor(F.least("high", F.lit(float(HIGHEST)))))
    usable = windows.filter("low <= high AND high >= 0 AND low <= " + str(HIGHEST))
    listed = usable.withColumn("_at", F.explode(reach)).groupBy("_at").agg(F.array_sort(F.collect_list(F.struct(F.col(number).cast("long").alias("number"), "low", "high"))).alias("_windows"))
    mz = F.col("mz")
    inside = (lambda w: (mz >= w["low"]) & (mz <= w["high"])) if inclusive else (lambda w: (mz > w["low"]) & (mz < w["high"]))
    found = ions.withColumn("_at", F.floor("mz")).join(listed, "_at", "left")
    return found.withColumn(name, F.coalesce(F.get(F.filter("_windows", inside), F.lit(0))["number"], F.lit(NO_BLOCK))).drop("_at", "_windows")


def fragment_index(entries: DataFrame, ppm: float, least: int, bin_width: float = BIN) -> DataFrame:
    """Postings (block, bin, compound_id, adduct) of ``entries`` (block, compound_id, adduct, precursor_mz, fragments).

    An entry of f fragments that ``least`` of have to match is listed under f - least + 1 of them: one of those always
    matches. They are its rarest in the block, so that a fragment that a whole class shares makes no long postings.
    A fragment stands under each bin that its tolerance, ``ppm`` of the entry's precursor, reaches.
    """
    each = entries.filter(F.size("fragments") >= least).select("block", "compound_id", "adduct", "precursor_mz", F.posexplode(F.transform("fragments", lambda f: f["mz"])).alias("place", "mz"), F.size("fragments").alias("_f"))
    home = each.withColumn("_home", F.floor(F.col("mz") / bin_width))
    counts = home.groupBy("block", "_home").agg(F.count(F.lit(1)).alias("_n"))
    rare = Window.partitionBy("block", "compound_id", "adduct").orderBy("_n", "place")
    kept = home.join(counts, ["block", "_home"]).withColumn("_r", F.row_number().over(rare)).filter(F.col("_r") <= F.col("_f") - least + 1)
    tolerance = F.col("precursor_mz") * ppm / 1e6
    bins = F.sequence(F.floor((F.col("mz") - tolerance) / bin_width), F.floor((F.col("mz") + tolerance) / bin_width))
    return kept.select("block", "compound_id", "adduct", F.explode(bins).alias("bin")).distinct()


def _peak_rows(spectra: DataFrame) -> DataFrame:
    """(sample, block, mz, intensity), of spectra given as such rows or as arrays."""
    if "spectrum" not in spectra.columns:
        return spectra.select("sample", "block", "mz", "intensity")
    return spectra.select("sample", "block", F.explode("spectrum").alias("_p")).select("sample", "block", "_p.mz", "_p.intensity")


def _classed(entries: DataFrame, least: int) -> DataFrame:
    """Entries of ``least`` fragments or more, each once, fragments by m/z, with the class of those that are alike but for their names."""
    held = entries.filter(F.size("fragments") >= least).dropDuplicates(["block", "compound_id", "adduct"]).withColumn("fragments", F.array_sort("fragments"))
    return held.withColumn("_class", F.sha2(F.to_json(F.struct("block", "precursor_mz", "fragments")), 256))


def nearest(peaks: DataFrame, asked: DataFrame, ppm: float, single: bool = False) -> DataFrame:
    """(sample, block, _class, place, mz, intensity, copies): of each fragment of ``asked`` (classes) its closest peaks within the tolerance.

    One peak if ``single``, else as many as the class has fragments: one-to-one matching can take no more away from a fragment
    than the others have. Distances count to six decimals, of equal ones the first in order of m/z and intensity, as in matching.
    Peaks and fragments meet in chunks of m/z some 8 to 16 tolerances wide, so a task holds a chunk of a spectrum, never the whole.
    """
    level = F.ceil(F.log2(F.greatest(F.col("precursor_mz") * ppm / 1e6, F.lit(1e-6)))).cast("int")
    width = F.pow(F.lit(2.0), F.col("_level") + 3)
    chunk = lambda mz: F.floor(mz / width).cast("long")
    each = asked.filter("precursor_mz > 0").select("block", "_class", (F.col("precursor_mz") * ppm / 1e6).alias("_t"), level.alias("_level"), F.size("fragments").alias("_f"), F.posexplode(F.transform("fragments", lambda f: f["mz"])).alias("place", "_mz"))
    placed = each.filter("_mz IS NOT NULL").withColumn("_chunk", chunk(F.col("_mz")))
    reach = F.pow(F.lit(2.0), F.col("_level")) * 1.001
    wanted = placed.select("block", "_level", "_chunk").distinct()
    spread = peaks.filter("mz IS NOT NULL").join(F.broadcast(placed.select("block", "_level").distinct()), "block").withColumn("_chunk", F.explode(F.sequence(chunk(F.col("mz") - reach), chunk(F.col("mz") + reach))))
    keys = ["sample", "block", "_level", "_chunk"]
    held = written(spread.join(wanted, ["block", "_level", "_chunk"], "left_semi").groupBy(*keys, "mz", "intensity").agg(F.count(F.lit(1)).alias("_n")))
    own = placed.hint(_SHUFFLED).join(held.select(*[F.col(c).alias(c) for c in keys]).distinct(), ["block", "_level", "_chunk"])
    kinds = {c: peaks.schema[c].dataType.simpleString() for c in ("sample", "block")}

    def run(key: tuple, fragments: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        near = near.sort_values(["mz", "intensity"], kind="stable")
        m, y, n = (near[c].to_numpy() for c in ("mz", "intensity", "_n"))
        who, at, copies = [], [], []
        rows = zip(*(fragments[c].tolist() for c in ("_mz", "_t", "_f")), strict=True)
        for k, (x, t, f) in enumerate(rows):
            most = 1 if single else f
            mid = int(np.searchsorted(m, x))
            low, high = np.searchsorted(m, [m[max(mid - most, 0)] - 2e-6, m[min(mid + most, len(m)) - 1] + 2e-6]) if len(m) else (0, 0)
            found = sorted((round(abs(float(m[j] - x)), 6), j) for j in range(int(low), int(high)) if abs(m[j] - x) <= t)[:most]
            who += [k] * len(found)
            at += [j for _, j in found]
            copies += [min(int(n[j]), f) for _, j in found]
        out = fragments.iloc[who][["_class", "place"]].reset_index(drop=True)
        return out.assign(sample=key[0], block=key[1], mz=m[at], intensity=y[at], copies=copies)[["sample", "block", "_class", "place", "mz", "intensity", "copies"]]

    schema = f"sample {kinds['sample']}, block {kinds['block']}, _class string, place int, mz double, intensity double, copies long"
    return own.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(run, schema)


def candidates(spectra: DataFrame, entries: DataFrame, ppm: float, least: int = 1, least_intensity: float = 0.0) -> DataFrame:
    """(sample, block, compound_id, adduct, hits): entries of which ``least`` fragments or more have a peak of the block's spectrum near.

    ``spectra``: sample, block and either a peak's mz, intensity or the spectrum as an array of them; peaks below ``least_intensity``
    don't count. ``hits`` bounds the one-to-one matches from above. Nulls and empty spectra match nothing; repeated entries are one.
    """
    asked = _classed(entries, max(least, 1))
    peaks = _peak_rows(spectra).filter(F.col("intensity") >= least_intensity)
    near = nearest(peaks, asked.select("block", "_class", "precursor_mz", "fragments").dropDuplicates(["_class"]), ppm, single=True)
    hits = near.groupBy("sample", "_class").agg(F.count_distinct("place").alias("hits")).filter(F.col("hits") >= least)
    return hits.join(asked, "_class").select(*_KEYS, "hits")


def assessed(spectra: DataFrame, entries: DataFrame, ppm: float, least: int = 1, least_intensity: float = 0.0, diagnostic: int = 0, sn1: int = 0, sn2: int = 0, precursor: bool = False) -> DataFrame:
    """Entries matched one to one: sample, block, compound_id, adduct, matches, diagnostic, sn1, sn2, has_precursor, max_intensity.

    ``fragments``: mz, intensity, label, whose tags say of which kind they are; ``spectra`` as in ``candidates``. Entries with fewer than ``least`` matches, or than asked of a
    kind, or without a matched fragment at the precursor where ``precursor`` asks for one, are left out. Entries alike but for
    their names are matched once, and against the peaks near their fragments, not the whole spectrum.
    """
    asked = _classed(entries, max(least, 1))
    classes = asked.select("block", "_class", "precursor_mz", "fragments").dropDuplicates(["_class"])
    near = nearest(_peak_rows(spectra), classes, ppm)
    few = near.groupBy("sample", "_class").agg(F.count_distinct("place").alias("_places"), F.array_sort(F.collect_set(F.struct("mz", "intensity", "copies"))).alias("_near")).filter(F.col("_places") >= least)
    spectrum = F.flatten(F.transform("_near", lambda p: F.array_repeat(F.struct(p["mz"].alias("mz"), p["intensity"].alias("intensity")), p["copies"].cast("int"))))
    plain = F.transform("fragments", lambda f: F.struct(f["mz"].alias("mz"), f["intensity"].alias("intensity")))
    held = few.select("sample", "_class", spectrum.alias("spectrum")).join(classes.hint(_SHUFFLED), "_class")
    ranked = held.withColumn("_t", F.col("precursor_mz") * ppm / 1e6).withColumn("_ranks", matching.matched(plain, F.col("spectrum"), F.col("_t")))
    at = lambda r: F.get("spectrum", r)["intensity"]
    pairs = F.filter(F.zip_with("fragments", "_ranks", lambda f, r: F.when((r >= 0) & (at(r) >= least_intensity), F.struct(f["mz"].alias("mz"), f["label"].alias("label"), at(r).alias("intensity")))), lambda x: x.isNotNull())
    scored = ranked.withColumn("_m", pairs)
    of = lambda kind: F.size(F.filter("_m", lambda m: F.coalesce(text.has_tag(m["label"], kind), F.lit(False)))).cast("long")
    out = scored.select("sample", "_class", F.size("_m").cast("long").alias("matches"), of("diagnostic").alias("diagnostic"), of("sn1").alias("sn1"), of("sn2").alias("sn2"), F.exists("_m", lambda m: F.abs(m["mz"] - F.col("precursor_mz")) < F.col("_t")).alias("has_precursor"), F.array_max(F.transform("_m", lambda m: m["intensity"])).alias("max_intensity"))
    enough = (F.col("matches") >= least) & (F.col("diagnostic") >= diagnostic) & (F.col("sn1") >= sn1) & (F.col("sn2") >= sn2)
    kept = out.filter(enough & F.col("has_precursor") if precursor else enough)
    return kept.join(asked.select("_class", "block", "compound_id", "adduct").hint(_SHUFFLED), "_class").select(*_KEYS, *out.columns[2:])


def with_ms1(matches: DataFrame, ions: DataFrame, ms1: DataFrame, ppm: float, most_before: float | None = None) -> DataFrame:
    """``matches`` with ms1_intensity: the highest peak of the sample's MS1 spectrum within ``ppm`` of the ion, else 0.

    ``ions``: compound_id, adduct, mz; ``ms1``: sample, mz, intensity. With ``most_before``, an ion whose peak has one a 13C
    step below of more than that share of it is no monoisotopic peak, and has 0.
    """
    asked = matches.join(ions.select("compound_id", "adduct", F.col("mz").alias("_ion")).hint(_SHUFFLED), ["compound_id", "adduct"])
    # ions of one m/z share their peaks: each m/z of a sample is looked up once
    steps = asked.select("sample", "_ion").distinct().withColumn("_step", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_at", F.col("_ion") - F.col("_step") * C13_STEP)
    reach = F.col("_ion") * ppm / 1e6
    listed = steps.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("_at") - reach) / BIN), F.floor((F.col("_at") + reach) / BIN))))
    peaks = ms1.select("sample", F.col("mz").alias("_mz"), F.col("intensity").alias("_y"), F.floor(F.col("mz") / BIN).alias("_bin"))
    near = listed.join(peaks, ["sample", "_bin"]).filter(F.abs(F.col("_mz") - F.col("_at")) <= reach)
    best = near.groupBy("sample", "_ion").agg(*[F.max(F.when(F.col("_step") == k, F.col("_y"))).alias(c) for k, c in ((0, "_own"), (1, "_before"))])
    value = F.coalesce("_own", F.lit(0.0))
    if most_before is not None:
        value = F.when(F.coalesce("_before", F.lit(0.0)) > most_before * value, 0.0).otherwise(value)
    found = asked.hint(_SHUFFLED).join(best, ["sample", "_ion"], "left").groupBy(*_KEYS).agg(F.max(value).alias("ms1_intensity"))
    return matches.join(found.hint(_SHUFFLED), _KEYS, "left").fillna({"ms1_intensity": 0.0})
