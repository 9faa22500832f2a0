"""Operators on one spectrum, an array of (mz, intensity) structs in order of m/z, as column expressions.

An empty spectrum gives an empty one, 0 or null, as each says; a null spectrum gives null. Ties go to the smaller position.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionquarry.functions.maths import C13_STEP, dot



def peaks(mz: Column, intensity: Column) -> Column:
    """A spectrum of two arrays of one length."""
    return F.zip_with(mz, intensity, lambda m, i: F.struct(m.cast("double").alias("mz"), i.cast("double").alias("intensity")))


def intensities(spectrum: Column) -> Column:
    return F.transform(spectrum, lambda p: p["intensity"])


def total(spectrum: Column) -> Column:
    return F.aggregate(spectrum, F.lit(0.0), lambda s, p: s + p["intensity"])


def above_intensity(spectrum: Column, least: float) -> Column:
    return F.filter(spectrum, lambda p: p["intensity"] > least)


def quantile(spectrum: Column, percent: float) -> Column:
    """The intensity at place percent / 100 * n of those in order, the last one at most; null without peaks."""
    n = F.size(spectrum)
    return F.get(F.array_sort(intensities(spectrum)), F.least((n * (percent / 100)).cast("int"), n - 1))


def above_quantile(spectrum: Column, percent: float) -> Column:
    cut = quantile(spectrum, percent)
    return F.filter(spectrum, lambda p: p["intensity"] > cut)


def in_range(spectrum: Column, low: Column, high: Column) -> Column:
    """Peaks from ``low`` to ``high``, both included."""
    return F.filter(spectrum, lambda p: p["mz"].between(low, high))


def around(spectrum: Column, mz: Column, ppm: float) -> Column:
    return in_range(spectrum, mz - mz / 1e6 * ppm, mz + mz / 1e6 * ppm)


def has_mz(spectrum: Column, mz: Column, ppm: float) -> Column:
    return F.exists(spectrum, lambda p: F.abs(p["mz"] - mz) <= mz / 1e6 * ppm)


def _best(spectrum: Column, order) -> Column:
    """The peak of the largest ``order``; of equal ones the first. Null without peaks."""
    keyed = F.transform(spectrum, lambda p, i: F.struct(order(p).alias("o"), (-i).alias("neg"), p.alias("p")))
    return F.get(F.array_sort(keyed, lambda x, y: F.when((x["o"] > y["o"]) | ((x["o"] == y["o"]) & (x["neg"] > y["neg"])), -1).otherwise(1)), F.lit(0))["p"]


def highest(spectrum: Column) -> Column:
    return _best(spectrum, lambda p: p["intensity"])


def highest_around(spectrum: Column, mz: Column, ppm: float) -> Column:
    return highest(around(spectrum, mz, ppm))


def closest_highest(spectrum: Column, mz: Column, ppm: float) -> Column:
    """Of the peaks around ``mz``, that of the largest root of relative intensity less squared distance."""
    near = around(spectrum, mz, ppm)
    most = F.array_max(intensities(near))
    return _best(near, lambda p: F.sqrt(p["intensity"] / most) - (p["mz"] - mz) * (p["mz"] - mz))


def closest_intensity(spectrum: Column, mz: Column, ppm: float) -> Column:
    """Intensity of the peak closest to ``mz`` within the tolerance; -1 without one."""
    return F.coalesce(_best(around(spectrum, mz, ppm), lambda p: -F.abs(p["mz"] - mz))["intensity"], F.lit(-1.0))


def normalised_intensity(spectrum: Column, query: Column, standard: Column, ppm: float, least: float = 0.0) -> Column:
    """Intensity at ``query`` over that at ``standard``; -1 if either is missing or below ``least``."""
    one, other = closest_intensity(spectrum, query, ppm), closest_intensity(spectrum, standard, ppm)
    return F.when((one < 0) | (other <= 0) | (one < least) | (other < least), -1.0).otherwise(one / other)


def by_intensity(spectrum: Column) -> Column:
    """Peaks from the most intense on; of equal ones the smaller m/z first."""
    return F.array_sort(spectrum, lambda x, y: F.when(x["intensity"] > y["intensity"], -1).when(x["intensity"] < y["intensity"], 1).when(x["mz"] < y["mz"], -1).when(x["mz"] > y["mz"], 1).otherwise(0))


def by_mz(spectrum: Column) -> Column:
    return F.array_sort(spectrum, lambda x, y: F.when(x["mz"] < y["mz"], -1).when(x["mz"] > y["mz"], 1).otherwise(0))


def top_peaks(spectrum: Column, fraction: float = 0.0, signal_to_noise: float = 0.0, baseline: int = 5, least: float = 0.0) -> Column:
    """Peaks from the most intense on, down to a fraction of it, a ratio to the baseline and a least intensity.

    The baseline is the intensity at place n * (100 - baseline) / 100 of the descending order, 1 where that is past the end.
    """
    ordered, n = by_intensity(spectrum), F.size(spectrum)
    most = F.array_max(intensities(spectrum))
    level = F.coalesce(F.get(ordered, (n * (100 - baseline) / 100).cast("int"))["intensity"], F.lit(1.0))
    return F.filter(ordered, lambda p: (p["intensity"] / most > fraction) & (p["intensity"] / level > signal_to_noise) & (p["intensity"] > least))


def log_scaled(spectrum: Column) -> Column:
    return F.transform(spectrum, lambda p: F.struct(p["mz"].alias("mz"), F.when(p["intensity"] > 0, F.log10(p["intensity"])).otherwise(p["intensity"]).alias("intensity")))


def is_monoisotopic(spectrum: Column, mz: Column, ppm: float, charge: Column) -> Column:
    """False if a peak one heavy carbon below exceeds 5 % of the peak at ``mz``; true without either."""
    own = highest_around(spectrum, mz, ppm)["intensity"]
    below = highest_around(spectrum, mz - C13_STEP / charge, ppm)["intensity"]
    return ~F.coalesce(below / own > 0.05, F.lit(False))


def top_n(spectrum: Column, n: int) -> Column:
    """The n most intense peaks, in order of m/z."""
    return by_mz(F.slice(by_intensity(spectrum), 1, n))


def without_co_isolated(spectrum: Column, precursor: Column, ppm: float, width: float = 0.5) -> Column:
    """Without peaks within ``width`` of the precursor, but for the precursor itself."""
    return F.filter(spectrum, lambda p: (F.abs(p["mz"] - precursor) > width) | (F.abs(p["mz"] - precursor) <= precursor / 1e6 * ppm))


def without_mz(spectrum: Column, removed: Column, ppm: float) -> Column:
    return F.filter(spectrum, lambda p: ~F.exists(removed, lambda m: F.abs(p["mz"] - m) <= m / 1e6 * ppm))


def scaled(spectrum: Column, to: float = 10_000.0) -> Column:
    """The most intense peak at ``to``; a spectrum of fewer than two peaks stays."""
    most = F.array_max(intensities(spectrum))
    grown = F.transform(spectrum, lambda p: F.struct(p["mz"].alias("mz"), (p["intensity"] / most * to).alias("intensity")))
    return F.when(F.size(spectrum) > 1, grown).otherwise(spectrum)


def _numbers(values: Column, digits: int, sep: str) -> Column:
    return F.array_join(F.transform(values, lambda v: F.format_string(f"%.{digits}f", v)), sep)


def encoded(spectrum: Column, digits: int = 5, table: bool = False, normalise: bool = False) -> Column:
    """``{{mz,...},{intensity,...}}``, or a line for each peak with a tab; intensities that the digits show as 0 are dropped."""
    spectrum = scaled(spectrum, 1.0) if normalise else spectrum
    kept = F.filter(spectrum, lambda p: p["intensity"] >= 10.0**-digits)
    if table:
        return F.array_join(F.transform(kept, lambda p: F.format_string(f"%.{digits}f\t%.{digits}f", p["mz"], p["intensity"])), "\n")
    mz, intensity = F.transform(kept, lambda p: p["mz"]), intensities(kept)
    return F.concat(F.lit("{{"), _numbers(mz, digits, ","), F.lit("},{"), _numbers(intensity, digits, ","), F.lit("}}"))


def decoded(text: Column) -> Column:
    """The spectrum of ``{{mz,...},{intensity,...}}``; what is no number is left out of its list."""
    lists = [F.filter(F.transform(F.split(F.regexp_extract(text, r"\{\{([^}]*)\}\s*,\s*\{([^}]*)\}\}", k), ","), lambda v: F.trim(v).try_cast("double")), lambda v: v.isNotNull()) for k in (1, 2)]
    return F.filter(peaks(*lists), lambda p: p["mz"].isNotNull() & p["intensity"].isNotNull())


def bracketed(spectrum: Column, digits: int = 4) -> Column:
    """``[mz,intensity][mz,intensity]...``"""
    return F.array_join(F.transform(spectrum, lambda p: F.format_string(f"[%.{digits}f,%.{digits}f]", p["mz"], p["intensity"])), "")


def from_bracketed(text: Column) -> Column:
    parts = F.regexp_extract_all(text, F.lit(r"\[([^\[\]]*)\]"), F.lit(1))
    pair = lambda t, k: F.trim(F.get(F.split(t, ","), F.lit(k))).try_cast("double")
    return F.filter(F.transform(parts, lambda t: F.struct(pair(t, 0).alias("mz"), pair(t, 1).alias("intensity"))), lambda p: p["mz"].isNotNull() & p["intensity"].isNotNull())


def signature(spectrum: Column, most: int) -> Column:
    """``[mz,intensity]...`` of the most intense peak of each integer m/z, ``most`` of them from the most intense on, no decimals."""
    ordered = by_intensity(spectrum)
    floors = F.transform(ordered, lambda p: F.floor(p["mz"]))
    first = F.filter(ordered, lambda p, i: F.array_position(floors, F.get(floors, i)) == i + 1)
    return F.array_join(F.transform(F.slice(first, 1, most), lambda p: F.format_string("[%d,%d]", F.floor(p["mz"]), F.floor(p["intensity"]))), "")


def mgf(spectrum: Column, title: Column, precursor: Column, rt: Column, charge: Column) -> Column:
    """The spectrum as an MGF record; rt in minutes."""
    lines = F.array_join(F.transform(spectrum, lambda p: F.format_string("%.5f %.4f", p["mz"], p["intensity"])), "\n")
    head = F.format_string("BEGIN IONS\nTITLE=%s\nPEPMASS=%.6f\nRTINSECONDS=%.3f\nCHARGE=%d+\n", title, precursor, rt * 60, charge)
    return F.concat(head, lines, F.lit("\nEND IONS\n"))


def msp(spectrum: Column, name: Column, precursor: Column, formula: Column) -> Column:
    """The spectrum as a NIST MSP record."""
    lines = F.array_join(F.transform(spectrum, lambda p: F.format_string("%.5f %.4f", p["mz"], p["intensity"])), "\n")
    head = F.format_string("NAME: %s\nPRECURSORMZ: %.5f\nFORMULA: %s\nNum Peaks: %d\n", name, precursor, F.coalesce(formula, F.lit("")), F.size(spectrum))
    return F.concat(head, lines, F.lit("\n"))


def msp_peak(line: Column) -> Column:
    """(mz, intensity, label) of a peak line: two numbers and, in quotes or not, a label; null if there are not two numbers."""
    number = lambda k: F.regexp_extract(line, r"^\s*([\d.eE+-]+)[\s,;]+([\d.eE+-]+)", k).try_cast("double")
    label = F.trim(F.regexp_replace(F.regexp_extract(line, r"^\s*[\d.eE+-]+[\s,;]+[\d.eE+-]+\s*(.*)$", 1), '"', ""))
    return F.when(number(1).isNotNull() & number(2).isNotNull(), F.struct(number(1).alias("mz"), number(2).alias("intensity"), label.alias("label")))


def neutral_losses(spectrum: Column, precursor: Column) -> Column:
    """Peaks below the precursor as its losses, in order of loss."""
    lost = F.filter(spectrum, lambda p: p["mz"] < precursor)
    return by_mz(F.transform(lost, lambda p: F.struct((precursor - p["mz"]).alias("mz"), p["intensity"].alias("intensity"))))


def with_neutral_losses(spectrum: Column, precursor: Column) -> Column:
    return by_mz(F.concat(spectrum, neutral_losses(spectrum, precursor)))


def has_neutral_loss(spectrum: Column, precursor: Column, loss: float, ppm: float) -> Column:
    return has_mz(spectrum, precursor - loss, ppm)


def binned(spectrum: Column, low: float = 100.0, high: float = 2000.0, bins: int = 2000) -> Column:
    """Sum of intensity in each of ``bins`` equal bins of m/z."""
    place = lambda p: ((p["mz"] - low) / ((high - low) / bins)).cast("int")
    inner = F.filter(spectrum, lambda p: (p["mz"] >= low) & (p["mz"] < high))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: total(F.filter(inner, lambda p: place(p) == b)))


def cosine(one: Column, other: Column) -> Column:
    """Of two intensity arrays in the same order, from 0 to 1; 0 where either has no length."""
    norm = F.sqrt(dot(one, one) * dot(other, other))
    return F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(one, other) / norm))).otherwise(0.0)


def weighted_dot(mz: Column, one: Column, other: Column) -> Column:
    """Cosine of intensities weighted by m/z: products of root intensity and squared m/z."""
    scale = lambda i: F.zip_with(mz, i, lambda m, x: F.sqrt(x) * m * m)
    return cosine(scale(one), scale(other))


def log_choose(total_: Column, drawn: Column) -> Column:
    """The score's own approximation: n x ln(1/x) + (1 - x) ln(1/(1 - x)), x = drawn / total; 0 at either end."""
    x = drawn / total_
    return F.when((drawn <= 0) | (drawn >= total_), 0.0).otherwise(total_ * x * F.log(1 / x) + (1 - x) * F.log(1 / (1 - x)))


def hypergeometric(matched: Column, of_library: Column, of_spectrum: Column, total_: Column | None = None) -> Column:
    """Score of ``matched`` peaks of a library spectrum's ``of_library`` in a spectrum of ``of_spectrum``."""
    n = F.lit(100_000.0) if total_ is None else total_
    k, m, s = matched.cast("double"), of_library.cast("double"), of_spectrum.cast("double")
    return -(log_choose(m, k) + log_choose(n - m, s - k) - log_choose(n, s))
