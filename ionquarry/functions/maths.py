"""Distances, combinatorics, robust statistics and abundance corrections as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (Da)
PROTON, ELECTRON, C13_STEP = 1.00727646688, 0.00054857990946, 1.00335483521


def ppm_distance(one: Column, other: Column) -> Column:
    """Distance in parts per million of the first; symmetric use needs care."""
    return F.abs(other - one) / (one / 1e6)


def rounded_to_ppm(mz: Column, ppm: float) -> Column:
    """The next multiple of so many parts per million of the value's integer part."""
    step = F.floor(mz) * ppm / 1e6
    return F.when(step > 0, F.round(mz / step) * step).otherwise(mz)


def within_ppm(one: Column, other: Column, ppm: float) -> Column:
    """Whether ``other`` lies strictly within so many parts per million of ``one``."""
    return (one - one / 1e6 * ppm < other) & (one + one / 1e6 * ppm > other)


def mz_key(mz: Column) -> Column:
    return F.round(mz * 1e6).cast("long")


def key_mz(key: Column) -> Column:
    return key.cast("double") / 1e6


def between_open(x: Column, a: Column, b: Column) -> Column:
    return (x > F.least(a, b)) & (x < F.greatest(a, b))


def between_closed(x: Column, a: Column, b: Column) -> Column:
    return (x >= F.least(a, b)) & (x <= F.greatest(a, b))


def choose(n: Column, k: Column) -> Column:
    """n over k as a double; 0 outside 0..n."""
    m = F.least(k, n - k).cast("int")
    steps = F.when(m >= 1, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
    return F.when((k < 0) | (k > n), 0.0).otherwise(F.round(F.aggregate(steps, F.lit(1.0), lambda a, i: a * (n - m + i) / i)))


def normalised(values: Column) -> Column:
    """Over the root of the sum of squares; as they are where that is 0."""
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(values, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def charge_series(mz: Column, most: int = 5) -> Column:
    """m/z of the protonated molecule at charges 1 to ``most``, given its neutral mass."""
    return F.transform(F.sequence(F.lit(1), F.lit(most)), lambda z: (mz + z) / z)


def adduct_mass(parent: Column, molecules: Column, charge: Column, added: Column) -> Column:
    """m/z of an adduct; 0 molecules or charges count as 1."""
    return (parent * F.when(molecules == 0, 1).otherwise(molecules) + added) / F.abs(F.when(charge == 0, 1).otherwise(charge))


def parent_mass(mz: Column, molecules: Column, charge: Column, added: Column) -> Column:
    """The neutral mass behind an adduct's m/z."""
    return (mz * F.abs(F.when(charge == 0, 1).otherwise(charge)) - added) / F.when(molecules == 0, 1).otherwise(molecules)


def adjusted_mass(mass: Column, charge: Column, electron: bool = False) -> Column:
    """m/z of a neutral mass with protons (or, by electron impact, without electrons); the mass itself at charge 0."""
    moved = mass - charge * ELECTRON if electron else mass + charge * PROTON
    return F.when(charge == 0, mass).otherwise(moved / F.abs(charge))


def corrected_abundance(observed: Column, expected_ratio: Column, monoisotopic: Column) -> Column:
    """What natural abundance does not explain, 0 at least; as observed where the ratio or the parent is not above 0."""
    return F.when((expected_ratio > 0) & (monoisotopic > 0), F.greatest(F.lit(0.0), observed - expected_ratio * monoisotopic)).otherwise(observed)


def c13_correction(measured: Column, carbons: Column, k: Column, rest: Column, p: float = 0.011) -> Column:
    """A 13C isotope's intensity without what the monoisotopic one brings by binomial abundance, 0 at least."""
    expected = choose(carbons, k) * F.pow(F.lit(p), k) * F.pow(F.lit(1 - p), carbons - k)
    return F.greatest(F.lit(0.0), measured - rest * expected)


def isotope_window(mz: Column, low: Column, high: Column, ppm: float) -> Column:
    """(mzmin, mzmax): merged isotopes reach from their lowest to their highest m/z, single ones around their own."""
    lo, hi = F.when(low > 0, low).otherwise(mz), F.when(high > 0, high).otherwise(mz)
    return F.struct((lo - lo / 1e6 * ppm).alias("mzmin"), (hi + hi / 1e6 * ppm).alias("mzmax"))


def median_or_zero(values: Column) -> Column:
    """Median of an array; 0 if it is empty."""
    v, n = F.array_sort(values), F.size(values)
    upper = (n / 2).cast("int") + 1
    return F.when(n == 0, 0.0).when(n % 2 == 1, F.get(v, upper - 1)).otherwise((F.get(v, upper - 2) + F.get(v, upper - 1)) / 2)


def lower_median(values: Column) -> Column:
    """The lower middle value of an array; null if it is empty."""
    return F.get(F.array_sort(values), ((F.size(values) + 1) / 2).cast("int") - 1)


def kth_smallest(values: Column, k: int) -> Column:
    """The k-th smallest value, from 0; null beyond the end."""
    return F.get(F.array_sort(values), F.lit(k))


def at_percentile(values: Column, percent: float) -> Column:
    """The value at place int(percent / 100 * n + 0.5) of the sorted array, the last one at most."""
    place = F.least((F.size(values) * (percent / 100) + 0.5).cast("int"), F.size(values) - 1)
    return F.get(F.array_sort(values), place)


def count_below(values: Column, limit: Column) -> Column:
    return F.size(F.filter(values, lambda x: x < limit))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def spread(values: Column, population: bool = False) -> Column:
    """Variance of an array; 0 for fewer than two values."""
    m = mean(values)
    squares = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
    return F.when(F.size(values) < 2, 0.0).otherwise(squares / (F.size(values) - (0 if population else 1)))


def array_correlation(one: Column, other: Column) -> Column:
    """Pearson correlation of two arrays of one length: 1 if they are identical, 0 if empty or either has no variance."""
    n, a, b = F.size(one), mean(one), mean(other)
    joint = F.aggregate(F.zip_with(one, other, lambda x, y: (x - a) * (y - b)), F.lit(0.0), lambda s, x: s + x)
    scale = F.sqrt(spread(one, True) * spread(other, True)) * n
    return F.when(one == other, F.when(n > 0, 1.0).otherwise(0.0)).when((n == 0) | (scale == 0), 0.0).otherwise(joint / scale)


def dot(one: Column, other: Column) -> Column:
    return F.aggregate(F.zip_with(one, other, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def weighted_mean(values: list[Column], weights: list[Column]) -> Column:
    total = reduce(Column.__add__, [v * w for v, w in zip(values, weights, strict=True)])
    return total / reduce(Column.__add__, weights)


def fraction_jaccard(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared over joint fractions of two closed integer ranges; below 0 where they lie apart."""
    shared = F.least(a1, b1) - F.greatest(a0, b0) + 1
    return shared / ((a1 - a0 + 1) + (b1 - b0 + 1) - shared)
