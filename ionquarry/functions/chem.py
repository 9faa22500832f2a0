"""Masses of formulas, adducts and residue strings as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Monoisotopic masses of the elements (Da)
ELEMENTS = {
    "H": 1.0078250321, "2H": 2.01410178, "D": 2.01410178, "C": 12.0, "Co": 58.93319352, "13C": 13.003354835336, "N": 14.0030740052, "15N": 15.000108898266,
    "O": 15.994914619257, "18O": 17.999159612136, "S": 31.97207069, "34S": 33.96786701, "P": 30.97376151, "F": 18.9984032, "Na": 22.98976967, "Mg": 23.98504,
    "Ca": 39.962591, "Cl": 34.96885271, "Br": 78.918336, "I": 126.904477, "K": 38.96399867, "Se": 79.916521, "As": 74.921596, "Si": 27.9769265325,
    "Fe": 55.934939, "Li": 7.016003437,
}
ELECTRON = 0.00054857990946
# Name, molecules, charge, added mass (Da)
ADDUCTS = [("[M+H]+", 1, 1, 1.00727646688), ("[M+Na]+", 1, 1, 22.98922), ("[2M+H]+", 2, 1, 1.00727646688), ("[M+2H]2+", 1, 2, 2.01455293376), ("[M-H]-", 1, -1, -1.00727646688)]
# Monoisotopic residue masses of the amino acids (Da)
RESIDUES = {
    "G": 57.02146, "A": 71.03711, "S": 87.03203, "P": 97.05276, "V": 99.06841, "T": 101.04768, "C": 103.00919, "L": 113.08406, "I": 113.08406, "N": 114.04293,
    "D": 115.02694, "Q": 128.05858, "K": 128.09496, "E": 129.04259, "M": 131.04049, "H": 137.05891, "F": 147.06841, "R": 156.10111, "Y": 163.06333, "W": 186.07931,
}
# Fixed value: the water that a chain has besides its residues (Da)
WATER = 18.0105
# Fixed value: natural abundance of 13C
C13 = 0.0107
# Lanczos coefficients of the gamma function (g = 7)
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def formula_mass(formula: Column) -> Column:
    """Neutral monoisotopic mass of elements and counts; null where an element is not in the table."""
    parts = F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?\d*)"), F.lit(1))
    table = F.create_map(*[F.lit(x) for pair in ELEMENTS.items() for x in pair])
    count = lambda p: F.coalesce(F.regexp_extract(p, r"(\d+)", 1).try_cast("double"), F.lit(1.0))
    mass = lambda p: F.try_element_at(table, F.regexp_extract(p, "([A-Za-z]+)", 1))
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a + count(p) * mass(p))


def adduct_mz(mass: Column, molecules: Column, charge: Column, added: Column) -> Column:
    return (mass * molecules + added) / F.abs(charge)


def residue_mass(text: Column) -> Column:
    """Mass of the residues among the letters, upper case, and one water."""
    count = lambda r: F.length(text) - F.length(F.replace(text, F.lit(r), F.lit("")))
    return reduce(Column.__add__, [count(r) * m for r, m in RESIDUES.items()]) + WATER


def log_factorial(n: Column) -> Column:
    """Natural logarithm of n!."""
    parts = [F.lit(c) / (n + i) if i else F.lit(c) for i, c in enumerate(LANCZOS)]
    t = n + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (n + 0.5) * F.log(t) - t + F.log(reduce(Column.__add__, parts))


def c13_distribution(carbons: Column, threshold: float = 0.0, abundance: float = C13) -> Column:
    """Array of (k, abundance) for k heavy carbons from 0 to all, those of at least ``threshold`` times the largest one."""
    n = carbons.cast("double")
    term = lambda k: F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(abundance) + (n - k) * math.log1p(-abundance))
    rows = F.when(carbons >= 0, F.transform(F.sequence(F.lit(0), carbons.cast("int")), lambda k: F.struct(k.alias("k"), term(k).alias("abundance"))))
    if not threshold:
        return rows
    most = lambda r: F.array_max(F.transform(r, lambda x: x["abundance"]))
    cut = F.transform(F.array(F.struct(rows.alias("r"), most(rows).alias("most"))), lambda b: F.filter(b["r"], lambda x: x["abundance"] >= b["most"] * threshold))
    return F.element_at(cut, 1)
