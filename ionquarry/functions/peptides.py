"""Peptides and proteins: parsing, masses, fragment ions, digestion, decoys, isoelectric points, truncations.

A peptide string holds residues in upper case, a modified one followed by its nominal mass in brackets (``C[160]``), and
``n[...]`` or ``c[...]`` for the ends; ``K.PEPTIDE.R/2`` adds neighbours and a charge. Kernels in Python are Arrow-batched.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionquarry.functions.chem import RESIDUES, WATER

# Fixed values (Da)
PROTON, HYDROGEN, WATER_MASS, AMMONIA, CARBONYL, PHOSPHATE = 1.00727646688, 1.00782503207, 18.0105646863, 17.0265491015, 27.9949146221, 97.9768955748
# Average residue masses (Da)
AVERAGE = {
    "G": 57.0513, "A": 71.0779, "S": 87.0773, "P": 97.1152, "V": 99.1311, "T": 101.1039, "C": 103.1429, "L": 113.1576, "I": 113.1576, "N": 114.1026,
    "D": 115.0874, "Q": 128.1292, "K": 128.1723, "E": 129.114, "M": 131.1961, "H": 137.1393, "F": 147.1739, "R": 156.1857, "Y": 163.1733, "W": 186.2099,
}
# Residue and nominal mass of a modification, its name and mass (Da)
MODIFICATIONS = {
    "C[160]": ("Carbamidomethyl", 57.021464), "M[147]": ("Oxidation", 15.994915), "K[357]": ("TMT", 229.162932), "n[230]": ("TMT", 229.162932), "n[43]": ("Acetyl", 42.010565),
    "S[167]": ("Phospho", 79.966331), "T[181]": ("Phospho", 79.966331), "Y[243]": ("Phospho", 79.966331), "N[115]": ("Deamidated", 0.984016), "Q[129]": ("Deamidated", 0.984016),
}
# Dissociation constants of side chains and of the ends, X for all others
SIDE = {"C": 1.000e-9, "D": 8.913e-5, "E": 3.548e-5, "H": 1.047e-6, "K": 1.000e-10, "R": 1.000e-12, "Y": 1.000e-10}
N_END = {"A": 2.570e-8, "E": 1.995e-8, "M": 1.000e-7, "P": 4.365e-9, "S": 1.175e-7, "T": 1.514e-7, "V": 3.631e-8, "X": 3.162e-8}
C_END = {"D": 2.818e-5, "E": 1.778e-5, "X": 2.818e-4}
_FORM = re.compile(r"^(?:([A-Z-])\.)?(n\[\d+\])?((?:[A-Z](?:\[\d+\])?)+)(c\[\d+\])?(?:\.([A-Z-]))?(?:/(\d+))?$")


def parse(text: str | None) -> dict | None:
    """residues, mods (place from 0, -1 and n for the ends, to modification), before, after, charge; null if it can't be read."""
    found = _FORM.match(text or "")
    if not found:
        return None
    before, head, body, tail, after, charge = found.groups()
    parts = re.findall(r"([A-Z])(\[\d+\])?", body)
    mods = {i: a + m for i, (a, m) in enumerate(parts) if m}
    mods |= ({-1: head} if head else {}) | ({len(parts): tail} if tail else {})
    return {"residues": "".join(a for a, _ in parts), "mods": mods, "before": before, "after": after, "charge": int(charge or 0)}


def _moved(mod: str) -> float:
    """Mass that a modification adds; unlisted ones by their nominal mass less the residue's."""
    if mod in MODIFICATIONS:
        return MODIFICATIONS[mod][1]
    nominal = float(re.search(r"\[(\d+)\]", mod)[1])
    return nominal - round(RESIDUES.get(mod[0], 1.0 if mod[0] == "n" else 17.0))


def neutral_mass(p: dict, average: bool = False) -> float:
    table = AVERAGE if average else RESIDUES
    return sum(table.get(a, 0.0) for a in p["residues"]) + sum(_moved(m) for m in p["mods"].values()) + (18.01528 if average else WATER_MASS)


def ion_mz(p: dict, kind: str, count: int, charge: int) -> float | None:
    """m/z of the b, y, a, c or z fragment of ``count`` residues; null outside 1..n-1 or without charge."""
    n = len(p["residues"])
    if kind not in "byacz" or not 1 <= count < n or charge < 1:
        return None
    places = range(count) if kind in "bac" else range(n - count, n)
    ends = -1 if kind in "bac" else n
    mass = sum(RESIDUES.get(p["residues"][i], 0.0) + (_moved(p["mods"][i]) if i in p["mods"] else 0.0) for i in places)
    mass += _moved(p["mods"][ends]) if ends in p["mods"] else 0.0
    mass += {"b": 0.0, "a": -CARBONYL, "c": AMMONIA, "y": WATER_MASS, "z": WATER_MASS - AMMONIA + PROTON}[kind]
    return (mass + charge * PROTON) / charge


def fragment_ions(p: dict, charge: int, kinds: str = "by") -> list[dict]:
    """Ions (name, mz, kind, place, charge, prominence) up to the precursor's charge less one, with losses of water and ammonia.

    CID gives b and y (by), ETD c and z (cz). Losses count where the fragment holds STED for water, RKNQ for ammonia, a
    phosphate where it holds a phosphorylated residue. Prominence: 4 for the whole ion of the main series, 3 for the other,
    2 for losses and a ions, less one for each charge above 1.
    """
    out, n = [], len(p["residues"])
    for z in range(1, max(charge, 2)):
        for kind in kinds:
            main = kind in "yz"
            for count in range(1, n):
                held = p["residues"][:count] if kind in "bac" else p["residues"][n - count :]
                mz = ion_mz(p, kind, count, z)
                mark = "" if z == 1 else f"^{z}"
                out.append({"name": f"{kind}{count}{mark}", "mz": mz, "kind": kind, "place": count, "charge": z, "prominence": (4 if main else 3) - (z - 1)})
                if kind in "cz":
                    continue
                places = range(count) if kind == "b" else range(n - count, n)
                phospho = any("Phospho" == MODIFICATIONS.get(p["mods"].get(i, ""), ("",))[0] for i in places)
                losses = [(18, WATER_MASS, set("STED") & set(held)), (17, AMMONIA, set("RKNQ") & set(held)), (98, PHOSPHATE, phospho), (28, CARBONYL, kind == "b")]
                for nominal, mass, present in losses:
                    if present:
                        name = f"a{count}{mark}" if nominal == 28 else f"{kind}{count}-{nominal}{mark}"
                        out.append({"name": name, "mz": mz - mass / z, "kind": "a" if nominal == 28 else kind, "place": count, "charge": z, "prominence": 2 - (z - 1)})
    return out


def theoretical_spectrum(p: dict, charge: int, most: float = 50.0) -> list[tuple[int, float]]:
    """(unit m/z, intensity): b and y at 50, their neighbours at 25, losses and a ions at 10; the largest where they meet."""
    bins: dict[int, float] = {}
    for ion in fragment_ions(p, charge):
        at, loss = int(ion["mz"] + 0.5), "-" in ion["name"] or ion["kind"] == "a"
        for k, y in ((0, 10.0 if loss else 50.0), *(() if loss else ((-1, 25.0), (1, 25.0)))):
            bins[at + k] = min(max(bins.get(at + k, 0.0), y), most)
    return sorted(bins.items())


def missed_cleavages(residues: str) -> int:
    return sum(a in "KR" and b != "P" for a, b in zip(residues, residues[1:], strict=False))


def tryptic_ends(p: dict) -> int:
    """0 to 2: ends that trypsin makes, or that are the protein's."""
    first = p["before"] in ("-", "[") or (p["before"] in ("K", "R") and p["residues"][0] != "P")
    last = p["after"] in ("-", "]") or (p["residues"][-1] in "KR" and p["after"] != "P")
    return int(first) + int(last)


def homologous(one: str, other: str, least: float) -> bool:
    """Whether the longest common subsequence (I as L, K as Q) covers ``least`` of the shorter sequence."""
    a, b = (s.replace("I", "L").replace("K", "Q") for s in (one, other))
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return bool(a and b) and row[-1] >= least * min(len(a), len(b))


def shuffled(text: str, seed: int) -> str:
    """A decoy: the residues but K, R and P, which stay in place, in another order; the last one stays too. The seed and the text decide."""
    moving = [i for i, a in enumerate(text[:-1]) if a not in "KRP"]
    r = np.random.Generator(np.random.PCG64([seed, *text.encode()]))
    out = list(text)
    for i, j in zip(moving, r.permutation(moving).tolist(), strict=True):
        out[i] = text[j]
    return "".join(out)


def isoelectric_point(residues: str) -> float:
    """pH of no net charge, by bisection to 0.01."""
    low, high, mid = 0.0, 14.0, 7.0
    n_end, c_end = N_END.get(residues[:1], N_END["X"]), C_END.get(residues[-1:], C_END["X"])
    while high - low > 0.01:
        mid = (low + high) / 2
        h = 10.0**-mid
        plus = h / (n_end + h) + sum(residues.count(a) * h / (SIDE[a] + h) for a in "RHK")
        minus = c_end / (c_end + h) + sum(residues.count(a) * SIDE[a] / (SIDE[a] + h) for a in "DECY")
        low, high = (mid, high) if plus > minus else (low, mid)
    return mid


def digest(sequence: str, least: int = 5, most: int = 30, spans: int = 3) -> list[tuple[int, int, str]]:
    """(start, end, peptide) of a tryptic digest: up to ``spans`` neighbouring pieces, cut after K and R, of allowed lengths."""
    cuts = [0, *(i + 1 for i, a in enumerate(sequence) if a in "KR" and i + 1 < len(sequence)), len(sequence)]
    return [(a, b, sequence[a:b]) for k, a in enumerate(cuts[:-1]) for b in cuts[k + 1 : k + 1 + spans] if least <= b - a <= most]


def modified_forms(peptide: str, tmt: bool = False) -> list[str]:
    """The peptide with its fixed modifications, and with more and more of its methionines oxidised, from the first on."""
    parts = ["C[160]" if a == "C" else "K[357]" if a == "K" and tmt else a for a in peptide]
    head, out = "n[230]" if tmt else "", ["".join(parts)]
    for i, a in enumerate(peptide):
        if a == "M":
            parts[i] = "M[147]"
            out.append("".join(parts))
    return [head + x for x in out]


_D, _L, _S = T.DoubleType(), T.LongType(), T.StringType()


def _mapped(kernel, kind: T.DataType, *columns: Column) -> Column:
    @F.pandas_udf(kind)
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if row[0] is None else kernel(*row) for row in zip(*series, strict=True)], dtype=object)

    return run(*columns)


def _rows(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields.items()]))


def digested(sequence: Column, **options) -> Column:
    """Array of (start, end, peptide)."""
    return _mapped(lambda s: [dict(zip(("start", "end", "peptide"), x, strict=True)) for x in digest(s, **options)], _rows(start=_L, end=_L, peptide=_S), sequence)


#: Peptides that a task holds before it hands them on; those of one sequence stay together.
PEPTIDES_AT_ONCE = 20_000


def digest_rows(sequences: DataFrame, **options) -> DataFrame:
    """(sequence_id, start, end, peptide) of ``sequences`` (sequence_id, residues): ``digested``, a row for each peptide.

    Peptides take many times their sequence's bytes, so a batch of sequences gives many batches of them.
    """
    kind = sequences.schema["sequence_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, held = batch.column("sequence_id"), []
            for i, residues in enumerate(batch.column("residues")):
                text = residues.as_py()
                held += [] if text is None else [(i, *x) for x in digest(text, **options)]
                if len(held) >= PEPTIDES_AT_ONCE:
                    yield peptide_batch(ids, held)
                    held = []
            if held:
                yield peptide_batch(ids, held)

    return sequences.select("sequence_id", "residues").mapInArrow(run, f"sequence_id {kind}, start long, end long, peptide string")


def peptide_batch(ids: pa.Array, held: list[tuple]) -> pa.RecordBatch:
    """Rows of a place among ``ids``, start, end and peptide as an Arrow batch."""
    at, start, end, peptide = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(peptide, pa.string())], names=["sequence_id", "start", "end", "peptide"])


def forms(peptide: Column, tmt: bool = False) -> Column:
    return _mapped(lambda p: modified_forms(p, tmt), T.ArrayType(_S), peptide)


def ions(peptide: Column, charge: int = 2, kinds: str = "by") -> Column:
    """Array of fragment ions; null for what can't be read."""
    kind = _rows(name=_S, mz=_D, kind=_S, place=_L, charge=_L, prominence=_L)
    return _mapped(lambda t: None if parse(t) is None else fragment_ions(parse(t), charge, kinds), kind, peptide)


def properties(peptide: Column) -> Column:
    """Struct of residues, mass, average_mass, mz (at its charge, 1 if it has none), missed, ends, point, named mods."""
    kind = T.StructType([T.StructField(n, t) for n, t in {"residues": _S, "mass": _D, "average_mass": _D, "mz": _D, "missed": _L, "ends": _L, "point": _D, "mods": T.ArrayType(_S)}.items()])

    def kernel(text: str | None) -> tuple:
        p = parse(text)
        if p is None:
            return (None,) * 8
        mass, z = neutral_mass(p), p["charge"] or 1
        names = [MODIFICATIONS.get(m, (m,))[0] for _, m in sorted(p["mods"].items())]
        return p["residues"], mass, neutral_mass(p, True), mass / z + PROTON, missed_cleavages(p["residues"]), tryptic_ends(p), isoelectric_point(p["residues"]), names

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kernel(t) for t in texts], columns=kind.names)

    return run(peptide)


def decoy(peptide: Column, seed: int = 0) -> Column:
    return _mapped(lambda p: shuffled(p, seed), _S, peptide)


def reversed_sequence(sequence: Column) -> Column:
    return F.reverse(sequence)


def with_modification_names(peptide: Column) -> Column:
    """``PEPTIDE`` with each known modification's name for its mass."""
    out = peptide
    for mod, (name, _) in MODIFICATIONS.items():
        out = F.replace(out, F.lit(mod), F.lit(f"{mod[0]}[{name}]"))
    return out


def stripped(peptide: Column) -> Column:
    """The residues alone, without neighbours, modifications and charge."""
    core = F.regexp_replace(F.regexp_replace(peptide, r"^[A-Z-]\.|\.[A-Z-](?=/|$)|/\d+$", ""), r"\[\d+\]|[nc](?=\[)", "")
    return F.regexp_replace(core, "[^A-Z]", "")


def missed(peptide: Column) -> Column:
    """Places after K or R, but before P and the end."""
    return F.regexp_count(peptide, F.lit("[KR](?=[^P])"))


def truncations(sequences: DataFrame, masses: list[float], tolerance: float, water: float = WATER) -> DataFrame:
    """(sequence_id, start, end, mass, target): stretches of each sequence whose residues weigh one of ``masses``.

    ``sequences``: sequence_id, residues; unknown residues weigh nothing. Stretches inside count with one water, as do those
    at either end. Prefix sums are looked up in order, so a sequence of n residues costs n log n for each mass, not n squared.
    """
    schema = T.StructType([sequences.schema["sequence_id"], *(T.StructField(n, t) for n, t in {"start": _L, "end": _L, "mass": _D, "target": _D}.items())])

    def run(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch["sequence_id"], batch["residues"], strict=True):
                sums = np.r_[0.0, np.cumsum([RESIDUES.get(a, 0.0) for a in text or ""])]
                for target in masses:
                    low, high = np.searchsorted(sums, sums + target - water - tolerance, "left"), np.searchsorted(sums, sums + target - water + tolerance, "left")
                    for a, (i, j) in enumerate(zip(low, high, strict=True)):
                        rows += [(key, a, b - 1, float(sums[b] - sums[a]) + water, target) for b in range(max(i, a + 1), j)]
            yield pd.DataFrame(rows, columns=schema.names)

    return sequences.select("sequence_id", "residues").mapInPandas(run, schema)


def probability_density(x: float, low: float, mode: float, high: float, shape: float = 4.0) -> float:
    """Density of the PERT distribution, a beta distribution between low and high; 0 outside."""
    if not low < x < high:
        return 0.0
    width = high - low
    a, b = 1 + shape * (mode - low) / width, 1 + shape * (high - mode) / width
    log_beta = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    u = (x - low) / width
    return math.exp((a - 1) * math.log(u) + (b - 1) * math.log1p(-u) - log_beta) / width
