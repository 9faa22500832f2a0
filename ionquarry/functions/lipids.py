"""Lipid names: class and chains, summaries to species and class, conversions; column expressions, with Arrow where chains are parsed."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# An oxidised fatty acid's name, its chain and its group
OXIDISED = {
    "HETE": ("20:4", "OH"), "HDoHE": ("22:6", "OH"), "EET": ("20:3", "Ep"), "EpETE": ("20:4", "Ep"), "HEPE": ("20:5", "OH"), "HODE": ("18:2", "OH"), "EpDPE": ("22:5", "Ep"),
}
# The attribute of each level of detail
LEVEL_KEYS = {1: "lipidClass", 2: "acylChainLengthSummary", 3: "acylChainLengthSummary", 4: "snPositionLevelSummary", 5: "structureDefinedLevelSummary", 6: "structureDefinedAndOxPositionLevelSummary"}
_OXYGEN = (";OH", ";(OH", ";Ep", ";OO", ";oxo", ";COOH")
_LINKED = {"o-": "Alkyl_", "p-": "Alkenyl_"}


def parsed(name: str | None) -> tuple[str, list[str], int] | None:
    """(class, chains, level of detail) of ``Class(chain/chain)``; null without brackets.

    A chain linkage at the start of the brackets makes the class Alkyl_ or Alkenyl_. Named oxygen groups make level 5, counts
    of oxygens level 6, else the level is 4.
    """
    if name is None or "(" not in name or ")" not in name:
        return None
    start, end = name.index("("), name.rindex(")")
    if end < start:
        return None
    inner, level = name[start + 1 : end], 4
    chains = inner.split("/")
    for chain in chains:
        if any(mark in chain for mark in _OXYGEN):
            level = 5
        elif re.search(r";[0-9]+", chain):
            level = 6
    return _LINKED.get(inner[:2], "") + name[:start], chains, level


def _head(kind: str) -> str:
    """How the class starts a summary of its chains."""
    linkage, _, base = kind.rpartition("_")
    return f"{base}(o-" if linkage in ("Alkyl", "Alkenyl") and base in ("PC", "PE") else f"{kind}("


def species(name: str | None) -> str | None:
    """Sums of carbons and double bonds over the chains, and of oxygens; the name itself if a chain can't be read."""
    own = parsed(name)
    if own is None:
        return name
    kind, chains, _ = own
    carbons = bonds = oxygens = 0
    linkage = ""
    for chain in chains:
        bits = []
        for bit in chain.split(":"):
            if bit[:1] in ("m", "d", "t"):
                oxygens += " mdt".index(bit[0])
                bit = bit[1:]
            if ";" in bit:
                bit, tail = bit.split(";", 1)
                count = re.match(r".(\d+)", tail)
                oxygens += 1 if len(tail) <= 1 else int(count[1]) if count else 0
            if "-" in bit:
                head, _, bit = bit.partition("-")
                linkage = head + "-"
            bits.append(bit)
        if len(bits) != 2 or not all(re.match(r"\d+", b) for b in bits):
            return name
        carbons, bonds = carbons + int(re.match(r"\d+", bits[0])[0]), bonds + int(re.match(r"\d+", bits[1])[0])
    bonds += linkage == "p-"
    return f"{_head(kind)}{carbons}:{bonds}{';O' if oxygens else ''}{oxygens if oxygens > 1 else ''})"


def _chain_order(chain: str) -> tuple[int, str]:
    """Chains with more hydroxyl groups first, plain ones last."""
    return ("tdm".find(chain[:1]) if chain[:1] in "tdm" and chain else 3), chain


def molecular_species(name: str | None) -> str | None:
    """The class with its chains in order, where positions are unknown; ether PC and PE go to their species."""
    own = parsed(name)
    if own is None:
        return name
    kind, chains, _ = own
    if _head(kind) != f"{kind}(":
        return species(name)
    linkage, plain = "", []
    for chain in chains:
        head, dash, rest = chain.partition("-")
        if dash and "-" not in rest:
            linkage, chain = head + "-", rest
        plain.append(chain)
    return f"{kind}({linkage}{'_'.join(sorted(plain, key=_chain_order))})"


def without_positions(name: str | None) -> str | None:
    """Level 5: positions before oxygen groups and double-bond geometry left out."""
    own = parsed(name)
    if own is None:
        return name
    start = name.index("(")
    chains = [re.sub(r";[\d,]*", ";", re.sub(r"\((?:\d+[EZ],?)+\)", "", c)) for c in own[1]]
    return f"{name[:start]}({'/'.join(chains)})"


def sn_positions(name: str | None) -> str | None:
    """Level 4: chains by position, oxygen groups as counts."""
    own = parsed(name)
    if own is None:
        return name
    start, chains = name.index("("), []
    for chain in own[1]:
        base, *groups = re.sub(r"\((?:\d+[EZ],?)+\)", "", chain).split(";")
        count = 0
        for group in groups:
            listed, many = re.match(r"([\d,]*)", group)[1], re.search(r"\)(\d+)$|^O(\d+)$", group)
            each = 2 if "OO" in group or "COOH" in group else 1
            count += int(many[1] or many[2]) if many else each * max(len([x for x in listed.split(",") if x]), 1)
        chains.append(base + (";O" + (str(count) if count > 1 else "") if count else ""))
    return f"{name[:start]}({'/'.join(chains)})"


def lipid_class(name: str | None) -> str | None:
    own = parsed(name)
    return name if own is None else own[0]


def from_riken(name: str | None) -> str | None:
    """The name with an ether chain marked o- and an oxidised fatty acid written out; others than two chains stay."""
    own = parsed(name)
    if own is None or len(own[1]) != 2:
        return name
    one, two = own[1]
    one = "o-" + one.rstrip("e") if "e" in one else one
    found = re.match(r"([\d,()A-Za-z]*?)-?([A-Za-z]+)$", two)
    chain = two.rpartition("-")[2]
    if found and chain in OXIDISED:
        positions = re.match(r"[^,-]*", two)[0]
        base, group = OXIDISED[chain]
        two = f"{base};{positions}{group}"
    return f"{own[0]}({one}/{two})"


SUMMARIES = {1: lipid_class, 2: species, 3: molecular_species, 4: sn_positions, 5: without_positions}


def summary(name: Column, level: int) -> Column:
    """The name at a level of detail: 1 class, 2 species, 3 molecular species, 4 positions, 5 structure. Null stays null."""
    kernel = SUMMARIES[level]
    run = F.pandas_udf(lambda s: s.map(kernel, na_action="ignore"), T.StringType())
    return run(name)


def components(name: Column) -> Column:
    """Struct of lipid_class, chains, level of ``Class(chain/chain)``; all null without brackets."""
    inner = F.regexp_extract(name, r"\((.*)\)", 1)
    chains = F.split(inner, "/")
    linkage = F.when(inner.startswith("o-"), "Alkyl_").when(inner.startswith("p-"), "Alkenyl_").otherwise("")
    level_of = lambda c: F.when(c.rlike("|".join(re.escape(m) for m in _OXYGEN)), 5).when(c.rlike(r";[0-9]+"), 6).otherwise(4)
    level = F.aggregate(chains, F.lit(4), lambda held, c: F.when(level_of(c) == 4, held).otherwise(level_of(c)))
    whole = name.rlike(r"\(.*\)")
    kind = F.concat(linkage, F.regexp_extract(name, r"^([^(]*)", 1))
    return F.struct(F.when(whole, kind).alias("lipid_class"), F.when(whole, chains).alias("chains"), F.when(whole, level).alias("level"))


def species_sums(name: Column) -> Column:
    """Species of names whose chains are plain ``carbons:bonds``, in expressions alone; null for others."""
    chains = F.split(F.regexp_extract(name, r"^[^(]*\(([^)]*)\)$", 1), "/")
    plain = F.forall(chains, lambda c: c.rlike(r"^\d+:\d+$"))
    add = lambda k: F.aggregate(chains, F.lit(0), lambda s, c: s + F.get(F.split(c, ":"), F.lit(k)).try_cast("int"))
    return F.when(plain, F.concat(F.regexp_extract(name, r"^([^(]*)", 1), F.lit("("), add(0).cast("string"), F.lit(":"), add(1).cast("string"), F.lit(")")))


def converted(name: Column) -> Column:
    run = F.pandas_udf(lambda s: s.map(from_riken, na_action="ignore"), T.StringType())
    return run(name)


def level_key(level: Column) -> Column:
    table = F.create_map(*[x for k, v in LEVEL_KEYS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, level), F.lit("UNKNOWN"))


def frame(names: list[str]) -> pd.DataFrame:
    """All summaries of some names, for inspection."""
    return pd.DataFrame({f"level_{k}": [f(n) for n in names] for k, f in SUMMARIES.items()}, index=names)
