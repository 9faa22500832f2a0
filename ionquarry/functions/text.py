"""Strings, identifiers, encoded parameters and label tags as column expressions. A null argument gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
# Marks at the start of a fragment label
TAGS = {"*": "diagnostic", "@": "sn1", "$": "sn2", "!": "sn3", "^": "sn4", "&": "oxidation"}


def replace_all(text: Column, part: str, by: str) -> Column:
    return F.replace(text, F.lit(part), F.lit(by))


def contains_ignoring_case(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def equal_ignoring_case(one: Column, other: Column) -> Column:
    return F.lower(one) == F.lower(other)


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def replaced_in_quotes(text: Column, part: str, by: str) -> Column:
    """``part`` replaced where it stands between a pair of double quotes; an unpaired last quote opens none."""
    pieces = F.split(text, '"', -1)
    last = F.size(pieces) - 1
    inside = lambda i: (i % 2 == 1) & (i < last)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(inside(i), F.replace(p, F.lit(part), F.lit(by))).otherwise(p)), '"')


def leading_number(text: Column) -> Column:
    """The number that the text starts with, as a double; 0 without one."""
    return F.coalesce(F.regexp_extract(text, NUMBER, 1).try_cast("double"), F.lit(0.0))


def base_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def clean_name(path: Column) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def parameters(encoded: Column) -> Column:
    """Map of ``{key=value;...}``; entries without a key are left out, the last one of equal keys stays."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(encoded), r"^\{", ""), r"\}$", "")
    entries = F.filter(F.split(inner, ";"), lambda e: F.instr(e, "=") > 1)
    pairs = F.transform(entries, lambda e: F.struct(F.substring_index(e, "=", 1).alias("key"), F.regexp_replace(e, r"^[^=]*=", "").alias("value")))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"])))


def parameter_list(encoded: Column) -> Column:
    """Values of ``{a;b;...}``, empty ones left out."""
    return F.filter(F.split(F.regexp_replace(F.trim(encoded), r"^\{|\}$", ""), ";"), lambda e: e != "")


def encoded_floats(values: Column, digits: int = 4) -> Column:
    """``[a, b, ...]`` with so many decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.format_string(f"%.{digits}f", v.cast("double"))), ", "), F.lit("]"))


def removed_mz(text: Column) -> Column:
    """The m/z of a list that commas part; what is no number is left out."""
    return F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double")), lambda v: v.isNotNull())


def srm_precursor(line: Column) -> Column:
    """The m/z before the bracket of a filter line, as in ``... ms2 180.1 [79.9-80.1]``."""
    return F.regexp_extract(line, r"(\d+\.?\d*)(?:@\S+)?\s*\[", 1).try_cast("double")


def srm_product(line: Column) -> Column:
    """The middle of the bracketed range of a filter line."""
    low, high = (F.regexp_extract(line, r"\[(\d+\.?\d*)-(\d+\.?\d*)", k).try_cast("double") for k in (1, 2))
    return (low + high) / 2


def srm_name(line: Column) -> Column:
    """What follows ``name=``, up to a blank or semicolon; empty without it."""
    return F.regexp_extract(line, r"name=([^;\s]+)", 1)


def srm_energy(line: Column) -> Column:
    """The number that follows ``ce=`` or ``@cid``, or null."""
    return F.regexp_extract(line, r"(?:ce=|@cid)(\d+\.?\d*)", 1).try_cast("double")


def srm_key(precursor: Column, product: Column, name: Column | None = None) -> Column:
    """``(q1, q3)`` or ``(q1, q3, name)`` with two decimals; a null name counts as none."""
    plain = F.format_string("(%.2f, %.2f)", precursor, product)
    return plain if name is None else F.when(F.coalesce(name, F.lit("")) == "", plain).otherwise(F.format_string("(%.2f, %.2f, %s)", precursor, product, name))


def label_tags(label: Column) -> Column:
    """The distinct kinds of tags before the parts of a label, in order; slashes part a label."""
    table = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    marks = F.transform(F.split(label, "/"), lambda p: F.filter(F.split(F.regexp_extract(p, r"^([*@$!^&]*)", 1), ""), lambda c: c != ""))
    return F.array_sort(F.array_distinct(F.transform(F.flatten(marks), lambda c: F.element_at(table, c))))


def has_tag(label: Column, kind: str) -> Column:
    return F.array_contains(label_tags(label), kind)


def without_tags(label: Column) -> Column:
    """The label's parts without their tags."""
    return F.array_join(F.transform(F.split(label, "/"), lambda p: F.regexp_replace(p, r"^[*@$!^&]+", "")), "/")


def summarized_id(names: Column, adduct: Column) -> Column:
    """``{a;b}adduct``: the id of a compound that stands for several, sorted."""
    return F.concat(F.lit("{"), F.array_join(F.array_sort(F.array_distinct(names)), ";"), F.lit("}"), adduct)


def summarized_names(identifier: Column) -> Column:
    """The names between the braces of a summarised id; the id itself without braces."""
    inner = F.regexp_extract(identifier, r"\{([^}]*)\}", 1)
    return F.when(inner != "", F.split(inner, ";")).otherwise(F.array(identifier))


def exact_mass_adducts(text: Column) -> Column:
    """Array of (exact_mass, adduct) of ``mass:adduct;...``; entries without a mass are left out."""
    parts = F.filter(F.split(text, ";"), lambda p: F.substring_index(p, ":", 1).try_cast("double").isNotNull() & (F.instr(p, ":") > 0))
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, ":", 1).cast("double").alias("exact_mass"), F.trim(F.substring_index(p, ":", -1)).alias("adduct")))


def toggled(labels: Column, label: str) -> Column:
    """``labels`` with ``label`` taken out if it is there, else put in; sorted."""
    return F.array_sort(F.when(F.array_contains(labels, label), F.array_remove(labels, label)).otherwise(F.array_append(labels, label)))


def cleared(labels: Column) -> Column:
    """``labels`` of which only those that matching set, @ and m, stay."""
    return F.filter(labels, lambda x: x.isin("@", "m"))


def marked(labels: Column, label: str) -> Column:
    """``labels`` marked good (g) or bad (b), which exclude each other; sorted."""
    other = {"g": "b", "b": "g"}[label]
    return F.array_sort(F.array_union(F.array_remove(labels, other), F.array(F.lit(label))))
