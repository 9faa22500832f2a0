"""Queries of chemistry, identification and file operators over the library, spectra, sequence and observed views.

Formulas, names and labels are derived from the columns, so that every row has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionquarry.functions import chem, lipids, peptides
from ionquarry.functions import isotopes as I
from ionquarry.functions import spectrum as S
from ionquarry.operators import envelopes, identification, infusion, matching, neural
from ionquarry.operators.written import shared_path, written
from ionquarry.plans.queries import _r, query
from ionquarry.plans.spectrum_queries import with_peaks
from ionquarry.sources import codecs, spectra_source, text_files, xml_files


def _size() -> Column:
    return F.col("expected_rt").cast("int")


def _formula() -> Column:
    return F.concat(F.lit("C"), _size().cast("string"), F.lit("H"), (2 * _size() + 2).cast("string"), F.lit("N2O3S"))


_MASS = f"(n * 12.0::DOUBLE + (2 * n + 2) * {chem.ELEMENTS['H']!r} + 2 * {chem.ELEMENTS['N']!r} + 3 * {chem.ELEMENTS['O']!r} + {chem.ELEMENTS['S']!r})"
_N = "(SELECT *, CAST(expected_rt AS INT) AS n FROM library)"


@query("library", f"SELECT compound_id, n AS carbons, CASE WHEN n = 1 THEN 'C' ELSE 'C' || n END || 'H' || (2 * n + 2) || 'N2O3S' AS written, round({_MASS}, 6) AS mass, CASE WHEN n = 1 THEN 'C' ELSE 'C' || n END || 'H' || (2 * n) || 'N2O2S' AS less_water, round({_MASS} - 2 * {chem.ELEMENTS['H']!r} - {chem.ELEMENTS['O']!r}, 6) AS less_mass FROM {_N}")
def compositions(rows):
    """Formulas read, written, weighed and lessened."""
    held = rows.select("compound_id", I.composition_of(_formula()).alias("a")).withColumn("less", I.combined_of(F.col("a"), F.create_map(F.lit("H"), F.lit(2).cast("long"), F.lit("O"), F.lit(1).cast("long")), -1))
    return held.select("compound_id", F.element_at("a", "C").cast("int").alias("carbons"), I.written_of(F.col("a")).alias("written"), _r(I.mass_of_atoms(F.col("a"))).alias("mass"), I.written_of(F.col("less")).alias("less_water"), _r(I.mass_of_atoms(F.col("less"))).alias("less_mass"))


_H, _NA, _ACN = chem.ELEMENTS["H"], chem.ELEMENTS["Na"], 2 * chem.ELEMENTS["C"] + 3 * chem.ELEMENTS["H"] + chem.ELEMENTS["N"]
_IONS = {"[M+H]+": (1, 1, _H), "[2M+Na]+": (2, 1, _NA), "[M-H]-": (1, -1, -_H), "[M+2H]2+": (1, 2, 2 * _H), "[M+ACN+H]+": (1, 1, _ACN + _H), "[M-2H]2-": (1, -2, -2 * _H), "[M]": (1, 0, 0.0)}
_ION_ROWS = ", ".join(f"('{n}', {m}, {z}, {a!r}::DOUBLE)" for n, (m, z, a) in _IONS.items())


@query("library", f"SELECT compound_id, adduct, molecules, charge, round(added - charge * {chem.ELECTRON!r}, 6) AS added, round(({_MASS} * molecules + added - charge * {chem.ELECTRON!r}) / CASE WHEN charge = 0 THEN 1 ELSE abs(charge) END, 6) AS mz FROM {_N}, (VALUES {_ION_ROWS}) a(adduct, molecules, charge, added)")
def adducts_parsed(rows):
    """Adduct names read as molecules, charge and added mass."""
    held = rows.select("compound_id", I.mass_of_atoms(I.composition_of(_formula())).alias("m"), F.explode(F.array(*[F.lit(n) for n in _IONS])).alias("adduct")).withColumn("a", I.adduct_of(F.col("adduct")))
    mz = (F.col("m") * F.col("a.molecules") + F.col("a.added")) / F.when(F.col("a.charge") == 0, 1).otherwise(F.abs("a.charge"))
    return held.select("compound_id", "adduct", F.col("a.molecules").cast("int").alias("molecules"), F.col("a.charge").cast("int").alias("charge"), _r("a.added").alias("added"), _r(mz).alias("mz"))


@query("library")
def isotope_table(rows):
    """Natural isotopes of each distinct formula as [M+H]+."""
    held = rows.select(_formula().alias("formula")).distinct()
    return held.select("formula", F.explode(I.isotopes_of(F.col("formula"), F.lit("[M+H]+"), least=1e-4)).alias("i")).select("formula", "i.name", _r("i.mz").alias("mz"), _r("i.abundance", 9).alias("abundance"), _r("i.proportion", 9).alias("proportion"), "i.neutrons")


@query("library")
def isotope_neutrons(rows):
    """Isotopes of equal neutrons as one."""
    held = rows.select(_formula().alias("formula")).distinct()
    return held.select("formula", F.explode(I.isotopes_of(F.col("formula"), F.lit("[M-H]-"), least=1e-4, merge=True)).alias("i")).select("formula", "i.name", _r("i.mz").alias("mz"), _r("i.abundance", 9).alias("abundance"), "i.neutrons")


@query("library", """SELECT n AS size, c, k, round(exp(lgamma(n + 1) - lgamma(c + 1) - lgamma(n - c + 1)) * pow(0.0107, c) * pow(0.9893, n - c) * exp(lgamma(3) - lgamma(k + 1) - lgamma(3 - k)) * pow(0.00368, k) * pow(0.99632, 2 - k), 9) AS abundance
  FROM (SELECT DISTINCT CAST(expected_rt AS INT) AS n FROM library), (SELECT CAST(unnest(range(3)) AS INT) AS c), (SELECT CAST(unnest(range(3)) AS INT) AS k) WHERE c <= n""")
def isotope_labels(rows):
    """All counts of up to two 13C and two 15N, by binomial abundance."""
    held = rows.select(_size().alias("size"), _formula().alias("formula")).distinct()
    each = held.select("size", F.explode(I.isotopes_of(F.col("formula"), F.lit("[M]"), {"C": 2, "N": 2})).alias("i"))
    count = lambda mark: F.coalesce(F.regexp_extract("i.name", rf"\[{mark}\](\d+)", 1).try_cast("int"), F.lit(0))
    return each.select("size", count("13C").alias("c"), count("15N").alias("k"), _r("i.abundance", 9).alias("abundance"))


@query("library")
def formula_prediction(rows):
    """Formulas of each distinct mass within 5 ppm."""
    held = rows.select(_r(I.mass_of_atoms(I.composition_of(_formula())), 4).alias("mass")).distinct()
    bounds = {"C": (0, 60), "H": (0, 130), "N": (0, 4), "O": (0, 8), "S": (0, 2)}
    return held.select("mass", F.explode(I.formulas_of(F.col("mass"), 5, bounds)).alias("f")).select("mass", "f.formula", _r("f.ppm", 3).alias("ppm"))


@query("library", "SELECT element, mass_number, mass, abundance, neutrons FROM (VALUES " + ", ".join(f"('{e}', {n}, {m!r}::DOUBLE, {a!r}::DOUBLE, {k})" for e, kinds in I.ISOTOPES.items() for n, m, a, k in kinds) + ") t(element, mass_number, mass, abundance, neutrons)")
def natural_abundances(rows):
    """The table of isotopes."""
    return I.natural_abundances(rows.sparkSession)


@query("spectra")
def charge_states(rows):
    """Charges of peaks in a spectrum whose steps fit 13C at charges 1 to 5."""
    held = with_peaks(rows).select("spectrum_id", F.transform("s", lambda p, i: F.struct((500 + i * 1.00335483521 / 2).alias("mz"), (p["intensity"] / (i + 1)).alias("intensity"))).alias("s"))
    return held.select("spectrum_id", F.posexplode(I.charges_of(F.col("s"), 5)).alias("peak", "charge")).filter("charge > 0")


@query("spectra")
def isotope_patterns(rows):
    held = with_peaks(rows).select("spectrum_id", F.transform("s", lambda p, i: F.struct((500 + i * 1.00335483521 / 2).alias("mz"), p["intensity"].alias("intensity"))).alias("s"))
    return held.select("spectrum_id", F.explode(I.pattern_of(F.col("s"), F.lit(501.00335), 10, 1)).alias("i")).select("spectrum_id", "i.k", _r("i.mz").alias("mz"), _r("i.intensity").alias("intensity"))


@query("spectra")
def c13_envelopes(rows):
    held = with_peaks(rows).select("spectrum_id", F.transform("s", lambda p, i: F.struct((500 + i * 1.00335483521).alias("mz"), p["intensity"].alias("intensity"))).alias("s"))
    return held.select("spectrum_id", F.explode(I.envelope_of(F.col("s"), F.lit(20), F.lit(500.0), 10)).alias("i")).select("spectrum_id", "i.k", _r("i.mz").alias("mz"), _r("i.expected", 9).alias("expected"))


@query("spectra")
def charge_deconvolution(rows):
    """Neutral masses of spectra that hold one mass at consecutive charges."""
    proton = chem.ELEMENTS["H"] - chem.ELECTRON
    held = with_peaks(rows).select("spectrum_id", S.by_mz(F.transform(F.slice("s", 1, 8), lambda p, i: F.struct((10_000.0 / (i + 5) + proton).alias("mz"), p["intensity"].alias("intensity")))).alias("s"))
    return held.select("spectrum_id", F.explode(I.deconvoluted_of(F.col("s"), 5)).alias("d")).select("spectrum_id", _r("d.mass", 4).alias("mass"), "d.peaks", _r("d.intensity").alias("intensity"))


def _lipid() -> Column:
    c = F.col("compound_id")
    plain = F.concat(F.lit("PC("), (14 + c % 9).cast("string"), F.lit(":"), (c % 3).cast("string"), F.lit("/"), (16 + c % 7).cast("string"), F.lit(":"), (c % 5).cast("string"), F.lit(")"))
    return F.when(c % 4 == 0, F.concat(F.lit("Cer(d18:1/"), (16 + c % 9).cast("string"), F.lit(":0)"))).when(c % 4 == 1, F.concat(F.lit("PE(p-16:0/"), (18 + c % 5).cast("string"), F.lit(":2;O2)"))).otherwise(plain)




@query("library", """SELECT compound_id, CASE compound_id % 4 WHEN 0 THEN 'Cer(' || (34 + compound_id % 9) || ':1;O2)' WHEN 1 THEN 'PE(o-' || (34 + compound_id % 5) || ':3;O2)' ELSE 'PC(' || (30 + compound_id % 9 + compound_id % 7) || ':' || (compound_id % 3 + compound_id % 5) || ')' END AS species,
  CASE compound_id % 4 WHEN 0 THEN 'Cer' WHEN 1 THEN 'Alkenyl_PE' ELSE 'PC' END AS lipid_class, CASE WHEN compound_id % 4 IN (0, 1) THEN NULL ELSE 'PC(' || (30 + compound_id % 9 + compound_id % 7) || ':' || (compound_id % 3 + compound_id % 5) || ')' END AS plain_species,
  4 AS level, true AS parsed FROM library""")
def lipid_species(rows):
    """Species and class of lipid names, their level of detail, and the species by expressions alone."""
    name = _lipid()
    own = lipids.components(name)
    return rows.select("compound_id", lipids.summary(name, 2).alias("species"), own["lipid_class"].alias("lipid_class"), lipids.species_sums(name).alias("plain_species"), own["level"].alias("level"), own["chains"].isNotNull().alias("parsed"))


@query("library", """SELECT compound_id, 'PC(' || least(a, b) || '_' || greatest(a, b) || ')' AS molecular, 'PC(' || a || '/' || b || ')' AS by_position, 'acylChainLengthSummary' AS key FROM (SELECT compound_id, (14 + compound_id % 9) || ':' || (compound_id % 3) AS a, (16 + compound_id % 7) || ':' || (compound_id % 5) AS b FROM library)""")
def lipid_levels(rows):
    """Molecular species, positions, and the key of a level."""
    c = F.col("compound_id")
    name = F.concat(F.lit("PC("), (14 + c % 9).cast("string"), F.lit(":"), (c % 3).cast("string"), F.lit("/"), (16 + c % 7).cast("string"), F.lit(":"), (c % 5).cast("string"), F.lit(")"))
    return rows.select("compound_id", lipids.summary(name, 3).alias("molecular"), lipids.summary(name, 4).alias("by_position"), lipids.level_key(F.lit(2)).alias("key"))


@query("library", "SELECT compound_id, 'PC(o-16:0/20:4;' || (5 + compound_id % 10) || 'OH)' AS name FROM library")
def lipid_conversions(rows):
    """A library's short name of an oxidised lipid written out."""
    return rows.select("compound_id", lipids.converted(F.concat(F.lit("PC(16:0e/"), (5 + F.col("compound_id") % 10).cast("string"), F.lit("-HETE)"))).alias("name"))


def _residues(rows: DataFrame) -> DataFrame:
    """The first letters of each text as a protein; letters that are no residues are left out."""
    return rows.select("sequence_id", F.upper(F.regexp_replace(F.coalesce("residues", F.lit("")), "[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]", "")).alias("residues"))


@query("sequences")
def digest(rows):
    """Tryptic peptides, up to three neighbouring pieces, of every whole text."""
    return peptides.digest_rows(_residues(rows)).groupBy("peptide").agg(F.count(F.lit(1)).alias("places"), F.min("sequence_id").alias("first_sequence"))


def _peptides(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat(F.translate(F.upper(F.regexp_replace("name", "[^A-Za-z]", "")), "BJOUXZ", "AGDSTV"), F.lit("K")).alias("peptide")).distinct().filter(F.length("peptide").between(5, 30))


@query("library")
def peptide_properties(rows):
    """Mass, m/z, cleavages, isoelectric point, modifications."""
    each = _peptides(rows).withColumn("form", F.explode(peptides.forms(F.col("peptide"), tmt=True)))
    p = each.withColumn("p", peptides.properties(F.concat(F.lit("K."), F.col("form"), F.lit(".A/2"))))
    return p.select("form", "p.residues", _r("p.mass", 4).alias("mass"), _r("p.average_mass", 3).alias("average_mass"), _r("p.mz", 4).alias("mz"), "p.missed", "p.ends", _r("p.point", 3).alias("point"), F.array_join("p.mods", ",").alias("mods"), peptides.with_modification_names(F.col("form")).alias("named"))


@query("library", """, p AS (SELECT DISTINCT translate(upper(regexp_replace(name, '[^A-Za-z]', '', 'g')), 'BJOUXZ', 'AGDSTV') || 'K' AS peptide FROM library)
  SELECT peptide, peptide AS stripped, len(regexp_extract_all(peptide, '[KR][^P]')) AS missed, reverse(peptide) AS reversed FROM (SELECT * FROM p WHERE length(peptide) BETWEEN 5 AND 30)""")
def peptide_strings(rows):
    """Plain residues, missed cleavages and reversed sequences, by expressions."""
    p = F.col("peptide")
    return _peptides(rows).select("peptide", peptides.stripped(F.concat(F.lit("K."), F.regexp_replace(p, "C", "C[160]"), F.lit(".A/2"))).alias("stripped"), peptides.missed(p).cast("long").alias("missed"), peptides.reversed_sequence(p).alias("reversed"))


@query("library")
def peptide_ions(rows):
    """Fragment ions with losses."""
    each = _peptides(rows).select("peptide", F.explode(peptides.ions(F.col("peptide"), 3)).alias("i"))
    return each.select("peptide", "i.name", _r("i.mz", 4).alias("mz"), "i.charge", "i.prominence")


@query("library")
def peptide_ions_etd(rows):
    each = _peptides(rows).select("peptide", F.explode(peptides.ions(F.col("peptide"), 2, "cz")).alias("i"))
    return each.select("peptide", "i.name", _r("i.mz", 4).alias("mz"), "i.prominence")


@query("library")
def peptide_decoys(rows):
    return _peptides(rows).select("peptide", peptides.decoy(F.col("peptide"), 7).alias("decoy"))


@query("sequences")
def protein_truncations(rows):
    """Stretches of each whole text that weigh one of two masses."""
    return peptides.truncations(_residues(rows), [1500.7, 2750.3], 0.005).withColumn("mass", _r("mass", 4))


@query("sequences", r"""SELECT sequence_id, '>seq' || sequence_id || chr(10) || regexp_replace(s, '(.{60})', '\1' || chr(10), 'g') AS record, s AS back FROM (SELECT sequence_id, upper(regexp_replace(coalesce(residues, ''), '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '', 'g')) AS s FROM sequences) WHERE s <> '' AND length(s) % 60 <> 0
  UNION ALL SELECT sequence_id, '>seq' || sequence_id || chr(10) || rtrim(regexp_replace(s, '(.{60})', '\1' || chr(10), 'g'), chr(10)) AS record, s AS back FROM (SELECT sequence_id, upper(regexp_replace(coalesce(residues, ''), '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '', 'g')) AS s FROM sequences) WHERE s <> '' AND length(s) % 60 = 0""")
def fasta_round_trip(rows):
    """FASTA records of whole texts, and what reading them gives."""
    text = text_files.fasta_text(F.concat(F.lit("seq"), F.col("sequence_id").cast("string")), F.col("residues"), 60)
    records = _residues(rows).filter("residues <> ''").select(text.alias("record"), F.substring(text, 2, 2**31 - 1).alias("value"))
    back = text_files.fasta_records(records.select("value")).select(F.regexp_extract("header", r"(\d+)", 1).cast("long").alias("sequence_id"), F.col("sequence").alias("back"))
    return records.select(F.regexp_extract("record", r"^>seq(\d+)", 1).cast("long").alias("sequence_id"), "record").join(back, "sequence_id")


@query("spectra", "SELECT spectrum_id, count(*) AS peaks, round(sum(round(abs(v), 4)), 3) AS total, 500.25::DOUBLE AS precursor_mz, 2 AS charge, 1.5::DOUBLE AS rt FROM (SELECT spectrum_id, unnest(intensity) AS v FROM spectra) GROUP BY 1")
def mgf_round_trip(rows):
    """MGF records read back."""
    text = S.mgf(F.col("s"), F.col("spectrum_id").cast("string"), F.lit(500.25), F.lit(1.5), F.lit(2))
    back = text_files.mgf_records(with_peaks(rows).select(text.alias("value")))
    return back.select(F.col("title").cast("long").alias("spectrum_id"), F.size("spectrum").cast("long").alias("peaks"), _r(S.total(F.col("spectrum")), 3).alias("total"), "precursor_mz", "charge", "rt")


@query("spectra", "SELECT spectrum_id, len(intensity) AS values, round(list_sum(intensity), 4) AS total, round(list_sum(intensity), 4) AS zipped, true AS inflated FROM spectra")
def base64_round_trip(rows):
    """Float arrays as base64, plain and compressed, read back; bytes deflated and inflated."""
    y = F.col("intensity")
    total = lambda a: _r(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 4)
    plain, zipped = codecs.decoded_floats(codecs.encoded_floats(y, 64), 64), codecs.decoded_floats(codecs.encoded_floats(y, 64, True, True), 64, True, True)
    data = F.col("spectrum_id").cast("string").cast("binary")
    return rows.select("spectrum_id", F.size(plain).cast("long").alias("values"), total(plain).alias("total"), total(zipped).alias("zipped"), (codecs.inflated(codecs.deflated(data)) == data).alias("inflated"))


@query("observed", "SELECT order_id, count(*) AS points, 1 AS mslevel, round(sum(intensity), 4) AS total, round(min(mz), 6) AS first_mz FROM observed GROUP BY 1")
def mzcsv_round_trip(rows):
    """Scans as mzCSV rows and the rows as scans."""
    scans = rows.groupBy(F.col("order_id").alias("scan_id")).agg(F.min("rt").alias("rt"), F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("spectrum"))
    held = scans.select("scan_id", "rt", "spectrum", F.lit(1).alias("mslevel"), F.lit(None).cast("double").alias("precursor_mz"), F.lit(1).alias("polarity"), F.lit(None).cast("string").alias("filter_line"))
    lines = text_files.mzcsv_lines(held)
    back = lines.groupBy("scannum").agg(F.count(F.lit(1)).alias("points"), F.max("mslevel").alias("mslevel"), _r(F.sum("intensity"), 4).alias("total"), _r(F.min("mz")).alias("first_mz"))
    return back.select((F.col("scannum") - 1).cast("long").alias("order_id"), "points", "mslevel", "total", "first_mz")


@query("signal", "SELECT channel AS sample, scan_id, count(*) AS points, min(mz) AS first_mz, round(sum(intensity), 4) AS total, round(min(rt), 6) AS rt FROM signal WHERE intensity IS NOT NULL GROUP BY 1, 2")
def spectra_files(points):
    """Scans written as indexed mzML files, one for each channel, and read back by ranges of bytes."""
    held = points.filter("intensity IS NOT NULL").groupBy(F.col("channel").alias("sample"), "scan_id").agg(F.min("rt").alias("rt"), F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("s"))
    given = {"mslevel": F.lit(1), "polarity": F.lit(1), "mz": F.col("s.mz"), "intensity": F.col("s.intensity")}
    names = [c.split()[0] for c in xml_files.SCANS.split(", ")]
    scans = held.select(*[given.get(c, F.col(c) if c in held.columns else F.lit(None)).alias(c) for c in names])
    path = shared_path(points.sparkSession, "spectra")
    spectra_source.write_spectra(scans, path)
    back = spectra_source.read_spectra(points.sparkSession, path, 1 << 20)
    return back.select("sample", "scan_id", F.size("mz").cast("long").alias("points"), F.array_min("mz").alias("first_mz"), _r(F.aggregate("intensity", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), _r("rt").alias("rt"))


def _pairs(rows: DataFrame) -> DataFrame:
    """Each spectrum as an observed one and the next as a library one, m/z moved by a little."""
    held = with_peaks(rows)
    moved = F.transform("s", lambda p, i: F.struct((p["mz"] + (i % 7) * 0.001).alias("mz"), p["intensity"].alias("intensity")))
    follow = held.select((F.col("spectrum_id") - 1).alias("spectrum_id"), F.filter(moved, lambda p: p["intensity"] > 0.02).alias("library"))
    return held.withColumn("s", F.filter("s", lambda p: p["intensity"] > 0.03)).join(follow, "spectrum_id")


@query("spectra")
def greedy_match(rows):
    """One-to-one matches within 0.0035 Da."""
    found = _pairs(rows).select("spectrum_id", F.posexplode(matching.matched(F.col("library"), F.col("s"), F.lit(0.0035))).alias("place", "observed"))
    return found.filter("observed >= 0")


@query("spectra")
def located_peaks(rows):
    """The best observed peak of each library peak; several may share one."""
    return _pairs(rows).select("spectrum_id", F.posexplode(matching.located(F.col("library"), F.col("s"), 10)).alias("place", "observed")).filter("observed >= 0")


@query("spectra")
def spectrum_match_scores(rows):
    """All scores of each spectrum against the next one."""
    scores = _pairs(rows).select("spectrum_id", matching.scored(F.col("library"), F.col("s"), F.lit(700.0), F.lit(700.001), 5).alias("x"))
    return scores.select("spectrum_id", "x.matches", *[_r(f"x.{n}").alias(n) for n in matching.SCORES])


def _scans(rows: DataFrame) -> DataFrame:
    moved = F.transform("s", lambda p, i: F.struct((p["mz"] + F.col("spectrum_id") % 5 * 0.0004).alias("mz"), p["intensity"].alias("intensity")))
    return with_peaks(rows).select("cluster", "spectrum_id", moved.alias("spectrum"), F.lit(700.0).alias("precursor_mz"), (F.col("spectrum_id") % 3).alias("collision_energy"), F.col("spectrum_id").alias("scan_id"), F.lit(0.9).alias("purity"), F.col("spectrum_id").cast("double").alias("rt"))


@query("spectra")
def consensus_spectrum(rows):
    """One spectrum of each cluster's."""
    found = matching.consensus_of(_scans(rows), ["cluster"], "spectrum_id", 5, "median", least_scans=2, least_fraction=0.1, to=10_000.0)
    return found.select("cluster", "spectra", _r("rt", 3).alias("rt"), _r("purity", 3).alias("purity"), F.size("spectrum").alias("peaks"), F.explode("spectrum").alias("p")).select("cluster", "spectra", "rt", "purity", "peaks", _r("p.mz", 5).alias("mz"), _r("p.intensity", 3).alias("intensity"), "p.observed")


@query("spectra")
def consensus_by_energy(rows):
    """Consensus of each collision energy, then over the energies."""
    found = matching.loop_injection(_scans(rows), ["cluster"], 5)
    return found.select("cluster", "spectra", F.explode("spectrum").alias("p")).select("cluster", "spectra", _r("p.mz", 5).alias("mz"), _r("p.intensity", 4).alias("intensity"))


def _library_spectrum() -> Column:
    c = F.col("compound_id")
    return F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.struct((100 + i * 10 + c % 3 * 0.0005).cast("double").alias("mz"), ((i * 37 + c) % 101 + 1.0).cast("double").alias("intensity")))


def _groups(rows: DataFrame) -> DataFrame:
    c = F.col("compound_id")
    spectrum = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.struct((100 + i * 10.0).cast("double").alias("mz"), ((i * 37 + c) % 101 + 1.0).cast("double").alias("intensity")))
    return rows.filter(F.col("expected_rt") > 25).select(c.alias("group_id"), F.col("precursor_mz").alias("mz"), F.col("expected_rt").alias("rt"), spectrum.alias("spectrum"))


@query("library")
def lipid_search(rows):
    """Groups against library compounds within 2 ppm: best match by score, cosine, name."""
    library = rows.select("compound_id", "name", "precursor_mz", "expected_rt", F.lit("PC").alias("lipid_class"), F.lit("[M+H]+").alias("adduct"), _library_spectrum().alias("library_spectrum"))
    allowed = library.filter("lipid_class = 'PC' AND adduct = '[M+H]+'")
    found = identification.best_of(_groups(rows), allowed, 2.0, 20.0, "plain", 0.1)
    return found.select("group_id", "compound_id", _r("score", 4).alias("score"), _r("cosine", 4).alias("cosine"), "label")


@query("library")
def metabolite_search(rows):
    library = rows.select("compound_id", "name", "precursor_mz", "expected_rt", _library_spectrum().alias("library_spectrum"))
    found = identification.best_of(_groups(rows), library, 2.0, 20.0, "cosine", 0.5, 3)
    return found.select("group_id", "compound_id", _r("score", 4).alias("score"), "label")


@query("library", "SELECT compound_id, CASE WHEN compound_id % 5 = 0 THEN 'agrees_range' WHEN expected_rt <= 0 THEN 'none' WHEN abs(20 - expected_rt) <= 5 THEN 'agrees_time' ELSE 'differs_time' END AS agreement FROM (SELECT compound_id, expected_rt FROM library)")
def rt_agreement(rows):
    """Retention-time agreement by the library's range or time."""
    low = F.when(F.col("compound_id") % 5 == 0, 10.0)
    return rows.select("compound_id", identification.rt_agreement(F.lit(20.0), F.col("expected_rt"), low, low + 15, 5.0, use_range=True).alias("agreement"))


@query("library", "SELECT compound_id, CASE WHEN category = 'Brand#1' AND compound_id % 2 = 0 THEN 5 WHEN category = 'Brand#1' THEN 3 ELSE 2 END AS least_matches FROM library")
def lipid_thresholds(rows):
    """Thresholds of class and adduct, of the class, or by default."""
    spark = rows.sparkSession
    table = spark.range(2).select(F.lit("Brand#1").alias("lipid_class"), F.when(F.col("id") == 0, "[M+H]+").otherwise("*").alias("adduct"), F.when(F.col("id") == 0, 5).otherwise(3).alias("least_matches"))
    held = rows.select("compound_id", F.col("category").alias("lipid_class"), F.when(F.col("compound_id") % 2 == 0, "[M+H]+").otherwise("[M-H]-").alias("adduct"))
    return identification.with_thresholds(held, table, ["least_matches"], {"least_matches": 2}).select("compound_id", "least_matches")


@query("library", """SELECT compound_id AS peptide, ligand, adduct, c13, round((precursor_mz + mass + c13 * 1.00335483521 + added) / 1, 6) AS mz FROM library, (VALUES ('', 0.0::DOUBLE), ('biotin', 226.0776)) l(ligand, mass), (VALUES ('[M+H]+', 1.00727646688::DOUBLE), ('[M+Na]+', 22.98922)) a(adduct, added), (SELECT CAST(unnest(range(3)) AS INT) AS c13)""")
def maldi_ions(rows):
    """Peptides with and without a ligand, by 13C count and adduct."""
    ligands = rows.sparkSession.range(1).select(F.lit("biotin").alias("ligand"), F.lit(226.0776).alias("mass"))
    found = identification.peptide_ligand_ions(rows.select(F.col("compound_id").alias("peptide"), F.col("precursor_mz").alias("mass")), ligands, [("[M+H]+", 1, 1, 1.00727646688), ("[M+Na]+", 1, 1, 22.98922)], 2)
    return found.withColumn("mz", _r("mz"))


@query("library", """SELECT compound_id, adduct, round((precursor_mz + added) / 1, 6) AS mz, CASE WHEN precursor_mz + added BETWEEN 900 AND 910 THEN 0 WHEN precursor_mz + added BETWEEN 908 AND 925 THEN 1 ELSE -1 END AS window_id FROM library, (VALUES ('[M+H]+', 1, 1.00727646688::DOUBLE), ('[M+Na]+', 1, 22.98922), ('[M-H]-', -1, -1.00727646688)) a(adduct, z, added) WHERE sign(z) = CASE WHEN compound_id % 2 = 0 THEN 1 ELSE -1 END""")
def infusion_search_set(rows):
    """Ions of compounds and adducts of one sign, in isolation windows."""
    spark = rows.sparkSession
    ions = [("[M+H]+", 1, 1.00727646688), ("[M+Na]+", 1, 22.98922), ("[M-H]-", -1, -1.00727646688)]
    adducts = spark.createDataFrame([(n, 1, z, a) for n, z, a in ions], "name string, molecules int, charge int, added double")
    windows = spark.createDataFrame([(0, 900.0, 910.0), (1, 908.0, 925.0)], "window_id int, low double, high double")
    compounds = rows.select("compound_id", F.col("precursor_mz").alias("exact_mass"), F.when(F.col("compound_id") % 2 == 0, 1).otherwise(-1).alias("charge"))
    return infusion.search_set(compounds, adducts, windows).withColumn("mz", _r("mz"))


_MATCHES = "(SELECT DISTINCT order_id AS compound, CAST(sample % 40 AS BIGINT) AS fragment FROM observed)"


def _matches(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("order_id").alias("compound"), (F.col("sample") % 40).cast("long").alias("fragment")).distinct()


@query("observed", f"SELECT DISTINCT compound FROM (SELECT compound, size, max(size) OVER (PARTITION BY fragment) AS largest FROM (SELECT *, count(*) OVER (PARTITION BY compound) AS size FROM {_MATCHES})) WHERE largest <= size")
def parsimony(rows):
    """Compounds that strictly larger sets don't cover."""
    return infusion.parsimonious(_matches(rows))


@query("observed", f"SELECT compound, fragment, holders AS compounds, holders = 1 AS is_unique FROM (SELECT *, count(*) OVER (PARTITION BY fragment % 7, compound % 11) AS holders FROM (SELECT DISTINCT compound, fragment FROM {_MATCHES})) WHERE false UNION ALL SELECT m.compound, m.fragment, f.n, f.n = 1 FROM {_MATCHES} m JOIN (SELECT fragment, count(DISTINCT compound) AS n FROM {_MATCHES} GROUP BY 1) f USING (fragment)")
def fragment_uniqueness(rows):
    """The number of compounds of each matched fragment."""
    return infusion.unique_evidence(_matches(rows)).select("compound", "fragment", "compounds", "is_unique")


@query("observed", f"SELECT array_to_string(f, ',') AS fragments, count(*) AS members, min(compound) AS first_member FROM (SELECT compound, list_sort(list(DISTINCT fragment)) AS f FROM {_MATCHES} GROUP BY 1) GROUP BY 1")
def fragment_groups(rows):
    """Compounds of identical fragment sets."""
    return infusion.fragment_sets(_matches(rows)).select(F.array_join("fragments", ",").alias("fragments"), F.size("members").cast("long").alias("members"), F.get("members", F.lit(0)).alias("first_member"))


@query("observed")
def fragment_summaries(rows):
    """Identical fragment sets, named by their summary."""
    held = _matches(rows)
    c = F.col("compound")
    compounds = held.select("compound").distinct().select(c, F.lit("[M+H]+").alias("adduct"), F.when(c % 2 == 0, F.lit("PC(16:0_18:1)")).alias("acyl_summary"), F.when(c % 3 == 0, F.lit("PC(34:1)")).alias("composition_summary"), (700 + c % 50).cast("double").alias("precursor_mz"), F.lit(1).alias("charge"))
    return infusion.summarised(held.withColumn("compound", c.cast("string")), compounds.withColumn("compound", c.cast("string"))).select("name", "type", F.size("members").alias("members"), _r("precursor_mz").alias("precursor_mz"), "charge")


@query("observed")
def partition_fractions(rows):
    """Shares of compounds in the fragments of their MS1 id, shared fragments adjusted."""
    held = rows.select((F.col("order_id") % 50).alias("ms1_id"), (F.col("order_id") % 50 * 10.0).alias("ms1_intensity"), F.col("order_id").alias("compound"), (F.col("sample") % 40).alias("fragment"), F.when(F.col("line") % 2 == 0, "@sn1").otherwise("other").alias("label"), "intensity")
    return infusion.partition_fractions(held, "sn1").withColumn("fraction", _r("fraction"))


@query("observed", """, m AS (SELECT order_id % 50 AS ms1_id, order_id AS compound, line AS scan_id, sum(intensity) AS y FROM observed GROUP BY ALL)
  SELECT ms1_id, compound, round(avg(y / t), 6) AS fraction FROM (SELECT *, sum(y) OVER (PARTITION BY ms1_id, scan_id) AS t FROM m) WHERE t > 0 GROUP BY 1, 2""")
def scan_fractions(rows):
    """Means over scans of each compound's share."""
    held = rows.groupBy((F.col("order_id") % 50).alias("ms1_id"), F.col("order_id").alias("compound"), F.col("line").alias("scan_id")).agg(F.sum("intensity").alias("intensity"))
    return infusion.scan_fractions(held).withColumn("fraction", _r("fraction"))


@query("observed", "SELECT fragment, round(sum(y), 4) AS ms1_sum FROM (SELECT DISTINCT sample % 40 AS fragment, order_id AS precursor, order_id % 50 * 10.0::DOUBLE AS y FROM observed) GROUP BY 1")
def fragment_ms1(rows):
    """The sum of the MS1 intensities of each fragment's compounds."""
    held = rows.select((F.col("sample") % 40).alias("fragment"), F.col("order_id").alias("precursor_mz"), (F.col("order_id") % 50 * 10.0).alias("ms1_intensity"))
    return infusion.fragment_ms1(held).withColumn("ms1_sum", _r("ms1_sum", 4))


@query("observed", """, p AS (SELECT sample, order_id % 200 AS compound, sum(intensity) AS y, max(mz) AS score FROM observed GROUP BY 1, 2)
  SELECT compound, round(avg(share), 6) AS proportion, count(*) AS samples, arg_max(sample, (score, -sample)) AS best_sample FROM (SELECT *, y / sum(y) OVER (PARTITION BY sample) AS share FROM p) GROUP BY 1""")
def average_proportions(rows):
    """Mean share of each compound over the samples that have it."""
    held = rows.groupBy(F.col("sample").alias("sample_id"), (F.col("order_id") % 200).alias("compound")).agg(F.sum("intensity").alias("intensity"), F.max("mz").alias("score")).withColumn("adduct", F.lit("[M+H]+"))
    return infusion.average_proportions(held).select("compound", _r("proportion").alias("proportion"), "samples", "best_sample")


@query("observed", """, p AS (SELECT line AS compound, sample % 3 AS width, CAST(rt % 4 AS INT) AS distance, intensity AS q, mz AS s FROM observed), r AS (SELECT *, q / s AS x FROM (SELECT *, dense_rank() OVER (PARTITION BY compound ORDER BY distance, width) AS k FROM p WHERE q > 0 AND s > 0) WHERE k = 1), m AS (SELECT compound, median(x) AS normalised, count(*) AS scans FROM r GROUP BY 1)
  SELECT compound, round(any_value(normalised), 9) AS normalised, any_value(scans) AS scans, round(median(abs(x - normalised)), 9) AS deviation FROM r JOIN m USING (compound) GROUP BY 1""")
def normalised_quant(rows):
    """Median of query over standard, and its median deviation."""
    held = rows.select(F.col("line").alias("compound"), (F.col("sample") % 3).alias("width"), (F.col("rt") % 4).cast("int").alias("distance"), F.col("intensity").alias("query"), F.col("mz").alias("standard"))
    return infusion.normalised_quant(held).select("compound", _r("normalised", 9).alias("normalised"), "scans", _r("deviation", 9).alias("deviation"))


@query("library", "SELECT compound_id, window_id FROM (SELECT compound_id, w.window_id, row_number() OVER (PARTITION BY compound_id ORDER BY high - low, abs((high + low) / 2 - precursor_mz), w.window_id) AS r FROM library JOIN (SELECT window_id, 900.0::DOUBLE + window_id AS low, 903.0::DOUBLE + window_id + window_id % 4 AS high FROM (SELECT unnest(range(30)) AS window_id)) w ON precursor_mz BETWEEN low AND high) WHERE r = 1")
def best_windows(rows):
    """The narrowest, most central scan window that holds an m/z."""
    w = F.col("id")
    windows = rows.sparkSession.range(30).select(w.alias("window_id"), (900.0 + w).alias("low"), (903.0 + w + w % 4).alias("high"))
    return infusion.best_windows(rows.select(F.col("compound_id").alias("query_id"), F.col("precursor_mz").alias("mz")), windows).select(F.col("query_id").alias("compound_id"), "window_id")


@query("library", "SELECT compound_id, compound_id % 3 = 0 AS agrees FROM library")
def diagnostic_agreement(rows):
    """Whether matched labels hold the required tags."""
    found = F.when(F.col("compound_id") % 3 == 0, F.array(F.lit("*a"), F.lit("@b"), F.lit("*@c"))).otherwise(F.array(F.lit("*a"), F.lit("b")))
    required = F.create_map(F.lit("diagnostic"), F.lit(2), F.lit("sn1"), F.lit(2))
    return rows.select("compound_id", infusion.required_tags(infusion.tag_counts(found), required).alias("agrees"))


@query("observed")
def ms3_search(rows):
    """MS3 peaks against library fragments by three tolerances, and their summaries."""
    peaks = rows.filter("mz < 1000").select(F.col("order_id").alias("scan_id"), (700.0 + F.col("sample") % 3 * 0.001).alias("ms1_mz"), (300.0 + F.col("line") % 2 * 0.001).alias("ms2_mz"), "mz", "intensity")
    library = rows.sparkSession.range(40).select((F.col("id") % 8).alias("compound"), F.lit(700.0).alias("ms1_mz"), F.lit(300.0).alias("ms2_mz"), (900.0 + 2.0 * F.col("id")).alias("fragment"))
    found = infusion.ms3_matches(library, peaks, 10, 10, 0.5)
    return infusion.ms3_summary(found, peaks, 1, 0.0).withColumn("intensity", _r("intensity"))


@query("observed")
def ms3_groups(rows):
    held = rows.select((F.col("order_id") * 10 + F.col("line")).alias("scan_id"), F.col("mz").alias("ms1_mz"), (300.0 + F.col("sample") % 5).alias("ms2_mz"))
    return infusion.ms3_groups(held, 50).groupBy("group_id").agg(F.count(F.lit(1)).alias("scans"), _r(F.min("ms1_mz")).alias("ms1_mz"), F.min("ms2_mz").alias("ms2_mz"))


@query("observed", """, k AS (SELECT order_id AS parent, sample % 3 AS child, CAST(round(mz) AS BIGINT) AS key, mz, intensity, line FROM observed), n AS (SELECT parent, count(DISTINCT child) AS n FROM k GROUP BY 1)
  SELECT parent, round(round(mz), 6) AS mz, round(intensity, 6) AS intensity, labels FROM (SELECT parent, key, avg(round(mz)) AS mz, avg(intensity) AS intensity, count(DISTINCT child) AS c, array_to_string(list_sort(list(DISTINCT CAST(line AS VARCHAR))), '/') AS labels FROM k GROUP BY 1, 2) JOIN n USING (parent) WHERE c = n""")
def summed_compounds(rows):
    """Fragments that all children of a summary have."""
    held = rows.select(F.col("order_id").alias("parent"), (F.col("sample") % 3).alias("child"), F.round("mz").alias("mz"), "intensity", F.col("line").cast("string").alias("label"))
    return infusion.summed_compound(held).select("parent", _r("mz").alias("mz"), _r("intensity").alias("intensity"), "labels")


@query("observed", "SELECT order_id, line FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY intensity DESC, mz DESC, line) AS r FROM (SELECT order_id, line, CAST(floor(intensity / 10) AS INT) AS intensity, mz FROM observed)) WHERE r = 1")
def best_matches(rows):
    """Best candidate by score, dot product, name."""
    held = rows.select("order_id", "line", F.floor(F.col("intensity") / 10).alias("hypergeometric"), F.col("mz").alias("dot_product"), F.col("line").alias("name"))
    return infusion.best_matches(held, ["order_id"]).select("order_id", "line")


@query("observed", """SELECT order_id AS group_id, line, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY intensity / 50 * log10(line + 1) DESC, line) AS rank FROM observed WHERE mz BETWEEN 920 AND 2000 AND rt BETWEEN 100 AND 2000 AND abs(rt - 1000) <= 900 AND intensity / 50 >= 0.2) WHERE rank <= 2""")
def collected_ms2(rows):
    """The two best MS2 scans of each group by purity and peaks."""
    groups = rows.select(F.col("order_id").alias("group_id")).distinct().select("group_id", F.lit(920.0).alias("mzmin"), F.lit(2000.0).alias("mzmax"), F.lit(100.0).alias("rtmin"), F.lit(2000.0).alias("rtmax"), F.lit(1000.0).alias("rt"))
    scans = rows.select(F.col("order_id").alias("own"), F.col("line").alias("scan_id"), F.lit(0).alias("sample_id"), F.col("mz").alias("precursor_mz"), "rt", (F.col("intensity") / 50).alias("purity"), F.col("line").alias("peaks"))
    listed = scans.join(groups, F.col("own") == F.col("group_id")).select("group_id", "scan_id", "precursor_mz", scans["rt"], "purity", "peaks", "mzmin", "mzmax", "rtmin", "rtmax", groups["rt"].alias("group_rt"))
    inside = listed.filter("precursor_mz BETWEEN mzmin AND mzmax AND rt BETWEEN rtmin AND rtmax AND abs(rt - group_rt) <= 900 AND purity >= 0.2")
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc(F.col("purity") * F.log10(F.col("peaks") + 1)), "scan_id"))
    return inside.withColumn("rank", rank).filter("rank <= 2").select("group_id", F.col("scan_id").alias("line"), "rank")


@query("library")
def isotope_pull(rows):
    """Windows of each isotope of some formulas, and the signal-like points that fall into them."""
    held = rows.filter(F.col("expected_rt") <= 3).select(F.col("compound_id").alias("group_id"), _formula().alias("formula"), F.lit("[M+H]+").alias("adduct"), F.lit(None).cast("double").alias("mz"), F.lit(0.0).alias("rtmin"), F.lit(100.0).alias("rtmax"))
    windows = envelopes.isotope_windows(held, 10.0)
    points = windows.select("mz", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("scan_id"), "proportion", (F.col("group_id") % 3).alias("sample_id")).select("sample_id", F.col("scan_id").cast("long").alias("scan_id"), F.col("scan_id").cast("double").alias("rt"), "mz", (F.col("proportion") * (10 + F.col("scan_id"))).alias("intensity")).distinct()
    quant = envelopes.extracted(windows, points)
    found = envelopes.corrected(envelopes.enough_isotopes(quant, 2), windows)
    return found.select("group_id", "isotope", "sample_id", _r("intensity").alias("intensity"), _r("corrected").alias("corrected"), "apex_rt", "scans", "group_rank")


@query("library")
def isotope_children(rows):
    """Isotope groups of each compound, of the windows and signal-like points of all formulas."""
    held = rows.select(F.col("compound_id").alias("group_id"), _formula().alias("formula"), F.lit("[M+H]+").alias("adduct"), F.lit(None).cast("double").alias("mz"), F.lit(0.0).alias("rtmin"), F.lit(100.0).alias("rtmax"))
    leaders, members = envelopes.led(held)
    windows = written(envelopes.isotope_windows(leaders, 10.0))
    samples = members.select(F.col("leader").alias("group_id"), (F.col("group_id") % 3).alias("sample_id")).distinct()
    points = windows.join(samples, "group_id").select("sample_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("scan_id"), "mz", "proportion").select("sample_id", "scan_id", F.col("scan_id").cast("double").alias("rt"), "mz", (F.col("proportion") * (10 + F.col("scan_id") * F.col("scan_id"))).alias("intensity")).distinct()
    return envelopes.children(envelopes.correlated_extraction(windows, points), members=members).withColumn("max_intensity", _r("max_intensity"))


@query("spectra")
def network_scores(rows):
    """Forward runs of a small network with fixed random weights."""
    weights = neural.loaded(neural.saved(neural.initial([3, 4, 2], 5)))
    out = neural.scored(weights, [F.get("intensity", F.lit(k)) for k in range(3)])
    return rows.select("spectrum_id", _r(F.get(out, F.lit(0))).alias("first"), _r(F.get(out, F.lit(1))).alias("second"))
