import math

import pytest

from ionquarry.functions import chem, isotopes, lipids, peptides, smiles


def test_formulas():
    assert isotopes.composition("C6H12O6") == {"C": 6, "H": 12, "O": 6} and isotopes.composition("2H2O") == {"H": 4, "O": 2}
    assert isotopes.composition("[13C]2C4H12O6") == {"13C": 2, "C": 4, "H": 12, "O": 6} and isotopes.composition("C2H5+") == {"C": 2, "H": 5}
    assert isotopes.composition("not a formula") is None and isotopes.composition(None) is None and isotopes.composition("") == {}
    assert isotopes.written({"O": 6, "H": 12, "C": 6, "13C": 1}) == "C6H12[13C]O6" and isotopes.mass_of({"Xx": 1}) is None
    assert isotopes.mass_of(isotopes.composition("C6H12O6")) == pytest.approx(180.063388, abs=1e-5)


@pytest.mark.parametrize(("name", "molecules", "charge", "added"), [("[M+H]+", 1, 1, 1.007276), ("[M-H]-", 1, -1, -1.007276), ("[2M+Na]+", 2, 1, 22.989218), ("[M+2H]2+", 1, 2, 2.014553), ("[M+ACN+H]+", 1, 1, 42.033823), ("[M+H-H2O]+", 1, 1, -17.003289), ("[M]", 1, 0, 0.0)])
def test_adducts(name, molecules, charge, added):
    found = isotopes.adduct(name)
    assert found[:2] == (molecules, charge) and found[2] == pytest.approx(added, abs=1e-5)


def test_unreadable_adducts():
    assert isotopes.adduct("M+H") is None and isotopes.adduct(None) is None and isotopes.adduct("[M+Qq]+") is None


def test_distribution_is_a_distribution():
    found = isotopes.distribution({"C": 20, "H": 30, "N": 3, "O": 5, "S": 1}, 1e-12)
    total = 0.99757 + 0.00205  # of oxygen, which has no third isotope in the table
    assert sum(s["abundance"] for s in found) == pytest.approx(total**5 * (0.9493 + 0.0368), rel=1e-6)
    one = next(s for s in found if s["heavy"] == "[13C]1")
    light = next(s for s in found if not s["heavy"])
    assert one["proportion"] == pytest.approx(20 * 0.0107 / 0.9893) and one["mass"] - light["mass"] == pytest.approx(1.00335483521) and light["proportion"] == 1
    boron = isotopes.distribution({"B": 1})
    assert [s["abundance"] for s in boron] == [0.189, 0.811]


def test_isotopes_of_ions():
    found = isotopes.isotopes("C6H12O6", "[M-H]-", least=1e-3)
    assert found[0]["mz"] == pytest.approx(179.0561, abs=1e-4) and found[0]["name"] == "C12 PARENT"
    merged = isotopes.isotopes("C6H12O6", "[M-H]-", least=1e-6, merge=True)
    assert [s["neutrons"] for s in merged] == sorted(s["neutrons"] for s in merged) and merged[1]["mz_min"] <= merged[1]["mz"] <= merged[1]["mz_max"]
    labelled = isotopes.isotopes("C3H8N2", "[M+H]+", {"C": 3, "N": 2})
    assert len(labelled) == 12 and sum(s["abundance"] for s in labelled) == pytest.approx(1, abs=1e-3)
    assert isotopes.isotopes("CH4", "[M-5H]5-") is None
    assert len(isotopes.unknown_isotopes(500.0, 2, {"C": 2, "N": 1})) == 6


def test_formula_prediction_against_enumeration():
    bounds = {"C": (0, 8), "H": (0, 16), "O": (0, 8), "N": (0, 2)}
    mass = isotopes.mass_of({"C": 6, "H": 12, "O": 6})
    every = {}
    for c in range(9):
        for h in range(17):
            for o in range(9):
                for n in range(3):
                    m = isotopes.mass_of({"C": c, "H": h, "O": o, "N": n})
                    if abs(m - mass) <= mass * 200 / 1e6:
                        every[isotopes.written({"C": c, "H": h, "O": o, "N": n})] = m
    found = isotopes.formulas(mass, 200, bounds)
    assert found[0] == ("C6H12O6", pytest.approx(0, abs=1e-6)) and {f for f, _ in found} == set(every)
    with pytest.raises(ValueError):
        isotopes.formulas(mass, 200, bounds, most=3)


def test_charges_patterns_and_masses():
    step = 1.00335483521
    mz, y = [500 + k * step / 2 for k in range(4)] + [700.0], [100.0, 80.0, 40.0, 10.0, 5.0]
    assert isotopes.charge_states(mz, y, 5) == [2, 0, 0, 0, 0]
    assert [k for k, *_ in isotopes.isotope_pattern(mz, y, 500.0, 5, 2)] == [0, 1, 2, 3]
    proton = chem.ELEMENTS["H"] - chem.ELECTRON
    mz = sorted(12000 / z + proton for z in range(8, 13))
    assert isotopes.deconvoluted(mz, [1.0] * 5, 5)[0][:2] == (pytest.approx(12000), 5)
    found = isotopes.envelope([500.0, 500 + step, 600.0], [9.0, 2.0, 1.0], 20, 500.0, 5)
    assert [k for k, *_ in found] == [0, 1] and found[1][3] == pytest.approx(20 * 0.0107 * 0.9893**19)


@pytest.mark.parametrize(("name", "species", "molecular", "kind"), [
    ("PC(16:0/18:1)", "PC(34:1)", "PC(16:0_18:1)", "PC"), ("PC(18:1/16:0)", "PC(34:1)", "PC(16:0_18:1)", "PC"), ("PE(p-16:0/18:2)", "PE(o-34:3)", "PE(o-34:3)", "Alkenyl_PE"),
    ("Cer(d18:1/16:0)", "Cer(34:1;O2)", "Cer(d18:1_16:0)", "Cer"), ("FA(16:1;O2)", "FA(16:1;O2)", "FA(16:1;O2)", "FA"), ("Cholesterol", "Cholesterol", "Cholesterol", "Cholesterol"), ("PC(x/18:1)", "PC(x/18:1)", "PC(18:1_x)", "PC"),
])
def test_lipid_summaries(name, species, molecular, kind):
    assert (lipids.species(name), lipids.molecular_species(name), lipids.lipid_class(name)) == (species, molecular, kind)


def test_lipid_details():
    assert lipids.parsed("PC(16:0/20:4;OH)")[2] == 5 and lipids.parsed("PC(16:0/20:4;5OH)")[2] == 6 and lipids.parsed("none") is None
    assert lipids.from_riken("PC(16:0e/15-HETE)") == "PC(o-16:0/20:4;15OH)" and lipids.from_riken("PC(16:0/18:1)") == "PC(16:0/18:1)"
    assert lipids.sn_positions("PC(16:0/20:4;5,12OH)") == "PC(16:0/20:4;O2)" and lipids.without_positions("PC(16:0/20:4(5Z,8Z);15OH)") == "PC(16:0/20:4;OH)"


def test_peptides():
    p = peptides.parse("K.PEPC[160]IDEK.R/2")
    assert (p["residues"], p["before"], p["after"], p["charge"]) == ("PEPCIDEK", "K", "R", 2)
    assert peptides.neutral_mass(peptides.parse("PEPTIDE")) == pytest.approx(799.35996, abs=1e-3)
    assert peptides.neutral_mass(peptides.parse("PEPTIDE"), True) == pytest.approx(799.82, abs=0.02)
    b, y = peptides.ion_mz(peptides.parse("PEPTIDE"), "b", 2, 1), peptides.ion_mz(peptides.parse("PEPTIDE"), "y", 5, 1)
    assert b == pytest.approx(227.1026, abs=1e-3) and y == pytest.approx(574.2719, abs=1e-3) and b + y == pytest.approx(799.35996 + 2 * 1.007276, abs=1e-3)
    assert peptides.ion_mz(p, "b", 0, 1) is None and peptides.ion_mz(p, "b", 8, 1) is None and peptides.ion_mz(p, "x", 2, 1) is None
    assert peptides.parse("pep?") is None and peptides.parse(None) is None
    names = {i["name"] for i in peptides.fragment_ions(peptides.parse("SPEK"), 2)}
    assert {"b2", "y1", "b2-18", "y1-17", "a1"} <= names and {i["name"] for i in peptides.fragment_ions(peptides.parse("SPEK"), 2, "cz")} == {f"{k}{n}" for k in "cz" for n in (1, 2, 3)}
    assert max(v for _, v in peptides.theoretical_spectrum(peptides.parse("SPEK"), 2)) == 50


def test_peptide_properties():
    assert peptides.missed_cleavages("AKPRK") == 1 and peptides.tryptic_ends(p := peptides.parse("K.AAK.A")) == 2 and p["mods"] == {}
    assert peptides.tryptic_ends(peptides.parse("A.AAA.A")) == 0 and peptides.tryptic_ends(peptides.parse("-.AAA.-")) == 2
    assert peptides.isoelectric_point("KKKK") > 9 > 5 > peptides.isoelectric_point("DDDD")
    assert peptides.homologous("PEPTIDE", "PEPTLDE", 1.0) and not peptides.homologous("PEPTIDE", "GGGG", 0.5) and not peptides.homologous("", "A", 0)
    decoy = peptides.shuffled("ACDEFGHILMNPQSTVWYK", 3)
    assert sorted(decoy) == sorted("ACDEFGHILMNPQSTVWYK") and decoy[-1] == "K" and decoy[11] == "P" and decoy == peptides.shuffled("ACDEFGHILMNPQSTVWYK", 3)
    assert peptides.modified_forms("AMCMK") == ["AMC[160]MK", "AM[147]C[160]MK", "AM[147]C[160]M[147]K"]


def test_digest_against_a_plain_one():
    text = "MKAAAAARCCCCCCKDDDDDDDDRPEEEEEK"
    pieces, last = [], 0
    for i, a in enumerate(text):
        if a in "KR":
            pieces.append((last, i + 1))
            last = i + 1
    expected = {(pieces[i][0], pieces[j][1]) for i in range(len(pieces)) for j in range(i, min(i + 3, len(pieces))) if 5 <= pieces[j][1] - pieces[i][0] <= 30}
    found = peptides.digest(text)
    assert {(a, b) for a, b, _ in found} == expected and all(text[a:b] == p for a, b, p in found)
    assert peptides.digest("") == [] and peptides.digest("AAAAAA") == [(0, 6, "AAAAAA")]


def test_truncations_against_all_stretches(spark):
    text = "GASPVTCLINDQKEMHFRYW" * 2
    mass = lambda a, b: sum(chem.RESIDUES[c] for c in text[a:b]) + chem.WATER
    target = mass(3, 9) + 0.1
    expected = {(a, b - 1) for a in range(len(text)) for b in range(a + 1, len(text) + 1) if abs(mass(a, b) - target) < 0.5}
    table = spark.createDataFrame([(1, text), (2, ""), (3, None)], "sequence_id long, residues string")
    got = peptides.truncations(table, [target], 0.5).collect()
    assert {(x.start, x.end) for x in got} == expected and expected and all(abs(x.mass - target) < 0.5 for x in got)


def test_density_adds_up():
    steps = 20_000
    total = sum(peptides.probability_density(2 + 6 * (k + 0.5) / steps, 2, 3, 8) * 6 / steps for k in range(steps))
    assert total == pytest.approx(1, abs=1e-4) and peptides.probability_density(1, 2, 3, 8) == 0 and math.isfinite(peptides.probability_density(3, 2, 3, 8))


@pytest.mark.parametrize(("text", "formula", "rings"), [
    ("C", "CH4", 0), ("CCO", "C2H6O", 0), ("CC(=O)O", "C2H4O2", 0), ("c1ccccc1", "C6H6", 1), ("C1CCCCC1", "C6H12", 1), ("N[C@@H](C)C(=O)O", "C3H7NO2", 0), ("c1ccncc1", "C5H5N", 1),
    ("c1cc[nH]c1", "C4H5N", 1), ("[13C]C", "CH3[13C]", 0), ("ClCCBr", "C2H4BrCl", 0), ("C#N", "CHN", 0), ("CS(=O)(=O)C", "C2H6O2S", 0), ("c1ccc2ccccc2c1", "C10H8", 2), ("[Na+].[Cl-]", "ClNa", 0), ("C/C=C/C", "C4H8", 0),
])
def test_smiles(text, formula, rings):
    m = smiles.read(text)
    assert isotopes.written(m.formula()) == formula and m.rings() == rings


def test_smiles_fragments_and_errors():
    assert {f for f, _, _ in smiles.read("CCO").fragments(1)} == {"CH3", "CH3O", "C2H5", "HO"} and smiles.read("CCO").fragments(0) == []
    assert smiles.read("c1ccccc1").fragments(2) == [] and all(n == 2 for f, _, n in smiles.read("CCO").fragments(2) if f == "CH2")
    for text in (None, "C(", "C1CC", "X!", "C)", "1CC"):
        assert smiles.read(text) is None
