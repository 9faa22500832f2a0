"""Files written and read again; codecs; text parsers."""

import random
import sqlite3
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionquarry.functions import spectrum as S
from ionquarry.sources import codecs, text_files, xml_files


def scans(spark):
    rows = [
        ("a", 0, 1, 0.5, None, None, 1, None, None, [100.0, 200.5, 300.25], [1.0, 2.5, 3.0]),
        ("a", 1, 2, 0.75, 200.5, 100.0, 1, 'FTMS + <p> "ESI" & ms2', 35.0, [100.0], [7.0]),
        ("blank_1", 0, 1, 1.0, None, None, -1, None, None, [], []),
    ]
    return spark.createDataFrame(rows, xml_files.SCANS)


@pytest.mark.parametrize("compressed", [True, False])
def test_mzml_round_trip(spark, tmp_path, compressed):
    xml_files.write_mzml(scans(spark), str(tmp_path / "out"), compressed)
    got = {}
    for folder in (tmp_path / "out").glob("sample=*"):
        part = next(folder.glob("*.txt"))
        name = folder.name.partition("=")[2]
        (tmp_path / f"{name}.mzML").write_bytes(part.read_bytes())
    for x in xml_files.read_scans(spark, str(tmp_path / "*.mzML")).collect():
        got[x.sample, x.scan_id] = (x.mslevel, x.rt, x.precursor_mz, x.polarity, x.filter_line, x.mz, x.intensity)
    assert got == {(x.sample, x.scan_id): (x.mslevel, x.rt, x.precursor_mz, x.polarity, x.filter_line, x.mz, x.intensity) for x in scans(spark).collect()}
    assert xml_files.read_scans(spark, str(tmp_path / "*.mzML"), mslevel=2).count() == 1


def test_mzml_chromatograms():
    array = lambda name, values, unit="": f'<binaryDataArray><cvParam name="64-bit float"/><cvParam name="{name}" unitName="{unit}"/><binary>{codecs.encoded(values, 64)}</binary></binaryDataArray>'
    one = lambda q1, q3, t, y: f'<chromatogram id="SRM {q1}"><precursor><isolationWindow><cvParam name="isolation window target m/z" value="{q1}"/></isolationWindow></precursor><product><isolationWindow><cvParam name="isolation window target m/z" value="{q3}"/></isolationWindow></product>{array("time array", t, "second")}{array("intensity array", y)}</chromatogram>'
    text = f'<mzML xmlns="http://psi.hupo.org/ms/mzml"><run>{one(180, 80, [60.0, 120.0], [1.0, 2.0])}{one(150, 70, [90.0], [3.0])}{one(0, 70, [10.0], [3.0])}</run></mzML>'
    got = [(x["scan_id"], x["rt"], x["precursor_mz"], x["product_mz"], x["intensity"]) for x in xml_files.mzml(text.encode(), "s")]
    assert got == [(1, 1.0, 180, 80, [1.0]), (2, 1.5, 150, 70, [3.0]), (3, 2.0, 180, 80, [2.0])]


def test_mzxml_and_mzdata(spark, tmp_path):
    peaks = codecs.encoded([200.0, 5.0, 100.0, 3.0, 150.0, 0.0], 32, False, True)
    nested = f'<scan num="2" msLevel="2" retentionTime="PT1M30S" polarity="-" scanType="SRM"><precursorMz>200.0</precursorMz><peaks precision="32">{peaks}</peaks></scan>'
    text = f'<mzXML><msRun><scan num="1" msLevel="1" retentionTime="PT60S" polarity="+"><peaks precision="32">{peaks}</peaks>{nested}</scan></msRun></mzXML>'
    (tmp_path / "run1.mzXML").write_text(text)
    got = sorted(xml_files.read_scans(spark, str(tmp_path / "run1.mzXML")).collect(), key=lambda x: x.scan_id)
    assert [(x.scan_id, x.mslevel, x.rt, x.polarity, x.mz, x.intensity) for x in got] == [(1, 1, 1.0, 1, [100.0, 200.0], [3.0, 5.0]), (2, 2, 1.5, -1, [100.0, 200.0], [3.0, 5.0])]
    assert got[1].precursor_mz == 200 and got[1].filter_line == "SRM ms2 200.000 [100.000-200.000]" and got[1].product_mz == 100
    data = lambda name, v: f'<{name}><data precision="64" endian="little">{codecs.encoded(v, 64)}</data></{name}>'
    text = f'<mzData><spectrumList><spectrum id="4"><spectrumDesc><spectrumSettings><spectrumInstrument msLevel="1"><cvParam name="Polarity" value="Positive"/><cvParam name="TimeInMinutes" value="2.5"/></spectrumInstrument></spectrumSettings></spectrumDesc>{data("mzArrayBinary", [2.0, 1.0])}{data("intenArrayBinary", [8.0, 9.0])}</spectrum></spectrumList></mzData>'
    assert [(x["scan_id"], x["rt"], x["polarity"], x["mz"], x["intensity"]) for x in xml_files.mzdata(text.encode(), "s")] == [(4, 2.5, 1, [1.0, 2.0], [9.0, 8.0])]


def test_sqlite(spark, tmp_path):
    base = sqlite3.connect(tmp_path / "run.sqlite")
    base.execute("CREATE TABLE msScan(id INTEGER PRIMARY KEY, startScanNumber INTEGER, level INTEGER, precursorMZ REAL, retentionTime REAL, peakCount INTEGER)")
    base.execute("CREATE TABLE msScanData(scanID INTEGER, peakMZ BLOB, peakIntensity BLOB)")
    mz, y = np.array([200.0, 100.0]).tobytes(), np.array([2.0, 1.0], "<f4").tobytes()
    base.executemany("INSERT INTO msScan VALUES (?, ?, ?, ?, ?, ?)", [(1, 10, 1, 0.0, 0.5, 2), (2, 11, 2, 500.5, 0.6, 2), (3, 12, 1, None, 0.7, 0)])
    base.executemany("INSERT INTO msScanData VALUES (?, ?, ?)", [(1, mz, y), (2, zlib.compress(mz), zlib.compress(y)), (3, b"", None)])
    base.commit()
    base.close()
    got = sorted(xml_files.read_scans(spark, str(tmp_path / "run.sqlite")).collect(), key=lambda x: x.scan_id)
    assert [(x.scan_id, x.mslevel, x.rt, x.precursor_mz, x.mz, x.intensity) for x in got] == [(10, 1, 0.5, None, [100.0, 200.0], [1.0, 2.0]), (11, 2, 0.6, 500.5, [100.0, 200.0], [1.0, 2.0]), (12, 1, 0.7, None, [], [])]


def test_samples_points_and_precursors(spark):
    table = {x.sample: x for x in xml_files.sample_table(scans(spark)).collect()}
    assert (table["a"].sample_id, table["a"].is_blank, table["a"].mzmin, table["a"].mzmax) == (0, False, 100.0, 300.25)
    assert (table["blank_1"].sample_id, table["blank_1"].is_blank, table["blank_1"].mzmin) == (1, True, None)
    assert xml_files.points(scans(spark)).count() == 4
    moved = scans(spark).withColumn("precursor_mz", F.col("precursor_mz") + 0.006)
    assert [x.precursor_mz for x in xml_files.corrected_precursors(moved).filter("mslevel = 2").collect()] == [200.5]
    far = scans(spark).withColumn("precursor_mz", F.col("precursor_mz") + 5)
    assert [x.precursor_mz for x in xml_files.corrected_precursors(far).filter("mslevel = 2").collect()] == [205.5]


def test_floats_and_numpress():
    r = random.Random(1)
    for bits, compressed, big in ((32, False, True), (64, True, False)):
        values = [r.random() * 1000 for _ in range(50)]
        assert codecs.floats(codecs.encoded(values, bits, compressed, big), bits, compressed, big) == pytest.approx(values, rel=1e-6)
    assert len(codecs.floats("")) == 0 and len(codecs.floats(None)) == 0 and codecs.floats(codecs.encoded([1.5]) + "\n ") == [1.5]
    mz = np.cumsum(np.array([r.random() for _ in range(200)])) + 100
    assert codecs.from_linear(codecs.linear(mz)) == pytest.approx(mz, abs=1e-5)
    counts = [0, 1, 7, 255, 256, 70_000, 2**30]
    assert list(codecs.from_integers(codecs.integers(counts))) == counts
    assert codecs.from_logarithms(codecs.logarithms([0.0, 3.0, 1e6])) == pytest.approx([0, 3, 1e6], rel=1e-3)
    assert codecs._from_halves(codecs._halves([0, -1, -70_000, 12])) == [0, -1, -70_000, 12]
    for n in range(3):
        assert list(codecs.from_linear(codecs.linear([5.0] * n))) == pytest.approx([5.0] * n)


def test_bytes_columns(spark):
    table = spark.createDataFrame([(1, b"abc" * 100), (2, b""), (3, None)], "id long, data binary")
    got = table.select("id", codecs.inflated(codecs.deflated(F.col("data"))).alias("back"), codecs.inflated(F.lit(b"no zlib")).alias("none")).orderBy("id").collect()
    assert [bytes(x.back) if x.back is not None else None for x in got] == [b"abc" * 100, b"", None] and got[0].none is None
    assert zlib.decompress(spark.createDataFrame([(b"q",)], "d binary").select(codecs.deflated(F.col("d")).alias("x")).first().x) == b"q"


def test_mzcsv_round_trip(spark, tmp_path):
    rows = [(0, 1, 0.5, None, 1, None, [(100.0, 1.0), (200.0, 2.0)]), (4, 2, 1.25, 200.0, -1, "line", [(50.0, 3.0)])]
    spectrum = "array<struct<mz:double,intensity:double>>"
    table = spark.createDataFrame(rows, f"scan_id long, mslevel int, rt double, precursor_mz double, polarity int, filter_line string, spectrum {spectrum}")
    text_files.write_mzcsv(table.coalesce(1), str(tmp_path / "run.csv"))
    got = sorted(text_files.read_mzcsv(spark, str(tmp_path / "run.csv")).collect(), key=lambda x: x.scan_id)
    assert [(x.scan_id - 1, x.mslevel, x.rt, x.precursor_mz, x.polarity, [tuple(p) for p in x.spectrum]) for x in got] == [(r[0], r[1], r[2], r[3], r[4], r[6]) for r in rows]
    assert got[1].product_mz == 50 and got[0].product_mz is None


def test_text_formats(spark, tmp_path):
    spectrum = "array<struct<mz:double,intensity:double>>"
    table = spark.createDataFrame([("t 1", 500.25, 1.5, 2, "C6H6", [(100.0, 1.5), (200.0, 2.0)]), ("t2", 300.0, 2.0, 1, "", [])], f"title string, precursor_mz double, rt double, charge int, formula string, spectrum {spectrum}")
    text_files.write_mgf(table, str(tmp_path / "mgf"))
    got = {x.title: x for x in text_files.read_mgf(spark, str(tmp_path / "mgf")).collect()}
    assert got["t 1"].precursor_mz == 500.25 and got["t 1"].charge == 2 and got["t 1"].rt == 1.5 and [tuple(p) for p in got["t 1"].spectrum] == [(100.0, 1.5), (200.0, 2.0)] and got["t2"].spectrum == []
    text_files.write_msp(table.withColumnRenamed("title", "name"), str(tmp_path / "msp"))
    found = {x.name: x for x in text_files.read_msp(spark, str(tmp_path / "msp")).collect()}
    assert found["t 1"].precursor_mz == 500.25 and found["t 1"].formula == "C6H6" and len(found["t 1"].spectrum) == 2 and len(found["t2"].spectrum) == 0
    (tmp_path / "x.ms2").write_text("H\tversion\nS\t3\t3\t445.12\nI\tRTime\t1.5\nZ\t2\t889.2\n100.5 10\n200.5 20\n\nS\t4\t4\t500\n")
    ms2 = text_files.read_ms_text(spark, str(tmp_path / "x.ms2"), 2).collect()
    assert [(x.sample, x.scan_id, x.rt, x.precursor_mz, x.charge, len(x.spectrum)) for x in ms2] == [("x", 3, 1.5, 445.12, 2, 2), ("x", 4, None, 500.0, None, 0)]


def test_fasta_round_trip(spark, tmp_path):
    table = spark.createDataFrame([("one protein", "MKV" * 50), ("two", "A" * 160), ("three", "G")], "header string, sequence string")
    text_files.write_fasta(table, str(tmp_path / "f"), 80)
    got = {x.header: x.sequence for x in text_files.read_fasta(spark, str(tmp_path / "f")).collect()}
    assert got == {x.header: x.sequence for x in table.collect()}
    lines = [x for p in (tmp_path / "f").glob("*.txt") for x in p.read_text().splitlines()]
    assert max(map(len, lines)) == 80


def test_small_tables(spark, tmp_path):
    (tmp_path / "adducts.csv").write_text("#name,nmol,charge,mass\n[M+H]+,1,1,1.00727\nbad,x,y,z\n\n[2M-H]-,2,-1,-1.00727\n")
    assert sorted((x.name, x.molecules, x.charge) for x in text_files.read_adducts(spark, str(tmp_path / "adducts.csv")).collect()) == [("[2M-H]-", 2, -1), ("[M+H]+", 1, 1)]
    (tmp_path / "t.csv").write_text("lipid_class,adduct,least_matches\n#note\nPC,[M+H]+,5\nPC,,3\n")
    assert sorted(x.adduct for x in text_files.read_thresholds(spark, str(tmp_path / "t.csv")).collect()) == ["*", "[M+H]+"]
    (tmp_path / "a.tsv").write_text("sample\trt\trt_update\ns1\t1.0\t1.5\ns1\tx\ty\n")
    assert [tuple(x) for x in text_files.read_alignment(spark, str(tmp_path / "a.tsv")).collect()] == [("s1", 1.0, 1.5)]
    (tmp_path / "p.csv").write_text("#mz,rt\n100.5,2.0\n200.5,3.0,blank\n")
    assert sorted((x.mz, x.rt, x.sample_filter) for x in text_files.read_anchors(spark, str(tmp_path / "p.csv")).collect()) == [(100.5, 2.0, None), (200.5, 3.0, "blank")]


def test_traces_dumped_and_restored(spark, tmp_path):
    table = spark.createDataFrame([(1, 0.5, 2.0), (1, 0.25, 1.0)], "sample_id long, rt double, intensity double")
    text_files.dump_traces(table, str(tmp_path / "t"), ["sample_id"])
    assert sorted(map(tuple, text_files.restore_traces(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, table.collect()))


def test_spectrum_expressions_at_their_edges(spark):
    kind = "array<struct<mz:double,intensity:double>>"
    table = spark.createDataFrame([(1, []), (2, None), (3, [(100.0, 5.0), (100.0, 5.0)])], f"id long, s {kind}")
    s = F.col("s")
    got = table.select("id", F.size(S.top_peaks(s)).alias("top"), S.quantile(s, 50).alias("q"), S.closest_intensity(s, F.lit(100.0), 5).alias("c"), S.highest(s).alias("h"), S.encoded(s).alias("e"), S.is_monoisotopic(s, F.lit(100.0), 5, F.lit(1)).alias("m")).orderBy("id").collect()
    assert got[0].top == 0 and got[0].q is None and got[0].c == -1 and got[0].h is None and got[0].e == "{{},{}}" and got[0].m
    assert got[1].q is None and got[1].h is None
    assert got[2].top == 2 and got[2].h.intensity == 5 and got[2].c == 5
