import gzip
import random
import re
from pathlib import Path

import pytest

from ionquarry.sources import codecs, spectra_source, xml_files
from ionquarry.sources.spectra_source import Part, Source, Wanted, scans_of

FIELDS = ("sample", "scan_id", "mslevel", "rt", "precursor_mz", "polarity", "filter_line", "collision_energy", "mz", "intensity")


def plain(rows):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in (x[f] for f in FIELDS)) for x in rows), key=repr)


def scans(spark, n=60):
    r = random.Random(1)
    rows = []
    for sample in ("a", "b blank", "c&d"):
        for i in range(n if sample == "a" else 5):
            mz = sorted(r.uniform(50, 900) for _ in range(r.choice([0, 3, 400])))
            level = 1 + (i % 3 > 0)
            rows.append((sample, i, level, 0.1 * i, 200.5 + i if level > 1 else None, None, r.choice([1, -1, 0]), r.choice([None, 'FTMS + <p> "ESI" & ms2']), 35.0 if level > 1 else None, mz, [r.uniform(1, 9) for _ in mz]))
    return spark.createDataFrame(rows, xml_files.SCANS)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("spectra")
    spectra_source.write_spectra(scans(spark), f"{out}/w")
    return f"{out}/w"


def test_written_files_are_read_back_by_many_tasks(spark, folder):
    assert sorted(p.name for p in Path(folder).iterdir()) == ["a.mzML", "b_blank.mzML", "c_d.mzML"]
    want = plain([x.asDict() | {"sample": re.sub(r"[^A-Za-z0-9_.-]", "_", x.sample)} for x in scans(spark).collect()])
    for size in (1500, 20_000, spectra_source.PARTITION):
        held = spectra_source.read_spectra(spark, folder, size)
        assert plain(x.asDict() for x in held.collect()) == want
        assert held.rdd.getNumPartitions() > (100 if size == 1500 else 2 if size > 10**6 else 5)
    # the reader of whole files agrees
    assert plain(x.asDict() for x in xml_files.read_scans(spark, f"{folder}/*.mzML").collect()) == want


def test_the_index_points_at_spectra(folder):
    data = Path(f"{folder}/a.mzML").read_bytes()
    source = Source(f"{folder}/a.mzML", len(data))
    found = spectra_source.index_of(source, "mzml")
    assert found == [m.start() for m in re.finditer(rb"<spectrum[\s>]", data)] and len(found) == 60
    assert int(re.search(rb"<indexListOffset>(\d+)", data)[1]) == data.index(b"<indexList ")


def test_files_without_or_with_a_wrong_index(spark, folder, tmp_path):
    data = Path(f"{folder}/a.mzML").read_bytes()
    want = plain(xml_files.mzml(data, "a"))
    bare = re.sub(rb' index="\d+"', b"", data[: data.index(b"<indexList ")].replace(b"<indexedmzML", b"<x").replace(b"/mzML>", b"/mzML></x>"))
    wrong = re.sub(rb"<offset([^>]*)>(\d+)<", lambda m: b"<offset%s>%d<" % (m[1], int(m[2]) + 3), data)
    for text in (bare, wrong):
        (tmp_path / "a.mzML").write_bytes(text)
        for size in (1000, 30_000):
            assert plain(x.asDict() for x in spectra_source.read_spectra(spark, str(tmp_path), size).collect()) == want
    (tmp_path / "a.mzML").unlink()
    (tmp_path / "a.mzML.gz").write_bytes(gzip.compress(data))
    assert plain(x.asDict() for x in spectra_source.read_spectra(spark, f"{tmp_path}/*.gz", 1000).collect()) == want


def test_filters_reach_the_file(spark, folder):
    held = spectra_source.read_spectra(spark, folder)
    want = scans(spark).toPandas()
    assert held.filter("mslevel = 2 AND rt >= 2 AND rt < 3").count() == int(((want.mslevel == 2) & (want.rt >= 2) & (want.rt < 3)).sum())
    assert held.filter("scan_id IN (3, 4) AND sample = 'a'").count() == 2
    assert held.filter("rt > 1 AND (mslevel = 1 OR scan_id = 13)").count() == int(((want.rt > 1) & ((want.mslevel == 1) | (want.scan_id == 13))).sum())
    size = Path(f"{folder}/a.mzML").stat().st_size
    whole, few = Source(f"{folder}/a.mzML", size), Source(f"{folder}/a.mzML", size)
    part = Part(f"{folder}/a.mzML", "a", "mzml", 0, size, size)
    assert len(list(scans_of(part, None, whole))) == 60
    wanted = Wanted(low={"rt": 2.05}, high={"rt": 2.15})
    assert [x["scan_id"] for x in scans_of(part, wanted, few)] == [21]


def test_a_range_of_rt_reads_little_of_a_large_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spectra_source, "BLOCK", 1 << 16)
    n = 120
    mz = [100 + 0.01 * i for i in range(20_000)]
    with open(tmp_path / "long.mzML", "wb") as f:
        out = spectra_source.MzmlFile(f, "long", "none")
        for i in range(n):
            out.add(dict(sample="long", scan_id=i, mslevel=1, rt=float(i), mz=mz, intensity=mz))
        out.close()
    size = (tmp_path / "long.mzML").stat().st_size
    source = Source(str(tmp_path / "long.mzML"), size)
    got = list(scans_of(Part(str(tmp_path / "long.mzML"), "long", "mzml", 0, size, size), Wanted(low={"rt": 50.0}, high={"rt": 51.0}), source))
    assert [x["scan_id"] for x in got] == [50, 51] and got[0]["mz"] == mz
    assert source.bytes_read < 0.05 * size


def test_numpress_files(spark, tmp_path):
    spectra_source.write_spectra(scans(spark).filter("sample = 'a'"), str(tmp_path), "numpress")
    got = {x.scan_id: x for x in spectra_source.read_spectra(spark, str(tmp_path), 5000).collect()}
    for x in scans(spark).filter("sample = 'a'").collect():
        assert got[x.scan_id].mz == pytest.approx(x.mz, abs=1e-4) and got[x.scan_id].intensity == pytest.approx(x.intensity, rel=1e-3)


def test_nested_mzxml_scans_in_ranges(spark, tmp_path):
    r = random.Random(3)
    text, places = "<mzXML><msRun>", []
    for i in range(1, 41):
        body = codecs.encoded([v for _ in range(30) for v in (r.uniform(50, 90), float(r.randrange(3)))], 32, i % 2 == 0, True)
        places.append(len(text))
        kind = ' compressionType="zlib"' if i % 2 == 0 else ""
        nested = i % 4 != 1
        text += f'<scan num="{i}" msLevel="{2 if nested else 1}" retentionTime="PT{i * 6}S" polarity="+">' + (f"<precursorMz>{100 + i}</precursorMz>" if nested else "") + f'<peaks precision="32"{kind}>{body}</peaks>'
        text += "</scan>" if nested else ""
        text += "</scan>" if i % 4 == 0 else ""
    text += "</msRun>"
    index = "<index name=\"scan\">" + "".join(f'<offset id="{i}">{p}</offset>' for i, p in enumerate(places, 1)) + f"</index><indexOffset>{len(text)}</indexOffset></mzXML>"
    want = plain(xml_files.mzxml((text + "</mzXML>").encode(), "run"))
    for whole in (text + index, text + "</mzXML>"):
        (tmp_path / "run.mzXML").write_text(whole)
        for size in (700, 10**6):
            held = spectra_source.read_spectra(spark, str(tmp_path), size)
            assert plain(x.asDict() for x in held.collect()) == want
            assert held.filter("mslevel = 1").count() == 10 and held.filter("rt <= 1").count() == 10


def test_chromatograms_and_odd_files(spark, tmp_path):
    array = lambda name, values, unit="": f'<binaryDataArray><cvParam name="64-bit float"/><cvParam name="{name}" unitName="{unit}"/><binary>{codecs.encoded(values, 64)}</binary></binaryDataArray>'
    window = lambda tag, v: f'<{tag}><isolationWindow><cvParam name="isolation window target m/z" value="{v}"/></isolationWindow></{tag}>'
    text = f'<mzML><run><chromatogramList><chromatogram id="SRM">{window("precursor", 180)}{window("product", 80)}{array("time array", [60.0, 120.0], "second")}{array("intensity array", [1.0, 2.0])}</chromatogram></chromatogramList></run></mzML>'
    (tmp_path / "srm.mzML").write_text(text)
    for size in (100, 10**6):
        assert [(x.scan_id, x.rt, x.product_mz) for x in spectra_source.read_spectra(spark, str(tmp_path), size).orderBy("scan_id").collect()] == [(1, 1.0, 80.0), (2, 2.0, 80.0)]
    (tmp_path / "srm.mzML").write_text("<mzML><run><spectrumList></spectrumList></run></mzML>")
    assert spectra_source.read_spectra(spark, str(tmp_path)).collect() == []
    (tmp_path / "srm.mzML").write_text("")
    assert spectra_source.read_spectra(spark, str(tmp_path)).collect() == []
    assert spectra_source.read_spectra(spark, f"{tmp_path}/none*.mzML").collect() == []
