"""Binary MS1, MS2 and ANDI files, made here byte by byte, are read back."""

import random
import struct
import zlib

import pytest

from ionquarry.sources import binary_files
from ionquarry.sources.spectra_source import Part, Source, Wanted


def made(n, seed, level):
    """(scan, precursors, rt, points in any order) with values that floats of four bytes hold."""
    r = random.Random(seed)
    return [(10 + 2 * i, [400.5 + i] * (level - 1), i / 4, [(r.uniform(50, 900), float(r.randrange(1, 1000))) for _ in range(r.choice([0, 1, 30, 200]))]) for i in range(n)]


def binary(scans, kind, version):
    out = [struct.pack("<ii", kind, version), b"H\tline".ljust(16 * 128, b"\0")]
    for k, (scan, precursors, rt, points) in enumerate(scans):
        charges, more = k % 3, k % 2 if version >= 3 else 0
        out.append(struct.pack("<ii", scan, scan))
        out.append(struct.pack(f"<i{len(precursors)}d", len(precursors), *precursors) if version >= 5 else struct.pack("<d", precursors[0] if precursors else 0.0))
        out.append(struct.pack("<f", rt))
        if version >= 2:
            out.append(struct.pack("<fddd", 1.0, 2.0, 3.0, 4.0) + (struct.pack("<4d", 5, 6, 7, 8) if version >= 4 else b"") + struct.pack("<df", 9.0, 10.0))
        out.append(struct.pack("<i", charges) + (struct.pack("<i", more) if version >= 3 else b"") + struct.pack("<i", len(points)))
        out.append(struct.pack("<id", 2, 801.0) * charges + struct.pack("<idff", 2, 801.0, 1.0, 2.0) * more)
        if kind in (2, 4):
            mz, y = (zlib.compress(struct.pack(f"<{len(points)}{c}", *[p[j] for p in points])) for j, c in ((0, "d"), (1, "f")))
            out.append(struct.pack("<ii", len(mz), len(y)) + mz + y)
        else:
            out += [struct.pack("<df", *p) for p in points]
    return b"".join(out)


def netcdf(scans, by_record, offset_bytes=4, streamed=False):
    """An ANDI file, its points in variables of fixed length or interleaved by record."""
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: struct.pack(">i", len(s)) + pad(s.encode())
    n, total = len(scans), sum(len(x[3]) for x in scans)
    starts = [sum(len(x[3]) for x in scans[:k]) for k in range(n)]
    points = [p for x in scans for p in x[3]]
    fixed = [("scan_index", 4, struct.pack(f">{n}i", *starts)), ("point_count", 4, struct.pack(f">{n}i", *[len(x[3]) for x in scans])), ("scan_acquisition_time", 6, struct.pack(f">{n}d", *[x[2] * 60 for x in scans])), ("actual_scan_number", 4, struct.pack(f">{n}i", *[x[0] for x in scans]))]
    values = [("mass_values", 6, [struct.pack(">d", p[0] / 2) for p in points]), ("intensity_values", 5, [struct.pack(">f", p[1]) for p in points])]
    start = b"CDF" + bytes([1 if offset_bytes == 4 else 2]) + struct.pack(">I", (2**32 - 1 if streamed else total) if by_record else 0)
    start += struct.pack(">ii", 10, 2) + name("scan_number") + struct.pack(">i", n) + name("point_number") + struct.pack(">i", 0 if by_record else total)
    start += struct.pack(">ii", 12, 2) + name("test_ionization_polarity") + struct.pack(">i", 2) + name("Positive Polarity") + name("raw_data_mass_factor") + struct.pack(">iid", 6, 1, 2.0)
    listed = [(k, t, 0, d) for k, t, d in fixed] + [(k, t, 1, b"".join(d)) for k, t, d in values]
    size = len(start) + 8 + sum(len(name(k)) + 4 + 4 + 8 + 4 + 4 + offset_bytes for k, *_ in listed)
    variables, body = struct.pack(">ii", 11, len(listed)), b""
    for k, t, dim, data in listed:
        record = dim == 1 and by_record
        step = {"mass_values": 8, "intensity_values": 4}.get(k, 0)
        begin = size + len(body) + (8 if record and k == "intensity_values" else 0)
        variables += name(k) + struct.pack(">ii", 1, dim) + struct.pack(">ii", 0, 0) + struct.pack(">ii", t, step if record else len(pad(data))) + begin.to_bytes(offset_bytes, "big")
        body += b"" if record else pad(data)
    if by_record:
        body += b"".join(a + b for a, b in zip(values[0][2], values[1][2], strict=True))
    return start + variables + body


def expected(scans, level, polarity=0):
    return [(scan, level, pytest.approx(rt), precursors[0] if precursors else None, polarity, [p[0] for p in sorted(points)], [p[1] for p in sorted(points)]) for scan, precursors, rt, points in scans]


def rows(df):
    return [(x.scan_id, x.mslevel, x.rt, x.precursor_mz, x.polarity, x.mz, x.intensity) for x in sorted(df, key=lambda x: x.scan_id)]


@pytest.mark.parametrize(("kind", "version"), [(1, 1), (1, 5), (2, 3), (3, 2), (3, 4), (4, 5)])
def test_binary_records_are_read_by_many_tasks(spark, tmp_path, kind, version):
    level, ending = {1: (1, "bms1"), 2: (1, "cms1"), 3: (2, "bms2"), 4: (2, "cms2")}[kind]
    scans = made(40, kind * 10 + version, level)
    (tmp_path / f"run.{ending}").write_bytes(binary(scans, kind, version))
    (tmp_path / f"none.{ending}").write_bytes(b"")
    for size in (3000, 1 << 26):
        held = binary_files.read_binary(spark, str(tmp_path), size)
        assert rows(held.collect()) == expected(scans, level)
    few = binary_files.read_binary(spark, str(tmp_path), 3000).filter("rt >= 2 AND rt < 4 AND sample = 'run'").collect()
    assert rows(few) == expected([x for x in scans if 2 <= x[2] < 4], level)


def test_scans_passed_over_are_not_read_and_cut_files_end_early(tmp_path):
    scans = [(i, [], float(i), [(k + 1.0, 1.0) for k in range(20_000)]) for i in range(40)]
    data = binary(scans, 1, 5)
    path = tmp_path / "run.bms1"
    path.write_bytes(data)
    source = Source(str(path), len(data))
    asked = Wanted(low={"rt": 30.0}, high={"rt": 30.0})
    found = list(binary_files.records(Part(str(path), "run", "records", 0, len(data), len(data)), asked, source))
    assert [x["scan_id"] for x in found] == [30] and source.bytes_read < len(data) / 20
    short = len(data) - 5
    path.write_bytes(data[:short])
    assert [x["scan_id"] for x in binary_files.records(Part(str(path), "run", "records", 0, short, short), Wanted(), Source(str(path), short))] == list(range(39))


@pytest.mark.parametrize(("by_record", "offset_bytes", "streamed"), [(False, 4, False), (True, 4, False), (True, 8, True)])
def test_andi_files_are_read_by_many_tasks(spark, tmp_path, by_record, offset_bytes, streamed):
    scans = made(40, 9, 1)
    (tmp_path / "run.cdf").write_bytes(netcdf(scans, by_record, offset_bytes, streamed))
    for size in (5000, 1 << 26):
        held = binary_files.read_binary(spark, str(tmp_path / "*.cdf"), size)
        assert rows(held.collect()) == expected([x for x in scans if x[3]], 1, polarity=1)
    assert rows(held.filter("scan_id IN (12, 14)").collect()) == expected([x for x in scans if x[3] and x[0] in (12, 14)], 1, polarity=1)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        binary_files.kind_of("/x/run.mzML")
