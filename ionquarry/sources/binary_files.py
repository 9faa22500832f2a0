"""Binary MS1 and MS2 files (.bms1, .bms2, compressed .cms1, .cms2) and ANDI files (.cdf, .nc: classic NetCDF) as a Spark data source.

    read_binary(spark, "/data/run*.bms2").filter("rt BETWEEN 10 AND 12")

Scans have the schema ``xml_files.SCANS``, rt in minutes, points in order of m/z. A task takes a range of bytes of a binary file,
or a range of an ANDI file's scans, and holds one scan at a time besides a batch of rows. Records of binary files have no
index, so a task goes through the heads before its range; what filters on sample, scan_id, mslevel and rt don't ask for is
passed over the same way. Empty files give no rows; a scan that the file's end cuts off is left out.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from ionquarry.sources import xml_files
from ionquarry.sources.spectra_source import PARTITION, Part, Source, SpectraReader, Wanted, listed

#: Bytes before the first record (two numbers, sixteen lines of text), levels and compression by file type.
_START = 8 + 16 * 128
_LEVELS, _COMPRESSED = {1: 1, 2: 1, 3: 2, 4: 2}, {2, 4}
#: Types of the classic NetCDF format.
_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
_HEAD = 256


def kind_of(path: str) -> str:
    ending = path.lower().rpartition(".")[2]
    if ending in ("cdf", "nc"):
        return "andi"
    if ending in ("bms1", "bms2", "cms1", "cms2"):
        return "records"
    raise ValueError(f"not a binary spectra file: {path}")


def _row(sample: str, scan: int, level: int, rt: float | None, mz: np.ndarray, y: np.ndarray, precursor: float | None = None, polarity: int = 0) -> dict:
    order = np.argsort(mz, kind="stable")
    product = float(mz[order[0]]) if level > 1 and len(mz) else None
    return {"sample": sample, "scan_id": scan, "mslevel": level, "rt": rt, "precursor_mz": precursor, "product_mz": product, "polarity": polarity, "filter_line": None, "collision_energy": None, "mz": mz[order].astype(float).tolist(), "intensity": y[order].astype(float).tolist()}


@dataclass
class Head:
    """What the head of a record tells; ``body`` is where its points begin."""

    scan: int
    precursor: float | None
    rt: float
    points: int
    body: int


def head_at(source: Source, at: int, version: int, block: int) -> Head | None:
    """The head of the record at ``at``; None where the file ends in it.

    Later versions tell more: 2 the base peak, two constants, the total and the injection time, 3 a second list of charges,
    4 four more constants, 5 several precursors.
    """
    several = 0
    if version >= 5:
        found = source.read(at + 8, at + 12, block)
        if len(found) < 4:
            return None
        several = struct.unpack("<i", found)[0]
    masses = several if version >= 5 else 1
    layout = "<ii" + ("i" if version >= 5 else "") + f"{masses}d" + "f" + ("fddd" + ("dddd" if version >= 4 else "") + "df" if version >= 2 else "") + "i" + ("i" if version >= 3 else "") + "i"
    size = struct.calcsize(layout)
    data = source.read(at, at + size, block)
    if len(data) < size:
        return None
    values = struct.unpack(layout, data)
    first = 3 if version >= 5 else 2
    charges, more = (values[-3], values[-2]) if version >= 3 else (values[-2], 0)
    precursor = values[first] if masses and values[first] else None
    return Head(values[0], precursor, values[first + masses], values[-1], at + size + 12 * charges + 20 * more)


def records(part: Part, wanted: Wanted, source: Source) -> Iterator[dict]:
    """Scans of a binary MS1 or MS2 file whose records begin in the part."""
    start = source.read(0, _START, 1)
    if len(start) < _START:
        return
    kind, version = struct.unpack("<ii", start[:8])
    if kind not in _LEVELS:
        raise ValueError(f"{part.path}: unknown file type {kind}")
    level, packed, at = _LEVELS[kind], kind in _COMPRESSED, _START
    while at < min(part.last, part.size):
        block = _HEAD if wanted or at < part.first else 0  # 0 reads ahead
        head = head_at(source, at, version, block)
        if head is None:
            return
        body, sizes = head.body, (8 * head.points, 4 * head.points)
        if packed:
            told = source.read(body, body + 8, block)
            if len(told) < 8:
                return
            body, sizes = body + 8, struct.unpack("<ii", told)
        end = body + (sum(sizes) if packed else 12 * head.points)
        if end > part.size:
            return
        if at >= part.first and wanted.admits(scan_id=head.scan, mslevel=level, rt=head.rt):
            data = source.read(body, end, block)
            if packed:
                mz, y = np.frombuffer(zlib.decompress(data[: sizes[0]]), "<f8"), np.frombuffer(zlib.decompress(data[sizes[0] :]), "<f4")
            else:
                both = np.frombuffer(data, [("mz", "<f8"), ("y", "<f4")])
                mz, y = both["mz"], both["y"]
            yield _row(part.sample, head.scan, level, head.rt, mz, y, head.precursor if level > 1 else None)
        at = end


class Cursor:
    """Numbers and names of a NetCDF header, one after another."""

    def __init__(self, source: Source) -> None:
        self.source, self.at = source, 0

    def take(self, n: int) -> bytes:
        data = self.source.read(self.at, self.at + n)
        if len(data) < n:
            raise ValueError("the NetCDF header is cut off")
        self.at += n
        return data

    def number(self, n: int = 4) -> int:
        return int.from_bytes(self.take(n), "big")

    def padded(self, n: int) -> bytes:
        return self.take(n + -n % 4)[:n]

    def name(self) -> str:
        return self.padded(self.number()).decode()

    def attributes(self) -> dict[str, str | np.ndarray]:
        self.number()
        out = {}
        for _ in range(self.number()):
            name, kind, n = self.name(), _TYPES[self.number()], self.number()
            data = self.padded(n * np.dtype(kind).itemsize)
            out[name] = data.rstrip(b"\0").decode("latin-1") if kind == "S1" else np.frombuffer(data, kind)
        return out


@dataclass
class Variable:
    kind: np.dtype
    length: int
    begin: int
    step: int


class NetCdf:
    """A classic NetCDF file: attributes, and ranges of its one-dimensional variables, of fixed length or by records.

    Each variable is read through a block of its own, since they lie apart.
    """

    def __init__(self, path: str, size: int) -> None:
        self.path, self.size, self.sources = path, size, {}
        c = Cursor(Source(path, size))
        magic = c.take(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2):
            raise ValueError("not a classic NetCDF file")
        rows = c.number()
        c.number()
        dims = [(c.name(), c.number())[1] for _ in range(c.number())]
        self.attributes = c.attributes()
        c.number()
        found = []
        for _ in range(c.number()):
            name = c.name()
            of = [dims[c.number()] for _ in range(c.number())]
            c.attributes()
            kind, size, begin = np.dtype(_TYPES[c.number()]), c.number(), c.number(8 if magic[3] == 2 else 4)
            found.append((name, of, kind, size, begin))
        by_row = [x for x in found if x[1] and x[1][0] == 0]
        row = sum(x[3] for x in by_row) if len(by_row) > 1 else sum(x[2].itemsize * int(np.prod(x[1][1:], dtype=int)) for x in by_row)
        if by_row and rows == 2**32 - 1:
            rows = (self.size - min(x[4] for x in by_row)) // row
        self.variables = {name: Variable(kind, rows if (name, of, kind, size, begin) in by_row else of[0], begin, row if (name, of, kind, size, begin) in by_row else kind.itemsize) for name, of, kind, size, begin in found if len(of) == 1}

    def values(self, name: str, first: int, last: int) -> np.ndarray:
        """Values first .. last - 1 of a variable, fewer where it or the file ends."""
        v = self.variables[name]
        last = min(last, v.length, max(0, (self.size - v.begin - v.kind.itemsize) // v.step + 1))
        if last <= first:
            return np.empty(0)
        source = self.sources.get(name) or Source(self.path, self.size)
        self.sources[name] = source
        data = np.frombuffer(source.read(v.begin + first * v.step, v.begin + (last - 1) * v.step + v.kind.itemsize), np.uint8)
        rows = np.lib.stride_tricks.as_strided(data, (last - first, v.kind.itemsize), (v.step, 1))
        return np.ascontiguousarray(rows).view(v.kind).ravel()

    def factor(self, name: str, default: float) -> float:
        found = self.attributes.get(name)
        return float(found[0]) if isinstance(found, np.ndarray) and len(found) else default


def andi(part: Part, wanted: Wanted) -> Iterator[dict]:
    """Scans of an ANDI file; a part takes as large a share of the scans as its bytes are of the file's. All are of level 1."""
    held = NetCdf(part.path, part.size)
    n = held.variables["scan_index"].length
    first, last = n * part.first // part.size, n * part.last // part.size
    scale_mz, scale_y, more = held.factor("raw_data_mass_factor", 1.0), held.factor("raw_data_intensity_factor", 1.0), held.factor("raw_data_intensity_offset", 0.0)
    polarity = 1 if str(held.attributes.get("test_ionization_polarity", "")).lower().startswith("positive") else -1
    for block in range(first, last, 10_000):
        end = min(block + 10_000, last)
        at, count, seconds = (held.values(name, block, end) for name in ("scan_index", "point_count", "scan_acquisition_time"))
        numbers = held.values("actual_scan_number", block, end) if "actual_scan_number" in held.variables else np.arange(block, end)
        for number, begin, points, second in zip(numbers.tolist(), at.tolist(), count.tolist(), seconds.tolist(), strict=False):
            if points > 0 and wanted.admits(scan_id=number, mslevel=1, rt=second / 60):
                mz, y = held.values("mass_values", begin, begin + points), held.values("intensity_values", begin, begin + points)
                if len(mz) == len(y) == points:
                    yield _row(part.sample, number, 1, second / 60, mz * scale_mz, y * scale_y + more, polarity=polarity)


class BinaryReader(SpectraReader):
    def partitions(self) -> list[Part]:
        out = []
        for path, (name, size) in listed(self.pattern):
            sample = re.sub(r"\.[^.]*$", "", name)
            if self.wanted.admits(sample=sample):
                out += [Part(path, sample, kind_of(path), a, min(a + self.partition, size), size) for a in range(0, size, self.partition)]
        return out or [Part("", "", "", 0, 0, 0)]

    def scans(self, part: Part) -> Iterator[dict]:
        return andi(part, self.wanted) if part.kind == "andi" else records(part, self.wanted, Source(part.path, part.size))


class BinarySource(DataSource):
    """``binary_spectra``: options path, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "binary_spectra"

    def schema(self) -> str:
        return xml_files.SCANS

    def reader(self, schema: StructType) -> BinaryReader:
        return BinaryReader(schema, self.options)


def read_binary(spark: SparkSession, path: str, partition_bytes: int = PARTITION) -> DataFrame:
    """Scans (``xml_files.SCANS``) of the files of ``path``: a file, a directory, or a pattern for the names in one."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BinarySource)
    return spark.read.format("binary_spectra").option("path", path).option("partitionBytes", partition_bytes).load()
