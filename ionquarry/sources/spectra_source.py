"""Spectra files as a Spark data source: many tasks for one file, filters that skip what they don't ask for, an indexed writer.

    read_spectra(spark, "/data/run*.mzML").filter("mslevel = 2 AND rt BETWEEN 10 AND 12")
    write_spectra(scans, "/data/out")

A file is cut into ranges of bytes from its size alone. A task takes the spectra that begin in its range: it finds them by the
file's own index, or, where there is none, by their opening tags. Of a spectrum that filters leave out no more than its head
is read. Files are opened through pyarrow's file systems (local, HDFS, S3, GCS); for other stores there is
``xml_files.read_scans``, which goes through Spark's reader.
"""

from __future__ import annotations

import fnmatch
import gzip
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ionquarry.sources import codecs, xml_files

#: Bytes of a file that a task takes, of a spectrum's head, and that are read at a time.
PARTITION, HEAD, BLOCK = 64 << 20, 4096, 4 << 20
#: Opening tag of a spectrum, the tag that ends it, the list of chromatograms, and the place of the index, by format.
_OPENS = {"mzml": re.compile(rb"<spectrum[\s>]"), "mzxml": re.compile(rb"<scan[\s>]")}
_OTHERS = re.compile(rb"<chromatogramList[\s>]")
_INDEX_AT = re.compile(rb"<(?:indexListOffset|indexOffset)>\s*(\d+)\s*<")
_OFFSET = re.compile(rb"<offset[^>]*>\s*(\d+)\s*<")
_LEVEL, _TIME, _ORDER = re.compile(rb'name="ms level"[^>]*?value="(\d+)"'), re.compile(rb'<cvParam[^>]*name="scan start time"[^>]*>'), re.compile(rb'^<spectrum[^>]*?\sindex="(\d+)"')
_TAG = re.compile(rb"^<scan[^>]*>")


def _attribute(tag: bytes, name: str) -> str | None:
    found = re.search(rb'\s%s="([^"]*)"' % name.encode(), tag)
    return found[1].decode() if found else None


@dataclass
class Wanted:
    """What filters ask for: bounds and values of the columns that a spectrum's head tells."""

    low: dict[str, float] = field(default_factory=dict)
    high: dict[str, float] = field(default_factory=dict)
    values: dict[str, set] = field(default_factory=dict)

    def take(self, f: Filter) -> None:
        """Narrows by a filter; others are left to Spark, which tests all of them again."""
        name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        if name not in ("sample", "scan_id", "mslevel", "rt"):
            return
        if isinstance(f, EqualTo | In):
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.values[name] = self.values.get(name, asked) & asked
        elif isinstance(f, GreaterThan | GreaterThanOrEqual) and name != "sample":
            self.low[name] = max(self.low.get(name, f.value), f.value)
        elif isinstance(f, LessThan | LessThanOrEqual) and name != "sample":
            self.high[name] = min(self.high.get(name, f.value), f.value)

    def __bool__(self) -> bool:
        return bool(self.low or self.high or self.values)

    def admits(self, **known) -> bool:
        """Whether a spectrum with these values may be asked for; None is not known."""
        for name, value in known.items():
            if value is not None and (value < self.low.get(name, value) or value > self.high.get(name, value) or name in self.values and value not in self.values[name]):
                return False
        return True


@dataclass
class Part(InputPartition):
    path: str
    sample: str
    kind: str
    first: int
    last: int
    size: int


class Source:
    """Random access to a file, a few megabytes at a time."""

    def __init__(self, path: str, size: int) -> None:
        system, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        self.file, self.size, self.at, self.held, self.bytes_read = system.open_input_file(inner), size, 0, b"", 0

    def read(self, first: int, last: int, block: int = 0) -> bytes:
        first, last = max(0, first), min(last, self.size)
        if first < self.at or last > self.at + len(self.held):
            take = min(max(last - first, block or BLOCK), self.size - first)
            self.held, self.at = self.file.read_at(max(0, take), first), first
            self.bytes_read += len(self.held)
        return self.held[first - self.at : last - self.at]

    def find(self, pattern: re.Pattern, first: int, last: int) -> Iterator[int]:
        """Where the pattern (shorter than 64 bytes) begins in [first, last)."""
        while first < last:
            data = self.read(first, min(first + BLOCK, last) + 64)
            end = min(first + BLOCK, last)
            yield from (first + m.start() for m in pattern.finditer(data) if first + m.start() < end)
            first = end


def index_of(source: Source, kind: str) -> list[int] | None:
    """Offsets of all spectra by the file's index; None where there is none or it leads astray."""
    found = _INDEX_AT.search(source.read(source.size - 1024, source.size))
    if not found or int(found[1]) >= source.size:
        return None
    data = source.read(int(found[1]), source.size)
    part = re.search(rb'<index\s+name="(?:spectrum|scan)"\s*>(.*?)</index>', data, re.DOTALL)
    out = [int(x) for x in _OFFSET.findall(part[1])] if part else []
    ends = (out[0], out[len(out) // 2], out[-1]) if out else ()
    if out != sorted(out) or not all(_OPENS[kind].match(source.read(at, at + 16, 16)) for at in ends):
        return None
    return out


class SpectraReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.wanted = Wanted()
        self.schema, self.pattern, self.partition = schema, options["path"], int(options.get("partitionbytes", PARTITION))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            self.wanted.take(f)
            yield f

    def partitions(self) -> list[Part]:
        out = []
        for path, name in listed(self.pattern):
            sample = re.sub(r"\.[^.]*(\.gz)?$", "", name[0])
            if not self.wanted.admits(sample=sample):
                continue
            kind, size = xml_files.kind_of(path), name[1]
            step = self.partition if kind in _OPENS and not path.endswith(".gz") else max(1, size)
            out += [Part(path, sample, kind, a, min(a + step, size), size) for a in range(0, size, step)]
        return out or [Part("", "", "", 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows, points, schema = [], 0, to_arrow_schema(self.schema)
        for row in self.scans(partition) if partition.path else ():
            rows.append(row)
            points += len(row["mz"])
            if points > 500_000 or len(rows) >= 5000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, points = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def scans(self, part: Part) -> Iterator[dict]:
        return scans_of(part, self.wanted)


def listed(pattern: str) -> list[tuple[str, tuple[str, int]]]:
    """(path, (name, size)) of the files of a path: a file, a directory, or a pattern for names in one."""
    scheme = f"{pattern.partition('://')[0]}://" if "://" in pattern else ""
    system, inner = pafs.FileSystem.from_uri(pattern) if scheme and not re.search(r"[*?\[]", pattern) else (None, pattern.removeprefix("file://"))
    if system is None:
        folder, _, name = inner.rpartition("/")
        system, folder = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder or ".")
        if not re.search(r"[*?\[]", name):
            folder, name = f"{folder}/{name}", None
    else:
        folder, name = inner, None
    if name is None and system.get_file_info(folder).type == pafs.FileType.File:
        infos = [system.get_file_info(folder)]
    else:
        infos = [x for x in system.get_file_info(pafs.FileSelector(folder, allow_not_found=False)) if x.type == pafs.FileType.File and not x.base_name.startswith((".", "_"))]
    infos = [x for x in infos if name is None or fnmatch.fnmatch(x.base_name, name)]
    outer = scheme if scheme not in ("", "file://") else ""
    return sorted((f"{outer}{x.path}", (x.base_name, x.size)) for x in infos)


def scans_of(part: Part, wanted: Wanted | None = None, source: Source | None = None) -> Iterator[dict]:
    """Rows of the spectra that begin in the part's bytes and that the filters may ask for."""
    wanted, source = wanted or Wanted(), source or Source(part.path, part.size)
    if part.kind not in _OPENS or part.path.endswith(".gz"):
        data = source.read(0, part.size)
        for row in xml_files.PARSERS[part.kind](gzip.decompress(data) if part.path.endswith(".gz") else data, part.sample):
            if wanted.admits(scan_id=row["scan_id"], mslevel=row["mslevel"], rt=row["rt"]):
                yield row
        return
    index = index_of(source, part.kind)
    if index is None:
        before, opens = None, source.find(_OPENS[part.kind], part.first, part.last)
    else:
        before, last = np.searchsorted(index, [part.first, part.last])
        opens = iter(index[before:last])
    found = 0
    for at in opens:
        head = source.read(at, at + HEAD, HEAD if wanted else 0)
        if part.kind == "mzml":
            order = _ORDER.match(head)
            if order:
                number = int(order[1])
            else:
                before = sum(1 for _ in Source(part.path, part.size).find(_OPENS["mzml"], 0, part.first)) if before is None else before
                number = int(before) + found
        else:
            tag = _TAG.match(head)
            number = int(_attribute(tag[0], "num") or 0) if tag else None
        found += 1
        if not wanted or wanted.admits(scan_id=number, **_told(head, part.kind)):
            yield _parsed(source, at, part, number)
    if not found and part.kind == "mzml" and part.first == 0 and (index == [] or index is None and _no_spectra(source)):
        for row in xml_files.mzml(source.read(0, part.size), part.sample):  # chromatograms alone: points of all of them, by rt
            if wanted.admits(scan_id=row["scan_id"], mslevel=row["mslevel"], rt=row["rt"]):
                yield row


def _no_spectra(source: Source) -> bool:
    """Whether chromatograms come before any spectrum; spectra would stand first."""
    either = re.compile(b"|".join((_OPENS["mzml"].pattern, _OTHERS.pattern, rb"<chromatogram[\s>]")))
    at = next(source.find(either, 0, source.size), None)
    return at is not None and not _OPENS["mzml"].match(source.read(at, at + 16))


def _told(head: bytes, kind: str) -> dict:
    """Level and minutes of rt that the head of a spectrum tells, if it does."""
    if kind == "mzxml":
        tag = _TAG.match(head)
        return {"mslevel": int(_attribute(tag[0], "msLevel") or 1), "rt": xml_files._duration(_attribute(tag[0], "retentionTime"))} if tag else {}
    level, time = _LEVEL.search(head), _TIME.search(head)
    if level and head.find(b"</spectrum>", 0, level.start()) >= 0 or time and head.find(b"</spectrum>", 0, time.start()) >= 0:
        return {}  # those of the next spectrum
    value = xml_files._number(_attribute(time[0], "value")) if time else None
    return {"mslevel": int(level[1]) if level else None, "rt": xml_files._minutes(value, _attribute(time[0], "unitName") or "") if time else None}


def _parsed(source: Source, at: int, part: Part, number: int | None) -> dict:
    ends, take = (re.compile(rb"</spectrum>"), HEAD) if part.kind == "mzml" else (re.compile(rb"</scan>|<scan[\s>]|</msRun>"), HEAD)
    while True:
        data = source.read(at, at + take)
        end = ends.search(data, 5)
        if end or at + take >= part.size:
            break
        take *= 2
    if part.kind == "mzml":
        return xml_files.mzml_scan(ElementTree.fromstring(data[: end.end()]), part.sample, number)
    own = data[: end.start()] if end else data
    return xml_files.mzxml_scan(ElementTree.fromstring(own + b"</scan>"), part.sample)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class SpectraWriter(DataSourceWriter):
    """An indexed mzML file for each sample; a file comes under its name only when all tasks are done."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.folder = schema.names, options["path"].rstrip("/")
        self.coding, self.run = options.get("coding", "zlib"), uuid.uuid4().hex

    def _system(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.folder) if "://" in self.folder else (pafs.LocalFileSystem(), self.folder)

    def write(self, iterator: Iterator) -> Written:
        system, folder = self._system()
        system.create_dir(folder, recursive=True)
        out, files, done = None, [], set()
        for row in iterator:
            values = dict(zip(self.names, row, strict=True))
            if out is None or values["sample"] != out.sample:
                if out:
                    out.close()
                if values["sample"] in done:
                    raise ValueError("the rows of a sample must follow one another in one task; see write_spectra")
                done.add(values["sample"])
                name = f"{folder}/{re.sub(r'[^A-Za-z0-9_.-]', '_', values['sample'] or 'null')}.mzML"
                files.append((f"{name}.{self.run}-{uuid.uuid4().hex}.tmp", name))
                out = MzmlFile(system.open_output_stream(files[-1][0]), values["sample"], self.coding)
            out.add(values)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        system, _ = self._system()
        moves = [f for m in messages if m for f in m.files]
        if len({name for _, name in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("two samples, or two tasks, would write one file")
        for held, name in moves:
            system.move(held, name)

    def abort(self, messages: list) -> None:
        system, _ = self._system()
        for held, _ in (f for m in messages if m for f in m.files):
            system.delete_file(held)


class MzmlFile:
    """An indexed mzML file, written spectrum by spectrum; offsets are sums of what has been written."""

    def __init__(self, stream, sample: str, coding: str) -> None:
        self.stream, self.sample, self.coding, self.at, self.index = stream, sample, coding, 0, []
        self._put(f'<?xml version="1.0" encoding="utf-8"?>\n<indexedmzML xmlns="http://psi.hupo.org/ms/mzml"><mzML version="1.1.0"><run id={quoteattr(sample or "")}><spectrumList>\n')

    def _put(self, text: str) -> None:
        data = text.encode()
        self.stream.write(data)
        self.at += len(data)

    def _array(self, name: str, values: list[float]) -> str:
        press = {"numpress": ("MS-Numpress linear prediction compression", codecs.linear) if name == "m/z array" else ("MS-Numpress short logged float compression", codecs.logarithms)}.get(self.coding)
        if press and len(values):
            label, data = press[0], codecs.base64.b64encode(press[1](values)).decode()
        else:
            label, data = "zlib compression" if self.coding != "none" else "no compression", codecs.encoded(values, 64, self.coding != "none")
        return f'<binaryDataArray encodedLength="{len(data)}"><cvParam cvRef="MS" name="64-bit float"/><cvParam cvRef="MS" name="{label}"/><cvParam cvRef="MS" name="{name}"/><binary>{data}</binary></binaryDataArray>'

    def add(self, v: dict) -> None:
        number = int(v["scan_id"])
        self.index.append((number, self.at))
        param = lambda name, value: f'<cvParam cvRef="MS" name="{name}" value={quoteattr(str(value))}/>'
        own = param("ms level", v["mslevel"])
        if v.get("polarity"):
            own += param("positive scan" if v["polarity"] > 0 else "negative scan", "")
        if v.get("filter_line") is not None:
            own += param("filter string", v["filter_line"])
        time = f'<scanList count="1"><scan><cvParam cvRef="MS" name="scan start time" value="{v["rt"]!r}" unitName="minute"/></scan></scanList>' if v.get("rt") is not None else ""
        energy = f"<activation>{param('collision energy', repr(v['collision_energy']))}</activation>" if v.get("collision_energy") is not None else ""
        before = f'<precursorList count="1"><precursor><isolationWindow>{param("isolation window target m/z", repr(v["precursor_mz"]))}</isolationWindow>{energy}</precursor></precursorList>' if v.get("precursor_mz") is not None else ""
        mz, y = (list(v[c] or ()) for c in ("mz", "intensity"))
        self._put(f'<spectrum index="{number}" id="scan={number}" defaultArrayLength="{len(mz)}">{own}{time}{before}<binaryDataArrayList count="2">{self._array("m/z array", mz)}{self._array("intensity array", y)}</binaryDataArrayList></spectrum>\n')

    def close(self) -> None:
        self._put("</spectrumList></run></mzML>\n")
        start = self.at
        self._put('<indexList count="1"><index name="spectrum">\n')
        for number, at in self.index:
            self._put(f'<offset idRef="scan={number}">{at}</offset>\n')
        self._put(f"</index></indexList>\n<indexListOffset>{start}</indexListOffset></indexedmzML>\n")
        self.stream.close()


class SpectraSource(DataSource):
    """``spectra``: options path, partitionBytes (reading), coding (writing: zlib, none, numpress)."""

    @classmethod
    def name(cls) -> str:
        return "spectra"

    def schema(self) -> str:
        return xml_files.SCANS

    def reader(self, schema: StructType) -> SpectraReader:
        return SpectraReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> SpectraWriter:
        return SpectraWriter(schema, self.options)


def read_spectra(spark: SparkSession, path: str, partition_bytes: int = PARTITION) -> DataFrame:
    """Scans (``xml_files.SCANS``) of the files of ``path``: a file, a directory, or a pattern for the names in one.

    Filters on sample, scan_id, mslevel and rt (comparisons and lists of values) reach the files. mzML scans are numbered by
    their index attribute, or from 0 in order; mzXML scans by num. Compressed files (.gz) and the formats without plain
    text (mzData, SQLite) are one task's each. Files without scans give no rows; empty files neither.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SpectraSource)
    return spark.read.format("spectra").option("path", path).option("partitionBytes", partition_bytes).load()


def write_spectra(scans: DataFrame, path: str, coding: str = "zlib") -> None:
    """One indexed mzML file for each sample in the folder ``path``, spectra by rising scan_id; numpress rounds the values.

    A sample's rows meet in one task, which streams them; repeated scan_ids stay. Characters of a sample's name that file
    names shouldn't hold become _; a null sample is ``null``. An empty table writes nothing.
    """
    scans.sparkSession.dataSource.register(SpectraSource)
    scans.repartition("sample").sortWithinPartitions("sample", "scan_id").write.format("spectra").option("path", path).option("coding", coding).mode("append").save()
