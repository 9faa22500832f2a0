"""Spectra in mzML, mzXML, mzData and SQLite files, read as scans through Spark's own file reader, so from any store it reaches.

One row for each scan, in the schema ``SCANS``: rt in minutes, spectra in order of m/z, points without intensity left out of
mzXML. Here a file is parsed as a stream by one task (Spark's binary reader takes files of up to 2 GB); ``spectra_source``
reads one mzML or mzXML file by many tasks, and leaves out what filters don't ask for. Files that hold no scans give no rows.
"""

from __future__ import annotations

import io
import re
import sqlite3
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionquarry.sources import codecs

SCANS = "sample string, scan_id long, mslevel int, rt double, precursor_mz double, product_mz double, polarity int, filter_line string, collision_energy double, mz array<double>, intensity array<double>"
_NAMES = [c.split()[0] for c in SCANS.split(", ")]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _elements(data: bytes, wanted: set[str]) -> Iterator[ElementTree.Element]:
    """Whole elements of the wanted names, each cleared after use."""
    for _, element in ElementTree.iterparse(io.BytesIO(data), events=("end",)):
        if _local(element.tag) in wanted:
            yield element
            element.clear()


def _params(element: ElementTree.Element) -> dict[str, tuple[str, str]]:
    """Name to (value, unit) of the cvParams anywhere below."""
    return {p.get("name", ""): (p.get("value", ""), p.get("unitName", "")) for p in element.iter() if _local(p.tag) == "cvParam"}


def _number(text: str | None) -> float | None:
    try:
        return float(text) if text else None
    except ValueError:
        return None


def _minutes(value: float | None, unit: str) -> float | None:
    return None if value is None else value / 60 if unit.startswith("second") else value


def _arrays(element: ElementTree.Element) -> dict[str, np.ndarray]:
    """m/z, intensity and time arrays of a spectrum or chromatogram."""
    out = {}
    for array in (x for x in element.iter() if _local(x.tag) == "binaryDataArray"):
        names = set(_params(array))
        text = next((x.text for x in array.iter() if _local(x.tag) == "binary"), "") or ""
        kind = next((k for k in ("m/z array", "intensity array", "time array") if k in names), None)
        press = next((k for k, mark in (("linear", "linear prediction"), ("pic", "positive integer"), ("slof", "short logged float")) if any(mark in n for n in names)), None)
        if kind is None:
            continue
        if press:
            raw = codecs.base64.b64decode(text)
            out[kind] = codecs.NUMPRESS[press](codecs.zlib.decompress(raw) if any("zlib" in n for n in names) else raw)
        else:
            out[kind] = codecs.floats(text, 64 if "64-bit float" in names else 32, "zlib compression" in names)
        unit = next((u for n, (_, u) in _params(array).items() if n == "time array"), "")
        if kind == "time array" and unit.startswith("second"):
            out[kind] = out[kind] / 60
    return out


def _row(sample: str, scan: int, **values) -> dict:
    return dict.fromkeys(_NAMES) | {"sample": sample, "scan_id": scan} | values


def _target(element: ElementTree.Element) -> float | None:
    p = _params(element)
    return _number(p.get("isolation window target m/z", ("", ""))[0]) or _number(p.get("selected ion m/z", ("", ""))[0])


def _polarity(p: dict[str, tuple[str, str]]) -> int:
    return 1 if "positive scan" in p else -1 if "negative scan" in p else 0


def mzml_scan(element: ElementTree.Element, sample: str, scan: int) -> dict:
    """The row of a spectrum element."""
    arrays, p = _arrays(element), _params(element)
    y, mz = arrays.get("intensity array", np.zeros(0)), arrays.get("m/z array", np.zeros(0))
    order = np.argsort(mz[: len(y)], kind="stable")
    # of a third-level scan's two precursors, the last is the one that was isolated last
    precursors = [x for x in element.iter() if _local(x.tag) == "precursor"]
    value, unit = p.get("scan start time", ("", ""))
    level = int(_number(p.get("ms level", ("1", ""))[0]) or 1)
    return _row(sample, scan, mslevel=level, rt=_minutes(_number(value), unit), precursor_mz=_target(precursors[-1]) if precursors else None, polarity=_polarity(p), filter_line=p.get("filter string", (None, ""))[0], collision_energy=_number(p.get("collision energy", ("", ""))[0]), mz=mz[order].tolist(), intensity=y[order].tolist())


def mzml(data: bytes, sample: str) -> Iterator[dict]:
    """Scans of an mzML file's spectra; without spectra, one for each point of its SRM chromatograms, in order of rt, from 1."""
    scans, found = 0, []
    for element in _elements(data, {"spectrum", "chromatogram"}):
        if _local(element.tag) == "spectrum":
            yield mzml_scan(element, sample, scans)
            scans += 1
            continue
        arrays, p = _arrays(element), _params(element)
        first = lambda name: next((_target(x) for x in element.iter() if _local(x.tag) == name), None)  # noqa: B023, E731
        q1, q3 = first("precursor"), first("product")
        if q1 and q3 and q1 > 0 and q3 > 0:
            more = (q1, q3, element.get("id", ""), _polarity(p), _number(p.get("collision energy", ("", ""))[0]))
            found += [(t, i, *more) for t, i in zip(arrays.get("time array", np.zeros(0)).tolist(), arrays.get("intensity array", np.zeros(0)).tolist(), strict=False)]
    if not scans:
        for k, (t, i, q1, q3, line, polarity, energy) in enumerate(sorted(found), 1):
            yield _row(sample, k, mslevel=2, rt=t, precursor_mz=q1, product_mz=q3, polarity=polarity, filter_line=line, collision_energy=energy, mz=[q3], intensity=[i])


def _duration(text: str | None) -> float | None:
    """Minutes of ``PT12.3S``, or of plain minutes."""
    found = re.fullmatch(r"PT(?:(\d+)H)?(?:([\d.]+)M)?(?:([\d.]+)S)?", text or "")
    if not found:
        return _number(text)
    hours, minutes, seconds = (float(x or 0) for x in found.groups())
    return hours * 60 + minutes + seconds / 60


def mzxml_scan(element: ElementTree.Element, sample: str) -> dict:
    """The row of a scan element; scans inside it are not looked at."""
    child = {_local(x.tag): x for x in element if _local(x.tag) in ("peaks", "precursorMz")}
    peaks, precursor = child.get("peaks"), child.get("precursorMz")
    both = np.zeros(0)
    if peaks is not None and peaks.text:
        both = codecs.floats(peaks.text, int(peaks.get("precision", "32")), peaks.get("compressionType") == "zlib", True)
    pairs = both[: len(both) // 2 * 2].reshape(-1, 2)
    pairs = pairs[pairs[:, 1] > 0]
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    line, q1 = element.get("filterLine"), _number(precursor.text) if precursor is not None else None
    level = int(element.get("msLevel", "1"))
    polarity = {"+": 1, "-": -1}.get(element.get("polarity") or (line or "")[12:13], 0)
    if line is None and element.get("scanType") in ("MRM", "SRM") and len(pairs):
        line = f"SRM ms2 {q1 or 0:.3f} [{pairs[0, 0]:.3f}-{pairs[-1, 0]:.3f}]"
    return _row(sample, int(element.get("num", "0")), mslevel=level, rt=_duration(element.get("retentionTime")), precursor_mz=q1, product_mz=float(pairs[0, 0]) if level > 1 and len(pairs) else None, polarity=polarity, filter_line=line, collision_energy=_number(element.get("collisionEnergy")), mz=pairs[:, 0].tolist(), intensity=pairs[:, 1].tolist())


def mzxml(data: bytes, sample: str) -> Iterator[dict]:
    """Scans of an mzXML file, nested ones too; points without intensity are left out, a missing filter line of an SRM scan is made."""
    for event, element in ElementTree.iterparse(io.BytesIO(data), events=("start", "end")):
        if event == "end" and _local(element.tag) == "scan":
            yield mzxml_scan(element, sample)
            element.clear()


def mzdata(data: bytes, sample: str) -> Iterator[dict]:
    """Scans of an mzData file."""
    for element in _elements(data, {"spectrum"}):
        p = _params(element)
        level = next((int(x.get("msLevel", "1")) for x in element.iter() if _local(x.tag) == "spectrumInstrument"), 1)
        arrays = []
        for name in ("mzArrayBinary", "intenArrayBinary"):
            held = next((d for x in element.iter() if _local(x.tag) == name for d in x.iter() if _local(d.tag) == "data"), None)
            arrays.append(np.zeros(0) if held is None else codecs.floats(held.text, int(held.get("precision", "32")), big_endian=held.get("endian") == "big"))
        n = min(map(len, arrays))
        order = np.argsort(arrays[0][:n], kind="stable")
        rt = _number(p["TimeInMinutes"][0]) if "TimeInMinutes" in p else _minutes(_number(p.get("TimeInSeconds", ("", ""))[0]), "second")
        polarity = {"positive": 1, "negative": -1}.get(p.get("Polarity", ("", ""))[0].lower(), 0)
        precursor = _number(p.get("MassToChargeRatio", p.get("mz", ("", "")))[0])
        yield _row(sample, int(element.get("id", "0")), mslevel=level, rt=rt, precursor_mz=precursor, polarity=polarity, mz=arrays[0][order].tolist(), intensity=arrays[1][order].tolist())


def kind_of(path: str) -> str:
    """The format that the file's name holds; mzXML where it holds none."""
    return next((k for k in ("mzdata", "mzxml", "mzml", "sqlite") if k in path.rpartition("/")[2].lower()), "mzxml")


def sqlite(data: bytes, sample: str) -> Iterator[dict]:
    """Scans of an SQLite file of spectra (tables msScan and msScanData), read from memory; blobs hold doubles and floats, deflated or not."""
    base = sqlite3.connect(":memory:")
    base.deserialize(data)
    sql = "SELECT startScanNumber, level, retentionTime, precursorMZ, peakCount, peakMZ, peakIntensity FROM msScan JOIN msScanData ON msScan.id = scanID ORDER BY msScan.id"
    for scan, level, rt, precursor, count, mz, y in base.execute(sql):
        arrays = []
        for blob, kind in ((mz, "<f8"), (y, "<f4")):
            raw = blob or b""
            raw = raw if len(raw) == (count or 0) * int(kind[-1]) else codecs.zlib.decompress(raw)
            arrays.append(np.frombuffer(raw, kind).astype(float))
        order = np.argsort(arrays[0], kind="stable")
        yield _row(sample, scan, mslevel=level, rt=rt, precursor_mz=precursor if precursor and precursor > 0 else None, polarity=0, mz=arrays[0][order].tolist(), intensity=arrays[1][order].tolist())
    base.close()


PARSERS = {"mzml": mzml, "mzxml": mzxml, "mzdata": mzdata, "sqlite": sqlite}


def read_scans(spark: SparkSession, path: str, mslevel: int | None = None) -> DataFrame:
    """Scans of the files at ``path`` (a glob), of one ``mslevel`` if given: other spectra are then not kept in memory."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                sample, rows = re.sub(r"\.[^.]*(\.gz)?$", "", name.rpartition("/")[2]), []
                for row in PARSERS[kind_of(name)](content, sample):
                    if mslevel is None or row["mslevel"] == mslevel:
                        rows.append(row)
                    if len(rows) >= 500:
                        yield pd.DataFrame(rows, columns=_NAMES)
                        rows = []
                yield pd.DataFrame(rows, columns=_NAMES)

    return files.mapInPandas(run, SCANS)


def sample_table(scans: DataFrame) -> DataFrame:
    """(sample, sample_id, is_blank, scans, mz and rt ranges): ids count from 0 by name; blanks have blank in their name."""
    n = F.size("mz")
    sized = scans.withColumns({"_lo": F.when(n > 0, F.array_min("mz")), "_hi": F.when(n > 0, F.array_max("mz"))})
    held = sized.groupBy("sample").agg(F.count(F.lit(1)).alias("scans"), F.min("_lo").alias("mzmin"), F.max("_hi").alias("mzmax"), F.min("rt").alias("rtmin"), F.max("rt").alias("rtmax"))
    return held.withColumns({"sample_id": F.row_number().over(Window.orderBy("sample")) - 1, "is_blank": F.contains(F.lower("sample"), F.lit("blank"))})


def points(scans: DataFrame) -> DataFrame:
    """One row for each peak: the scan's columns with mz and intensity."""
    return scans.withColumn("_p", F.explode(F.arrays_zip("mz", "intensity"))).drop("mz", "intensity").select("*", F.col("_p.mz").alias("mz"), F.col("_p.intensity").alias("intensity")).drop("_p")


def corrected_precursors(scans: DataFrame, ppm: float = 20.0, look_back: int = 50) -> DataFrame:
    """``scans`` with precursor_mz moved to the highest peak near it in the last full scan, in 1 to 5 times the tolerance; else as it is."""
    order = Window.partitionBy("sample").orderBy("scan_id").rowsBetween(-look_back, -1)
    last = F.last(F.when(F.col("mslevel") == 1, F.struct("mz", "intensity")), ignorenulls=True).over(order)
    held = scans.withColumn("_full", F.when(F.col("mslevel") > 1, last))
    peaks = F.arrays_zip(F.col("_full.mz").alias("mz"), F.col("_full.intensity").alias("intensity"))

    def best(times: int):
        near = F.filter(peaks, lambda p: F.abs(p["mz"] - F.col("precursor_mz")) <= F.col("precursor_mz") * ppm * times / 1e6)
        return F.array_max(F.transform(near, lambda p: F.struct(p["intensity"].alias("y"), (-p["mz"]).alias("neg"))))["neg"] * -1

    return held.withColumn("precursor_mz", F.coalesce(*[best(k) for k in range(1, 6)], F.col("precursor_mz"))).drop("_full")


def as_mzml(scans: DataFrame, compressed: bool = True) -> DataFrame:
    """(sample, sequence, value): the lines of an mzML file of each sample, to be written in order of sequence."""
    mz, y = (codecs.encoded_floats(F.col(c), 64, compressed) for c in ("mz", "intensity"))
    param = lambda name, value="": F.concat(F.lit(f'<cvParam cvRef="MS" name="{name}" value="'), value if not isinstance(value, str) else F.lit(value), F.lit('"/>'))
    minute = F.concat(F.lit('<cvParam cvRef="MS" name="scan start time" unitName="minute" value="'), F.col("rt").cast("string"), F.lit('"/>'))
    packed = '<cvParam cvRef="MS" name="zlib compression"/>' if compressed else ""
    array = lambda kind, data: F.concat(F.lit(f'<binaryDataArray><cvParam cvRef="MS" name="{kind}"/><cvParam cvRef="MS" name="64-bit float"/>{packed}<binary>'), data, F.lit("</binary></binaryDataArray>"))
    target = F.when(F.col("precursor_mz").isNotNull(), F.concat(F.lit("<precursorList><precursor><isolationWindow>"), param("isolation window target m/z", F.col("precursor_mz").cast("string")), F.lit("</isolationWindow></precursor></precursorList>"))).otherwise("")
    polarity = F.when(F.col("polarity") > 0, param("positive scan")).when(F.col("polarity") < 0, param("negative scan")).otherwise("")
    line = F.when(F.col("filter_line").isNotNull(), param("filter string", F.replace(F.replace(F.replace("filter_line", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;")))).otherwise("")
    body = F.concat(F.lit('<spectrum id="scan='), F.col("scan_id").cast("string"), F.lit('">'), param("ms level", F.col("mslevel").cast("string")), polarity, line, F.lit("<scanList><scan>"), minute, F.lit("</scan></scanList>"), target, F.lit("<binaryDataArrayList>"), array("m/z array", mz), array("intensity array", y), F.lit("</binaryDataArrayList></spectrum>"))
    ends = scans.select("sample").distinct()
    head = ends.select("sample", F.lit(-1).cast("long").alias("sequence"), F.lit('<?xml version="1.0"?><mzML><run><spectrumList>').alias("value"))
    tail = ends.select("sample", F.lit(2**62).alias("sequence"), F.lit("</spectrumList></run></mzML>").alias("value"))
    return head.unionByName(scans.select("sample", F.col("scan_id").alias("sequence"), body.alias("value"))).unionByName(tail)


def write_mzml(scans: DataFrame, path: str, compressed: bool = True) -> None:
    """One directory ``sample=...`` with one mzML file for each sample."""
    lines = as_mzml(scans, compressed).repartition("sample").sortWithinPartitions("sample", "sequence")
    lines.select("sample", "value").write.partitionBy("sample").option("lineSep", "\n").mode("overwrite").text(path)
