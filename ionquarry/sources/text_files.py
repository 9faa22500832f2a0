"""Text sources and sinks: mzCSV, MGF, MS1/MS2, FASTA, MSP, adducts, thresholds, alignments, anchors, filter and merge tables.

All read through Spark's text and CSV readers, with schemas given, so columns and filters reach the scan where the format
allows. Blank lines and comments give no rows; what can't be read as a number is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionquarry.functions import spectrum as S
from ionquarry.functions import text as X

MZCSV = "scannum int, rt double, mz double, intensity double, mslevel int, precursorMz double, polarity string, srmid string"


def read_mzcsv(spark: SparkSession, path: str) -> DataFrame:
    """Scans of mzCSV files: rt in minutes, an mslevel below 1 counts as 1, the product of a higher one is its first m/z."""
    rows = spark.read.csv(path, schema=MZCSV, header=True).withColumn("sample", X.clean_name(F.input_file_name()))
    rows = rows.filter("scannum IS NOT NULL").withColumn("mslevel", F.when(F.coalesce("mslevel", F.lit(1)) <= 0, 1).otherwise(F.coalesce("mslevel", F.lit(1))))
    peaks = F.array_sort(F.collect_list(F.struct("mz", "intensity")))
    scans = rows.groupBy("sample", "scannum").agg(F.min("rt").alias("_rt"), F.max("mslevel").alias("mslevel"), F.max("precursorMz").alias("precursor_mz"), F.max("polarity").alias("_p"), F.max("srmid").alias("filter_line"), peaks.alias("spectrum"))
    polarity = F.when(F.col("_p").startswith("+"), 1).when(F.col("_p").startswith("-"), -1).otherwise(0)
    first = F.when(F.col("mslevel") > 1, F.get("spectrum", F.lit(0))["mz"])
    return scans.select("sample", F.col("scannum").cast("long").alias("scan_id"), "mslevel", (F.col("_rt") / 60).alias("rt"), "precursor_mz", first.alias("product_mz"), polarity.alias("polarity"), "filter_line", "spectrum")


def mzcsv_lines(scans: DataFrame) -> DataFrame:
    """The rows of an mzCSV file: scans count from 1, rt in seconds."""
    p = F.explode("spectrum")
    each = scans.withColumn("_p", p)
    sign = F.when(F.col("polarity") > 0, "+").when(F.col("polarity") < 0, "-").otherwise("")
    return each.select((F.col("scan_id") + 1).cast("int").alias("scannum"), (F.col("rt") * 60).alias("rt"), "_p.mz", "_p.intensity", "mslevel", F.col("precursor_mz").alias("precursorMz"), sign.alias("polarity"), F.coalesce("filter_line", F.lit("")).alias("srmid"))


def write_mzcsv(scans: DataFrame, path: str) -> None:
    mzcsv_lines(scans).write.csv(path, header=True, mode="overwrite")


def _records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(value): the pieces of text files between separators."""
    return spark.read.text(path, lineSep=separator)


def _field(text: Column, name: str) -> Column:
    found = F.trim(F.regexp_extract(text, rf"(?im)^{name}\s*[=:][ \t]*(.*)$", 1))
    return F.when(found != "", found)


def _peak_lines(text: Column) -> Column:
    parts = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(\d+\.?\d*(?:[eE][-+]?\d+)?[ \t]+\d+\.?\d*(?:[eE][-+]?\d+)?)"), F.lit(1))
    pair = lambda p, k: F.get(F.split(p, r"[ \t]+"), F.lit(k)).try_cast("double")
    return S.by_mz(F.transform(parts, lambda p: F.struct(pair(p, 0).alias("mz"), pair(p, 1).alias("intensity"))))


def mgf_records(records: DataFrame) -> DataFrame:
    """title, precursor_mz, charge, rt (minutes), spectrum of texts (value) that each hold an MGF record."""
    body = F.col("value")
    charge = F.regexp_extract(_field(body, "CHARGE"), r"(\d+)", 1).try_cast("int") * F.when(_field(body, "CHARGE").contains("-"), -1).otherwise(1)
    mass = F.regexp_extract(_field(body, "PEPMASS"), r"([\d.]+)", 1).try_cast("double")
    return records.filter(body.contains("BEGIN IONS")).select(_field(body, "TITLE").alias("title"), mass.alias("precursor_mz"), charge.alias("charge"), (_field(body, "RTINSECONDS").try_cast("double") / 60).alias("rt"), _peak_lines(body).alias("spectrum"))


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    return mgf_records(_records(spark, path, "END IONS"))


def write_mgf(scans: DataFrame, path: str) -> None:
    """Columns title, precursor_mz, rt, charge, spectrum."""
    text = S.mgf(F.col("spectrum"), F.col("title"), F.col("precursor_mz"), F.col("rt"), F.col("charge"))
    scans.select(text.alias("value")).write.mode("overwrite").text(path, lineSep="\n")


def msp_records(records: DataFrame) -> DataFrame:
    """name, precursor_mz, formula, spectrum of texts (value) that each hold an MSP record after its first NAME:."""
    body = F.concat(F.lit("NAME:"), F.col("value"))
    return records.filter(F.trim("value") != "").select(_field(body, "NAME").alias("name"), _field(body, "PRECURSORMZ").try_cast("double").alias("precursor_mz"), _field(body, "FORMULA").alias("formula"), _peak_lines(body).alias("spectrum"))


def read_msp(spark: SparkSession, path: str) -> DataFrame:
    return msp_records(_records(spark, path, "NAME:"))


def write_msp(scans: DataFrame, path: str) -> None:
    """Columns name, precursor_mz, formula, spectrum."""
    text = S.msp(F.col("spectrum"), F.col("name"), F.col("precursor_mz"), F.col("formula"))
    scans.select(text.alias("value")).write.mode("overwrite").text(path, lineSep="\n")


def inclusion_list(scans: DataFrame, window: float) -> DataFrame:
    """(mz, charge, rt_start, rt_end): a list to steer an instrument, rt in minutes."""
    return scans.select(F.round("precursor_mz", 5).alias("mz"), "charge", F.greatest(F.lit(0.0), F.col("rt") - window).alias("rt_start"), (F.col("rt") + window).alias("rt_end"))


_MS = "sample string, scan_id long, mslevel int, rt double, precursor_mz double, charge int, spectrum array<struct<mz:double,intensity:double>>"


def parse_ms_text(text: str, sample: str, mslevel: int) -> Iterator[tuple]:
    """Scans of MS1 or MS2 text: S lines open a scan, I RTime and Z lines belong to it, others are peaks."""
    scan = None
    for line in [*text.split("\n"), "S"]:
        parts = line.split()
        if not parts or parts[0] == "H" or parts[0] == "D":
            continue
        if parts[0] == "S":
            if scan is not None:
                yield (sample, scan["id"], mslevel, scan["rt"], scan["mz"], scan["z"], [{"mz": m, "intensity": y} for m, y in sorted(scan["peaks"])])
            if len(parts) < 2:
                return
            scan = {"id": int(parts[1]), "rt": None, "mz": float(parts[3]) if len(parts) > 3 else None, "z": None, "peaks": []}
        elif scan is not None and parts[0] == "I":
            if len(parts) > 2 and parts[1] == "RTime":
                scan["rt"] = float(parts[2])
        elif scan is not None and parts[0] == "Z":
            scan["z"] = int(parts[1])
        elif scan is not None and re.match(r"[\d.]", parts[0]) and len(parts) > 1:
            scan["peaks"].append((float(parts[0]), float(parts[1])))


def read_ms_text(spark: SparkSession, path: str, mslevel: int) -> DataFrame:
    """Scans of .ms1 or .ms2 files; a file is read by one task."""
    names = [c.split()[0] for c in _MS.replace("array<struct<mz:double,intensity:double>>", "x").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sample, text in zip(batch["sample"], batch["value"], strict=True):
                yield pd.DataFrame(list(parse_ms_text(text, sample, mslevel)), columns=names)

    whole = spark.read.text(path, wholetext=True).withColumn("sample", X.clean_name(F.input_file_name()))
    return whole.select("sample", "value").mapInPandas(run, _MS)


def fasta_records(records: DataFrame) -> DataFrame:
    """header, sequence of texts (value) between the > of FASTA files; lines of a sequence are joined, text before the first > left out."""
    head = F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1))
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
    return records.filter(F.trim("value") != "").select(head.alias("header"), body.alias("sequence")).filter("sequence <> ''")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    return fasta_records(_records(spark, path, ">"))


def fasta_text(header: Column, sequence: Column, width: int = 80) -> Column:
    """A record with lines of at most ``width`` residues."""
    lines = F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), header, F.lit("\n"), lines)


def write_fasta(proteins: DataFrame, path: str, width: int = 80) -> None:
    proteins.select(fasta_text(F.col("header"), F.col("sequence"), width).alias("value")).write.mode("overwrite").text(path, lineSep="\n")


def read_adducts(spark: SparkSession, path: str) -> DataFrame:
    """name, molecules, charge, added of ``name,nmol,charge,mass`` lines; # starts a comment."""
    rows = spark.read.csv(path, schema="name string, molecules int, charge int, added double", comment="#", ignoreLeadingWhiteSpace=True)
    return rows.filter("name IS NOT NULL AND charge IS NOT NULL AND added IS NOT NULL")


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """Thresholds by (lipid_class, adduct) of a CSV with a header; # starts a comment, an empty adduct is *."""
    rows = spark.read.csv(path, header=True, inferSchema=True, comment="#")
    return rows.withColumn("adduct", F.coalesce(F.when(F.trim("adduct") != "", F.trim("adduct")), F.lit("*")))


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """sample, rt, rt_update of tab-separated lines with a header; lines without numbers are left out."""
    rows = spark.read.csv(path, sep="\t", schema="sample string, rt double, rt_update double", header=True)
    return rows.filter("rt IS NOT NULL AND rt_update IS NOT NULL")


def write_alignment(segments: DataFrame, path: str) -> None:
    segments.select("sample", "rt", "rt_update").write.csv(path, sep="\t", header=True, mode="overwrite")


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """mz, rt, sample_filter of ``mz,rt[,filter]`` lines; # starts a comment."""
    rows = spark.read.csv(path, schema="mz double, rt double, sample_filter string", comment="#")
    return rows.filter("mz IS NOT NULL AND rt IS NOT NULL")


def merged_runs(runs: DataFrame, ppm: float = 20.0, rt_gap: float = 0.25) -> DataFrame:
    """``runs`` (file, mz, rt, ...) with group_id: broken where m/z, in order, has a gap over ``ppm``, then where rt has one.

    Gaps are found within bins of log m/z of 1 %, so that no single task sorts all m/z; a bin's border parts groups too.
    """
    bin_ = F.floor(F.log("mz") / 0.01)
    w = Window.partitionBy("_bin").orderBy("mz", "rt")
    fresh = F.coalesce(((F.col("mz") - F.lag("mz").over(w)) / F.lag("mz").over(w) * 1e6 > ppm).cast("int"), F.lit(0))
    one = runs.withColumn("_bin", bin_).withColumn("_f", fresh).withColumn("_a", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v = Window.partitionBy("_bin", "_a").orderBy("rt", "mz")
    late = F.coalesce((F.col("rt") - F.lag("rt").over(v) > rt_gap).cast("int"), F.lit(0))
    two = one.withColumn("_g", late).withColumn("_b", F.sum("_g").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    return two.withColumn("group_id", F.concat_ws("-", "_bin", "_a", "_b")).drop("_bin", "_f", "_a", "_g", "_b")


def run_matrix(merged: DataFrame, files: list, value: str = "mz") -> DataFrame:
    """One row for each group, one column for each file: the mean ``value``, null without."""
    return merged.groupBy("group_id").pivot("file", files).agg(F.avg(value))


def dump_traces(traces: DataFrame, path: str, keys: list[str]) -> None:
    """Traces as Parquet, partitioned by nothing and ordered by key, to be read again as they were."""
    traces.sortWithinPartitions(*keys, "rt").write.mode("overwrite").parquet(path)


def restore_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
