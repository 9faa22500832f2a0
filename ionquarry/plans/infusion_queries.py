"""Queries of the direct-infusion block search over the observed view and the library.

Orders stand for MS2 scans (their number gives the isolation window), lines for peaks; each library entry has five
fragments at fixed distances from its precursor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionquarry.operators import block_search
from ionquarry.plans.queries import _WITH, ORACLES, QUERIES, _r
from ionquarry.sources import views

PPM, LEAST = 1500.0, 2
#: Distance from the precursor, intensity, label of the fragments.
_FRAGMENTS = [(0.0, 100.0, "pre"), (7.25, 80.0, "*a"), (13.5, 60.0, "@b"), (-29.75, 40.0, "$c"), (57.5, 20.0, "*@d")]

_SQL = f"""{_WITH}, scan AS (SELECT *, order_id % 3 AS smp, 900.0::DOUBLE + 25 * (order_id % 5) AS pre FROM observed),
block AS (SELECT CAST(round(pre + 0.001) AS BIGINT) AS block, arg_min(pre - 20, (smp, order_id)) AS low, arg_min(pre + 20, (smp, order_id)) AS high FROM scan GROUP BY 1),
ion AS (SELECT compound_id, 'M' AS adduct, precursor_mz AS mz FROM library UNION ALL SELECT compound_id, 'M+10', precursor_mz + 10 FROM library),
held AS (SELECT compound_id, adduct, ion.mz, coalesce((SELECT min(block) FROM block WHERE ion.mz > low AND ion.mz < high), -1) AS block FROM ion),
fragment AS (SELECT compound_id, adduct, block, mz AS precursor, mz + d AS fmz, d FROM held, (VALUES {", ".join(f"({d}::DOUBLE)" for d, _, _ in _FRAGMENTS)}) f(d)),
peak AS (SELECT smp, CAST(round(pre + 0.001) AS BIGINT) AS block, mz FROM scan),
hit AS (SELECT DISTINCT smp, f.block, compound_id, adduct, d FROM fragment f JOIN peak p ON p.block = f.block AND abs(p.mz - fmz) <= precursor * {PPM} / 1e6)
SELECT smp AS sample, block, compound_id, adduct, count(*) AS hits FROM hit GROUP BY ALL HAVING count(*) >= {LEAST}"""


def rows_and_entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(peaks: sample, block, mz, intensity; entries)."""
    rows = views.observed(spark, sf_dir).withColumns({"sample": (F.col("order_id") % 3).cast("long"), "precursor_mz": 900.0 + 25 * (F.col("order_id") % 5), "scan_id": F.col("order_id")})
    windows = block_search.isolation_blocks(rows.select("sample", "scan_id", "precursor_mz", (F.col("precursor_mz") - 20).alias("low"), (F.col("precursor_mz") + 20).alias("high")))
    library = views.library(spark, sf_dir)
    ions = library.select("compound_id", F.explode(F.array(F.struct(F.lit("M").alias("adduct"), F.lit(0.0).alias("d")), F.struct(F.lit("M+10").alias("adduct"), F.lit(10.0).alias("d")))).alias("a"), "precursor_mz").select("compound_id", "a.adduct", (F.col("precursor_mz") + F.col("a.d")).alias("mz"))
    fragments = F.array(*[F.struct((F.col("mz") + d).alias("mz"), F.lit(y).alias("intensity"), F.lit(label).alias("label")) for d, y, label in _FRAGMENTS])
    entries = block_search.first_window(ions, windows, "block").select("block", "compound_id", "adduct", F.col("mz").alias("precursor_mz"), fragments.alias("fragments"))
    return rows.select("sample", block_search.block_of(F.col("precursor_mz")).alias("block"), "mz", "intensity"), entries


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spectra, entries, ms1 peaks), the spectra as arrays."""
    peaks, entries = rows_and_entries(spark, sf_dir)
    spectra = peaks.groupBy("sample", "block").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("spectrum"))
    return spectra, entries, peaks.select("sample", "mz", "intensity")


def infusion_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library ions that two fragments or more of lead to peaks of their block."""
    peaks, entries = rows_and_entries(spark, sf_dir)
    return block_search.candidates(peaks, entries, PPM, LEAST)


def infusion_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches assessed fragment by fragment, with the MS1 intensity of their ions."""
    peaks, entries = rows_and_entries(spark, sf_dir)
    matches = block_search.assessed(peaks, entries, PPM, LEAST, least_intensity=5.0)
    ions = entries.select("compound_id", "adduct", F.col("precursor_mz").alias("mz"))
    return block_search.with_ms1(matches, ions, peaks, 20.0, 0.9).withColumn("max_intensity", _r("max_intensity"))


QUERIES |= {"infusion_candidates": infusion_candidates, "infusion_block_search": infusion_block_search}
ORACLES["infusion_candidates"] = _SQL
