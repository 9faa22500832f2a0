"""The subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ionquarry.llm import decontaminate, fim, language_id, license_scan, minhash, mixing, packing, search, spotsigs, suffix_dedup, toxicity, url_filter, warc
from ionquarry.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdict_report(table(spark, sf_dir, "pages"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.dedup_report(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_report(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisit_report(table(spark, sf_dir, "pages"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # stands at the repository's top, and itself uses this subpackage

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_url_filters": op3_url_filters,
    "op4_minhash": op4_minhash,
    "op5_language_id": op5_language_id,
    "op6_fingerprints": op6_fingerprints,
    "op7_mix_sources": op7_mix_sources,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_license_scan": op9_license_scan,
    "op10_toxicity": op10_toxicity,
    "op11_ranked_search": op11_ranked_search,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE_SQL,
    "op2_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op3_url_filters": url_filter.ORACLE_SQL,
    "op4_minhash": minhash.ORACLE_SQL,
    "op8_warc_revisits": warc.ORACLE_SQL,
    "op11_ranked_search": search.ORACLE_SQL,
    "op13_fill_in_middle": fim.ORACLE_SQL,
}
