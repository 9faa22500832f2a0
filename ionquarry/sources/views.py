"""The domain's tables, projected from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_schemas: dict[tuple[str, str], T.StructType] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its schema is read from the files once for each path and session, not for each query."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, sample_id, channel, scan_id (hour), rt (minutes), mz, intensity: one row for each point."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    mz = 100.0 + F.get_json_object("props", "$.k").cast("double")
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("point_id"), F.col("user_id").alias("sample_id"), F.col("event_type").alias("channel"), F.floor(us / 3_600_000_000).alias("scan_id"), (us / 60_000_000).alias("rt"), mz.alias("mz"), F.col("value").alias("intensity"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """compound_id, name, category, precursor_mz, expected_rt."""
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("compound_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.col("p_retailprice").alias("precursor_mz"), F.col("p_size").cast("double").alias("expected_rt"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, line, sample, mz, rt (days), intensity."""
    rt = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("sample"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("mz"), rt.alias("rt"), F.col("l_quantity").alias("intensity"))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spectrum_id, intensity (array), cluster."""
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("spectrum_id"), F.col("embedding").cast("array<double>").alias("intensity"), F.col("label").alias("cluster"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sequence_id, residues."""
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sequence_id"), F.col("text").alias("residues"))


#: The same views in DuckDB SQL.
SQL = {
    "signal": "SELECT event_id AS point_id, user_id AS sample_id, event_type AS channel, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000) AS BIGINT) AS scan_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 60000000 AS rt, 100.0 + CAST(json_extract(props, '$.k') AS DOUBLE) AS mz, value AS intensity FROM events",
    "library": "SELECT p_partkey AS compound_id, p_name AS name, p_brand AS category, p_retailprice AS precursor_mz, CAST(p_size AS DOUBLE) AS expected_rt FROM part",
    "observed": "SELECT l_orderkey AS order_id, l_linenumber AS line, l_suppkey AS sample, l_extendedprice / l_quantity AS mz, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS rt, l_quantity AS intensity FROM lineitem",
    "spectra": "SELECT vec_id AS spectrum_id, CAST(embedding AS DOUBLE[]) AS intensity, label AS cluster FROM embeddings",
    "sequences": "SELECT doc_id AS sequence_id, text AS residues FROM documents",
}
