"""Intermediate tables of loops, written where all machines see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, whose clean-up is left to the cluster; where that is unset, as on one machine, in a temporary folder."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp()}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read again: its lineage ends there, so that a lost executor costs no more than a read."""
    path = shared_path(df.sparkSession, "written")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
