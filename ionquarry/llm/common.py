"""What the operators share: reading tables, written intermediate tables, row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of small columns.
ROWS_A_FILE, FILES_A_CORE = 200_000, 4
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines see."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def cut(df: DataFrame, rows: int | None = None, small: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    It ends the lineage: what follows survives the loss of executors without computing ``df`` again, and reads only the
    columns it needs. ``rows``: as many rows at most are known to come; few of them go to few files. ``small``: the table is
    far smaller than what it is made of, and goes to ``FILES_A_CORE`` files for each core at most, not to one for each
    partition. The folder is left to the cluster's clean-up of its checkpoint directory.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_A_FILE)
    elif small:
        df = df.coalesce(FILES_A_CORE * df.sparkSession.sparkContext.defaultParallelism)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def text_id(text: Column) -> Column:
    """16 bytes that stand for the text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def text_halves(text: Column) -> tuple[Column, Column]:
    """The digest of ``text_id`` as two longs, which can be keys of a hash aggregation."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return tuple(F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17))


def unique_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(tid, text, copies): one row for each distinct text.

    Copies meet in the map-side aggregation first, so a group of copies, however large, sends one row from each task.
    """
    return docs.select(text_id(F.col(text_col)).alias("tid"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("tid").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def chosen_name(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
