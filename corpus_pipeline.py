"""The corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, source mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionquarry.llm import decontaminate, language_id, minhash, mixing, suffix_dedup
from ionquarry.llm.common import cut, held_out, table

#: Bytes of a passage that must not repeat: less than any 50 words of prose have.
PASSAGE_BYTES = 240


#: Bytes of a batch of rows between the JVM and Python. Texts go both ways, so that each core holds a few batches on either side.
BATCH_BYTES = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    """Sets ``BATCH_BYTES`` for the session, unless it has less already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learnt from ``lang``; null texts, texts without a letter and other languages go.

    Where no lang is known, all texts with a letter stay. Repeated rows are judged alike; an empty table stays empty.
    """
    _small_batches(spark)
    model = language_id.train(docs.filter(~held_out(F.col("doc_id"))))
    return language_id.in_learnt_language(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 or more: the one with the smallest id; null ids are the largest.

    Of equal rows one stays; texts without words link with nothing and all stay; an empty table stays empty.
    """
    _small_batches(spark)
    return minhash.drop_near_duplicates(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand more than once in the corpus; documents of which nothing is left go.

    Null and empty texts stay; equal texts (of which the stage before leaves one) would lose all; an empty table stays empty.
    """
    _small_batches(spark)
    return _counted(suffix_dedup.remove_repeats(docs, PASSAGE_BYTES))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that hold ten words in a row of a benchmark item; documents of hit words alone go.

    Null texts stay; without items nothing changes; an empty table stays empty.
    """
    _small_batches(spark)
    return _counted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with the number of times it does, copies; wordless ones are never taken.

    A null source is one of the sources; equal rows share what falls to them; an empty table stays empty.
    """
    _small_batches(spark)
    return mixing.mix(docs).filter("copies > 0")


STAGES = [
    ("language_id", by_language),
    ("minhash_dedup", without_near_duplicates),
    ("suffix_array_dedup", without_repeats),
    ("decontamination", without_leaks),
    ("mix_sources", mixed),
]
#: Not expressible in SQL; tests hold the operators of the stages against brute force, and the stages against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages, one after another, make of documents; each works on what the one before wrote. An empty table gives an empty one."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
