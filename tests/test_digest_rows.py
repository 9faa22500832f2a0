"""Peptides row by row against arrays of them, and in bounded batches."""

from pyspark.sql import functions as F

from ionquarry.functions import peptides


def test_rows_equal_arrays_in_small_batches(spark):
    texts = [(i, "ACDKEFGRHIK" * (i % 5) if i % 7 else None) for i in range(120)] + [(None, "MKWR")]
    rows = spark.createDataFrame(texts, "sequence_id int, residues string").coalesce(1)
    found = peptides.digest_rows(rows)
    each = rows.select("sequence_id", F.explode(peptides.digested(F.col("residues"))).alias("p")).select("sequence_id", "p.*")
    assert found.schema == each.schema
    assert sorted(map(repr, found.collect())) == sorted(map(repr, each.collect())) != []
    long = spark.range(40, numPartitions=1).select(F.col("id").alias("sequence_id"), F.lit("ACDKEFGRHIK" * 600).alias("residues"))

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    assert peptides.digest_rows(long).mapInArrow(sizes, "n long").count() > 1
