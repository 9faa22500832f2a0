"""The best of a search by classes against all candidates ranked."""

import pytest
from pyspark.sql import functions as F

from ionquarry.operators import identification
from ionquarry.plans import library_queries
from ionquarry.sources import views


@pytest.mark.parametrize("kind", ["plain", "cosine"])
def test_best_of_classes_is_rank_one(spark, kind):
    rows = views.library(spark, "/root/testdata/sf0.001").limit(60)
    # every third m/z is one, in several spectra and names
    rows = rows.withColumns({"precursor_mz": F.when(F.col("compound_id") % 3 == 0, 950.0).otherwise(F.col("precursor_mz")), "name": F.concat(F.lit("n"), (F.col("compound_id") % 7).cast("string"))})
    rows = rows.unionByName(rows.withColumn("compound_id", F.col("compound_id") + 303))
    spectrum = library_queries._library_spectrum()
    library = rows.select("compound_id", "name", "precursor_mz", "expected_rt", F.lit("PC").alias("lipid_class"), F.lit("x").alias("adduct"), spectrum.alias("library_spectrum"))
    groups = library_queries._groups(rows)
    if kind == "plain":
        every, found = identification.lipid_search(groups, library, 2.0, 20.0, 0.1), identification.best_of(groups, library, 2.0, 20.0, "plain", 0.1)
    else:
        every, found = identification.metabolite_search(groups, library, 2.0, 20.0, 0.5, 3), identification.best_of(groups, library, 2.0, 20.0, "cosine", 0.5, 3)
    columns = ["group_id", "compound_id", "name", "score", "cosine", "label"]
    want = sorted(map(tuple, every.filter("rank = 1").withColumn("cosine", F.col("scores.cosine")).select(*columns).collect()))
    got = sorted(map(tuple, found.select(*columns).collect()))
    assert [x[:3] + x[5:] for x in got] == [x[:3] + x[5:] for x in want] != []
    assert all(x[3:5] == pytest.approx(y[3:5], abs=1e-12) for x, y in zip(got, want, strict=True))
