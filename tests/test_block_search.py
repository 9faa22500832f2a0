import random

import numpy as np
from pyspark.sql import functions as F

from ionquarry.functions.maths import C13_STEP
from ionquarry.operators import block_search, matching
from ionquarry.plans import infusion_queries

SF = "/root/testdata/sf0.001"


def brute(spectra, entries, ppm, least, least_intensity):
    """Every entry against every spectrum of its block."""
    out = {}
    for s in spectra:
        peaks = sorted(s["spectrum"])
        for e in entries:
            if e["block"] != s["block"]:
                continue
            fragments = sorted(e["fragments"])
            ranks = matching.greedy_ranks(np.array([f[0] for f in fragments]), np.array([p[0] for p in peaks]), e["precursor_mz"] * ppm / 1e6)
            hit = [(f, peaks[r]) for f, r in zip(fragments, ranks, strict=True) if r >= 0 and peaks[r][1] >= least_intensity]
            if len(hit) >= least:
                marks = lambda c: sum(c in f[2][: len(f[2]) - len(f[2].lstrip("*@$!^&"))] for f, _ in hit)  # noqa: B023, E731
                out[s["sample"], s["block"], e["compound_id"], e["adduct"]] = (len(hit), marks("*"), marks("@"), marks("$"), any(abs(f[0] - e["precursor_mz"]) < e["precursor_mz"] * ppm / 1e6 for f, _ in hit), round(max(p[1] for _, p in hit), 6))
    return out


def test_block_search_equals_every_pair(spark):
    spectra, entries, ms1 = infusion_queries.inputs(spark, SF)
    held, asked, peaks = (x.collect() for x in (spectra, entries, ms1))
    want = brute(held, asked, infusion_queries.PPM, infusion_queries.LEAST, 5.0)
    got = {tuple(x[k] for k in ("sample", "block", "compound_id", "adduct")): x for x in infusion_queries.infusion_block_search(spark, SF).collect()}
    assert want and set(got) == set(want)
    for key, x in got.items():
        assert (x.matches, x.diagnostic, x.sn1, x.sn2, x.has_precursor, x.max_intensity) == want[key]
    ions = {(e.compound_id, e.adduct): e.precursor_mz for e in asked}
    by_sample = {}
    for p in peaks:
        by_sample.setdefault(p.sample, []).append((p.mz, p.intensity))
    by_sample = {k: np.array(v) for k, v in by_sample.items()}
    for key, x in list(got.items())[:300]:
        ion = ions[key[2], key[3]]
        mz, y = by_sample[key[0]].T
        own, before = (y[np.abs(mz - at) <= ion * 20e-6].max(initial=0.0) for at in (ion, ion - C13_STEP))
        assert x.ms1_intensity == (0.0 if before > 0.9 * own else own)


def test_no_rows_of_the_library_are_broadcast(spark):
    entries = lambda n: spark.range(n).selectExpr("0L AS block", "id AS compound_id", "'M' AS adduct", "100.0D + id AS precursor_mz", "array(named_struct('mz', 100.0D + id, 'intensity', 1.0D, 'label', 'a')) AS fragments")
    peaks = spark.range(50).selectExpr("id % 2 AS sample", "0L AS block", "100.0D + id AS mz", "9.0D AS intensity")
    few = entries(20)
    matches = block_search.assessed(peaks, few, 100.0)
    found = block_search.with_ms1(matches, few.select("compound_id", "adduct", F.col("precursor_mz").alias("mz")), peaks, 20.0)
    assert {(x.compound_id, x.sample, x.ms1_intensity) for x in found.collect()} == {(k, k % 2, 9.0) for k in range(20)}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    joins = [x for x in plan.splitlines() if "BroadcastHashJoin" in x]
    assert joins and not [x for x in joins if "_class" in x or "compound_id" in x]


def test_rare_fragments_find_what_all_would(spark):
    r = random.Random(3)
    spectra = [(s, b, [(float(r.randrange(100, 130)) + r.random() * 0.02, r.random() * 10) for _ in range(r.randrange(0, 12))]) for s in range(4) for b in range(3)] + [(9, 0, []), (9, 1, None)]
    entries = [(r.randrange(3), i, "M", 110.0, [(100.0, 1.0, "shared")] + [(float(r.randrange(101, 130)), 1.0, "x") for _ in range(r.randrange(0, 6))]) for i in range(150)]
    entries += entries[:3] + [(0, 900, "M", 110.0, []), (0, 901, "M", 110.0, None)]
    a = spark.createDataFrame(spectra, "sample long, block long, spectrum array<struct<mz:double,intensity:double>>")
    b = spark.createDataFrame(entries, "block long, compound_id long, adduct string, precursor_mz double, fragments array<struct<mz:double,intensity:double,label:string>>")
    for least in (1, 2, 3):
        got = sorted(tuple(x) for x in block_search.candidates(a, b, 100.0, least, 2.0).collect())
        want = set()
        for s, block, peaks in spectra:
            for e in entries:
                n = sum(any(y >= 2.0 and abs(mz - f[0]) <= 110.0 * 100.0 / 1e6 for mz, y in peaks or []) for f in e[4] or [])
                if e[0] == block and n >= least:
                    want.add((s, block, e[1], "M", n))
        assert got == sorted(want) and got
    index = block_search.fragment_index(b.dropDuplicates(["compound_id"]), 100.0, 3)
    assert index.filter("bin BETWEEN 1999 AND 2001").count() < 40  # the shared fragment is left to short entries
    assert block_search.assessed(a.limit(0), b, 100.0).collect() == []


def test_ions_go_to_the_first_window(spark):
    windows = spark.createDataFrame([(3, 100.0, 110.0), (1, 105.0, 120.0), (2, 0.0, 1e9), (7, 50.0, 40.0)], "block int, low double, high double")
    ions = spark.createDataFrame([(m,) for m in (99.0, 100.0, 105.0, 106.0, 110.0, 120.0, 5e5)], "mz double")
    open_ = {x.mz: x.block for x in block_search.first_window(ions, windows, "block").collect()}
    assert open_ == {99.0: 2, 100.0: 2, 105.0: 2, 106.0: 1, 110.0: 1, 120.0: 2, 5e5: -1}
    shut = {x.mz: x.block for x in block_search.first_window(ions, windows.filter("block <> 2"), "block", inclusive=True).collect()}
    assert shut == {99.0: -1, 100.0: 3, 105.0: 1, 106.0: 1, 110.0: 1, 120.0: 1, 5e5: -1}
    assert block_search.first_window(ions, windows.limit(0), "block").select(F.max("block")).first()[0] == -1


def test_near_peaks_come_in_chunks_and_copies(spark):
    peaks = [(1, 0, 100.0 + (k % 40) * 0.05, float(k % 3)) for k in range(4000)] + [(1, 0, 1e4 + k, 1.0) for k in range(50)]
    rows = spark.createDataFrame(peaks, "sample long, block long, mz double, intensity double")
    fragments = [(100.02, 1.0, "a"), (100.03, 1.0, "b"), (100.04, 1.0, "c"), (101.0, 1.0, "d")]
    entries = spark.createDataFrame([(0, k, "M", 100.0, fragments) for k in range(300)], "block long, compound_id long, adduct string, precursor_mz double, fragments array<struct<mz:double,intensity:double,label:string>>")
    classes = block_search._classed(entries, 1).select("block", "_class", "precursor_mz", "fragments").dropDuplicates(["_class"])
    near = block_search.nearest(rows, classes, 1000.0)
    assert near.count() <= 4 * 4  # alike entries are one class, and a fragment brings no more peaks than it may need
    got = block_search.assessed(rows, entries, 1000.0, 2).collect()
    assert len(got) == 300 and {(x.matches, x.max_intensity) for x in got} == {(4, brute_top(peaks, fragments))}
    from_arrays = spark.createDataFrame([(1, 0, [(m, y) for _, _, m, y in peaks])], "sample long, block long, spectrum array<struct<mz:double,intensity:double>>")
    assert sorted(block_search.assessed(from_arrays, entries, 1000.0, 2).collect()) == sorted(got)


def brute_top(peaks, fragments):
    held = sorted((m, y) for _, _, m, y in peaks)
    ranks = matching.greedy_ranks(np.array([f[0] for f in fragments]), np.array([p[0] for p in held]), 0.1)
    return max(held[r][1] for r in ranks)
