"""Streams replayed from files give what the batch operators give."""

import random

from pyspark.sql import functions as F

from ionquarry.operators import deltas
from ionquarry.streaming import deltas as stream

SCHEMA = "sample_id long, scan_id long, mz double, intensity double"
OPTIONS = {"top": 5, "history": 4, "least": 1.0, "correlation": 0.8, "ppm": 5.0}


def rows():
    r = random.Random(5)
    out = []
    for sample in (1, 2):
        for scan in range(14):
            base = r.random() * 10
            out += [(sample, scan, m + r.random() * 1e-4, base * k + r.random()) for k, m in enumerate((100.0, 150.0, 200.0, 300.0), 1)]
    return out


def replay(spark, tmp_path, build, parts, name, mode="append"):
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p{k:02}"))
    source = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = build(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.table(name)


def test_stream_of_scans_equals_the_batch(spark, tmp_path):
    data = rows()
    table = spark.createDataFrame(data, SCHEMA)
    expected = {(x.sample_id, x.scan_id, round(x.mz1, 6), round(x.mz2, 6)): x.correlation for x in deltas.correlated_pairs(table, **OPTIONS).collect() if x.scan_id < 13}
    parts = [table.filter(f"scan_id >= {a} AND scan_id < {a + 7}") for a in (0, 7)]
    got = {(x.sample_id, x.scan_id, round(x.mz1, 6), round(x.mz2, 6)): x.correlation for x in replay(spark, tmp_path, lambda s: stream.correlated_pairs(s, **OPTIONS), parts, "pairs").collect()}
    assert expected and set(got) == set(expected) and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_sessions_of_a_stream(spark, tmp_path):
    data = [(1, t, 100.0, 150.0, 0.9) for t in (0, 1, 2, 20, 21, 90)]
    table = spark.createDataFrame(data, "sample_id long, t long, mz1 double, mz2 double, correlation double").withColumn("at", F.timestamp_seconds("t"))
    parts = [table.filter("t < 50"), table.filter("t >= 50")]
    found = replay(spark, tmp_path, lambda s: stream.sessions(s, "at", "5 seconds"), parts, "sessions")
    closed = sorted((x.hits, x.session.start.timestamp()) for x in found.collect())
    assert closed == [(2, 20.0), (3, 0.0)]


def plain_cache(rows, ppm=3.0, gap=5):
    """A list searched from its start for each pair, as (mz1, mz2, first, last, hits)."""
    cache = []
    for n, a, b in sorted(rows):
        for e in cache:
            if e[3] < n and n - e[3] < gap and abs(a - e[0]) / e[0] * 1e6 < ppm and abs(b - e[1]) / e[1] * 1e6 < ppm:
                e[3:] = n, e[4] + 1
                break
        else:
            cache.append([a, b, n, n, 1])
    return sorted((round(a, 9), round(b, 9), f, z, h) for a, b, f, z, h in cache)


def drifting_pairs(sample, scans, seed):
    """Pairs at m/z a few ppm apart, so that a chain holds several entries and neighbouring bins matter."""
    r = random.Random(seed)
    return [(sample, n, 200 * (1 + r.randrange(-8, 9) * 0.7e-6), 300 * (1 + r.randrange(-8, 9) * 0.7e-6), 0.95) for n in range(scans) for _ in range(r.randrange(0, 6))]


PAIR = "sample_id long, n long, mz1 double, mz2 double, correlation double"


def found_in(rows, sample):
    return sorted((round(x.mz1, 9), round(x.mz2, 9), x.first_scan, x.last_scan, x.hits) for x in rows if x.sample_id == sample)


def test_cached_sessions_equal_a_plain_cache(spark):
    data = drifting_pairs(1, 80, 3) + drifting_pairs(2, 40, 4)
    got = deltas.cached_sessions(spark.createDataFrame(data + [(1, None, 1.0, 2.0, 1.0), (1, 3, 0.0, 2.0, 1.0)], PAIR)).collect()
    for sample in (1, 2):
        expected = plain_cache([x[1:4] for x in data if x[0] == sample])
        assert len(expected) > 20 and max(x[4] for x in expected) > 3 and found_in(got, sample) == expected
    assert deltas.cached_sessions(spark.createDataFrame([], PAIR)).count() == 0


def test_stream_of_pairs_equals_a_plain_cache(spark, tmp_path):
    data = drifting_pairs(1, 60, 5) + drifting_pairs(2, 30, 6)
    timed = spark.createDataFrame(data + [(3, 100_000, 1.0, 2.0, 0.9)], PAIR).withColumn("at", F.timestamp_seconds(F.col("n") + 100))
    parts = [timed.filter(f"n >= {a} AND n < {b}") for a, b in ((0, 11), (11, 12), (12, 43), (43, 1000), (1000, 200_000))]
    got = replay(spark, tmp_path, lambda s: stream.cached_sessions(s, "at", idle="2 minutes"), parts, "held").collect()
    for sample in (1, 2):
        assert found_in(got, sample) == plain_cache([x[1:4] for x in data if x[0] == sample])


def test_idle_sample_has_its_last_scan_judged(spark, tmp_path):
    data = rows()
    table = spark.createDataFrame(data + [(9, 10_000, 1.0, 1.0)], SCHEMA).withColumn("at", F.timestamp_seconds(F.col("scan_id") + 100))
    expected = {(x.sample_id, x.scan_id, round(x.mz1, 6), round(x.mz2, 6)) for x in deltas.correlated_pairs(table, **OPTIONS).collect()}
    parts = [table.filter(f"scan_id >= {a} AND scan_id < {b}") for a, b in ((0, 5), (5, 14), (14, 20_000))]
    got = replay(spark, tmp_path, lambda s: stream.correlated_pairs(s, **OPTIONS, time_col="at", idle="1 minute"), parts, "idle_pairs").collect()
    assert {(x.sample_id, x.scan_id, round(x.mz1, 6), round(x.mz2, 6)) for x in got} == expected and any(x[1] == 13 for x in expected)
