import pytest

from ionquarry.plans import queries
from ionquarry.sources import views

SCHEMA = "sample_id long, channel string, scan_id long, intensity double"


def run(spark, monkeypatch, name, rows):
    monkeypatch.setattr(views, "signal", lambda spark, sf_dir: spark.createDataFrame(rows, SCHEMA))
    return queries.QUERIES[name](spark, "").collect()


def test_welch_t_special_cases(spark, monkeypatch):
    sides = {"flat": ([5.0, 5.0], [3.0, 3.0]), "one_each": ([5.0], [3.0]), "lacks": ([5.0, 6.0], []), "empty": ([None], [None]), "plain": ([1.0, 3.0], [2.0, 6.0]), "flat_left": ([4.0, 4.0], [2.0, 6.0])}
    rows = [(k, c, 0, v) for c, both in sides.items() for k, side in enumerate(both) for v in side]
    got = {x.channel: x.t for x in run(spark, monkeypatch, "welch_t", rows)}
    expected = {"flat": 2.0, "one_each": 2 / 2**0.5, "lacks": 1000.0, "empty": 0.0, "plain": -2 / 5**0.5, "flat_left": 0.0}
    assert got == pytest.approx(expected, abs=1e-6)


def test_trace_correlation_special_cases(spark, monkeypatch):
    traces = {"a": [1.0, 2.0, 4.0], "b": [1.0, 2.0, 4.0], "c": [7.0, 7.0, 7.0], "d": [4.0, 2.0, 1.0], "e": [7.0, 7.0, 7.0], "f": [1.0]}
    rows = [(0, c, k, v) for c, trace in traces.items() for k, v in enumerate(trace)]
    got = {x.one + x.other: x.correlation for x in run(spark, monkeypatch, "trace_correlation", rows)}
    assert got["ab"] == 1 and got["ce"] == 1 and got["ac"] == 0 and got["cd"] == 0
    assert got["af"] == 1 and got["cf"] == 0 and got["ad"] == pytest.approx(-0.928571, abs=1e-6)
