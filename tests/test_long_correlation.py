"""Correlations of long traces over shifts."""

import time

import numpy as np
import pytest

from ionquarry.operators import trace_kernels as K


@pytest.mark.parametrize("sizes", [(3000, 3000), (4000, 2500), (1, 5000)])
def test_transforms_equal_sums(monkeypatch, sizes):
    r = np.random.default_rng(4)
    x, y = (np.abs(r.normal(size=n)).cumsum() % 7 for n in sizes)
    found = K.shifted_correlation_z(x, y)
    monkeypatch.setattr(K, "LONG", 10**9)
    assert found == pytest.approx(K.shifted_correlation_z(x, y), abs=1e-7)
    assert K.shifted_correlation_z(np.ones(4000), np.ones(4000)) == 0.0


def test_time_grows_with_the_trace():
    r, began = np.random.default_rng(4), time.process_time()
    x = r.random(600_000)
    assert K.shifted_correlation_z(x, x.copy()) > 10
    assert time.process_time() - began < 20
