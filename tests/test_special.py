"""Probability tails against slow sums, known values and the JVM's own library."""

import math

import numpy as np
import pytest

from cairnstat.functions import special as sp


def test_normal_tail_and_quantile():
    z = np.array([-40.0, -5.0, -1.0, 0.0, 1.0, 3.0, 10.0, 35.0, 60.0])
    lt = sp.log_normal_tail(z)
    assert np.allclose(lt[1:6], [math.log(0.5 * math.erfc(v / math.sqrt(2))) for v in z[1:6]])
    assert np.isclose(lt[6], -53.23128515051247) and lt[0] == 0.0 and np.isfinite(lt[8])
    assert np.all(np.diff(lt) <= 0)
    for lp in (-1e-12, -0.1, -0.7, -3.0, -50.0, -600.0, -2000.0):
        q = sp.normal_quantile_from_log(np.array([lp]))
        assert np.isclose(sp.log_normal_tail(-q)[0], lp, rtol=1e-8, atol=1e-13)
    assert sp.normal_quantile_from_log(np.array([0.0, -np.inf])).tolist() == [np.inf, -np.inf]
    assert np.isnan(sp.log_normal_tail(np.array([np.nan])))[0]


def test_against_jvm(spark):
    lib = spark._jvm.org.apache.commons.math3.distribution
    for df in (1.0, 2.5, 7.0, 40.0, 1e4):
        d = lib.TDistribution(df)
        for t in (-8.0, -1.0, 0.0, 0.3, 2.0, 15.0):
            assert math.isclose(math.exp(sp.log_t_tail([t], [df])[0]), 1 - d.cumulativeProbability(t), rel_tol=1e-7, abs_tol=1e-13)
    for a, b in ((1.0, 5.0), (3.0, 12.0), (20.0, 7.0)):
        d = lib.FDistribution(a, b)
        for f in (0.1, 1.0, 3.0, 9.0):
            assert math.isclose(math.exp(sp.log_f_tail([f], [a], [b])[0]), 1 - d.cumulativeProbability(f), rel_tol=1e-7)


def test_binomial_by_sum():
    for n, p in ((0, 0.3), (1, 0.5), (12, 0.2), (60, 0.77)):
        pmf = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
        for k in range(0, n + 1, max(1, n // 6)):
            lo, hi = sp.log_binomial_tails([k], [n], [p])
            assert math.isclose(math.exp(lo[0]), sum(pmf[: k + 1]), rel_tol=1e-9) and math.isclose(math.exp(hi[0]), sum(pmf[k:]), rel_tol=1e-9)


def test_chi_square_and_stouffer():
    assert math.isclose(math.exp(float(sp.log_chi_square_tail_even(9.487729, 4))), 0.05, rel_tol=1e-6)
    assert math.isclose(sp.stouffer_log([math.log(0.05)] * 2), math.log(0.0100), rel_tol=2e-3)
    assert math.isnan(sp.stouffer_log([0.0, -np.inf])) and math.isnan(sp.stouffer_log([np.nan]))
    assert math.isclose(sp.stouffer_log([-1.0, np.nan]), -1.0, rel_tol=1e-9)


@pytest.mark.parametrize("x", [0.0, 1e-12, 0.3, 0.999, 1.0])
def test_beta_symmetry(x):
    a, b = 2.5, 0.7
    lo, hi = sp.log_beta_cdf(x, a, b), sp.log_beta_cdf(1 - x, b, a)
    assert math.isclose(math.exp(lo) + math.exp(hi), 1.0, rel_tol=1e-9)
