"""Trends of sparse tables, where no feature reaches the least mean."""

import numpy as np
import pytest

from cairnstat.functions import fits
from cairnstat.operators import variance as va
from test_markers import make


def sparse():
    rng = np.random.default_rng(5)
    m = rng.uniform(0.005, 0.08, 400)
    return m, rng.gamma(20, 1 / 20, 400)


def test_variance_trend_below_the_least_mean():
    m, noise = sparse()
    with pytest.warns(UserWarning, match="all 400"):
        t = fits.fit_trend_var(m, 3 * m * noise)
    at = np.linspace(0.01, 0.07, 20)
    assert np.abs(np.log(t(at) / (3 * at))).max() < 0.3 and np.isfinite(t.std_dev)
    with_high = fits.fit_trend_var(np.append(m, [1.0, 2, 3, 4, 5]), np.append(3 * m * noise, [1.0, 2, 3, 4, 5]))
    assert with_high.knots.min() == 1.0  # where enough features reach it, the least mean holds


def test_cv2_trend_below_the_least_mean():
    m, noise = sparse()
    with pytest.warns(UserWarning, match="all 400"):
        t = fits.fit_trend_cv2(m, 2 / m * noise, 10_000)
    at = np.linspace(0.01, 0.07, 20)
    assert np.abs(np.log(t(at) / (2 / at))).max() < 0.3


def test_queries_on_a_sparse_table(spark):
    rng = np.random.default_rng(6)
    x = np.where(rng.random((60, 900)) < 0.01, rng.poisson(3, (60, 900)) + 1.0, 0.0)
    a = make(spark, x, ["g"] * 900, [str(b) for b in rng.choice(list("xy"), 900)])
    for m in (va.model_var(a.normalized()), va.model_var_spikes(a, a), va.model_cv2(a), va.model_cv2(a, a)):
        rows = m.collect()
        assert len(rows) == 60 and all(r.p_value is not None and len(r.per_block) == 2 for r in rows)


def test_smoother_by_definition():
    """The neighbourhood holds the span of the weight, ties and all; one round against the plain formula."""
    rng = np.random.default_rng(7)
    x, y, w = np.round(rng.gamma(1, 2, 300), 1), rng.normal(0, 1, 300), rng.uniform(0.5, 2, 300)
    got = fits.lowess(x, y, w, rounds=1)
    for i in range(300):
        d = np.abs(x - x[i])
        order = np.argsort(d, kind="stable")
        reach = d[order[np.searchsorted(np.cumsum(w[order]), 0.3 * w.sum())]]
        t = np.clip(1 - (d / reach) ** 3, 0, None) ** 3 * w
        mx, my = (t @ x) / t.sum(), (t @ y) / t.sum()
        want = my + (t @ ((x - mx) * (y - my))) / (t @ (x - mx) ** 2) * (x[i] - mx)
        assert got[i] == pytest.approx(want, abs=1e-9)
