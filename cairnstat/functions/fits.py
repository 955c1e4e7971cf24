"""Curve fits over one row per feature, in numpy on the driver.

Their input has as many rows as there are features, which is the size of a
small table whatever the number of observations.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np

MAD = 1.4826


def weighted_median(x: np.ndarray, w: np.ndarray) -> float:
    """Value at half the total weight; the mean of two neighbours where it falls between them."""
    order = np.argsort(x)
    x, w = x[order], w[order]
    cum = np.cumsum(w) / w.sum()
    i = int(np.searchsorted(cum, 0.5 - 1e-12))
    if abs(cum[i] - 0.5) < 1e-12 and i + 1 < len(x):
        return float((x[i] + x[i + 1]) / 2)
    return float(x[i])


def inverse_density_weights(x: np.ndarray, points: int = 512) -> np.ndarray:
    """1 / Gaussian kernel density at each point, read off a grid over the range, scaled to mean 1."""
    n = len(x)
    iqr = np.subtract(*np.percentile(x, [75, 25])) / 1.34
    spread = min(s for s in (x.std(ddof=1), iqr, np.inf) if s > 0) if n > 1 and x.std() > 0 else 1.0
    h = 0.9 * spread * n ** -0.2
    grid = np.linspace(x.min(), x.max(), points)
    dens = np.array([np.exp(-0.5 * ((g - x) / h) ** 2).sum() for g in grid]) / (n * h * np.sqrt(2 * np.pi))
    w = 1.0 / np.maximum(np.interp(x, grid, dens), 1e-300)
    return w / w.mean()


def anchors(n: int) -> np.ndarray:
    """Places among n sorted points at which the smoother is evaluated, at most 400; it is read off between them."""
    return np.unique(np.round(np.linspace(0, n - 1, min(n, 400))).astype(int))


def _reach(xs: np.ndarray, cum: np.ndarray, i: int, need: float) -> float:
    """Smallest distance from sorted point i within which the points weigh ``need``; cum starts at 0."""
    x = xs[i]

    def enough(r: float) -> bool:
        r += 1e-12 * (abs(x) + r)  # the point at this very distance counts, however x + r is rounded
        return cum[np.searchsorted(xs, x + r, side="right")] - cum[np.searchsorted(xs, x - r, side="left")] >= need

    best = max(x - xs[0], xs[-1] - x)
    for side, sign in ((xs[i:], 1), (xs[: i + 1][::-1], -1)):  # distances on a side grow with the place
        lo, hi = 0, len(side) - 1
        if not enough(sign * (side[hi] - x)):
            continue
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if enough(sign * (side[mid] - x)) else (mid + 1, hi)
        best = min(best, sign * (side[lo] - x))
    return best


def lowess(x: np.ndarray, y: np.ndarray, w: np.ndarray, span: float = 0.3, rounds: int = 4) -> np.ndarray:
    """Robust local linear fit with tricube weights; the neighbourhood holds ``span`` of the total weight."""
    order = np.argsort(x, kind="stable")
    xs, ys, ws = x[order], y[order], w[order]
    cum = np.concatenate([[0.0], np.cumsum(ws)])
    need = span * cum[-1] * (1 - 1e-12)
    at = anchors(len(xs))
    near = []  # per point: its neighbourhood, a run of the sorted points
    for i in at:
        reach = max(_reach(xs, cum, i, need), 1e-8)
        near.append((reach, np.searchsorted(xs, xs[i] - reach, side="left"), np.searchsorted(xs, xs[i] + reach, side="right")))
    robust, fit = np.ones(len(xs)), ys
    for _ in range(rounds):
        out = np.empty(len(at))
        for k, (reach, lo, hi) in enumerate(near):
            u, v = xs[lo:hi], ys[lo:hi]
            far = np.abs(u - xs[at[k]]) / reach
            near_by = np.clip(1 - far * far * far, 0, None)  # made anew each round: 400 of these are larger than the table
            t = near_by * near_by * near_by * ws[lo:hi] * robust[lo:hi]
            total = t.sum()
            if total <= 0:
                out[k] = ys[at[k]]
                continue
            mx, my = (t @ u) / total, (t @ v) / total
            sxx = t @ (u - mx) ** 2
            out[k] = my + ((t @ ((u - mx) * (v - my))) / sxx if sxx > 1e-12 * total else 0.0) * (xs[at[k]] - mx)
        fit = np.interp(xs, xs[at], out) if len(np.unique(xs[at])) > 1 else np.full(len(xs), out.mean())
        res = np.abs(ys - fit)
        cut = 6 * np.median(res)
        if cut <= 1e-12:
            break
        robust = np.clip(1 - (res / cut) ** 2, 0, None) ** 2
    back = np.empty(len(xs))
    back[order] = fit
    return back


def gauss_newton(model, start: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 500) -> np.ndarray:
    """Weighted least squares by damped Gauss-Newton; raises ArithmeticError where it cannot proceed."""
    p = np.asarray(start, float)
    with np.errstate(all="ignore"):
        loss = (w * (y - model(p, x)) ** 2).sum()
        for _ in range(steps):
            base = model(p, x)
            eps = 1e-6 * np.maximum(np.abs(p), 1e-3)
            jac = np.column_stack([(model(p + np.eye(len(p))[i] * eps[i], x) - base) / eps[i] for i in range(len(p))])
            a = jac.T @ (jac * w[:, None])
            if not np.isfinite(a).all() or np.linalg.cond(a) > 1e14:
                raise ArithmeticError("singular gradient")
            step, factor = np.linalg.solve(a, jac.T @ (w * (y - base))), 1.0
            while factor > 1e-10:
                new = (w * (y - model(p + factor * step, x)) ** 2).sum()
                if np.isfinite(new) and new <= loss:
                    break
                factor /= 2
            else:
                return p
            p = p + factor * step
            if loss - new <= 1e-12 * max(loss, 1e-300):
                return p
            loss = new
    return p


@dataclass(frozen=True)
class Trend:
    """A fitted mean-variance trend: a parametric part, times a smooth correction on the log scale, times a constant."""

    kind: str
    params: np.ndarray
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    heights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: float = 1.0
    std_dev: float = float("nan")

    def __call__(self, x) -> np.ndarray:
        x = np.asarray(x, float)
        with np.errstate(all="ignore"):
            if self.kind == "hill":
                out = _hill(self.params, x)
            elif self.kind == "cv2":
                out = np.exp(self.params[0]) + np.exp(self.params[1]) / x
            elif self.kind == "ramp":
                out = np.minimum(1.0, x / self.params[0])
            else:
                out = np.ones_like(x)
        if len(self.knots):
            out = out * np.exp(np.interp(x, self.knots, self.heights))
        return out * self.scale


def _hill(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    n = 1.0 + np.exp(p[2])
    return np.exp(p[0]) * x / (x**n + np.exp(p[1]))


def _hill_start(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope from the lowest means, then the best of a grid of half-points and powers."""
    low = np.argsort(x)[: max(1, min(100, int(0.1 * len(x))))]
    slope = max((x[low] * y[low]).sum() / (x[low] ** 2).sum(), 1e-8)
    losses = {}
    for n in 2.0 ** np.linspace(0, 10, 10):
        with np.errstate(all="ignore"):
            power = x**n
            for b in 2.0 ** np.linspace(-5, 5, 10):
                losses[b, n] = ((y - slope * b * x / (power + b)) ** 2).sum()
    best, found = np.inf, None
    for b, n in sorted(losses):
        if losses[b, n] < best:
            best, found = losses[b, n], (b, n)
    b, n = found if found else (1.0, 2.0)
    return np.array([np.log(slope * b), np.log(b), np.log(max(n - 1.0, 1e-3))])


def _finish(kind: str, params, x, y, w, knots=np.zeros(0), heights=np.zeros(0)) -> Trend:
    raw = Trend(kind, np.asarray(params, float), knots, heights)
    r = y / raw(x)
    m = weighted_median(r, w)
    sd = MAD * weighted_median(np.abs(r / m - 1), w)
    return Trend(kind, np.asarray(params, float), knots, heights, m, sd)


def _fitted(x: np.ndarray, usable: np.ndarray, above: np.ndarray, least: int) -> np.ndarray:
    """Features a trend is fitted to: usable ones ``above`` the least mean; all usable ones of positive mean where fewer than ``least`` are.

    Means fall as observations without a feature are added, so in a sparse
    table no feature need reach a fixed mean; its features still have a trend.
    """
    ok, every = usable & above, usable & (x > 0)
    if ok.sum() >= least or every.sum() <= ok.sum():
        return ok
    warnings.warn(f"{int(ok.sum())} features reach the least mean: the trend is fitted to all {int(every.sum())}", stacklevel=3)
    return every


def fit_trend_var(means, variances, min_mean: float = 0.1, parametric: bool = True, smooth: bool = True, density_weights: bool = True) -> Trend:
    """Trend of log-value variance on the mean: a curve that rises linearly from 0 and falls off, then a robust smoother on the log ratio."""
    x, y = np.asarray(means, float), np.asarray(variances, float)
    if not parametric and not smooth:
        raise ValueError("a trend must be parametric or smooth")
    ok = _fitted(x, np.isfinite(x) & np.isfinite(y) & (y > 1e-8), x >= min_mean, 4 if parametric else 2)
    x, y = x[ok], y[ok]
    if len(x) < 2:
        raise ValueError("at least 2 features are needed for a trend")
    w = inverse_density_weights(x) if density_weights else np.ones(len(x))
    if parametric:
        if len(x) <= 3:
            raise ValueError("at least 4 features are needed for a parametric trend")
        params, kind = _hill_start(x, y), "hill"
        try:
            params = gauss_newton(_hill, params, x, y, w)
        except ArithmeticError:
            pass
    else:
        params, kind = np.array([x.min()]), "ramp"
    if not smooth:
        return _finish(kind, params, x, y, w)
    ratio = np.log(y) - np.log(np.maximum(Trend(kind, params)(x), 1e-300))
    fit = lowess(x, ratio, w)
    order = np.argsort(x, kind="stable")[anchors(len(x))]  # between these the fit is a straight line
    knots, first = np.unique(x[order], return_index=True)
    return _finish(kind, params, x, y, w, knots, fit[order][first])


def fit_trend_cv2(means, cv2, n_obs: int, min_mean: float = 0.1, nmads: float = 6.0, rounds: int = 50) -> Trend:
    """Trend A + B / mean of the squared coefficient of variation, outliers weighted down between rounds."""
    x, y = np.asarray(means, float), np.asarray(cv2, float)
    ok = _fitted(x, np.isfinite(x) & np.isfinite(y) & (y > 0) & (y < n_obs - 1e-8), x > min_mean, 2)
    x, y = x[ok], y[ok]
    if len(x) < 2:
        raise ValueError("at least 2 features are needed for a trend")
    base = inverse_density_weights(np.log(x)) if len(x) > 2 else np.ones(len(x))
    design = np.column_stack([np.ones(len(x)), 1.0 / x])
    scale = 1.0 / np.maximum(y, 1e-8)
    b, *_ = np.linalg.lstsq(design * scale[:, None], np.ones(len(x)), rcond=None)
    p = np.log(np.maximum(b, 1e-6))
    w, last = base.copy(), np.zeros(len(x))
    both = True
    for _ in range(rounds):
        fitted = np.exp(p[0]) * both + np.exp(p[1]) / x
        ww = w / np.maximum(fitted, 1e-12) ** 2
        try:
            if both:
                p = gauss_newton(lambda q, v: np.exp(q[0]) + np.exp(q[1]) / v, p, x, y, ww)
            else:
                p = np.array([-np.inf, gauss_newton(lambda q, v: np.exp(q[0]) / v, p[1:], x, y, ww)[0]])
        except ArithmeticError:
            if not both:
                break
            both = False  # a plateau of nothing: drop it once
            continue
        r = np.abs(y / (np.exp(p[0]) + np.exp(p[1]) / x) - 1)
        robust = np.clip(1 - (r / max(nmads * np.median(r), 1e-12)) ** 3, 0, None) ** 3
        w = base * robust
        if np.abs(robust - last).max() < 1e-8:
            break
        last = robust
    raw = Trend("cv2", p)
    sd = MAD * weighted_median(np.abs(y / raw(x) - 1), base)
    return Trend("cv2", p, std_dev=sd)


def poisson_means(low: float, high: float, points: int) -> np.ndarray:
    """Means at which counts are simulated: ``points`` of them, evenly on the log scale."""
    return np.exp(np.linspace(np.log(max(low, 1e-4)), np.log(max(high, 1e-3)), points))


def log_counts(rng: np.random.Generator, mean: float, size_factors: np.ndarray, dispersion: float = 0.0, pseudo: float = 1.0) -> np.ndarray:
    """log2(count / size factor + pseudo) of one simulated count per size factor."""
    rate = mean * size_factors
    counts = rng.poisson(rate) if dispersion <= 0 else rng.negative_binomial(1 / dispersion, 1 / (1 + dispersion * rate))
    return np.log2(counts / size_factors + pseudo)


def poisson_moments(low: float, high: float, size_factors: np.ndarray, points: int = 1000, dispersion: float = 0.0, pseudo: float = 1.0, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances of simulated log counts whose means span low..high."""
    rng = np.random.default_rng(seed)
    e = [log_counts(rng, u, size_factors, dispersion, pseudo) for u in poisson_means(low, high, points)]
    return np.array([x.mean() for x in e]), np.array([x.var(ddof=1) for x in e])


def fit_trend_poisson(means, size_factors, points: int = 1000, dispersion: float = 0.0, pseudo: float = 1.0, seed: int = 1) -> Trend:
    """Trend of purely technical variance over the range of the given log-scale means."""
    x = np.asarray(means, float)
    x = x[np.isfinite(x) & (x > 0)]
    m, v = poisson_moments(2 ** x.min() - pseudo, 2 ** x.max() - pseudo, np.asarray(size_factors, float), points, dispersion, pseudo, seed)
    return fit_trend_var(m, v, min_mean=0.0)
