"""Linear models per feature and pseudo-bulk tests.

Coefficients are linear in the values, so each is one weighted sum over the
stored values: weights come from the design once, on the driver, and are
joined to the values; zeros add nothing. Residual sums of squares follow from
the sum of squares and the coefficients.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cairnstat.functions import special
from cairnstat.functions.testing import METHODS, benjamini_hochberg, stouffer, weighted_mean
from cairnstat.operators.moments import moments
from cairnstat.session import materialize, parallelism
from cairnstat.sources.assays import Assay


def gram(design: DataFrame, columns: list[str]) -> tuple[np.ndarray, int]:
    """X'X and the number of rows of a design table (obs, columns), as one aggregate row."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = design.agg(F.count("*").alias("n"), *[F.sum(F.col(columns[i]).cast("double") * F.col(columns[j]).cast("double")).alias(f"g{i}_{j}") for i, j in pairs]).first()
    g = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return g, row.n


def least_squares(values: DataFrame, features: DataFrame, design: DataFrame, columns: list[str]) -> tuple[DataFrame, np.ndarray | None, int]:
    """(feature, b0.., sigma2), (X'X)^-1 and residual degrees of freedom; None for a design without full rank."""
    g, n = gram(design, columns)
    p = len(columns)
    if n == 0 or np.linalg.matrix_rank(g) < p:
        return features.select("feature", *[F.lit(None).cast("double").alias(f"b{i}") for i in range(p)], F.lit(None).cast("double").alias("sigma2")), None, n - p
    inv = np.linalg.inv(g)
    s = values.join(design.select("obs", *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns)]), "obs")
    sums = s.groupBy("feature").agg(*[F.sum(F.col("value") * F.col(f"__x{i}")).alias(f"__s{i}") for i in range(p)], F.sum(F.col("value") * F.col("value")).alias("__q"))
    full = features.select("feature").join(sums, "feature", "left").na.fill(0.0)
    beta = [sum((F.col(f"__s{j}") * float(inv[i, j]) for j in range(p)), F.lit(0.0)) for i in range(p)]
    fit = full.select("feature", *[b.alias(f"b{i}") for i, b in enumerate(beta)], "__q", *[f"__s{i}" for i in range(p)])
    rss = F.col("__q") - sum((F.col(f"b{i}") * F.col(f"__s{i}") for i in range(p)), F.lit(0.0))
    df = n - p
    return fit.select("feature", *[f"b{i}" for i in range(p)], (F.greatest(rss, F.lit(0.0)) / df if df > 0 else F.lit(None).cast("double")).alias("sigma2")), inv, df


def residual_moments(assay: Assay, design: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, variance): raw mean, and residual variance of the model."""
    fit, inv, df = least_squares(assay.values, assay.features, design, columns)
    if inv is None or df <= 0:
        raise ValueError("no residual degrees of freedom")
    mean = moments(Assay(assay.values, assay.features, design.select("obs", F.lit("all").alias("block"))), ["block"]).select("feature", "mean")
    return mean.join(fit.select("feature", F.col("sigma2").alias("variance")), "feature")


def residuals(assay: Assay, design: DataFrame, columns: list[str]) -> Assay:
    """The assay less what a linear model of every feature explains. Residuals are dense: choose the features first."""
    fit, inv, _ = least_squares(assay.values, assay.features, design, columns)
    if inv is None:
        raise ValueError("the design has no full rank")
    coefs = fit.agg(F.collect_list(F.struct("feature", *[f"b{i}" for i in range(len(columns))])).alias("__f"))  # one row, an entry per feature
    d = design.select("obs", *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns)])
    grid = d.join(F.broadcast(coefs)).select("*", F.explode("__f").alias("__e"))
    fitted = sum((F.col(f"__e.b{i}") * F.col(f"__x{i}") for i in range(len(columns))), F.lit(0.0))
    grid = grid.select("obs", F.col("__e.feature").alias("feature"), fitted.alias("__fit"))
    x = grid.join(assay.values, ["feature", "obs"], "left").select("feature", "obs", (F.coalesce("value", F.lit(0.0)) - F.col("__fit")).alias("value"))
    o = assay.observations.join(design.select("obs"), "obs", "left_semi").withColumn("block", F.lit("all"))
    return Assay(x, assay.features, o)


def contrast_test(assay: Assay, design: DataFrame, columns: list[str], coefs: list[int] | None = None, contrasts: np.ndarray | None = None) -> DataFrame:
    """(feature, estimates, log_p, p_value, fdr): t test of one contrast (logfc), F test of several together.

    ``coefs`` are column numbers, by default the last. A design without full
    rank or residual degrees of freedom gives NULLs.
    """
    p = len(columns)
    if contrasts is None:
        at = [p - 1] if coefs is None else list(coefs)
        c, names = np.eye(p)[at].T, ["logfc"] if len(at) == 1 else [columns[i] for i in at]
    else:
        c = np.asarray(contrasts, float).reshape(p, -1)
        names = ["logfc"] if c.shape[1] == 1 else [f"contrast_{i + 1}" for i in range(c.shape[1])]
    fit, inv, df = least_squares(assay.values, assay.features, design, columns)
    est = [sum((F.col(f"b{i}") * float(c[i, k]) for i in range(p)), F.lit(0.0)).alias(n) for k, n in enumerate(names)]
    x = fit.select("feature", *est, "sigma2")
    if inv is None or df <= 0:
        return x.select("feature", *names, *[F.lit(None).cast("double").alias(n) for n in ("log_p", "p_value", "fdr")])
    v = c.T @ inv @ c
    if len(names) == 1:
        x = x.withColumn("__t", F.when(F.col("sigma2") > 0, F.abs("logfc") / F.sqrt(F.col("sigma2") * float(v[0, 0])))).withColumn("__d", F.lit(float(df)))
        x = x.withColumn("log_p", F.least(F.lit(0.0), special.t_tail_udf("__t", "__d") + special.LN2))
    else:
        vi = np.linalg.pinv(v)
        quad = sum((F.col(a) * F.col(b) * float(vi[i, j]) for i, a in enumerate(names) for j, b in enumerate(names)), F.lit(0.0))
        x = x.withColumn("__f", F.when(F.col("sigma2") > 0, quad / len(names) / F.col("sigma2"))).withColumn("__a", F.lit(float(len(names)))).withColumn("__d", F.lit(float(df)))
        x = x.withColumn("log_p", special.f_tail_udf("__f", "__a", "__d"))
    x = x.select("feature", *names, "log_p", F.exp("log_p").alias("p_value"))
    return benjamini_hochberg(x, "p_value", [], "fdr")


def contrast_test_blocked(assay: Assay, design: DataFrame, columns: list[str], block: str = "block", equal_weight: bool = False, method: str = "stouffer", **what) -> DataFrame:
    """Fits per block of the design, combined; blocks without rank or degrees of freedom are left out, and all of them is an error."""
    blocks = [r[0] for r in design.select(block).filter(F.col(block).isNotNull()).distinct().orderBy(block).collect()]
    rows, names = None, None
    for b in blocks:
        d = design.filter(F.col(block) == b)
        g, n = gram(d, columns)
        if np.linalg.matrix_rank(g) < len(columns) or n <= len(columns):
            continue
        t = contrast_test(assay, d, columns, **what)
        names = [c for c in t.columns if c not in ("feature", "log_p", "p_value", "fdr")]
        t = t.select("feature", *names, "log_p", "p_value", F.lit(1.0 if equal_weight else float(n - len(columns))).alias("w"))
        rows = t if rows is None else rows.unionByName(t)
    if rows is None:
        raise ValueError("no block has residual degrees of freedom")
    est = rows.groupBy("feature").agg(*[weighted_mean(F.col(n), F.col("w")).alias(n) for n in names])
    if method in ("stouffer", "z"):
        p = stouffer(rows, "log_p", ["feature"], "__lp", "w").select("feature", F.exp("__lp").alias("p_value"))
    else:
        p = METHODS[method](rows, "p_value", ["feature"], "p_value")
    return benjamini_hochberg(est.join(p, "feature", "left"), "p_value", [], "fdr")


def pairwise_t_design(assay: Assay, design: DataFrame | None = None, columns: list[str] | None = None, direction: str = "any", lfc: float = 0.0) -> DataFrame:
    """(feature, first, second, logfc, p_value, fdr): every ordered pair of groups in one linear model with further covariates.

    The model has a mean per group and the named columns of ``design`` (obs,
    ..) but an intercept, which is dropped. All pairs share the residual
    variance, floored at 1e-8.
    """
    groups = sorted(r.grp for r in assay.observations.select("grp").filter("grp <> ''").distinct().collect())
    columns = [c for c in columns or [] if c != "(Intercept)"]
    x = assay.observations.filter("grp <> ''").select("obs", *[(F.col("grp") == g).cast("double").alias(f"__g{i}") for i, g in enumerate(groups)])
    if design is not None:
        x = x.join(design.select("obs", *columns), "obs")
    names = [f"__g{i}" for i in range(len(groups))] + columns
    fit, inv, df = least_squares(assay.values, assay.features, x, names)
    if inv is None or df <= 0:
        raise ValueError("no residual degrees of freedom")
    fit = materialize(fit)
    each = []
    for i, a in enumerate(groups):
        for j, b in enumerate(groups):
            if i != j:
                unit = float(inv[i, i] + inv[j, j] - 2 * inv[i, j])
                each.append(F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), (F.col(f"b{i}") - F.col(f"b{j}")).alias("logfc"), F.sqrt(F.greatest("sigma2", F.lit(1e-8)) * unit).alias("se")))
    p = fit.select("feature", F.explode(F.array(*each)).alias("e")).select("feature", "e.*").withColumn("__d", F.lit(float(df)))
    p = p.withColumn("__l", -(F.col("logfc") + lfc) / F.col("se")).withColumn("__r", (F.col("logfc") - lfc) / F.col("se"))
    p = p.withColumn("left", special.t_tail_udf("__l", "__d")).withColumn("right", special.t_tail_udf("__r", "__d"))
    lp = {"up": F.col("right"), "down": F.col("left"), "any": F.least(F.lit(0.0), F.least("left", "right") + special.LN2)}[direction]
    return benjamini_hochberg(p.select("feature", "first", "second", "logfc", F.exp(lp).alias("p_value")), "p_value", ["first", "second"], "fdr")


# pseudo-bulk: few samples per label, many features; labels are independent


def _tmm(counts: np.ndarray) -> np.ndarray:
    """Trimmed mean of M-values factors against the sample whose upper quartile is nearest the mean."""
    lib = counts.sum(axis=0)
    q = np.array([np.percentile(c[c > 0], 75) if (c > 0).any() else 0 for c in counts.T]) / lib
    ref = int(np.argmin(np.abs(q - q.mean())))
    out = np.ones(counts.shape[1])
    for j in range(counts.shape[1]):
        a, b = counts[:, j], counts[:, ref]
        ok = (a > 0) & (b > 0)
        if j == ref or ok.sum() < 3:
            continue
        pa, pb = a[ok] / lib[j], b[ok] / lib[ref]
        m, e = np.log2(pa / pb), 0.5 * np.log2(pa * pb)
        v = (lib[j] - a[ok]) / lib[j] / a[ok] + (lib[ref] - b[ok]) / lib[ref] / b[ok]
        n = len(m)
        rm, re = np.argsort(np.argsort(m)), np.argsort(np.argsort(e))
        keep = (rm >= int(n * 0.3)) & (rm < n - int(n * 0.3)) & (re >= int(n * 0.05)) & (re < n - int(n * 0.05))
        if keep.any() and np.abs(m).max() > 1e-6:
            out[j] = 2 ** np.average(m[keep], weights=1 / np.maximum(v[keep], 1e-12))
    return out / np.exp(np.log(out).mean())


def _expressed(counts: np.ndarray, design: np.ndarray) -> np.ndarray:
    """Features with enough counts in as many samples as the smallest group has."""
    lib = counts.sum(axis=0)
    least = 1.0 / np.max(np.einsum("ij,jk,ik->i", design, np.linalg.pinv(design.T @ design), design))
    if least > 10:
        least = 10 + (least - 10) * 0.7
    cut = 10 / np.median(lib) * 1e6
    return ((counts / lib * 1e6 >= cut).sum(axis=1) >= least - 1e-9) & (counts.sum(axis=1) >= 15 - 1e-9)


def _shrink(s2: np.ndarray, df: int) -> tuple[float, float]:
    """Prior variance and degrees of freedom of an inverse-chi-square prior, by moments of log variances."""
    e = np.log(np.maximum(s2, 1e-300))
    tri = lambda x: 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3)
    di = lambda x: np.log(x) - 1 / (2 * x) - 1 / (12 * x**2)
    half = df / 2 + 3  # shifted into the range of the series
    digamma = di(half) - sum(1 / (df / 2 + k) for k in range(3))
    trigamma = tri(half) + sum(1 / (df / 2 + k) ** 2 for k in range(3))
    spread = e.var(ddof=1) - trigamma if len(e) > 1 else 0.0
    if spread <= 1e-8:
        return float(np.exp(e.mean() - digamma + np.log(df / 2))), np.inf
    d0 = 2 * (0.5 + 1 / spread)
    x = d0 / 2 + 3
    dig0 = di(x) - sum(1 / (d0 / 2 + k) for k in range(3))
    return float(np.exp(e.mean() - digamma + np.log(df / 2) + dig0 - np.log(d0 / 2))), float(d0)


def _voom(counts: np.ndarray, lib: np.ndarray, design: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log2 counts per million and precision weights from the trend of residual spread on abundance."""
    from cairnstat.functions.fits import lowess

    y = np.log2((counts + 0.5) / (lib + 1) * 1e6)
    h = np.linalg.pinv(design)
    fit = y @ h.T @ design.T
    sd = np.sqrt(((y - fit) ** 2).sum(axis=1) / max(design.shape[0] - design.shape[1], 1))
    x = y.mean(axis=1) + np.log2((lib + 1).prod() ** (1 / len(lib))) - np.log2(1e6)
    s = lowess(x, np.sqrt(np.maximum(sd, 1e-8)), np.ones(len(x)), span=0.5)
    o = np.argsort(x)
    at = np.log2(2**fit * (lib + 1) / 1e6)
    return y, 1.0 / np.maximum(np.interp(at, x[o], s[o]), 1e-4) ** 4


def bulk_test(counts: np.ndarray, design: np.ndarray, contrast: np.ndarray, lfc: float = 0.0, method: str = "quasi") -> pd.DataFrame | None:
    """logfc, abundance, p, se, df per feature for one label; None if the design has no rank or no residual degrees of freedom.

    Counts are normalised by trimmed means; precision-weighted least squares on
    log counts ("voom"), or a negative binomial log-linear fit with dispersions
    that follow a trend on abundance and quasi-likelihood variances ("quasi");
    feature variances shrink to a common prior. With one coefficient the F test
    is the two-sided t test on df degrees of freedom. Features with too few
    counts have NaN.
    """
    n, p = design.shape
    if n <= p or np.linalg.matrix_rank(design) < p:
        return None
    keep = _expressed(counts, design)
    out = pd.DataFrame({"logfc": np.nan, "abundance": np.nan, "p": np.nan}, index=range(len(counts))).assign(se=np.nan, df=np.nan)
    if not keep.any():
        return out
    c = counts[keep]
    lib = c.sum(axis=0) * _tmm(c)
    df = n - p
    if method == "voom":
        y, w = _voom(c, lib, design)
        xtwx = np.einsum("ij,gi,ik->gjk", design, w, design)
        inv = np.linalg.pinv(xtwx)
        beta = np.einsum("gjk,gk->gj", inv, (w * y) @ design)
        s2 = (w * (y - beta @ design.T) ** 2).sum(axis=1) / df
        logfc, unit = beta @ contrast, np.einsum("j,gjk,k->g", contrast, inv, contrast)
    else:
        off = np.log(lib / np.exp(np.log(lib).mean()))
        disp = np.full((len(c), 1), 0.1)
        for _ in range(3):
            beta, mu, inv = _nb_fit(c, design, off, disp)
            disp = _dispersion_trend(c, mu, n / df)
        beta, mu, inv = _nb_fit(c, design, off, disp)
        s2 = ((c - mu) ** 2 / (mu + disp * mu**2)).sum(axis=1) / df
        logfc, unit = beta @ contrast / np.log(2), np.einsum("j,gjk,k->g", contrast, inv, contrast) / np.log(2) ** 2
    s0, d0 = _shrink(s2, df)
    post = np.full(len(s2), s0) if np.isinf(d0) else (d0 * s0 + df * s2) / (d0 + df)
    dft = np.full(len(s2), min(d0 + df, 1e6))
    se = np.sqrt(np.maximum(post * unit, 1e-300))
    out.loc[keep, "logfc"], out.loc[keep, "p"], out.loc[keep, "se"], out.loc[keep, "df"] = logfc, effect_p(logfc, se, dft, lfc), se, dft
    out.loc[keep, "abundance"] = np.log2((c + 0.5) / (lib + 1) * 1e6).mean(axis=1)
    return out


def effect_p(effect: np.ndarray, se: np.ndarray, df: np.ndarray, lfc: float = 0.0) -> np.ndarray:
    """Two-sided p of an effect against 0, or against the interval from -lfc to lfc."""
    size = np.abs(effect)
    if lfc == 0:
        return np.exp(np.minimum(0.0, special.log_t_tail(size / se, df) + special.LN2))
    return np.exp(np.minimum(0.0, np.logaddexp(special.log_t_tail((size - lfc) / se, df), special.log_t_tail((size + lfc) / se, df))))


def _dispersion_trend(c: np.ndarray, mu: np.ndarray, ratio: float) -> np.ndarray:
    """A dispersion per feature (a column): moment estimates, pulled onto a smooth trend over log abundance."""
    from cairnstat.functions.fits import lowess

    own = ((c - mu) ** 2 - mu).sum(axis=1) / (mu**2).sum(axis=1) * ratio
    common = float(np.clip((((c - mu) ** 2 - mu).sum() / (mu**2).sum()) * ratio, 1e-4, 10.0))
    if len(c) < 50:  # too few features for a trend
        return np.full((len(c), 1), common)
    trend = lowess(np.log(mu.mean(axis=1)), np.clip(own, -10.0, 10.0), np.ones(len(c)), span=0.5, rounds=1)
    return np.clip(trend, 1e-4, 10.0)[:, None]


def _nb_fit(c: np.ndarray, x: np.ndarray, off: np.ndarray, disp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Negative binomial log-linear fits of all features at once by weighted least squares."""
    mu = np.maximum(c, 0.5)
    beta = np.linalg.lstsq(x, (np.log(mu) - off).T, rcond=None)[0].T
    for _ in range(30):
        eta = np.clip(beta @ x.T + off, -30, 30)
        mu = np.exp(eta)
        w = mu / (1 + disp * mu)
        inv = np.linalg.pinv(np.einsum("ij,gi,ik->gjk", x, w, x) + 1e-10 * np.eye(x.shape[1]))
        new = np.einsum("gjk,gk->gj", inv, (w * (eta - off + (c - mu) / mu)) @ x)
        if np.abs(new - beta).max() < 1e-8:
            beta = new
            break
        beta = np.clip(new, -50, 50)
    return beta, np.exp(np.clip(beta @ x.T + off, -30, 30)), inv


def pseudo_bulk(counts: DataFrame, design: Callable[[pd.DataFrame], np.ndarray], contrast: np.ndarray, lfc: float = 0.0, method: str = "quasi") -> DataFrame:
    """(label, feature, logfc, abundance, p_value, se, df, fdr): each label tested on its samples.

    ``counts`` has (label, sample, feature, value, covariates..) with one row
    per stored count; ``design`` gets one row per sample of a label, ordered by
    sample, and returns its design matrix. Labels whose design fails are left
    out (`failed_labels` lists them). A label's task holds features x samples of that label only.
    """
    covariates = [c for c in counts.columns if c not in ("label", "sample", "feature", "value")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"label": pd.Series(dtype=str), "feature": pd.Series(dtype=str), "logfc": pd.Series(dtype=float), "abundance": pd.Series(dtype=float), "p_value": pd.Series(dtype=float), "se": pd.Series(dtype=float), "df": pd.Series(dtype=float)})
        samples = pdf.drop_duplicates("sample").sort_values("sample")[["sample", *covariates]].reset_index(drop=True)
        wide = pdf.pivot_table(index="feature", columns="sample", values="value", aggfunc="sum", fill_value=0.0)[samples["sample"].tolist()]
        try:
            x = np.asarray(design(samples), float)
        except Exception:
            return empty
        t = bulk_test(wide.to_numpy(float), x, np.asarray(contrast, float), lfc, method) if x.shape[1] == len(contrast) else None
        if t is None:
            return empty
        return pd.DataFrame({"label": pdf["label"].iloc[0], "feature": wide.index, "logfc": t.logfc.to_numpy(), "abundance": t.abundance.to_numpy(), "p_value": t.p.to_numpy(), "se": t.se.to_numpy(), "df": t["df"].to_numpy()})

    out = counts.repartition(parallelism(counts.sparkSession), "label").groupBy("label").applyInPandas(run, "label string, feature string, logfc double, abundance double, p_value double, se double, df double")
    nn = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return benjamini_hochberg(out.select("label", "feature", nn("logfc"), nn("abundance"), nn("p_value"), nn("se"), nn("df")), "p_value", ["label"], "fdr")


def failed_labels(counts: DataFrame, results: DataFrame) -> DataFrame:
    """(label): those of ``counts`` that `pseudo_bulk` could not test."""
    return counts.select("label").distinct().join(results.select("label").distinct(), "label", "left_anti")


def pseudo_bulk_specific(results: DataFrame, average: str = "median", missing_as_zero: bool = False, lfc: float = 0.0) -> DataFrame:
    """(label, feature, logfc, other_average, p_value, fdr): effects that a label does not share with the others.

    ``results`` comes from `pseudo_bulk`. p is 1 if the effect lies between 0
    and the average effect of the other labels, else the larger of its p
    against 0 and of its p against that average. An average as null effect
    shifts the fit within the design's space, so the second test is that of
    the shifted effect with the same standard error and degrees of freedom.
    Missing effects of other labels are left out, or count as 0 with
    ``missing_as_zero``; where none is left, ``other_average`` is NULL and the
    null effect 0. Every pair of labels of a feature is met: labels are the
    levels of a design factor.
    """
    r = materialize(results)
    others = r.select(F.col("label").alias("__l"), "feature", (F.coalesce("logfc", F.lit(0.0)) if missing_as_zero else F.col("logfc")).alias("__o")).filter("__o is not null")
    agg = F.median("__o") if average == "median" else F.avg("__o")
    avg = r.select("label", "feature").join(others, "feature").filter("label <> __l").groupBy("label", "feature").agg(agg.alias("other_average"))
    x = r.join(avg, ["label", "feature"], "left")

    @F.pandas_udf("double")
    def against(effect: pd.Series, se: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(effect_p(effect.to_numpy(float), se.to_numpy(float), df.to_numpy(float), lfc)).where(effect.notna().to_numpy() & se.notna().to_numpy(), None)

    null = F.coalesce("other_average", F.lit(0.0))
    x = x.withColumn("__p", against(F.col("logfc") - null, "se", "df"))
    between = (F.signum("logfc") == F.signum(null)) & (F.abs("logfc") <= F.abs(null))
    p = F.when(F.col("p_value").isNull(), None).when(between, 1.0).otherwise(F.greatest("p_value", "__p"))
    return benjamini_hochberg(x.select("label", "feature", "logfc", "other_average", p.alias("p_value")), "p_value", ["label"], "fdr")


def decide_tests(results: DataFrame, threshold: float = 0.05, whole: bool = False, effect: str = "logfc") -> DataFrame:
    """(label, feature, status): sign of the effect where the FDR, per label or over all, is at most ``threshold``; else 0; NULL without a p-value."""
    x = benjamini_hochberg(results, "p_value", [] if whole else ["label"], "__f")
    status = F.when(F.col("__f").isNull(), None).when(F.col("__f") <= threshold, F.signum(effect)).otherwise(0.0)
    return x.select("label", "feature", status.cast("int").alias("status"))


def summarize_tests(decided: DataFrame) -> DataFrame:
    """(label, down, unchanged, up, missing): features by status."""
    return decided.groupBy("label").agg(
        F.count_if(F.col("status") == -1).alias("down"), F.count_if(F.col("status") == 0).alias("unchanged"),
        F.count_if(F.col("status") == 1).alias("up"), F.count_if(F.col("status").isNull()).alias("missing"),
    )
