"""Variance of each feature split into a trend and what exceeds it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cairnstat.functions import special
from cairnstat.functions.fits import Trend, fit_trend_cv2, fit_trend_var, log_counts, poisson_means
from cairnstat.functions.testing import METHODS, benjamini_hochberg, stouffer
from cairnstat.operators.moments import moments, shifted_lognorm_moments
from cairnstat.session import materialize
from cairnstat.sources.assays import Assay


def trend_value(trend: Trend, x: Column) -> Column:
    """The trend at a column; its few knots travel with the function."""

    @F.pandas_udf(T.DoubleType())
    def at(v: pd.Series) -> pd.Series:
        return pd.Series(trend(v.to_numpy(dtype=float))).where(v.notna().to_numpy(), None)

    return at(x)


def decompose(stats: DataFrame, trend: Trend) -> DataFrame:
    """(.., mean, total, tech, bio, log_p) from (mean, variance): bio is what exceeds the trend; upper normal tail of bio / tech."""
    x = stats.withColumn("tech", trend_value(trend, F.col("mean"))).withColumn("bio", F.col("variance") - F.col("tech"))
    x = x.withColumn("__z", F.when(F.col("tech") > 0, F.col("bio") / F.col("tech") / F.lit(float(trend.std_dev))))
    return x.withColumn("log_p", special.normal_tail_udf("__z")).withColumnRenamed("variance", "total").drop("__z")


def decompose_cv2(stats: DataFrame, trend: Trend) -> DataFrame:
    """(.., mean, total, trend, ratio, log_p) from (mean, cv2): upper tail of the ratio about 1."""
    x = stats.withColumn("trend", trend_value(trend, F.col("mean"))).withColumn("ratio", F.when(F.col("trend") > 0, F.col("cv2") / F.col("trend")))
    x = x.withColumn("__z", (F.col("ratio") - 1) / F.lit(float(trend.std_dev)))
    return x.withColumn("log_p", special.normal_tail_udf("__z")).withColumnRenamed("cv2", "total").drop("__z")


def combine_blocks(per_block: DataFrame, fields: Sequence[str], by: str = "block", geometric: bool = False, weight: str | None = None, valid: str | None = None, method: str = "fisher") -> DataFrame:
    """(feature, fields, p_value, fdr, per_block): means of ``fields`` over the valid blocks, p-values combined.

    A NULL in a valid block makes the mean NULL. Weights are equal unless
    ``weight`` is named. ``per_block`` keeps each block's row as a map.
    """
    per_block = materialize(per_block)  # three aggregates read it
    ok = F.col(valid) if valid else F.lit(True)
    x = per_block.withColumn("__ok", ok).withColumn("__w", F.col(weight).cast("double") if weight else F.lit(1.0))
    v = x.filter("__ok")

    def mean(c: str) -> Column:
        value = F.log(F.col(c)) if geometric else F.col(c)
        m = F.sum(F.col("__w") * value) / F.sum("__w")
        return F.when(F.count(c) == F.count("*"), F.exp(m) if geometric else m).alias(c)

    out = v.groupBy("feature").agg(*[mean(c) for c in fields])
    if method in ("stouffer", "z"):
        p = stouffer(v, "log_p", ["feature"], "__lp", "__w").select("feature", F.exp("__lp").alias("p_value"))
    else:
        p = METHODS[method](v.withColumn("__p", F.exp("log_p")), "__p", ["feature"], "p_value")
    kept = per_block.groupBy("feature").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(by).cast("string"), F.struct(*fields))))).alias("per_block"))
    return benjamini_hochberg(out.join(p, "feature", "left"), "p_value", [], "fdr").join(kept, "feature", "left")


def _fit_points(stats: DataFrame, value: str) -> pd.DataFrame:
    """One row per feature of a block: what a trend is fitted to."""
    return stats.filter(F.col(value).isNotNull()).orderBy("mean", "feature").select("mean", value).toArrow().to_pandas()


def _blocks(stats: DataFrame) -> list[str]:
    rows = stats.select("block", "n").distinct().collect()
    good = sorted(r.block for r in rows if r.n >= 2)
    if not good:
        raise ValueError("no block has residual degrees of freedom")
    return good


def _per_block(stats: DataFrame, fitted: DataFrame, value: str, fit, split) -> DataFrame:
    out = None
    for b in _blocks(stats):
        trend = fit(_fit_points(fitted.filter(F.col("block") == b), value))
        part = split(stats.filter(F.col("block") == b), trend)
        out = part if out is None else out.unionByName(part)
    return out


VAR_FIELDS = ("mean", "total", "tech", "bio")
CV2_FIELDS = ("mean", "total", "trend", "ratio")


def model_var(assay: Assay, fit_features: list[str] | None = None, equal_weight: bool = True, method: str = "fisher", **trend) -> DataFrame:
    """Decomposed variance of log-normalised values, trend fitted to the features themselves, combined over blocks."""
    stats = materialize(moments(assay, ["block"]).select("feature", "block", "n", "mean", "variance"))
    fitted = stats.filter(F.col("feature").isin(fit_features)) if fit_features else stats
    per = _per_block(stats, fitted, "variance", lambda p: fit_trend_var(p["mean"], p.variance, **trend), decompose)
    return combine_blocks(per, VAR_FIELDS, weight=None if equal_weight else "n", method=method)


def model_var_design(assay: Assay, design: DataFrame, columns: list[str], **trend) -> DataFrame:
    """As `model_var`, with the residual variance of a linear model in place of the variance within blocks."""
    from cairnstat.operators.linear import residual_moments

    stats = materialize(residual_moments(assay, design, columns).withColumn("block", F.lit("all")).withColumn("n", F.lit(2)))
    return combine_blocks(_per_block(stats, stats, "variance", lambda p: fit_trend_var(p["mean"], p.variance, **trend), decompose), VAR_FIELDS)


def model_var_spikes(assay: Assay, spikes: Assay, equal_weight: bool = True, method: str = "fisher", pseudo: float = 1.0, **trend) -> DataFrame:
    """As `model_var`, with the trend fitted to spike-in features (same observations, own size factors of the same mean)."""
    stats = materialize(shifted_lognorm_moments(assay, ["block"], pseudo).select("feature", "block", "n", "mean", "variance"))
    other = materialize(shifted_lognorm_moments(spikes, ["block"], pseudo).select("feature", "block", "n", "mean", "variance"))
    per = _per_block(stats, other, "variance", lambda p: fit_trend_var(p["mean"], p.variance, **trend), decompose)
    return combine_blocks(per, VAR_FIELDS, weight=None if equal_weight else "n", method=method)


#: Observations whose counts one task simulates at a time.
SIMULATED_ROWS = 5_000


def simulated_moments(observations: DataFrame, spans: dict[str, tuple[float, float]], points: int, dispersion: float, pseudo: float, seed: int) -> DataFrame:
    """(block, point, m, v): moments of simulated log counts over all observations of a block.

    Every size factor takes part: observations are simulated bucket by bucket
    (of a hash of obs, SIMULATED_ROWS on average) and the buckets' sums
    added up. The outcome depends on the observations and the seed only.
    """
    known = observations.filter("size_factor > 0 and block is not null").select("obs", "block", F.col("size_factor").cast("double").alias("size_factor"))
    buckets = max(1, -(-known.count() // SIMULATED_ROWS))
    placed = known.withColumn("__b", F.pmod(F.xxhash64("obs"), F.lit(buckets)).cast("int"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block, bucket = key
        if block not in spans:
            return pd.DataFrame({"block": [], "point": [], "n": [], "s": [], "q": []})
        sf = pdf.sort_values("obs").size_factor.to_numpy()
        mu = poisson_means(*spans[block], points)
        rng = np.random.default_rng([seed, int(bucket)])
        e = np.array([log_counts(rng, u, sf, dispersion, pseudo) for u in mu]) - np.log2(mu + pseudo)[:, None]
        return pd.DataFrame({"block": block, "point": np.arange(points), "n": len(sf), "s": e.sum(axis=1), "q": (e * e).sum(axis=1)})

    sums = placed.groupBy("block", "__b").applyInPandas(run, "block string, point int, n bigint, s double, q double")
    total = sums.groupBy("block", "point").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    return total.select("block", "point", (F.col("s") / F.col("n")).alias("m"), F.when(F.col("n") > 1, (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("v"))


def model_var_poisson(assay: Assay, points: int = 1000, dispersion: float = 0.0, pseudo: float = 1.0, seed: int = 1, equal_weight: bool = True, method: str = "fisher") -> DataFrame:
    """As `model_var`, with a trend from simulated Poisson (or negative binomial) counts of all observations. Size factors are used as given."""
    stats = materialize(shifted_lognorm_moments(assay, ["block"], pseudo).select("feature", "block", "n", "mean", "variance"))
    good = _blocks(stats)
    ends = stats.filter("mean > 0").groupBy("block").agg(F.min("mean").alias("low"), F.max("mean").alias("high")).collect()
    spans = {r.block: (2**r.low - pseudo, 2**r.high - pseudo) for r in ends if r.block in good}
    made = simulated_moments(assay.observations, spans, points, dispersion, pseudo, seed).toPandas()
    out = None
    for b in good:
        if b not in spans:
            continue
        own = made[made.block == b].sort_values("point")
        mu = np.log2(poisson_means(*spans[b], points) + pseudo)
        part = decompose(stats.filter(F.col("block") == b), fit_trend_var(own.m.to_numpy() + mu, own.v.to_numpy(), min_mean=0.0))
        out = part if out is None else out.unionByName(part)
    return combine_blocks(out, VAR_FIELDS, weight=None if equal_weight else "n", method=method)


def _cv2(assay: Assay) -> DataFrame:
    m = moments(assay.normalized(log=False), ["block"])
    return materialize(m.select("feature", "block", "n", "mean", F.when(F.col("mean") > 0, F.col("variance") / (F.col("mean") * F.col("mean"))).alias("cv2")))


def model_cv2(assay: Assay, spikes: Assay | None = None, equal_weight: bool = True, method: str = "fisher", **trend) -> DataFrame:
    """Squared coefficient of variation against its trend, over the features or over spike-ins; combined by geometric means."""
    stats = _cv2(assay)
    fitted = _cv2(spikes) if spikes is not None else stats
    sizes = {r.block: r.n for r in stats.select("block", "n").distinct().collect()}
    out = None
    for b in _blocks(stats):
        pts = _fit_points(fitted.filter(F.col("block") == b), "cv2")
        part = decompose_cv2(stats.filter(F.col("block") == b), fit_trend_cv2(pts["mean"], pts.cv2, sizes[b], **trend))
        out = part if out is None else out.unionByName(part)
    return combine_blocks(out, CV2_FIELDS, geometric=True, weight=None if equal_weight else "n", method=method)


def combine_tables(tables: Sequence[DataFrame], geometric: bool = False, weights: Sequence[float] | None = None, method: str = "fisher") -> DataFrame:
    """Combine several decompositions: numeric columns they share, apart from p_value and fdr, over the features of the first."""
    shared = [c for c, t in tables[0].dtypes if t in ("double", "float", "int", "bigint") and c not in ("p_value", "fdr", "log_p") and all(dict(x.dtypes).get(c) in ("double", "float", "int", "bigint") for x in tables)]
    rows = None
    for i, t in enumerate(tables):
        part = t.select("feature", F.lit(str(i)).alias("block"), F.lit(float(weights[i]) if weights else 1.0).alias("w"), F.log("p_value").alias("log_p"), *shared)
        rows = part if rows is None else rows.unionByName(part)
    return combine_blocks(rows, shared, geometric=geometric, weight="w", method=method)


def top_features(stats: DataFrame, by: str = "bio", n: int | None = None, prop: float | None = None, threshold: float | None = 0.0, fdr: float | None = None) -> DataFrame:
    """(feature, place): features by descending ``by``, strictly above ``threshold``, FDR at most ``fdr``.

    The first max(n, prop of those left, rounded half to even) are kept; all if
    neither is given. Ties by name.
    """
    x = stats.filter(F.col(by).isNotNull())
    if fdr is not None:
        x = x.filter(F.col("fdr") <= fdr)
    if threshold is not None:
        x = x.filter(F.col(by) > threshold)
    keep = None
    if n is not None or prop is not None:
        keep = max(n or 0, round((prop or 0.0) * x.count()))
    x = x.select("feature", by).orderBy(F.col(by).desc(), "feature")
    if keep is not None:
        x = x.limit(keep)
    from pyspark.sql import Window

    return x.select("feature", F.row_number().over(Window.orderBy(F.col(by).desc(), "feature")).alias("place"))
